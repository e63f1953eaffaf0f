"""Tables with nulls, empty and long texts, repeated rows, and columns whose names clash with those of operators."""

from __future__ import annotations

DDL = (
    "doc_id long, text string, lang string, source string, n_chars long, key int, rank string, length int, score int, "
    "hits string, marks string, component int, _row string, label int, n int, n_lines int, n_words string, w int"
)

LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
BASE = " ".join(f"common{i}" for i in range(60))


def rows():
    texts = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t \n", "en", "a"), (4, BASE, "en", "a"),
        (4, BASE, "en", "a"), (5, BASE, "de", None), (6, BASE + " more", None, "b"), (7, LONG, "en", "b"),
        (8, "tail " + LONG, "en", "b"), (9, "é𝄞 ß x y", "fr", "b"), (10, "one", "en", "b"),
        (11, "ONE", "en", "b"), (None, BASE, "en", "a"), (None, None, None, None), (12, "x " * 300, "en", "a"),
        (13, "a\x00b\x0bc\x0cd\re", "en", "a"), (-3, BASE + " less", "en", "a"),
    ]
    return [(d, t, lang, s, len(t or ""), 1, "r", 2, 3, "h", "m", 4, "_", 5, 6, 7, "x", 8) for d, t, lang, s in texts]


def docs(spark):
    return spark.createDataFrame(rows(), DDL).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DDL)


def pairs():
    """(doc_id, text) once per id, for the plain versions."""
    return [(d, t) for d, t in {r[0]: r[1] for r in rows() if r[0] is not None}.items()]
