"""Quality rules per document, and verdicts on whole hosts from shrunken failure rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvelake.llm.base import SPACES, covered, let, store, told, windows, words_of

SYMBOLS = "#*$%&|<>"


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _repeat_words(words: Column, size: int) -> Column:
    """Words inside windows found twice or more: equal window hashes lie side by side once sorted with their places."""

    def count(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            placed,
            lambda s: F.filter(
                s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]).__or__(F.get(s, j + 1)["h"] == x["h"])
            ),
        )
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(starts, lambda s: covered(s, size))
        )

    return let(windows(words, size), count)


def document_rules(
    docs: DataFrame, text: str = "text", min_words: int = 20, max_repeat_percent: int = 30, window: int = 8
) -> DataFrame:
    """``docs`` with counts per text and ``base_failed``. A null text has no words; repeated rows each get theirs.

    Windows are compared by 64-bit hashes inside one document.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    counts = let(
        words_of(raw),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w, window).alias("r")),
    )
    out = docs.withColumns(
        {
            "_rules": counts,
            "word_chars": F.length(F.regexp_replace(raw, SPACES, "")).cast("long"),
            "n_symbols": (F.length(raw) - F.length(F.translate(raw, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": _dup_lines(raw).cast("long"),
        }
    )
    out = out.withColumns({"n_words": F.col("_rules.n"), "n_repeat_words": F.col("_rules.r")}).drop("_rules")
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    )
    return out.withColumn("base_failed", failed)


def host_verdicts(rules: DataFrame, host: str, max_host_failure: float = 0.5) -> DataFrame:
    """One row per host: pages, failures, the failure rate shrunk by a beta prior, and whether the host is rejected.

    The prior is fitted to the rates of all hosts by their mean and variance. Without variance the mean stands for
    every host. A null host is a host of its own.
    """
    per_host = rules.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.col("base_failed").cast("long")).alias("failures")
    )
    rate = F.col("failures") / F.col("pages")
    mean, var = per_host.agg(F.avg(rate), F.var_pop(rate)).first()  # two numbers
    if mean is None:
        mean, var = 0.0, 0.0
    spread = mean * (1 - mean)
    if var is None or var <= 0 or var >= spread:
        strength = float("inf") if not var else 0.0
    else:
        strength = spread / var - 1
    if strength == float("inf"):
        shrunk = F.lit(float(mean))
    else:
        shrunk = (F.col("failures") + F.lit(mean * strength)) / (F.col("pages") + F.lit(float(strength)))
    return per_host.withColumn("host_failure", shrunk).withColumn(
        "host_rejected", F.col("host_failure") > max_host_failure
    )


def quality_rules(docs: DataFrame, host: str = "source", max_host_failure: float = 0.5) -> DataFrame:
    """Counts, ``base_failed``, ``host_failure`` and ``kept`` of each row of ``docs`` (doc_id, text, ``host``).

    A document is kept if it passes its own rules and its host's shrunken failure rate is at most
    ``max_host_failure``. Null, empty and repeated rows each give a row; an empty table gives an empty one.
    """
    narrow = document_rules(docs.select("doc_id", F.col(host).alias("host"), "text")).drop("text")
    rules, _ = store(narrow, "rules")
    verdicts = host_verdicts(rules, "host", max_host_failure)
    bad = told(verdicts.filter("host_rejected").select(F.col("host").alias("_host"), F.lit(True).alias("_bad")))
    joined = rules.join(bad, rules["host"].eqNullSafe(F.col("_host")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("_bad").isNull()).drop("_host", "_bad")


def keep_documents(docs: DataFrame, host: str = "source", max_host_failure: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    marked = document_rules(
        docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text")), text="_text"
    ).select("_row", "base_failed")
    marked = marked.withColumn("_host", F.col(f"_row.{host}"))
    marked, _ = store(marked, "ruled")
    verdicts = host_verdicts(marked, "_host", max_host_failure)
    rejected = told(verdicts.filter("host_rejected").select(F.col("host").alias("_bad_host")))
    kept = marked.filter(~F.col("base_failed"))
    return kept.join(rejected, kept["_host"].eqNullSafe(F.col("_bad_host")), "left_anti").select("_row.*")
