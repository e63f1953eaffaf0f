"""Folding, time, id and error expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fold(col: Column | str) -> Column:
    """Key for case-insensitive equality; a plain string, so joins and groupings stay hash based."""
    return F.lower(_c(col))


def epoch(col: Column | str) -> Column:
    """Naive timestamp to epoch seconds (the session zone is UTC)."""
    return F.unix_seconds(_c(col).cast("timestamp"))


def to_second(col: Column | str) -> Column:
    """Round a naive timestamp to whole seconds, half up."""
    micros = F.unix_micros(_c(col).cast("timestamp"))
    return F.timestamp_seconds(F.floor((micros + 500000) / 1000000)).cast("timestamp_ntz")


def stamp(text: str | None) -> Column:
    """``text`` as a naive timestamp, the clock if it is None."""
    return F.localtimestamp() if text is None else F.lit(text).cast("timestamp_ntz")


def stable_id(kind: str, *cols: Column | str) -> Column:
    """A uuid-shaped id that depends only on its inputs, so a retried task writes the same id.

    Each part is written with its length, a null as a mark of its own, so that no two lists of parts read alike.
    """
    texts = [F.lit(kind), *[_c(c).cast("string") for c in cols]]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    digest = F.md5(F.concat_ws("|", *parts))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])


# The spellings of a uuid.
_HYPHENATED = "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
UUID = rf"^([0-9a-fA-F]{{32}}|{_HYPHENATED}|\{{{_HYPHENATED}\}}|urn:uuid:{_HYPHENATED})$"


def uuid_of(col: Column | str) -> Column:
    """The one spelling (hyphens, lower case) of a text that reads as a uuid, else null."""
    c = _c(col)
    digits = F.lower(F.regexp_replace(c, r"^urn:uuid:|[-{}]", ""))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.when(c.rlike(UUID), F.concat_ws("-", *[F.substring(digits, start, size) for start, size in cuts]))
