from __future__ import annotations

import datetime as dt

BASE = dt.datetime(2024, 1, 1)


def ts(seconds: float) -> dt.datetime:
    return BASE + dt.timedelta(seconds=seconds)


def sec(value: dt.datetime) -> int:
    return int((value - BASE).total_seconds())


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def as_set(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def as_list(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def as_dict(df, key, *cols):
    out = {}
    for r in df.select(key, *cols).collect():
        assert r[0] not in out, f"two rows for {r[0]}"
        out[r[0]] = r[1] if len(cols) == 1 else tuple(r[1:])
    return out
