"""Compare one query with its SQL on DuckDB: same columns, same rows, order aside."""

from __future__ import annotations

import datetime
import glob
import os
import re
from collections import Counter

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connect(sf: str = SF):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in records]
    return sorted(columns), sorted(out, key=repr)


def kind(name: str) -> str:
    name = str(name).lower()
    for tag, names in {
        "int": ("integer", "int"),
        "text": ("varchar", "string"),
        "time": ("timestamp", "timestamp_ntz"),
    }.items():
        if name in names:
            return tag
    return name


BANNED = ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin")


def check_plan(df):
    """No Python evaluation, no cross or nested-loop join, no window over a whole table but the ranking of a limit."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in BANNED:
        assert word not in plan, word
    for whole in re.findall(r"Window \[.*?\n.*?Sort .*?\n.*\n?.*Exchange SinglePartition", plan):
        assert "TakeOrderedAndProject" in plan, whole


def compare(spark, con, fn, sql, sf: str = SF):
    df = fn(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    check_plan(df)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    assert got[0] == want[0], (got[0], want[0])
    spark_kinds = {n: kind(t) for n, t in df.dtypes}
    duck_kinds = {d[0]: kind(d[1]) for d in cur.description}
    assert spark_kinds == duck_kinds, (df.dtypes, cur.description)
    mine, theirs = Counter(got[1]), Counter(want[1])
    extra, missing = mine - theirs, theirs - mine
    assert not extra and not missing, (
        got[0], len(got[1]), len(want[1]), "extra", list(extra)[:3], "missing", list(missing)[:3]
    )
    return len(got[1])
