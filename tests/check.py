"""Run queries against their SQL from the command line: ``python tests/check.py [name ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as e  # noqa: E402

if __name__ == "__main__":
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect()
    q, o = e.queries(), e.oracle_sql()
    bad = []
    for name in sys.argv[1:] or q:
        start = time.time()
        try:
            if name in o:
                n = oracle.compare(spark, con, q[name], o[name])
            else:
                n = len(q[name](spark, oracle.SF).collect())
            print(f"ok   {name:32s} {n:7d} rows {time.time() - start:6.2f}s {'' if name in o else 'rows only'}", flush=True)
        except Exception as exc:
            bad.append(name)
            print(f"FAIL {name} {type(exc).__name__} {str(exc)[:1500]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("failed:", bad)
