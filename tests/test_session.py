from __future__ import annotations

import os

import pytest

from solvelake import session


def test_cuts_are_deleted_on_request(spark):
    one, two = session.cut(spark.range(3)), session.cut(spark.range(4))
    paths = [d._cut_path for d in (one, two)]
    assert one.count() == 3 and all(os.path.isdir(p) for p in paths)
    session.release(one, spark.range(1))
    assert not os.path.exists(paths[0]) and two.count() == 4
    session.release_all(spark)
    assert not os.path.exists(paths[1])


def test_work_root_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:1"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.work_root(Session())
