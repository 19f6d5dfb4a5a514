import os

import pytest

from leafmill import session as S


def test_scratch_tables(spark):
    df = S.materialize(spark.range(5), "x")
    path = os.path.dirname(df.inputFiles()[0]).removeprefix("file:").replace("///", "/")
    assert df.count() == 5 and os.path.isdir(path)
    other = S.materialize(spark.range(3), "y")
    S.drop_materialized(other)
    S.drop_scratch(spark)
    assert not os.path.isdir(path)


def test_broadcast_is_checked(spark):
    small = S.broadcast_if_small(spark.range(10), 10)
    large = S.broadcast_if_small(spark.range(11), 10)
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(small) and "broadcast" not in plan(large)


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    sc = spark.sparkContext
    monkeypatch.setattr(type(sc), "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(sc, "master", "spark://x", raising=False)
    if sc.getConf().get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            S.shared_dir(spark)
