"""Written stages: where they go and when they are removed."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quillmill import session


def _files(folder):
    return sum(len(f) for _, _, f in os.walk(folder.removeprefix("file://")))


def test_no_local_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda k, d=None: d)
    with pytest.raises(ValueError):
        session.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    with pytest.raises(ValueError):
        session.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]")))


def test_scope_removes_its_stages(spark):
    folder = spark.conf.get("spark.checkpoint.dir") + "/quillmill"
    outer = session.cut(spark.range(10), "outer")
    before = _files(folder)
    with session.scope(spark):
        inner = session.cut(outer.groupBy(F.col("id") % 3).count(), "inner")
        assert inner.count() == 3 and _files(folder) > before
    assert _files(folder) == before and outer.count() == 10
    assert spark.conf.get(session._CLEAN_UP, "false") == "false"


def test_buckets_are_not_moved_again(spark):
    n = session.partitions(spark)
    names = lambda: {r["tableName"] for r in spark.sql("SHOW TABLES").collect()}
    before = names()
    with session.scope(spark):
        left = session.cut(spark.range(1000).repartition(n, "id"), "left", by="id")
        right = session.cut(spark.range(500), "right")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            both = left.join(right, "id")
            assert both.count() == 500
            assert both._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # once in each of two printed plans
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert len(names() - before) == 1
    assert names() == before
