"""Shared storage: what is needed of the session, and what is left behind."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from symdex.llm import support


def test_a_cluster_must_name_a_shared_folder():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        with pytest.raises(RuntimeError):
            support.shared_dir(SimpleNamespace(conf=conf, sparkContext=context))


def test_discarded_tables_are_gone(spark):
    df = support.stored(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count(), "some")
    folder = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    assert df.count() == 3 and os.path.isdir(folder)
    support.discard(df)
    assert not os.path.exists(folder)


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), *((100, i) for i in range(101, 160)), (159, 3)]
    got = {r["node"]: r["component"] for r in support.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, **dict.fromkeys(range(100, 160), 1)}
    assert support.components(spark.createDataFrame([], "a long, b long")).count() == 0
