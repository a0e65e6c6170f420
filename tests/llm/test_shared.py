"""Shared tables: joins with hot keys, components, and the folder of intermediates."""

import glob

import pytest
from pyspark.sql import functions as F

from rooftide.llm import shared


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_join_like_others(spark, how):
    left = spark.createDataFrame([(7, i) for i in range(3000)] + [(i, -i) for i in range(100, 3000)], "k long, v long")
    right = left.groupBy("k").agg(F.count("*").alias("n")).where("k % 3 <> 0 OR k = 7").withColumn("name", F.col("k") * 2)
    got = shared.join_hot(left, right, ["k"], "n", how)
    want = left.join(right, ["k"], how)
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    empty = right.limit(0)
    assert shared.join_hot(left, empty, ["k"], "n", how).count() == (5900 if how == "left" else 0)


def test_components_of_stars_chains_and_odd_rows(spark):
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 1), (1, None), (9, 0), (0, 9)]
    got = {r.node: r.component for r in shared.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got == {i: 0 for i in range(400)} | {1000 + i: 1000 for i in range(61)}
    assert shared.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_intermediates_stand_in_one_folder_that_cleanup_deletes(spark):
    rows = shared.materialize(spark.range(10))
    own = shared.own_dir(spark)
    assert rows.count() == 10 and spark.sparkContext.applicationId in own and glob.glob(own.removeprefix("file://") + "/*")
    shared.cleanup(spark)
    assert not glob.glob(own.removeprefix("file://") + "/*")
    assert shared.materialize(spark.range(3)).count() == 3
