"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` from files in the folder that ``spark.checkpoint.dir`` names.

    Where none is named a temporary folder serves on one machine, until Python ends; a cluster must name one.
    """
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not named:
            folder = tempfile.mkdtemp(prefix="rooftide-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            named = "file://" + folder
        context.setCheckpointDir(named)
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node with an edge ``(a long, b long)`` to another; the component is its smallest node.

    Large-star and small-star rounds alternate: each node's larger neighbours move to the smallest neighbour, then its
    smaller ones do, until every component is a star. Rounds grow with the logarithm of the longest path. Loops,
    repeated edges and rows with a null end are ignored; no edges give no rows.
    """
    e = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(root, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpointed(moved.unionByName(root.withColumnRenamed("m", "b")).distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
