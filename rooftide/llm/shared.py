"""Materialised intermediate tables, joins with hot keys, and distributed connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it. Where that is unset a temporary folder
    takes its place on one machine, until Python ends; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if spark.sparkContext.applicationId not in _LOCAL:
        _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="rooftide-")
        atexit.register(shutil.rmtree, _LOCAL[spark.sparkContext.applicationId], ignore_errors=True)
    return "file://" + _LOCAL[spark.sparkContext.applicationId]


_LOCAL: dict[str, str] = {}


def own_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables stand."""
    return f"{shared_dir(spark)}/rooftide-{spark.sparkContext.applicationId}"


def cleanup(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that haven't been written yet can't be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Files that a small intermediate table is written to at most, and the rows of a file of a larger one.
FILES, FILE_ROWS = 8, 250_000


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage with files that survive the loss of executors, and
    gives later joins true sizes to plan with. ``rows``, where known, bounds the
    rows of ``df``; the number of files follows from it, so that small tables
    don't become one tiny file for each shuffle partition. It is for results of
    a shuffle: a scan right before it would be narrowed to as few tasks.
    """
    path = f"{own_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(FILES, -(-rows // FILE_ROWS)))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that hold more than one in ``HOT`` of all rows are hot; there are fewer than ``HOT`` of them.
HOT = 1024


def join_hot(left: DataFrame, right: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Join of many rows with a table that has each key once, and in ``weight`` how many rows of ``left`` have it.

    Hot keys are broadcast, which the definition of ``HOT`` bounds, so their
    rows stay where they are; the other keys are joined by shuffle. Both sides
    are read more than once. ``how`` is ``inner`` or ``left``.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = right.where(F.col(weight) * HOT > total)
    cold = right.where(F.col(weight) * HOT <= total)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return left.join(F.broadcast(hot), on).unionByName(rest.join(cold, on, how))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the graph whose edges are the rows ``(a long, b long)``.

    Returns ``node, component`` for every node with an edge to another node;
    the component is its smallest node. Loops, repeated edges and rows with a
    null end are ignored; no edges give no rows.

    Each round hangs every node on its smallest neighbour, shortens the paths
    by pointer doubling, and contracts the edges; a star needs one round and a
    long chain a logarithmic number. Only aggregations with partial results
    and equi-joins are used; the edges of a node with very many neighbours meet
    in one partition of a join, which adaptive execution splits when it is large.
    """
    e = materialize(
        edges.where("a <> b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    )
    mapping, mapped = None, 0
    while left := e.count():  # from the files' footers; it bounds the nodes with a parent as well
        p = materialize(e.groupBy(F.col("y").alias("node")).agg(F.min("x").alias("parent")), left)
        while True:
            q = p.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
            p = materialize(
                p.join(q, "parent", "left").select(
                    "node", F.coalesce("up", "parent").alias("parent"), F.col("up").isNotNull().alias("moved")
                ),
                left,
            )
            if p.where("moved").isEmpty():
                break
            p = p.drop("moved")
        p = p.drop("moved")
        mapped += left
        if mapping is None:
            mapping = p
        else:
            q = p.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
            mapping = materialize(
                mapping.join(q, "parent", "left").select("node", F.coalesce("up", "parent").alias("parent")).unionByName(p),
                mapped,
            )
        px = p.select(F.col("node").alias("x"), F.col("parent").alias("rx"))
        py = p.select(F.col("node").alias("y"), F.col("parent").alias("ry"))
        r = e.join(py, "y", "left").join(px, "x", "left")
        r = r.select(F.coalesce("rx", "x").alias("x"), F.coalesce("ry", "y").alias("y"))
        e = materialize(
            r.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), left
        )
    if mapping is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    nodes = mapping.select("node", F.col("parent").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
