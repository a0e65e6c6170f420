"""Queries that need connected components: SQL gives the nodes and edges, and sums up the labelled nodes.

Each entry is ``(nodes, edges, result)``. ``nodes`` has a column ``node``, ``edges`` the columns ``a, b``; ``result``
reads ``labelled``, which is ``nodes`` with ``component``, the smallest node that edges reach. DuckDB runs the same
three texts around a recursive query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rooftide.operators.components import components
from rooftide.plans.fixtures import TABLES, with_views

_TWINS = "SELECT h.face AS a, h.twin_face AS b FROM arr_halfedge h JOIN arr_face f ON h.face = f.face JOIN arr_face g ON h.twin_face = g.face WHERE f.in_footprint AND g.in_footprint"
_CELLS = "SELECT DISTINCT bucket AS fid, x, y, CAST(floor(x / 1.0e0) AS BIGINT) AS cx, CAST(floor(y / 1.0e0) AS BIGINT) AS cy, CAST(x * 1000 + y AS BIGINT) AS node FROM points WHERE cls = 6"

#: Spacing of the clusters in space.
SPACING = 4.0
_SPACE = f"""SELECT *, row_number() OVER (PARTITION BY fid ORDER BY x, y, z) + fid * 10000000 AS node, CAST(floor(x / {SPACING}e0) AS BIGINT) AS cx, CAST(floor(y / {SPACING}e0) AS BIGINT) AS cy, CAST(floor(z / {SPACING}e0) AS BIGINT) AS cz
  FROM (SELECT DISTINCT bucket AS fid, x, y, z FROM points WHERE cls = 6) AS d"""

GRAPHS = {
    "g2_cluster_points": (
        _CELLS,
        f"""WITH c AS ({_CELLS}), o(d) AS (VALUES (-1), (0), (1)),
        p AS (SELECT c.*, c.cx + i.d AS jx, c.cy + j.d AS jy FROM c CROSS JOIN o i CROSS JOIN o j)
        SELECT p.node AS a, q.node AS b FROM p JOIN c q ON p.fid = q.fid AND p.jx = q.cx AND p.jy = q.cy
        WHERE p.node < q.node AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 1""",
        "SELECT fid, component AS cluster_id, count(*) AS cells, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM labelled GROUP BY fid, component",
    ),
    "g2_cluster_points_3d": (
        _SPACE,
        f"""WITH c AS ({_SPACE}), o(d) AS (VALUES (-1), (0), (1)),
        p AS (SELECT c.*, c.cx + i.d AS jx, c.cy + j.d AS jy, c.cz + k.d AS jz FROM c CROSS JOIN o i CROSS JOIN o j CROSS JOIN o k)
        SELECT p.node AS a, q.node AS b FROM p JOIN c q ON p.fid = q.fid AND p.jx = q.cx AND p.jy = q.cy AND p.jz = q.cz
        WHERE p.node < q.node AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) <= {SPACING * SPACING}""",
        "SELECT fid, component AS cluster_id, count(*) AS points, min(z) AS z0, max(z) AS z1 FROM labelled GROUP BY fid, component",
    ),
    "x5_segment_dissolve": (
        "SELECT *, face AS node FROM arr_face",
        f"{_TWINS} AND f.segid = g.segid AND f.segid <> 0",
        """SELECT fid, segid, component AS face, count(*) AS faces, CAST(sum(pixel_count) AS BIGINT) AS pixel_count, max(elevation_50p) AS elevation_max,
        floor(sum(elevation_50p * pixel_count) / sum(pixel_count) * 1e4 + 0.5e0) / 1e4 AS elevation_50p FROM labelled WHERE in_footprint GROUP BY fid, segid, component""",
    ),
    "x11_building_parts": (
        "SELECT *, face AS node FROM arr_face WHERE in_footprint",
        _TWINS,
        "SELECT fid, face, CAST(dense_rank() OVER (PARTITION BY fid ORDER BY component) - 1 AS BIGINT) AS part_id FROM labelled",
    ),
}


def oracle(name: str) -> str:
    nodes, edges, result = GRAPHS[name]
    text = with_views(f"WITH nodes AS ({nodes}), edges AS ({edges}), RECURSION labelled AS (SELECT n.*, r.component FROM nodes n JOIN reached r ON n.node = r.node) {result}")
    reached = """pairs AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
    walk(node, component) AS (SELECT node, node FROM nodes UNION SELECT p.b, w.component FROM walk w JOIN pairs p ON w.node = p.a),
    reached AS (SELECT node, min(component) AS component FROM walk GROUP BY node),"""
    return text.replace("RECURSION", reached).replace("WITH ", "WITH RECURSIVE ", 1)


def query(name: str):
    """The query of that name, as a function of the session and the folder of tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes, edges, result = GRAPHS[name]
        for table in TABLES:
            if table in with_views(nodes) + with_views(edges):
                spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        found = components(spark.sql(with_views(edges)))
        rows = spark.sql(with_views(nodes)).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        return spark.sql(result.replace("labelled", "{labelled}"), labelled=rows)

    return run


QUERIES = {name: query(name) for name in GRAPHS}
