"""Plans for queries of ``surfaces`` and ``graphs`` that pair points or cells within a feature.

As joins these make tens of rows of each point, which shuffles and sorts write to disk. Here a feature's rows go to one
kernel call instead, so what is shuffled is the points themselves. Results are those of the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rooftide.kernels import nearby
from rooftide.plans import graphs, surfaces
from rooftide.plans.surfaces import ROOF_CELLS, near

Sql = Callable[[str], DataFrame]


def by_feature(rows: DataFrame, kernel: Callable[..., list], schema: str) -> DataFrame:
    """``kernel(fid, *columns)`` over each feature's rows as arrays; it returns the columns that ``schema`` names after ``fid``."""
    names, types = [c.split()[0] for c in schema.split(", ")], [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]] for c in schema.split(", ")]

    def one(t: pa.Table) -> pa.Table:
        fid = t.column("fid")[0].as_py()
        found = kernel(fid, *(t.column(c).to_numpy() for c in t.column_names if c != "fid"))
        n = len(found[0]) if found else 0
        return pa.table([pa.array([fid] * n, pa.int64()), *(pa.array(c, k) for c, k in zip(found or [[]] * len(types), types, strict=True))], names=["fid", *names])

    # kernels take longer than their rows' bytes tell, so adaptive execution must not merge these partitions
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.where("fid IS NOT NULL").repartition(parts, "fid").groupBy("fid").applyInArrow(one, f"fid long, {schema}")


def _adjacent(fid, x, y, z, label):
    found = nearby.adjacency(np.stack([x, y, z], axis=1), label)
    return [[hi for hi, _ in found], [lo for _, lo in found], list(found.values())]


def adjacent(sql: Sql) -> DataFrame:
    return by_feature(sql(f"WITH {surfaces._LABELLED} SELECT fid, x, y, z, label FROM labelled"), _adjacent, "hi int, lo int, cnt long")


def plane_segments(sql: Sql) -> DataFrame:
    text = surfaces.SQL["j4_plane_segments"]
    pairs = adjacent(sql)
    pairs.createOrReplaceTempView("feature_adjacent")
    return sql(f"WITH {surfaces._LABELLED}, adjacent AS (SELECT * FROM feature_adjacent),\n" + text[text.index("line AS (") :])


def _distances(fid, x, y, z, cls):
    p = np.stack([x, y, z], axis=1)
    own, to = p[cls == 6], p[cls == 2]
    return [*own.T, nearby.nearest_squared(own, to)] if len(own) and len(to) else []


def nearest_distance(sql: Sql) -> DataFrame:
    rows = sql("SELECT DISTINCT bucket AS fid, x, y, z, cls FROM points WHERE cls <> 1")
    return by_feature(rows, _distances, "x double, y double, z double, squared double").selectExpr("fid", "x", "y", "z", f"{near('sqrt(squared)')} AS distance")


def _quality(fid, kind, tri, n, *c):
    points, faces = kind == 0, kind == 1
    order = np.flatnonzero(faces)[np.argsort(tri[faces], kind="stable")]
    if not len(order) or not points.any():
        return []
    t, weight = np.stack([a[order] for a in c], axis=1).reshape(-1, 3, 3), n[points]
    p = np.stack([a[points] for a in c[:3]], axis=1)
    best, squared = zip(*(nearby.to_triangles(p[a : a + 4096], t) for a in range(0, len(p), 4096)))
    best, squared = np.concatenate(best), np.concatenate(squared)
    hit = np.unique(best)
    total, count = np.bincount(best, squared * weight), np.bincount(best, weight)
    most = np.full(len(t), -1.0)
    np.maximum.at(most, best, squared)
    return [tri[order][hit], count[hit].astype(np.int64), total[hit], most[hit]]


def mesh_quality(sql: Sql) -> DataFrame:
    points = sql("SELECT bucket AS fid, 0 AS kind, 0 AS tri, count(*) AS n, x AS a, y AS b, z AS c FROM points WHERE cls = 6 AND y IS NOT NULL AND z IS NOT NULL GROUP BY bucket, x, y, z")
    faces = sql("SELECT fid, 1 AS kind, tri_id AS tri, 0 AS n, x0 AS a, y0 AS b, z0 AS c, x1 AS d, y1 AS e, z1 AS f, x2 AS g, y2 AS h, z2 AS i FROM triangles WHERE label = 1")
    found = by_feature(faces.unionByName(points, allowMissingColumns=True), _quality, "tri_id int, points long, total double, most double")
    return found.selectExpr("fid", "tri_id", "points", f"{near('sqrt(total / points)')} AS rmse", f"{near('most')} AS largest")


def _filled(fid, col, row_, z):
    return list(nearby.window_least(col, row_, z))


def filled_raster(sql: Sql) -> DataFrame:
    written = sql(f"WITH {ROOF_CELLS} SELECT fid, col, row_, max(z) AS z FROM cells WHERE (col + row_) % 3 <> 0 GROUP BY fid, col, row_")
    return by_feature(written, _filled, "col long, row_ long, z double, filled boolean").selectExpr("fid", "col", "row_", f"{near('z')} AS z", "filled")


def _clustered(fid, x, y, z):
    order = np.lexsort((z, y, x))
    label, z = nearby.clusters(np.stack([x, y, z], axis=1)[order], graphs.SPACING), z[order]
    own, place, n = np.unique(label, return_inverse=True, return_counts=True)
    low, high = np.full(len(own), np.inf), np.full(len(own), -np.inf)
    np.minimum.at(low, place, z)
    np.maximum.at(high, place, z)
    return [own + 1 + fid * 10_000_000, n, low, high]


def cluster_points_3d(sql: Sql) -> DataFrame:
    return by_feature(sql("SELECT DISTINCT bucket AS fid, x, y, z FROM points WHERE cls = 6"), _clustered, "cluster_id long, points long, z0 double, z1 double")


PLANS: dict[str, Callable[[Sql], DataFrame]] = {
    "j4_plane_segments": plane_segments,
    "j6_plane_adjacency": adjacent,
    "j7_nearest_distance": nearest_distance,
    "j8_mesh_quality": mesh_quality,
    "r3_filled_raster": filled_raster,
    "g2_cluster_points_3d": cluster_points_3d,
}
