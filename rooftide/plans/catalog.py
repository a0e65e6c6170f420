"""Named queries for the relational operators, one text for Spark and DuckDB.

Spatial joins are equalities of buckets with an exact residual predicate, so
they never become nested loops. Sums of fractions are rounded half up to four
places, as sums depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rooftide.plans import features, graphs, kernels, surfaces
from rooftide.plans.dialects import read, series
from rooftide.plans.fixtures import TABLES, with_views
from rooftide.plans.surfaces import SHAPES, inside, near, percentile, ranked


#: Points with the footprints whose ring holds them: an equality of buckets, then boxes, then crossings counted over the ring's edges in place.
_PIP = f"""{SHAPES},
pip AS (SELECT /*+ SHUFFLE_HASH(f) */ f.fid, p.x, p.y, p.z, p.cls FROM points p JOIN shapes f ON p.bucket = f.bucket AND p.x BETWEEN f.x0 AND f.x1 AND p.y BETWEEN f.y0 AND f.y1 WHERE {inside('p.x', 'p.y')})"""
_AREA = "area AS (SELECT fid, abs(sum(ax * by_ - bx * ay)) / 2 AS area FROM ring_edges GROUP BY fid)"
#: Roof pixels of 1 x 1 within the faces of 5 x 5, and what they say of each face of the footprint.
_ZONAL = f"""pixel AS (SELECT floor(x) AS c, floor(y) AS r, max(z) AS z FROM points WHERE cls = 6 GROUP BY floor(x), floor(y)),
zone AS (SELECT a.face AS fid, p.z FROM pixel p JOIN arr_face a ON floor(p.c / 5) = a.col AND floor(p.r / 5) = a.row_ WHERE a.in_footprint),
measured AS (SELECT fid AS face, {percentile(0.5)} AS p50, {percentile(0.7)} AS p70, {percentile(0.97)} AS p97, min(z) AS z_min, max(z) AS z_max, max(cnt) AS pixels FROM ({ranked('zone')}) AS q GROUP BY fid),
zonal AS (SELECT a.face, a.fid, a.segid, p50 AS elevation_50p, p70 AS elevation_70p, p97 AS elevation_97p, z_min AS elevation_min, z_max AS elevation_max,
  CAST(coalesce(pixels, 0) AS BIGINT) AS pixels, coalesce(pixels, 0) / 25.0e0 AS data_coverage FROM arr_face a LEFT JOIN measured m ON a.face = m.face WHERE a.in_footprint)"""
#: Corners of the faces, the sides of those in ``held``, and the ends of these.
_LATTICE = """lattice AS (SELECT DISTINCT a.fid, a.col + i.v AS vx, a.row_ + j.v AS vy FROM arr_face a CROSS JOIN (VALUES (0), (1)) AS i(v) CROSS JOIN (VALUES (0), (1)) AS j(v)),
      side AS (SELECT fid, col AS ax, row_ AS ay, col + 1 AS bx, row_ AS by_ FROM held UNION SELECT fid, col, row_ + 1, col + 1, row_ + 1 FROM held UNION SELECT fid, col, row_, col, row_ + 1 FROM held UNION SELECT fid, col + 1, row_, col + 1, row_ + 1 FROM held),
      end_ AS (SELECT fid, ax AS vx, ay AS vy FROM side UNION ALL SELECT fid, bx, by_ FROM side)"""
#: Lower limits of the error histogram's bins, in metres (fixed values); the last bin has no end.
LIMITS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0)


def binned(value: str) -> str:
    """The bin of a value that isn't negative, by one pass over the limits."""
    return "CASE " + " ".join(f"WHEN {value} < {top}e0 THEN {i}" for i, top in enumerate(LIMITS[1:])) + f" ELSE {len(LIMITS) - 1} END"


def histogram(value: str) -> str:
    """The histogram of a group as a JSON text."""
    counts = ", ',', ".join(f"CAST(count(CASE WHEN {binned(value)} = {i} THEN 1 END) AS VARCHAR(20))" for i in range(len(LIMITS)))
    return f"""concat('{{"lower_limits":[{",".join(f"{x:g}" for x in LIMITS)}],"counts":[', {counts}, ']}}')"""


def to_segment(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    """Squared distance of a point from a segment that has a length."""
    t = f"least(greatest((({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / (({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay})), 0.0e0), 1.0e0)"
    return f"power({px} - {ax} - {t} * ({bx} - {ax}), 2) + power({py} - {ay} - {t} * ({by} - {ay}), 2)"


def crossed() -> str:
    """Whether the segments x0, y0, x1, y1 and u0, v0, u1, v1 cross."""
    side = lambda ax, ay, bx, by, px, py: f"(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}))"
    own, other = ("x0", "y0", "x1", "y1"), ("u0", "v0", "u1", "v1")
    return f"{side(*own, 'u0', 'v0')} * {side(*own, 'u1', 'v1')} < 0 AND {side(*other, 'x0', 'y0')} * {side(*other, 'x1', 'y1')} < 0"


def slab(p: str, d: str, low: str, high: str, end: int) -> str:
    """Where a line enters (0) or leaves (1) a slab across one axis; past all reach if it never does."""
    pick, far = ("least", "-1e300") if end == 0 else ("greatest", "1e300")
    return f"CASE WHEN {d} <> 0 THEN {pick}(({low} - {p}) / {d}, ({high} - {p}) / {d}) WHEN {p} BETWEEN {low} AND {high} THEN {far} ELSE -({far}) END"


def weighted(value: str) -> str:
    """Mean by pixels, from whole hundred-thousandths, so that it doesn't depend on the order of rows."""
    return f"floor(CAST(sum(CAST(floor({value} * 1e5 + 0.5e0) AS BIGINT) * pixels) AS DOUBLE) / CAST(sum(pixels) * 10 AS DOUBLE) + 0.5e0) / 1e4"


def step(rows: str, ends: str) -> str:
    """Rows of ring vertices that are joined with those after them; ``n`` is the ring's length."""
    return f"SELECT *, count(*) OVER (PARTITION BY fid) AS n FROM {rows}" if not ends else f"{ends}.i = (v.i + {'v.n - 1' if ends == 'p' else '1'}) % v.n"


SQL = {
    "j1_points_in_polygons": f"WITH {_PIP} SELECT fid, cls, count(*) AS points, min(z) AS z_min, max(z) AS z_max FROM pip GROUP BY fid, cls",
    "j2_overlap_resolution": f"""WITH {_PIP}, {_AREA},
      d AS (SELECT p.fid, count(*) / max(a.area) AS density, avg(p.z) AS elevation FROM pip p JOIN area a ON p.fid = a.fid WHERE p.cls = 6 GROUP BY p.fid),
      c AS (SELECT DISTINCT p.x, p.y, p.z, p.fid, d.density, d.elevation FROM pip p JOIN d ON p.fid = d.fid WHERE p.cls = 6),
      w AS (SELECT a.x, a.y, a.z, a.fid, a.elevation, sum(CASE WHEN abs(1 - a.density / b.density) < 0.05e0 THEN CASE WHEN a.elevation >= b.elevation THEN 1 ELSE 0 END
        WHEN a.density >= b.density THEN 1 ELSE 0 END) AS wins FROM c a JOIN c b ON a.x = b.x AND a.y = b.y AND a.z = b.z AND a.fid <> b.fid GROUP BY a.x, a.y, a.z, a.fid, a.elevation),
      best AS (SELECT fid, row_number() OVER (PARTITION BY x, y, z ORDER BY wins DESC, elevation DESC, fid) AS rn FROM w)
      SELECT fid, count(*) AS resolved FROM best WHERE rn = 1 GROUP BY fid""",
    "a1_coverage_class": f"""WITH {_PIP}, {_AREA},
      k AS (SELECT fid, count(CASE WHEN cls = 6 THEN 1 END) AS bld, count(CASE WHEN cls = 2 THEN 1 END) AS grd FROM pip GROUP BY fid),
      c AS (SELECT a.fid, a.area, coalesce(k.bld, 0) AS bld, coalesce(k.grd, 0) AS grd FROM area a LEFT JOIN k ON a.fid = k.fid),
      m AS (SELECT sum(bld + grd) / sum(area) AS mean FROM c), s AS (SELECT max(mean) AS mean, sqrt(avg((mean - bld / area) * (mean - bld / area))) AS dev FROM c CROSS JOIN m)
      SELECT fid, {near('area')} AS area, bld, grd, {near('bld / area')} AS density, CASE WHEN bld / area < mean - 2 * dev THEN 'insufficient' ELSE 'sufficient' END AS coverage FROM c CROSS JOIN s""",
    "a1_ground_elevation": f"""WITH g AS (SELECT /*+ SHUFFLE_HASH(f) */ f.fid, p.z FROM points p JOIN footprint_buckets f ON p.bucket = f.bucket AND p.x BETWEEN f.x0 AND f.x1 AND p.y BETWEEN f.y0 AND f.y1 WHERE p.cls = 2),
      r AS (SELECT fid, {percentile(0.05)} AS z FROM ({ranked('g')}) AS q GROUP BY fid), low AS (SELECT min(z) AS z FROM points WHERE cls = 2)
      SELECT f.fid, coalesce(r.z, low.z) AS ground FROM footprints f CROSS JOIN low LEFT JOIN r ON f.fid = r.fid""",
    "a2_floor_rank_percentile": f"WITH g AS (SELECT l_suppkey AS fid, z FROM points) SELECT fid, {percentile(0.5)} AS p50, {percentile(0.7)} AS p70, {percentile(0.99)} AS p97 FROM ({ranked('g')}) AS q GROUP BY fid",
    "a3_mean_z": f"SELECT l_suppkey AS fid, {near('avg(z)')} AS mean_z FROM points GROUP BY l_suppkey",
    "a5_weighted_merge": f"""WITH {_ZONAL} SELECT fid, segid, {weighted('elevation_50p')} AS elevation_50p, {weighted('elevation_70p')} AS elevation_70p, max(elevation_97p) AS elevation_97p,
      min(elevation_min) AS elevation_min, max(elevation_max) AS elevation_max, {weighted('data_coverage')} AS data_coverage, CAST(sum(pixels) AS BIGINT) AS pixels FROM zonal GROUP BY fid, segid HAVING sum(pixels) > 0""",
    "a7_error_histogram": f"SELECT l_suppkey AS fid, {histogram('abs(z - y) / 10')} AS histogram FROM points GROUP BY l_suppkey",
    "a8_roof_volume": "SELECT CAST(floor(col / 4.0e0) AS BIGINT) AS fid, CAST(sum(CAST(floor(abs(z - 1) * 1e5 + 0.5e0) AS BIGINT)) * 25 AS BIGINT) / 1e5 AS volume FROM raster GROUP BY 1",
    "a10_distinct_vertices": "SELECT fid, count(*) AS vertices FROM (SELECT DISTINCT fid, x, y, z FROM (SELECT fid, x0 AS x, y0 AS y, z0 AS z FROM triangles UNION ALL SELECT fid, x1, y1, z1 FROM triangles UNION ALL SELECT fid, x2, y2, z2 FROM triangles) AS v) AS d GROUP BY fid",
    "a11_grid_tiler": f"""WITH t AS (SELECT fid, CAST(floor(((x0 + x1) / 2 - m.left_) / 500) AS BIGINT) AS col, CAST(floor(((y0 + y1) / 2 - m.low) / 500) AS BIGINT) AS row_ FROM footprints CROSS JOIN (SELECT min(x0) AS left_, min(y0) AS low FROM footprints) AS m),
      m AS (SELECT min(x0) AS left_, min(y0) AS low, CAST(floor((max(x1) - min(x0)) / 500 + 1) AS BIGINT) AS cols, CAST(floor((max(y1) - min(y0)) / 500 + 1) AS BIGINT) AS rows_ FROM footprints),
      c AS (SELECT *, {series('0', 'cols - 1')} AS col FROM m), cell AS (SELECT *, {series('0', 'rows_ - 1')} AS row_ FROM c)
      SELECT CAST(cell.col AS BIGINT) AS col, CAST(cell.row_ AS BIGINT) AS row_, CAST(cell.row_ * cell.cols + cell.col AS BIGINT) AS tile_id, max(left_ + cell.col * 500) AS x0, max(low + cell.row_ * 500) AS y0, count(t.fid) AS polygons
      FROM cell LEFT JOIN t ON cell.col = t.col AND cell.row_ = t.row_ GROUP BY cell.col, cell.row_, cell.cols""",
    "a12_bounding_box": "SELECT l_suppkey AS fid, min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) AS x1, max(y) AS y1, max(z) AS z1 FROM points GROUP BY l_suppkey",
    "g1_plane_counts": "SELECT fid, CAST(sum(CASE WHEN c / sqrt(a * a + b * b + c * c) > 0.97e0 THEN 1 ELSE 0 END) AS BIGINT) AS horizontal, CAST(sum(CASE WHEN c / sqrt(a * a + b * b + c * c) <= 0.97e0 THEN 1 ELSE 0 END) AS BIGINT) AS slanted, count(*) AS planes FROM planes GROUP BY fid",
    "j3_data_coverage": f"""WITH {_AREA}, d AS (SELECT fid, sum(CASE WHEN in_footprint THEN 25.0e0 ELSE 0.0e0 END) AS data_area, sum(CASE WHEN in_footprint THEN 0.0e0 ELSE 5.0e0 END) AS ground_area FROM arr_face GROUP BY fid)
      SELECT a.fid, {near('coalesce(d.data_area, 0) / (a.area - coalesce(d.ground_area, 0))')} AS coverage FROM area a LEFT JOIN d ON a.fid = d.fid""",
    "j5_plane_intersections": f"""WITH line AS (SELECT p.fid, p.plane_id AS a, q.plane_id AS b, p.b * q.c - p.c * q.b AS dx, p.c * q.a - p.a * q.c AS dy, p.a * q.b - p.b * q.a AS dz,
        q.d * p.a - p.d * q.a AS ux, q.d * p.b - p.d * q.b AS uy, q.d * p.c - p.d * q.c AS uz FROM planes p JOIN planes q ON p.fid = q.fid AND p.plane_id <> q.plane_id),
      based AS (SELECT l.*, (uy * dz - uz * dy) / len2 AS px, (uz * dx - ux * dz) / len2 AS py, (ux * dy - uy * dx) / len2 AS pz, f.x0, f.x1, f.y0, f.y1
        FROM (SELECT *, dx * dx + dy * dy + dz * dz AS len2 FROM line) AS l JOIN footprints f ON l.fid = f.fid WHERE len2 > 0),
      cut AS (SELECT *, {slab('px', 'dx', 'x0', 'x1', 0)} AS a0, {slab('px', 'dx', 'x0', 'x1', 1)} AS a1, {slab('py', 'dy', 'y0', 'y1', 0)} AS b0, {slab('py', 'dy', 'y0', 'y1', 1)} AS b1,
        {slab('pz', 'dz', '0.0e0', '30.0e0', 0)} AS c0, {slab('pz', 'dz', '0.0e0', '30.0e0', 1)} AS c1 FROM based)
      SELECT fid, a, b, {near('px + greatest(a0, b0, c0) * dx')} AS x0, {near('py + greatest(a0, b0, c0) * dy')} AS y0, {near('pz + greatest(a0, b0, c0) * dz')} AS z0,
        {near('px + least(a1, b1, c1) * dx')} AS x1, {near('py + least(a1, b1, c1) * dy')} AS y1, {near('pz + least(a1, b1, c1) * dz')} AS z1 FROM cut WHERE greatest(a0, b0, c0) < least(a1, b1, c1)""",
    "j8_plane_errors": f"SELECT s.fid, t.plane_id, {near('sum(power(abs(t.a * s.x0 + t.b * s.y0 + t.c * s.z0 + t.d), 2) / (t.a * t.a + t.b * t.b + t.c * t.c))')} AS squared, count(*) AS n FROM segments s JOIN planes t ON s.fid = t.fid GROUP BY s.fid, t.plane_id",
    "m5_mesh_volume": f"SELECT fid, {near('sum(x0 * (y1 * z2 - z1 * y2) - y0 * (x1 * z2 - z1 * x2) + z0 * (x1 * y2 - y1 * x2)) / 6')} AS volume FROM triangles GROUP BY fid",
    "m10_grid_simplify": f"""WITH v AS (SELECT fid, tri_id, 0 AS k, x0 AS x, y0 AS y, z0 AS z FROM triangles UNION ALL SELECT fid, tri_id, 1, x1, y1, z1 FROM triangles UNION ALL SELECT fid, tri_id, 2, x2, y2, z2 FROM triangles),
      c AS (SELECT *, CAST(floor(x / 8) AS BIGINT) AS cx, CAST(floor(y / 8) AS BIGINT) AS cy FROM v), z AS (SELECT fid, cx, cy, {near('avg(z)')} AS z FROM c GROUP BY fid, cx, cy),
      k AS (SELECT fid, tri_id FROM (SELECT DISTINCT fid, tri_id, cx, cy FROM c) AS d GROUP BY fid, tri_id HAVING count(*) = 3)
      SELECT c.fid, c.tri_id, c.k, (c.cx + 0.5e0) * 8 AS x, (c.cy + 0.5e0) * 8 AS y, z.z FROM c JOIN z ON c.fid = z.fid AND c.cx = z.cx AND c.cy = z.cy JOIN k ON c.fid = k.fid AND c.tri_id = k.tri_id""",
    "p1_point_filter": f"SELECT l_partkey, count(*) AS n, max(z) AS z FROM points WHERE z > 1.0e0 GROUP BY l_partkey",
    "p2_attribute_tester": "SELECT fid, coalesce(skip_flag, false) AS result FROM features",
    "p3_skip_replace": """WITH f AS (SELECT fid, coalesce(skip_flag, false) AS skip, roof_type, CASE fid % 7 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 3 END AS rings FROM features),
      t AS (SELECT fid, skip, CASE WHEN rings = 0 AND roof_type NOT IN ('no points', 'no planes') THEN 'no points' ELSE roof_type END AS roof_type FROM f)
      SELECT fid, roof_type, skip OR roof_type IN ('no points', 'no planes') AS skip, skip AND roof_type NOT IN ('no points', 'no planes') AS replace_ FROM t""",
    "p4_faces_selector": "SELECT t.fid, t.tri_id, CASE WHEN coalesce(f.skip_flag, false) THEN 'A' ELSE 'B' END AS side FROM triangles t JOIN features f ON t.fid = f.fid WHERE NOT coalesce(f.skip_flag, false) OR f.roof_type <> 'no planes'",
    "p5_ring_attributes": """SELECT f.fid, 'A' AS side, r.i, r.vx, r.vy, CAST(NULL AS DOUBLE) AS data_coverage, CAST(NULL AS BOOLEAN) AS is_ground, CAST(NULL AS INT) AS building_part_id FROM features f JOIN ring_vertices r ON f.fid = r.fid WHERE coalesce(f.skip_flag, false) AND f.roof_type <> 'no planes'
      UNION ALL SELECT fid, 'none', CAST(NULL AS INT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS BOOLEAN), CAST(NULL AS INT) FROM features WHERE coalesce(skip_flag, false) AND roof_type = 'no planes'
      UNION ALL SELECT f.fid, 'B', e.i, e.ax, e.ay, 1.0e0, false, 0 FROM features f JOIN ring_edges e ON f.fid = e.fid WHERE NOT coalesce(f.skip_flag, false)""",
    "p6_ring_to_rings": "SELECT fid, 0 AS ring, i, vx, vy FROM ring_vertices",
    "p11_polygon_grower": f"""WITH v AS ({step('ring_vertices', '')}), n AS (SELECT v.fid, v.i, v.vx, v.vy, p.vx - v.vx AS ax, p.vy - v.vy AS ay, q.vx - v.vx AS bx, q.vy - v.vy AS by_ FROM v
        JOIN ring_vertices p ON v.fid = p.fid AND {step('', 'p')} JOIN ring_vertices q ON v.fid = q.fid AND {step('', 'q')}),
      w AS (SELECT *, ax / (ax * ax + ay * ay) AS px, ay / (ax * ax + ay * ay) AS py, bx / (bx * bx + by_ * by_) AS qx, by_ / (bx * bx + by_ * by_) AS qy FROM n),
      s AS (SELECT *, (px + qx) * (px + qx) + (py + qy) * (py + qy) AS len2 FROM w)
      SELECT fid, i, {near('vx + 0.1e0 * CASE WHEN ax * by_ = ay * bx THEN py ELSE (px + qx) / len2 END')} AS x, {near('vy + 0.1e0 * CASE WHEN ax * by_ = ay * bx THEN -px ELSE (py + qy) / len2 END')} AS y, 0.0e0 AS z FROM s""",
    "p14_triangles_to_mesh": "SELECT fid, 0 AS part_id, tri_id AS face_id, label, x0, y0, z0, x1, y1, z1, x2, y2, z2 FROM triangles",
    "p15_triangle_normals": f"""WITH c AS (SELECT *, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS nx, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS ny, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS nz FROM triangles),
      u AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS len FROM c)
      SELECT fid, tri_id, k, CASE k WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END AS x, CASE k WHEN 0 THEN y0 WHEN 1 THEN y1 ELSE y2 END AS y, CASE k WHEN 0 THEN z0 WHEN 1 THEN z1 ELSE z2 END AS z,
        {near('nx / len')} AS nx, {near('ny / len')} AS ny, {near('nz / len')} AS nz FROM u CROSS JOIN (VALUES (0), (1), (2)) AS t(k)""",
    "p7_ring_segments": "SELECT fid, i AS segment, ax, ay, bx, by_ FROM ring_edges",
    "p8_footprint_faces": f"""WITH {_ZONAL} SELECT z.face, z.fid, z.elevation_50p, z.elevation_70p, z.elevation_min, z.elevation_max, z.data_coverage, false AS is_ground, f.name, f.roof_type FROM zonal z LEFT JOIN features f ON z.fid = f.fid
      UNION ALL SELECT a.face, a.fid, NULL, NULL, NULL, NULL, NULL, true, f.name, f.roof_type FROM arr_face a LEFT JOIN features f ON a.fid = f.fid WHERE NOT a.in_footprint""",
    "p10_segment_extend": f"WITH d AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) + (z1 - z0) * (z1 - z0)) AS len FROM segments) SELECT fid, sid, {', '.join(near(f'{c}{e} {o} 0.005e0 * ({c}1 - {c}0) / len') + f' AS {c}{e}' for e, o in ((0, '-'), (1, '+')) for c in 'xyz')} FROM d",
    "p12_polygon_extruder": """WITH h AS (SELECT fid, coalesce(roof_elevation, 3.0e0) AS top FROM features), v AS (SELECT r.*, count(*) OVER (PARTITION BY fid) AS n FROM ring_vertices r)
      SELECT fid, -1 AS edge, 0 AS surface_type, i, vx AS x, vy AS y, 0.0e0 AS z FROM ring_vertices UNION ALL SELECT v.fid, -1, 2, v.i, v.vx, v.vy, h.top FROM v JOIN h ON v.fid = h.fid
      UNION ALL SELECT e.fid, e.i, 1, k.k, CASE WHEN k.k IN (0, 3) THEN e.ax ELSE e.bx END, CASE WHEN k.k IN (0, 3) THEN e.ay ELSE e.by_ END, CASE WHEN k.k < 2 THEN 0.0e0 ELSE h.top END
      FROM ring_edges e JOIN h ON e.fid = h.fid CROSS JOIN (VALUES (0), (1), (2), (3)) AS k(k)""",
    "p13_lod1_extruder": """WITH rings AS (SELECT fid, 0 AS ring, i, ax, ay, bx, by_ FROM ring_edges
        UNION ALL SELECT e.fid, 1, e.i, (e.bx + f.x0 + f.x1) / 3, (e.by_ + f.y0 + f.y1) / 3, (e.ax + f.x0 + f.x1) / 3, (e.ay + f.y0 + f.y1) / 3 FROM ring_edges e JOIN footprints f ON e.fid = f.fid),
      h AS (SELECT fid, floor_elevation, roof_elevation FROM features)
      SELECT r.fid, 'floor' AS part, r.ring, -1 AS edge, -r.i AS i, r.ax AS x, r.ay AS y, h.floor_elevation AS z FROM rings r JOIN h ON r.fid = h.fid
      UNION ALL SELECT r.fid, 'roof', r.ring, -1, r.i, r.ax, r.ay, h.roof_elevation FROM rings r JOIN h ON r.fid = h.fid WHERE h.roof_elevation IS NOT NULL
      UNION ALL SELECT r.fid, 'wall', r.ring, r.i, k.k, CASE WHEN k.k IN (0, 3) THEN r.ax ELSE r.bx END, CASE WHEN k.k IN (0, 3) THEN r.ay ELSE r.by_ END, CASE WHEN k.k < 2 THEN h.floor_elevation ELSE h.roof_elevation END
      FROM rings r JOIN h ON r.fid = h.fid CROSS JOIN (VALUES (0), (1), (2), (3)) AS k(k) WHERE h.roof_elevation IS NOT NULL""",
    "r1_rasterise": f"""WITH c AS (SELECT CAST(floor(x / 5) AS BIGINT) AS col, CAST(floor(y / 5) AS BIGINT) AS row_, z FROM points WHERE cls = 6),
      r AS (SELECT *, row_number() OVER (PARTITION BY col, row_ ORDER BY z) AS rn, count(*) OVER (PARTITION BY col, row_) AS cnt FROM c)
      SELECT col, row_, max(z) AS z_max, min(z) AS z_min, count(*) AS cnt, max(CASE WHEN rn = floor(cnt / 2.0e0) + 1 THEN z END) AS z_med, {near('avg(z)')} AS z_avg, {near('var_pop(z)')} AS z_var FROM r GROUP BY col, row_""",
    "r5_fill_window": """WITH o(d) AS (VALUES (-2), (-1), (0), (1)), n AS (SELECT r.col - a.d AS col, r.row_ - b.d AS row_, min(r.z) AS z FROM raster r CROSS JOIN o a CROSS JOIN o b GROUP BY 1, 2)
      SELECT n.col, n.row_, coalesce(r.z, n.z) AS z, r.z IS NULL AS filled FROM n LEFT JOIN raster r ON n.col = r.col AND n.row_ = r.row_""",
    "r7_raster_merger": "SELECT col, row_, max(z) AS z FROM (SELECT col, row_, z FROM raster UNION ALL SELECT CAST(floor(x / 5) AS BIGINT), CAST(floor(y / 5) AS BIGINT), z FROM points WHERE cls = 2) AS u GROUP BY col, row_",
    "s3_building_selector": "SELECT * FROM features WHERE fid = 0",
    "s6_print_result": "SELECT fid, concat('Result: ', CAST(fid AS VARCHAR(20))) AS info FROM features",
    "u1_point_cloud_merger": "SELECT cls, count(*) AS n FROM (SELECT cls FROM points WHERE cls = 2 UNION ALL SELECT cls FROM points WHERE cls = 6) AS u GROUP BY cls",
    "x2_label_costs": f"""WITH {_ZONAL}, held AS (SELECT a.face, a.fid, p.c, p.r, p.z FROM pixel p JOIN arr_face a ON floor(p.c / 5) = a.col AND floor(p.r / 5) = a.row_ WHERE a.in_footprint),
      cost AS (SELECT h.face, q.plane_id, sum(CAST(floor(abs(h.z + (q.a * (h.c + 0.5e0) + q.b * (h.r + 0.5e0) + q.d) / q.c) * 1e6 + 0.5e0) AS BIGINT)) AS off FROM held h JOIN planes q ON h.fid = q.fid GROUP BY h.face, q.plane_id),
      most AS (SELECT max(off) AS top FROM cost)
      SELECT face, plane_id, {near('50 * (CAST(off AS DOUBLE) / CAST(top AS DOUBLE))')} AS cost FROM cost CROSS JOIN most""",
    "x2_smoothness_costs": f"""WITH e AS (SELECT h.face, h.twin_face, sum(h.len) AS len FROM arr_halfedge h JOIN arr_face a ON h.face = a.face JOIN arr_face b ON h.twin_face = b.face WHERE a.in_footprint AND b.in_footprint GROUP BY h.face, h.twin_face),
      most AS (SELECT max(len) AS top FROM e) SELECT face, twin_face, {near('len / top')} AS cost FROM e CROSS JOIN most""",
    "x6_same_segment_edges": "SELECT h.face, h.twin_face FROM arr_halfedge h JOIN arr_face a ON h.face = a.face JOIN arr_face b ON h.twin_face = b.face WHERE a.in_footprint AND b.in_footprint AND a.segid = b.segid AND a.segid <> 0",
    "x9_footprint_dissolve": "SELECT h.face, h.twin_face FROM arr_halfedge h JOIN arr_face a ON h.face = a.face JOIN arr_face b ON h.twin_face = b.face WHERE a.in_footprint <> b.in_footprint",
    "x13_biggest_faces": "SELECT fid, segid, pixel_count FROM (SELECT fid, segid, CAST(sum(pixel_count) AS BIGINT) AS pixel_count, sum(sum(pixel_count)) OVER (PARTITION BY fid) AS total FROM arr_face GROUP BY fid, segid) AS t WHERE pixel_count > 0.34e0 * total",
    "a4_zonal_statistics": f"WITH {_ZONAL} SELECT face, fid, elevation_50p, elevation_70p, elevation_97p, elevation_min, elevation_max, pixels, data_coverage FROM zonal",
    "a4_global_elevations": f"""WITH {_ZONAL}, whole AS (SELECT 0 AS fid, z FROM zone)
      SELECT {percentile(0.5)} AS elevation_50p, {percentile(0.7)} AS elevation_70p, {percentile(0.99)} AS elevation_97p, min(z) AS elevation_min, max(z) AS elevation_max FROM ({ranked('whole')}) AS q""",
    "a11_tile_of_polygon": """WITH m AS (SELECT min(x0) AS left_, min(y0) AS low, CAST(floor((max(x1) - min(x0)) / 500 + 1) AS BIGINT) AS cols FROM footprints)
      SELECT fid, CAST(floor(((y0 + y1) / 2 - low) / 500) * cols + floor(((x0 + x1) / 2 - left_) / 500) AS BIGINT) AS tile_id FROM footprints CROSS JOIN m""",
    "j8_vertex_errors": f"""WITH v AS (SELECT DISTINCT fid, x, y, z FROM (SELECT fid, x0 AS x, y0 AS y, z0 AS z FROM triangles UNION ALL SELECT fid, x1, y1, z1 FROM triangles UNION ALL SELECT fid, x2, y2, z2 FROM triangles) AS t),
      d AS (SELECT v.fid, v.x, v.y, v.z, min((v.x - p.x) * (v.x - p.x) + (v.y - p.y) * (v.y - p.y) + (v.z - p.z) * (v.z - p.z)) AS squared FROM v JOIN points p ON v.fid = p.bucket AND p.cls = 6 GROUP BY v.fid, v.x, v.y, v.z)
      SELECT fid, count(*) AS vertices, {near('sqrt(avg(squared))')} AS rmse, max(squared) AS m2pc_error_max, {histogram('squared')} AS histogram FROM d GROUP BY fid""",
    "p9_isolated_vertices": f"WITH held AS (SELECT * FROM arr_face WHERE segid = 1), {_LATTICE} SELECT l.fid, l.vx, l.vy FROM lattice l WHERE NOT EXISTS (SELECT 1 FROM end_ e WHERE l.fid = e.fid AND l.vx = e.vx AND l.vy = e.vy)",
    "p9_debug_faces": "SELECT face, fid, segid AS label, pixel_count, in_footprint, NOT in_footprint AS is_footprint_hole FROM arr_face",
    "x10_redundant_vertices": f"WITH held AS (SELECT * FROM arr_face WHERE in_footprint), {_LATTICE} SELECT fid, vx, vy FROM end_ GROUP BY fid, vx, vy HAVING count(*) = 2",
    "x8_naive_step_edges": "SELECT h.face, h.twin_face, abs(a.elevation_50p - b.elevation_50p) AS step_ FROM arr_halfedge h JOIN arr_face a ON h.face = a.face JOIN arr_face b ON h.twin_face = b.face WHERE a.in_footprint AND b.in_footprint AND abs(a.elevation_50p - b.elevation_50p) < 1.0e0",
    "f1_area_with_holes": f"""WITH hole AS (SELECT e.fid, (e.bx + f.x0 + f.x1) / 3 AS ax, (e.by_ + f.y0 + f.y1) / 3 AS ay, (e.ax + f.x0 + f.x1) / 3 AS bx, (e.ay + f.y0 + f.y1) / 3 AS by_ FROM ring_edges e JOIN footprints f ON e.fid = f.fid)
      SELECT fid, {near('max(CASE WHEN ring = 0 THEN area END) - sum(CASE WHEN ring > 0 THEN area ELSE 0.0e0 END)')} AS area FROM (SELECT fid, 0 AS ring, abs(sum(ax * by_ - bx * ay)) / 2 AS area FROM ring_edges GROUP BY fid
        UNION ALL SELECT fid, 1, abs(sum(ax * by_ - bx * ay)) / 2 FROM hole GROUP BY fid) AS r GROUP BY fid""",
    "f2_newell_normal": f"""WITH e AS (SELECT r.fid, ax, ay, -(p.a * ax + p.b * ay + p.d) / p.c AS az, bx, by_, -(p.a * bx + p.b * by_ + p.d) / p.c AS bz FROM ring_edges r JOIN planes p ON r.fid = p.fid AND p.plane_id = 1),
      n AS (SELECT fid, sum((ay - by_) * (az + bz)) AS nx, sum((az - bz) * (ax + bx)) AS ny, sum((ax - bx) * (ay + by_)) AS nz FROM e GROUP BY fid), u AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS len FROM n)
      SELECT fid, {near('nx / len')} AS nx, {near('ny / len')} AS ny, {near('nz / len')} AS nz FROM u""",
    "f5_segment_distances": f"""WITH p AS (SELECT a.fid, a.sid AS a, b.sid AS b, a.x0, a.y0, a.x1, a.y1, b.x0 AS u0, b.y0 AS v0, b.x1 AS u1, b.y1 AS v1 FROM segments a JOIN segments b ON a.fid = b.fid AND a.sid < b.sid)
      SELECT fid, a, b, {near('CASE WHEN ' + crossed() + ' THEN 0.0e0 ELSE sqrt(least(' + ', '.join(to_segment(*q) for q in (('x0', 'y0', 'u0', 'v0', 'u1', 'v1'), ('x1', 'y1', 'u0', 'v0', 'u1', 'v1'), ('u0', 'v0', 'x0', 'y0', 'x1', 'y1'), ('u1', 'v1', 'x0', 'y0', 'x1', 'y1'))) + ')) END')} AS distance FROM p""",
    "f7_weighted_mean_angle": f"""WITH s AS (SELECT *, (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) AS w, CASE WHEN atan2(x1 - x0, y1 - y0) < 0 THEN atan2(x1 - x0, y1 - y0) + pi() ELSE atan2(x1 - x0, y1 - y0) END AS angle FROM segments)
      SELECT fid, {near('sum(w * angle) / sum(w)')} AS angle, {near('sum(w * (x0 + x1) / 2) / sum(w)')} AS x, {near('sum(w * (y0 + y1) / 2) / sum(w)')} AS y FROM s GROUP BY fid""",
    "f8_ring_check": f"""WITH v AS (SELECT fid, i, floor(vx / 8) AS vx, floor(vy / 8) AS vy, count(*) OVER (PARTITION BY fid) AS n FROM ring_vertices),
      k AS (SELECT v.fid, v.i, v.vx = q.vx AND v.vy = q.vy AS twice, (v.vx - p.vx) * (q.vy - v.vy) = (v.vy - p.vy) * (q.vx - v.vx) AS straight FROM v JOIN v p ON v.fid = p.fid AND {step('', 'p')} JOIN v q ON v.fid = q.fid AND {step('', 'q')})
      SELECT fid, count(CASE WHEN twice THEN 1 END) AS repeated, count(CASE WHEN straight THEN 1 END) AS straight, count(CASE WHEN NOT twice THEN 1 END) >= 3 AS valid FROM k GROUP BY fid""",
}

SQL |= surfaces.SQL


def oracle() -> dict[str, str]:
    return {name: read(with_views(sql), "duckdb") for name, sql in SQL.items()} | {name: graphs.oracle(name) for name in graphs.GRAPHS}


def query(name: str):
    """The query of that name, as a function of the session and the folder of tables.

    Views given by name, such as ``points=`` of a scanned cloud, stand in for those made from the tables.
    """

    def run(spark: SparkSession, sf_dir: str, **given: DataFrame) -> DataFrame:
        for view, rows in given.items():
            rows.createOrReplaceTempView(view)
        text = read(with_views(SQL[name] if name in SQL else " ".join(graphs.GRAPHS[name]), tuple(given)), "spark")
        for table in TABLES:
            if table in text:
                spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        if name in features.PLANS:
            return features.PLANS[name](lambda sql: spark.sql(read(with_views(sql, tuple(given)), "spark")))
        return spark.sql(text)

    return run


QUERIES = {name: query(name) for name in SQL} | graphs.QUERIES | {name: query(name) for name in features.PLANS} | kernels.QUERIES
