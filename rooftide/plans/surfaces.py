"""Queries over plane adjacency, nearest points, polygon rasters, roof parts and indexed meshes, for Spark and DuckDB.

Neighbours are sought within one feature, in the cells around a point first, and in the whole feature only where these
don't settle the answer. Equal distances go to the smaller coordinates.
"""

from __future__ import annotations

from rooftide.plans.dialects import count_where, gathered, series


def near(x: str) -> str:
    """Half-up rounding to four places, alike in both engines."""
    return f"floor(({x}) * 1e4 + 0.5e0) / 1e4"


def inside(px: str, py: str) -> str:
    """Even-odd crossings of a ray from the point with the ring in ``edges``, counted within the row."""
    return count_where("edges", f"(e.ay > {py}) <> (e.by_ > {py}) AND {px} < (e.bx - e.ax) * ({py} - e.ay) / (e.by_ - e.ay) + e.ax") + " % 2 = 1"


#: Footprints in their buckets, each with its ring as an array of edges.
SHAPES = f"shapes AS (SELECT b.*, r.edges FROM footprint_buckets b JOIN (SELECT fid, {gathered('ax', 'ay', 'bx', 'by_')} AS edges FROM ring_edges GROUP BY fid) AS r ON b.fid = r.fid)"


def ranked(rows: str) -> str:
    """Distinct heights of each ``fid`` with the number of rows up to each and of all: rows are folded before any is sorted."""
    return f"SELECT fid, z, sum(n) OVER (PARTITION BY fid ORDER BY z) AS upto, sum(n) OVER (PARTITION BY fid) AS cnt FROM (SELECT fid, z, count(*) AS n FROM {rows} GROUP BY fid, z) AS folded"


def percentile(p: float) -> str:
    """The height at place ``floor(p * (n - 1))`` of a group of ``ranked`` rows."""
    return f"min(CASE WHEN upto > floor((cnt - 1) * {p}e0) THEN z END)"


#: Roof points in the frame of their feature; label 0 is unsegmented, 1 to 4 are planes.
_LABELLED = "labelled AS (SELECT DISTINCT bucket AS fid, x - bucket * 20 AS x, y, z, CAST(l_suppkey % 5 AS INT) AS label FROM points WHERE cls = 6)"


#: Side of the cells in which neighbours are sought first, and steps to the cells around.
CELL = 4
_AROUND = "o(d) AS (VALUES (-1), (0), (1))"
_SQUARED = "(p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)"


def celled(rows: str) -> str:
    return f"(SELECT *, floor(x / {CELL}) AS cx, floor(y / {CELL}) AS cy FROM {rows})"


def around(rows: str) -> str:
    """Rows once for each of the nine cells about them, ``jx, jy``."""
    return f"(SELECT p.*, p.cx + a.d AS jx, p.cy + b.d AS jy FROM {celled(rows)} AS p CROSS JOIN o a CROSS JOIN o b)"


def adjacency(k: int = 15) -> str:
    """Plane pairs with the number of cross-label neighbours among each labelled point's ``k`` nearest.

    Neighbours come from the cells around; a point counts as done if its k-th is no farther than a cell's side, as all
    nearer ones are there then. Only the others are compared with their whole feature.
    """
    order = f"ORDER BY {_SQUARED}, q.x, q.y, q.z, q.label"
    own = "PARTITION BY p.fid, p.x, p.y, p.z, p.label"
    other = "(p.x <> q.x OR p.y <> q.y OR p.z <> q.z OR p.label <> q.label)"
    return f"""{_AROUND}, seeking AS (SELECT * FROM labelled WHERE label <> 0),
    close_by AS (SELECT p.fid, p.x, p.y, p.z, p.label, q.label AS other, {_SQUARED} AS squared, row_number() OVER ({own} {order}) AS rn
      FROM {around('seeking')} AS p JOIN {celled('labelled')} AS q ON p.fid = q.fid AND p.jx = q.cx AND p.jy = q.cy AND {other}),
    done AS (SELECT DISTINCT fid, x, y, z, label FROM close_by WHERE rn = {k} AND squared <= {CELL * CELL}),
    rest AS (SELECT s.* FROM seeking s LEFT JOIN done d ON s.fid = d.fid AND s.x = d.x AND s.y = d.y AND s.z = d.z AND s.label = d.label WHERE d.fid IS NULL),
    far_off AS (SELECT p.fid, p.x, p.y, p.z, p.label, q.label AS other, row_number() OVER ({own} {order}) AS rn FROM rest p JOIN labelled q ON p.fid = q.fid AND {other}),
    pairs AS (SELECT c.fid, c.label, c.other, c.rn FROM close_by c JOIN done d ON c.fid = d.fid AND c.x = d.x AND c.y = d.y AND c.z = d.z AND c.label = d.label
      UNION ALL SELECT fid, label, other, rn FROM far_off),
    adjacent AS (SELECT fid, greatest(label, other) AS hi, least(label, other) AS lo, count(*) AS cnt FROM pairs WHERE rn <= {k} AND other <> 0 AND other <> label GROUP BY 1, 2, 3)"""


def scanned(edges: str, keys: str) -> str:
    """Even-odd scanline cells of closed rings; ``edges`` has the keys and ends ``ax, ay, bx, by_`` in cells.

    Crossings are cut to whole columns and both ends of a span are filled. Rows and columns come from the rings' own extent.
    """
    return f"""swept AS (SELECT *, {series('CAST(floor(least(ay, by_)) AS BIGINT)', 'CAST(ceil(greatest(ay, by_)) AS BIGINT)')} AS r FROM {edges}),
    crossing AS (SELECT {keys}, r, CAST(floor(bx + (r - by_) / (ay - by_) * (ax - bx)) AS BIGINT) AS ix FROM swept WHERE (by_ < r AND ay >= r) OR (ay < r AND by_ >= r)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY {keys}, r ORDER BY ix) AS rn FROM crossing),
    span AS (SELECT {keys}, r, min(ix) AS lo, max(ix) AS hi FROM numbered GROUP BY {keys}, r, floor((rn - 1) / 2.0e0)),
    filled AS (SELECT {keys}, {series('lo', 'hi')} AS col, r AS row_ FROM span)"""


#: Triangles' cells of 1 x 1 on a grid half a cell around the feature, with the height of the triangle's plane at the centre.
ROOF_CELLS = f"""local AS (SELECT t.fid, t.tri_id, t.x0 - f.x0 + 0.5e0 AS x0, t.y0 - f.y0 + 0.5e0 AS y0, t.z0, t.x1 - f.x0 + 0.5e0 AS x1, t.y1 - f.y0 + 0.5e0 AS y1, t.z1,
      t.x2 - f.x0 + 0.5e0 AS x2, t.y2 - f.y0 + 0.5e0 AS y2, t.z2 FROM triangles t JOIN footprints f ON t.fid = f.fid),
    sides AS (SELECT fid, tri_id, x0 AS ax, y0 AS ay, x1 AS bx, y1 AS by_ FROM local UNION ALL SELECT fid, tri_id, x1, y1, x2, y2 FROM local UNION ALL SELECT fid, tri_id, x2, y2, x0, y0 FROM local),
    {scanned('sides', 'fid, tri_id')},
    cells AS (SELECT c.fid, c.tri_id, c.col, c.row_, t.z0 + ((t.z1 - t.z0) * ((c.col + 0.5e0 - t.x0) * (t.y2 - t.y0) - (t.x2 - t.x0) * (c.row_ + 0.5e0 - t.y0))
      + (t.z2 - t.z0) * ((t.x1 - t.x0) * (c.row_ + 0.5e0 - t.y0) - (c.col + 0.5e0 - t.x0) * (t.y1 - t.y0))) / ((t.x1 - t.x0) * (t.y2 - t.y0) - (t.x2 - t.x0) * (t.y1 - t.y0)) AS z
      FROM filled c JOIN local t ON c.fid = t.fid AND c.tri_id = t.tri_id)"""

#: Triangles over vertices numbered in the order of their coordinates.
_INDEXED = """corners AS (SELECT fid, tri_id, 0 AS k, x0 AS x, y0 AS y, z0 AS z FROM triangles UNION ALL SELECT fid, tri_id, 1, x1, y1, z1 FROM triangles UNION ALL SELECT fid, tri_id, 2, x2, y2, z2 FROM triangles),
    vertex AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY x, y, z) - 1 AS v FROM (SELECT DISTINCT fid, x, y, z FROM corners) AS d),
    face AS (SELECT c.fid, c.tri_id, max(CASE WHEN k = 0 THEN v END) AS v0, max(CASE WHEN k = 1 THEN v END) AS v1, max(CASE WHEN k = 2 THEN v END) AS v2
      FROM corners c JOIN vertex v ON c.fid = v.fid AND c.x = v.x AND c.y = v.y AND c.z = v.z GROUP BY c.fid, c.tri_id),
    kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fid, least(v0, v1, v2), greatest(v0, v1, v2), v0 + v1 + v2 ORDER BY tri_id) AS copy FROM face
      WHERE v0 <> v1 AND v1 <> v2 AND v0 <> v2) AS f WHERE copy = 1)"""



def to_edge(a: int, b: int) -> str:
    """Squared distance of the point ``x, y, z`` from the edge between two corners of a triangle."""
    t = f"least(greatest(((x - x{a}) * (x{b} - x{a}) + (y - y{a}) * (y{b} - y{a}) + (z - z{a}) * (z{b} - z{a})) / ((x{b} - x{a}) * (x{b} - x{a}) + (y{b} - y{a}) * (y{b} - y{a}) + (z{b} - z{a}) * (z{b} - z{a})), 0.0e0), 1.0e0)"
    return " + ".join(f"power({c} - {c}{a} - {t} * ({c}{b} - {c}{a}), 2)" for c in "xyz")


def beside(a: int, b: int) -> str:
    """Whether the point's foot on the plane lies on the inner side of an edge; ``nx, ny, nz`` is the triangle's normal."""
    cross = [f"(({u}{b} - {u}{a}) * ({v} - {v}{a}) - ({v}{b} - {v}{a}) * ({u} - {u}{a}))" for u, v in ("yz", "zx", "xy")]
    return f"{cross[0]} * nx + {cross[1]} * ny + {cross[2]} * nz >= 0"


SQL = {
    "a6_plane_summary": f"""WITH pts AS (SELECT bucket AS fid, z, CAST(l_suppkey % 5 AS INT) AS label FROM points WHERE cls = 6),
      kind AS (SELECT fid, plane_id, c / sqrt(a * a + b * b + c * c) AS up FROM planes),
      tagged AS (SELECT p.fid, p.z, p.label, k.up FROM pts p LEFT JOIN kind k ON p.fid = k.fid AND p.label = k.plane_id),
      roofs AS (SELECT fid, z FROM tagged WHERE up >= 0.3e0), heights AS (SELECT fid, {percentile(0.5)} AS z_50p, {percentile(0.7)} AS z_70p FROM ({ranked('roofs')}) AS q GROUP BY fid),
      counted AS (SELECT fid, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS unsegmented, sum(CASE WHEN up < 0.3e0 THEN 1 ELSE 0 END) AS wall, sum(CASE WHEN up >= 0.3e0 THEN 1 ELSE 0 END) AS roof,
        sum(CASE WHEN up > 0.97e0 THEN 1 ELSE 0 END) AS level, count(DISTINCT CASE WHEN up > 0.97e0 THEN label END) AS horizontal, count(DISTINCT CASE WHEN up >= 0.3e0 AND up <= 0.97e0 THEN label END) AS slanted,
        count(DISTINCT CASE WHEN label <> 0 THEN label END) AS planes, min(CASE WHEN up >= 0.3e0 THEN z END) AS z_min, max(CASE WHEN up >= 0.3e0 THEN z END) AS z_max FROM tagged GROUP BY fid)
      SELECT c.fid, CAST(roof AS BIGINT) AS roof_points, CAST(wall AS BIGINT) AS wall_points, CAST(unsegmented AS BIGINT) AS unsegmented_points, horizontal, slanted, z_min, z_max, z_50p, z_70p,
        CASE WHEN planes = 0 THEN 'no points' WHEN horizontal = 1 AND slanted = 0 THEN 'horizontal' WHEN level * 1.0e0 / greatest(roof, 1) > 0.95e0 THEN 'multiple horizontal' WHEN slanted > 0 THEN 'slanted' ELSE 'no planes' END AS roof_type FROM counted c LEFT JOIN heights h ON c.fid = h.fid""",
    "j8_mesh_quality": f"""WITH p AS (SELECT bucket AS fid, x, y, z, count(*) AS n FROM points WHERE cls = 6 GROUP BY bucket, x, y, z),
      t AS (SELECT *, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS nx, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS ny, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS nz FROM triangles WHERE label = 1),
      d AS (SELECT p.*, t.tri_id, CASE WHEN {beside(0, 1)} AND {beside(1, 2)} AND {beside(2, 0)} THEN power((x - x0) * nx + (y - y0) * ny + (z - z0) * nz, 2) / (nx * nx + ny * ny + nz * nz)
        ELSE least({to_edge(0, 1)}, {to_edge(1, 2)}, {to_edge(2, 0)}) END AS squared FROM p JOIN t ON p.fid = t.fid),
      nearest AS (SELECT *, row_number() OVER (PARTITION BY fid, x, y, z ORDER BY squared, tri_id) AS rn FROM d)
      SELECT fid, tri_id, CAST(sum(n) AS BIGINT) AS points, {near('sqrt(sum(squared * n) / sum(n))')} AS rmse, {near('max(squared)')} AS largest FROM nearest WHERE rn = 1 GROUP BY fid, tri_id""",
    "j4_plane_segments": f"""WITH {_LABELLED}, {adjacency()},
      line AS (SELECT p.fid, j.hi, j.lo, p.b * q.c - p.c * q.b AS dx, p.c * q.a - p.a * q.c AS dy, p.a * q.b - p.b * q.a AS dz,
        q.d * p.a - p.d * q.a AS ux, q.d * p.b - p.d * q.b AS uy, q.d * p.c - p.d * q.c AS uz
        FROM adjacent j JOIN planes p ON j.fid = p.fid AND j.hi = p.plane_id JOIN planes q ON j.fid = q.fid AND j.lo = q.plane_id WHERE j.cnt >= 5),
      based AS (SELECT fid, hi, lo, dx / len AS dx, dy / len AS dy, dz / len AS dz, (uy * dz - uz * dy) / len / len AS px, (uz * dx - ux * dz) / len / len AS py, (ux * dy - uy * dx) / len / len AS pz
        FROM (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS len FROM line) AS l WHERE len > 0),
      along AS (SELECT b.*, t.label, (t.x - px) * dx + (t.y - py) * dy + (t.z - pz) * dz AS s, (t.x - px) * (t.x - px) + (t.y - py) * (t.y - py) + (t.z - pz) * (t.z - pz) AS far
        FROM based b JOIN labelled t ON b.fid = t.fid AND (t.label = b.hi OR t.label = b.lo)),
      side AS (SELECT fid, hi, lo, px, py, pz, dx, dy, dz, label, min(s) AS s0, max(s) AS s1 FROM along WHERE far - s * s < 16 GROUP BY fid, hi, lo, px, py, pz, dx, dy, dz, label HAVING count(*) >= 2),
      both_ AS (SELECT fid, hi, lo, px, py, pz, dx, dy, dz, max(s0) AS s0, min(s1) AS s1 FROM side GROUP BY fid, hi, lo, px, py, pz, dx, dy, dz HAVING count(*) = 2)
      SELECT fid, hi, lo, {near('px + s0 * dx')} AS x0, {near('py + s0 * dy')} AS y0, {near('pz + s0 * dz')} AS z0, {near('px + s1 * dx')} AS x1, {near('py + s1 * dy')} AS y1, {near('pz + s1 * dz')} AS z1,
        {near('abs(s1 - s0)')} AS length FROM both_ WHERE (s1 - s0) * (s1 - s0) > 1e-10""",
    "j6_plane_adjacency": f"WITH {_LABELLED}, {adjacency()} SELECT fid, hi, lo, cnt FROM adjacent",
    "j7_nearest_distance": f"""WITH {_AROUND}, s AS (SELECT DISTINCT bucket AS fid, x, y, z, cls FROM points WHERE cls <> 1), from_ AS (SELECT fid, x, y, z FROM s WHERE cls = 6), to_ AS (SELECT fid, x, y, z FROM s WHERE cls = 2),
      close_by AS (SELECT p.fid, p.x, p.y, p.z, min({_SQUARED}) AS squared FROM {around('from_')} AS p JOIN {celled('to_')} AS q ON p.fid = q.fid AND p.jx = q.cx AND p.jy = q.cy GROUP BY p.fid, p.x, p.y, p.z),
      done AS (SELECT * FROM close_by WHERE squared <= {CELL * CELL}), rest AS (SELECT f.* FROM from_ f LEFT JOIN done d ON f.fid = d.fid AND f.x = d.x AND f.y = d.y AND f.z = d.z WHERE d.fid IS NULL),
      found AS (SELECT * FROM done UNION ALL SELECT p.fid, p.x, p.y, p.z, min({_SQUARED}) FROM rest p JOIN to_ q ON p.fid = q.fid GROUP BY p.fid, p.x, p.y, p.z)
      SELECT fid, x, y, z, {near('sqrt(squared)')} AS distance FROM found""",
    "j9_point_location": "SELECT a.face, a.fid, a.segid, count(*) AS located, max(p.z) AS z FROM points p JOIN arr_face a ON floor(p.x / 5) = a.col AND floor(p.y / 5) = a.row_ WHERE p.cls <> 1 GROUP BY a.face, a.fid, a.segid",
    "j9_carry_attributes": """WITH o(d) AS (VALUES (0), (1)), part_ AS (SELECT floor((a.col * 5 - 2 + o.d * 5) / 8.0e0) AS nc, floor((a.row_ * 5 - 2 + q.d * 5) / 8.0e0) AS nr, a.* FROM arr_face a CROSS JOIN o CROSS JOIN o q),
      share AS (SELECT DISTINCT nc, nr, face, segid, in_footprint, (least(nc * 8 + 10, col * 5 + 5) - greatest(nc * 8 + 2, col * 5)) * (least(nr * 8 + 10, row_ * 5 + 5) - greatest(nr * 8 + 2, row_ * 5)) AS area
        FROM part_ WHERE least(nc * 8 + 10, col * 5 + 5) > greatest(nc * 8 + 2, col * 5) AND least(nr * 8 + 10, row_ * 5 + 5) > greatest(nr * 8 + 2, row_ * 5)),
      best AS (SELECT *, row_number() OVER (PARTITION BY nc, nr ORDER BY area DESC, face) AS rn FROM share)
      SELECT CAST(nc AS BIGINT) AS col, CAST(nr AS BIGINT) AS row_, face, segid, in_footprint FROM best WHERE rn = 1""",
    "a9_roof_parts": f"""WITH {ROOF_CELLS}, ordered AS (SELECT fid, tri_id, z, row_number() OVER (PARTITION BY fid, tri_id ORDER BY z) AS rn, count(*) OVER (PARTITION BY fid, tri_id) AS n FROM cells),
      h AS (SELECT fid, tri_id, min(z) AS h_min, max(z) AS h_max, max(CASE WHEN rn = floor((n - 1) * 0.5e0) + 1 THEN z END) AS h_50p, max(CASE WHEN rn = floor((n - 1) * 0.7e0) + 1 THEN z END) AS h_70p FROM ordered GROUP BY fid, tri_id),
      slope AS (SELECT fid, tri_id, least(z0, z1, z2) AS z_min, greatest(z0, z1, z2) AS z_max, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS nx, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS ny, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS nz FROM triangles)
      SELECT s.fid, s.tri_id, {near('coalesce(h_min, z_min)')} AS h_min, {near('coalesce(h_max, z_max)')} AS h_max, {near('coalesce(h_50p, z_min)')} AS h_50p, {near('coalesce(h_70p, z_max)')} AS h_70p,
        {near('degrees(atan2(sqrt(nx * nx + ny * ny), nz))')} AS slope, {near('CASE WHEN atan2(nx, ny) < 0 THEN degrees(atan2(nx, ny)) + 360 ELSE degrees(atan2(nx, ny)) END')} AS azimuth
      FROM slope s LEFT JOIN h ON s.fid = h.fid AND s.tri_id = h.tri_id""",
    "a10_indexed_mesh": f"WITH {_INDEXED} SELECT fid, tri_id, v0, v1, v2 FROM face",
    "m11_surface_mesh": f"WITH {_INDEXED} SELECT fid, tri_id, v0, v1, v2 FROM kept",
    "s4_off_text": f"""WITH {_INDEXED} SELECT fid, 0 AS part_, 0 AS line, 'OFF' AS text FROM footprints
      UNION ALL SELECT v.fid, 1, 0, printf('%d %d 0', v.n, coalesce(f.n, 0)) FROM (SELECT fid, count(*) AS n FROM vertex GROUP BY fid) v LEFT JOIN (SELECT fid, count(*) AS n FROM kept GROUP BY fid) f ON v.fid = f.fid
      UNION ALL SELECT fid, 2, v, printf('%.5f %.5f %.5f', x, y, z) FROM vertex
      UNION ALL SELECT fid, 3, tri_id, printf('3 %d %d %d', v0, v1, v2) FROM kept""",
    "m2_polygon_offset": f"""WITH u AS (SELECT *, count(*) OVER (PARTITION BY fid) AS n, (by_ - ay) / sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS nx, (ax - bx) / sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS ny FROM ring_edges)
      SELECT q.fid, q.i, {near('q.ax + 4 * (p.nx + q.nx) / (1 + p.nx * q.nx + p.ny * q.ny)')} AS x, {near('q.ay + 4 * (p.ny + q.ny) / (1 + p.nx * q.nx + p.ny * q.ny)')} AS y FROM u q JOIN u p ON q.fid = p.fid AND p.i = (q.i + q.n - 1) % q.n""",
    "r2_building_raster": f"""WITH {SHAPES}, near_by AS (SELECT /*+ SHUFFLE_HASH(f) */ f.fid, p.z, p.cls, CAST(floor(p.x - f.x0 + 1) AS BIGINT) AS col, CAST(floor(p.y - f.y0 + 1) AS BIGINT) AS row_
        FROM points p JOIN footprint_buckets f ON p.bucket = f.bucket AND p.x BETWEEN f.x0 - 1 AND f.x1 + 1 AND p.y BETWEEN f.y0 - 1 AND f.y1 + 1 WHERE p.cls <> 1),
      cloud AS (SELECT fid, col, row_, max(CASE WHEN cls = 6 THEN z END) AS building, max(CASE WHEN cls = 2 THEN z END) AS ground FROM near_by GROUP BY fid, col, row_),
      ground_ AS (SELECT fid, z FROM near_by WHERE cls = 2), low AS (SELECT fid, {percentile(0.05)} AS z FROM ({ranked('ground_')}) AS q GROUP BY fid),
      across AS (SELECT *, {series('0', 'CAST(floor(x1 - x0 + 3) AS BIGINT) - 1')} AS col FROM shapes WHERE bucket = fid), cell AS (SELECT *, {series('0', 'CAST(floor(y1 - y0 + 3) AS BIGINT) - 1')} AS row_ FROM across),
      placed AS (SELECT fid, CAST(col AS BIGINT) AS col, CAST(row_ AS BIGINT) AS row_, NOT ({inside('(x0 + col - 0.5e0)', '(y0 + row_ - 0.5e0)')}) AS beyond FROM cell)
      SELECT o.fid, o.col, o.row_, CASE WHEN o.beyond THEN greatest(low.z, coalesce(p.building, low.z)) ELSE coalesce(p.building, p.ground) END AS z
      FROM placed o LEFT JOIN cloud p ON o.fid = p.fid AND o.col = p.col AND o.row_ = p.row_ LEFT JOIN low ON o.fid = low.fid""",
    "r3_segment_raster": f"WITH {ROOF_CELLS} SELECT fid, col, row_, {near('max(z)')} AS z, CAST(count(*) OVER (PARTITION BY fid) AS DOUBLE) AS data_area FROM cells GROUP BY fid, col, row_",
    "r3_filled_raster": f"""WITH {ROOF_CELLS}, written AS (SELECT fid, col, row_, max(z) AS z FROM cells WHERE (col + row_) % 3 <> 0 GROUP BY fid, col, row_), w(d) AS (VALUES (-5), (-4), (-3), (-2), (-1), (0), (1), (2), (3), (4)),
      around_ AS (SELECT r.fid, r.col - a.d AS col, r.row_ - b.d AS row_, min(r.z) AS z FROM written r CROSS JOIN w a CROSS JOIN w b GROUP BY r.fid, r.col - a.d, r.row_ - b.d),
      box AS (SELECT fid, max(col) AS cols, max(row_) AS rows_ FROM written GROUP BY fid)
      SELECT n.fid, CAST(n.col AS BIGINT) AS col, CAST(n.row_ AS BIGINT) AS row_, {near('coalesce(r.z, n.z)')} AS z, r.z IS NULL AS filled FROM around_ n JOIN box b ON n.fid = b.fid AND n.col BETWEEN 0 AND b.cols AND n.row_ BETWEEN 0 AND b.rows_
      LEFT JOIN written r ON n.fid = r.fid AND n.col = r.col AND n.row_ = r.row_""",
    "r3_cell_size": f"SELECT fid, 0.05e0 * power(2.0e0, greatest(0.0e0, ceil(log2((x1 - x0 + 1) * (y1 - y0 + 1) / (0.05e0 * 0.05e0) / 1e5) / 2))) AS cellsize FROM footprints",
    "r0_raster_cells": """WITH b AS (SELECT min(x) AS x0, min(y) AS y0, CAST(floor((max(x) - min(x)) / 5 + 1) AS BIGINT) AS dimx, CAST(floor((max(y) - min(y)) / 5 + 1) AS BIGINT) AS dimy FROM points),
      c AS (SELECT CAST(floor((x - x0) / 5) AS BIGINT) AS col, CAST(floor((y - y0) / 5) AS BIGINT) AS row_, count(*) AS points, min(z) AS z_min, max(z) AS z_max FROM points CROSS JOIN b GROUP BY 1, 2)
      SELECT col, row_, row_ * dimx + col AS linear, x0 + (col + 0.5e0) * 5 AS cx, y0 + (row_ + 0.5e0) * 5 AS cy, points, z_min, z_max FROM c CROSS JOIN b""",
    "r4_polygon_cells": f"WITH sides AS (SELECT e.fid, e.ax - f.x0 AS ax, e.ay - f.y0 AS ay, e.bx - f.x0 AS bx, e.by_ - f.y0 AS by_ FROM ring_edges e JOIN footprints f ON e.fid = f.fid), {scanned('sides', 'fid')} SELECT fid, col, row_ FROM filled",
    "x17_unlabelled_area": f"SELECT fid, 25.0e0 * sum(CASE WHEN segid = 0 THEN 1 ELSE 0 END) AS area, {near('sum(CASE WHEN segid = 0 THEN 1.0e0 ELSE 0.0e0 END) / count(*)')} AS share FROM arr_face WHERE in_footprint GROUP BY fid",
}
