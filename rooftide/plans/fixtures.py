"""Spatial views over the star-schema tables, as SQL that Spark and DuckDB both run."""

VIEWS = {
    "points": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CAST(l_partkey AS DOUBLE) AS x, l_quantity AS y, l_extendedprice / 1000 AS z,
       CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 6 ELSE 1 END AS cls,
       CAST(floor(l_partkey / 20.0e0) AS BIGINT) AS bucket
FROM lineitem
""",
    "footprints": """
SELECT s_suppkey AS fid, s_suppkey * 20 - 0.25e0 AS x0, s_suppkey * 20 + 24.25e0 AS x1,
       (s_suppkey % 3) * 5 + 0.75e0 AS y0, (s_suppkey % 3) * 5 + 36.25e0 AS y1
FROM supplier
""",
    "ring_vertices": """
SELECT fid, i,
       CASE i WHEN 0 THEN x0 WHEN 1 THEN x0 + 6 WHEN 2 THEN x1 - 6 WHEN 3 THEN x1 WHEN 4 THEN x1 - 6 ELSE x0 + 6 END AS vx,
       CASE i WHEN 0 THEN (y0 + y1) / 2 WHEN 1 THEN y0 WHEN 2 THEN y0 WHEN 3 THEN (y0 + y1) / 2 ELSE y1 END AS vy
FROM footprints CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS t(i)
""",
    "ring_edges": """
SELECT a.fid, a.i, a.vx AS ax, a.vy AS ay, b.vx AS bx, b.vy AS by_
FROM ring_vertices a JOIN ring_vertices b ON a.fid = b.fid AND b.i = (a.i + 1) % 6
""",
    "footprint_buckets": """
SELECT f.*, f.fid + o.d AS bucket
FROM footprints f CROSS JOIN (VALUES (-1), (0), (1)) AS o(d)
""",
    "segments": """
SELECT CAST(floor(p_partkey / 20.0e0) AS BIGINT) AS fid, p_partkey AS sid,
       CAST(p_partkey % 20 AS DOUBLE) AS x0, CAST(p_size AS DOUBLE) AS y0, 0.0e0 AS z0,
       CAST(p_partkey % 20 + 1 + p_size % 7 AS DOUBLE) AS x1, CAST(p_size + p_partkey % 5 AS DOUBLE) AS y1,
       CAST(p_size % 3 AS DOUBLE) AS z1, CAST(p_partkey % 2 * 2 AS INT) AS priority
FROM part
""",
    "planes": """
SELECT s_suppkey AS fid, k AS plane_id, (k - 2.5e0) / 4 AS a, (s_suppkey % 5 - 2) / 8.0e0 AS b, 1.0e0 AS c,
       -(10.0e0 + k + s_suppkey % 7) AS d
FROM supplier CROSS JOIN (VALUES (1), (2), (3), (4)) AS t(k)
""",
    "triangles": """
SELECT e.fid, e.i AS tri_id, CAST(1 AS INT) AS label,
       e.ax AS x0, e.ay AS y0, 10.0e0 AS z0, e.bx AS x1, e.by_ AS y1, 10.0e0 AS z1,
       (f.x0 + f.x1) / 2 AS x2, (f.y0 + f.y1) / 2 AS y2, 12.0e0 + f.fid % 4 AS z2
FROM ring_edges e JOIN footprints f ON e.fid = f.fid
""",
    "raster": """
SELECT CAST(floor(x / 5) AS BIGINT) AS col, CAST(floor(y / 5) AS BIGINT) AS row_, max(z) AS z, count(*) AS cnt
FROM points WHERE cls = 6 GROUP BY 1, 2
""",
    "arr_face": """
SELECT CAST(col * 1000 + row_ AS BIGINT) AS face, col, row_, CAST(floor(col / 4.0e0) AS BIGINT) AS fid,
       CAST(cnt % 3 AS INT) AS segid, cnt % 5 <> 0 AS in_footprint, z AS elevation_50p, cnt AS pixel_count
FROM raster
""",
    "arr_halfedge": """
SELECT a.face, b.face AS twin_face, 5.0e0 AS len
FROM arr_face a JOIN arr_face b ON a.fid = b.fid
 AND ((a.col = b.col AND abs(a.row_ - b.row_) = 1) OR (a.row_ = b.row_ AND abs(a.col - b.col) = 1))
""",
    "features": """
SELECT s_suppkey AS fid, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 2 = 0 END AS skip_flag,
       CASE s_suppkey % 5 WHEN 0 THEN 'no points' WHEN 1 THEN 'no planes' WHEN 2 THEN 'horizontal' WHEN 3 THEN 'multiple horizontal' ELSE 'slanted' END AS roof_type,
       CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_acctbal / 100 END AS roof_elevation, CAST(s_suppkey % 3 AS DOUBLE) AS floor_elevation
FROM supplier
""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def with_views(sql: str, given: tuple[str, ...] = ()) -> str:
    """``sql`` with the views it names, and those they name, as common table expressions; those ``given`` exist already."""
    import re

    wanted: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in given and re.search(rf"\b{name}\b", text) and name not in wanted:
                need(VIEWS[name])
                wanted.append(name)

    need(sql)
    ctes = [f"{n} AS ({VIEWS[n].strip()})" for n in wanted]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        ctes.append(body[5:])
        return "WITH " + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
