import struct

import numpy as np
import pytest

from rooftide.plans import catalog
from rooftide.sources import las
from rooftide.sources.off import write_off


def las_file(path, xyz, cls, minor=2, kind=0, crs=None):
    """A file of the given points, with a scale of 0.01 and an offset of 100."""
    size, length = (375, 30) if minor >= 4 else (227, 20)
    vlr = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(crs), b"") + crs if crs else b""
    head = bytearray(size)
    head[:4], head[24], head[25] = b"LASF", 1, minor
    struct.pack_into("<HIIBHI", head, 94, size, size + len(vlr), bool(crs), kind, length, 0 if minor >= 4 else len(xyz))
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 100, 100, 100)
    a = np.array(xyz, float).reshape(-1, 3)
    if len(a):
        struct.pack_into("<6d", head, 179, *(v for i in range(3) for v in (a[:, i].max(), a[:, i].min())))
    if minor >= 4:
        struct.pack_into("<Q", head, 247, len(xyz))
    body = b""
    for p, c in zip(xyz, cls):
        r = bytearray(length)
        struct.pack_into("<3iH", r, 0, *(round((v - 100) * 100) for v in p), 7)
        r[16 if kind >= 6 else 15] = c
        body += r
    path.write_bytes(bytes(head) + vlr + body)


def read(spark, **options):
    las.register(spark)
    df = spark.read.format("las").options(**options).load()
    return sorted((r.file.rsplit("/", 1)[1], r.pid, round(r.x, 2), round(r.y, 2), round(r.z, 2), r.intensity, r.classification) for r in df.collect())


def test_las_points_areas_and_formats(spark, tmp_path):
    las_file(tmp_path / "a.las", [(1, 2, 3), (4.25, 5, 6), (7, 8, -9)], [2, 6, 2 | 32])
    las_file(tmp_path / "b.LAS", [(50, 60, 70)], [66], minor=4, kind=6, crs=b'PROJCS["x"]\0')
    las_file(tmp_path / "c.las", [], [])
    (tmp_path / "notes.txt").write_text("no points")
    rows = [("a.las", 0, 1, 2, 3, 7, 2), ("a.las", 1, 4.25, 5, 6, 7, 6), ("a.las", 2, 7, 8, -9, 7, 2), ("b.LAS", 0, 50, 60, 70, 7, 66)]
    assert read(spark, path=str(tmp_path)) == rows
    assert read(spark, path=f"{tmp_path}/b.LAS {tmp_path}/a.las", points="2") == rows
    assert read(spark, path=str(tmp_path), x0="4.25", y0="0", x1="20", y1="20") == rows[1:3]
    assert read(spark, path=f"file://{tmp_path}") == rows and read(spark, path=f"file://{tmp_path}/b.LAS") == rows[3:]
    assert read(spark, path=str(tmp_path), x0="900", y0="0", x1="999", y1="20") == []
    assert las.wkt(f"{tmp_path}/b.LAS") == 'PROJCS["x"]' and las.wkt(f"{tmp_path}/a.las") is None


def test_las_refuses_other_files(tmp_path):
    las_file(tmp_path / "z.laz", [(1, 2, 3)], [2], kind=128)
    (tmp_path / "n.las").write_bytes(b"nothing")
    for name in ("z.laz", "n.las"):
        with pytest.raises(ValueError):
            las.header(f"{tmp_path}/{name}")


def test_a_scan_feeds_the_spatial_join(spark, tmp_path):
    """From LAS files to counts and coverage of footprints, as from the tables."""
    folder = "/root/testdata/sf0.001"
    tables = spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("CAST(l_partkey AS DOUBLE) AS x", "l_quantity AS y", "round(l_extendedprice / 1000, 2) AS z", "CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 6 ELSE 1 END AS cls").collect()
    for i in range(2):
        las_file(tmp_path / f"{i}.las", [(r.x, r.y, r.z) for r in tables[i::2]], [r.cls for r in tables[i::2]])
    las.register(spark)
    cloud = spark.read.format("las").load(str(tmp_path)).selectExpr("x", "y", "z", "classification AS cls", "CAST(floor(x / 20) AS BIGINT) AS bucket")
    for name, columns in (("j1_points_in_polygons", ["fid", "cls", "points"]), ("a1_coverage_class", ["fid", "bld", "grd", "coverage"])):
        got = catalog.QUERIES[name](spark, folder, points=cloud).select(*columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, catalog.QUERIES[name](spark, folder).select(*columns).collect()))


def test_off_files(spark, tmp_path):
    write_off(catalog.QUERIES["s4_off_text"](spark, "/root/testdata/sf0.001"), f"{tmp_path}/off")
    (only,) = (tmp_path / "off/fid=3").glob("*.txt")
    lines = only.read_text().splitlines()
    assert lines[0] == "OFF" and lines[1] == "7 6 0" and len(lines) == 15 and lines[2].count(".") == 3 and lines[9].startswith("3 ")
