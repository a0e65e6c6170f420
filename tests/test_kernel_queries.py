"""Kernel queries over the fixture: every feature has rows, and neither the order nor the partitions of rows matter."""

import math

import pytest

from rooftide.plans import kernels
from rooftide.plans.dialects import read
from rooftide.plans.fixtures import with_views

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    return {name: kernels.QUERIES[name](spark, FOLDER).collect() for name in kernels.QUERIES}


@pytest.mark.parametrize("name", sorted(kernels.QUERIES))
def test_rows_are_whole(results, name):
    rows = results[name]
    assert rows and not any((v is None and name != "r2_surface_raster") or (isinstance(v, float) and not math.isfinite(v)) for r in rows for v in r)
    assert len({r.fid for r in rows}) >= (9 if name != "x7_step_dissolve" else 1)


def test_energies_and_volumes_make_sense(results):
    assert all(r.energy <= r.energy_before + 1e-4 for r in results["x4_alpha_expansion"])
    assert all(r.volume > 0 for r in results["m5_triangulate_solid"])
    area = {}
    for r in results["x1_arrangement_from_lines"]:
        area[r.fid] = area.get(r.fid, 0) + r.area * r.in_footprint
    assert len({round(a, 2) for a in area.values()}) == 1  # faces add up to the footprint, which is alike everywhere
    kept = {r.fid: r.kept for r in results["r6_filter_25d"]}
    assert all(0 < k <= r.points for r in results["r6_filter_25d"] for k in [kept[r.fid]])


@pytest.mark.parametrize("name", ["g1_detect_planes", "x4_alpha_expansion", "g5_regularise_lines", "x16_arrangement_extruder"])
def test_order_and_partitions_do_not_matter(spark, results, name):
    inputs, kernel, schema = kernels.KERNELS[name]
    kernels.QUERIES[name](spark, FOLDER)  # names the tables
    parts = [spark.sql(read(with_views(sql), "spark")) for sql in inputs]
    rows = parts[0].selectExpr("CAST(fid AS BIGINT) AS fid", "CAST(kind AS INT) AS kind", *(f"CAST({c} AS DOUBLE) AS {c}" if c in parts[0].columns else f"CAST(NULL AS DOUBLE) AS {c}" for c in kernels.PLACES))
    for p in parts[1:]:
        rows = rows.unionByName(p.selectExpr("CAST(fid AS BIGINT) AS fid", "CAST(kind AS INT) AS kind", *(f"CAST({c} AS DOUBLE) AS {c}" if c in p.columns else f"CAST(NULL AS DOUBLE) AS {c}" for c in kernels.PLACES)))
    again = kernels.run(rows.orderBy("c", "b").repartition(7), kernel, schema).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, results[name]))


def test_no_rows_give_no_rows(spark):
    empty = spark.createDataFrame([], "fid long, kind int, " + ", ".join(f"{c} double" for c in kernels.PLACES))
    for _, kernel, schema in kernels.KERNELS.values():
        assert kernels.run(empty, kernel, schema).columns[0] == "fid"
    assert kernels.run(empty, kernels.detect_planes, kernels.KERNELS["g1_detect_planes"][2]).count() == 0


def test_rows_hold_only_what_kernels_take(spark, monkeypatch):
    monkeypatch.setattr(kernels, "run", lambda rows, *_: rows)
    shipped = lambda name: kernels.query(name)(spark, FOLDER).columns
    assert shipped("g8_alpha_shape") == shipped("m4_max_inscribed_circle") == ["fid", "kind", "a", "b", "c"]
    assert shipped("g5_regularise_lines") == ["fid", "kind", *"abcdef"] and shipped("m6_mesh_clipper") == ["fid", "kind", *kernels.PLACES]


def test_corners_give_the_cells_of_the_sql(spark):
    kernels.QUERIES["g1_detect_planes"](spark, FOLDER)
    rows = lambda sql: spark.sql(read(with_views(sql), "spark")).selectExpr("CAST(fid AS BIGINT) AS fid", "CAST(kind AS INT) AS kind", *(f"CAST({c} AS DOUBLE) AS {c}" for c in "abc"))
    one = lambda sql: sorted(kernels.run(rows(sql), lambda f: [dict(zip("abc", map(float, p))) for p in f.cloud], "a double, b double, c double").collect())
    cells, corners = rows(kernels.CLOUD), rows(kernels.CORNERS)
    assert one(kernels.CORNERS) == one(kernels.CLOUD) == sorted(cells.drop("kind").collect())
    assert corners.count() * 30 < cells.count()


def test_features_are_whole_over_batches_of_rows(spark):
    # one feature of many batches between small ones, and rows without a feature
    rows = spark.range(60_000).selectExpr("CASE WHEN id < 50000 THEN 5 WHEN id < 50003 THEN NULL ELSE id % 700 + 10 END AS fid", "0 AS kind", "CAST(id AS DOUBLE) AS a", "0e0 AS b", "0e0 AS c")
    count = kernels.run(rows, lambda f: [{"n": len(f.cloud), "s": float(f.cloud[:, 0].sum())}], "n long, s double").collect()
    want = rows.groupBy("fid").agg({"kind": "count", "a": "sum"}).selectExpr("fid", "`count(kind)` AS n", "`sum(a)` AS s").collect()
    assert sorted(map(repr, count)) == sorted(map(repr, want)) and len(count) == 702
