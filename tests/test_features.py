"""Queries whose plans bring a feature's rows to one kernel: same rows as the SQL, and no more of them shuffled than there are points."""

import duckdb
import numpy as np
import pytest

from rooftide.kernels import nearby
from rooftide.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [1 << 20, 64])
def test_adjacency_by_strips_is_that_of_all_pairs(monkeypatch, most):
    monkeypatch.setattr(nearby, "MOST", most)
    r = np.random.default_rng(3)
    p, label = np.unique(np.column_stack([r.integers(0, 60, (400, 2)), r.integers(0, 3, 400)]).astype(float), axis=0), None
    label = r.integers(0, 4, len(p))
    want = {}
    for i in range(len(p)):
        if label[i]:
            d = ((p - p[i]) ** 2).sum(1)
            for j in [j for j in np.lexsort((label, p[:, 2], p[:, 1], p[:, 0], d)) if j != i][:15]:
                if label[j] not in (0, label[i]):
                    key = (max(label[i], label[j]), min(label[i], label[j]))
                    want[key] = want.get(key, 0) + 1
    assert nearby.adjacency(p, label) == want
    assert nearby.adjacency(p[:4], np.array([0, 1, 1, 2])) == {(2, 1): 4}


def test_plane_adjacency_makes_no_pairs_of_rows(spark):
    plan = plan_of(catalog.QUERIES["j6_plane_adjacency"](spark, FOLDER))
    assert "FlatMapGroupsInArrow" in plan and "Window" not in plan and "Join" not in plan


def test_plane_segments_take_their_pairs_from_the_kernel(spark):
    plan = plan_of(catalog.QUERIES["j4_plane_segments"](spark, FOLDER))
    assert "FlatMapGroupsInArrow" in plan and "Window" not in plan


def test_raster_is_filled_without_a_row_for_each_cell_of_a_window(spark):
    plan = plan_of(catalog.QUERIES["r3_filled_raster"](spark, FOLDER))
    assert "FlatMapGroupsInArrow" in plan


def test_windows_take_the_least_of_written_cells():
    r = np.random.default_rng(5)
    cells = np.unique(r.integers(-3, 30, (60, 2)), axis=0)
    z = r.random(len(cells))
    got = {(c, w): (h, e) for c, w, h, e in zip(*(a.tolist() for a in nearby.window_least(*cells.T, z)), strict=True)}
    own = {tuple(c): h for c, h in zip(cells.tolist(), z.tolist(), strict=True)}
    want = {}
    for c in range(cells[:, 0].max() + 1):
        for w in range(cells[:, 1].max() + 1):
            near = [h for (a, b), h in own.items() if c - 5 <= a <= c + 4 and w - 5 <= b <= w + 4]
            if near:
                want[c, w] = (own.get((c, w), min(near)), (c, w) not in own)
    assert got == want


def test_points_between_two_triangles_go_where_duckdb_has_them(spark, tmp_path):
    db = duckdb.connect()
    db.execute("CREATE TABLE supplier AS SELECT CAST(unnest([569, 656]) AS BIGINT) AS s_suppkey, 'a' AS s_name, 1.0e0 AS s_acctbal")
    db.execute("""CREATE TABLE lineitem AS SELECT CAST(k AS BIGINT) AS l_orderkey, 1 AS l_linenumber, CAST(k AS BIGINT) AS l_partkey, CAST(1 AS BIGINT) AS l_suppkey, CAST(q AS DOUBLE) AS l_quantity,
      CAST(p AS DOUBLE) AS l_extendedprice, 'N' AS l_returnflag FROM (VALUES (11384, 9, 50694.34), (13135, 39, 90612.5), (11384, 30, 20000)) AS t(k, q, p)""")
    db.execute("CREATE TABLE part AS SELECT CAST(1 AS BIGINT) AS p_partkey")
    for t in ("supplier", "lineitem", "part"):
        db.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got = catalog.QUERIES["j8_mesh_quality"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(db.execute(catalog.oracle()["j8_mesh_quality"]).fetchall())


@pytest.mark.parametrize("most", [1 << 20, 64])
def test_nearest_by_strips_is_the_nearest_of_all(monkeypatch, most):
    monkeypatch.setattr(nearby, "MOST", most)
    r = np.random.default_rng(4)
    p, q = r.random((300, 3)) * 90, r.random((70, 3)) * [20, 90, 90]
    assert np.array_equal(nearby.nearest_squared(p, q), [min(float((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) for b in q) for a in p])


def test_nearest_distance_makes_no_pairs_of_rows(spark):
    plan = plan_of(catalog.QUERIES["j7_nearest_distance"](spark, FOLDER))
    assert "FlatMapGroupsInArrow" in plan and "Join" not in plan


def test_clusters_hang_together_over_long_chains():
    p = np.column_stack([np.arange(500) * 3.9, np.zeros(500), np.zeros(500)])
    p[250:, 0] += 1
    assert nearby.clusters(p, 4.0).tolist() == [0] * 250 + [250] * 250


def test_clusters_are_those_of_a_plain_walk():
    r = np.random.default_rng(6)
    for _ in range(20):
        p = r.random((150, 3)) * 30
        p = p[np.argsort(p[:, 0])]
        near = ((p[:, None] - p[None]) ** 2).sum(2) <= 16
        want = np.arange(150)
        while (least := np.where(near, want[None], 150).min(1)).tolist() != want.tolist():
            want = least
        assert nearby.clusters(p, 4.0).tolist() == want.tolist()


def test_clusters_in_space_need_no_table_of_links(spark):
    assert "FlatMapGroupsInArrow" in plan_of(catalog.QUERIES["g2_cluster_points_3d"](spark, FOLDER))
