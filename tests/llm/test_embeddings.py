"""Nearest neighbours and near-duplicates of vectors, against brute force."""

import collections

import numpy as np
import pytest

from rooftide.llm import ann, itq

SCHEMA = "vec_id long, embedding array<double>"
CLASHING = "vec_id long, embedding array<double>, id long, v string, n int, score double, rank int, copies long"


def table(spark, x, more=()):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + list(more), SCHEMA)


def unit(x):
    x = np.asarray(x, float)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def links(x, threshold=0.95):
    u = unit(x)
    return (u @ u.T >= threshold).sum(1) - 1


def with_mean(common, n=900, pairs=300, dims=64, seed=5):
    """Unit vectors with a common direction, and partners of the first ones at cosine 0.952."""
    r = np.random.default_rng(seed)
    x = common * np.eye(dims)[0] + np.sqrt(1 - common**2) * unit(r.standard_normal((n, dims)))
    x = unit(x)
    g = r.standard_normal((pairs, dims))
    g = unit(g - (g * x[:pairs]).sum(1)[:, None] * x[:pairs])
    return np.concatenate([x, 0.952 * x[:pairs] + np.sqrt(1 - 0.952**2) * g])


def test_chunks_of_a_bucket_cover_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(itq, "BUCKET", 8)
    r = np.random.default_rng(1)
    x = np.concatenate([r.standard_normal((1, 16)) + 0.02 * r.standard_normal((40, 16)), r.standard_normal((60, 16))])
    odd = [(200, x[0].tolist()), (201, None), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, []), (205, [1.0, None])]
    got = {g.vec_id: g for g in itq.link(table(spark, x, odd)).collect()}
    want = links(np.concatenate([x, x[:1]]))
    assert [got[i].n_links for i in [*range(100), 200]] == want.tolist()
    assert all(got[i].component_id == (0 if want[i] else i) for i in range(100)) and got[200].component_id == 0
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in range(201, 206))


@pytest.mark.parametrize("common", [0.0, 0.7, 0.8, 0.9, 0.99])
def test_links_of_vectors_with_a_common_mean_are_found(spark, common):
    x = with_mean(common)
    got = {v.vec_id: v.n_links for v in itq.link(table(spark, x)).collect()}
    want = links(x)
    assert sum(got.values()) >= 0.99 * want.sum() and all(got[i] <= n for i, n in enumerate(want))


def test_vectors_of_every_length_link(spark):
    r = np.random.default_rng(9)
    a, b = r.standard_normal((5, 16)), r.standard_normal((3, 8))
    more = [*((10 + i, v) for i, v in enumerate(b.tolist())), (20, b[1].tolist()), (21, (b[2] * 2).tolist()), (22, a[0].tolist()), (23, [1.0])]
    got = {g.vec_id: (g.n_links, g.component_id) for g in itq.link(table(spark, a, more)).collect()}
    alone = {i: (0, i) for i in (1, 2, 3, 4, 10, 23)}
    assert got == alone | {0: (1, 0), 22: (1, 0), 11: (1, 11), 20: (1, 11), 12: (1, 12), 21: (1, 12)}


@pytest.mark.parametrize("size", [1e200, 1e-200])
def test_large_and_small_components_count(spark, size):
    x = with_mean(0.3, 40, 20, 12) * size
    got = {g.vec_id: g.n_links for g in itq.link(table(spark, x)).collect()}
    assert [got[i] for i in range(60)] == links(x).tolist()
    found = ann.search(table(spark, x), 50, 3).collect()
    u = unit(x)
    for g in found:
        assert abs(g.score - u[g.query_id] @ u[g.vec_id]) < 1e-12
    assert {(g.query_id, g["rank"], g.vec_id) for g in found} == {(q, r + 1, int(c)) for q in (0, 50) for r, c in enumerate(np.argsort(-np.where(np.arange(60) == q, -9, u @ u[q]), kind="stable")[:3])}


def test_nearest_rows_and_ties(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((300, 12))
    x[7] = x[9] = x[11] = x[0] * 1.0
    got = ann.search(table(spark, x, [(500, None), (501, [0.0] * 12)]), 50).orderBy("query_id", "rank").collect()
    by = collections.defaultdict(list)
    for g in got:
        by[g.query_id].append(g.vec_id)
    assert by[0][:3] == [7, 9, 11] and set(by) == {0, 50, 100, 150, 200, 250} and all(len(v) == 5 for v in by.values())
    u = unit(x)
    hits = sum(len(set(np.argsort(-np.where(np.arange(300) == q, -9, u @ u[q]))[:5]) & set(by[q])) for q in by)
    assert hits >= 0.9 * 30


@pytest.mark.parametrize("rows", [1, 2, 4, 6])
def test_few_rows_give_all_candidates(spark, rows):
    x = np.random.default_rng(4).standard_normal((rows, 64))
    got = ann.search(table(spark, x).repartition(2), 1)
    assert {(g.query_id, g.vec_id) for g in got.collect()} == {(i, j) for i in range(rows) for j in range(rows) if i != j}


@pytest.mark.parametrize(("dims", "common"), [(64, 0.0), (64, 0.8), (256, 0.0)])
def test_recall_against_brute_force(spark, dims, common):
    x = with_mean(common, 3000, 500, dims)
    trace = {}
    got = collections.defaultdict(set)
    for g in ann.search(table(spark, x), 50, trace=trace).collect():
        got[g.query_id].add(g.vec_id)
    u = unit(x)
    hits = sum(len(got[q] & set(np.argsort(-np.where(np.arange(len(x)) == q, -9, u @ u[q]))[:5].tolist())) for q in range(0, len(x), 50))
    assert hits >= 0.9 * 5 * 70 and trace[dims][0] >= 1


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    x = with_mean(0.5, 900, 100, 16)
    want = {tuple(r) for r in ann.search(table(spark, x), 1).select("query_id", "vec_id", "rank").collect()}
    monkeypatch.setattr(ann, "BLOCK", 256 * 16)
    assert {tuple(r) for r in ann.search(table(spark, x), 1).select("query_id", "vec_id", "rank").collect()} == want


def test_odd_tables(spark):
    none = spark.createDataFrame([], CLASHING)
    assert ann.search(none, 50).count() == 0 and itq.link(none).count() == 0
    a, b = [1.0, 0.0, 0.5], [0.0, 1.0, 0.0]
    rows = [(0, a), (0, a), (1, a), (2, b), (None, a), (50, None), (100, b)]
    odd = spark.createDataFrame([(i, v, 7, "x", 1, 0.5, 3, 9) for i, v in rows], CLASHING)
    got = sorted((g.vec_id if g.vec_id is not None else -1, g.n_links, g.component_id, g.kept) for g in itq.link(odd).collect())
    # repeated rows are vectors of their own, rows without an id link with nothing
    assert got == [(-1, 0, None, False), (0, 2, 0, True), (0, 2, 0, True), (1, 2, 0, False), (2, 1, 2, True), (50, 0, 50, True), (100, 1, 2, False)]
    found = {(g.query_id, g["rank"], g.vec_id) for g in ann.search(odd, 50).collect()}
    assert found == {(0, 1, 1), (0, 2, 2), (0, 3, 100), (100, 1, 2), (100, 2, 0), (100, 3, 1)}
