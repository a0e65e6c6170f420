"""Kernels on shapes whose answers are known: cube, gable roof, L, rings with holes, lines, grids, small graphs."""

import collections
import itertools
import time

import numpy as np
import pytest

from rooftide.kernels import arrangement, cuts, delaunay, lines, meshes, planes

SQUARE = np.array([[0.0, 0], [4, 0], [4, 4], [0, 4]])
L = np.array([[0.0, 0], [4, 0], [4, 2], [2, 2], [2, 4], [0, 4]])


def grid(n, step=1.0):
    return np.array([[i * step, j * step] for i in range(n) for j in range(n)], float)


def gable():
    xy = grid(20)
    return np.column_stack([xy, 10 - np.abs(xy[:, 0] - 9.5)])


def cube():
    v = np.array(list(itertools.product((0.0, 1.0), repeat=3)))
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    return np.concatenate([meshes.triangulated(v[list(q)]) for q in quads])


def test_a_gable_roof_has_two_planes():
    p = gable()
    label, found, wall = planes.grow(p)
    assert len(found) == 2 and not wall.any() and (label > 0).mean() > 0.85
    for plane in found.values():
        assert np.allclose(np.abs(plane[:3]), [np.sqrt(0.5), 0, np.sqrt(0.5)], atol=1e-6)
    assert set(planes.adjacency(p, label)) == {(2, 1)}
    ridge = planes.crossing(p[label == 1], found[1], p[label == 2], found[2])
    assert np.allclose(ridge[:, [0, 2]], [9.5, 10]) and np.allclose(sorted(ridge[:, 1]), [0, 19])
    assert planes.crossing(p, found[1], p, found[1]) is None and planes.crossing(p[:1], found[1], p, found[2]) is None
    assert planes.roof_type(found, label) == "slanted"


def test_planes_do_not_depend_on_shifts_and_need_points():
    p = gable()
    a, b = planes.grow(p), planes.grow(p + [1000.0, -50, 7])
    assert (a[0] == b[0]).all()
    for n in (0, 1, 2, 3, 20):
        assert planes.grow(p[:n])[1] == {}
    flat = np.column_stack([grid(8), np.zeros(64)])
    label, found, _ = planes.grow(flat)
    assert planes.roof_type(found, label) == "horizontal" and (label == 1).all()
    two = np.concatenate([flat, flat + [100, 0, 5]])
    label, found, _ = planes.grow(two)
    assert len(found) == 2 and planes.roof_type(found, label) == "multiple horizontal" and planes.adjacency(two, label) == {}
    assert planes.roof_type({}, np.zeros(3)) == "no planes" and planes.roof_type({}, np.zeros(0)) == "no points"
    wall = np.column_stack([grid(8)[:, 0], np.zeros(64), grid(8)[:, 1]])
    label, found, on_wall = planes.grow(wall)
    assert found == {} and on_wall.all() and (label == 0).all()


@pytest.mark.parametrize("n", [2, 3, 6])
def test_triangles_cover_the_hull_of_a_grid(n):
    p = grid(n)
    t = delaunay.delaunay(p)
    assert np.isclose(delaunay.doubled_area(p, t).sum() / 2, (n - 1) ** 2) and (delaunay.doubled_area(p, t) > 0).all()
    assert len(t) == 2 * (n - 1) ** 2


def test_circles_of_triangles_are_empty():
    p = np.random.default_rng(1).random((60, 2))
    t = delaunay.delaunay(p)
    centre, radius = delaunay.circles(p, t)
    assert (((p[None] - centre[:, None]) ** 2).sum(2) > radius[:, None] * (1 - 1e-5)).all()
    assert len(delaunay.delaunay(p[:2])) == 0 and len(delaunay.delaunay(np.column_stack([np.arange(5.0), np.arange(5.0)]))) == 0


def test_alpha_shapes_follow_an_l_and_its_hole():
    p = np.array([q for q in grid(9, 0.5).tolist() if not (q[0] > 2 and q[1] > 2)])
    t, alpha = delaunay.alpha_shape(p)
    found = delaunay.rings(p, t)
    # half a cell stands in the inner corner
    assert len(found) == 1 and np.isclose(arrangement.ring_area(p[found[0]]), 12.125) and np.isclose(alpha, 0.25)
    ring = np.array([q for q in grid(9).tolist() if not (2 < q[0] < 6 and 2 < q[1] < 6)])
    t, _ = delaunay.alpha_shape(ring, 1.0)
    areas = sorted(arrangement.ring_area(ring[r]) for r in delaunay.rings(ring, t))
    assert np.allclose(areas, [-14, 64])  # the hole less half a cell in each corner
    apart = np.concatenate([grid(3), grid(3) + 10])
    t, alpha = delaunay.alpha_shape(apart)
    assert delaunay.parts(t).max() == 0 and alpha > 1
    assert delaunay.parts(delaunay.alpha_shape(apart, 0.6, optimal=False)[0]).max() == 1


def test_the_largest_circle_of_a_square_and_around_points():
    centre, radius = delaunay.largest_circle(SQUARE, np.zeros((0, 2)), 0.25)
    assert np.allclose(centre, 2, atol=0.1) and np.isclose(radius, 2, atol=0.02)
    _, smaller = delaunay.largest_circle(SQUARE, np.array([[2.0, 2.0]]), 0.25)
    assert smaller < 1.3


def test_spikes_go_and_flat_surfaces_thin_out():
    p = np.column_stack([grid(6, 0.4), np.zeros(36)])
    p[14, 2] = 5
    kept, t = delaunay.without_spikes(p, 0.65)
    assert 14 not in kept and len(kept) == 35 and len(t)
    used, t = delaunay.thinned(gable(), 0.6)
    p = gable()
    assert len(used) < 60 and np.nanmax(np.abs(delaunay.height_in(p, t, p[:, :2]) - p[:, 2])) <= 0.6 + 1e-9
    assert len(delaunay.thinned(np.column_stack([grid(9), np.zeros(81)]), 0.1)[0]) == 4


def test_lines_of_a_square_ring_chain_to_its_corners():
    p = np.concatenate([a + (b - a) * np.linspace(0, 1, 13)[:-1, None] for a, b in zip(SQUARE, np.roll(SQUARE, -1, axis=0))])
    found = lines.detect(p, 0.1)
    assert len(found) == 4 and sum(map(len, found)) >= 40
    ring = lines.chained([lines.segment(p[m]) for m in found], 1.0)
    assert np.isclose(abs(arrangement.ring_area(ring)), 16, atol=0.2)
    assert lines.detect(p[:1]) == []


def test_lines_cluster_by_angle_then_place():
    s = np.array([[[0.0, 0], [4, 0]], [[0, 0.2], [4, 0.25]], [[0, 3], [4, 3]], [[0, 0], [0, 4]]])
    by_angle, by_place = lines.cluster(s)
    assert by_angle[0] == by_angle[1] == by_angle[2] != by_angle[3]
    assert by_place[0] == by_place[1] and len(set(by_place)) == 3
    out = lines.regularised(s, np.array([0, 2, 0, 1]))
    assert [x[1] for x in out] == [2, 0, 1] and np.isclose(np.hypot(*(out[1][0][1] - out[1][0][0])), 6)
    assert lines.regularised(np.zeros((0, 2, 2)), np.zeros(0)) == []


def test_rings_are_simplified_regularised_and_offset():
    ring = np.array([[0.0, 0], [2, 0.01], [4, 0], [4, 4], [0, 4]])
    assert len(lines.simplified(ring)) == 4 and len(lines.simplified(ring, 1e-9)) == 5
    tilted = np.array([[0.0, 0], [10, 0.3], [10.2, 6], [0.1, 6.2]])
    out = lines.contour(tilted)
    e = np.roll(out, -1, axis=0) - out
    assert len(out) == 4 and np.allclose((e * np.roll(e, -1, axis=0)).sum(1), 0, atol=1e-9)
    for n in (3, 4, 6, 9):
        a = 2 * np.pi * np.arange(n) / n
        grown = lines.offset(5 * np.stack([np.cos(a), np.sin(a)], axis=1), 1.0)
        assert np.allclose(np.hypot(*grown.T), 5 + 1 / np.cos(np.pi / n))


def test_lines_cut_a_square_and_areas_add_up():
    cross = np.array([[[-1.0, 2], [5, 2]], [[2, -1], [2, 5]]])
    arr = arrangement.from_lines(SQUARE, cross)
    assert len(arr.faces) == 4 and arr.in_footprint.all() and np.allclose([arr.area(f) for f in range(4)], 4)
    assert len(set(arr.edges.ravel())) - len(arr.edges) + len(arr.faces) == 1  # Euler, one component
    assert sorted(arr.pairs().values()) == [2, 2, 2, 2]
    assert np.isclose(sum(arr.area(f) for f in range(4)), 16)
    loose = arrangement.from_lines(SQUARE, np.array([[[1.0, 1], [2, 2]]]))
    assert len(loose.faces) == 1 and len(loose.edges) == 4
    split = arrangement.from_lines(L, np.array([[[-1.0, 1], [9, 1]]]))
    assert sorted(np.round([split.area(f) for f in range(len(split.faces))], 9)) == [4, 8]


def test_holes_belong_to_the_face_around_them():
    hole = np.array([[1.0, 1], [2, 1], [2, 2], [1, 2]])
    arr = arrangement.build(np.concatenate([arrangement.ring_segments(SQUARE), arrangement.ring_segments(hole)]))
    assert sorted(arr.area(f) for f in range(2)) == [1, 15]
    assert arrangement.locate(arr, np.array([[1.5, 1.5], [3, 3], [9, 9]])).tolist().count(-1) == 1
    bow = np.array([[0.0, 0], [2, 2], [2, 0], [0, 2]])
    assert len(arrangement.build(arrangement.ring_segments(bow)).faces) == 2


def test_unions_have_outer_rings_and_holes():
    found = arrangement.union([SQUARE, SQUARE + [2, 2]])
    assert len(found) == 1 and np.isclose(arrangement.ring_area(found[0]), 28)
    sides = [np.array([[0.0, 0], [6, 0], [6, 1], [0, 1]]), np.array([[0.0, 5], [6, 5], [6, 6], [0, 6]]), np.array([[0.0, 0], [1, 0], [1, 6], [0, 6]]), np.array([[5.0, 0], [6, 0], [6, 6], [5, 6]])]
    assert np.allclose(sorted(arrangement.ring_area(r) for r in arrangement.union(sides)), [-16, 36])


def test_snapping_keeps_faces_and_merges_close_vertices():
    arr = arrangement.from_lines(SQUARE, np.array([[[-1.0, 2], [5, 2.0004]], [[-1, 2.002], [5, 2.0024]]]))
    assert len(arr.faces) == 3
    rounded = arrangement.snap_rounded(arr, 0.5)
    assert len(rounded.faces) == 2 and rounded.in_footprint.all() and np.allclose([rounded.area(f) for f in range(2)], 8)
    merged = arrangement.merged_vertices(arr, 0.005)
    assert len(merged.faces) == 2 and np.isclose(sum(merged.area(f) for f in range(2)), 16)
    assert arrangement.carried(arr, merged, np.array([7, 8, 9])).min() > 0


def test_small_steps_dissolve_first():
    into = arrangement.dissolved_steps({1: 0.0, 2: 0.4, 3: 1.1, 4: 9.0}, {1: 1, 2: 1, 3: 1, 4: 1}, {(1, 2): 1.0, (2, 3): 1.0, (3, 4): 1.0})
    assert into == {1: 1, 2: 1, 3: 1, 4: 4}
    into = arrangement.dissolved_steps({1: 0.0, 2: 0.4, 3: 1.3}, {1: 9, 2: 1, 3: 1}, {(1, 2): 1.0, (2, 3): 1.0})
    assert into == {1: 1, 2: 1, 3: 3}  # after the first merge the mean is 0.04


def best_by_trial(data, pairs):
    n, labels = data.shape
    return min(cuts.energy(np.array(x), data, pairs) for x in itertools.product(range(labels), repeat=n))


@pytest.mark.parametrize("seed", range(6))
def test_two_labels_are_cut_at_the_optimum(seed):
    r = np.random.default_rng(seed)
    data = r.random((8, 2)) * 3
    pairs = {(int(a), int(b)): float(r.random() * 2) for a in range(8) for b in range(a + 1, 8) if r.random() < 0.5}
    assert np.isclose(cuts.energy(cuts.expanded(data, pairs), data, pairs), best_by_trial(data, pairs))


@pytest.mark.parametrize("seed", range(4))
def test_moves_never_raise_the_energy_and_end_near_the_optimum(seed):
    r = np.random.default_rng(10 + seed)
    data = r.random((6, 4)) * 3
    pairs = {(int(a), int(b)): float(r.random()) for a in range(6) for b in range(a + 1, 6) if r.random() < 0.6}
    got = cuts.energy(cuts.expanded(data, pairs), data, pairs)
    assert best_by_trial(data, pairs) - 1e-9 <= got <= min(cuts.energy(np.argmin(data, axis=1), data, pairs), 2 * best_by_trial(data, pairs)) + 1e-9


def test_solids_are_closed():
    arr = arrangement.from_lines(SQUARE, np.array([[[2.0, -1], [2, 5]]]))
    left = int(arrangement.locate(arr, np.array([[1.0, 1.0]]))[0])
    for own in ({0: [0, 0, 1, -3.0], 1: [0, 0, 1, -3.0]}, {left: [-1, 0, 1, -2.0], 1 - left: [1, 0, 1, -6.0]}, {left: [0, 0, 1, -3.0], 1 - left: [0, 0, 1, -5.0]}, {left: [0, -1, 1, -1.0], 1 - left: [0, 1, 1, -5.0]}):
        surfaces = arrangement.extruded(arr, {f: np.array(p, float) for f, p in own.items()}, 0.0)
        t = np.concatenate([meshes.triangulated(np.array(r)) for _, r in surfaces])
        assert np.isclose(meshes.volume(t) * 1.0, {3.0: 48.0}.get(-own[left][3] if own[left] == own[1 - left] else None, meshes.volume(t))) and meshes.volume(t) > 0
        assert np.allclose(np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]).sum(0), 0, atol=1e-9)  # closed: normals add up to nothing
    assert {label for label, _ in surfaces} == {0, 1, 2, 3}


def test_polygons_are_triangulated_whole():
    in_space = lambda r, z=0.0: np.column_stack([r, np.full(len(r), z)])
    area = lambda t: np.sqrt((np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]) ** 2).sum(1)).sum() / 2
    assert np.isclose(area(meshes.triangulated(in_space(L))), 12)
    holes = [in_space(SQUARE / 4 + [x, y]) for x, y in ((0.5, 0.5), (2.5, 2.5), (0.5, 2.5))]
    assert np.isclose(area(meshes.triangulated(in_space(SQUARE), holes)), 13)
    twice = np.concatenate([in_space(SQUARE)[:2], in_space(SQUARE)[1:]])
    assert np.isclose(area(meshes.triangulated(twice)), 16)
    assert len(meshes.triangulated(np.zeros((5, 3)))) == 0 and len(meshes.triangulated(in_space(SQUARE[:2]))) == 0
    assert np.isclose(abs(meshes.volume(cube())), 1) and np.allclose(meshes.newell(in_space(SQUARE)), [0, 0, 1])


def test_meshes_are_clipped_and_collapsed():
    t = cube()
    half = meshes.clipped(t, np.array([0.0, 0, 0]), np.array([0.5, 1, 1]))
    assert half[:, :, 0].max() == 0.5 and len(meshes.clipped(t, np.full(3, 5.0), np.full(3, 6.0))) == 0
    assert np.allclose(meshes.clipped(t, np.full(3, -1.0), np.full(3, 2.0)), t)
    assert np.allclose(np.sqrt((meshes.smooth_normals(t) ** 2).sum(2)), 1)
    p = np.column_stack([grid(9), np.zeros(81)])
    v, f = meshes.indexed(p[delaunay.delaunay(p[:, :2])])
    for shorter, faces in (meshes.shortened(v, f, 0.5), meshes.quadric(v, f, 0.25)):
        n = np.cross(shorter[faces[:, 1]] - shorter[faces[:, 0]], shorter[faces[:, 2]] - shorter[faces[:, 0]])
        assert len(faces) < len(f) and np.isclose(n[:, 2].sum() / 2, 64) and (n[:, 2] > 0).all()
    assert len(meshes.quadric(v, f, 0.25)[1]) <= round(0.25 * len(f)) + 1


def test_edges_of_three_triangles_are_split():
    v = np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1]])
    out, faces = meshes.manifold(v, np.array([[0, 1, 2], [1, 0, 3], [0, 1, 4]]))
    assert len(out) == 7 and max(meshes.edges_of(faces.tolist()).values()) == 2 and np.allclose(out[faces[2]], v[[0, 1, 4]])
    same, kept = meshes.manifold(v, np.array([[0, 1, 2], [1, 0, 3]]))
    assert len(same) == 5 and kept.tolist() == [[0, 1, 2], [1, 0, 3]]


def test_rings_nest():
    assert delaunay.nesting([SQUARE * 3, SQUARE * 2 + 1, SQUARE / 4 + 3, SQUARE + 50]) == [0, 1, 2, 0]


def test_neighbours_of_many_points_are_those_of_all_pairs_and_soon_found():
    r = np.random.default_rng(11)
    for p in (r.integers(0, 25, (500, 3)).astype(float), r.random((400, 2)) * [50, 1], np.column_stack([np.arange(300), np.zeros(300), r.random(300) * 99])):
        d = ((p[:, None] - p[None]) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        assert np.array_equal(planes.neighbours(p, 8), np.argsort(d, axis=1, kind="stable")[:, :8])
    began = time.time()
    planes.neighbours(r.random((20_000, 3)) * [1, 1, 0.01], 15)
    assert time.time() - began < 5


def test_triangulation_of_many_points_is_soon_done():
    r = np.random.default_rng(12)
    p, began = r.random((20_000, 2)), time.time()
    t = delaunay.delaunay(p)
    assert time.time() - began < 5
    assert abs(delaunay.doubled_area(p, t).sum() / 2 - 1) < 0.01 and len(np.unique(t)) == len(p)
    centre, radius = delaunay.circles(p, t[::500])
    assert all((((p - c) ** 2).sum(1) < s * (1 - 1e-3)).sum() == 0 for c, s in zip(centre, radius))


def test_rings_of_many_vertices_are_soon_simplified():
    a = np.linspace(0, 2 * np.pi, 1500, endpoint=False)
    began = time.time()
    kept = lines.simplified(np.stack([np.cos(a), np.sin(a)], axis=1) * 10)
    assert time.time() - began < 3 and 3 < len(kept) < 1500


def test_meshes_of_many_triangles_are_soon_thinned():
    p = np.column_stack([grid(80), np.sin(grid(80)[:, 0])])
    i = np.arange(79)[:, None] * 80 + np.arange(79)
    t = np.concatenate([np.stack([i, i + 80, i + 1], -1).reshape(-1, 3), np.stack([i + 1, i + 80, i + 81], -1).reshape(-1, 3)])
    began = time.time()
    v, f = meshes.quadric(p, t)
    assert time.time() - began < 9 and len(f) < 0.6 * len(t)
    assert abs(delaunay.doubled_area(v[:, :2], f).sum() / 2 - 79 * 79) < 5


def test_heights_of_many_places_are_soon_found():
    r = np.random.default_rng(13)
    p = np.column_stack([r.random((12_000, 2)), np.zeros(12_000)])
    p[:, 2] = 3 * p[:, 0] - p[:, 1]
    t, q = delaunay.delaunay(p[:, :2]), r.random((12_000, 2)) * 0.9 + 0.05
    began = time.time()
    z = delaunay.height_in(p, t, q)
    assert time.time() - began < 1.5 and np.allclose(z, 3 * q[:, 0] - q[:, 1])
    assert np.isnan(delaunay.height_in(p, t, np.array([[2.0, 2.0]]))).all()


def test_lines_grow_again_only_where_points_were_taken(monkeypatch):
    seeds = []
    monkeypatch.setattr(lines, "deque", lambda first: seeds.append(first[0]) or collections.deque(first))
    a = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    curve = np.stack([np.cos(a), np.sin(a)], axis=1) * 12
    assert not lines.detect(curve, threshold=0.05)
    assert len(seeds) == 40  # once from each point, whatever the least count


def test_clouds_are_triangulated_without_insertion(monkeypatch):
    r = np.random.default_rng(8)
    clouds = [grid(26), r.normal(size=(400, 2)) + [1e4, 2e4], grid(20)[r.random(400) < 0.8]]
    before = [delaunay._inserted(*_surrounded(p).T.tolist(), len(p)) for p in clouds]
    monkeypatch.setattr(delaunay, "_inserted", None)
    for p, t in zip(clouds, before, strict=True):
        q = _surrounded(p)
        now = delaunay._closed(q, delaunay._starred([q[:-3]])[0])
        assert len(now) == 2 * len(p) + 1 and {*map(tuple, now.tolist())} == {*map(tuple, t.tolist())}
        assert len(delaunay.delaunay(p)) > len(p)


def _surrounded(p):
    p = (p - p.mean(0)) / np.ptp(p, axis=0).max() + 1e-7 * np.random.default_rng(1).random(p.shape)
    return np.concatenate([p, [[-3e3, -2e3], [3e3, -2e3], [0.0, 4e3]]])


def test_lines_and_far_clumps_are_triangulated():
    for n in (7, 50, 200, 400):
        assert len(delaunay.delaunay(np.column_stack([np.arange(n), 2.0 * np.arange(n)]))) == 0
    # every two neighbours on a line make a triangle with a point off it
    assert len(delaunay.delaunay(np.append(np.column_stack([np.arange(200), 2.0 * np.arange(200)]), [[3.0, 9.0]], axis=0))) == 199
    for seed in range(8):
        r = np.random.default_rng(seed)
        p = np.concatenate([r.random((50, 2)) * 0.01 + r.random(2) * 100 for _ in range(20)])
        q = _surrounded(p)
        assert len(delaunay.delaunay(p)) and len(delaunay._closed(q, delaunay._starred([q[:-3]])[0])) == 2001


def test_planes_are_fitted_in_plain_numbers(monkeypatch):
    r, solve, asked = np.random.default_rng(2), np.linalg.eigh, []
    for wide in ([1e-6, 1, 2], [0.1, 1, 1], [1, 1.5, 3], [0, 1, 2], [0, 0, 1]):
        q = r.normal(size=(30, 3)) * wide @ np.linalg.qr(r.normal(size=(3, 3)))[0]
        m = (q - q.mean(0)).T @ (q - q.mean(0))
        axis, values = np.array(planes.flattest(*m[[0, 0, 0, 1, 1, 2], [0, 1, 2, 1, 2, 2]].tolist())), solve(m)[0]
        assert np.isclose(axis @ axis, 1) and axis[2] >= 0 and np.isclose(axis @ m @ axis, values[0], atol=1e-12 * values[2])
    monkeypatch.setattr(np.linalg, "eigh", lambda m: (asked.append(m.ndim), solve(m))[1])
    label, found, _ = planes.grow(gable())
    # one for each plane, and where the first points lie in a line; not one for every five points
    assert len(found) == 2 and (label > 0).mean() > 0.8 and asked.count(2) < 40


@pytest.mark.parametrize("k", [3, 8, 15])
def test_equal_distances_go_to_the_smaller_index(k, monkeypatch):
    p = np.column_stack([grid(14), np.round(np.random.default_rng(k).random(196))])[np.random.default_rng(4).permutation(196)]
    d = ((p[:, None] - p[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    widest, some = [0], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *x, **y: (widest.append(a.shape[-1] if a.ndim > 1 else 0), some(a, *x, **y))[1])
    near = planes.neighbours(p, k)
    monkeypatch.undo()
    assert (near == np.argsort(d, axis=1, kind="stable")[:, :k]).all()
    # rows are put in order up to little more than the k nearest
    assert max(widest) <= k + 12


def test_clouds_of_a_feature_are_triangulated_together(monkeypatch):
    r, turned, asked = np.random.default_rng(6), delaunay._turned, []
    clouds = [grid(12), r.random((300, 2)) * [1000, 40] + 5e5, grid(3), np.zeros((0, 2)), r.normal(size=(90, 2)), np.column_stack([np.arange(40.0), np.zeros(40)]), grid(2)[:2]]
    clouds.append(np.concatenate([r.random((150, 2)), r.random((150, 2)) * 0.01]))
    alone = [delaunay.delaunay(p) for p in clouds]
    monkeypatch.setattr(delaunay, "_turned", lambda *a: (asked.append(len(a[2])), turned(*a))[1])
    together = delaunay.triangulations(clouds)
    assert len(asked) <= 2 and [len(t) for t in together][2:6] == [8, 0, len(alone[4]), 0]
    assert all(np.array_equal(a, b) for a, b in zip(alone, together, strict=True))
    for p, t in zip(clouds, together):
        assert (np.sort(delaunay.alpha_shape(p, t=t)[0]) == np.sort(delaunay.alpha_shape(p)[0])).all()


def test_contours_cross_lines_in_plain_numbers(monkeypatch):
    way, hypot, asked = np.linspace(0, 2 * np.pi, 200, endpoint=False), np.hypot, []
    ring = np.column_stack([30 * np.cos(way), 20 * np.sin(way)]).round()
    ring = ring[(ring != np.roll(ring, 1, axis=0)).any(1)]
    monkeypatch.setattr(np, "hypot", lambda *a: (asked.append(1), hypot(*a))[1])
    out = lines.contour(ring)
    # one call for the lengths of all edges; none for each corner
    assert len(asked) <= 1 and abs(arrangement.ring_area(out) / arrangement.ring_area(ring) - 1) < 0.1
    assert lines.crossing(SQUARE[:2], SQUARE[2:]) is None and lines.crossing(SQUARE[[0, 2]], SQUARE[[1, 3]]).tolist() == [2, 2]


def test_planes_of_many_clouds_are_those_of_each():
    r = np.random.default_rng(3)
    clouds = [np.unique(np.floor(r.random((int(n), 3)) * [20, 15, 2]) + r.random(3) * 50, axis=0) for n in r.integers(5, 300, 30)] + [gable(), gable() + [900, -70, 3], np.zeros((0, 3))]
    params = planes.PlaneParams(plane_k=8, epsilon=0.4)
    for p, near in zip(clouds, planes.neighbourhoods(clouds, 8), strict=True):
        d = ((p[:, None] - p[None]) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        assert np.array_equal(near, np.argsort(d, axis=1, kind="stable")[:, : max(0, min(8, len(p) - 1))])
    for p, (label, found, wall) in zip(clouds, planes.grown(clouds, params), strict=True):
        alone = planes.grow(p, params)
        assert np.array_equal(label, alone[0]) and np.array_equal(wall, alone[2]) and found.keys() == alone[1].keys()
        assert all(np.allclose(found[i], alone[1][i], atol=1e-12) for i in found)


def test_shapes_of_many_clouds_are_those_of_each():
    r = np.random.default_rng(5)
    clouds = [np.argwhere(r.random((w, 9)) < 0.8).astype(float) + r.random(2) * 100 for w in range(1, 25)] + [r.random((200, 2)) * [1, 40], np.zeros((2, 2))]
    clouds = [p for p in clouds if len(p)]
    shapes = delaunay.triangulations(clouds)
    sizes = delaunay.radii(clouds, shapes)
    for p, t, *known in zip(clouds, shapes, sizes, delaunay.joins(shapes, sizes), strict=True):
        assert np.array_equal(t, delaunay.delaunay(p))
        if not len(t):
            continue
        # parts at each radius are the triangles less the joins up to there
        for at in np.quantile(known[0], [0, 0.3, 0.7, 1]):
            held = t[known[0] <= at]
            assert len(held) - (known[1] <= at).sum() == delaunay.parts(held).max() + 1
        assert np.array_equal(delaunay.alpha_shape(p, 0.6, t=t, known=known)[0], delaunay.alpha_shape(p, 0.6)[0])


def test_grids_inside_rings_are_those_of_their_places():
    r = np.random.default_rng(6)
    for _ in range(20):
        ring = np.round(r.random((9, 2)) * 6) / 2
        x, y = np.arange(-1, 4, 0.25), np.arange(-1, 4, 0.5)
        assert np.array_equal(delaunay.inside_grid(x, y, ring), delaunay.inside(*np.meshgrid(x, y), ring))
    assert not delaunay.inside_grid(x[:0], y, ring).size
