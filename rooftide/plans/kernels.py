"""Queries that run geometry kernels over all features, one feature at a time.

Rows are dealt out and sorted by ``fid``, and a partition's features go through
the kernels in batches; these are clouds cropped to one building and its
outline, so a feature stays small however many buildings there are. What the kernels return depends on the feature alone,
not on the order of its rows: they are sorted first.

The inputs come from the star-schema tables through the same views as the SQL
queries. ``CLOUD`` is the roof of each feature as points a cell apart, ``RING``
its outline. A query ships the ``CORNERS`` of the roof's triangles in place of
``CLOUD``, as these are 18 rows for some 700, and cuts them into its cells. SQL has no form of these kernels; tests hold them against shapes
with known answers.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rooftide.kernels import arrangement, cells, cuts, delaunay, lines, meshes, planes
from rooftide.plans.dialects import read
from rooftide.plans.fixtures import TABLES, with_views
from rooftide.plans.surfaces import ROOF_CELLS

#: Kind of the first corner of the roof's first triangle.
FIRST = 16
CLOUD = f"WITH {ROOF_CELLS} SELECT fid, 0 AS kind, CAST(col AS DOUBLE) AS a, CAST(row_ AS DOUBLE) AS b, max(z) AS c FROM cells GROUP BY fid, col, row_"
CORNERS = " UNION ALL ".join(f"SELECT t.fid, {FIRST} + 3 * t.tri_id + {k} AS kind, t.x{k} - f.x0 + 0.5e0 AS a, t.y{k} - f.y0 + 0.5e0 AS b, t.z{k} AS c FROM triangles t JOIN footprints f ON t.fid = f.fid" for k in range(3))
RING = "SELECT e.fid, 1 AS kind, CAST(e.i AS DOUBLE) AS a, e.ax - f.x0 + 0.5e0 AS b, e.ay - f.y0 + 0.5e0 AS c FROM ring_edges e JOIN footprints f ON e.fid = f.fid"
SEGMENTS = "SELECT fid, 2 AS kind, sid AS a, x0 AS b, y0 AS c, x1 AS d, y1 AS e, CAST(priority AS DOUBLE) AS f FROM segments"
TRIANGLES = "SELECT t.fid, 3 AS kind, CAST(tri_id AS DOUBLE) AS a, t.x0 AS b, t.y0 AS c, z0 AS d, t.x1 AS e, t.y1 AS f, z1 AS g, x2 AS h, y2 AS i, z2 AS j FROM triangles t"
FACES = "SELECT fid, 4 AS kind, CAST(face AS DOUBLE) AS a, elevation_50p AS b, CAST(pixel_count AS DOUBLE) AS c FROM arr_face WHERE in_footprint"
TWINS = "SELECT f.fid, 5 AS kind, CAST(h.face AS DOUBLE) AS a, CAST(h.twin_face AS DOUBLE) AS b, h.len AS c FROM arr_halfedge h JOIN arr_face f ON h.face = f.face JOIN arr_face g ON h.twin_face = g.face WHERE f.in_footprint AND g.in_footprint AND h.face < h.twin_face"
PLACES = "abcdefghij"


PLANES = planes.PlaneParams(plane_k=8, epsilon=0.4)


class Feature:
    """One feature's rows by kind, sorted, and the chain from its cloud to faces with planes.

    What many features need is found for all that stand ``beside`` it, this one included, once any asks for it.
    """

    def __init__(self, rows: np.ndarray):
        order = np.lexsort(rows.T[::-1])
        self.rows = rows[order]
        self.beside = [self]

    def share(self, name: str, found: list):
        for f, x in zip(self.beside, found, strict=True):
            f.__dict__[name] = x
        return self.__dict__[name]

    def kind(self, kind: int, width: int) -> np.ndarray:
        return self.rows[np.searchsorted(self.rows[:, 0], kind, "left") : np.searchsorted(self.rows[:, 0], kind, "right"), 1 : 1 + width]

    @property
    def cloud(self) -> np.ndarray:
        return self.kind(0, 3)

    @property
    def ring(self) -> np.ndarray:
        return self.kind(1, 3)[:, 1:]

    @property
    def triangles(self) -> np.ndarray:
        return self.kind(3, 10)[:, 1:].reshape(-1, 3, 3)

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = self.kind(2, 6)
        return s[:, 0].astype(np.int64), s[:, 1:5].reshape(-1, 2, 2), s[:, 5].astype(np.int64)

    @cached_property
    def near(self) -> np.ndarray:
        return self.share("near", planes.neighbourhoods([f.cloud for f in self.beside], 15))

    @cached_property
    def grown(self) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
        return self.share("grown", planes.grown([f.cloud for f in self.beside], PLANES, [f.near for f in self.beside] if "near" in self.__dict__ else None))

    @cached_property
    def outlines(self) -> list[tuple[int, np.ndarray]]:
        """Plane and ring of each boundary of the planes' alpha shapes."""
        named, clouds = [], []
        for i, f in enumerate(self.beside):
            (label, found, _), cloud = f.grown, f.cloud[:, :2]
            named += [(i, plane) for plane in found]
            clouds += [cloud[label == plane] for plane in found]
        shapes = delaunay.triangulations(clouds)
        radii = delaunay.radii(clouds, shapes)
        joined = delaunay.joins(shapes, radii)
        out: list[list[tuple[int, np.ndarray]]] = [[] for _ in self.beside]
        for (i, plane), p, t, *known in zip(named, clouds, shapes, radii, joined, strict=True):
            t, _ = delaunay.alpha_shape(p, 0.6, t=t, known=known)
            out[i] += [(plane, p[r]) for r in delaunay.rings(p, t)]
        return self.share("outlines", out)

    def ring_lines(self) -> list[tuple[int, int, np.ndarray, int]]:
        """Plane, ring, segment and points of the lines along the outlines."""
        return [(plane, i, lines.segment(ring[m]), len(m)) for i, (plane, ring) in enumerate(self.outlines) for m in lines.detect(ring)]

    def intersections(self) -> list[np.ndarray]:
        """Where adjacent planes cross, as far as both have points beside the line."""
        near = self.near  # before the planes, which need fewer
        label, found, _ = self.grown
        out = []
        for (hi, lo), count in planes.adjacency(self.cloud, label, near=near).items():
            s = planes.crossing(self.cloud[label == hi], found[hi], self.cloud[label == lo], found[lo]) if count >= 5 else None
            if s is not None:
                out.append(s[:, :2])
        return out

    def arranged(self) -> arrangement.Arrangement:
        """The outline cut by regularised lines of its planes' outlines and crossings, which come first."""
        cross = self.intersections()
        found = [s for _, _, s, _ in self.ring_lines()]
        kept = lines.regularised(np.array(found + cross).reshape(-1, 2, 2), np.array([0] * len(found) + [2] * len(cross)), extension=3.0)
        return arrangement.from_lines(self.ring, np.array([s for s, _, _ in kept]).reshape(-1, 2, 2))

    def costs(self, arr: arrangement.Arrangement) -> tuple[list[int], np.ndarray]:
        """Faces of the footprint, and for each the error of its points to each plane: root mean squares, 0 without points, by their largest."""
        _, found, _ = self.grown
        faces = [f for f in range(len(arr.faces)) if arr.in_footprint[f]]
        at = arrangement.locate(arr, self.cloud[:, :2])
        out = np.zeros((len(faces), len(found)))
        for i, f in enumerate(faces):
            p = self.cloud[at == f]
            for j, (a, b, c, d) in enumerate(found.values()):
                out[i, j] = np.sqrt(np.mean((p[:, 2] + (a * p[:, 0] + b * p[:, 1] + d) / c) ** 2)) if len(p) else 0.0
        return faces, out / max(out.max(initial=0), 1e-300)

    def labelled(self) -> tuple[arrangement.Arrangement, list[int], np.ndarray, float, float]:
        """Arrangement, its faces, their planes by least energy, and the energy of the nearest planes and of these."""
        arr = self.arranged()
        faces, data = self.costs(arr)
        place = {f: i for i, f in enumerate(faces)}
        pairs = {(place[a], place[b]): w for (a, b), w in arr.pairs().items() if a in place and b in place}
        most = max(pairs.values(), default=1.0)
        pairs = {k: 2 * w / most for k, w in pairs.items()}
        if not data.size:
            return arr, faces, np.zeros(len(faces), np.int64), 0.0, 0.0
        label = cuts.expanded(50 * data, pairs)
        return arr, faces, label, cuts.energy(np.argmin(data, axis=1), 50 * data, pairs), cuts.energy(label, 50 * data, pairs)

    def solid(self) -> list[tuple[int, list[tuple[float, float, float]]]]:
        arr, faces, label, _, _ = self.labelled()
        found = list(self.grown[1].values())
        return arrangement.extruded(arr, {f: found[i] for f, i in zip(faces, label, strict=True)} if found else {}, 0.0)


#: Features and rows in one batch at most, and rows below which more are waited for.
TOGETHER, MOST, LEAST = 256, 1 << 17, 4608


def featured(rows: list[np.ndarray]) -> list[Feature]:
    """Features of these rows; corners of roofs become clouds, all at once."""
    t, owner, plain = [], [], []
    for i, r in enumerate(rows):
        roof = r[:, 0] >= FIRST
        if roof.any():
            corners = np.unique(r[roof, :4], axis=0)
            t.append(corners[:, 1:].reshape(-1, 3, 3))
            owner += [i] * len(t[-1])
        plain.append(r[~roof])
    if t:
        cloud, own = cells.highest(np.concatenate(t), np.array(owner))
        width = rows[0].shape[1]
        cloud = np.column_stack([np.zeros(len(cloud)), cloud, np.zeros((len(cloud), width - 4))])
        at = np.searchsorted(own, np.arange(len(rows) + 1))
        plain = [np.concatenate([cloud[a:b], p]) for p, a, b in zip(plain, at, at[1:])]
    features = [Feature(p) for p in plain]
    for f in features:
        f.beside = features
    return features


def _n(x: float) -> float:
    """Rounded half up to four places."""
    return float(np.floor(x * 1e4 + 0.5) / 1e4)


def ringed(rings: list[np.ndarray], name: str = "ring") -> list[dict]:
    return [{name: i, "i": k, "x": _n(p[0]), "y": _n(p[1])} for i, ring in enumerate(rings) for k, p in enumerate(ring)]


def corners(t: np.ndarray, normals: np.ndarray | None = None) -> list[dict]:
    return [
        {"tri": i, "k": k, "x": _n(t[i, k, 0]), "y": _n(t[i, k, 1]), "z": _n(t[i, k, 2])} | ({} if normals is None else {c: _n(v) for c, v in zip(("nx", "ny", "nz"), normals[i, k])})
        for i in range(len(t)) for k in range(3)
    ]


def faces_of(arr: arrangement.Arrangement) -> list[dict]:
    return [{"face": f, "area": _n(arr.area(f)), "vertices": sum(map(len, arr.faces[f])), "in_footprint": bool(arr.in_footprint[f])} for f in range(len(arr.faces))]


def detect_planes(f: Feature) -> list[dict]:
    label, found, wall = f.grown
    level = [i for i, p in found.items() if p[2] > 0.97]
    return [
        {"plane_id": i, "a": _n(p[0]), "b": _n(p[1]), "c": _n(p[2]), "d": _n(p[3]), "points": int((label == i).sum()), "is_horizontal": i in level, "unsegmented": int((label == 0).sum()), "wall_points": int(wall.sum()), "roof_type": planes.roof_type(found, label)}
        for i, p in found.items()
    ]


def regularised_lines(f: Feature) -> list[dict]:
    sid, s, priority = f.segments()
    return [{"line": i, "x0": _n(x[0, 0]), "y0": _n(x[0, 1]), "x1": _n(x[1, 0]), "y1": _n(x[1, 1]), "priority": p, "angle_cluster": a} for i, (x, p, a) in enumerate(lines.regularised(s, priority))]


def clustered_lines(f: Feature) -> list[dict]:
    sid, s, _ = f.segments()
    by_angle, by_place = lines.cluster(s)
    return [{"sid": int(i), "angle_cluster": int(a), "cluster": int(c)} for i, a, c in zip(sid, by_angle, by_place, strict=True)]


def label_faces(f: Feature) -> list[dict]:
    arr, faces, label, before, after = f.labelled()
    return [{"face": x, "plane": int(i), "area": _n(arr.area(x)), "energy_before": _n(before), "energy": _n(after)} for x, i in zip(faces, label, strict=True)]


def point_costs(f: Feature) -> list[dict]:
    faces, cost = f.costs(f.arranged())
    return [{"face": x, "plane": j, "cost": _n(c)} for x, row in zip(faces, cost, strict=True) for j, c in enumerate(row)]


def dissolve_steps(f: Feature) -> list[dict]:
    rows, twins = f.kind(4, 3), f.kind(5, 3)
    height, pixels = ({int(r[0]): v(r) for r in rows} for v in (lambda r: float(r[1]), lambda r: int(r[2])))
    into = arrangement.dissolved_steps(height, pixels, {(int(a), int(b)): w for a, b, w in twins})
    return [{"face": a, "into": b} for a, b in into.items()]


def snapped(f: Feature) -> list[dict]:
    return faces_of(arrangement.snap_rounded(f.arranged(), 0.001))


def tri_snapped(f: Feature) -> list[dict]:
    return faces_of(arrangement.merged_vertices(f.arranged(), 0.005))


def extrude(f: Feature) -> list[dict]:
    return [{"surface": i, "label": label, "ring": json.dumps([[_n(c) for c in p] for p in ring])} for i, (label, ring) in enumerate(f.solid())]


def triangulate(f: Feature) -> list[dict]:
    t = [meshes.triangulated(np.array(ring)) for _, ring in f.solid()]
    whole = np.concatenate(t) if t else np.zeros((0, 3, 3))
    return [{"triangles": len(whole), "volume": _n(meshes.volume(whole)), "area": _n(np.sqrt((np.cross(whole[:, 1] - whole[:, 0], whole[:, 2] - whole[:, 0]) ** 2).sum(1)).sum() / 2)}]


def clip_mesh(f: Feature) -> list[dict]:
    t = f.triangles
    if not len(t):
        return []
    low, high = t.reshape(-1, 3).min(0), t.reshape(-1, 3).max(0)
    out = meshes.clipped(t, low, np.array([(low[0] + high[0]) / 2 + 1, high[1], high[2]]))
    return corners(out, meshes.smooth_normals(out))


def shorten_mesh(f: Feature) -> list[dict]:
    v, t = meshes.shortened(*meshes.indexed(surface(f)))
    return corners(v[t])


def quadric_mesh(f: Feature) -> list[dict]:
    v, t = meshes.quadric(*meshes.indexed(surface(f)))
    return corners(v[t])


def surface(f: Feature) -> np.ndarray:
    return f.cloud[delaunay.delaunay(f.cloud[:, :2])]


def thin_mesh(f: Feature) -> list[dict]:
    used, t = delaunay.thinned(f.cloud, 0.5)
    return corners(f.cloud[t])


def filter_surface(f: Feature) -> list[dict]:
    kept, t = delaunay.without_spikes(f.cloud, 1.6)
    return [{"points": len(f.cloud), "kept": len(kept), "triangles": len(t)}]


def largest_circle(f: Feature) -> list[dict]:
    centre, radius = delaunay.largest_circle(f.ring, f.cloud[::7, :2])
    return [{"x": _n(centre[0]), "y": _n(centre[1]), "diameter": _n(2 * radius)}]


def union_outlines(f: Feature) -> list[dict]:
    return ringed(arrangement.union([f.ring, f.ring + [9, 4]]))


def fit_plane(f: Feature) -> list[dict]:
    a, b, c, d = planes.least_squares(f.cloud)
    return [{"a": _n(a), "b": _n(b), "c": _n(c), "d": _n(d), "rmse": _n(np.sqrt(np.mean((f.cloud @ [a, b, c] + d) ** 2)))}]


def floor_rank(z: np.ndarray, share: float) -> float:
    return float(np.sort(z)[int(np.floor(share * (len(z) - 1)))])


def roof_parts(f: Feature, cell: float = 0.5) -> list[dict]:
    """Heights of each outline's plane over its cells (its corners, if it holds no cell's centre), slope and azimuth."""
    out = []
    for i, (plane, ring) in enumerate(f.outlines):
        a, b, c, d = f.grown[1][plane]
        x, y = (np.arange(lo, hi, cell) + cell / 2 for lo, hi in zip(ring.min(0), ring.max(0)))
        row, col = np.nonzero(delaunay.inside_grid(x, y, ring))
        at = np.stack([x[col], y[row]], axis=1) if len(row) else ring
        z = -(a * at[:, 0] + b * at[:, 1] + d) / c
        out.append({"plane": plane, "ring": i, "h_min": _n(z.min()), "h_max": _n(z.max()), "h_50p": _n(floor_rank(z, 0.5)), "h_70p": _n(floor_rank(z, 0.7)),
                    "slope": _n(np.degrees(np.arccos(min(c, 1.0)))), "azimuth": _n(np.degrees(np.arctan2(a, b)) % 360)})
    return out


def located(f: Feature) -> list[dict]:
    arr = f.arranged()
    at = arrangement.locate(arr, f.cloud[:, :2])
    return [{"face": x, "points": int((at == x).sum()), "z_max": _n(f.cloud[at == x, 2].max())} for x in range(-1, len(arr.faces)) if (at == x).any()]


def surface_raster(f: Feature, cell: float = 1.0) -> list[dict]:
    """Cells of the outline's box: outside it the lowest height, inside the surface over every third point, or null beyond that."""
    low, high = f.ring.min(0) - cell, f.ring.max(0) + cell
    x, y = (g.ravel() for g in np.meshgrid(np.arange(int((high[0] - low[0]) / cell + 1)), np.arange(int((high[1] - low[1]) / cell + 1))))
    at = low + (np.stack([x, y], axis=1) + 0.5) * cell
    p = f.cloud[::3]
    z = np.where(delaunay.inside(at[:, 0], at[:, 1], f.ring), delaunay.height_in(p, delaunay.delaunay(p[:, :2]), at), f.cloud[:, 2].min())
    return [{"col": int(c), "row_": int(r), "z": None if np.isnan(h) else _n(h)} for c, r, h in zip(x, y, z, strict=True)]


def split_mesh(f: Feature) -> list[dict]:
    """The roof with a fin on the edge that its first two triangles share, as vertices and triangles with two of these at most on an edge."""
    t = f.triangles
    fin = np.array([t[0, 1], t[0, 2], t[0, 2] + [0, 0, 5]])
    v, faces = meshes.manifold(*meshes.indexed(np.concatenate([t, [fin]])))
    return [{"tri": i, "v0": int(a), "v1": int(b), "v2": int(c), "vertices": len(v)} for i, (a, b, c) in enumerate(faces)]


def nested(f: Feature) -> list[dict]:
    found = [f.ring, *(f.ring.mean(0) + (f.ring - f.ring.mean(0)) * s for s in (0.6, 0.3))]
    return [{"ring": i, "depth": d, "is_hole": d % 2 == 1} for i, d in enumerate(delaunay.nesting(found))]


_RING3, _MESH, _FACES = "ring long, i long, x double, y double", "tri long, k long, x double, y double, z double", "face long, area double, vertices long, in_footprint boolean"
#: Query: the rows it needs, its kernel, and the columns beside ``fid``.
KERNELS: dict[str, tuple[tuple[str, ...], Callable[[Feature], list[dict]], str]] = {
    "g1_detect_planes": ((CLOUD,), detect_planes, "plane_id long, a double, b double, c double, d double, points long, is_horizontal boolean, unsegmented long, wall_points long, roof_type string"),
    "g3_line_detector": ((CLOUD,), lambda f: [{"plane": p, "ring": i, "x0": _n(s[0, 0]), "y0": _n(s[0, 1]), "x1": _n(s[1, 0]), "y1": _n(s[1, 1]), "points": n} for p, i, s, n in f.ring_lines()], "plane long, ring long, x0 double, y0 double, x1 double, y1 double, points long"),
    "g4_detect_lines": ((CLOUD,), lambda f: ringed([lines.chained([lines.segment(r[m]) for m in lines.detect(r)]) for _, r in f.outlines]), _RING3),
    "j4_detected_plane_segments": ((CLOUD,), lambda f: [{"line": i, "x0": _n(s[0, 0]), "y0": _n(s[0, 1]), "x1": _n(s[1, 0]), "y1": _n(s[1, 1])} for i, s in enumerate(f.intersections())], "line long, x0 double, y0 double, x1 double, y1 double"),
    "g5_regularise_lines": ((SEGMENTS,), regularised_lines, "line long, x0 double, y0 double, x1 double, y1 double, priority long, angle_cluster long"),
    "g6_cluster_lines": ((SEGMENTS,), clustered_lines, "sid long, angle_cluster long, cluster long"),
    "g8_alpha_shape": ((CLOUD,), lambda f: ringed([r for _, r in f.outlines]), _RING3),
    "x1_arrangement_from_lines": ((CLOUD, RING), lambda f: faces_of(f.arranged()), _FACES),
    "x3_point_costs": ((CLOUD, RING), point_costs, "face long, plane long, cost double"),
    "x4_alpha_expansion": ((CLOUD, RING), label_faces, "face long, plane long, area double, energy_before double, energy double"),
    "x7_step_dissolve": ((FACES, TWINS), dissolve_steps, "face long, into long"),
    "x14_snap_round": ((CLOUD, RING), snapped, _FACES),
    "x15_tri_snap": ((CLOUD, RING), tri_snapped, _FACES),
    "x16_arrangement_extruder": ((CLOUD, RING), extrude, "surface long, label long, ring string"),
    "m1_simplify_polygon": ((CLOUD,), lambda f: ringed([lines.simplified(r) for _, r in f.outlines]), _RING3),
    "m2_any_ring_offset": ((RING,), lambda f: ringed([lines.offset(f.ring)]), _RING3),
    "m3_contour_regulariser": ((CLOUD,), lambda f: ringed([lines.contour(r) for _, r in f.outlines]), _RING3),
    "m4_max_inscribed_circle": ((CLOUD, RING), largest_circle, "x double, y double, diameter double"),
    "m5_triangulate_solid": ((CLOUD, RING), triangulate, "triangles long, volume double, area double"),
    "m6_mesh_clipper": ((TRIANGLES,), clip_mesh, _MESH + ", nx double, ny double, nz double"),
    "m7_mesh_simplify": ((CLOUD,), shorten_mesh, _MESH),
    "m8_mesh_simplify_2d": ((CLOUD,), thin_mesh, _MESH),
    "m9_quadric_simplify": ((CLOUD,), quadric_mesh, _MESH),
    "a9_outline_parts": ((CLOUD,), roof_parts, "plane long, ring long, h_min double, h_max double, h_50p double, h_70p double, slope double, azimuth double"),
    "j9_points_in_faces": ((CLOUD, RING), located, "face long, points long, z_max double"),
    "r2_surface_raster": ((CLOUD, RING), surface_raster, "col long, row_ long, z double"),
    "m11_manifold_mesh": ((TRIANGLES,), split_mesh, "tri long, v0 long, v1 long, v2 long, vertices long"),
    "f10_ring_nesting": ((RING,), nested, "ring long, depth long, is_hole boolean"),
    "r6_filter_25d": ((CLOUD,), filter_surface, "points long, kept long, triangles long"),
    "u2_polygon_union": ((RING,), union_outlines, _RING3),
    "f11_least_squares_plane": ((CLOUD,), fit_plane, "a double, b double, c double, d double, rmse double"),
}


def run(rows: DataFrame, kernel: Callable[[Feature], list[dict]], schema: str) -> DataFrame:
    """``kernel`` over the rows of each ``fid``, with the places that any of them has; ``schema`` names the columns it returns beside that."""
    names, places = [c.split()[0] for c in schema.split(", ")], [c for c in PLACES if c in rows.columns]
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def batch(fids: list[int | None], t: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
        features = featured(np.split(t, start))
        found = [(fid, r) for fid, f in zip(fids, features, strict=True) for r in kernel(f)]
        features.clear()  # they hold this list, so arrays would stay until they are collected
        columns = [pa.array([fid for fid, _ in found], pa.int64())] + [pa.array([r[n] for _, r in found], k) for n, k in zip(names, types, strict=True)]
        return pa.record_batch(columns, names=["fid", *names])

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a feature's rows follow each other, maybe over several batches; the last one may go on
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            if held and (sum(h.num_rows for h in held) < LEAST or held[0].column(0)[0] == b.column(0)[-1]):
                held.append(b)
                continue
            whole, rest = parted([*held, b])
            held = [rest]
            yield from map(batch, *whole)
        if held:
            whole, rest = parted([*held, None])
            yield from map(batch, *whole)

    def parted(pieces: list[pa.RecordBatch | None]) -> tuple[tuple[list, list, list], pa.RecordBatch | None]:
        """Whole features in batches, as lists of their fids, rows and where these are to be split, and the rows of the last feature unless the last piece is None."""
        t = pa.Table.from_batches([p for p in pieces if p is not None]).combine_chunks()
        fid, null = t.column("fid").fill_null(0).to_numpy(), t.column("fid").is_null().to_numpy()
        start = np.flatnonzero(np.concatenate([[True], (fid[1:] != fid[:-1]) | (null[1:] != null[:-1])]))
        end = len(fid)
        rest = None
        if pieces[-1] is not None:
            end, start = int(start[-1]), start[:-1]
            rest = t.slice(end).to_batches()[0]
        rows = np.column_stack([t.column(c).fill_null(0).to_numpy()[:end].astype(float) for c in ("kind", *places)])
        out: tuple[list, list, list] = ([], [], [])
        i, ends = 0, np.append(start[1:], end)
        while i < len(start):
            upto = max(i + 1, min(i + TOGETHER, int(np.searchsorted(ends, start[i] + MOST, "right"))))
            own, last, i = start[i:upto], int(ends[upto - 1]), upto
            out[0].append([None if null[a] else int(fid[a]) for a in own])
            out[1].append(rows[own[0] : last])
            out[2].append(own[1:] - own[0])
        return out, rest

    # kernels take far longer than their rows' bytes tell, so adaptive execution must not merge these partitions
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fid").sortWithinPartitions("fid")
    return rows.mapInArrow(all_of, f"fid long, {schema}")


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs, kernel, schema = KERNELS[name]
        inputs = [CORNERS if sql == CLOUD else sql for sql in inputs]
        for table in TABLES:
            if any(table in with_views(sql) for sql in inputs):
                spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        parts = [spark.sql(read(with_views(sql), "spark")) for sql in inputs]
        shaped = [p.selectExpr("CAST(fid AS BIGINT) AS fid", "CAST(kind AS INT) AS kind", *(f"CAST({c} AS DOUBLE) AS {c}" if c in p.columns else f"CAST(NULL AS DOUBLE) AS {c}" for c in PLACES if any(c in q.columns for q in parts))) for p in parts]
        rows = shaped[0]
        for more in shaped[1:]:
            rows = rows.unionByName(more)
        return run(rows, kernel, schema)

    return of


QUERIES = {name: query(name) for name in KERNELS}
