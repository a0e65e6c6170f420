"""Planar subdivisions: faces between segments, snapping, unions, and solids over labelled faces."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import floor, hypot, sqrt

import numpy as np

from rooftide.kernels.delaunay import inside

#: Vertices closer than this, in parts of the extent, are one.
TOLERANCE = 1e-9


@dataclass
class Arrangement:
    """Vertices, edges ``(a, b)`` with the faces to their left and right, and the faces' rings (holes after the outer one); face -1 is outside."""

    vertices: np.ndarray
    edges: np.ndarray
    left: np.ndarray
    right: np.ndarray
    faces: list[list[list[int]]]
    in_footprint: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def area(self, face: int) -> float:
        return sum(ring_area(self.vertices[r]) for r in self.faces[face])

    def pairs(self) -> dict[tuple[int, int], float]:
        """Lengths of shared edges by pair of faces."""
        out: dict[tuple[int, int], float] = {}
        for (a, b), f, g in zip(self.edges, self.left, self.right, strict=True):
            if f != g and f >= 0 and g >= 0:
                key = (int(min(f, g)), int(max(f, g)))
                out[key] = out.get(key, 0.0) + float(np.hypot(*(self.vertices[a] - self.vertices[b])))
        return out


def ring_area(ring: np.ndarray) -> float:
    x, y = ring.T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def noded(segments: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and distinct edges once segments are cut where they cross, touch or overlap."""
    n = len(segments)
    cuts: list[list[float]] = [[0.0, 1.0] for _ in range(n)]
    d = segments[:, 1] - segments[:, 0]
    size = np.maximum((d * d).sum(1), 1e-300)
    # plain numbers: there are many pairs of few segments
    way, at, square = d.tolist(), segments[:, 0].tolist(), size.tolist()
    near = (tolerance / np.sqrt(size)).tolist()
    for i in range(n):
        (dx, dy), (x, y), a = way[i], at[i], near[i]
        for j in range(i + 1, n):
            ex, ey = way[j]
            wx, wy = at[j][0] - x, at[j][1] - y
            cross = dx * ey - dy * ex
            if abs(cross) > 1e-12 * sqrt(square[i] * square[j]):
                t, u, b = (wx * ey - wy * ex) / cross, (wx * dy - wy * dx) / cross, near[j]
                if -a <= t <= 1 + a and -b <= u <= 1 + b:
                    cuts[i].append(min(max(t, 0.0), 1.0))
                    cuts[j].append(min(max(u, 0.0), 1.0))
                continue
            for k, m in ((i, j), (j, i)):  # parallel: ends of one that lie on the other
                for end in segments[m]:
                    t = float((end - segments[k, 0]) @ d[k] / size[k])
                    if 0 < t < 1 and np.hypot(*(segments[k, 0] + t * d[k] - end)) <= tolerance:
                        cuts[k].append(t)
    vertices: list[np.ndarray] = []
    place: dict[tuple[int, int], int] = {}

    def vertex(p: np.ndarray) -> int:
        cell = floor(p[0] / (2 * tolerance)), floor(p[1] / (2 * tolerance))
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                at = place.get((cell[0] + dx, cell[1] + dy))
                if at is not None and hypot(vertices[at][0] - p[0], vertices[at][1] - p[1]) <= 2 * tolerance:
                    return at
        place[cell] = len(vertices)
        vertices.append(p)
        return len(vertices) - 1

    edges = set()
    for i in range(n):
        at = [vertex(segments[i, 0] + t * d[i]) for t in sorted(cuts[i])]
        edges |= {(min(a, b), max(a, b)) for a, b in zip(at, at[1:]) if a != b}
    return np.array(vertices).reshape(-1, 2), np.array(sorted(edges), np.int64).reshape(-1, 2)


def build(segments: np.ndarray, keep_dangling: bool = False, tolerance: float | None = None) -> Arrangement:
    """The faces between segments; edges with one face on both sides are dropped."""
    segments = np.asarray(segments, float).reshape(-1, 2, 2)
    extent = float(np.ptp(segments.reshape(-1, 2), axis=0).max()) if len(segments) else 1.0
    v, e = noded(segments, tolerance or max(extent, 1.0) * TOLERANCE)
    while len(e) and not keep_dangling:
        degree = np.bincount(e.ravel(), minlength=len(v))
        loose = (degree[e] == 1).any(1)
        if not loose.any():
            break
        e = e[~loose]
    m = len(e)
    src, dst = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
    turn = np.arctan2(v[dst, 1] - v[src, 1], v[dst, 0] - v[src, 0]) if m else np.zeros(0)
    fan: dict[int, list[int]] = {}
    for h in np.lexsort((turn, src)):
        fan.setdefault(int(src[h]), []).append(int(h))
    following = np.zeros(2 * m, np.int64)
    for around in fan.values():
        for k, h in enumerate(around):  # after the half-edge into a vertex comes the one clockwise of its twin
            twin = h + m if h < m else h - m
            following[twin] = around[k - 1]
    cycle = np.full(2 * m, -1)
    loops: list[list[int]] = []
    for h in range(2 * m):
        if cycle[h] < 0:
            loop = []
            while cycle[h] < 0:
                cycle[h] = len(loops)
                loop.append(h)
                h = int(following[h])
            loops.append(loop)
    outer = [i for i, loop in enumerate(loops) if ring_area(v[src[loop]]) > 1e-12 * max(extent, 1.0) ** 2]
    face_of = {i: n for n, i in enumerate(outer)}
    faces = [[src[loops[i]].tolist()] for i in outer]
    for i, loop in enumerate(loops):
        if i in face_of:
            continue
        ring = v[src[loop]]
        around = [n for n, o in enumerate(outer) if inside(ring[:1, 0], ring[:1, 1], v[faces[n][0]])[0] and not set(faces[n][0]) & set(src[loop].tolist())]
        best = min(around, key=lambda n: ring_area(v[faces[n][0]]), default=-1)
        face_of[i] = best
        if best >= 0:
            faces[best].append(src[loop].tolist())
    side = np.array([face_of[c] for c in cycle], np.int64)
    left, right = side[:m], side[m:]
    keep = left != right
    return Arrangement(v, e[keep], left[keep], right[keep], faces)


def point_in(arr: Arrangement, face: int) -> np.ndarray:
    """A point inside a face, on the widest of a few lines across it."""
    rings = [arr.vertices[r] for r in arr.faces[face]]
    y0, y1 = rings[0][:, 1].min(), rings[0][:, 1].max()
    best, at = -1.0, rings[0].mean(0)
    rings = [r.tolist() for r in rings]
    for share in (0.5, 0.37, 0.61, 0.23, 0.79, 0.11, 0.89):
        y, xs = y0 + share * (y1 - y0), []
        for ring in rings:
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                if (ay > y) != (by > y):
                    xs.append(ax + (y - ay) / (by - ay) * (bx - ax))
        xs.sort()
        for a, b in zip(xs[::2], xs[1::2]):
            if b - a > best:
                best, at = b - a, np.array([(a + b) / 2, y])
    return at


def ring_segments(ring: np.ndarray) -> np.ndarray:
    return np.stack([ring, np.roll(ring, -1, axis=0)], axis=1)


def from_lines(footprint: np.ndarray, lines: np.ndarray, most: int = 400) -> Arrangement:
    """The faces that the longest lines cut a footprint into; those outside it are told apart."""
    lines = np.asarray(lines, float).reshape(-1, 2, 2)
    length = ((lines[:, 1] - lines[:, 0]) ** 2).sum(1)
    order = np.lexsort((np.arange(len(lines)), -length))
    use = [i for i in order if length[i] > 0.001][:most]
    arr = build(np.concatenate([ring_segments(footprint), lines[use]]))
    at = np.array([point_in(arr, f) for f in range(len(arr.faces))]).reshape(-1, 2)
    arr.in_footprint = inside(at[:, 0], at[:, 1], footprint)
    return arr


def locate(arr: Arrangement, p: np.ndarray) -> np.ndarray:
    """The face of each point, -1 outside."""
    out = np.full(len(p), -1)
    for f, rings in enumerate(arr.faces):
        hit = np.zeros(len(p), bool)
        for r in rings:
            hit ^= inside(p[:, 0], p[:, 1], arr.vertices[r])
        out[hit & (out < 0)] = f
    return out


def carried(old: Arrangement, new: Arrangement, value: np.ndarray) -> np.ndarray:
    """Values of the old faces at a point of each new one; -1 where there is none."""
    at = np.array([point_in(new, f) for f in range(len(new.faces))]).reshape(-1, 2)
    face = locate(old, at)
    return np.where(face >= 0, np.append(value, -1)[face], -1)


def snap_rounded(arr: Arrangement, pixel: float = 0.001) -> Arrangement:
    """All edges between centres of pixels, cut and rounded until nothing moves; footprint flags are carried."""
    s = arr.vertices[arr.edges]
    for _ in range(16):
        rounded = np.round(s / pixel) * pixel
        v, e = noded(rounded[(rounded[:, 0] != rounded[:, 1]).any(1)], pixel * 1e-3)
        s = v[e]
        if np.allclose(np.round(v / pixel) * pixel, v, atol=pixel * 1e-2):
            break
    out = build(s, tolerance=pixel * 1e-3)
    out.in_footprint = carried(arr, out, arr.in_footprint.astype(np.int64)) == 1
    return out


def merged_vertices(arr: Arrangement, distance: float = 0.005) -> Arrangement:
    """Vertices nearer than ``distance`` as one, and edges bent to vertices that near; those of the footprint's rim stay in place."""
    rim = np.zeros(len(arr.vertices), bool)
    flag = np.append(arr.in_footprint, False)
    rim[arr.edges[flag[arr.left] != flag[arr.right]].ravel()] = True
    order = sorted(set(arr.edges.ravel().tolist()), key=lambda i: (not rim[i], i))
    own = np.arange(len(arr.vertices))
    for k, i in enumerate(order):
        for j in order[:k]:
            if own[j] == j and np.hypot(*(arr.vertices[i] - arr.vertices[j])) < distance:
                own[i] = j
                break
    segments = []
    for a, b in own[arr.edges]:
        p, q = arr.vertices[a], arr.vertices[b]
        d = q - p
        along = [(0.0, a), (1.0, b)]
        for i in set(own[order].tolist()) - {a, b}:
            t = float((arr.vertices[i] - p) @ d / max(d @ d, 1e-300))
            if 0 < t < 1 and np.hypot(*(p + t * d - arr.vertices[i])) < distance:
                along.append((t, i))
        at = [i for _, i in sorted(along)]
        segments += [(arr.vertices[i], arr.vertices[j]) for i, j in zip(at, at[1:]) if i != j]
    out = build(np.array(segments))
    out.in_footprint = carried(arr, out, arr.in_footprint.astype(np.int64)) == 1
    return out


def union(polygons: list[np.ndarray]) -> list[np.ndarray]:
    """Rings of the union of rings: outer ones counter-clockwise, holes clockwise."""
    arr = build(np.concatenate([ring_segments(p) for p in polygons]))
    at = np.array([point_in(arr, f) for f in range(len(arr.faces))]).reshape(-1, 2)
    held = np.append(np.any([inside(at[:, 0], at[:, 1], p) for p in polygons], axis=0), False)
    ways: dict[int, list[int]] = {}
    for (a, b), f, g in zip(arr.edges.tolist(), arr.left, arr.right, strict=True):
        if held[f] != held[g]:
            ways.setdefault(a if held[f] else b, []).append(b if held[f] else a)
    out = []
    for start in sorted(ways):
        while ways[start]:
            ring, last, at_ = [start], start, ways[start].pop(0)
            while at_ != start:
                ring.append(at_)
                back = np.arctan2(*(arr.vertices[last] - arr.vertices[at_])[::-1])
                on = min(ways[at_], key=lambda b: ((back - np.arctan2(*(arr.vertices[b] - arr.vertices[at_])[::-1])) % (2 * np.pi), b))
                ways[at_].remove(on)
                last, at_ = at_, on
            out.append(arr.vertices[ring])
    return out


def dissolved_steps(height: dict[int, float], pixels: dict[int, int], pairs: dict[tuple[int, int], float], threshold: float = 1.0) -> dict[int, int]:
    """The face that each face merges into: again and again the adjacent two with the least step below the threshold.

    The merged height is the mean by pixels; equal steps go to the smaller faces.
    """
    height, pixels = dict(height), dict(pixels)
    into = {f: f for f in height}
    near = {tuple(sorted(p)) for p in pairs}
    while near:
        step, pair = min((abs(height[a] - height[b]), (a, b)) for a, b in near)
        if step >= threshold:
            break
        a, b = pair
        total = pixels[a] + pixels[b]
        height[a] = (height[a] * pixels[a] + height[b] * pixels[b]) / max(total, 1)
        pixels[a] = total
        into = {f: a if g == b else g for f, g in into.items()}
        near = {tuple(sorted((a if x == b else x, a if y == b else y))) for x, y in near if {x, y} != {a, b}}
        near = {(x, y) for x, y in near if x != y}
    return into


def extruded(arr: Arrangement, planes: dict[int, np.ndarray], floor: float, digits: int = 4) -> list[tuple[int, list[tuple[float, float, float]]]]:
    """Surfaces of the solid over footprint faces with a plane: label (0 ground, 1 roof, 2 outer wall, 3 inner wall) and ring.

    Heights equal to ``digits`` places are one. Walls stand between the heights
    of both sides; where the sides' planes cross above an edge, two triangles.
    """
    own = {f: planes[f] for f in range(len(arr.faces)) if arr.in_footprint[f] and f in planes}
    v = arr.vertices

    def z(face: int, at: np.ndarray) -> float:
        if face not in own:
            return round(floor, digits)
        a, b, c, d = own[face]
        return round(float(-(a * at[0] + b * at[1] + d) / c), digits)

    point = lambda p, h: (float(p[0]), float(p[1]), float(h))
    out = []
    for f in own:
        for ring in arr.faces[f]:
            out.append((1, [point(v[i], z(f, v[i])) for i in ring]))
            out.append((0, [point(v[i], round(floor, digits)) for i in reversed(ring)]))
    for (a, b), f, g in zip(arr.edges, arr.left, arr.right, strict=True):
        if f not in own and g not in own:
            continue
        label = 3 if f in own and g in own else 2
        p, q = v[a], v[b]
        fp, fq, gp, gq = z(f, p), z(f, q), z(g, p), z(g, q)
        # seen from the left face's side; the higher side faces out
        if (fp - gp) * (fq - gq) < 0:
            t = (fp - gp) / ((fp - gp) - (fq - gq))
            x, h = p + t * (q - p), round(fp + t * (fq - fp), digits)
            out.append((label, [point(p, fp), point(p, gp), point(x, h)]))
            out.append((label, [point(x, h), point(q, gq), point(q, fq)]))
            continue
        ring = [point(p, gp), point(q, gq), point(q, fq), point(p, fp)]
        ring = [c for i, c in enumerate(ring) if c != ring[i - 1]]
        if len(ring) > 2:
            out.append((label, ring))
    return out
