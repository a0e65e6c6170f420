"""Lines found along rings, clustered and regularised lines, and rings made of lines or simplified."""

from __future__ import annotations

from collections import deque
from math import atan2, cos, hypot, sin

import numpy as np

from rooftide.kernels.planes import neighbours


def line_of(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and direction of the line of least squared distances."""
    centre = p.mean(0)
    _, axes = np.linalg.eigh((p - centre).T @ (p - centre))
    return centre, axes[:, -1]


class Growing:
    """A line in the plane through points that come one by one, from their sums."""

    def __init__(self):
        self.n = self.x = self.y = self.xx = self.xy = self.yy = 0.0

    def add(self, x: float, y: float) -> None:
        self.n, self.x, self.y = self.n + 1, self.x + x, self.y + y
        self.xx, self.xy, self.yy = self.xx + x * x, self.xy + x * y, self.yy + y * y

    def fit(self) -> None:
        self.mx, self.my = self.x / self.n, self.y / self.n
        turn = 0.5 * atan2(2 * (self.xy / self.n - self.mx * self.my), (self.xx / self.n - self.mx**2) - (self.yy / self.n - self.my**2))
        self.ux, self.uy = cos(turn), sin(turn)

    def off(self, x: float, y: float) -> float:
        """Squared distance from the line as last fitted."""
        return ((x - self.mx) * self.uy - (y - self.my) * self.ux) ** 2


def through(points: list[tuple[float, float]]) -> Growing:
    line = Growing()
    for x, y in points:
        line.add(x, y)
    line.fit()
    return line


def detect(p: np.ndarray, threshold: float = 0.4, counts: range = range(10, 4, -1), k: int = 5) -> list[np.ndarray]:
    """Members of each line along a ring in the plane, in the order of the ring, sought with falling least counts.

    Seeds come by falling residual of the line through a point and its
    neighbours; a region takes neighbours near its line, fitted anew each time.
    """
    if len(p) < 2:
        return []
    # sums of products lose less around the middle
    at = [tuple(q) for q in (p - p.mean(0)).tolist()]
    near = neighbours(p, k).tolist()
    first = [[at[i], *(at[j] for j in near[i])] for i in range(len(p))]
    local = [through(own) for own in first]
    rough = [round(sum(line.off(*q) for q in own), 12) for line, own in zip(local, first, strict=True)]
    order = sorted(range(len(p)), key=lambda i: (-rough[i], i))
    free, found, limit = [True] * len(p), [], threshold**2
    # a region stays what it was while none of the points it met has been taken by a line
    size, met, since, taken = {}, {}, {}, [-1] * len(p)
    for least in counts:
        for seed in order:
            if not free[seed]:
                continue
            if seed in size and size[seed] < least and all(taken[i] < since[seed] for i in met[seed]):
                continue
            members, queue, line, grown = {seed}, deque([seed]), local[seed], Growing()
            grown.add(*at[seed])
            while queue:
                for i in near[queue.popleft()]:
                    if free[i] and i not in members and line.off(*at[i]) < limit:
                        members.add(i)
                        queue.append(i)
                        grown.add(*at[i])
                        grown.fit()
                        line = grown
            size[seed], met[seed], since[seed] = len(members), {i for j in members for i in near[j]}, len(found)
            if len(members) >= least:
                for i in members:
                    free[i], taken[i] = False, len(found)
                m = np.array(sorted(members))
                # a line over the ring's start begins after its widest gap
                found.append(np.roll(m, -1 - int(np.argmax(np.append(np.diff(m), m[0] + len(p) - m[-1])))))
    return sorted(found, key=lambda m: (m[0], len(m)))


def segment(p: np.ndarray) -> np.ndarray:
    """The part of the line through points, in their order, that they cover."""
    centre, way = line_of(p)
    along = (p - centre) @ way
    if along[-1] < along[0]:
        way, along = -way, -along
    return np.array([centre + along.min() * way, centre + along.max() * way])


def crossing(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Where the lines through two segments of the plane cross; none if they are parallel."""
    (ax, ay), (ux, uy) = a.tolist()
    (bx, by), (vx, vy) = b.tolist()
    ux, uy, vx, vy = ux - ax, uy - ay, vx - bx, vy - by
    d = ux * vy - uy * vx
    if abs(d) < 1e-9 * hypot(ux, uy) * hypot(vx, vy) or d == 0:
        return None
    along = (bx - ax) * vy - (by - ay) * vx
    return np.array([ax + ux * along / d, ay + uy * along / d])


def chained(segments: list[np.ndarray], snap: float = 1.0) -> np.ndarray:
    """A closed ring of segments in order: crossings near both ends where there are any, else both ends."""
    out = []
    for a, b in zip(segments, segments[1:] + segments[:1], strict=True):
        x = crossing(a, b) if len(segments) > 1 else None
        if x is not None and ((x - a[1]) ** 2).sum() <= snap and ((x - b[0]) ** 2).sum() <= snap:
            out.append(x)
        else:
            out += [a[1], b[0]]
    return np.array(out).reshape(-1, 2)


def angles(s: np.ndarray) -> np.ndarray:
    """Undirected angles from the y axis in [0, pi)."""
    d = s[:, 1] - s[:, 0]
    return np.arctan2(d[:, 0], d[:, 1]) % np.pi


def between(a: np.ndarray, b: np.ndarray) -> float:
    """Distance of two segments in the plane."""
    x = crossing(a, b)
    on = lambda s: x is not None and -1e-12 <= (x - s[0]) @ (s[1] - s[0]) <= ((s[1] - s[0]) ** 2).sum() + 1e-12
    if on(a) and on(b):
        return 0.0

    def to(p: np.ndarray, s: np.ndarray) -> float:
        d = s[1] - s[0]
        t = np.clip((p - s[0]) @ d / max(d @ d, 1e-300), 0, 1)
        return float(np.hypot(*(p - s[0] - t * d)))

    return min(to(a[0], b), to(a[1], b), to(b[0], a), to(b[1], a))


def merged(values: np.ndarray, weights: np.ndarray, threshold: float) -> np.ndarray:
    """Clusters of numbers: the two nearest means merge, by weight, until none are within the threshold.

    Means in order only merge with those beside them; equal gaps go to the smaller values.
    """
    order = np.argsort(values, kind="stable")
    groups = [[i] for i in order]
    mean = [(values[i], weights[i]) for i in order]
    while len(groups) > 1:
        gap = [b[0] - a[0] for a, b in zip(mean, mean[1:])]
        i = int(np.argmin(gap))
        if gap[i] >= threshold:
            break
        w = mean[i][1] + mean[i + 1][1]
        mean[i : i + 2] = [((mean[i][0] * mean[i][1] + mean[i + 1][0] * mean[i + 1][1]) / max(w, 1e-300), w)]
        groups[i : i + 2] = [groups[i] + groups[i + 1]]
    out = np.zeros(len(values), np.int64)
    for g, members in enumerate(groups):
        out[members] = g
    return out


def cluster(s: np.ndarray, angle: float = 0.15, distance: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Angle cluster of each segment, and within these the cluster of segments that lie near each other (single link)."""
    by_angle = merged(angles(s), ((s[:, 1] - s[:, 0]) ** 2).sum(1), angle)
    by_place = np.arange(len(s))
    for i in range(len(s)):
        for j in range(i):
            if by_angle[i] == by_angle[j] and between(s[i], s[j]) < distance:
                old, new = max(by_place[i], by_place[j]), min(by_place[i], by_place[j])
                by_place[by_place == old] = new
    return by_angle, np.unique(by_place, return_inverse=True)[1] if len(s) else by_place


def regularised(s: np.ndarray, priority: np.ndarray, angle: float = 0.15, distance: float = 0.5, extension: float = 1.0) -> list[tuple[np.ndarray, int, int]]:
    """One segment of each cluster, with its priority and angle cluster.

    The members of the highest priority give the centre and the angle, weighted
    by squared length; all members give the extent, which is then extended.
    """
    if not len(s):
        return []
    by_angle, by_place = cluster(s, angle, distance)
    weight = np.maximum(((s[:, 1] - s[:, 0]) ** 2).sum(1), 1e-12)
    out = []
    for c in range(by_place.max() + 1):
        own = np.flatnonzero(by_place == c)
        top = own[priority[own] == priority[own].max()]
        turn = float((angles(s)[top] * weight[top]).sum() / weight[top].sum())
        way = np.array([np.sin(turn), np.cos(turn)])
        centre = (s[top].mean(1) * weight[top][:, None]).sum(0) / weight[top].sum()
        along = (s[own].reshape(-1, 2) - centre) @ way
        out.append((np.array([centre + (along.min() - extension) * way, centre + (along.max() + extension) * way]), int(priority[own].max()), int(by_angle[own[0]])))
    return out


def to_chord(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """Squared distance of a point from a segment."""
    d = b - a
    t = min(max((p - a) @ d / max(d @ d, 1e-300), 0.0), 1.0)
    return float(((p - a - t * d) ** 2).sum())


def simplified(ring: np.ndarray, threshold: float = 0.005) -> np.ndarray:
    """A ring without the vertices that cost least, as long as the squared distance from their neighbours' chord is below the threshold."""
    left = list(range(len(ring)))
    chord = lambda i: to_chord(ring[left[i]], ring[left[i - 1]], ring[left[(i + 1) % len(left)]])
    cost = [chord(i) for i in range(len(left))] if len(left) > 3 else []
    while len(left) > 3:
        i = cost.index(min(cost))
        if cost[i] >= threshold:
            break
        del left[i], cost[i]
        # only the vertices beside it have another chord now
        for j in (i - 1, i % len(left)):
            cost[j] = chord(j)
    return ring[left]


def contour(ring: np.ndarray, min_length: float = 2.0, max_angle: float = 20.0, max_offset: float = 2.0) -> np.ndarray:
    """A ring whose edges follow few directions.

    The longest edge gives the first direction and its normal; other long edges
    add theirs where they turn by more than ``max_angle`` from all before. Edges
    take the nearest direction within that angle; following parallel edges
    within ``max_offset`` merge, others are joined by a step; then edges cross.
    """
    n = len(ring)
    edge = np.roll(ring, -1, axis=0) - ring
    length = np.hypot(*edge.T)
    middles, angle, length = ring + edge / 2, (np.arctan2(edge[:, 1], edge[:, 0]) % np.pi).tolist(), length.tolist()
    limit, known, pi = float(np.radians(max_angle)), [], float(np.pi)
    apart = lambda a, b: min((a - b) % pi, (b - a) % pi)
    for i in sorted(range(n), key=lambda i: (-length[i], i)):
        if length[i] < min_length:
            break
        if all(apart(angle[i], k) > limit for k in known):
            known += [angle[i], (angle[i] + pi / 2) % pi]
    way = {}  # unit vectors along and across each direction
    lines = []
    for turn, middle, size in zip(angle, middles, length):
        near = min(known, key=lambda k: apart(turn, k), default=turn)
        turn = near if apart(turn, near) <= limit else turn
        if turn not in way:
            u, v = np.cos(turn), np.sin(turn)
            way[turn] = np.array([u, v]), np.array([-v, u])
        lines.append((turn, middle, size))
    joined: list[tuple[float, np.ndarray, float]] = []
    for turn, middle, size in [*lines]:
        if joined and apart(turn, joined[-1][0]) < 1e-9:
            if abs((middle - joined[-1][1]) @ way[turn][1]) <= max_offset:
                _, m, w = joined[-1]
                joined[-1] = (turn, (m * w + middle * size) / (w + size), w + size)
                continue
        joined.append((turn, middle, size))
    if len(joined) > 3 and apart(joined[0][0], joined[-1][0]) < 1e-9:
        turn, m, w = joined[0]
        _, m2, w2 = joined[-1]
        if abs((m - m2) @ way[turn][1]) <= max_offset:
            joined = [(turn, (m * w + m2 * w2) / (w + w2), w + w2), *joined[1:-1]]
    out = []
    for (a, m, _), (b, k, _) in zip(joined, joined[1:] + joined[:1], strict=True):
        u, v = way[a][0], way[b][0]
        x = crossing(np.array([m, m + u]), np.array([k, k + v]))
        if x is None:  # parallel and apart: a step across, half way
            half = (m + k) / 2
            out += [m + u * ((half - m) @ u), k + v * ((half - k) @ v)]
        else:
            out.append(x)
    return np.array(out) if len(out) > 2 else ring


def offset(ring: np.ndarray, by: float = 4.0) -> np.ndarray:
    """A counter-clockwise ring moved outwards by mitred corners."""
    e = np.roll(ring, -1, axis=0) - ring
    n = np.stack([e[:, 1], -e[:, 0]], axis=1) / np.hypot(*e.T)[:, None]
    before = np.roll(n, 1, axis=0)
    return ring + by * (before + n) / (1 + (before * n).sum(1))[:, None]
