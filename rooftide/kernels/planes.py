"""Neighbours, normals, and planes grown over a point cloud."""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

import numpy as np


@dataclass(frozen=True)
class PlaneParams:
    normal_k: int = 5
    plane_k: int = 15
    min_points: int = 20
    epsilon: float = 0.2
    normal_thres: float = 0.75
    horizontal: float = 0.97
    wall: float = 0.3
    n_refit: int = 5


def neighbours(p: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest other points of each point, nearest first, ties to the smaller index."""
    return neighbourhoods([p], k)[0]


def neighbourhoods(clouds: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The neighbours of each cloud's points as by ``neighbours``; many small clouds are cheaper together."""
    out, many = [np.zeros((len(p), max(0, min(k, len(p) - 1))), np.int64) for p in clouds], []
    for i, p in enumerate(clouds):
        if len(p) > max(64, k):
            many.append(i)
        else:
            _from_all(p, np.arange(len(p)), out[i])
    if not many:
        return out
    p, n = np.concatenate([clouds[i] for i in many]), np.array([len(clouds[i]) for i in many])
    start, of = np.cumsum(n) - n, np.repeat(np.arange(len(many)), n)
    low = np.minimum.reduceat(p[:, :2], start)
    extent = np.maximum.reduceat(p[:, :2], start) - low
    side = np.maximum(np.maximum(np.sqrt(extent[:, 0] * extent[:, 1] / n * (k + 1)), extent.max(1) / n * (k + 1)), 1e-150) * 0.7
    found, left = np.zeros((len(p), k), np.int64), np.arange(len(p))
    for _ in range(5):
        left = left[~_from_cells(p, of, low, left, k, side, found)]
        side = side * 1.5
        if not len(left):
            break
    found -= start[of, None]
    for i, a, m in zip(many, start, n):
        out[i] = found[a : a + m]
        own = left[(left >= a) & (left < a + m)] - a if len(left) else left
        _from_all(clouds[i], own, out[i])
    return out


def _from_all(p: np.ndarray, left: np.ndarray, out: np.ndarray) -> None:
    """Neighbours of the rows ``left`` among all points."""
    k = out.shape[1]
    for a in range(0, len(left) if k else 0, 512):
        own = left[a : a + 512]
        d = ((p[own, None, :] - p[None, :, :]) ** 2).sum(2)
        d[np.arange(len(d)), own] = np.inf
        out[own] = np.argsort(d, axis=1, kind="stable")[:, :k]


def _from_cells(p: np.ndarray, of: np.ndarray, corner: np.ndarray, rows: np.ndarray, k: int, sides: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Seek neighbours of ``rows`` up to the side of their cloud along y in the columns of that width around; true where these settle them, as the last is no farther than it.

    ``of`` is the cloud of each point of ``p``, ``corner`` that of the clouds, which stand side by side with empty columns between.
    """
    side, place = sides[of], p[:, :2] - corner[of]
    col = np.floor(place[:, 0] / side)
    # heights count in sides, so that one table serves all clouds
    up = place[:, 1] / side
    last = np.zeros(len(sides))
    np.maximum.at(last, of, col)
    col += (np.cumsum(last + 3) - last)[of]
    high = float(up.max()) + 3
    key = col * high + up
    order = np.argsort(key, kind="stable")
    key = key[order]
    axes = [np.append(x, np.inf) for x in p.T]
    last = len(p)
    order = np.append(order, last)
    done = np.zeros(len(rows), bool)
    # a block is short enough for its tables to stay in the processor's cache
    for a in range(0, len(rows), 256):
        own = rows[a : a + 256]
        base = (col[own, None] + [-1, 0, 1]) * high + up[own, None]
        lo, hi = np.searchsorted(key, base - 1.00001, "left"), np.searchsorted(key, base + 1.00001, "right")
        many = (hi - lo).sum(1)
        width = int(many.max())
        if width * len(own) > 1 << 19 or width < k:
            continue
        within = np.arange(width)[None, :]
        first, second = (hi - lo)[:, :1], (hi - lo)[:, :2].sum(1, keepdims=True)
        at = within + np.where(within < first, lo[:, :1], np.where(within < second, lo[:, 1:2] - first, lo[:, 2:] - second))
        at[within >= many[:, None]] = last
        other = order[at]
        d = 0.0
        for x in axes:
            e = x[own, None] - x[other]
            e *= e
            d = e + d
        d[other == own[:, None]] = np.inf
        if width > k + 12:
            # only some of the nearest are put in order; equal distances at their end leave a row for the whole order
            some = np.argpartition(d, k + 8, axis=1)[:, : k + 9]
            d_, other_ = np.take_along_axis(d, some, 1), np.take_along_axis(other, some, 1)
            far = d_[:, -1].copy()
        else:
            d_, other_, far = d, other, np.full(len(own), np.inf)
        best = np.argsort(other_, axis=1)  # of equal distances the smaller index is first
        d_, other_ = np.take_along_axis(d_, best, 1), np.take_along_axis(other_, best, 1)
        best = np.argsort(d_, axis=1, kind="stable")[:, :k]
        kth = np.take_along_axis(d_, best[:, -1:], 1)[:, 0]
        near = np.take_along_axis(other_, best, 1)
        tied = np.flatnonzero(kth == far)
        if len(tied):
            best = np.lexsort((other[tied], d[tied]))[:, :k]
            near[tied] = np.take_along_axis(other[tied], best, 1)
        good = kth < (side[own] * (1 - 1e-9)) ** 2
        out[own[good]] = near[good]
        done[a : a + 256] = good
    return done


def spread(p: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normals with z >= 0 from each point and its neighbours, and how far these are from flat (0: flat)."""
    group = np.concatenate([p[:, None, :], p[near]], axis=1)
    group = group - group.mean(1, keepdims=True)
    values, axes = np.linalg.eigh(np.einsum("nki,nkj->nij", group, group))
    normal = axes[:, :, 0]
    return np.where(normal[:, 2:] < 0, -normal, normal), values[:, 0] / np.maximum(values.sum(1), 1e-300)


def least_squares(p: np.ndarray) -> np.ndarray:
    """The plane ``a x + b y + c z + d = 0`` of least squared distances, with c >= 0 and a unit normal."""
    centre = p.mean(0)
    _, axes = np.linalg.eigh((p - centre).T @ (p - centre))
    n = axes[:, 0] if axes[2, 0] >= 0 else -axes[:, 0]
    return np.append(n, -n @ centre)


def flattest(xx: float, xy: float, xz: float, yy: float, yz: float, zz: float) -> list[float]:
    """The unit axis, with z >= 0, along which points of these central moments spread least.

    The least root of the characteristic polynomial is sought from below by Newton's steps, which can't pass it; where
    two roots are close the axis is numpy's.
    """
    size = xx + yy + zz
    if size > 0:
        second = xx * yy + xx * zz + yy * zz - xy * xy - xz * xz - yz * yz
        last = xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)
        low = 0.0
        for _ in range(40):
            slope = (3 * low - 2 * size) * low + second
            if slope <= 0:
                break
            step = (((size - low) * low - second) * low + last) / slope
            low += step
            if step <= 1e-15 * size:
                break
        p, q, r = xx - low, yy - low, zz - low
        # the axis is at right angles to all rows of the matrix; the longest product of two of them is the surest
        best, axis = 0.0, None
        for a, b, c in ((xy * yz - xz * q, xz * xy - p * yz, p * q - xy * xy), (xy * r - xz * yz, xz * xz - p * r, p * yz - xy * xz), (q * r - yz * yz, yz * xz - xy * r, xy * yz - q * xz)):
            long = a * a + b * b + c * c
            if long > best:
                best, axis = long, (a, b, c)
        if best > 1e-8 * size**4:
            long = sqrt(best) if axis[2] >= 0 else -sqrt(best)
            return [k / long for k in axis]
    axes = np.linalg.eigh(np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]]))[1]
    return (axes[:, 0] if axes[2, 0] >= 0 else -axes[:, 0]).tolist()


def flattests(xx: np.ndarray, xy: np.ndarray, xz: np.ndarray, yy: np.ndarray, yz: np.ndarray, zz: np.ndarray) -> np.ndarray:
    """What ``flattest`` returns for each of many moments, in three rows."""
    size = xx + yy + zz
    second = xx * yy + xx * zz + yy * zz - xy * xy - xz * xz - yz * yz
    last = xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)
    low, on = np.zeros(len(xx)), size > 0
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for _ in range(40):
            slope = (3 * low - 2 * size) * low + second
            on = on & ~(slope <= 0)
            if not on.any():
                break
            step = (((size - low) * low - second) * low + last) / slope
            low = np.where(on, low + step, low)
            on = on & ~(step <= 1e-15 * size)
        p, q, r = xx - low, yy - low, zz - low
        best, axis = np.zeros(len(xx)), np.zeros((3, len(xx)))
        for row in ((xy * yz - xz * q, xz * xy - p * yz, p * q - xy * xy), (xy * r - xz * yz, xz * xz - p * r, p * yz - xy * xz), (q * r - yz * yz, yz * xz - xy * r, xy * yz - q * xz)):
            long = row[0] * row[0] + row[1] * row[1] + row[2] * row[2]
            more = long > best
            best, axis = np.where(more, long, best), np.where(more, np.stack(row), axis)
        long = np.where(axis[2] >= 0, np.sqrt(best), -np.sqrt(best))
        out = axis / long
    # powers of whole sizes as in flattest
    for i in np.flatnonzero(~(best > 1e-8 * size**4 * (1 + 1e-12))).tolist():
        out[:, i] = flattest(*(float(v[i]) for v in (xx, xy, xz, yy, yz, zz)))
    return out


def grow(p: np.ndarray, params: PlaneParams = PlaneParams(), near: np.ndarray | None = None) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
    """Plane of each point (0: none), the planes, and whether each point lies on a wall.

    Seeds come flattest first, then by index. A region takes neighbours near its
    plane whose normals agree, and fits its plane again every few points.
    ``near`` are the neighbours, if known.
    """
    return grown([p], params, None if near is None else [near])[0]


#: Fewer clouds than this grow one after the other.
ABREAST = 12


def grown(clouds: list[np.ndarray], params: PlaneParams = PlaneParams(), near: list[np.ndarray] | None = None) -> list[tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]]:
    """What ``grow`` returns for each cloud. Clouds grow abreast, each at its own next point, until few are left."""
    near = neighbourhoods(clouds, params.plane_k) if near is None else [x[:, : params.plane_k] for x in near]
    out = [(np.zeros(len(p), np.int64), {}, np.zeros(len(p), bool)) for p in clouds]
    # each cloud has all its neighbours then
    whole = [i for i, p in enumerate(clouds) if len(p) > max(params.min_points, params.plane_k, params.normal_k)]
    for i, p in enumerate(clouds):
        if len(p) > params.min_points and i not in whole:
            _grow_on(Growth(p, near[i], *spread(p, near[i][:, : params.normal_k]), params), out[i], params)
    if not whole:
        return out
    n = np.array([len(clouds[i]) for i in whole])
    base = np.cumsum(n) - n
    p, around = np.concatenate([clouds[i] for i in whole]), np.concatenate([near[i] + b for i, b in zip(whole, base)])
    normal, rough = spread(p, around[:, : params.normal_k])
    parts = [slice(b, b + m) for b, m in zip(base, n)]
    lanes = [Growth(clouds[i], near[i], normal[s], rough[s], params) for i, s in zip(whole, parts)]
    if len(whole) >= ABREAST:
        _grow_abreast(lanes, [out[i] for i in whole], p, around, normal, base, params)
    for g, i in zip(lanes, whole):
        _grow_on(g, out[i], params)
    return out


class Growth:
    """How far the regions of one cloud have grown."""

    def __init__(self, p: np.ndarray, near: np.ndarray, normal: np.ndarray, rough: np.ndarray, params: PlaneParams):
        self.p, self.near, self.normal = p, near, normal
        self.order = np.lexsort((np.arange(len(p)), rough)).tolist()
        self.seed, self.free = 0, np.ones(len(p), bool)
        # sums of products lose less around the middle
        self.middle = p.mean(0)
        shifted = p - self.middle
        self.terms = np.column_stack([shifted, shifted[:, [0, 0, 0, 1, 1, 2]] * shifted[:, [0, 1, 2, 1, 2, 2]]])
        # the region at hand: its points, how many of these are done, sums and plane
        self.members: list[int] = []
        self.done, self.sums, self.plane = 0, [0.0] * 9, [0.0] * 4


def _settle(g: Growth, members: np.ndarray, out: tuple[np.ndarray, dict[int, np.ndarray], np.ndarray], params: PlaneParams) -> None:
    """Name the points of a region that is large enough."""
    label, planes, wall = out
    plane = least_squares(g.p[members])
    if abs(plane[2]) < params.wall:
        wall[members] = True
        return
    planes[len(planes) + 1] = plane
    label[members] = len(planes)


def _grow_abreast(lanes: list[Growth], out: list, p: np.ndarray, around: np.ndarray, normal: np.ndarray, base: np.ndarray, params: PlaneParams) -> None:
    """Regions of all clouds at once, as ``_grow_on`` grows them, until fewer than ``ABREAST`` clouds have seeds; indices are those of the clouds in a row."""
    far, least, every = params.epsilon**2, params.normal_thres, params.n_refit
    x, y, z = p.T.copy()
    nx, ny, nz = normal.T.copy()
    terms, free = np.concatenate([g.terms for g in lanes]), np.ones(len(p), bool)
    middle = np.array([g.middle for g in lanes])
    seeds = [(np.array(g.order) + b) for g, b in zip(lanes, base)]
    line = np.zeros(len(p), np.int64)  # each cloud's members
    head, tail = base.copy(), base.copy()
    plane, sums = np.zeros((4, len(lanes))), np.zeros((len(lanes), 9))
    live = np.arange(len(lanes))

    def ended(these: np.ndarray) -> list[int]:
        """Settle regions that have no point left, and give their clouds the next seeds; clouds without any."""
        over, first, whose = [], [], []
        for i in these.tolist():
            b, e = int(base[i]), int(tail[i])
            if 0 < e - b < params.min_points:
                free[line[b:e]] = True
            elif e > b:
                _settle(lanes[i], line[b:e] - b, out[i], params)
            order, at = seeds[i], lanes[i].seed
            while at < len(order):
                some = free[order[at : at + 64]]
                step = int(some.argmax())
                if some[step]:
                    at += step
                    break
                at += 64
            lanes[i].seed = at + 1
            head[i] = tail[i] = b
            if at >= len(order):
                over.append(i)
                continue
            whose.append(i)
            first.append(order[at])
        if whose:
            w, s = np.array(whose), np.array(first)
            tail[w] += 1
            line[base[w]] = s
            free[s] = False
            sums[w] = terms[s]
            plane[:3, w] = normal[s].T
            # as one product for each, so that the last bit is that of a cloud alone
            plane[3, w] = [float(-normal[a] @ p[a]) for a in first]
        return over

    over = ended(live)
    live = np.setdiff1d(live, over)
    while len(live) >= ABREAST:
        i = line[head[live]]
        head[live] += 1
        to = around[i]
        a, b, c, d = plane[:, live, None]
        off = x[to] * a + y[to] * b + z[to] * c + d
        fits = free[to] & (off * off < far) & (np.abs(nx[to] * a + ny[to] * b + nz[to] * c) > least)
        n = fits.sum(1)
        got = np.flatnonzero(n)
        if len(got):
            own, fits, n = live[got], fits[got], n[got]
            new = to[got][fits]
            free[new] = False
            first = np.cumsum(n) - n
            lane = np.repeat(np.arange(len(got)), n)
            within = np.arange(len(new)) - first[lane]
            old = tail[own] - base[own]
            line[tail[own][lane] + within] = new
            tail[own] += n
            # sums add up one point after the other
            added = np.zeros((len(got), int(n.max()) + 1, 9))
            added[:, 0] = sums[own]
            added[lane, within + 1] = terms[new]
            added = np.cumsum(added, axis=1)
            sums[own] = added[:, -1]
            # only the last fit of several counts
            upto = (old + n) // every * every
            fit = np.flatnonzero(upto > old)
            if len(fit):
                m, at = upto[fit], own[fit]
                sx, sy, sz, sxx, sxy, sxz, syy, syz, szz = added[fit, m - old[fit]].T
                mx, my, mz = sx / m, sy / m, sz / m
                a, b, c = flattests(sxx - sx * mx, sxy - sx * my, sxz - sx * mz, syy - sy * my, syz - sy * mz, szz - sz * mz)
                plane[:3, at] = a, b, c
                plane[3, at] = -(a * (mx + middle[at, 0]) + b * (my + middle[at, 1]) + c * (mz + middle[at, 2]))
        idle = live[head[live] == tail[live]]
        if len(idle):
            over = ended(idle)
            if over:
                live = np.setdiff1d(live, over)
    for i, g in enumerate(lanes):
        b, m = int(base[i]), len(g.p)
        g.free = free[b : b + m]
        g.members, g.done = (line[b : tail[i]] - b).tolist(), int(head[i] - b)
        g.sums, g.plane = sums[i].tolist(), plane[:, i].tolist()


def _grow_on(g: Growth, out: tuple[np.ndarray, dict[int, np.ndarray], np.ndarray], params: PlaneParams) -> None:
    """Grow what is left of one cloud's regions."""
    free, far, least = g.free.tolist(), params.epsilon**2, params.normal_thres
    if not g.members and g.seed >= len(free):
        return
    at, way, around, terms, middle = g.p.tolist(), g.normal.tolist(), g.near.tolist(), g.terms.tolist(), g.middle.tolist()
    members, done = g.members, g.done
    (a, b, c, d), (sx, sy, sz, sxx, sxy, sxz, syy, syz, szz) = g.plane, g.sums
    while True:
        if not members:
            while g.seed < len(free) and not free[g.order[g.seed]]:
                g.seed += 1
            if g.seed >= len(free):
                return
            seed = g.order[g.seed]
            g.seed += 1
            (a, b, c), d, members, done = way[seed], float(-g.normal[seed] @ g.p[seed]), [seed], 0
            free[seed] = False
            sx, sy, sz, sxx, sxy, sxz, syy, syz, szz = terms[seed]
        while done < len(members):
            fits = []
            for i in around[members[done]]:
                if free[i]:
                    x, y, z = at[i]
                    u, v, w = way[i]
                    off = x * a + y * b + z * c + d
                    if off * off < far and abs(u * a + v * b + w * c) > least:
                        fits.append(i)
            done += 1
            for i in fits:
                free[i] = False
                members.append(i)
                x, y, z, xx, xy, xz, yy, yz, zz = terms[i]
                sx, sy, sz, sxx, sxy, sxz, syy, syz, szz = sx + x, sy + y, sz + z, sxx + xx, sxy + xy, sxz + xz, syy + yy, syz + yz, szz + zz
                if len(members) % params.n_refit == 0:
                    n = len(members)
                    mx, my, mz = sx / n, sy / n, sz / n
                    a, b, c = flattest(sxx - sx * mx, sxy - sx * my, sxz - sx * mz, syy - sy * my, syz - sy * mz, szz - sz * mz)
                    d = -(a * (mx + middle[0]) + b * (my + middle[1]) + c * (mz + middle[2]))
        if len(members) < params.min_points:
            for i in members:
                free[i] = True
        else:
            _settle(g, np.array(members), out, params)
        members, done = [], 0


def adjacency(p: np.ndarray, label: np.ndarray, k: int = 15, near: np.ndarray | None = None) -> dict[tuple[int, int], int]:
    """Pairs ``(higher, lower)`` of planes with the number of neighbours that cross between them."""
    own = np.repeat(label, min(k, max(len(p) - 1, 0)))
    other = label[neighbours(p, k) if near is None else near[:, :k]].ravel()
    cross = (own > 0) & (other > 0) & (own != other)
    pairs, counts = np.unique(np.stack([np.maximum(own, other)[cross], np.minimum(own, other)[cross]]), axis=1, return_counts=True)
    return {(int(a), int(b)): int(c) for a, b, c in zip(*pairs, counts, strict=True)}


def crossing(p: np.ndarray, a: np.ndarray, q: np.ndarray, b: np.ndarray, distance: float = 1.0, least: float = 0.0) -> np.ndarray | None:
    """The segment where planes ``a`` and ``b`` cross, from the later start to the earlier end of both clouds' points near the line."""
    way = np.cross(a[:3], b[:3])
    size = np.sqrt(way @ way)
    if size < 1e-9:
        return None
    way /= size
    base = np.linalg.solve(np.stack([a[:3], b[:3], way]), [-a[3], -b[3], 0.0])
    ends = []
    for cloud in (p, q):
        d = cloud - base
        along = d @ way
        near = along[(d * d).sum(1) - along**2 < distance**2]
        if len(near) < 2:
            return None
        ends.append((near.min(), near.max()))
    s = base + np.array([max(e[0] for e in ends), min(e[1] for e in ends)])[:, None] * way
    long2 = ((s[1] - s[0]) ** 2).sum()
    return s if long2 > max(1e-10, least**2) else None


def roof_type(planes: dict[int, np.ndarray], label: np.ndarray, horizontal: float = 0.97) -> str:
    """What the planes make of a roof."""
    if not len(label):
        return "no points"
    if not planes:
        return "no planes"
    level = [i for i, plane in planes.items() if plane[2] > horizontal]
    if len(planes) == 1 and level:
        return "horizontal"
    share = np.isin(label, level).sum() / max((label > 0).sum(), 1)
    return "multiple horizontal" if share > 0.95 else "slanted"
