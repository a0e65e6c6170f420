"""Near points, links and windows within one feature, as the SQL of ``plans.surfaces`` defines them.

Points are sorted by x. A block of them is compared with those of a strip around it only, which is widened until nothing
beyond can matter, so memory is bounded by the block and not by the feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import pow

import numpy as np

#: Numbers in one table of distances.
MOST = 1 << 20
#: What counts as within a strip, as its ends are rounded.
NEARLY = 1 - 1e-9


def squared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of every two points, summed in the order of the axes."""
    d = p[:, None, 0] - q[None, :, 0]
    out = d * d
    for k in (1, 2):
        d = p[:, None, k] - q[None, :, k]
        out += d * d
    return out


def strips(p: np.ndarray, q: np.ndarray, reach: float) -> Iterator[tuple[slice, slice]]:
    """Blocks of ``p`` with the part of ``q`` within ``reach`` along x; both are sorted by x."""
    a = 0
    while a < len(p):
        lo = np.searchsorted(q[:, 0], p[a, 0] - reach, "left")
        b, most = a + 1, max(1, min(len(p) - a, 4096))
        for size in (most, most // 4, most // 16, most // 64):
            if size > 1:
                hi = np.searchsorted(q[:, 0], p[a + size - 1, 0] + reach, "right")
                if size * (hi - lo) <= MOST:
                    b = a + size
                    break
        yield slice(a, b), slice(int(lo), int(np.searchsorted(q[:, 0], p[b - 1, 0] + reach, "right")))
        a = b


def settled(p: np.ndarray, q: np.ndarray, reach: float, answer) -> None:
    """``answer(rows, columns, distances)`` for all of ``p``, which says how far out each row's answer lies; those beyond the strip are asked again in a wider one."""
    left, whole = np.arange(len(p)), float(max(np.ptp(np.append(p[:, 0], q[:, 0])), 1.0)) if len(q) else 0.0
    while len(left) and len(q):
        # a feature that fits one table needs no strips
        reach = whole if len(left) * len(q) <= MOST else min(reach, whole)
        again = []
        for rows, columns in strips(p[left], q, reach):
            far = answer(left[rows], columns, squared(p[left[rows]], q[columns]))
            if reach < whole:
                again.append(left[rows][far > (reach * NEARLY) ** 2])
        left, reach = np.concatenate(again) if again else left[:0], 2 * reach


def adjacency(p: np.ndarray, label: np.ndarray, k: int = 15) -> dict[tuple[int, int], int]:
    """Pairs ``(higher, lower)`` of labels with the number of neighbours of the other label among the ``k`` nearest of each labelled point.

    Label 0 is none. Equal distances go to the smaller coordinates, then labels; rows are distinct.
    """
    order = np.lexsort((label, p[:, 2], p[:, 1], p[:, 0]))
    p, label = p[order], label[order]
    names, place = np.unique(label, return_inverse=True)
    count = np.zeros((len(names), len(names)), np.int64)
    seek = np.flatnonzero(label != 0)

    def nearest(rows: np.ndarray, columns: slice, d: np.ndarray) -> np.ndarray:
        own = seek[rows] - columns.start
        d[np.arange(len(rows)), own] = np.inf
        if d.shape[1] > k:
            far = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
            taken, tie = d < far, d == far
            more = k - taken.sum(1, keepdims=True)
            taken |= tie & (np.cumsum(tie, axis=1) <= more)
            far = far[:, 0]
        else:
            taken, far = np.isfinite(d), np.full(len(rows), np.inf)
        done = far <= limit[0] ** 2
        i, j = np.nonzero(taken[done])
        np.add.at(count, (place[seek[rows[done]][i]], place[columns.start + j]), 1)
        return far

    limit = [np.inf]
    _settle_counts(p, seek, nearest, limit)
    out: dict[tuple[int, int], int] = {}
    for i, j in zip(*np.nonzero(count)):
        a, b = int(names[i]), int(names[j])
        if a != b and b != 0:
            out[max(a, b), min(a, b)] = out.get((max(a, b), min(a, b)), 0) + int(count[i, j])
    return out


def _settle_counts(p: np.ndarray, seek: np.ndarray, nearest, limit: list[float], reach: float = 2.0) -> None:
    """Like ``settled`` for answers that add up: a row counts once, at the strip that settles it."""
    left, whole = np.arange(len(seek)), float(max(np.ptp(p[:, 0]), 1.0)) if len(p) else 0.0
    while len(left):
        reach = whole if len(left) * len(p) <= MOST else min(reach, whole)
        limit[0] = np.inf if reach >= whole else reach * NEARLY
        again = []
        for rows, columns in strips(p[seek[left]], p, reach):
            far = nearest(left[rows], columns, squared(p[seek[left[rows]]], p[columns]))
            again.append(left[rows][far > limit[0] ** 2])
        left, reach = np.concatenate(again), 2 * reach


def nearest_squared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distance of each point of ``p`` to the nearest of ``q``, which has one at least."""
    order, q = np.argsort(p[:, 0], kind="stable"), q[np.argsort(q[:, 0], kind="stable")]
    out = np.full(len(p), np.inf)

    def least(rows: np.ndarray, columns: slice, d: np.ndarray) -> np.ndarray:
        out[order[rows]] = d.min(1, initial=np.inf)
        return out[order[rows]]

    settled(p[order], q, 4.0, least)
    return out


def clusters(p: np.ndarray, spacing: float) -> np.ndarray:
    """The least index that links of at most ``spacing`` reach from each point; points are sorted by x."""
    a, b = [], []
    for rows, columns in strips(p, p, spacing):
        i, j = np.nonzero(squared(p[rows], p[columns]) <= spacing * spacing)
        i, j = i + rows.start, j + columns.start
        a.append(i[i < j])
        b.append(j[i < j])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    label = np.arange(len(p))
    while len(a):
        least = label.copy()
        low = np.minimum(label[a], label[b])
        # only roots move, and their members with them: links within a cluster needn't be kept
        for at in (label[a], label[b]):
            np.minimum.at(least, at, low)
        while (least[least] != least).any():
            least = least[least]
        if (least == label).all():
            break
        label = least
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def window_least(col: np.ndarray, row: np.ndarray, z: np.ndarray, before: int = 5, after: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells from 0 to the last written column and row with a written one from ``before`` cells before to ``after`` after on both axes: their least height, and whether they aren't written."""
    c0, r0 = min(int(col.min()), 0), min(int(row.min()), 0)
    own = np.full((int(col.max()) - c0 + 1, int(row.max()) - r0 + 1), np.inf)
    own[col - c0, row - r0] = z
    least = own
    for axis in (0, 1):
        wide = np.pad(least, [(before, after) if k == axis else (0, 0) for k in (0, 1)], constant_values=np.inf)
        n = least.shape[axis]
        least = np.min([np.take(wide, range(s, s + n), axis=axis) for s in range(before + after + 1)], axis=0)
    own, least = own[-c0:, -r0:], least[-c0:, -r0:]
    c, r = np.nonzero(np.isfinite(least))
    empty = np.isinf(own[c, r])
    return c, r, np.where(empty, least[c, r], own[c, r]), empty


def to_triangles(p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest triangle of each point, the first of equal ones, and the squared distance.

    Points on the bisector of two triangles go by the last bit, so where distances nearly agree, squares are those of
    libm's ``pow`` as in DuckDB, which isn't always the rounded product.
    """
    x, y, z = p.T[:, :, None]
    c = [[t[None, :, k, a] for a in range(3)] for k in range(3)]
    e, f = [c[1][a] - c[0][a] for a in range(3)], [c[2][a] - c[0][a] for a in range(3)]
    n = [e[1] * f[2] - e[2] * f[1], e[2] * f[0] - e[0] * f[2], e[0] * f[1] - e[1] * f[0]]
    size = n[0] * n[0] + n[1] * n[1] + n[2] * n[2]
    q = (x, y, z)
    up = (x - c[0][0]) * n[0] + (y - c[0][1]) * n[1] + (z - c[0][2]) * n[2]
    over, offs = np.ones(up.shape, bool), []
    for a, b in ((0, 1), (1, 2), (2, 0)):
        d, w = [c[b][i] - c[a][i] for i in range(3)], [q[i] - c[a][i] for i in range(3)]
        over &= (d[1] * w[2] - d[2] * w[1]) * n[0] + (d[2] * w[0] - d[0] * w[2]) * n[1] + (d[0] * w[1] - d[1] * w[0]) * n[2] >= 0
        along = np.minimum(np.maximum((w[0] * d[0] + w[1] * d[1] + w[2] * d[2]) / (d[0] * d[0] + d[1] * d[1] + d[2] * d[2]), 0.0), 1.0)
        offs.append([w[i] - along * d[i] for i in range(3)])
    sides = np.min([o[0] * o[0] + o[1] * o[1] + o[2] * o[2] for o in offs], axis=0)
    exact = np.where(over, up * up / size, sides)
    for i, j in zip(*np.nonzero(exact <= exact.min(1, keepdims=True) * (1 + 1e-12))):
        exact[i, j] = pow(up[i, j], 2) / size[0, j] if over[i, j] else min(pow(o[0][i, j], 2) + pow(o[1][i, j], 2) + pow(o[2][i, j], 2) for o in offs)
    best = np.argmin(exact, axis=1)
    return best, exact[np.arange(len(p)), best]
