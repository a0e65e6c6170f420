"""Labels of least energy by alpha expansion, each move a minimum cut."""

from __future__ import annotations

from collections import deque

import numpy as np


class Network:
    """A flow network for one minimum cut, by levels and blocking flows."""

    def __init__(self, n: int):
        self.head: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def add(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        self.head[a].append(len(self.to))
        self.to.append(b)
        self.room.append(there)
        self.head[b].append(len(self.to))
        self.to.append(a)
        self.room.append(back)

    def source_side(self, s: int, t: int, least: float = 1e-10) -> list[bool]:
        """Which nodes stay on the source's side of a minimum cut."""
        while True:
            level = [-1] * len(self.head)
            level[s] = 0
            queue = deque([s])
            while queue:
                a = queue.popleft()
                for e in self.head[a]:
                    if self.room[e] > least and level[self.to[e]] < 0:
                        level[self.to[e]] = level[a] + 1
                        queue.append(self.to[e])
            if level[t] < 0:
                return [x >= 0 for x in level]
            at, path, a = [0] * len(self.head), [], s
            while True:
                if a == t:
                    flow = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= flow
                        self.room[e ^ 1] += flow
                    cut = next(i for i, e in enumerate(path) if self.room[e] <= least)
                    a = self.to[path[cut] ^ 1]
                    path = path[:cut]
                    continue
                while at[a] < len(self.head[a]):
                    e = self.head[a][at[a]]
                    if self.room[e] > least and level[self.to[e]] == level[a] + 1:
                        break
                    at[a] += 1
                else:
                    if a == s:
                        break
                    level[a] = -1
                    a = self.to[path.pop() ^ 1]
                    continue
                path.append(e)
                a = self.to[e]


def energy(label: np.ndarray, data: np.ndarray, pairs: dict[tuple[int, int], float]) -> float:
    return float(data[np.arange(len(label)), label].sum()) + sum(w for (a, b), w in pairs.items() if label[a] != label[b])


def expanded(data: np.ndarray, pairs: dict[tuple[int, int], float], rounds: int = 3, label: np.ndarray | None = None) -> np.ndarray:
    """Labels (rows of ``data``: faces, columns: labels) with data costs and costs of pairs that differ.

    A fixed number of rounds; in each, every label in turn may take any faces over, where that lowers the energy.
    """
    n, labels = data.shape
    label = np.argmin(data, axis=1) if label is None else label.copy()
    for _ in range(rounds):
        for alpha in range(labels):
            net = Network(n + 2)
            s, t = n, n + 1
            keep, take = data[np.arange(n), label].tolist(), data[:, alpha].tolist()
            for (a, b), w in pairs.items():
                both, only_b, only_a = w * (label[a] != label[b]), w * (label[a] != alpha), w * (label[b] != alpha)
                # what the pair costs if neither, only b or only a takes alpha: two terms of one face, and one of a keeping and b taking
                take[a] += only_a - both
                take[b] -= only_a
                net.add(a, b, only_b + only_a - both)
            # faces on the source's side keep their labels
            for f in range(n):
                low = min(keep[f], take[f])
                net.add(s, f, take[f] - low)
                net.add(f, t, keep[f] - low)
            stays = net.source_side(s, t)
            new = np.where(stays[:n], label, alpha)
            if energy(new, data, pairs) < energy(label, data, pairs) - 1e-10:
                label = new
    return label
