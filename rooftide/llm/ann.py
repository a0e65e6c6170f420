"""Approximate nearest neighbours by cross-polytope hashing.

A polytope's hash of a unit vector is the nearest signed axis after a fast
pseudo-rotation: three rounds of random signs and a Hadamard transform. A
table's hash joins those of one polytope or of several. Each vector stands in
one bucket of each table; a query probes the nearest buckets of each table, and
all vectors there are reranked with exact cosines in double precision. Ties go
to the smaller id.

The number of polytopes and of probes is measured, not guessed: the true
neighbours of ``ASKED`` queries are found by brute force over all vectors (one
pass), and of all settings that meet ``GOAL`` of them the one that ranks the
least share of pairs is taken. More polytopes are weighed the more vectors
there are, so that the share can fall as the table grows. Queries for which the
tables give fewer rows than asked for are then ranked against all rows.

The queries are taken in blocks (``BLOCK`` numbers, a bound that does not grow),
one after the other: each is broadcast, one pass over all vectors serves it,
every task keeps ``k`` rows a query, the block's result is written, and the
broadcast is dropped. No vector is shuffled.

Vectors are scaled by a power of two before they are squared, which leaves the
cosine as it is, so that large and small components neither overflow nor vanish.

Defined cases: vectors that are null, zero, or hold null or non-finite values
take no part, nor do those with another length than a query; a query with too
few candidates gets what there is; rows that share the query's id are its own
row; repeated rows count once; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rooftide.llm.shared import materialize

TABLES, ASKED, GOAL, SAMPLE, BLOCK = 24, 64, 0.99, 1024, 1 << 20
#: Pairs of a query and a vector looked at together.
PAIRS = 1 << 22
VALID = (
    "{c} IS NOT NULL AND NOT exists({c}, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))"
    " AND exists({c}, x -> x <> 0)"
)


def matrix(col: pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros((0, 0))
    return np.asarray(col.flatten(), np.float64).reshape(len(col), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings the largest component near 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def transformed(y: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform; the rows' length is a power of two."""
    n = y.shape[1]
    for s in np.random.default_rng(1000 + seed).choice([-1.0, 1.0], (3, n)):
        y = y * s
        h = 1
        while h < n:
            y = y.reshape(len(y), n // (2 * h), 2, h)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(y), n)
            h *= 2
    return y


@lru_cache(maxsize=512)
def rotation(n: int, dims: int, seed: int) -> np.ndarray:
    return transformed(np.eye(dims, n), seed)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Fast pseudo-rotation of rows, padded to a power of two; short rows take one product with its matrix."""
    n = 1 << max(0, int(x.shape[1] - 1).bit_length())
    if n <= 128:
        return x @ rotation(n, x.shape[1], seed)
    return transformed(np.pad(x, ((0, 0), (0, n - x.shape[1]))), seed)


def both_signs(x: np.ndarray, table: int, polytope: int) -> np.ndarray:
    """How far each row goes along each signed axis."""
    y = rotated(x, table * 64 + polytope)
    return np.stack([y, -y], axis=2).reshape(len(y), -1)


def buckets(x: np.ndarray, table: int, polytopes: int) -> np.ndarray:
    """The bucket of each row."""
    code = np.zeros(len(x), np.int64)
    for p in range(polytopes):
        y = both_signs(x, table, p)
        code = code * y.shape[1] + np.argmax(y, axis=1)
    return code


def probes(x: np.ndarray, table: int, polytopes: int, count: int) -> np.ndarray:
    """The ``count`` nearest buckets of each row, by the squared shortfalls along their axes.

    Of two sorted lists the sum of places i and j is among the ``count`` least only if i times j (from 1) is at most that.
    """
    out = []
    for a in range(0, max(len(x), 1), 256):
        short, code = np.zeros((len(x[a : a + 256]), 1)), np.zeros((len(x[a : a + 256]), 1), np.int64)
        for p in range(polytopes):
            y = both_signs(x[a : a + 256], table, p)
            miss = (y.max(axis=1, keepdims=True) - y) ** 2
            near = np.argsort(miss, axis=1, kind="stable")[:, :count]
            i, j = np.nonzero(np.arange(1, short.shape[1] + 1)[:, None] * np.arange(1, near.shape[1] + 1) <= count)
            short = short[:, i] + np.take_along_axis(miss, near, 1)[:, j]
            code = code[:, i] * y.shape[1] + near[:, j]
            keep = np.argsort(short, axis=1, kind="stable")[:, :count]
            short, code = np.take_along_axis(short, keep, 1), np.take_along_axis(code, keep, 1)
        out.append(code)
    return np.concatenate(out)


def best(q: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ``k`` best distinct ids of each query: highest score, then smallest id."""
    order = np.lexsort((ids, -s, q))
    # an id occurs again only with an equal score, or as a repeated id: its best place counts
    seen = np.lexsort((np.arange(len(q)), ids[order], q[order]))
    head = np.ones(len(q), bool)
    head[1:] = (q[order][seen][1:] != q[order][seen][:-1]) | (ids[order][seen][1:] != ids[order][seen][:-1])
    keep = np.zeros(len(q), bool)
    keep[seen[head]] = True
    order = order[keep]
    start = np.searchsorted(q[order], q[order])
    order = order[np.arange(len(order)) - start < k]
    return q[order], ids[order], s[order], *(m[order] for m in more)


class Index:
    """The probes of a block of unit queries; ``polytopes`` 0 stands for all rows."""

    def __init__(self, unit: np.ndarray, polytopes: int, count: int):
        self.n, self.polytopes, self.tables = len(unit), polytopes, []
        for t in range(TABLES if polytopes else 0):
            code = probes(unit, t, polytopes, count)
            owner, flat = np.repeat(np.arange(len(unit)), code.shape[1]), code.ravel()
            order = np.argsort(flat, kind="stable")
            self.tables.append((owner[order], flat[order]))

    def met(self, unit: np.ndarray) -> np.ndarray:
        """Which queries (rows) meet which of the vectors (columns)."""
        out = np.full((self.n, len(unit)), not self.polytopes)
        for t, (owner, codes) in enumerate(self.tables):
            code = buckets(unit, t, self.polytopes)
            lo = np.searchsorted(codes, code, side="left")
            n = np.searchsorted(codes, code, side="right") - lo
            at = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
            out[owner[at], np.repeat(np.arange(len(unit)), n)] = True
        return out


class Searcher:
    """A block of queries with its index."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, polytopes: int, count: int):
        self.ids, self.k = ids, k
        self.x = scaled(x)
        self.norm = norms(self.x)
        self.unit = self.x / self.norm[:, None]
        self.index = Index(self.unit, polytopes, count)

    def search(self, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Queries, ids, scores and places of the best rows of ``x``."""
        found, step = [], max(64, PAIRS // max(len(self.ids), 1))
        for a in range(0, len(x), step):
            y = scaled(x[a : a + step])
            norm = norms(y)
            unit, own = y / norm[:, None], ids[a : a + step]
            met = self.index.met(unit) & (self.ids[:, None] != own[None, :])
            if met.mean() > 1 / 16:
                s = np.where(met, self.unit @ unit.T, -2)
                least = np.partition(s, -self.k, axis=1)[:, -self.k] if len(y) > self.k else np.full(len(s), -1.5)
                q, c = np.nonzero((s >= least[:, None] - 1e-9) & met)  # ties all stay for now
            else:
                q, c = np.nonzero(met)
            s = np.concatenate([np.zeros(0)] + [np.einsum("ij,ij->i", self.x[q[i : i + 65536]], y[c[i : i + 65536]]) for i in range(0, len(q), 65536)])
            found.append(best(q, own[c], s / (self.norm[q] * norm[c]), self.k, c + a))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        return best(*(np.concatenate(f) for f in list(zip(*found, strict=True))[:3]), self.k, np.concatenate([f[3] for f in found]))


def setting(asked: np.ndarray, owner: np.ndarray, near: np.ndarray, sample: np.ndarray, n: int) -> tuple[int, int]:
    """Polytopes and probes: of what meets ``GOAL`` of the true neighbours what ranks the fewest rows of the sample.

    ``near[i]`` is a neighbour of ``asked[owner[i]]``; all are unit vectors.
    """
    axes = 2 << max(0, int(asked.shape[1] - 1).bit_length())
    choices = []
    for polytopes in range(1, max(1, int(np.ceil(np.log(max(n, 2)) / np.log(axes)))) + 1):
        count = 1
        while True:
            index = Index(asked, polytopes, count)
            if not len(near) or index.met(near)[owner, np.arange(len(near))].mean() >= GOAL:
                choices.append((index.met(sample).mean() + TABLES * count / axes**polytopes / 8, polytopes, count))
                break
            if count >= axes**polytopes or count >= 512:
                break
            count *= 2
    return min(choices)[1:] if choices else (1, axes)


def search(vectors: DataFrame, every: int, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", trace: dict | None = None) -> DataFrame:
    """Returns ``query_id, rank, vec_id, score``: the ``k`` nearest to each row whose id is divisible by ``every``.

    ``trace`` takes the polytopes and probes in use by vector length.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))
    rows = rows.where("id IS NOT NULL AND " + VALID.format(c="v")).withColumn("n", F.size("v"))
    counted = rows.groupBy("n").agg(F.count("*").alias("rows"), F.count_if(F.col("id") % every == 0).alias("asked")).collect()
    schema = "query_id long, vec_id long, score double"
    kept = spark.createDataFrame([], schema)

    def against(own: DataFrame, ids: np.ndarray, x: np.ndarray, shape: tuple[int, int], carried: bool = False) -> tuple[DataFrame, object]:
        ids, first = np.unique(ids, return_index=True)
        block = spark.sparkContext.broadcast((ids, x[first]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, x = block.value
            searcher = Searcher(ids, x, k, *shape)
            held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, x.shape[1])))
            for batch in batches:
                if batch.num_rows:
                    own, v = batch.column("id").to_numpy(), matrix(batch.column("v"))
                    q, c, s, at = searcher.search(own, v)
                    held = best(*(np.concatenate(p) for p in zip(held[:3], (q, c, s), strict=True)), k, np.concatenate([held[3], v[at] if carried else np.zeros((len(at), x.shape[1]))]))
            out = {"query_id": ids[held[0]], "vec_id": held[1], "score": held[2]}
            yield pa.RecordBatch.from_pydict(out | ({"v": pa.array(list(held[3]), pa.list_(pa.float64()))} if carried else {}))

        return own.select("id", "v").mapInArrow(run, schema + (", v array<double>" if carried else "")), block

    for n, total, count in sorted((r.n, r["rows"], r["asked"]) for r in counted if r["asked"]):
        own = rows.where(F.col("n") == n)
        asked = own.where(F.col("id") % every == 0)
        few = asked.orderBy(F.xxhash64("id"), "id").limit(ASKED).select("id", "v").toArrow()
        true, block = against(own, few.column("id").to_numpy(), matrix(few.column("v")), (0, 0), True)
        true = true.toArrow()
        block.destroy()
        held = np.unique(few.column("id").to_numpy())
        q, _, _, at = best(np.searchsorted(held, true.column("query_id").to_numpy()), true.column("vec_id").to_numpy(), true.column("score").to_numpy(), k, np.arange(true.num_rows))
        sample = own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
        unit = [u / norms(u)[:, None] for u in (scaled(matrix(t.column("v"))) for t in (few, true, sample)) if len(u)]
        first = np.unique(few.column("id").to_numpy(), return_index=True)[1]
        shape = setting(unit[0][first], q, unit[1][at], unit[-1], total) if true.num_rows else (1, 1)
        if trace is not None:
            trace[n] = shape
        size = max(256, BLOCK // n)
        blocks = -(-count // (size * 3 // 4))
        for b in range(blocks):
            part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "v").toArrow()
            if part.num_rows == 0:
                continue
            ids, x = part.column("id").to_numpy(), matrix(part.column("v"))
            out, block = against(own, ids, x, shape)
            out = materialize(out)
            block.destroy()
            full = out.groupBy("query_id").agg(F.countDistinct("vec_id").alias("c")).where(F.col("c") >= k).select("query_id").toArrow()
            short = ~np.isin(ids, full.column("query_id").to_numpy())
            if short.any():
                rest, block = against(own, ids[short], x[short], (0, 0))
                out = out.unionByName(materialize(rest))
                block.destroy()
            kept = kept.unionByName(out)
    out = kept.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_column), "score")
