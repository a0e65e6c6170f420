"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Rotations learned on a bounded sample (``SAMPLE`` vectors, those with the
smallest hash of their id) turn centred unit vectors into balanced binary
codes. A code is cut into pieces; each piece indexes one table, and vectors
that agree on a piece meet. The pieces' bits grow with the logarithm of the
number of vectors, so buckets keep their size. Centring widens the angle of
vectors that share a mean, so the number of tables comes from pairs at the
threshold made from the sample: of the ``LEAST`` share of them whose centred
angles are the widest, ``MEET`` at least must meet, by angle and then counted
with the codes in use. Where that asks for many tables, shorter pieces are
taken if they cost less, down to none: then all pairs are compared.

Codes are dealt to the tables first. In each bucket a vector stays only if
another's code lies within a Hamming radius, which all made pairs keep and a
tenth more; of those that stay, the vectors follow and are reranked by cosine
in double precision, so nothing below the threshold links. Vectors without
anything near are thus shuffled as codes only.

Equal vectors form classes first and count by their number. A pair is counted
only in the first table where it meets. Buckets of at most ``BUCKET`` classes
are worked through in sorted order; larger ones are cut into parts and each
pair of parts is a task of its own. Tasks give counts and a spanning forest of
the links, never the pairs.

Vectors of each length are fitted and indexed on their own, as vectors of two
lengths never link. They are scaled by a power of two before they are squared,
so that large and small components neither overflow nor vanish.

Defined cases: vectors that are null, zero, or hold null or non-finite values
link with nothing; rows with a null id have no component; repeated rows are vectors of their own that
share a node; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rooftide.llm.ann import VALID, matrix, norms, scaled
from rooftide.llm.jaccard import forest
from rooftide.llm.shared import connected_components, join_hot, materialize

SAMPLE, ROUNDS, MEET, BUCKET = 10_000, 30, 0.995, 1024
#: The share of made pairs that must meet as well, tables before shorter pieces are weighed, and what a row in a table costs in compared pairs.
LEAST, MANY, ROW = 0.1, 32, 256


def made(x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors at the threshold: each of ``x`` with one in a random direction, and with one towards another of ``x``."""
    rng = np.random.default_rng(7)
    a, g = np.concatenate([x, x]), np.concatenate([rng.standard_normal(x.shape), x[rng.permutation(len(x))]])
    g = g - (g * a).sum(1)[:, None] * a
    size = np.sqrt((g * g).sum(1))
    a, g, size = a[size > 1e-6], g[size > 1e-6], size[size > 1e-6]
    return a, threshold * a + np.sqrt(1 - threshold**2) * g / size[:, None]


def widest(a: np.ndarray, b: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs with the widest centred angles, and the share of bits on which each agrees."""
    u, v = a - mean, b - mean
    cos = (u * v).sum(1) / np.maximum(np.sqrt((u * u).sum(1) * (v * v).sum(1)), 1e-300)
    agree = 1 - np.arccos(np.clip(cos, -1, 1)) / np.pi
    worst = np.argsort(agree, kind="stable")[: int(np.ceil(LEAST * len(agree)))]
    return a[worst], b[worst], agree[worst]


def tables_for(agree: np.ndarray, bits: int, most: int) -> int:
    """The least number of tables in which ``MEET`` of the pairs meet, or more than ``most``."""
    apart = 1 - agree**bits
    low, high = 0, 1
    while (apart**high).mean() > 1 - MEET:
        low, high = high, 2 * high
        if low > most:
            return low
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if (apart**mid).mean() > 1 - MEET else (low, mid)
    return high


def cost(n: int, bits: int, tables: int) -> float:
    return tables * (ROW + n / 2**bits)


def shape(n: int, dims: int, agree: np.ndarray) -> tuple[int, int]:
    """Bits of a piece, and tables, for ``n`` vectors; no bits for one table of all."""
    bits = min(int(np.clip(round(np.log2(max(n, 2))) - 4, 6, 24)), dims)
    tables = tables_for(agree, bits, MANY)
    if tables <= MANY:
        return bits, tables
    return min(((b, tables_for(agree, b, ROW + n)) for b in range(bits + 1)), key=lambda s: cost(n, *s))


def fit(x: np.ndarray, n: int, threshold: float) -> tuple[tuple, int, int, int]:
    """Mean and projections, bits, tables and Hamming radius from a sample ``x`` of ``n`` unit vectors."""
    a, b, agree = widest(*made(x, threshold), x.mean(0))
    bits, tables = shape(n, x.shape[1], agree) if len(agree) else (0, 1)
    while bits:
        codes = learn(x, -(-tables // (x.shape[1] // bits)))
        u, v = code(a, *codes, bits, tables), code(b, *codes, bits, tables)
        if (keys_of(u, bits) == keys_of(v, bits)).any(1).mean() >= MEET:
            return codes, bits, tables, int(np.ceil(1.1 * (u != v).sum(1).max()))
        tables += -(-tables // 4)
        if cost(n, bits, tables) > cost(n, 0, 1):
            bits = 0
    return (x.mean(0), []), 0, 1, 0


def learn(x: np.ndarray, codes: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The mean of unit vectors, and ``codes`` projections by principal axes and learned rotation."""
    mean = x.mean(0)
    c = x - mean
    _, axes = np.linalg.eigh(c.T @ c)
    v = c @ axes
    out = []
    for i in range(codes):
        r = np.linalg.qr(np.random.default_rng(77 + i).standard_normal((x.shape[1],) * 2))[0]
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(axes @ r)
    return mean, out


def code(x: np.ndarray, mean: np.ndarray, projections: list[np.ndarray], bits: int, tables: int) -> np.ndarray:
    """The bits of each vector: ``bits`` for each of ``tables``."""
    if not bits:
        return np.zeros((len(x), 0), bool)
    unit = scaled(x)
    unit = unit / norms(unit)[:, None] - mean
    whole = [(unit @ p >= 0)[:, : p.shape[1] // bits * bits] for p in projections]
    return np.concatenate(whole, axis=1)[:, : bits * tables]


def keys_of(bit: np.ndarray, bits: int) -> np.ndarray:
    """The key of each vector in each table."""
    if not bits:
        return np.zeros((len(bit), 1), np.int32)
    return (bit.reshape(len(bit), -1, bits) * (1 << np.arange(bits))).sum(2).astype(np.int32)


def packed(bit: np.ndarray) -> pa.Array:
    """Bits as binary values."""
    flat = np.packbits(bit, axis=1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(flat.shape[1]), len(flat), [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary()) if flat.shape[1] else pa.array([b""] * len(flat), pa.binary())


def unpacked(col: pa.Array, n: int) -> np.ndarray:
    """The ``n`` bits of binary values."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not n:
        return np.zeros((len(col), 0), bool)
    flat = np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1)
    return np.unpackbits(flat, axis=1, count=n).astype(bool)


def near(bit: np.ndarray, radius: int) -> np.ndarray:
    """Which rows have another within the Hamming radius."""
    sign = np.where(bit, np.float32(1), np.float32(-1))
    hit = sign @ sign.T >= bit.shape[1] - 2 * radius
    np.fill_diagonal(hit, False)
    return hit.any(1)


def linked(x: np.ndarray, keys: np.ndarray, table: int, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold and have not met in an earlier table."""
    x = scaled(x)
    norm = norms(x)
    hit = (x @ x.T) / (norm[:, None] * norm[None, :]) >= threshold
    np.fill_diagonal(hit, False)
    if table and hit.any():
        i, j = np.nonzero(hit)
        hit[i, j] = ~(keys[i, :table] == keys[j, :table]).any(1)
    return hit


def runs(batches: Iterator[pa.RecordBatch], held_rows: int) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Rows sorted by table and key, a few buckets at a time, with the ends of each bucket of two rows or more."""
    held = None

    def cut(t: pa.Table):
        table, key = t.column("table").to_numpy(), t.column("key").to_numpy()
        at = np.flatnonzero(np.concatenate([[True], (table[1:] != table[:-1]) | (key[1:] != key[:-1])]))
        return t, [(a, z) for a, z in zip(at, np.append(at[1:], len(key)), strict=True) if z - a > 1]

    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        if held.num_rows > held_rows:
            table, key = held.column("table").to_numpy(), held.column("key").to_numpy()
            last = int(np.flatnonzero((table != table[-1]) | (key != key[-1]))[-1]) + 1 if (table[0], key[0]) != (table[-1], key[-1]) else 0
            if last:
                yield cut(held.slice(0, last))
                held = held.slice(last)
    if held is not None and held.num_rows:
        yield cut(held)


def link(vectors: DataFrame, threshold: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Returns ``id_column, n_links, component_id, kept`` for every row of ``vectors``."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    good = rows.where("id IS NOT NULL AND " + VALID.format(c="v"))
    sizes = sorted(r.n for r in good.select(F.size("v").alias("n")).distinct().collect())
    classes = [materialize(good.where(F.size("v") == n).groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))) for n in sizes]
    if not classes:
        none = "CAST(0 AS BIGINT)"
        return rows.select(F.col("id").alias(id_column), F.expr(none).alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    found = reduce(DataFrame.unionByName, [_links(c, n, threshold) for c, n in zip(classes, sizes, strict=True)])
    classes = reduce(DataFrame.unionByName, classes)
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    links = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    known = classes.join(links, "rep", "left").join(parts, "rep", "left").select(
        "v", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    whole = join_hot(rows, materialize(known), ["v"], "copies", "left")
    return whole.select(
        F.col("id").alias(id_column),
        F.expr("CAST(IF(id IS NULL, 0, coalesce(n_links, 0)) AS BIGINT)").alias("n_links"),
        F.expr("IF(id IS NULL, NULL, coalesce(component_id, id))").alias("component_id"),
        F.expr("id IS NOT NULL AND id = coalesce(component_id, id)").alias("kept"),
    )


def _links(classes: DataFrame, dims: int, threshold: float) -> DataFrame:
    """``id, links, root`` of the classes of one length that link: counts, and edges of a forest."""
    n = classes.count()
    spread = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toArrow()
    x = scaled(matrix(spread.column("v")))
    codes, bits, tables, radius = fit(x / norms(x)[:, None], n, threshold)
    model = classes.sparkSession.sparkContext.broadcast(codes)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bit = code(matrix(batch.column("v")), *model.value, bits, tables)
                keys = keys_of(bit, bits)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), keys.ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns, packed(bit), lists], [*batch.schema.names, "code", "keys"])

    def staying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ends in runs(batches, 16 * BUCKET):
            keep, bit = np.zeros(t.num_rows, bool), unpacked(t.column("code"), bits * tables)
            for a, z in ends:
                keep[a:z] = near(bit[a:z], radius)
            yield from t.select(["table", "key", "rep"]).filter(pa.array(keep)).combine_chunks().to_batches()

    def batch_of(found: list) -> pa.RecordBatch:
        cols = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)]
        return pa.RecordBatch.from_pydict(dict(zip(("id", "links", "root"), (c.astype(np.int64) for c in cols), strict=True)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ends in runs(batches, 4 * BUCKET):
            table, ids, copies = (t.column(c).to_numpy() for c in ("table", "rep", "copies"))
            x, keys, found = matrix(t.column("v")), keys_of(unpacked(t.column("code"), bits * tables), bits), []
            for a, z in ends:
                hit = linked(x[a:z], keys[a:z], int(table[a]), threshold)
                own = np.flatnonzero(hit.any(1))
                if len(own):
                    few, at = hit[np.ix_(own, own)], ids[a:z][own]
                    found.append((at, (few * copies[a:z][own][None, :]).sum(1), at[forest(few)]))
            yield batch_of(found)

    def part(t: pa.Table) -> pa.Table:
        ids, copies, side = (t.column(c).to_numpy() for c in ("rep", "copies", "side"))
        hit = linked(matrix(t.column("v")), keys_of(unpacked(t.column("code"), bits * tables), bits), int(t.column("table")[0].as_py()), threshold)
        if (side == 1).any():
            hit &= side[:, None] != side[None, :]
        if not hit.any():
            return pa.Table.from_batches([batch_of([])])
        return pa.Table.from_batches([batch_of([(ids, (hit * copies[None, :]).sum(1), ids[forest(hit)])])])

    keyed = materialize(classes.mapInArrow(index, "v array<double>, rep long, copies long, code binary, keys array<int>"))
    dealt = keyed.select("rep", "code", F.posexplode("keys").alias("table", "key"))
    big = keyed.select(F.posexplode("keys").alias("table", "key")).groupBy("table", "key").count()
    big = materialize(big.where(F.col("count") > BUCKET).withColumn("parts", F.ceil(F.col("count") / (BUCKET // 2))).drop("count"))
    schema = "id long, links long, root long"
    # of big buckets there are fewer than rows / BUCKET, each a few numbers
    some = dealt.join(big, ["table", "key"], "left_anti").repartition("table", "key").sortWithinPartitions("table", "key")
    stay = some.mapInArrow(staying, "table int, key int, rep long") if bits else some.select("table", "key", "rep")
    own = keyed.select("rep", "v", "copies", "code")
    small = stay.join(own, "rep").repartition("table", "key").sortWithinPartitions("table", "key").mapInArrow(walk, schema)
    cut = dealt.drop("code").join(big, ["table", "key"]).join(own, "rep").withColumn("p", F.expr("pmod(xxhash64(rep), parts)"))
    cut = cut.withColumn("o", F.explode(F.expr("sequence(0L, parts - 1)"))).withColumn("side", F.expr("IF(p > o, 1, 0)"))
    large = cut.groupBy("table", "key", F.least("p", "o").alias("a"), F.greatest("p", "o").alias("b")).applyInArrow(part, schema)
    return materialize(small.unionByName(large))
