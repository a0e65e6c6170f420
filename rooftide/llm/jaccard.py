"""Exact n-gram Jaccard join of documents by blocked sparse products.

Texts are lower-cased (A-Z), cut into words, and turned into sets of ``k``-word
shingles (:func:`rooftide.llm.text.shingle_sets`). Two documents link when
``den * intersection >= num * union``.

1. Texts with equal sets form classes; from here on each class counts once.
2. Candidates. If the smaller of two linked sets has at most ``hi`` elements,
   the sets differ in at most ``d = hi * (den - num) // num`` elements. Deal the
   elements into ``d + 1 + slack`` groups by hash: ``slack + 1`` groups at least
   are equal in both sets. Both documents leave out their ``slack`` least
   groups, by the number of their elements that are not common ones, then by
   size; equal groups rank alike in both, so one remains that both keep. (The
   common elements, counted over all documents, are the most frequent of those
   that several documents of one task share; ``COMMON`` bounds them, and they
   decide only which groups are left out.) Hashes of kept
   groups are the keys under which documents meet; no link can be missed.
   Sizes fall into bands, each with its own ``d``; a document also gives keys
   for a lower band if a smaller partner may lie there.
3. Keys are grouped within each task before the shuffle, so a key shared by very
   many documents arrives as one row per task. Components of the candidate
   graph are families; families are cut into blocks of bounded weight by size
   band and hash, and pairs of blocks whose sizes exclude a link are left out.
   Families of more than ``RECUT`` classes, which may hang together by chains
   of few pairs, are cut by their keys where that gives fewer rows: the classes
   that share a key are a block, and of keys with equal classes one is taken.
4. Each pair of blocks is one sparse product of the document by n-gram
   incidence, run over blocks of columns that add up overlap counts; pairs
   that can no longer reach the bound of their sizes drop out. A block returns
   a spanning forest of its links, never all pairs.
5. Components of these links give the result. Sets that very many documents
   have are given theirs by broadcast (:func:`rooftide.llm.shared.join_hot`).

Defined cases: nulls and texts without words have empty sets and link with
nothing; rows with a null id have no component; rows that share an id count as
one node; repeated rows are returned each; an empty table gives no rows; other
columns of the input are not read. Elements are 64-bit hashes and classes have
128-bit hashes of their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rooftide.llm.shared import connected_components, join_hot, materialize
from rooftide.llm.text import chunks, mix, shingle_sets

_U = np.uint64
#: Documents and shingles that one block should hold.
BLOCK_DOCS, BLOCK_SHINGLES = 384, 1 << 18
#: Documents of one chunk that must share an element for it to be counted, and the most common elements used.
SHARED, COMMON = 4, 1 << 17
#: Documents above which a family may be cut by its keys instead.
RECUT = 8 * BLOCK_DOCS
#: Keys that a task groups at once.
GROUPED_KEYS = 1 << 20


def bands(top: int) -> list[tuple[int, int]]:
    """Size bands ``(lo, hi)`` that grow by half, up to ``top``."""
    out, lo = [], 1
    while lo <= top:
        out.append((lo, max(lo, lo * 3 // 2)))
        lo = out[-1][1] + 1
    return out


def set_hashes(flat: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of sets, as two columns; empty sets have 0."""
    some = np.flatnonzero(np.diff(offs))
    out = np.zeros((2, len(offs) - 1), _U)
    for i, salt in enumerate((31, 32)):
        if len(some):
            out[i, some] = np.add.reduceat(mix(flat, salt), offs[:-1][some])
    return out[0].view(np.int64), out[1].view(np.int64)


def keys(flat: np.ndarray, offs: np.ndarray, num: int, den: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Meeting keys of sets: the keys, and the place of each one's set.

    ``common`` are sorted elements that many sets hold; groups with few others
    are left out first.
    """
    if common is None or not len(common):
        rare = np.ones(len(flat), np.int64)
    else:
        rare = (common[np.minimum(np.searchsorted(common, flat), len(common) - 1)] != flat).astype(np.int64)
    n = np.diff(offs)
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo, hi = (np.array(x, np.int64) for x in zip(*bands(int(n.max())), strict=True))
    out_key, out_set = [], []
    own = np.searchsorted(lo, n, side="right") - 1
    down = 0
    while True:
        # the smallest partner of a set of n has ceil(n * num / den) elements
        docs = np.flatnonzero((n > 0) & (own - down >= 0) & ((down == 0) | (-(-n * num // den) <= hi[np.maximum(own - down, 0)])))
        if down and not len(docs):
            break
        b = own[docs] - down
        d = hi[b] * (den - num) // num
        docs, b, d = docs[d > 0], b[d > 0], d[d > 0]  # where d is 0 only equal sets link
        if len(docs):
            slack = -(-d // 3)
            groups = d + 1 + slack
            size = n[docs]
            at = np.arange(int(size.sum())) + np.repeat(offs[docs] - (np.cumsum(size) - size), size)
            u = flat[at]
            base = np.cumsum(groups) - groups
            g = np.repeat(base, size) + (((u >> _U(32)) * np.repeat(groups, size).astype(_U)) >> _U(32)).astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            total = int(groups.sum())
            count, few, value = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, _U)
            count[g[new]] = np.diff(np.append(new, len(g)))
            few[g[new]] = np.add.reduceat(rare[at], new)
            value[g[new]] = np.add.reduceat(mix(u, 33), new)
            owner = np.repeat(np.arange(len(docs)), groups)
            place = np.arange(total) - base[owner]
            order = np.lexsort((place, count, few, owner))
            kept = order[(np.arange(total) - base[owner]) >= slack[owner]]
            salt = mix((b[owner[kept]].astype(_U) << _U(40)) + place[kept].astype(_U), 34)
            out_key.append(mix(value[kept] + salt, 35))
            out_set.append(docs[owner[kept]])
        down += 1
    if not out_key:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_key).view(np.int64), np.concatenate(out_set)


def grouped(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row for each key, with its smallest node; the others meet that node under a key of their own."""
    if not len(key):
        return key, node
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    least = np.repeat(node[head], np.diff(np.append(np.flatnonzero(head), len(key))))
    rest = least != node
    star = np.unique(np.stack([least[rest], node[rest]]), axis=1)
    pair = mix(mix(star[0].view(_U), 36) + star[1].view(_U), 37).view(np.int64)
    return np.concatenate([key[head], pair, pair]), np.concatenate([node[head], star[0], star[1]])


def linked(sets: list[np.ndarray], num: int, den: int, columns: int = 4096, few: int = 8) -> np.ndarray:
    """Which pairs of sets link, by a sparse incidence product over blocks of columns.

    A column of at most ``few`` rows adds one to each pair of its rows, by their
    codes; denser columns are multiplied as a block of the rows that still hold
    any. After each block, pairs whose count plus the smaller of what both rows
    have left falls short of what their sizes ask for drop out, and rows without
    pairs are read no further.
    """
    n, rows = np.array([len(s) for s in sets], np.int64), len(sets)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    row = np.repeat(np.arange(rows), n)
    _, col, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(df > 1) - 1  # n-grams of one document alone can't overlap
    use = df[col] > 1
    row, col = row[use], shared[col[use]]
    order = np.lexsort((row, col))
    row, col = row[order], col[order]
    need = -(-num * (n[:, None] + n[None, :]) // (num + den))
    left = np.bincount(row, minlength=rows)
    total = np.zeros((rows, rows), np.int64)
    live = (np.minimum(left[:, None], left[None, :]) >= need) & (n > 0)[:, None]
    np.fill_diagonal(live, False)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, columns):
        alive = live.any(1)
        if not alive.any():
            break
        a, z = np.searchsorted(col, [lo, lo + columns])
        r, c = row[a:z], col[a:z] - lo
        left = left - np.bincount(r, minlength=rows)
        r, c = r[alive[r]], c[alive[r]]
        count = np.bincount(c, minlength=columns)
        thin = count[c] <= few
        tr, tc = r[thin], c[thin]
        codes = []
        for d in range(1, few):
            same = np.flatnonzero(tc[d:] == tc[:-d]) if len(tc) > d else np.zeros(0, np.int64)
            if not len(same):
                break
            codes.append(tr[same] * rows + tr[same + d])
        if codes:
            pair, times = np.unique(np.concatenate(codes), return_counts=True)
            total[pair // rows, pair % rows] += times
            total[pair % rows, pair // rows] += times
        if not thin.all():
            own, at = np.unique(r[~thin], return_inverse=True)
            dense, cols = np.unique(c[~thin], return_inverse=True)
            m = np.zeros((len(own), len(dense)), np.float32)
            m[at, cols] = 1
            total[np.ix_(own, own)] += (m @ m.T).astype(np.int64)
        live &= total + np.minimum(left[:, None], left[None, :]) >= need
    return live


def forest(hit: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the least row of its component."""
    label = np.arange(len(hit))
    hit = hit | np.eye(len(hit), dtype=bool)
    while True:
        least = np.where(hit, label[None, :], len(label)).min(axis=1)
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def join(docs: DataFrame, k: int, num: int, den: int, id_column: str = "doc_id", text_column: str = "text", trace: dict | None = None) -> DataFrame:
    """Returns ``id_column, n_shingles, component_id`` for every row of ``docs``."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                flat, offs = shingle_sets(part.column("text"), k)
                h1, h2 = set_hashes(flat, offs)
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "n": np.diff(offs), "h1": h1, "h2": h2})
                gram, df = np.unique(flat, return_counts=True)
                gram, df = gram[df >= SHARED].view(np.int64), df[df >= SHARED]
                none = pa.nulls(len(gram), pa.int64())
                yield pa.RecordBatch.from_pydict({"id": none, "n": -df, "h1": gram, "h2": np.zeros(len(gram), np.int64)})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            key, node = grouped(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            for i in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_pydict({"key": key[i : i + (1 << 16)], "node": node[i : i + (1 << 16)]})

        held, count = [], 0
        for batch in batches:
            for part in chunks(batch, "text"):
                flat, offs = shingle_sets(part.column("text"), k)
                key, place = keys(flat, offs, num, den, common.value)
                held.append((key, set_hashes(flat, offs)[0][place]))
                count += len(key)
                if count > GROUPED_KEYS:
                    yield from flush()
                    held, count = [], 0
        if held:
            yield from flush()

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_node = None
        for batch in batches:
            key, node = (batch.column(c).to_numpy() for c in ("key", "node"))
            if not len(key):
                continue
            head = np.concatenate([[key[0] != last_key if last_key is not None else True], key[1:] != key[:-1]])
            least = np.where(head, node, 0)
            at = np.maximum.accumulate(np.where(head, np.arange(len(key)), -1))
            least = np.where(at >= 0, node[np.maximum(at, 0)], last_node if last_node is not None else 0)
            rest = least != node
            star = np.unique(np.stack([least[rest], node[rest]]), axis=1)
            last_key, last_node = key[-1], least[-1]
            yield pa.RecordBatch.from_pydict({"a": star[0], "b": star[1]})

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                flat, offs = shingle_sets(part.column("text"), k)
                key, place = keys(flat, offs, num, den, common.value)
                same = set_hashes(flat, offs)[0] == part.column("h1").to_numpy()
                key, place = key[same[place]], place[same[place]]
                out = part.drop_columns(["text"]).take(pa.array(place))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(key)], [*out.schema.names, "key"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                flat, offs = shingle_sets(part.column("text"), k)
                same = np.flatnonzero(set_hashes(flat, offs)[0] == part.column("h1").to_numpy())
                out = part.drop_columns(["text", "h1"]).take(pa.array(same))
                lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat.view(np.int64))).take(pa.array(same))
                yield pa.RecordBatch.from_arrays([*out.columns, lists], [*out.schema.names, "grams"])

    def product(batch: pa.Table) -> pa.Table:
        ids = batch.column("id").to_numpy()
        grams = batch.column("grams").combine_chunks()
        offs, flat = grams.offsets.to_numpy(), grams.values.to_numpy()
        parts = [flat[offs[i] : offs[i + 1]] for i in range(len(ids))]
        least = forest(linked(parts, num, den))
        far = np.flatnonzero(least != np.arange(len(ids)))
        return pa.table({"a": ids[least[far]], "b": ids[far]})

    sketched = materialize(rows.mapInArrow(sketch, "id long, n long, h1 long, h2 long"))
    sized = sketched.where("n >= 0")
    shared = sketched.where("n < 0").groupBy("h1").agg(F.sum("n").alias("n")).orderBy("n", "h1").limit(COMMON)
    common = docs.sparkSession.sparkContext.broadcast(np.sort(shared.select("h1").toArrow().column("h1").to_numpy().view(_U)))
    classes = sized.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("docs")).where("rep IS NOT NULL")
    met = rows.where("id IS NOT NULL").mapInArrow(meet, "key long, node long").repartition("key").sortWithinPartitions("key", "node")
    families = connected_components(met.mapInArrow(stars, "a long, b long")).withColumnRenamed("node", "h1")
    ratio = np.log(den / num)
    members = materialize(
        classes.join(families, "h1").select("rep", "h1", "n", F.col("component").alias("family"), F.floor(F.log("n") / ratio).alias("band"))
    )
    whole = members.groupBy("family").agg(F.count("*").alias("docs"), F.sum("n").alias("grams"))
    small = f"docs <= {BLOCK_DOCS} AND grams <= {BLOCK_SHINGLES}"
    whole = materialize(whole)
    cut = materialize(join_hot(members, whole, ["family"], "docs").withColumn("band", F.expr(f"IF({small}, 0L, band)")))
    weight = cut.groupBy("family", "band").agg(
        F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"), F.count("*").alias("own")
    )
    weight = materialize(weight)
    beside = weight.select("family", (F.col("band") - 1).alias("band"), F.col("parts").alias("above"))
    below = weight.select("family", (F.col("band") + 1).alias("band"), F.col("parts").alias("under"))
    weight = weight.join(beside, ["family", "band"], "left").join(below, ["family", "band"], "left")
    placed = join_hot(cut, weight, ["family", "band"], "own")
    placed = placed.withColumn("part", F.expr("pmod(xxhash64(rep), parts)"))
    # a block pair is (band, part, next band or the same, other part)
    blocks = F.expr(
        "concat(transform(sequence(0L, parts - 1), p -> concat_ws(',', family, band, least(p, part), 0, greatest(p, part))),"
        " IF(above IS NULL, array(), transform(sequence(0L, above - 1), p -> concat_ws(',', family, band, part, 1, p))),"
        " IF(under IS NULL, array(), transform(sequence(0L, under - 1), p -> concat_ws(',', family, band - 1, p, 1, part))))"
    )
    large = whole.where(F.col("docs") > RECUT).select("family")
    if large.isEmpty():
        placed = placed.select(F.col("rep").alias("id"), "h1", blocks.alias("blocks"))
    else:
        own = members.join(large, "family").select(F.col("rep").alias("id"), "h1", "n", "family")
        keyed = materialize(rows.join(own, "id").select("id", "h1", "n", "family", "text").mapInArrow(raw, "id long, h1 long, n long, family long, key long"))
        groups = keyed.groupBy("family", "key").agg(
            F.count("*").alias("docs"), F.sum("n").alias("grams"), F.bit_xor(F.xxhash64("id")).alias("s1"), F.bit_xor(F.xxhash64("id", "h1")).alias("s2")
        )
        groups = groups.where("docs > 1").groupBy("family", "docs", "grams", "s1", "s2").agg(F.min("key").alias("key"))
        parts_of = F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("grams") / BLOCK_SHINGLES))
        groups = materialize(groups.select("family", "key", "docs", parts_of.alias("parts")))
        whole_rows = placed.join(large, "family").groupBy("family").agg(F.expr("sum(parts + coalesce(above, 0) + coalesce(under, 0))").alias("whole_rows"))
        recut = groups.groupBy("family").agg(F.sum(F.col("docs") * F.col("parts")).alias("key_rows")).join(whole_rows, "family")
        recut = materialize(recut.where("key_rows < whole_rows").select("family"))
        if trace is not None:
            trace["recut"] = recut
        by_key = keyed.join(groups.join(recut, "family").drop("docs"), ["family", "key"]).withColumn("part", F.expr("pmod(xxhash64(id), parts)"))
        pairs = "transform(sequence(0L, parts - 1), p -> concat_ws(',', 'key', family, key, least(p, part), greatest(p, part)))"
        by_key = by_key.groupBy("id", "h1").agg(F.flatten(F.collect_list(F.expr(pairs))).alias("blocks"))
        placed = placed.join(recut, "family", "left_anti").select(F.col("rep").alias("id"), "h1", blocks.alias("blocks")).unionByName(by_key)
    if trace is not None:
        trace["placed"], trace["members"] = placed, members
    filled = rows.join(placed, "id").select("id", "h1", "text", "blocks").mapInArrow(sets, "id long, blocks array<string>, grams array<long>")
    links = filled.select(F.explode("blocks").alias("block"), "id", "grams").groupBy("block").applyInArrow(product, "a long, b long")
    parts = connected_components(links).withColumnRenamed("node", "rep")
    named = materialize(classes.join(parts, "rep", "left").select("h1", "h2", "n", "docs", F.coalesce("component", "rep").alias("component")))
    return join_hot(sized, named, ["h1", "h2", "n"], "docs", "left").select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.expr("IF(id IS NULL, NULL, coalesce(component, id))").alias("component_id"),
    )
