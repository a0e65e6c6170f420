"""Toxicity by classifier chains over hashed words and word beginnings.

Labels mark toxic documents as a whole. Categories come from the labelled rows
themselves: spherical k-means over the telling features of the toxic training
rows parts these into ``KINDS`` kinds, by falling size; ``toxic`` stands at the
chain's end. Each link is a regularised logistic regression over the presence
of features, and over the log-odds that the earlier links give. In training
those come from out-of-fold predictions, so that a link sees earlier answers as
good as they will be on new texts; each fold chooses its features from the
other folds only. Rows fall into folds by their least feature hash, so that
near copies mostly share a fold.

At most ``PER_CLASS`` labelled rows of each class are read, none of the
held-out quarter (crc32 of the id as text, mod 4, is 2). Features are counted
by Spark; the driver gets the ``FEATURES`` most telling ones for all rows and
for each fold, and of each row which of these it has, so its share is bounded
whatever the texts' length. All rows and whole texts are scored.

Defined cases: null and empty texts have no features; rows with a null id are
scored; repeated rows are scored each; without labels of both classes all
probabilities are 0; an empty table gives no rows; columns other than the id
and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rooftide.llm.quality import labelled
from rooftide.llm.shared import FILES, materialize
from rooftide.llm.text import chunks, mix, utf8, word_hashes, word_spans

PER_CLASS = 3000
FEATURES = 2048
FOLDS = 3
KINDS, STARTS = 3, 8
CATEGORIES = (*(f"kind_{i}" for i in range(KINDS)), "toxic")
BEGINNINGS = (4, 5, 6)


def letters() -> np.ndarray:
    """What parts words here: all of ASCII but letters and digits."""
    gap = np.zeros(256, bool)
    gap[:128] = True
    for a, z in ((48, 58), (65, 91), (97, 123)):
        gap[a:z] = False
    return gap


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and word beginnings, with their documents; not distinct."""
    buf, offs = utf8(col)
    starts, ends, doc = word_spans(buf, offs, letters())
    out, owner = [mix(word_hashes(buf, starts, ends), 50)], [doc]
    for n in BEGINNINGS:
        long = ends - starts > n
        out.append(mix(word_hashes(buf, starts[long], starts[long] + n), 50 + n))
        owner.append(doc[long])
    return np.concatenate(out), np.concatenate(owner)


def logistic(rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, y: np.ndarray, n_cols: int, l2: float = 2.0, steps: int = 120):
    """Weights of sparse binary and dense columns, and the constant, by Adam steps."""
    w, v, b = np.zeros(n_cols), np.zeros(dense.shape[1]), 0.0
    p = np.concatenate([w, v, [b]])
    m, s = np.zeros_like(p), np.zeros_like(p)
    pos = max(y.sum(), 1)
    weight = np.where(y == 1, 0.5 / pos, 0.5 / max(len(y) - pos, 1)) * len(y)
    for t in range(1, steps + 1):
        w, v, b = p[:n_cols], p[n_cols:-1], p[-1]
        z = np.bincount(rows, w[cols], minlength=len(y)) + dense @ v + b
        r = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.concatenate([np.bincount(cols, r[rows], minlength=n_cols) + l2 * w, dense.T @ r + l2 * v, [r.sum()]])
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return p[:n_cols], p[n_cols:-1], p[-1]


def logits(model, rows: np.ndarray, cols: np.ndarray, dense: np.ndarray) -> np.ndarray:
    w, v, b = model
    return np.clip(np.bincount(rows, w[cols], minlength=len(dense)) + dense @ v + b, -30, 30)


def kinds(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, n_cols: int, steps: int = 20) -> np.ndarray:
    """The kind of each toxic row, by spherical k-means over its features; -1 for other rows."""
    toxic = np.flatnonzero(y == 1)
    place = np.full(len(y), -1)
    place[toxic] = np.arange(len(toxic))
    x = np.zeros((len(toxic), n_cols), np.float32)
    hit = place[rows] >= 0
    x[place[rows[hit]], cols[hit]] = 1
    x *= np.log((1 + len(x)) / (1 + x.sum(0)))
    x /= np.maximum(np.sqrt((x * x).sum(1)), 1e-12)[:, None]
    # of a few starts the closest clusters count
    best, own = -1.0, np.zeros(len(x), np.int64)
    for seed in range(STARTS):
        centres = x[np.random.default_rng(seed).choice(len(x), KINDS, replace=len(x) < KINDS)]
        for _ in range(steps):
            at = np.argmax(x @ centres.T, axis=1)
            new = np.array([x[at == i].sum(0) if (at == i).any() else centres[i] for i in range(KINDS)])
            centres = new / np.maximum(np.sqrt((new * new).sum(1)), 1e-12)[:, None]
        near = x @ centres.T
        if near.max(1).sum() > best + 1e-6:
            best, own = float(near.max(1).sum()), np.argmax(near, axis=1)
    order = np.argsort(-np.bincount(own, minlength=KINDS), kind="stable")
    out = np.full(len(y), -1)
    out[toxic] = np.argsort(order)[own]
    return out


def fit(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, fold: np.ndarray, chosen: list[np.ndarray], vocab: np.ndarray) -> dict:
    """The chain for documents with feature ``vocab[cols[i]]`` in document ``rows[i]``, each pair once.

    ``chosen`` has the places of the features in use: for all rows, then for the rows outside each fold.
    """
    n, pos = len(y), int(y.sum())
    if pos < 2 or n - pos < 2 or not len(chosen[0]):
        return {}

    def within(own: np.ndarray, subset: np.ndarray, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of some rows and features, with both numbered anew."""
        of_row, of_col = np.cumsum(own) - 1, np.full(len(vocab), -1)
        of_col[subset] = np.arange(len(subset))
        use = own[r] & (of_col[c] >= 0)
        return of_row[r[use]], of_col[c[use]]

    every = np.ones(n, bool)
    r, c = within(every, chosen[0], rows, cols)
    kind = kinds(r, c, y, len(chosen[0]))
    chain, dense = [], np.zeros((n, 0))
    for i, name in enumerate(CATEGORIES):
        t, out = (y if name == "toxic" else (kind == i).astype(int)), np.zeros(n)
        for f in range(FOLDS):
            seen, held = fold != f, fold == f
            if not held.any():
                continue
            model = logistic(*within(seen, chosen[1 + f], rows, cols), dense[seen], t[seen], len(chosen[1 + f]))
            out[held] = logits(model, *within(held, chosen[1 + f], rows, cols), dense[held])
        chain.append(logistic(r, c, dense, t, len(chosen[0])))
        dense = np.column_stack([dense, out / 5])
    return {"vocab": vocab[chosen[0]], "chain": chain, "out_of_fold": dense * 5, "kind": kind}


def predict(model: dict, col: pa.Array) -> np.ndarray:
    """Probabilities of each category, by text."""
    n = len(col)
    if not model:
        return np.zeros((n, len(CATEGORIES)))
    names, doc = features(col)
    vocab = model["vocab"]
    at = np.minimum(np.searchsorted(vocab, names), len(vocab) - 1)
    hit = vocab[at] == names
    pair = np.unique(doc[hit] * len(vocab) + at[hit])
    rows, cols = pair // len(vocab), pair % len(vocab)
    dense = np.zeros((n, 0))
    for link in model["chain"]:
        dense = np.column_stack([dense, logits(link, rows, cols, dense) / 5])
    return 1 / (1 + np.exp(-5 * dense))


def own_features(col: pa.Array) -> list[np.ndarray]:
    """The distinct features of each text, sorted."""
    names, doc = features(col)
    order = np.lexsort((names, doc))
    names, doc = names[order], doc[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    return np.split(names[new], np.cumsum(np.bincount(doc[new], minlength=len(col)))[:-1])


def fold_of(own: np.ndarray) -> int:
    return int(mix(own, 60).min() % np.uint64(FOLDS)) if len(own) else 0


def train(docs: DataFrame, labels: DataFrame) -> dict:
    spark = docs.sparkSession
    # the documents are scanned by as many tasks as they have; only the chosen rows move into few files
    rows = materialize(labelled(docs, labels, "toxic", PER_CLASS).repartition(FILES))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                own, y = own_features(part.column("text")), part.column("y").to_numpy()
                group = np.repeat([fold_of(x) * 2 + int(t) for x, t in zip(own, y, strict=True)], [len(x) for x in own]).astype(np.int64)
                name, at = np.unique(np.concatenate(own), return_inverse=True)
                df = np.bincount(at * 2 * FOLDS + group, minlength=len(name) * 2 * FOLDS).reshape(len(name), 2 * FOLDS)
                yield pa.RecordBatch.from_pydict({"name": name.view(np.int64)} | {f"n{g}": df[:, g] for g in range(2 * FOLDS)})
                # the row without a name counts the documents
                yield pa.RecordBatch.from_pydict({"name": pa.nulls(1, pa.int64())} | {f"n{g}": [sum(fold_of(x) * 2 + int(t) == g for x, t in zip(own, y, strict=True))] for g in range(2 * FOLDS)})

    columns = [f"n{g}" for g in range(2 * FOLDS)]
    counted = rows.mapInArrow(counts, "name long, " + ", ".join(f"{c} long" for c in columns))
    counted = materialize(counted.groupBy("name").agg(*[F.sum(c).alias(c) for c in columns]))
    sizes = counted.where("name IS NULL").first()
    if sizes is None:
        return {}
    lists = []
    for left_out in (None, *range(FOLDS)):
        folds = [f for f in range(FOLDS) if f != left_out]
        neg, pos = (max(1, sum(sizes[f"n{2 * f + t}"] for f in folds)) for t in (0, 1))
        df0, df1 = (f"({' + '.join(f'n{2 * f + t}' for f in folds)})" for t in (0, 1))
        telling = f"abs(ln(({df1} + 0.5e0) / {pos + 1}) - ln(({df0} + 0.5e0) / {neg + 1})) * sqrt({df1} / {pos}e0 + {df0} / {neg}e0)"
        top = counted.where(f"name IS NOT NULL AND {df1} + {df0} >= 3").select("name", F.expr(telling).alias("t")).orderBy(F.col("t").desc(), "name").limit(FEATURES)
        lists.append(np.sort(top.select("name").toArrow().column("name").to_numpy().view(np.uint64)))
    vocab = np.unique(np.concatenate(lists))
    known = spark.sparkContext.broadcast(vocab)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                own = own_features(part.column("text"))
                at = [np.flatnonzero(np.isin(known.value, x)).astype(np.int32) for x in own]
                yield pa.RecordBatch.from_pydict({"x": pa.array(at, pa.list_(pa.int32())), "y": part.column("y"), "fold": pa.array([fold_of(x) for x in own], pa.int32())})

    got = rows.mapInArrow(held, "x array<int>, y int, fold int").toArrow()
    sets = [np.array(x, np.int64) for x in got.column("x").to_pylist()]
    y, fold = got.column("y").to_numpy(), got.column("fold").to_numpy()
    order = sorted(range(len(y)), key=lambda i: (int(y[i]), int(fold[i]), len(sets[i]), sets[i].tolist()))  # whatever the order of tasks
    sets, y, fold = [sets[i] for i in order], y[order], fold[order]
    row = np.repeat(np.arange(len(y)), [len(x) for x in sets])
    return fit(row, np.concatenate(sets), y, fold, [np.searchsorted(vocab, x) for x in lists], vocab) | {"chosen": lists}


def score(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Returns ``id_column, p_kind_0, p_kind_1, p_kind_2, p_toxic, toxic`` for every row."""
    trained = train(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast({k: trained[k] for k in ("vocab", "chain")} if trained else {})
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text"):
                p = predict(model.value, part.column("_text"))
                yield pa.RecordBatch.from_pydict({"_id": part.column("_id")} | {f"p_{c}": p[:, i] for i, c in enumerate(CATEGORIES)})

    out = rows.mapInArrow(run, f"_id {kind}, " + ", ".join(f"p_{c} double" for c in CATEGORIES))
    return out.select(F.col("_id").alias(id_column), *[f"p_{c}" for c in CATEGORIES], (F.col("p_toxic") >= 0.5).cast("int").alias("toxic"))
