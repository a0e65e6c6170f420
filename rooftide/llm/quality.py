"""Quality scores by a regularised quadratic discriminant over document statistics.

Every whole text gives a row of statistics, transformed towards normal shape.
Each class of labelled rows has a mean and a covariance shrunk towards its
diagonal and a scaled identity; the score comes from the difference of the two
log-densities, computed with cached inverse Cholesky factors, and rises strictly with
it. The cut that 0.7 stands for is where the two classes' shares of right answers
over the training rows, that of class 1 counted ``KEEP`` times, add up to most.

Labels are used only of rows outside the held-out quarter (crc32 of the id as
text, mod 4, is 2), and of at most ``PER_CLASS`` rows of each class, those with
the smallest hash of their id; everything else covers all rows.

Defined cases: null and empty texts are scored like texts without words; rows
with a null id are scored and count as not held out; repeated rows are scored
each; without labels of both classes every score is 0.5; an empty table gives
no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rooftide.llm.text import chunks, utf8, word_hashes, word_spans

#: The most labelled rows of each class that a fit reads.
PER_CLASS = 5000
SHRINK = 0.1
#: What keeping a share of class 1 counts against dropping the same share of class 0.
KEEP = 4


def by_doc(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (by byte) over each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[offs[1:]] - total[offs[:-1]]).astype(float)


def distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each document, and how often its most frequent one occurs."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    head = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])) if len(k) else np.zeros(0, np.int64)
    most = np.zeros(n)
    np.maximum.at(most, d[head], np.diff(np.append(head, len(k))))
    return np.bincount(d[head], minlength=n).astype(float), most


def statistics(col: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text."""
    buf, offs = utf8(col)
    n = len(offs) - 1
    starts, ends, doc = word_spans(buf, offs)
    w = word_hashes(buf, starts, ends)
    words = np.bincount(doc, minlength=n).astype(float)
    chars = by_doc((buf & 0xC0) != 0x80, offs)
    kind = np.zeros(256, np.uint8)
    kind[48:58], kind[65:91], kind[97:123] = 1, 2, 3
    kind[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
    kind[128:] = 5
    k = kind[buf]
    accented = np.zeros(len(buf), bool)
    accented[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] < 0x9F)
    upper, lower = by_doc((k == 2) | accented, offs), by_doc(k == 3, offs)
    own, most = distinct(w, doc, n)
    same = doc[1:] == doc[:-1]
    again = np.bincount(doc[1:][same & (w[1:] == w[:-1])], minlength=n)
    pair = w[:-1][same] * np.uint64(31) + w[1:][same] if len(w) else w
    pairs = np.bincount(doc[1:][same], minlength=n) if len(w) else np.zeros(n)
    own_pairs = distinct(pair, doc[1:][same], n)[0] if len(w) else np.zeros(n)
    lengths = (ends - starts).astype(float)
    mean = np.bincount(doc, lengths, minlength=n) / np.maximum(words, 1)
    var = np.bincount(doc, lengths**2, minlength=n) / np.maximum(words, 1) - mean**2
    part = lambda a, b: np.log(a / np.maximum(b, 1) + 1e-3)
    return np.column_stack(
        [
            np.log1p(words), np.log1p(mean), np.log1p(np.sqrt(np.maximum(var, 0))),
            part(upper, chars), part(lower, chars), part(by_doc(k == 1, offs), chars), part(by_doc(k == 4, offs), chars),
            part(by_doc(buf == 33, offs), chars), part(by_doc(k == 5, offs), chars), part(by_doc(buf == 10, offs), words),
            part(again, words), part(most, words), part(words - own, words), part(pairs - own_pairs, pairs),
        ]
    )


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """The discriminant of rows ``x`` with labels ``y`` (0 or 1); empty if a class is missing."""
    model: dict = {"classes": []}
    if (y == 0).sum() < 2 or (y == 1).sum() < 2:
        return {}
    for c in (0, 1):
        rows = x[y == c]
        s = np.cov(rows.T)
        s = (1 - SHRINK) * s + SHRINK * (0.5 * np.diag(np.diag(s)) + 0.5 * np.trace(s) / len(s) * np.eye(len(s))) + 1e-4 * np.eye(len(s))
        factor = np.linalg.cholesky(s)
        model["classes"].append((rows.mean(0), np.linalg.solve(factor, np.eye(len(s))), np.log(np.diag(factor)).sum()))
    d = differences(model, x)
    order = np.argsort(d)
    right = np.cumsum(y[order] == 0) / (y == 0).sum() + KEEP * (1 - np.cumsum(y[order] == 1) / (y == 1).sum())
    best = int(np.argmax(right))
    model["cut"] = float((d[order[best]] + d[order[min(best + 1, len(d) - 1)]]) / 2)
    model["scale"] = float(np.std(d[y == 1])) or 1.0
    return model


def differences(model: dict, x: np.ndarray) -> np.ndarray:
    """Log-density of class 1 less that of class 0.

    ``einsum`` keeps to one thread: solving for all rows at once in a driver
    that had forked a JVM sometimes waited for ever on the threads of the BLAS.
    """
    out = []
    for mean, inverse, log_det in model["classes"]:
        z = np.einsum("nk,jk->nj", x - mean, inverse)
        out.append(-0.5 * (z**2).sum(1) - log_det)
    return out[1] - out[0]


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    """Strictly rising in the difference, in (0, 1), and 0.7 at the cut."""
    if not model:
        return np.full(len(x), 0.5)
    z = (differences(model, x) - model["cut"]) / model["scale"] + 2 / 3
    return 0.5 * (1 + z / (1 + np.abs(z)))


def held_out(id_column: str):
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``text, y`` of at most ``per_class`` rows of each class, none of them held out.

    The chosen ids are few, by the bound, and so they are broadcast.
    """
    y = labels.where(F.col(id_column).isNotNull() & ~held_out(id_column)).select(F.col(id_column).alias("_id"), F.col(label).cast("int").alias("y"))
    parts = [y.where(F.col("y") == c).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    return docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("text")).join(chosen, "_id").select("text", "y")


def train(docs: DataFrame, labels: DataFrame) -> dict:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                x = statistics(part.column("text"))
                yield pa.RecordBatch.from_pydict({"x": pa.array(list(x), pa.list_(pa.float64())), "y": part.column("y")})

    got = labelled(docs, labels, "quality", PER_CLASS).mapInArrow(rows, "x array<double>, y int").toArrow()
    if got.num_rows == 0:
        return {}
    x = np.array(got.column("x").to_pylist())
    y = got.column("y").to_numpy()
    order = np.lexsort((*x.T, y))  # the fit doesn't depend on the order of tasks
    return fit(x[order], y[order])


def score(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: tuple = ()) -> DataFrame:
    """Returns ``id_column, held_out, score, predicted``, and the columns in ``keep``."""
    model = train(docs, labels)
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields if f.name != "_text" or text_column in keep}
    names = [c for c in rows.columns if c != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text"):
                s = scores(model, statistics(part.column("_text")))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(s)], [*names, "score"])

    out = rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", score double")
    return out.select(
        F.col("_id").alias(id_column), held_out("_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(keep) if c != id_column],
    )
