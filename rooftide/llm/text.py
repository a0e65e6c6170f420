"""Vectorised words and word shingles over Arrow string columns.

Words are maximal runs of bytes other than space and 0x09-0x0D, so other
Unicode spaces belong to words. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; bounds the memory of the temporary arrays.
CHUNK_BYTES = 1 << 20
_U = np.uint64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser that spreads 64-bit values (the well-known splitmix64 steps)."""
    x = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """White space by byte; a value by byte, with A-Z as a-z; multipliers by position."""
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    low = np.arange(256)
    low[65:91] += 32
    return space, mix(np.arange(256, dtype=_U), 7)[low], mix(np.arange(1 << 16, dtype=_U), 11) | _U(1)


def chunks(batch: pa.RecordBatch, column: str, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``max_bytes`` of text each, and one row at least."""
    if batch.num_rows == 0:
        return
    offs = utf8(batch.column(column))[1]
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + max_bytes, side="right")) - 1)
        j = min(j, batch.num_rows, i + (1 << 19))
        yield batch.slice(i, j - i)
        i = j


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each."""
    col = col.cast(pa.large_string()).fill_null("")
    n, _ = len(col), col.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def word_spans(buf: np.ndarray, offs: np.ndarray, gap: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and document index of all words; ``gap`` tells by byte what parts them."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = ~(tables()[0] if gap is None else gap)[buf]
    cut = offs[1:-1]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cut = cut[(cut > 0) & (cut < len(buf))]
    starts[cut] = inside[1:-1][cut]
    ends[cut - 1] = inside[1:-1][cut - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words with A-Z taken as a-z."""
    if len(starts) == 0:
        return np.zeros(0, _U)
    _, value, mult = tables()
    lens = ends - starts
    first = np.cumsum(lens) - lens
    at = np.arange(int(lens.sum())) + np.repeat(starts - first, lens)
    pos = np.arange(len(at)) - np.repeat(first, lens)
    m = mult[np.minimum(pos, len(mult) - 1)] if pos.max() < len(mult) else mix(pos.astype(_U), 11) | _U(1)
    return mix(np.add.reduceat(value[buf[at]] * m, first) + lens.astype(_U), 3)


def shingle_sets(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``k``-word shingles of each text, flat, with offsets.

    A text with fewer words has its whole sequence as its one shingle; without
    words it has none. Shingles are 64-bit hashes of the words.
    """
    buf, offs = utf8(col)
    starts, ends, doc = word_spans(buf, offs)
    w = word_hashes(buf, starts, ends)
    n_docs = len(offs) - 1
    if len(w) == 0:
        return np.zeros(0, _U), np.zeros(n_docs + 1, np.int64)
    nw = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(nw) - nw
    pos, have = np.arange(len(w)) - first[doc], nw[doc]
    s = mix(w, 21)
    for j in range(1, k):
        if j < len(w):
            s[:-j] += np.where(pos[:-j] + j < have[:-j], mix(w[j:], 21 + j), _U(0))
    s = mix(s + np.where(have < k, have, 0).astype(_U), 5)
    ok = (pos + k <= have) | ((pos == 0) & (have < k))
    s, doc = s[ok], doc[ok]
    ns = np.bincount(doc, minlength=n_docs)
    o = np.concatenate([[0], np.cumsum(ns)])
    for i in np.flatnonzero(ns > 1):
        s[o[i] : o[i + 1]].sort()
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[keep], doc[keep]
    return s, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs))])
