"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

``encode_decode`` returns one row per input row. A null text counts as empty
and has no tokens; very long texts are encoded whole, one chunk of the batch at
a time; columns of the input other than the key and the text are left out, so
their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rooftide.llm.text import chunks

#: The pattern of byte-level pre-tokenisation, with white space spelled out.
_S = r"\t-\r\x20\x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Distinct words whose tokens a worker remembers; beyond, it starts anew.
CACHE_WORDS = 400_000
_NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes, with the byte of each."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merge tables and token bytes of a byte-level BPE file; about 1 MB, whatever the corpus."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, ids = byte_letters(), spec["model"]["vocab"]
        as_bytes = {i: bytes(letters[c] for c in t) for t, i in ids.items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        as_bytes |= {i: t.encode() for t, i in self.special.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([(ids[a] << 32) | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.of_byte = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.of_byte[b] = ids[c]
        top = max(as_bytes) + 1
        self.length = np.array([len(as_bytes.get(i, b"")) for i in range(top)], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(as_bytes.get(i, b"") for i in range(top)), np.uint8)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, by binary search over the sorted pair keys."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, flat, and how many each word has.

        All words' symbols stand in one array. Each round finds every word's
        lowest-ranked pair and merges its occurrences from the left; only the
        pairs beside a merge are looked up again, and finished words leave.
        """
        lens = np.array([len(w) for w in words], np.int64)
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lens)
        done_sym, done_word = [], []
        rank = np.full(len(sym), _NONE, np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self._ranks(sym[inner], sym[inner + 1])
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(word)))
            low = np.repeat(least, count)
            live = low != _NONE
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, low = sym[live], word[live], rank[live], low[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == low)
            run = np.concatenate([[True], np.diff(hit) != 1])
            head = np.repeat(hit[run], np.diff(np.append(np.flatnonzero(run), len(hit))))
            hit = hit[(hit - head) % 2 == 0]  # of overlapping occurrences, from the left
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # places after the right halves are gone
            sym, word, rank = sym[keep], word[keep], rank[keep]
            again = np.unique(np.concatenate([at, at[at > 0] - 1]))
            last = again == len(sym) - 1
            nxt = np.where(last, again, again + 1)
            rank[again] = np.where(last | (word[again] != word[nxt]), _NONE, self._ranks(sym[again], sym[nxt]))
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        flat, owner = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(owner, kind="stable")
        return flat[order], np.bincount(owner, minlength=len(words))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, one after another, special tokens included."""
        n = self.length[ids]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[ids] - (ends - n), n)
        return self.bytes[at].tobytes()


class Encoder:
    """Encodes texts; the tokens of words seen before come from a bounded memory."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.find = vocabulary, regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.names: list[str] = []
        self.flat, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._add(list(self.v.special), np.array(list(self.v.special.values()), np.int64), np.ones(len(self.v.special), np.int64))

    def _add(self, words: list[str], ids: np.ndarray, count: np.ndarray) -> None:
        self.index.update(zip(words, range(len(self.names), len(self.names) + len(words)), strict=True))
        text, at = list(map(str, ids.tolist())), 0
        for n in count.tolist():
            self.names.append(",".join(text[at : at + n]))
            at += n
        self.flat, self.count = np.concatenate([self.flat, ids]), np.concatenate([self.count, count])
        self.start = np.cumsum(self.count) - self.count

    def pieces(self, text: str) -> list[str]:
        if self.cut is None or not self.cut.search(text):
            return self.find(text)
        return [p for i, part in enumerate(self.cut.split(text)) for p in ([part] if i % 2 else self.find(part))]

    def words_of(self, texts: list[str]) -> list[list[int]]:
        """For each text the places of its words in this memory."""
        split = [self.pieces(t) for t in texts]
        if len(self.index) > CACHE_WORDS:
            self.forget()
        if new := list(set().union(*split).difference(self.index)):
            self._add(new, *self.v.encode_words([w.encode() for w in new]))
        return [list(map(self.index.__getitem__, words)) for words in split]

    def ids(self, places: list[int]) -> np.ndarray:
        at = np.array(places, np.int64)
        n = self.count[at]
        ends = np.cumsum(n)
        return self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[at] - (ends - n), n)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.ids(p) for p in self.words_of(texts)]


def remembered(key: str, make):
    """``make()``'s value, kept by this Python worker from task to task."""
    kept = sys.modules.setdefault("_rooftide_kept", types.ModuleType("_rooftide_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def encode_decode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", more: tuple = ()) -> DataFrame:
    """Encode and decode every text of ``docs`` with the vocabulary file at ``path``.

    Returns ``id_column, n_tokens, ids_sha256, decoded_sha256`` (SHA-256 of the
    decimal ids joined by commas, and of the decoded text in UTF-8), and those of
    ``ids array<int>`` and ``decoded string`` that ``more`` names. One pass over the
    input, no shuffle; the merge tables are broadcast and of fixed size.
    """
    table = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    rows = docs.select(id_column, text_column)
    kind = rows.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {c} {k}" for c, k in (("ids", "array<int>"), ("decoded", "string")) if c in more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = remembered(f"bpe {path}", lambda: Encoder(table.value))
        for batch in batches:
            for part in chunks(batch, text_column):
                words = e.words_of([t or "" for t in part.column(text_column).to_pylist()])
                ids = [e.ids(w) for w in words]
                out = [e.v.decode(i).decode("utf-8", "replace") for i in ids]
                sha = [hashlib.sha256(",".join([e.names[x] for x in w]).encode()).hexdigest() for w in words]
                columns = {
                    id_column: part.column(id_column),
                    "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
                    "ids_sha256": pa.array(sha, pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in out], pa.string()),
                }
                if "ids" in more:
                    columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
                if "decoded" in more:
                    columns["decoded"] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, schema)
