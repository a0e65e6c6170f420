import hashlib
import random

import duckdb
import numpy as np
import plain
import pytest
from tokenizers import Tokenizer

from rooftide.llm import bpe, jaccard, linededup, mixing, secretscan
from rooftide.llm.queries import vocabulary_path

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, _text string"
TEXTS = ["", None, "a", "one two three four five six", "one two three four five six", "x " * 3000, "É\x85 ü\n\n\tb", "A B c\nd e\nf g\nh", "password = abcdefghijkl0123"]


def rows(texts):
    return [(i, t, "en", "s" if i % 2 else None, None, 7, "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(TEXTS) + [(None, "no id here at all", None, None, None, 1, None), rows(TEXTS)[3]], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_odd_rows_have_defined_results(spark, odd, none):
    runs = {"mix": mixing.mix, "bpe": lambda d: bpe.encode_decode(d, vocabulary_path()), "jaccard": lambda d: jaccard.join(d, 3, 9, 10), "secrets": secretscan.digests, "lines": linededup.dedup}
    rows_of = {name: run(odd).collect() for name, run in runs.items()}
    for name, run in runs.items():
        assert len(rows_of[name]) == 11, name
        assert run(none).count() == 0, name
    want = plain.jaccard(dict(enumerate(TEXTS)), 3, 9, 10)
    assert sorted((r.n_shingles, r.component_id) for r in rows_of["jaccard"] if r.doc_id is not None) == sorted([*want.values(), want[3]])
    assert [(r.n_shingles, r.component_id) for r in rows_of["jaccard"] if r.doc_id is None] == [(3, None)]
    library = Tokenizer.from_file(vocabulary_path())
    for r in rows_of["bpe"]:
        text = "no id here at all" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert {r.doc_id: (r.n_assign, r.spans) for r in rows_of["secrets"]}[8] == (1, "assign:0:27")
    assert all(r.text == (TEXTS[r.doc_id] if r.doc_id is not None else "no id here at all") for r in rows_of["lines"])
    sizes = {r.doc_id: r["size"] for r in rows_of["mix"]}
    assert sizes == {i: len(plain.words(t)) for i, t in enumerate(TEXTS)} | {None: 5}


def test_bpe_is_the_librarys():
    want = Tokenizer.from_file(vocabulary_path())
    e = bpe.Encoder(bpe.Vocabulary(vocabulary_path()))
    r = random.Random(3)
    texts = [t or "" for t in TEXTS] + ["a" * 999, "<|endoftext|>x<|endoftext|>"] + ["".join(r.choice("ab \n'st0é漢😀́\x85\x1c") for _ in range(300)) for _ in range(50)]
    for text, ids in zip(texts, e.encode(texts), strict=True):
        assert ids.tolist() == want.encode(text, add_special_tokens=False).ids
        assert e.v.decode(ids).decode() == want.decode(ids.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("columns", [7, 64, 4096])
def test_blocks_of_columns_give_the_links(columns):
    r = np.random.default_rng(columns)
    base = r.choice(5000, 200, replace=False)
    sets = [np.unique(np.concatenate([base[: r.integers(1, 200)], r.choice(9000, r.integers(0, 30))])) for _ in range(60)] + [np.zeros(0, np.int64)] * 2
    for num, den in ((9, 10), (4, 5), (1, 3)):
        got = jaccard.linked(sets, num, den, columns)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                both = len(np.intersect1d(a, b))
                assert got[i, j] == (i != j and both > 0 and den * both >= num * (len(a) + len(b) - both))


@pytest.mark.parametrize(("k", "num", "den", "recut"), [(3, 9, 10, None), (5, 4, 5, None), (3, 9, 10, 3), (5, 4, 5, 3)])
def test_jaccard_finds_every_link(spark, monkeypatch, k, num, den, recut):
    if recut:
        # every family is cut by its keys, and by parts of these
        monkeypatch.setattr(jaccard, "RECUT", recut)
        monkeypatch.setattr(jaccard, "BLOCK_DOCS", 2)
    r = random.Random(k)
    texts = {}
    for base in range(6):
        words = [f"w{r.randrange(200)}" for _ in range(r.choice([4, 12, 40, 150]))]
        for _ in range(12):
            own = list(words)
            for _ in range(r.randrange(5)):
                own[r.randrange(len(own))] = f"n{r.randrange(9)}"
            texts[len(texts)] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(docs, k, num, den).collect()}
    assert got == plain.jaccard(texts, k, num, den)


def test_a_long_chain_is_cut_by_its_keys(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "RECUT", 20)
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 4)
    words = [f"w{i}" for i in range(2000)]
    texts = {i: " ".join(words[3 * i : 3 * i + 70]) for i in range(150)} | {200 + i: " ".join(words[i * 90 : i * 90 + 50]) for i in range(9)}
    trace = {}
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), 3, 9, 10, trace=trace).collect()}
    assert trace["recut"].count() == 1
    assert got == plain.jaccard(texts, 3, 9, 10)


def test_mixing_and_lines_as_in_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = {r[0]: r[1:] for r in c.execute(f"SELECT doc_id, size, target, taken FROM ({mixing.oracle()})").fetchall()}
    got = {r.doc_id: (r["size"], r.target, r.taken) for r in mixing.mix(docs).collect()}
    assert got == want
    want = {r[0]: r[1:] for r in c.execute(f"SELECT doc_id, n_lines, n_removed FROM ({linededup.ORACLE})").fetchall()}
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in linededup.dedup(docs).collect()} == want


def test_every_repeated_passage_goes(spark):
    r = random.Random(8)
    texts = {}
    for n in (2, 3, 4, 5):
        passage = [f"passage {n} line {j}" for j in range(n)]
        for i in range(20):
            texts[len(texts)] = "\n".join([f"own {n} {i} {j}" for j in range(r.randrange(1, 5))] + passage + [f"after {n} {i} {j}" for j in range(r.randrange(1, 5))])
    for i in range(40):
        texts[len(texts)] = "\n".join(r.choice(["a", "b", "c", "d", "", " "]) for _ in range(r.randrange(9)))
    texts |= {len(texts): "single\n\nx0", len(texts) + 1: "single\n\ny0", len(texts) + 2: "same\nsame\nsame"}
    docs = spark.createDataFrame([*texts.items(), (None, texts[1]), (999, None)], "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.text, x.n_removed) for x in linededup.passages(docs).collect()}
    assert got.pop(None) == (texts[1], 0) and got.pop(999) == (None, 0)
    assert got == plain.passages(texts)
    assert all(sum(f"passage {n} line {j}" in t for t, _ in got.values()) == 1 for n in (2, 3, 4, 5) for j in range(n))
    kept = {line for t, _ in got.values() for line in t.split("\n")}
    assert all(line in kept for t in texts.values() for line in t.split("\n") if line.strip())
