"""Each pipeline stage, and all of them in a row, against plain forms over whole texts."""

import hashlib
import sys
from pathlib import Path

import plain
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline

from rooftide.llm.queries import vocabulary_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    return docs, [(r.doc_id, r.quality) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()]


def by_quality(docs, labels):
    d, cut = plain.quality({r[0]: r[1] for r in docs}, labels)
    return [r for r in docs if d[r[0]] > cut]


def by_lines(docs):
    left = plain.passages({r[0]: r[1] for r in docs if r[1] is not None})
    rows = [(r, *left.get(r[0], (None, 0))) for r in docs]
    return [(r[0], t, r[2], r[3], None if t is None else len(t)) for r, t, n in rows if n == 0 or t.strip(" \t\r\n")]


def by_jaccard(docs):
    group = plain.jaccard({r[0]: r[1] for r in docs}, 5, 4, 5)
    return [r for r in docs if group[r[0]][1] == r[0]]


def by_mix(docs):
    rows = {r[0]: r for r in docs}
    return [rows[i] for i, size, _, taken in plain.mixed([(r[0], r[1], r[3]) for r in docs]) if size for _ in range(int(taken / size + 0.5))]


def by_bpe(docs):
    library = Tokenizer.from_file(vocabulary_path())
    out = []
    for r in docs:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        out.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return out


STEPS = {"line_dedup": by_lines, "ngram_jaccard": by_jaccard, "mixing": by_mix}


def test_stages_are_named_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "ngram_jaccard", "mixing", "bpe"]


@pytest.mark.parametrize("name", STEPS)
def test_each_stage_keeps_what_the_plain_form_keeps(spark, tables, name):
    docs = spark.createDataFrame(tables[0], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, FOLDER)
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, STEPS[name](tables[0])))


def test_the_pipeline_is_its_stages_in_a_row(spark, tables):
    docs, labels = tables
    docs = by_quality(docs, labels)
    assert 0 < len(docs) < len(tables[0])
    for step in STEPS.values():
        docs = step(docs)
    got = corpus_pipeline.run(spark, FOLDER).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(by_bpe(docs))


def test_odd_rows_and_empty_tables_pass_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, "a b c", "en", None, 5), (2, "a b c", "en", None, 5), (3, "long " * 20000, "en", "a", 100000)]
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, spark.createDataFrame([], schema), FOLDER).count() == 0, name
        got = stage(spark, spark.createDataFrame(rows, schema), FOLDER)
        assert {r.doc_id for r in got.collect()} <= {0, 1, 2, 3}, name
    assert corpus_pipeline.keep_quality(spark, spark.createDataFrame([], schema), FOLDER).count() == 0
