"""The quality discriminant, the toxicity chain and the mix, against plain forms."""

import numpy as np
import pyarrow as pa
import pytest
from plain import held_out, mixed, quality as plain_quality, statistics

from rooftide.llm import mixing, quality, toxicity

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, y int, x string, fold int, score double"


def tables(spark, folder=FOLDER):
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_statistics_are_those_of_a_plain_count():
    texts = ["", None, "a", "One two two  two\nÉcole 12!\x85x", "漢字 漢字 😀", "A-b " * 200, "\t\n \x0b"]
    assert np.allclose(quality.statistics(pa.array(texts)), [statistics(t) for t in texts])


def test_scores_follow_the_log_densities(spark):
    docs, labels = tables(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    d, cut = plain_quality(texts, [(r.doc_id, r.quality) for r in labels.collect()])
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    ids = sorted(d, key=lambda i: d[i])
    scores = [got[i].score for i in ids]
    assert all(a < b + 1e-12 for a, b in zip(scores, scores[1:])) and 0 < scores[0] and scores[-1] < 1
    assert all((d[i] > cut) == (got[i].predicted == 1) for i in ids if abs(d[i] - cut) > 1e-6)
    assert all(got[i].held_out == held_out(i) for i in ids)


def test_held_out_labels_are_never_read(spark):
    docs, labels = tables(spark)
    other = labels.withColumn("quality", (quality.held_out("doc_id") != (labels.quality == 1)).cast("int")).withColumn("toxic", (quality.held_out("doc_id") != (labels.toxic == 1)).cast("int"))
    assert other.exceptAll(labels).count() > 0
    for operator in (quality, toxicity):
        assert operator.score(docs, labels).exceptAll(operator.score(docs, other)).count() == 0


@pytest.mark.parametrize(("operator", "label", "call", "least"), [(quality, "quality", "predicted", 0.97), (toxicity, "toxic", "toxic", 0.97)])
def test_held_out_accuracy(spark, operator, label, call, least):
    docs, labels = tables(spark, "/root/testdata/sf0.1")
    got = {r.doc_id: r[call] for r in operator.score(docs, labels).collect()}
    held = [(got[r.doc_id], r[label]) for r in labels.collect() if held_out(r.doc_id)]
    assert sum(a == b for a, b in held) >= least * len(held)
    assert sum(a for a, b in held if b == 1) >= 0.85 * sum(b for _, b in held)


def plain_features(text):
    return set(toxicity.features(pa.array([text]))[0].tolist())


def test_features_are_chosen_without_the_fold(spark):
    docs, labels = tables(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = [(plain_features(texts[r.doc_id]), r.toxic) for r in labels.collect() if r.doc_id in texts and not held_out(r.doc_id)]
    rows = [(f, y, toxicity.fold_of(np.array(sorted(f), np.uint64))) for f, y in rows]
    model = toxicity.train(docs, labels)
    for fold, chosen in zip((None, *range(toxicity.FOLDS)), model["chosen"]):
        use = [(f, y) for f, y, at in rows if at != fold]
        pos, neg = sum(y for _, y in use), sum(1 - y for _, y in use)
        df = {}
        for f, y in use:
            for name in f:
                df.setdefault(name, [0, 0])[y] += 1
        telling = {n: abs(np.log((b + 0.5) / (pos + 1)) - np.log((a + 0.5) / (neg + 1))) * np.sqrt(b / pos + a / neg) for n, (a, b) in df.items() if a + b >= 3}
        worst = sorted(telling.values(), reverse=True)[: toxicity.FEATURES][-1]
        assert len(chosen) == min(toxicity.FEATURES, len(telling))
        assert all(telling[int(n)] >= worst - 1e-9 for n in chosen) and {n for n, t in telling.items() if t > worst + 1e-9} <= set(map(int, chosen))


def dense_logistic(x, y, l2=2.0, steps=120):
    p = np.zeros(x.shape[1] + 1)
    m, s = np.zeros_like(p), np.zeros_like(p)
    weight = [len(y) * (0.5 / max(y.sum(), 1) if t else 0.5 / max(len(y) - max(y.sum(), 1), 1)) for t in y]
    for step in range(1, steps + 1):
        g = np.zeros_like(p)
        for row, t, w in zip(x, y, weight):
            r = w * (1 / (1 + np.exp(-np.clip(row @ p[:-1] + p[-1], -30, 30))) - t)
            g[:-1] += r * row
            g[-1] += r
        g[:-1] += l2 * p[:-1]
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return p


def test_out_of_fold_rows_come_from_the_other_folds():
    r = np.random.default_rng(3)
    n, cols = 60, 12
    x = r.random((n, cols)) < 0.3
    y = (x[:, 0] | x[:, 3]).astype(int)
    fold = r.integers(0, toxicity.FOLDS, n)
    rows, at = np.nonzero(x)
    chosen = [np.arange(cols), np.arange(0, 10), np.arange(2, cols), np.arange(cols)]
    model = toxicity.fit(rows, at, y, fold, chosen, np.arange(cols, dtype=np.uint64))
    assert set(model["kind"][y == 1]) <= {0, 1, 2} and (model["kind"][y == 0] == -1).all()
    dense = np.zeros((n, 0))
    for i, name in enumerate(toxicity.CATEGORIES):
        t, out = (y if name == "toxic" else (model["kind"] == i).astype(int)), np.zeros(n)
        for f in range(toxicity.FOLDS):
            seen = fold != f
            whole = np.column_stack([x[:, chosen[1 + f]], dense])
            p = dense_logistic(whole[seen], t[seen])
            out[~seen] = np.clip(whole[~seen] @ p[:-1] + p[-1], -30, 30)
        dense = np.column_stack([dense, out / 5])
    assert np.allclose(model["out_of_fold"], dense * 5, atol=1e-6)


def test_odd_rows_have_defined_scores(spark):
    docs, labels = tables(spark)
    texts = [None, "", " \n", "word " * 5000, "a b", "a b"]
    odd = spark.createDataFrame([(i, t, "en", None, 1, 5, "x", 2, 0.1) for i, t in enumerate(texts)] + [(None, "a b", None, None, None, 1, "", 1, 0.2)], SCHEMA)
    empty = spark.createDataFrame([], SCHEMA)
    whole = odd.unionByName(docs, allowMissingColumns=True)
    for operator, columns in ((quality, ["score", "predicted"]), (toxicity, ["p_toxic", "toxic"])):
        got = operator.score(whole, labels.unionByName(spark.createDataFrame([(None, None, None)], labels.schema)))
        few = {r.doc_id: r for r in got.where("doc_id IS NULL OR doc_id < 6").collect()}
        assert all(few[0][c] == few[1][c] == few[2][c] and few[4][c] == few[5][c] == few[None][c] for c in columns) or docs.where("doc_id < 6").count() > 0
        assert got.count() == whole.count() and got.where(" OR ".join(f"{c} IS NULL" for c in columns)).count() == 0
        assert operator.score(empty, labels).count() == 0
        none = operator.score(odd, labels.limit(0)).collect()
        assert {r[columns[0]] for r in none} == ({0.5} if operator is quality else {0.0}) and {r[columns[1]] for r in none} == {0}
    held = {r.doc_id: r.held_out for r in quality.score(odd, labels.limit(0)).collect()}
    assert held == {i: held_out(i) for i in (None, 0, 1, 2, 3, 4, 5)}


@pytest.mark.parametrize("shard", [2_000_000, 700])
def test_the_mix_is_sainte_lagues(spark, shard):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source").limit(120)
    rows = [tuple(r) for r in docs.collect()] + [(9001, None, "web"), (9002, "", None), (9003, "one two three", None), (9004, "x " * 999, "zz")]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, size int, target double")
    got = sorted((r.doc_id, r["size"], round(r.target, 6), r.taken) for r in mixing.mix(docs, shard=shard).collect())
    assert got == sorted((i, s, round(t, 6), n) for i, s, t, n in mixed(rows, shard=shard))
    assert all(n <= 2 * s for _, s, _, n in got)
