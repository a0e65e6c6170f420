"""Corpus pipeline: the stages that turn raw documents into encoded training text.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rooftide.llm import bpe, jaccard, linededup, mixing, quality
from rooftide.llm.queries import read, vocabulary_path
from rooftide.llm.shared import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as 1 stay."""
    scored = quality.score(docs, read(spark, sf_dir, "labels"), keep=tuple(c for c in COLUMNS if c != "doc_id"))
    return scored.where("predicted = 1").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of two lines or more go, and documents of which nothing else was left; the first occurrence stays."""
    left = linededup.passages(docs).where(r"n_removed = 0 OR text RLIKE '[^ \\t\\r\\n]'")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at 0.8 or more the smallest id stays."""
    found = jaccard.join(docs, 5, 4, 5)
    return docs.join(found.where("component_id < doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as many times as the mix takes its words, to the nearest whole."""
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = taken.where("size > 0").select("_id", F.round(F.col("taken") / F.col("size")).cast("int").alias("times")).where("times > 0")
    joined = docs.join(times, docs.doc_id.eqNullSafe(times["_id"]))
    return joined.withColumn("_n", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of them and of the text decoded from them."""
    return bpe.encode_decode(docs, vocabulary_path(), more=("ids",))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", one_of_each_group),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Fitted models and set similarity are beyond SQL; tests/llm/test_pipeline.py holds the stages and the whole pipeline against plain forms.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each to what the one before has kept."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
