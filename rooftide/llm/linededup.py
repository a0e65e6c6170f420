"""Removal of repeated multi-line chunks with content-defined boundaries.

Each line has a hash, and each place a rolling hash over the line and the one
before. A chunk starts where the rolling hash is a local minimum, so boundaries
depend on nearby lines only and shift along with them, and inner chunks have
two lines at least. Of a multi-line chunk that occurs more than once anywhere,
the occurrence with the smallest id, then the first line, stays; the others are
removed once all occurrences' bytes have been compared and agree. (Chunks that
share a digest with other bytes are left alone.)

Chunks miss most passages of a few lines, as their edges depend on the lines
around them. ``passages`` is exact instead: every two lines that follow each
other meet all others by digest, and of equal ones the first stays. Two lines
here have text; blank lines between them belong to them, and a line with only
blank lines around it is single. A later passage of any length is the union of
its pairs, so it goes as a whole. A pair that overlaps the first occurrence
stays. The first occurrence of every line with text always stays.

Digests, not texts, are grouped, with partial counts before the shuffle, and
digests that very many places share are joined by broadcast
(:func:`rooftide.llm.shared.join_hot`). Texts are shuffled once, to the places
of their repeated chunks, and written; the comparison and the final removal both
read that table.

A row is known by its id and its text. Defined cases: rows that share an id
keep their own chunks, and the one with the smaller digest of its text comes
first; rows with equal id and text count as one place, so they lose the same
chunks and don't remove each other's; null texts stay null and have no lines;
empty texts are one empty line; rows with a null id are returned unchanged and
keep nothing from being first; single lines are never removed; an empty table
gives no rows. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rooftide.llm.shared import join_hot, materialize

#: What chunks meet by.
DIGEST = "md5({x})"

_HASH = "CAST(conv(substr(md5(x), 1, 8), 16, 10) AS BIGINT)"
#: Starts of chunks, from the lines of a text.
_LINES = "split(_text, '\\n', -1)"
_ROLLING = f"transform(_h, (x, i) -> (x + IF(i = 0, 0, 31 * _h[i - 1])) % 4294967291)"
_STARTS = "concat(array(0), filter(sequence(0, size(_r) - 1), i -> i > 0 AND _r[i] < _r[i - 1] AND (i = size(_r) - 1 OR _r[i] < _r[i + 1])))"
#: Lines with text.
_FILLED = "array_compact(transform(_lines, (x, i) -> IF(trim(BOTH ' \\t\\r' FROM x) = '', NULL, i)))"
#: Places of the lines that stay, in linear time.
_KEPT = "array_except(sequence(0, size(_lines) - 1), flatten(transform(_gone, g -> sequence(g.at, g.at + g.len - 1))))"


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with its texts reduced by chunks, and the columns ``n_lines`` and ``n_removed`` (long)."""
    return _without(docs, id_column, text_column, _chunks)


def passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """As ``dedup``, for every passage of two lines or more."""
    return _without(docs, id_column, text_column, _pairs)


def _chunks(known: DataFrame) -> DataFrame:
    lines = known.select("_id", "_m", F.expr(_LINES).alias("_lines")).withColumn("_h", F.expr(f"transform(_lines, x -> {_HASH})"))
    starts = lines.withColumn("_r", F.expr(_ROLLING)).withColumn("_s", F.expr(_STARTS))
    bytes_ = "array_join(slice(_lines, a + 1, coalesce(get(_s, k + 1), size(_lines)) - a), '\\n')"
    return starts.where("size(_lines) > 1").select(
        "_id",
        "_m",
        F.expr(
            "inline(filter(transform(_s, (a, k) -> struct(a AS at, coalesce(get(_s, k + 1), size(_lines)) - a AS len,"
            f" {DIGEST.format(x=bytes_)} AS digest)), c -> c.len > 1))"
        ),
    )


def _pairs(known: DataFrame) -> DataFrame:
    # explode keeps the lines from being split again for every pair
    lines = known.select("_id", "_m", F.explode(F.expr(f"array({_LINES})")).alias("_lines"))
    bytes_ = "array_join(slice(_lines, _k[j] + 1, _k[j + 1] - _k[j] + 1), '\\n')"
    return lines.select("_id", "_m", "_lines", F.explode(F.expr(f"array({_FILLED})")).alias("_k")).where("size(_k) > 1").select(
        "_id",
        "_m",
        F.expr(
            "inline(transform(sequence(0, size(_k) - 2), j -> struct(_k[j] AS at, _k[j + 1] - _k[j] + 1 AS len,"
            f" {DIGEST.format(x=bytes_)} AS digest)))"
        ),
    )


def _without(docs: DataFrame, id_column: str, text_column: str, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    rest = [c for c in docs.columns if c not in (id_column, text_column)]
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.lit(0).alias("_")).alias("_rest"))
    known = rows.where("_id IS NOT NULL").withColumn("_m", F.expr("coalesce(md5(_text), '')"))
    unknown = rows.where("_id IS NULL")

    found = materialize(find(known))
    groups = materialize(found.groupBy("digest").agg(F.min(F.struct("_id", "_m", "at")).alias("first"), F.count("*").alias("n")).where("n > 1"))
    again = join_hot(found, groups, ["digest"], "n").withColumn("later", F.expr("first._id <> _id OR first._m <> _m OR at >= first.at + len"))
    lists = again.groupBy("_id", "_m").agg(F.collect_set(F.struct("at", "len", "digest", "later")).alias("_chunks"))
    out = materialize(known.join(lists, ["_id", "_m"], "left"))
    # lines are split below each explode, not again for every chunk above it
    pieces = out.where("_chunks IS NOT NULL").select("_chunks", F.explode(F.expr(f"array({_LINES})")).alias("_lines"))
    pieces = pieces.select("_lines", F.explode("_chunks").alias("c")).select("c.digest", F.expr("array_join(slice(_lines, c.at + 1, c.len), '\\n')").alias("bytes"))
    other = materialize(pieces.groupBy("digest").agg(F.min("bytes").alias("a"), F.max("bytes").alias("z")).where("a <> z").select("digest"))
    left = "filter(_chunks, c -> c.later)"
    if not other.isEmpty():
        alone = out.select("_id", "_m", F.explode("_chunks.digest").alias("digest")).join(other, "digest").groupBy("_id", "_m").agg(F.collect_set("digest").alias("_alone"))
        out = out.join(alone, ["_id", "_m"], "left")
        left = "filter(_chunks, c -> c.later AND NOT coalesce(array_contains(_alone, c.digest), false))"
    gone = F.expr(f"IF(size({left}) > 0, transform({left}, c -> named_struct('at', c.at, 'len', c.len)), NULL)")
    out = out.select("_id", "_text", "_rest", gone.alias("_gone"))
    out = out.unionByName(unknown.withColumn("_gone", F.lit(None).cast("array<struct<at:int,len:int>>")))
    out = out.select("_id", "_text", "_rest", "_gone", F.explode(F.expr(f"array(IF(_gone IS NULL, array(), {_LINES}))")).alias("_lines"))
    out = out.withColumn("_kept", F.expr(f"IF(_gone IS NULL, NULL, {_KEPT})"))
    return out.select(
        F.col("_id").alias(id_column),
        F.expr("IF(_gone IS NULL, _text, array_join(transform(_kept, i -> _lines[i]), '\\n'))").alias(text_column),
        F.expr(f"CAST(IF(_text IS NULL, 0, size({_LINES})) AS BIGINT)").alias("n_lines"),
        F.expr("CAST(IF(_gone IS NULL, 0, size(_lines) - size(_kept)) AS BIGINT)").alias("n_removed"),
        *[F.col(f"_rest.c{i}").alias(c) for i, c in enumerate(rest)],
    )


#: The digest query for DuckDB, by rows and windows.
ORACLE = """
WITH l AS (SELECT doc_id, md5(text) AS m, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL) AS x),
h AS (SELECT *, (CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) + 31 * coalesce(lag(CAST('0x' || substr(md5(line), 1, 8) AS BIGINT)) OVER w, 0)) % 4294967291 AS r
      FROM l WINDOW w AS (PARTITION BY doc_id, m ORDER BY i)),
b AS (SELECT *, CASE WHEN r < lag(r) OVER w AND coalesce(r < lead(r) OVER w, true) THEN 1 ELSE 0 END AS edge FROM h WINDOW w AS (PARTITION BY doc_id, m ORDER BY i)),
k AS (SELECT *, sum(edge) OVER (PARTITION BY doc_id, m ORDER BY i) AS chunk FROM b),
c AS (SELECT doc_id, m, chunk, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS bytes FROM k GROUP BY doc_id, m, chunk),
d AS (SELECT *, n > 1 AND row_number() OVER (PARTITION BY bytes, n > 1 ORDER BY doc_id, m, chunk) > 1 AS gone FROM c),
t AS (SELECT doc_id, m, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN n ELSE 0 END) AS BIGINT) AS n_removed,
             coalesce(string_agg(CASE WHEN NOT gone THEN bytes END, chr(10) ORDER BY chunk), '') AS text FROM d GROUP BY doc_id, m)
SELECT d.doc_id, t.n_lines, t.n_removed, sha256(t.text) AS text_sha256 FROM documents d JOIN t ON d.doc_id = t.doc_id AND md5(d.text) = t.m
UNION ALL SELECT doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), NULL FROM documents WHERE text IS NULL
"""
