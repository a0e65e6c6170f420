"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources, by code point with null last, weigh 5, 2, 1, repeating, and share
``share`` times all words. A source's target stops at ``most`` times its size;
the excess goes to the others by weight until none is above. In closed form
the targets are ``min(most * size, level * weight)``, and one sort of the
sources by ``most * size / weight`` finds the level.

Blocks of ``block`` words are apportioned to the sources by highest quotients
``target / (2j + 1)``, and each source's blocks to its shards likewise by their
words. Only the seats near each exact share are ranked, so the number of
quotients is bounded by the sources and shards, not by the words. A shard lays
its documents out in an order seeded by ``seed`` and takes its quota of equal
blocks: whole rounds first, then consecutive blocks from a seeded start.

One text serves both engines. Returns ``doc_id, size, source_size, target,
taken, source`` for each input row. Null texts have size 0, a null source is a
source of its own, repeated rows are rows of their own, and an empty table
gives no rows. Shards hold about ``shard`` words, so a hot source is spread
over many of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from rooftide.llm.shared import materialize

WORD = r"[^\x20\x09-\x0D]+"

_PLAN = """
WITH d AS (
  SELECT doc_id, source, size, {h1} AS h1, {h2} AS h2
  FROM (SELECT *, md5(concat('{seed}', '/', coalesce(CAST(doc_id AS {string}), 'null'))) AS digest FROM sized) AS x),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source IS NULL, source) AS sid,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         CAST(sum(source_size) OVER () AS DOUBLE) * {share}e0 AS whole
  FROM s),
r AS (
  SELECT *, source_size * {most}e0 AS top,
         whole - coalesce(sum(source_size * {most}e0) OVER (ORDER BY source_size * {most}e0 / weight, sid
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS rest,
         sum(weight) OVER (ORDER BY source_size * {most}e0 / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM w),
t AS (
  SELECT source, sid, source_size, whole, CASE WHEN top * weights <= rest * weight THEN top ELSE least(top, weight * max(rest / weights) OVER ()) END AS target
  FROM r),
q1 AS (
  SELECT sid, target, low, free, explode(sequence(low, high)) AS j
  FROM (SELECT *, floor(whole / {block} + 0.5e0) - sum(low) OVER () AS free FROM (
    SELECT *, CAST(greatest(0e0, floor(target / {block} - n * (target / whole) / 2 - 1)) AS BIGINT) AS low,
           CAST(ceil(target / {block} + n * (target / whole) / 2 + 1) AS BIGINT) AS high
    FROM (SELECT *, CAST(count(*) OVER () AS DOUBLE) AS n FROM t WHERE target > 0) AS x) AS y) AS z),
seats AS (
  SELECT sid, max(low) + count(CASE WHEN place <= free THEN 1 END) AS blocks
  FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, sid, j) AS place FROM q1) AS x GROUP BY sid),
e AS (
  SELECT d.doc_id, d.source, d.size, d.h2, t.sid, t.source_size, t.target,
         d.h1 % CAST(greatest(1, ceil(t.source_size / {shard}e0)) AS BIGINT) AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
sh AS (SELECT sid, shard, CAST(sum(size) AS BIGINT) AS words, max(source_size) AS source_size FROM e GROUP BY sid, shard HAVING sum(size) > 0),
q2 AS (
  SELECT sid, shard, words, low, free, explode(sequence(low, high)) AS j
  FROM (SELECT *, blocks - sum(low) OVER (PARTITION BY sid) AS free FROM (
    SELECT *, CAST(greatest(0e0, floor(blocks * (words / CAST(source_size AS DOUBLE)) - n * (words / CAST(source_size AS DOUBLE)) / 2 - 1)) AS BIGINT) AS low,
           CAST(ceil(blocks * (words / CAST(source_size AS DOUBLE)) + n * (words / CAST(source_size AS DOUBLE)) / 2 + 1) AS BIGINT) AS high
    FROM (SELECT sh.*, seats.blocks, CAST(count(*) OVER (PARTITION BY sh.sid) AS DOUBLE) AS n FROM sh JOIN seats ON sh.sid = seats.sid) AS x) AS y) AS z),
quota AS (
  SELECT sid, shard, words, parts, least(2 * parts, blocks) AS blocks, {h3} % parts AS begin
  FROM (
    SELECT sid, shard, max(words) AS words, max(low) + count(CASE WHEN place <= free THEN 1 END) AS blocks,
           CAST(greatest(1, floor(max(words) / {block}e0 + 0.5e0)) AS BIGINT) AS parts,
           md5(concat('{seed}', '/', CAST(sid AS {string}), '/', CAST(shard AS {string}))) AS digest
    FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY words / CAST(2 * j + 1 AS DOUBLE) DESC, shard, j) AS place FROM q2) AS x
    GROUP BY sid, shard) AS y),
span AS (
  SELECT sid, shard, CAST(floor(blocks / CAST(parts AS DOUBLE)) AS BIGINT) AS rounds,
         CAST(floor(begin * words / CAST(parts AS DOUBLE)) AS BIGINT) AS a,
         CAST(floor(least(begin + blocks % parts, parts) * words / CAST(parts AS DOUBLE)) AS BIGINT) AS z,
         CAST(floor(greatest(begin + blocks % parts - parts, 0) * words / CAST(parts AS DOUBLE)) AS BIGINT) AS wrapped
  FROM quota),
o AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY sid, shard ORDER BY h2, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
  FROM e)
SELECT o.doc_id, o.size, o.source_size, o.target, o.source,
       CAST(coalesce(span.rounds * o.size + greatest(0, least(o.upto, span.z) - greatest(o.upto - o.size, span.a))
         + greatest(0, least(o.upto, span.wrapped) - (o.upto - o.size)), 0) AS BIGINT) AS taken
FROM o LEFT JOIN span ON o.sid = span.sid AND o.shard = span.shard
"""


def plan(dialect: str, share: float = 1.5, most: int = 2, block: int = 16, shard: int = 2_000_000, seed: int = 17) -> str:
    """The mixing query over a table ``sized(doc_id, source, size)``, for ``spark`` or ``duckdb``."""
    digits = {"h1": 1, "h2": 9, "h3": 1}
    if dialect == "spark":
        parts = {k: f"CAST(conv(substr(digest, {i}, 8), 16, 10) AS BIGINT)" for k, i in digits.items()}
        return _PLAN.format(string="STRING", share=share, most=most, block=block, shard=shard, seed=seed, **parts)
    parts = {k: f"CAST('0x' || substr(digest, {i}, 8) AS BIGINT)" for k, i in digits.items()}
    text = _PLAN.format(string="VARCHAR", share=share, most=most, block=block, shard=shard, seed=seed, **parts)
    return text.replace("explode(sequence(low, high))", "unnest(range(low, high + 1))")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Mix ``docs(doc_id, text, source)``; options are those of :func:`plan`."""
    sized = materialize(docs.selectExpr("doc_id", "source", rf"CAST(coalesce(regexp_count(text, r'{WORD}'), 0) AS BIGINT) AS size"))
    return docs.sparkSession.sql(plan("spark", **options).replace("FROM sized)", "FROM {sized})"), sized=sized)


def oracle(**options) -> str:
    sized = f"sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents)"
    return plan("duckdb", **options).replace("WITH d AS", f"WITH {sized}, d AS", 1)
