"""URL filters with dated lists: a temporal join of captures and list entries.

List entries ``(domain, listed_on, action)`` become validity intervals, each
lasting until the domain's next entry. A capture is held against its host and
each parent domain; the entry active on its fetch date decides, the most
specific domain first. ``block`` blocks, ``allow`` permits, ``remove`` ends an
earlier entry. Where a domain has several entries of one date, the greatest
action by name holds.

All is SQL. Hosts and dates are judged, not captures: captures are folded to
one row for each host and date, these are joined with the intervals by equality
of domains with a range condition on dates, and the verdicts return to the
captures. At most one interval of a domain matches, so a hot host multiplies
nothing; hosts and dates that more than one in 1,024 captures have (fewer than
1,024 of them, then) are joined by broadcast, so no task gets all of a host.

A host is taken in lower case, without user, port and trailing dots. Hosts that
are addresses (digits and dots, or in brackets) have no parent domains.

Defined cases: a null or hostless URL has verdict ``none``; a null fetch date
matches no entry; entries with a null domain, date or action are ignored;
repeated captures give one row with their number; empty tables give no rows,
or only verdicts ``none``; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)"

#: Captures and list entries from the pages table: fetch dates by page, entries by the hash of each host.
_TABLES = """
c0 AS (SELECT page_id, url, {day0} AS fetched_on FROM pages),
hosts AS (SELECT DISTINCT rtrim(lower(regexp_extract(url, {host}, 1)), '.') AS domain FROM pages WHERE url IS NOT NULL),
named AS (SELECT domain FROM hosts WHERE domain <> '' UNION SELECT regexp_extract(domain, '[^.]+[.][^.]+$', 0) AS domain FROM hosts WHERE domain <> ''),
coded AS (SELECT domain, {code} AS k FROM named),
entries AS (
  SELECT domain, {day1} AS listed_on, 'block' AS action FROM coded WHERE k % 4 > 0
  UNION ALL SELECT domain, {day2} AS listed_on, CASE k % 4 WHEN 2 THEN 'remove' ELSE 'allow' END AS action FROM coded WHERE k % 4 > 1
  UNION ALL SELECT domain, {day3} AS listed_on, 'block' AS action FROM coded WHERE k % 4 > 2)
"""
_JOIN = """
c AS (SELECT page_id, url, fetched_on, {rtrim} AS host, count(*) AS captures FROM {captures} GROUP BY page_id, url, fetched_on),
f AS (SELECT host, fetched_on, count(*) AS n FROM c WHERE host <> '' AND fetched_on IS NOT NULL GROUP BY host, fetched_on),
e AS (SELECT domain, listed_on, max(action) AS action FROM {entries} WHERE domain IS NOT NULL AND listed_on IS NOT NULL AND action IS NOT NULL GROUP BY domain, listed_on),
v AS (SELECT domain, action, listed_on AS valid_from, lead(listed_on) OVER (PARTITION BY domain ORDER BY listed_on) AS valid_to FROM e),
s AS ({suffixes}),
m AS (
  SELECT s.host, s.fetched_on, max({row}) AS named
  FROM s JOIN v ON s.domain = v.domain AND s.fetched_on >= v.valid_from AND (v.valid_to IS NULL OR s.fetched_on < v.valid_to)
  WHERE v.action <> 'remove' GROUP BY s.host, s.fetched_on),
hot AS (
  SELECT f.host, f.fetched_on, m.named, true AS known FROM f CROSS JOIN (SELECT sum(n) AS total FROM f) AS t
  LEFT JOIN m ON f.host = m.host AND f.fetched_on = m.fetched_on WHERE f.n * 1024 > t.total),
h AS (SELECT /*+ BROADCAST(hot) */ c.page_id, c.url, c.fetched_on, c.captures, c.host, hot.named, hot.known IS NOT NULL OR c.host = '' OR c.fetched_on IS NULL AS known
      FROM c LEFT JOIN hot ON c.host = hot.host AND c.fetched_on = hot.fetched_on)
SELECT page_id, url, fetched_on, captures, coalesce(named.action, 'none') AS verdict, named.domain AS entry_domain, named.valid_from AS valid_from FROM h WHERE known
UNION ALL SELECT h.page_id, h.url, h.fetched_on, h.captures, coalesce(m.named.action, 'none'), m.named.domain, m.named.valid_from
FROM h LEFT JOIN m ON h.host = m.host AND h.fetched_on = m.fetched_on WHERE NOT h.known
"""
#: Addresses, which have no parents.
_ADDRESS = "(substr(host, 1, 1) = '[' OR translate(host, '0123456789.', '') = '')"
_DAYS = {"day0": "page_id * 37 % 366", "day1": "k % 200", "day2": "k % 200 + 30 + k % 60", "day3": "k % 200 + 75 + k % 60"}


def _spark(captures: str, entries: str) -> str:
    parts = f"IF({_ADDRESS}, array(host), split(host, '[.]'))"
    suffixes = (
        "SELECT host, fetched_on, n, size(parts) - i + 1 AS depth, array_join(slice(parts, i, 1000000), '.') AS domain"
        f" FROM (SELECT *, explode(sequence(1, size(parts))) AS i FROM (SELECT *, {parts} AS parts FROM f) AS y) AS x"
    )
    row = "named_struct('depth', s.depth, 'domain', v.domain, 'action', v.action, 'valid_from', v.valid_from)"
    host = f"trim(TRAILING '.' FROM lower(coalesce(regexp_extract(url, r'{HOST}', 1), '')))"
    return _JOIN.format(rtrim=host, captures=captures, entries=entries, suffixes=suffixes, row=row)


def judge(spark: SparkSession, captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Verdicts for ``captures(page_id, url, fetched_on)`` under ``entries(domain, listed_on, action)``."""
    return spark.sql("WITH " + _spark("{captures}", "{entries}"), captures=captures, entries=entries)


def example(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Verdicts for all pages under the list made from their hosts."""
    days = {k: f"date_add(DATE'2024-01-01', CAST({v} AS INT))" for k, v in _DAYS.items()}
    tables = _TABLES.format(host=f"r'{HOST}'", code="CAST(conv(substr(md5(domain), 1, 6), 16, 10) AS BIGINT)", **days)
    tables = tables.replace("rtrim(lower(", "trim(TRAILING '.' FROM lower(").replace(", 1)), '.')", ", 1)))")
    return spark.sql(f"WITH {tables.replace('FROM pages', 'FROM {pages}')}, {_spark('c0', 'entries')}", pages=pages)


def oracle() -> str:
    days = {k: f"DATE '2024-01-01' + CAST({v} AS INTEGER)" for k, v in _DAYS.items()}
    tables = _TABLES.format(host=f"'{HOST}'", code="CAST('0x' || substr(md5(domain), 1, 6) AS BIGINT)", **days)
    parts = f"CASE WHEN {_ADDRESS} THEN [host] ELSE string_split(host, '.') END"
    suffixes = (
        "SELECT host, fetched_on, n, len(parts) - i + 1 AS depth, array_to_string(list_slice(parts, i, 1000000), '.') AS domain"
        f" FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT *, {parts} AS parts FROM f) AS y) AS x"
    )
    row = "struct_pack(depth := s.depth, domain := v.domain, action := v.action, valid_from := v.valid_from)"
    host = f"rtrim(lower(coalesce(regexp_extract(url, '{HOST}', 1), '')), '.')"
    return f"WITH {tables}, " + _JOIN.format(rtrim=host, captures="c0", entries="entries", suffixes=suffixes, row=row)
