"""URL verdicts against a plain loop over entries."""

import datetime as d
import random
import re

import duckdb

from rooftide.llm import urlfilter

CAPTURES, ENTRIES = "page_id long, url string, fetched_on date", "domain string, listed_on date, action string"


def day(n):
    return None if n is None else d.date(2024, 1, 1) + d.timedelta(n)


def plain_host(url):
    m = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)", url or "")
    return m.group(1).lower().rstrip(".") if m else ""


def plain(url, on, entries):
    host = plain_host(url)
    if not host or on is None:
        return "none", None
    address = host[0] == "[" or not host.strip("0123456789.")
    names = [host] if address else [".".join(host.split(".")[i:]) for i in range(host.count(".") + 1)]
    for name in names:
        dated = [(l, a) for n, l, a in entries if n == name and l is not None and a is not None and l <= on]
        if dated:
            last = max(l for l, _ in dated)
            action = max(a for l, a in dated if l == last)
            if action != "remove":
                return action, name
    return "none", None


def test_verdicts_are_those_of_a_plain_loop(spark):
    r = random.Random(4)
    hosts = ["a.b.org", "b.org", "B.ORG.", "x.a.b.org", "c.net", "10.0.0.1", "0.0.1", "[2001:db8::1]", "hot.example", "u:p@b.org:80", ""]
    captures = [(i, r.choice(["http://", "https://", "ftp://"]) + r.choice(hosts) + r.choice(["", "/", "/x?y#z", "?q"]), day(r.randrange(60))) for i in range(300)]
    captures += [(1000 + i, "http://hot.example/p", day(7)) for i in range(600)] + [(2000, None, day(1)), (2001, "nothing", day(1)), (2002, "http://b.org", None), (None, "http://b.org", day(50))]
    entries = [(r.choice(["b.org", "a.b.org", "org", "c.net", "0.0.1", "10.0.0.1", "[2001:db8::1]", "hot.example", "example"]), day(r.randrange(60)), r.choice(["block", "allow", "remove"])) for _ in range(40)]
    entries += [("hot.example", day(3), "block"), ("hot.example", day(8), "remove"), (None, day(1), "block"), ("b.org", None, "block"), ("b.org", day(2), None)]
    got = urlfilter.judge(spark, spark.createDataFrame(captures, CAPTURES).repartition(3), spark.createDataFrame(entries, ENTRIES)).collect()
    assert len(got) == len(captures)
    for g in got:
        assert (g.verdict, g.entry_domain) == plain(g.url, g.fetched_on, entries), g


def test_repeated_captures_clashing_columns_and_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://b.org", day(5), "n", 3, "h")] * 3 + [(1, "http://b.org", day(1), "n", 3, "h")], CAPTURES + ", domain string, n int, host string")
    entries = spark.createDataFrame([("b.org", day(2), "block", "u", 1)], ENTRIES + ", url string, n int")
    got = sorted((g.fetched_on, g.captures, g.verdict, g.valid_from) for g in urlfilter.judge(spark, captures, entries).collect())
    assert got == [(day(1), 1, "none", None), (day(5), 3, "block", day(2))]
    assert urlfilter.judge(spark, captures.limit(0), entries).count() == 0
    assert {g.verdict for g in urlfilter.judge(spark, captures, entries.limit(0)).collect()} == {"none"}


def test_the_example_is_as_in_sql(spark):
    folder = "/root/testdata/sf0.001"
    want = sorted(map(repr, duckdb.sql(urlfilter.oracle().replace("FROM pages", f"FROM '{folder}/pages.parquet'")).fetchall()))
    got = urlfilter.example(spark, spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url"))
    assert sorted(repr(tuple(x)) for x in got.collect()) == want
