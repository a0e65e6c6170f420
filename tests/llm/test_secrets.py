"""Secret spans against a plain scan, and the time of long texts."""

import math
import random
import re
import time

import pytest

from rooftide.llm import secretscan
from rooftide.llm.secretscan import ALLOW, CLASSES, KINDS, PLACEHOLDERS, WINDOW

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def entropy(window):
    return sum(-window.count(c) / len(window) * math.log2(window.count(c) / len(window)) for c in set(window))


def plain(text):
    """Base spans and entropy spans of a text, window by window."""
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 12]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    more = set()
    for pattern, bits, held in CLASSES:
        for m in re.finditer(pattern, text):
            whole = m.group()
            if any(re.search(a, whole) for a in ALLOW) or (held and not re.search(held, whole)):
                continue
            at = 0
            for end, after in [(w.start(), w.end()) for w in re.finditer(PLACEHOLDERS, whole)] + [(len(whole), 0)]:
                hits = [i for i in range(at, end - WINDOW + 1) if entropy(whole[i : i + WINDOW]) >= bits - 1e-9]
                if hits:
                    more.add((m.start() + hits[0], 3, m.start() + hits[-1] + WINDOW))
                at = after
    return sorted(base), sorted(more)


def random_text(r):
    alphabets = ["0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcABCxyz0189+/_=-", "ab01", "aB3dE6gH9kLmNpQrStUvWxYz"]
    parts = []
    for _ in range(r.randrange(12)):
        run = "".join(r.choice(r.choice(alphabets[:1]) if r.random() < 0.1 else alphabets[r.randrange(6)]) for _ in range(r.randrange(3)))
        alphabet = r.choice(alphabets)
        key = "".join(r.choice(alphabet) for _ in range(r.choice([5, 12, 19, 20, 21, 30, 64])))
        parts.append(r.choice([run, key, key, "password=" + key, "Api_Key: '" + key, "TOKEN\":  " + key, "AKIA" + key.upper(), "example" + key, key + "xxxxXXXX" + key, "😀漢", "one-two-three-four-five", "123e4567-e89b-12d3-a456-426614174000"]))
        parts.append(r.choice([" ", "\n", "", ".", "é", "😀"]))
    return "".join(parts)


def test_spans_are_those_of_a_plain_scan(spark):
    r = random.Random(11)
    texts = [random_text(r) for _ in range(400)] + ["", None, "a" * 50, "secret=" * 5 + "x" * 12, "passwordpassword=abcdefghijkl=token=abcdefghijklm", "Secret = short", "deadbeefdeadbeef" * 9]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[3])], "doc_id long, text string").repartition(3)
    for got in secretscan.scan(docs).collect():
        base, more = plain(texts[3 if got.doc_id is None else got.doc_id])
        assert [tuple(x) for x in got.base] == base, texts[got.doc_id or 3]
        assert [tuple(x) for x in got.entropy] == more, texts[got.doc_id or 3]
        assert [got.n_assign, got.n_access, got.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
    row = secretscan.digests(docs.where("doc_id = 405")).first()
    base, more = plain(texts[405])
    assert row.spans == ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(base + more))


@pytest.mark.parametrize(("n", "most"), [(10_000, 2.0), (1_000_000, 60.0)])
def test_long_texts_take_little_more_than_linear_time(spark, n, most):
    r = random.Random(1)
    run = "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=n))
    many = " ".join("%016x" % r.getrandbits(64) for _ in range(n // 50))
    secretscan.scan(spark.createDataFrame([(0, "warm up password=abcdefghijkl aB3dE6gH9kLmNpQrStUvWxYz")], "doc_id long, text string")).collect()
    for text in (run, many):
        began = time.time()
        got = secretscan.scan(spark.createDataFrame([(0, text)], "doc_id long, text string")).first()
        assert time.time() - began < most
        assert got.n_hex == len(re.findall("[0-9a-f]{16,}", text))
