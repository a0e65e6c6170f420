"""Secrets in texts: fixed patterns, and sliding-window entropy over candidate strings.

Base kinds, each leftmost and non-overlapping: ``assign`` (a keyword, a sign and
a value of 12 characters or more), ``access`` (18 or more), ``hex`` (16 or
more). The method adds ``entropy`` spans: in candidate strings of one character
class the Shannon entropy of each window of ``WINDOW`` characters is kept by
counts that change by one character in and one out; a span goes from the first
window at the class's threshold to the last. What the allow-list names parts a
candidate, so no window reaches into it; a candidate that equals an allowed form
is suppressed as a whole. Base spans are not.

Positions are code points, with the end exclusive. They come from the lengths
of matches and of what lies between, by sums over blocks of a square root's
length, so texts with very many matches take little more than linear time. The
counts of a window stand in seven whole numbers, five bits a character, and the
entropy in whole numbers too, so a step costs the same however long a candidate
is and no rounding adds up. All is done by SQL functions, in one pass, without
a shuffle.

Defined cases: null texts count as empty; empty texts have no spans; repeated
rows are returned each; rows with a null id are scanned; an empty table gives
no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join([_either("password"), _either("passwd"), _either("secret"), _either("token"), _either("api") + "_?" + _either("key")])
ASSIGN = rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs end where these classes end, so the least lengths can stand in the patterns.
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
WINDOW = 20
#: Character classes of candidates: pattern, bits that a window must reach, and what a candidate must hold.
CLASSES = (
    (f"[0-9a-fA-F]{{{WINDOW},}}", 3.0, ""),
    (f"[A-Za-z0-9+/_=-]{{{WINDOW},}}", 3.8, "(?s)(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"),
    (f"(?<![A-Za-z0-9])[a-z0-9]{{{WINDOW},}}(?![A-Za-z0-9])", 3.5, "(?s)(?=(.*[0-9]){4})(?=.*[a-z])"),
    (f"(?<![A-Za-z0-9])[A-Z0-9]{{{WINDOW},}}(?![A-Za-z0-9])", 3.5, "(?s)(?=(.*[0-9]){4})(?=.*[A-Z])"),
)
#: Well-known harmless strings: placeholders, which part a candidate, and forms of whole candidates (UUIDs, and words joined by signs).
PLACEHOLDERS = "(?i)example|placeholder|dummy|xxxx|0123456789|abcdefgh"
ALLOW = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^[A-Za-z]+([-_/=+][A-Za-z]+)*$",
)
#: c log2 c in whole numbers, for the counts of a window.
_UNIT = 1 << 40
_G = "array(" + ", ".join(f"{round(c * math.log2(c) * _UNIT) if c > 1 else 0}L" for c in range(WINDOW + 1)) + ")"


def _quoted(pattern: str) -> str:
    return "r\"" + pattern + "\"" if '"' not in pattern else "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _before(lengths: str) -> str:
    """The sums of all earlier elements of an array, by blocks of a square root's length."""
    block = f"greatest(CAST(ceil(sqrt(size({lengths}))) AS INT), 1)"
    cut = f"transform(sequence(0, CAST((size({lengths}) - 1) DIV {block} AS INT)), b -> slice({lengths}, b * {block} + 1, {block}))"
    sums = f"transform({cut}, b -> aggregate(b, 0, (s, x) -> s + x))"
    append = "(a, x) -> named_struct('at', a.at + x, 'out', concat(a.out, array(a.at))), a -> a.out)"
    bases = f"aggregate({sums}, named_struct('at', 0, 'out', CAST(array() AS array<int>)), {append}"
    inner = f"aggregate(b, named_struct('at', base, 'out', CAST(array() AS array<int>)), {append}"
    return f"IF(size({lengths}) = 0, CAST(array() AS array<int>), flatten(zip_with({cut}, {bases}, (b, base) -> {inner})))"


def _parts(name: str, pattern: str, valued: bool = False) -> dict[str, str]:
    """Matches, gaps before them and values of one pattern; texts without a match are not cut."""
    p = _quoted(pattern)
    parts = {"m": f"regexp_extract_all(_text, {p}, 0)", "g": f"split(_text, {p}, -1)"}
    if valued:
        parts["v"] = f"regexp_extract_all(_text, {p}, 2)"
    return {f"{name}{k}": f"IF(_text RLIKE {p}, {v}, NULL)" for k, v in parts.items()}


def _places(name: str, least: int = 0) -> str:
    """All matches with their places, from ``{name}b``, the lengths before each; ``least`` is the least length of the value."""
    m, g, v, b = (f"{name}{k}" for k in "mgvb")
    begin = f"{b}[i] + length({g}[i])"
    spans = f"transform({m}, (x, i) -> named_struct('s', {begin}, 'e', {begin} + length(x), 'm', x{f', {chr(39)}v{chr(39)}, length({v}[i])' if least else ''}))"
    return f"coalesce({f'filter({spans}, x -> x.v >= {least})' if least else spans}, array())"


def _windows(bits: float) -> str:
    """From the character codes ``y.c`` the first and last window that reach ``bits``.

    ``n`` has the counts of the window's characters, ``f`` the sum of c log2 c;
    each step adds one character and, past the first window, takes one away.
    """
    # an entropy of bits or more means that the sum is at most this
    most = math.floor((math.log2(WINDOW) - bits) * WINDOW * _UNIT)
    count = lambda k: f"CAST(shiftright(a.n[{k} DIV 12], 5 * ({k} % 12)) & 31 AS INT)"
    into, out = "y.c[i]", f"y.c[i - {WINDOW}]"
    # first one character leaves, then one comes in
    step = f"IF(i < {WINDOW}, -1, {out})"
    left = f"IF(o < 0, a, named_struct('n', transform(a.n, (w, k) -> IF(k = o DIV 12, w - shiftleft(1L, 5 * (o % 12)), w)), 'f', a.f - g[{count('o')}] + g[{count('o')} - 1], 'lo', a.lo, 'hi', a.hi))"
    came = f"named_struct('n', transform(a.n, (w, k) -> IF(k = {into} DIV 12, w + shiftleft(1L, 5 * ({into} % 12)), w)), 'f', a.f - g[{count(into)}] + g[{count(into)} + 1], 'lo', a.lo, 'hi', a.hi)"
    seen = f"named_struct('n', a.n, 'f', a.f, 'lo', IF(a.lo IS NULL AND i >= {WINDOW - 1} AND a.f <= {most}L, i - {WINDOW - 1}, a.lo), 'hi', IF(i >= {WINDOW - 1} AND a.f <= {most}L, i + 1, a.hi))"
    zero = "named_struct('n', array_repeat(0L, 7), 'f', 0L, 'lo', CAST(NULL AS INT), 'hi', CAST(NULL AS INT))"
    body = f"transform(transform(transform(transform(array({step}), o -> {left}), a -> {came}), a -> {seen}), a -> a)[0]"
    return f"transform(array({_G}), g -> aggregate(sequence(0, size(y.c) - 1), {zero}, (a, i) -> {body}))[0]"


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Returns ``id_column, n_assign, n_access, n_hex, base, spans, entropy``; spans are ``array<struct<s, k, e>>`` in order."""
    rows = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    allowed = " OR ".join(f"x.m RLIKE {_quoted(p)}" for p in ALLOW)
    names = {"_0": ASSIGN, "_1": ACCESS, "_2": HEX} | {f"_c{i}": p for i, (p, *_) in enumerate(CLASSES)}
    cut = rows.select("_id", *[F.expr(e).alias(c) for k, p in names.items() for c, e in _parts(k, p, p == ASSIGN).items()])
    cut = cut.select("*", *[F.expr(f"transform({k}m, (x, i) -> length({k}g[i]) + length(x))").alias(f"{k}l") for k in names])
    cut = cut.select("*", *[F.expr(_before(f"{k}l")).alias(f"{k}b") for k in names])
    found = cut.select("_id", *[F.expr(_places(k, 12 if p == ASSIGN else 0)).alias(k) for k, p in names.items()])
    for i, (_, bits, held) in enumerate(CLASSES):
        # candidates, parted by placeholders into pieces with their places, then the pieces' character codes, then windows
        test = f"NOT ({allowed})" + (f" AND x.m RLIKE {_quoted(held)}" if held else "")
        word = _quoted(PLACEHOLDERS)
        pieces = f"transform(filter(_c{i}, x -> {test}), x -> IF(x.m RLIKE {word}, named_struct('s', x.s, 'p', split(x.m, {word}, -1), 'w', regexp_extract_all(x.m, {word}, 0)), named_struct('s', x.s, 'p', array(x.m), 'w', CAST(array() AS array<string>))))"
        found = found.withColumn(f"_c{i}", F.expr(pieces))
        found = found.withColumn(f"_c{i}", F.expr(f"transform(_c{i}, x -> named_struct('s', x.s, 'p', x.p, 'l', transform(x.p, (p, j) -> length(p) + length(coalesce(get(x.w, j), '')))))"))
        found = found.withColumn(f"_c{i}", F.expr(f"flatten(transform(_c{i}, x -> zip_with(x.p, {_before('x.l')}, (p, b) -> named_struct('s', x.s + b, 'm', p))))"))
        codes = f"transform(filter(_c{i}, x -> length(x.m) >= {WINDOW}), x -> named_struct('s', x.s, 'c', transform(split(x.m, ''), h -> ascii(h) - 43)))"
        found = found.withColumn(f"_c{i}", F.expr(codes))
        found = found.withColumn(f"_c{i}", F.expr(f"transform(_c{i}, y -> named_struct('s', y.s, 'w', {_windows(bits)}))"))
        found = found.withColumn(f"_c{i}", F.expr(f"transform(filter(_c{i}, x -> x.w.lo IS NOT NULL), x -> named_struct('s', x.s + x.w.lo, 'k', 3, 'e', x.s + x.w.hi))"))
    base = "array_sort(concat(" + ", ".join(f"transform(_{k}, x -> named_struct('s', x.s, 'k', {k}, 'e', x.e))" for k in range(3)) + "))"
    return found.select(
        F.col("_id").alias(id_column),
        *[F.expr(f"CAST(size(_{k}) AS BIGINT)").alias(f"n_{name}") for k, name in enumerate(KINDS[:3])],
        F.expr(base).alias("base"),
        F.expr("array_sort(array_distinct(concat(" + ", ".join(f"_c{i}" for i in range(len(CLASSES))) + ")))").alias("entropy"),
    ).withColumn("spans", F.expr("array_sort(concat(base, entropy))"))


def joined(spans: str) -> str:
    """SQL for ``kind:start:end`` of all spans, joined by commas."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat_ws(':', array({names})[x.k], x.s, x.e)), ',')"


def digests(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.expr(f"sha2({joined('base')}, 256)").alias("base_sha256"), F.expr(joined("spans")).alias("spans"))
