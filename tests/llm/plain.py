"""Plain forms of the corpus operators, by loops over whole texts, for the tests to hold results against."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall((text or "").encode())


def lowered(word):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in word)


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def statistics(text):
    """The quality statistics of one text, counted one by one."""
    text = text or ""
    w = [lowered(x) for x in words(text)]
    data = text.encode()
    n, chars = len(w), len(text)
    count = lambda test: sum(map(test, data))
    accented = sum(a == 0xC3 and 0x80 <= b < 0x9F for a, b in zip(data, data[1:]))
    upper = count(lambda b: 65 <= b <= 90) + accented
    lower, digits = count(lambda b: 97 <= b <= 122), count(lambda b: 48 <= b <= 57)
    marks = count(lambda b: 33 <= b < 127 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
    lengths = [len(x) for x in w]
    mean = sum(lengths) / max(n, 1)
    var = sum(x * x for x in lengths) / max(n, 1) - mean**2
    pairs = list(zip(w, w[1:]))
    part = lambda a, b: np.log(a / max(b, 1) + 1e-3)
    return [
        np.log1p(n), np.log1p(mean), np.log1p(np.sqrt(max(var, 0))), part(upper, chars), part(lower, chars), part(digits, chars), part(marks, chars),
        part(data.count(b"!"), chars), part(count(lambda b: b >= 128), chars), part(data.count(b"\n"), n), part(sum(a == b for a, b in pairs), n),
        part(max((w.count(x) for x in set(w)), default=0), n), part(n - len(set(w)), n), part(len(pairs) - len(set(pairs)), len(pairs)),
    ]


def density(rows, x, shrink=0.1):
    """Log-densities of ``x`` under the shrunk normal of ``rows``, straight from the definition."""
    s = np.cov(np.array(rows).T)
    s = (1 - shrink) * s + shrink * (0.5 * np.diag(np.diag(s)) + 0.5 * np.trace(s) / len(s) * np.eye(len(s))) + 1e-4 * np.eye(len(s))
    d = np.array(x) - np.mean(rows, axis=0)
    return np.array([-0.5 * v @ np.linalg.inv(s) @ v for v in d]) - 0.5 * np.linalg.slogdet(s)[1]


def quality(texts, labels, keep=4):
    """``doc_id: (difference of log-densities, cut)`` with all labelled rows that aren't held out."""
    x = {i: statistics(t) for i, t in texts.items()}
    learn = [(i, y) for i, y in labels if i in x and not held_out(i)]
    by = [[x[i] for i, y in learn if y == c] for c in (0, 1)]
    d = dict(zip(x, density(by[1], list(x.values())) - density(by[0], list(x.values()))))
    order = sorted((d[i], y) for i, y in learn)
    gain = [sum(y == 0 for _, y in order[: j + 1]) / len(by[0]) + keep * (1 - sum(y == 1 for _, y in order[: j + 1]) / len(by[1])) for j in range(len(order))]
    best = int(np.argmax(gain))
    return d, (order[best][0] + order[min(best + 1, len(order) - 1)][0]) / 2


def passages(texts):
    first, gone = {}, {i: set() for i in texts}
    for i, t in sorted(texts.items()):
        lines = t.split("\n")
        filled = [j for j, line in enumerate(lines) if line.strip(" \t\r")]
        for a, z in zip(filled, filled[1:]):
            doc, at = first.setdefault("\n".join(lines[a : z + 1]), (i, a))
            if doc != i or a > at + z - a:
                gone[i].update(range(a, z + 1))
    return {i: ("\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[i]), len(gone[i])) for i, t in texts.items()}


def jaccard(texts, k, num, den):
    """``doc_id: (shingles, least id of the group)``."""
    sets = {}
    for i, t in texts.items():
        w = [lowered(x) for x in words(t)]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    return {i: (len(sets[i]), group[i]) for i in sets}


def highest(shares, seats):
    """Sainte-Laguë: ``seats`` one by one to the highest quotient ``share / (2 got + 1)``; ties to the first."""
    got = [0] * len(shares)
    for _ in range(seats):
        got[max(range(len(shares)), key=lambda i: (Fraction(shares[i]) / (2 * got[i] + 1), -i))] += 1
    return got


def filled(sizes, weights, whole, most=2):
    """Targets by weight, stopping at ``most`` times the size, the excess reshared until none is above."""
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), whole
    while free:
        total = sum(weights[i] for i in free)
        full = {i for i in free if left * weights[i] / total >= most * sizes[i]}
        if not full:
            for i in free:
                target[i] = left * weights[i] / total
            break
        for i in full:
            target[i] = float(most * sizes[i])
        left -= sum(most * sizes[i] for i in full)
        free -= full
    return target


def mixed(docs, share=1.5, block=16, shard=2_000_000, seed=17):
    """``[(doc_id, size, target, taken)]`` of documents ``(doc_id, text, source)``."""
    code = lambda text, at: int(hashlib.md5(text.encode()).hexdigest()[at : at + 8], 16)
    rows = [(i, len(words(t)), s, code(f"{seed}/{'null' if i is None else i}", 0), code(f"{seed}/{'null' if i is None else i}", 8)) for i, t, s in docs]
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r[1] for r in rows if r[2] == s) for s in sources]
    whole = share * sum(sizes)
    target = filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))], whole)
    positive = [i for i in range(len(sources)) if target[i] > 0]
    blocks = dict(zip(positive, highest([target[i] for i in positive], int(whole / block + 0.5))))
    out = []
    for n, s in enumerate(sources):
        own = [r for r in rows if r[2] == s]
        count = max(1, -(-sizes[n] // shard))
        split = {k: [r for r in own if r[3] % count == k] for k in range(count)}
        some = sorted(k for k in split if sum(r[1] for r in split[k]) > 0)
        quota = dict(zip(some, highest([sum(r[1] for r in split[k]) for k in some], blocks.get(n, 0)))) if some else {}
        for k, members in split.items():
            total = sum(r[1] for r in members)
            parts = max(1, int(total / block + 0.5))
            want = min(2 * parts, quota.get(k, 0))
            begin = code(f"{seed}/{n + 1}/{k}", 0) % parts
            # one by one: whole rounds, then blocks in a row from the start
            edges = [int(j * total / parts) for j in range(parts + 1)]
            taken_block = [want // parts + (1 if (j - begin) % parts < want % parts else 0) for j in range(parts)]
            upto = 0
            for r in sorted(members, key=lambda r: (r[4], r[0] is not None, r[0] or 0, r[1])):
                a, z = upto, upto + r[1]
                upto = z
                out.append((r[0], r[1], target[n], sum(taken_block[j] * max(0, min(z, edges[j + 1]) - max(a, edges[j])) for j in range(parts))))
    return out
