"""Plain single-process versions of the operators' contracts, for small inputs."""

import hashlib
import itertools
import math
import re
import zlib

from codelake.llm.license_scan import BASE


def fold(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(t, lower=False):
    return re.findall(r"[^\x20\x09-\x0D]+", fold(t) if lower else (t or ""))


def base_places(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    hits = [(i, label) for phrase, label in BASE for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    return len(w), hits


def shingles(t, k=5):
    w = words(t, True)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, p), (b, q) in itertools.combinations(sets, 2):
        if p and q and 100 * len(p & q) >= 75 * len(p | q):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {d: (len(s), root(d)) for d, s in sets}


def repeats_removed(rows, n=50):
    docs = [(d, words(t)) for d, t in rows]
    first = {}
    for d, w in docs:
        for i in range(len(w) - n + 1):
            key = tuple(w[i:i + n])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, w in docs:
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i:i + n])] < d:
                gone.update(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def remainder(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


def unigram(rows, held):
    """(n_tokens, n_known, N, base) per row, in order."""
    count = {}
    for (d, t), h in zip(rows, held):
        if not h:
            for w in [*words(t, True), None]:
                count[w] = count.get(w, 0) + 1
    total, types = sum(count.values()), len(count)
    out = []
    for _, t in rows:
        seq = [*words(t, True), None]
        base = sum(math.log10((count.get(w, 0) + 0.5) / (total + 0.5 * (types + 1))) for w in seq)
        out.append((len(seq), sum(w in count for w in seq), total, base))
    return out


def pii_base(t):
    t = t or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        odd = d[-1::-2]
        even = [x for y in d[-2::-2] for x in divmod(2 * y, 10)]
        if 12 <= len(d) <= 19 and (sum(odd) + sum(even)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    order = ("email", "ip", "card", "phone")
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))
