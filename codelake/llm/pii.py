"""Personal data: high-recall generators, boosted trees, calibrated thresholds.

Base patterns (email, ip, card, phone) find their spans exactly as their
regular expressions say, and always stay.  Further generators propose
overlapping candidate spans in other notations; gradient boosted trees rate
a candidate from its format and its context, Platt scaling turns ratings
into probabilities on a calibration part of the labelled spans, and each
kind's threshold is the smallest that keeps the wanted precision there.
Of overlapping accepted candidates the best rated stays; those that touch a
base span are dropped.

The trees are fitted on a bounded table of labelled spans (at most
``MAX_LABELLED`` rows).  The given tables hold none, so a seeded one is made
from notations of personal data and of what is mistaken for it; pass your
own rows to ``train``.  Texts are searched whole, in their own row.

Defined cases: a very long text is worked on whole, in one task; null text counts as empty and gives no span; repeated rows
are rows of their own; an empty table gives an empty result; other columns
are ignored.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "iban")
MAX_LABELLED = 20_000
LABELLED = 4000
TREES, DEPTH, RATE = 60, 3, 0.2
PRECISION = 0.98
SEED = 11

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# only starts of digit runs can start a match, so a look-behind keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# candidate generators: (kind, pattern); numbers first, then spelled-out addresses
_NUMBERS = tuple((k, re.compile(p)) for k, p in (
    ("phone", r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9+])00[1-9][0-9 ().-]{7,18}[0-9](?![0-9])"),
    ("phone", r"(?<![0-9+])0[1-9][0-9]{0,3}[ /-][0-9]{3,4}[ -]?[0-9]{3,5}(?![0-9])"),
    ("card", r"(?<![0-9.])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"),
    ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}|\(\.\)[0-9]{1,3}){3}(?![0-9])"),
))
_SPELLED = tuple((k, re.compile(p)) for k, p in (
    ("email", r"(?i)(?<![\w.])[a-z0-9._-]{1,64} ?[\[({] ?at ?[\])}] ?[a-z0-9-]{1,64}(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[a-z0-9-]{2,24}){1,4}"),
    ("email", r"(?i)(?<![\w.])[a-z0-9._-]{1,64} at [a-z0-9-]{1,64}(?: dot [a-z0-9-]{2,24}){1,4}(?!\w)"),
))
# every match of a spelled pattern holds one of these
_HINT = re.compile(r"(?i)[\[({] ?at ?[\])}]| dot ")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9)
    return total % 10 == 0


def _count(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base patterns' spans, by start, then kind."""
    out: list[tuple[str, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            d = _count(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_count(m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping proposals of the further generators."""
    found = []
    if _DIGIT.search(text):
        found += [(k, m.start(), m.end()) for k, p in _NUMBERS for m in p.finditer(text)]
    if _HINT.search(text):
        found += [(k, m.start(), m.end()) for k, p in _SPELLED for m in p.finditer(text)]
    return found


_CONTEXT = tuple(re.compile(r"(?i)" + p) for p in (
    r"phone|tel|call|mobile|fax|dial|cell|ruf|whatsapp", r"card|visa|master|credit|debit|pay", r"mail|contact|write|reach|address",
    r"ssn|social|security", r"iban|bank|account|konto", r"\bip\b|host|server|login|addr|client",
    r"version|release|isbn|issn|doi|build|rfc|section|chapter|page|fig|table|item|part|order|invoice|ticket|serial|model|ref|no\.|nr|#$",
    r"date|year|since|until|time|score|price|total|usd|eur|\$"))


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of one candidate."""
    s = text[start:end]
    n = len(s)
    digits = _count(s)
    before, after = text[max(0, start - 40):start], text[end:end + 25]
    groups = re.findall(r"[0-9]+", s)
    row = [float(kind == k) for k in KINDS]
    row += [n, len(digits), len(digits) / n, len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
            s.count("-"), s.count("."), s.count(" "), s.count("/"), float("(" in s), float("[" in s or "{" in s),
            float(bool(digits) and luhn(digits)), sum(ch.isalpha() for ch in s) / n, sum(ch.isupper() for ch in s) / n,
            float(s[:1] == "0"), float(len(set(digits)) <= 2), float(bool(re.match(r"^(?:19|20)[0-9]{2}\D", s))),
            float(digits[:3] in ("000", "666") or digits[:1] == "9"), float(s.lower().endswith(("com", "org", "net", "edu", "de", "fr", "es"))),
            float(_iban_ok(s))]
    row += [float(bool(p.search(before))) for p in _CONTEXT]
    row += [float(bool(p.search(after))) for p in _CONTEXT[-2:]]
    row += [float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "-/.:=_"), float(after[:1] in "-/:=_")]
    return row


def _iban_ok(s: str) -> bool:
    t = s.replace(" ", "")
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}", t):
        return False
    return int("".join(str(int(ch, 36)) for ch in t[4:] + t[:4])) % 97 == 1


class Boosted:
    """Depth-limited regression trees fitted to the logistic gradient, with a calibrated sigmoid on top."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> None:
        self.trees, self.depth, self.rate = trees, depth, rate
        self.start, self.nodes, self.scale = 0.0, [], (1.0, 0.0)
        self.thresholds: dict[str, float] = {}

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.start)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 25))) for j in range(x.shape[1])]
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-f))
            tree = self._grow(x, y - prob, prob * (1 - prob), np.arange(len(y)), cuts, self.depth)
            self.nodes.append(tree)
            f += self.rate * self._eval(tree, x)

    def _grow(self, x, g, h, rows, cuts, depth):
        value = g[rows].sum() / (h[rows].sum() + 1.0)
        if not depth or len(rows) < 10:
            return value
        best, at = 1e-6 + g[rows].sum() ** 2 / (h[rows].sum() + 1.0), None
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            cell = np.searchsorted(c, x[rows, j], side="left")        # cell k: c[k-1] < value <= c[k]
            gl, hl = (np.cumsum(np.bincount(cell, weights=v[rows], minlength=len(c) + 1))[:-1] for v in (g, h))
            gr, hr = g[rows].sum() - gl, h[rows].sum() - hl
            gain = gl ** 2 / (hl + 1.0) + gr ** 2 / (hr + 1.0)
            k = int(np.argmax(gain))
            if gain[k] > best + 1e-9:
                best, at = gain[k], (j, c[k])
        if at is None:
            return value
        left = x[rows, at[0]] <= at[1]
        if left.all() or not left.any():
            return value
        return (*at, self._grow(x, g, h, rows[left], cuts, depth - 1), self._grow(x, g, h, rows[~left], cuts, depth - 1))

    def _eval(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, c, a, b = tree
        return np.where(x[:, j] <= c, self._eval(a, x), self._eval(b, x))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum(self._eval(t, x) for t in self.nodes)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.raw(x) + self.scale[1], -30, 30)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, kinds: np.ndarray, precision: float) -> None:
        """Platt scaling, then per kind the smallest threshold with the wanted precision on these rows."""
        f, w = self.raw(x), np.array([1.0, 0.0])
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        z = np.column_stack([f, np.ones(len(f))])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w = w - np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + 1e-6 * np.eye(2), z.T @ (p - target))
        self.scale = (float(w[0]), float(w[1]))
        p = self.probability(x)
        for k in set(kinds):
            own, order = kinds == k, None
            order = np.argsort(-p[own])
            good = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
            fine = np.flatnonzero(good >= precision)
            self.thresholds[k] = max(0.5, float(p[own][order][fine[-1]])) if len(fine) else 1.01


def labelled_spans(n: int = LABELLED, seed: int = SEED) -> list[tuple[str, str, int, int, int]]:
    """Seeded labelled candidates: text, kind, start, end, label."""
    rnd = random.Random(seed)
    d = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice(["er", "in", "the", "on", "an", "re", "ti", "la", "de", "que"]) for _ in range(rnd.randint(1, 4)))

    def card() -> str:
        body = "4" + d(14)
        return next(body + str(k) for k in range(10) if luhn(body + str(k)))

    def iban() -> str:
        body = d(18)
        check = 98 - int(body + "131400") % 97
        t = f"DE{check:02d}{body}"
        return " ".join(t[i:i + 4] for i in range(0, len(t), 4)) if rnd.random() < 0.6 else t

    def dotted(s: str, sep: str) -> str:
        return sep.join(s[i:i + 4] for i in range(0, 16, 4))

    good = [
        ("phone", lambda: f"({d(3)}) 555-{d(4)}", ["call me at", "phone:", "Tel.", "", word()]), ("phone", lambda: f"{rnd.randint(200, 989)}-555-{d(4)}", ["phone", "mobile", "fax", "cell"]),
        ("phone", lambda: f"{rnd.randint(200, 989)}.{rnd.randint(200, 989)}.{d(4)}", ["call", "tel", "dial"]),
        ("phone", lambda: f"00{rnd.randint(30, 49)} {d(3)} {d(3)} {d(4)}", ["phone", "tel:", "call", word()]), ("phone", lambda: f"0{rnd.randint(30, 99)}/{d(4)}{d(4)}", ["Tel.", "ruf", "phone"]),
        ("card", lambda: dotted(card(), "."), ["card", "visa", word()]), ("card", lambda: dotted(card(), "_"), ["pay with", "credit card", word()]),
        ("ssn", lambda: f"{rnd.randint(100, 665)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}", ["ssn", "social security number", "SSN:"]),
        ("iban", iban, ["iban", "bank", word(), "account"]), ("ip", lambda: ":".join(f"{rnd.randint(4096, 65535):x}" for _ in range(8)), ["ip", "host", word()]),
        ("ip", lambda: "[.]".join(str(rnd.randint(1, 254)) for _ in range(4)), ["ip", "server", word()]),
        ("email", lambda: f"{word()}.{word()} [at] {word()} [dot] {rnd.choice(['com', 'org', 'net', 'de'])}", ["mail", "contact", word()]),
        ("email", lambda: f"{word()}(at){word()}.{rnd.choice(['com', 'org', 'fr'])}", ["write", "mail", word()]),
        ("email", lambda: f"{word()}{d(2)} at {word()} dot {rnd.choice(['com', 'net', 'es'])}", ["mail me:", "reach me", "contact", word()]),
    ]
    bad = [
        ("phone", lambda: f"{d(3)}-{d(3)}-{d(4)}", ["order", "invoice no.", "isbn", "serial", "ticket #"]), ("phone", lambda: f"{d(3)} {d(3)} {d(4)}", ["total", "table", "version", "items"]),
        ("phone", lambda: f"{d(3)}.{d(3)}.{d(4)}", ["version", "section", "build", word()]), ("phone", lambda: f"0{rnd.randint(1, 9)}/{d(4)}-{d(3)}", ["ref", "part", "model", "date"]),
        ("phone", lambda: f"00{rnd.randint(10, 99)}{d(8)}", ["serial", "item", "no.", "ref"]),
        ("phone", lambda: f"00{rnd.randint(10, 99)}{d(rnd.randint(8, 14))}", [word(), "the", "of"]),
        ("card", lambda: dotted(card()[:-1] + rnd.choice("0123456789"), rnd.choice("._/")), ["serial", "build", word(), "ref"]),
        ("ssn", lambda: f"{d(3)}-{d(2)}-{d(4)}", ["part", "model", "ref", "date", "item"]), ("ssn", lambda: f"9{d(2)}-{d(2)}-{d(4)}", [word(), "no."]),
        ("ssn", lambda: f"{d(3)} {d(2)} {d(4)}", ["score", "table", word(), "page"]),
        ("iban", lambda: f"{rnd.choice('ABDEF')}{rnd.choice('KLMN')}{d(2)} {d(4)} {d(4)} {d(4)}", ["model", "serial", word()]),
        ("iban", lambda: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(2)) + d(2) + "".join(rnd.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(16)), ["key", word(), "token"]),
        ("ip", lambda: f"{d(2)}:{d(2)}:{d(2)}:{d(2)}", ["time", "date", "at", word()]), ("ip", lambda: ":".join(d(1) for _ in range(5)), ["score", "ratio", word()]),
        ("email", lambda: f"{word()} at {word()} dot {word()}", [word(), "the", "look"]), ("email", lambda: f"{word()} (at) {word()} . {word()}", [word(), "it was"]),
    ]
    patterns = {}
    for k, p in (*_NUMBERS, *_SPELLED):
        patterns.setdefault(k, []).append(p)
    out = []
    while len(out) < n:
        label = len(out) % 2
        kind, make, context = rnd.choice(good if label else bad)
        span = make()
        head = f"{word()} {word()} {rnd.choice(context)} "
        text = head + span + rnd.choice([" ", ". ", ", ", "\n", ""]) + (" " + word() + " " + word())
        if any(m.start() == len(head) for p in patterns[kind] for m in p.finditer(text)):
            out.append((text, kind, len(head), len(head) + len(span), label))
    return out


def train(rows: list[tuple[str, str, int, int, int]] | None = None, precision: float = PRECISION) -> Boosted:
    """Fit on two thirds of the labelled spans, calibrate on the rest."""
    rows = (rows or labelled_spans())[:MAX_LABELLED]
    x = np.array([features(t, k, a, b) for t, k, a, b, _ in rows], float)
    y = np.array([r[4] for r in rows], float)
    kinds = np.array([r[1] for r in rows])
    late = np.arange(len(rows)) % 6 >= 4            # pairs of rows, so both labels are in either part
    model = Boosted()
    model.fit(x[~late], y[~late])
    model.calibrate(x[late], y[late], kinds[late], precision)
    return model


def added_spans(text: str, base: list[tuple[str, int, int]], model: Boosted) -> list[tuple[str, int, int]]:
    """Accepted candidates that touch neither a base span nor a better rated one."""
    found = [c for c in candidates(text) if not any(c[1] < b and a < c[2] for _, a, b in base)]
    if not found:
        return []
    p = model.probability(np.array([features(text, *c) for c in found], float))
    out: list[tuple[str, int, int]] = []
    for i in sorted(range(len(found)), key=lambda i: (-p[i], found[i][1], KINDS.index(found[i][0]))):
        k, a, b = found[i]
        if p[i] >= model.thresholds.get(k, 1.01) and not any(a < e and s < b for _, s, e in out):
            out.append(found[i])
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def find(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """One row per document: doc_id, counts of base spans, their digest, all spans."""
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                for c, k in zip(cols, BASE_KINDS):
                    c.append(sum(s[0] == k for s in base))
                cols[4].append(hashlib.sha256(written(base).encode()).hexdigest())
                cols[5].append(written(base + added_spans(text, base, model)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:]]],
                ["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """The rows with every span of ``text`` replaced by its kind in brackets; other columns as they are."""
    model = model or train()
    cols = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = cols.index("text")
        for batch in batches:
            out = []
            for text in batch.column(at):
                text = text.as_py()
                if text is not None:
                    base = base_spans(text)
                    # spans of different kinds may overlap: each stretch takes the name of its first one
                    pieces, done = [], 0
                    for k, a, b in sorted(base + added_spans(text, base, model), key=lambda s: s[1]):
                        if a >= done:
                            pieces += [text[done:a], f"[{k.upper()}]"]
                        done = max(done, b)
                    text = "".join(pieces) + text[done:]
                out.append(text)
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
