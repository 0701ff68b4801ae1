"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a logistic model by
minimising the non-negative unbiased risk

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)).

With the logistic loss the unclipped risk is convex, so its Newton steps
over *all* training rows (one distributed sum of a gradient and a small
Hessian each) give the direction; a step is halved until the clipped risk
falls, and the search ends when none does.
The class prior is the share of positives among the training rows that
carry a label.  The score is the model's probability of label 1.

Features come from the text alone, whole, in one pass of vector operations:
shares of character and word classes, repetition of words and lines, word
lengths.  Labels, lang, source and doc_id are never inputs of a score.

Defined cases: a very long text is worked on whole, in one task; null text counts as empty; an empty text has all features
zero but its own indicator; repeated rows are rows of their own; several
labels of one doc_id count as their minimum; with no training positives or
no rows the score is the prior (0.5 if unknown); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.llm._tables import discard, landed
from codelake.llm._words import Words, pieces

RIDGE = 1e-3
FEW_WORDS, FEW_LINES = 8, 5     # added to denominators, so that short texts give weak evidence
NEWTON_STEPS = 25
THRESHOLD = 0.7
PIECE = 1 << 20                 # bytes of text whose character arrays a task holds at a time


def _chars(s: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(s.encode())] = True
    return t


_UPPER, _LOWER, _DIGIT = (_chars("".join(map(chr, range(a, b)))) for a, b in ((65, 91), (97, 123), (48, 58)))
_HIGH = np.arange(256) >= 128
_STOP = _chars(".,;:?")
_BANG, _BAR, _LINE = _chars("!"), _chars("|"), _chars("\n")
_MARK = _chars("#$%&*+/<=>@\\^_`{}~[]")

FEATURES = ("empty", "log_words", "upper", "upper_words", "digit", "bang", "bar", "mark", "stop", "marked_words",
            "bare_marks", "word_length", "long_words", "echo", "near_echo", "repeats", "line_repeats", "line_length")


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    w = Words(texts)
    n, buf, off = w.rows, w.buf, w.offsets
    words = w.counts + float(FEW_WORDS)

    def per_row(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return (c[edges[1:]] - c[edges[:-1]]).astype(float)

    def chars(table: np.ndarray) -> np.ndarray:
        return per_row(table[buf], off)

    upper, lower, high = chars(_UPPER), chars(_LOWER), chars(_HIGH)
    letters = np.maximum(upper + lower + high / 2, 1)
    size = np.maximum(np.diff(off), 1).astype(float)

    h = w.hashes()
    row = w.row_of()
    length = w.end - w.start
    last = buf[w.end - 1] if len(h) else buf
    first = buf[w.start] if len(h) else buf
    uc, lc = (np.concatenate([[0], np.cumsum(t[buf])]) for t in (_UPPER, _LOWER))
    shout = (uc[w.end] - uc[w.start] >= 2) & (lc[w.end] == lc[w.start]) if len(h) else np.zeros(0, bool)

    def same(gap: int) -> np.ndarray:
        out = np.zeros(len(h), bool)
        out[gap:] = (h[gap:] == h[:-gap]) & (row[gap:] == row[:-gap]) & ((length[gap:] > 2) | (gap == 1))
        return out

    echo = same(1) if len(h) > 1 else np.zeros(len(h), bool)
    near = echo.copy()
    for gap in (2, 3, 4):
        if len(h) > gap:
            near |= same(gap)

    def distinct(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        order = np.lexsort((hashes, rows))
        a, b = hashes[order], rows[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return np.bincount(b[new], minlength=n).astype(float)

    lines = Words(texts, separators=_LINE)
    line_n = lines.counts + float(FEW_LINES)
    x = np.column_stack([
        w.counts == 0,
        np.log1p(w.counts),
        upper / letters,
        per_row(shout, w.first) / words,
        chars(_DIGIT) / size,
        chars(_BANG) / words,
        chars(_BAR) / words,
        chars(_MARK) / words,
        chars(_STOP) / words,
        per_row(_MARK[last] | _BANG[last], w.first) / words,
        per_row((_MARK | _BAR)[first] & (length <= 2), w.first) / words,
        np.minimum(per_row(length, w.first) / words / 10, 5),
        per_row(length > 25, w.first) / words,
        per_row(echo, w.first) / words,
        per_row(near, w.first) / words,
        (w.counts - distinct(h, row)) / words,
        (lines.counts - distinct(lines.hashes(), lines.row_of())) / line_n,
        np.minimum(words / line_n / 100, 20),
    ]).astype(float)
    for name in ("upper", "upper_words", "digit", "bang", "bar", "mark", "marked_words", "bare_marks"):
        k = FEATURES.index(name)
        x[:, k] = np.sqrt(x[:, k])
    return x


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id and the features of its whole text, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, PIECE):
                x = features(part.column(1)).astype(np.float32)
                flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
                yield pa.RecordBatch.from_arrays([part.column(0), flat], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id bigint, x array<float>")


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def _sums(train: DataFrame, d: int, fn) -> np.ndarray:
    """Add up ``fn(x, positive)`` (a flat vector of fixed length) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                s = fn(_matrix(b.column(0), d), b.column(1).to_numpy(zero_copy_only=False).astype(bool))
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    rows = train.select("x", "positive").mapInArrow(run, "s binary").collect()   # one short row per partition
    return np.sum([np.frombuffer(bytes(r[0])) for r in rows], axis=0) if rows else np.zeros(0)


class Model:
    """Mean, scale and weights (bias last) of the logistic model; ``constant`` if it could not be trained."""

    def __init__(self, prior: float, mean=None, scale=None, w=None) -> None:
        self.prior, self.mean, self.scale, self.w = prior, mean, scale, w

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), self.prior)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(z @ self.w[:-1] + self.w[-1], -30, 30)))


def fit(train: DataFrame, prior: float, ridge: float = RIDGE, steps: int = NEWTON_STEPS) -> Model:
    """``train``: x, positive (trusted); every row is also unlabelled text."""
    d = len(FEATURES)
    m = _sums(train, d, lambda x, p: np.concatenate([[len(x), p.sum()], x.sum(0), (x * x).sum(0)]))
    if not len(m) or not m[1]:
        return Model(prior)
    n_u, n_p = m[0], m[1]
    mean = m[2:2 + d] / n_u
    scale = np.sqrt(np.maximum(m[2 + d:] / n_u - mean ** 2, 0))
    scale[scale < 1e-6] = 1.0

    def parts(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def at(x: np.ndarray, p: np.ndarray) -> np.ndarray:
            z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
            f = z @ w
            s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
            loss = np.logaddexp(0, f)
            return np.concatenate([[loss.sum(), loss[p].sum(), f[p].sum()], s @ z, z[p].sum(0),
                                   ((z * (s * (1 - s))[:, None]).T @ z).ravel()])

        t = _sums(train, d, at)
        k = d + 1
        negative = t[0] / n_u - prior * t[1] / n_p
        risk = prior * (t[1] - t[2]) / n_p + max(0.0, negative) + ridge / 2 * w @ w
        grad = t[3:3 + k] / n_u - prior * t[3 + k:3 + 2 * k] / n_p + ridge * w
        return risk, grad, t[3 + 2 * k:].reshape(k, k) / n_u + ridge * np.eye(k)

    w = np.zeros(d + 1)
    risk, grad, hess = parts(w)
    for _ in range(steps):
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-3:
            new = parts(w - size * step)
            if new[0] <= risk + 1e-12:
                break
            size /= 2
        else:
            break
        done = risk - new[0] < 1e-5
        w = w - size * step
        risk, grad, hess = new
        if done:
            break
    return Model(prior, mean, scale, w)


def _training(rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """Training rows (x, positive) of documents or their features, and the class prior."""
    x = feature_table(rows) if "text" in rows.columns else rows
    given = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("q")) \
        .where("q is not null").groupBy("doc_id").agg(F.min("q").alias("q"))
    train = landed(x.select("doc_id", "x").join(given, "doc_id", "left").select(
        "x", (F.coalesce(F.col("q"), F.lit(0)) == 1).alias("positive"), F.col("q").isNotNull().alias("labelled")), "train")
    c = train.agg(F.count(F.when(F.col("labelled"), 1)).alias("n"), F.count(F.when(F.col("positive"), 1)).alias("p")).first()
    return train, c["p"] / c["n"] if c["n"] else 0.5


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    ``held_out`` is a condition on doc_id; labels of those rows are not used."""
    x = landed(feature_table(docs), "features")
    train, prior = _training(x.where(~held_out), labels)
    model = fit(train, prior)
    discard(train)
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1), d)))], ["doc_id", "score"])

    return x.mapInArrow(run, "doc_id bigint, score double").select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``; labels of held-out rows are not used."""
    train, prior = _training(docs.where(~held_out), labels)
    model = fit(train, prior)
    discard(train)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at, PIECE):
                score = model.score(features(part.column(at)).astype(np.float32).astype(float))
                yield part.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)
