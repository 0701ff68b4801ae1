"""LM scoring with Brown class-based bigrams.

Words are put into classes by exchange clustering; a text's probability is
the product of class transitions and of word emissions from classes:

    P(w | v) = (1 - u) * P(class(w) | class(v)) * count(w) / count(class(w))

with ``u`` the probability of a word not seen in training (Good-Turing) and
transitions smoothed towards class frequencies.  A text is its words and
one end token (a class of its own, also the context of the first word).

1. Whole texts are encoded once into written chunks: word numbers and the
   chunk's dictionary (64-bit word fingerprints with training counts).
2. Training counts of all words are added up by word.
3. Exchange rounds: the ``exchange_words`` most frequent words start from
   seed classes; each round counts, over all training text, each such
   word's neighbour classes, and moves every word in turn to the class that
   raises the class bigram likelihood most, with the class counts kept up
   to date.  What a round gathers has a fixed size (words x classes).
4. All other words go to the class that explains their neighbours best,
   from their neighbour counts over the whole corpus, added up by word.
5. Class transitions are counted over all training text, and every text is
   scored in its chunk.

Tokens never cross the driver; dictionaries meet the word tables by shuffle
in groups of bounded size, so nothing that grows with the corpus is broadcast.

Defined cases: a very long text is worked on whole, in one task; null text counts as empty and has the end token only; a null
doc_id counts as empty text for the fold; repeated rows are rows of their
own; without training tokens all scores are 0; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.llm._sums import BLOCK_SCHEMA, added_up, blocks, pack, unpack
from codelake.llm._tables import discard, landed
from codelake.llm._words import Words, pieces

CLASSES = 64                   # class 0 is the end token's
EXCHANGE_WORDS = 8192
ROUNDS = 3
CHUNK_BYTES = 4 << 20
GROUP_WORDS = 400_000          # dictionary entries in one group, about
TRANSITION_MASS = 5.0          # pseudo-counts towards class frequencies

_ENCODED = ("chunk bigint, ids array<bigint>, held array<boolean>, lens array<int>, tokens binary, vocab binary, "
            "counts binary")


def encode(docs: DataFrame) -> DataFrame:
    """Chunks of whole texts; ``docs``: doc_id, text, held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in pieces(batch, 1, CHUNK_BYTES):
                w = Words(part.column(1), lower=True)
                coded = pa.array(w.hashes()).dictionary_encode()
                ix, vocab = coded.indices.to_numpy(), coded.dictionary.to_numpy()
                common = np.argsort(-np.bincount(ix, minlength=len(vocab)), kind="stable")
                rank = np.empty(len(vocab), np.uint32)
                rank[common] = np.arange(len(vocab), dtype=np.uint32)
                tokens = rank[ix]
                held = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                counts = np.bincount(tokens[~held[w.row_of()]], minlength=len(vocab)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([seq], pa.int64()), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                     pa.array([held.tolist()], pa.list_(pa.bool_())), pa.array([w.counts.tolist()], pa.list_(pa.int32())),
                     pa.array([pack(tokens)], pa.binary()), pa.array([vocab[common].tobytes()], pa.binary()),
                     pa.array([pack(counts)], pa.binary())],
                    ["chunk", "ids", "held", "lens", "tokens", "vocab", "counts"])
                seq += 1

    return docs.mapInArrow(run, _ENCODED)


class _Chunk:
    def __init__(self, row: dict) -> None:
        self.held = np.array(row["held"], bool)
        self.lens = np.array(row["lens"], np.int64)
        self.tokens = unpack(row["tokens"], np.uint32).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lens)])

    def runs(self, value: np.ndarray, end: int, train: bool) -> tuple[np.ndarray, np.ndarray]:
        """``value`` of each token of the (training) texts in order, with ``end`` before and after every text;
        and the tokens' places in that array."""
        doc = np.repeat(np.arange(len(self.lens)), self.lens)
        use = ~self.held if train else np.ones(len(self.lens), bool)
        keep = use[doc]
        before = np.cumsum(use)                       # texts up to and with this one
        place = np.flatnonzero(keep)
        at = np.arange(len(place)) + before[doc[place]]
        out = np.full(len(place) + int(use.sum()) + 1, end, value.dtype)
        out[at] = value[self.tokens[place]]
        return out, at


def word_counts(enc: DataFrame) -> DataFrame:
    """fp, c: the training count of every word that occurs in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fp, c = np.frombuffer(row["vocab"], np.int64), unpack(row["counts"], np.uint32).astype(np.int64)
                seen = c > 0
                yield pa.RecordBatch.from_arrays([pa.array(fp[seen]), pa.array(c[seen])], ["fp", "c"])

    return enc.select("vocab", "counts").mapInArrow(run, "fp bigint, c bigint").groupBy("fp").agg(F.sum("c").alias("c"))


def _lookup(keys: np.ndarray, values: np.ndarray, want: np.ndarray, missing: int) -> np.ndarray:
    """``values`` of ``want`` among sorted ``keys``."""
    if not len(keys):
        return np.full(len(want), missing, values.dtype)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, values[at], missing)


def neighbours(enc: DataFrame, keys: np.ndarray, cls: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Over all training text: class bigram counts, and each exchanged word's counts of classes before and after it.

    Words outside ``keys`` are one class, number ``classes``.  Every task adds
    up its chunks, blocks of words are added up by shuffle, and the sums
    (of a size fixed by the parameters) are returned."""
    s, n = classes + 1, len(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = np.zeros((n, 2 * s), np.int64), np.zeros(s * s, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                ch = _Chunk(row)
                fp = np.frombuffer(row["vocab"], np.int64)
                number = _lookup(keys, np.arange(n), fp, -1)
                g = np.where(number >= 0, cls[number] if n else 0, classes)
                seq, at = ch.runs(g, 0, True)
                pairs += np.bincount(seq[:-1] * s + seq[1:], minlength=s * s) if len(at) or len(seq) > 1 else 0
                w = number[ch.tokens[~np.repeat(ch.held, ch.lens)]]
                on = w >= 0
                w, at = w[on], at[on]
                if len(w):
                    words += np.bincount(np.concatenate([w * 2 * s + seq[at - 1], w * 2 * s + s + seq[at + 1]]),
                                         minlength=n * 2 * s).reshape(n, 2 * s)
        yield from blocks(np.concatenate([pairs, words.ravel()]))

    total = added_up(enc.select("held", "lens", "tokens", "vocab").mapInArrow(count, BLOCK_SCHEMA), s * s + n * 2 * s)
    return total[:s * s].reshape(s, s), total[s * s:].reshape(n, 2 * s)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, words: np.ndarray, cls: np.ndarray, classes: int) -> np.ndarray:
    """One round: every word in turn goes to the class with the largest class bigram likelihood."""
    n = np.maximum(pairs.astype(float), 0)
    s = classes + 1
    cls = cls.copy()
    out_n, in_n = n.sum(1), n.sum(0)
    word_classes = slice(1, classes)
    for w in range(len(cls)):
        before, after = words[w, :s].astype(float), words[w, s:].astype(float)
        a, total = cls[w], after.sum()
        if not total:
            continue
        n[a] = np.maximum(n[a] - after, 0)
        n[:, a] = np.maximum(n[:, a] - before, 0)
        out_n[a], in_n[a] = max(out_n[a] - total, 0), max(in_n[a] - total, 0)
        rows, cols = n[word_classes], n[:, word_classes].T
        gain = (_xlogx(rows + after) - _xlogx(rows)).sum(1) + (_xlogx(cols + before) - _xlogx(cols)).sum(1) \
            - (_xlogx(out_n[word_classes] + total) - _xlogx(out_n[word_classes])) \
            - (_xlogx(in_n[word_classes] + total) - _xlogx(in_n[word_classes]))
        b = int(np.argmax(gain)) + 1
        n[b] += after
        n[:, b] += before
        out_n[b] += total
        in_n[b] += total
        cls[w] = b
    return cls


def _bucket(fp: np.ndarray, buckets: int) -> np.ndarray:
    return (fp.view(np.uint64) >> np.uint64(7)) % np.uint64(buckets)


def rest_messages(enc: DataFrame, keys: np.ndarray, cls: np.ndarray, classes: int, buckets: int) -> DataFrame:
    """For each chunk and word group: the group's words in the chunk, their training and neighbour class counts."""
    s = classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ch = _Chunk(row)
                fp = np.frombuffer(row["vocab"], np.int64)
                c = unpack(row["counts"], np.uint32)
                number = _lookup(keys, np.arange(len(keys)), fp, -1)
                g = np.where(number >= 0, cls[number] if len(keys) else 0, classes)
                seq, at = ch.runs(g, 0, True)
                tok = ch.tokens[~np.repeat(ch.held, ch.lens)]
                on = number[tok] < 0
                tok, at = tok[on], at[on]
                cell, n = np.unique(np.concatenate([tok * 2 * s + seq[at - 1], tok * 2 * s + s + seq[at + 1]]), return_counts=True)
                owner, key = cell // (2 * s), (cell % (2 * s)).astype(np.uint16)
                per = np.bincount(owner, minlength=len(fp)).astype(np.uint32)
                rest = np.flatnonzero(number < 0)
                b, cell_b = _bucket(fp, buckets), _bucket(fp, buckets)[owner]
                order, cell_order = rest[np.argsort(b[rest], kind="stable")], np.argsort(cell_b, kind="stable")
                edge = np.searchsorted(b[order], np.arange(buckets + 1, dtype=np.uint64))
                cell_edge = np.searchsorted(cell_b[cell_order], np.arange(buckets + 1, dtype=np.uint64))
                for k in range(buckets):
                    ix, cx = order[edge[k]:edge[k + 1]], cell_order[cell_edge[k]:cell_edge[k + 1]]
                    if len(ix):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([k], pa.int64()), pa.array([row["chunk"]], pa.int64())]
                            + [pa.array([v], pa.binary()) for v in (fp[ix].tobytes(), pack(c[ix]), pack(per[ix]),
                                                                    pack(key[cx]), pack(n[cx].astype(np.uint32)))],
                            ["bucket", "chunk", "fp", "c", "per", "key", "n"])

    return enc.select("chunk", "held", "lens", "tokens", "vocab", "counts").mapInArrow(
        run, "bucket bigint, chunk bigint, fp binary, c binary, per binary, key binary, n binary")


def _assign(group: pa.Table, log_t: np.ndarray) -> pa.Table:
    """Of one group of words: the corpus count and the class of each, told to every chunk that has it."""
    rows = group.to_pylist()
    fp = np.concatenate([np.frombuffer(r["fp"], np.int64) for r in rows])
    c = np.concatenate([unpack(r["c"], np.uint32) for r in rows]).astype(np.int64)
    per = np.concatenate([unpack(r["per"], np.uint32) for r in rows]).astype(np.int64)
    key = np.concatenate([unpack(r["key"], np.uint16) for r in rows]).astype(np.int64)
    n = np.concatenate([unpack(r["n"], np.uint32) for r in rows])
    words, number = np.unique(fp, return_inverse=True)
    total = np.bincount(number, weights=c, minlength=len(words)).astype(np.int64)
    owner = np.repeat(number, per)
    order = np.argsort(owner, kind="stable")
    owner, key, n = owner[order], key[order], n[order]
    best, width = np.zeros(len(words), np.uint8), len(log_t)
    for lo in range(0, len(words), 8192):                     # a dense piece of the counts at a time
        hi = min(lo + 8192, len(words))
        i, j = np.searchsorted(owner, [lo, hi])
        dense = np.bincount((owner[i:j] - lo) * width + key[i:j], weights=n[i:j], minlength=(hi - lo) * width)
        best[lo:hi] = 1 + np.argmax(dense.reshape(hi - lo, width) @ log_t, axis=1)
    edges = np.cumsum([0] + [len(r["fp"]) // 8 for r in rows])
    at = [number[a:b] for a, b in zip(edges[:-1], edges[1:])]
    return pa.table({"chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int64()),
                     "c": pa.array([pack(total[x].astype(np.int64)) for x in at], pa.binary()),
                     "cls": pa.array([pack(best[x]) for x in at], pa.binary())})


def score(docs: DataFrame, held_out: Column, classes: int = CLASSES, exchange_words: int = EXCHANGE_WORDS,
          rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a condition on doc_id; those rows are scored, not learned from."""
    enc = landed(encode(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
                        .select("doc_id", "text", held_out.alias("held"))), "encoded")
    counts = landed(word_counts(enc), "counts")
    t = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n"), F.count(F.when(F.col("c") == 1, 1)).alias("once")).first()
    ends = enc.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    n_all, types = (t["n"] or 0) + ends, t["v"] + (ends > 0)
    top = counts.orderBy(F.desc("c"), "fp").limit(exchange_words).collect()       # bounded by the parameter
    discard(counts)

    cls = np.array([min(i + 1, classes) for i in range(len(top))], np.int64)        # the first seed a class each
    keys, top_c = np.array([r["fp"] for r in top], np.int64), np.array([r["c"] for r in top], np.int64)
    order = np.argsort(keys)
    sorted_keys = keys[order]
    for _ in range(rounds):
        pairs, words = neighbours(enc, sorted_keys, cls[order], classes)
        by_rank = np.empty_like(words)
        by_rank[order] = words
        cls = exchange(pairs, by_rank, cls, classes)
    sorted_cls, sorted_c = cls[order], top_c[order]
    pairs, _ = neighbours(enc, sorted_keys, sorted_cls, classes)
    p = pairs + 0.1
    # what a class says about the class after it, and the class before
    log_t = np.concatenate([np.log(p[:, 1:classes] / p[:, 1:classes].sum(0)),
                            np.log(p[1:classes] / p[1:classes].sum(1, keepdims=True)).T])

    entries = enc.select(F.sum(F.length("vocab") / 8)).first()[0] or 0
    buckets = max(1, int(-(-entries // GROUP_WORDS)))
    back = rest_messages(enc, sorted_keys, sorted_cls, classes, buckets).groupBy("bucket").applyInArrow(
        lambda key, group: _assign(group, log_t), "chunk bigint, bucket bigint, c binary, cls binary")

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        told = {r["bucket"]: r for r in right.to_pylist()}
        out = []
        for row in left.to_pylist():
            fp = np.frombuffer(row["vocab"], np.int64)
            g, c = _lookup(sorted_keys, sorted_cls, fp, 0), _lookup(sorted_keys, sorted_c, fp, 0)
            rest = np.flatnonzero(g == 0)
            b = _bucket(fp, buckets)[rest]
            for k, r in told.items():
                ix = rest[b == k]
                g[ix], c[ix] = unpack(r["cls"], np.uint8), unpack(r["c"], np.int64)
            out.append(row | {"vocab": pack(g.astype(np.uint8)), "counts": pack(c)})
        return pa.Table.from_pylist(out, left.schema) if out else left.slice(0, 0)

    full = landed(enc.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(
        lambda key, left, right: meet(key, left, right), _ENCODED), "classed")
    discard(enc)

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                seq, _ = _Chunk(row).runs(unpack(row["vocab"], np.uint8).astype(np.int64), 0, True)
                total += np.bincount(seq[:-1] * classes + seq[1:], minlength=classes * classes)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    rows = full.select("held", "lens", "tokens", "vocab").mapInArrow(transitions, "sums binary").collect()  # one per task
    n_cd = np.sum([np.frombuffer(bytes(r[0]), np.int64) for r in rows], axis=0) if rows else np.zeros(classes * classes)
    model = Model(n_cd.reshape(classes, classes), n_all, types, t["once"], ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ch = _Chunk(row)
                known, base, best = model.rate(ch, unpack(row["vocab"], np.uint8), unpack(row["counts"], np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(ch.held), pa.array(ch.lens + 1), pa.array(known),
                     pa.array(np.full(len(known), n_all, np.int64)), pa.array(base), pa.array(best)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return full.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                                "base_score double, score double")


class Model:
    """Class transitions, and what scoring needs of the corpus counts."""

    def __init__(self, n_cd: np.ndarray, n_all: int, types: int, once: int, ends: int) -> None:
        self.n_all, self.types, self.ends = n_all, types, ends
        self.size = n_cd.sum(0).astype(float)                        # tokens of each class
        classes = len(n_cd)
        self.freq = (self.size + 0.5) / (self.size.sum() + 0.5 * classes)
        self.next = (n_cd + TRANSITION_MASS * self.freq) / (n_cd.sum(1, keepdims=True) + TRANSITION_MASS)
        self.unseen = (once + 0.5) / (n_all + 1.0)

    def rate(self, ch: _Chunk, cls: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n_known, base score and score of each text of a chunk."""
        texts = len(ch.lens)
        room = self.n_all + 0.5 * (self.types + 1)
        known_end = int(self.ends > 0)
        if not self.n_all:
            zero = np.zeros(texts)
            return np.zeros(texts, np.int64), zero, zero

        def per_text(x: np.ndarray) -> np.ndarray:
            out = np.zeros(texts, x.dtype)
            some = np.flatnonzero(ch.lens)
            if len(some):
                out[some] = np.add.reduceat(x, ch.first[some])
            return out

        unknown = len(self.freq)                                      # a context without counts
        g = np.where(c > 0, cls.astype(np.int64), unknown)
        seq, at = ch.runs(g, 0, False)
        step = np.log10(np.vstack([self.next, self.freq]) * (1 - self.unseen))      # rows: context
        step = np.column_stack([step, np.full(len(step), np.log10(self.unseen))])
        emit = np.zeros(len(c))
        seen = c > 0
        emit[seen] = np.log10(c[seen] / self.size[g[seen]])
        best = per_text(step[seq[at - 1], seq[at]] + emit[ch.tokens])
        closes = np.cumsum(ch.lens + 1)                               # each text's closing end token
        best = best + step[seq[closes - 1], 0]
        base = per_text(np.log10((c + 0.5) / room)[ch.tokens]) + np.log10((self.ends + 0.5) / room)
        return per_text(seen[ch.tokens].astype(np.int64)) + known_end, base, best
