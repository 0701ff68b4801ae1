"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

The CGK random walk reads a word sequence with one pointer: at step t it
puts out the word under the pointer and advances by a random bit that
depends on t and that word.  Sequences at small edit distance get outputs at
small Hamming distance, so sampling a few steps of the output is a locality
sensitive hash.  All windows of a text are walked together: a step maps each
window's pointer, so it is one gather over the text's words.

Every word of every text starts a window.  Items are indexed at several
offsets (short items at every one), so edits anywhere in a passage leave some
of its windows clean; a walk that would leave its item is no key.  The
sampling is repeated with fresh walks, for each item length by itself, until
items of that length, with the largest allowed number of random word edits
and other words around them, are found with the target recall.  Lengths that
do not get there in ``MAX_REPEATS`` walks, and those that allow no edit, are
found by exact pieces instead: of one piece more than there are edits, at
least one is unchanged, so none is missed.  Each place found is verified by
the exact word edit distance between the item and the nearest stretch of the
text, at most ``max_share`` of the item's words.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
Items are taken in blocks of at most ``BLOCK_WORDS`` words; a block's index
is what a task is sent, and each block is one pass over the texts.

Defined cases: a very long text is worked on whole, in one task; null or wordless texts and items match nothing; equal items
are found each under its own id; repeated rows give their findings each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm._words import K1, K2, NOT_ALNUM, Words, grams, mix, pieces

MAX_SHARE = 0.2                # word edits per item word
TARGET_RECALL = 0.99
MAX_REPEATS = 24
STEPS = ((12, 16), (6, 8), (3, 4), (1, 1))     # (words an indexed window needs, steps of its walk)
SAMPLES = 6
STRIDE = 3
COPIES = 400                   # edited copies on which an item length's recall is measured
BLOCK_WORDS = 200_000
SEED = 5
_PIECE = 1 << 20


def _seed(repeat: int, steps: int) -> np.uint64:
    return mix(np.array([SEED * 1_000_003 + repeat * 1009 + steps], np.uint64) * K1)[0]


def _sampled(repeat: int, steps: int) -> list[int]:
    """The steps of the walk that a repeat looks at."""
    rnd = np.random.default_rng([SEED, repeat, steps])
    return sorted(rnd.choice(steps, min(SAMPLES, steps), replace=False).tolist())


def walk_keys(h: np.ndarray, starts: np.ndarray, repeat: int, steps: int) -> np.ndarray:
    """The sampled output of the walks from ``starts`` over the words ``h`` (zeros follow the last word)."""
    return _walk(h, starts, repeat, steps)[0]


def _walk(h: np.ndarray, starts: np.ndarray, repeat: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the walks, and the last word that each has looked at."""
    x = np.concatenate([h, np.zeros(steps, np.uint64)])
    bits = mix(x ^ _seed(repeat, steps))
    at = starts.astype(np.int32)
    key = np.full(len(at), steps, np.uint64) * K2
    looks = _sampled(repeat, steps)
    for t in range(looks[-1] + 1):
        if t in looks:
            key = (key ^ (key >> np.uint64(31)) ^ x[at]) * K1
        if t < looks[-1]:
            at += ((bits >> np.uint64(t)) & np.uint64(1)).astype(np.int8)[at]
    return key ^ (key >> np.uint64(29)), at


class _Table:
    """Sorted keys with the items and offsets they stand for; a bitmap answers most lookups."""

    def __init__(self, keys: np.ndarray, item: np.ndarray, offset: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.offset = keys[order], item[order], offset[order]
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[keys >> np.uint64(46)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``keys``, and the items and offsets found there."""
        at = np.flatnonzero(self.maybe[keys >> np.uint64(46)])
        lo, hi = (np.searchsorted(self.keys, keys[at], side) for side in ("left", "right"))
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.item[entry], self.offset[entry]


class Index:
    """LSH tables, and tables of exact pieces, over some items' word fingerprints."""

    def __init__(self, ids: list[int | None], words: list[np.ndarray], max_share: float, target: float) -> None:
        self.ids, self.words, self.max_share = pa.array(ids, pa.int64()), words, max_share
        self.flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.size = np.array([len(w) for w in words], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.repeats: dict[int, int] = {}              # item length: walks, 0 for exact pieces
        walked: dict[tuple[int, int], list[np.ndarray]] = {}
        cut: dict[int, list[tuple[np.ndarray, int]]] = {}
        for n in np.unique(self.size).tolist():
            items = np.flatnonzero(self.size == n)
            edits = int(max_share * n)
            need, steps = next(x for x in STEPS if n >= x[0])
            self.repeats[n] = self._repeats(items, need, steps, target) if edits else 0
            for r in range(self.repeats[n]):
                walked.setdefault((steps, r), []).append(items)
            if not self.repeats[n]:
                edges = np.arange(min(edits + 1, n) + 1) * n // min(edits + 1, n)
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    cut.setdefault(b - a, []).append((items, a))
        needs = {s: n for n, s in STEPS}
        self.walks = {k: self._walked(np.concatenate(v), needs[k[0]], *k) for k, v in walked.items()}
        self.parts = {k: self._cut(k, v) for k, v in cut.items()}

    def _walked(self, items: np.ndarray, need: int, steps: int, repeat: int) -> _Table:
        n = self.size[items]
        item, offset = np.repeat(items, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        some = (self.size[item] < 4 * need) | (offset % STRIDE == 0)
        item, offset = item[some], offset[some]
        keys, last = _walk(self.flat, self.first[item] + offset, repeat, steps)
        own = last < self.first[item + 1]              # what follows the item is other text
        return _Table(keys[own], item[own], offset[own])

    def _cut(self, k: int, pieces_at: list[tuple[np.ndarray, int]]) -> _Table:
        item = np.concatenate([i for i, _ in pieces_at])
        offset = np.concatenate([np.full(len(i), a, np.int64) for i, a in pieces_at])
        return _Table(grams(self.flat, k)[self.first[item] + offset], item, offset)

    def _repeats(self, items: np.ndarray, need: int, steps: int, target: float) -> int:
        """Walks until randomly edited copies of items of one length, among other words, are found with the target
        recall (half the misses, as it is measured on few copies); 0 if ``MAX_REPEATS`` are not enough."""
        n = int(self.size[items[0]])
        edits = int(self.max_share * n)
        rnd = np.random.default_rng([SEED, steps, n])
        copy = np.resize(rnd.permutation(items), min(COPIES, max(20, (1 << 20) // n)))
        other = rnd.integers(1, 2 ** 62, (len(copy), steps), np.uint64)        # follow a copy, and come before the next
        text = [np.concatenate([edit(self.words[i], edits, rnd), o]) for i, o in zip(copy, other)]
        long = np.array([len(w) for w in text])
        begin, owner, text = np.cumsum(long) - long, np.repeat(np.arange(len(copy)), long), np.concatenate(text)
        found = np.zeros(len(copy), bool)
        for r in range(MAX_REPEATS):
            starts = np.flatnonzero(~found[owner])
            at, item, offset = self._walked(items, need, steps, r).find(walk_keys(text, starts, r, steps))
            c = owner[starts[at]]
            found[c[(item == copy[c]) & (np.abs(starts[at] - offset - begin[c]) <= edits)]] = True
            if 2 * (~found).sum() <= (1 - target) * len(copy):
                return r + 1
        return 0

    def search(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, aligned start) of every sampled match of a window of ``h``, and of every piece, each once."""
        starts = np.arange(len(h))
        found = [np.zeros(0, np.int64)]
        longest = int(self.size.max(initial=0))
        span = len(h) + longest
        hits = [t.find(walk_keys(h, starts, r, steps)) for (steps, r), t in self.walks.items()]
        hits += [t.find(grams(h, k)) for k, t in self.parts.items()]
        found += [item * span + (at - offset + longest) for at, item, offset in hits]
        both = np.unique(np.concatenate(found))
        return both // span, both % span - longest

    def plausible(self, h: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Whether enough of an item's words stand near each place: fewer than all but the allowed edits rule it out."""
        ok = np.zeros(len(item), bool)
        order = np.argsort(item, kind="stable")
        edges = np.flatnonzero(np.diff(item[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:]):
            w = self.words[item[order[a]]]
            k = int(self.max_share * len(w))
            for c in range(a, b, 1024):
                rows = order[c:min(c + 1024, b)]
                near = np.clip(start[rows][:, None] + np.arange(-k, len(w) + k), 0, len(h) - 1)
                near = h[near]
                ok[rows] = sum((near == word).any(1) for word in w) >= len(w) - k
        return ok

    def verified(self, item: int, text: np.ndarray, start: int) -> tuple[int, int, int] | None:
        """(edits, first word, end word) of the stretch of ``text`` near ``start`` that is closest to the item."""
        w = self.words[item]
        k = int(self.max_share * len(w))
        lo = max(0, start - k)
        edits, end = _closest(w, text[lo:start + len(w) + k])
        if edits > k or lo + end == lo:
            return None
        _, back = _closest(w[::-1], text[lo:lo + end][::-1], anchored=True)
        return edits, lo + end - back, lo + end


def edit(w: np.ndarray, edits: int, rnd: np.random.Generator) -> np.ndarray:
    """``w`` with so many random word substitutions, insertions and deletions."""
    out = w.tolist()
    for _ in range(edits):
        at, kind, new = int(rnd.integers(0, max(1, len(out)))), int(rnd.integers(0, 3)), int(rnd.integers(1, 2 ** 62))
        if kind == 0 and out:
            out[at] = new
        elif kind == 1:
            out.insert(at, new)
        elif len(out) > 1:
            del out[at]
    return np.array(out, np.uint64)


def _closest(item: np.ndarray, text: np.ndarray, anchored: bool = False) -> tuple[int, int]:
    """Least word edits between the item and a stretch of the text, and where the stretch ends.

    The stretch starts anywhere, or with the text if ``anchored``."""
    n = len(text)
    step = np.arange(n + 1)
    row = step.copy() if anchored else np.zeros(n + 1, np.int64)
    for i, word in enumerate(item):
        new = np.empty(n + 1, np.int64)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(new - step) + step
    end = int(np.argmin(row))
    return int(row[end]), end


def _leaks(index: Index, part: pa.RecordBatch, column: int) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, first word, end word) of every verified, non-overlapping place."""
    w = Words(part.column(column), lower=True, separators=NOT_ALNUM)
    h = w.hashes()
    out = []
    if not len(h):
        return out
    item, start = index.search(h)
    near = index.plausible(h, item, start)
    item, start = item[near], start[near]
    # a window belongs to the row in which it lies for the most part
    middle = np.clip(start + np.array([len(index.words[i]) // 2 for i in item], np.int64), 0, len(h) - 1) if len(item) else start
    row = w.row_of()[middle] if len(item) else start
    order = np.lexsort((start, item, row))
    done: tuple[int, int, int] = (-1, -1, -1)
    for j in order:
        r, i = int(row[j]), int(item[j])
        a, b = int(w.first[r]), int(w.first[r + 1])
        s = int(start[j]) - a
        if done[:2] == (r, i) and s < done[2]:
            continue
        hit = index.verified(i, h[a:b], s)
        if hit:
            out.append((r, i, *hit))
            done = (r, i, hit[2])
    return out


def _blocks(items: DataFrame) -> int:
    words = items.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    return max(1, math.ceil(words / BLOCK_WORDS))


def _indexes(items: DataFrame, max_share: float, target_recall: float) -> Iterator[Index]:
    """The index of each block of items."""
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")) \
        .where("text is not null")
    blocks = _blocks(items)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()      # about BLOCK_WORDS words at most
        w = Words(pa.array([r["text"] for r in rows], pa.string()), lower=True, separators=NOT_ALNUM)
        h = w.hashes()
        some = [i for i in range(len(rows)) if w.counts[i]]
        yield Index([rows[i]["item_id"] for i in some], [h[w.first[i]:w.first[i + 1]] for i in some], max_share, target_recall)


def leaks(docs: DataFrame, items: DataFrame, max_share: float = MAX_SHARE, target_recall: float = TARGET_RECALL) -> DataFrame:
    """One row per leaked place: doc_id, item_id, first_word, end_word, edits, item_words."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def task(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, 1, _PIECE):
                    rows = np.array(_leaks(index, part, 1), np.int64).reshape(-1, 5)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(rows[:, 0])), index.ids.take(pa.array(rows[:, 1])), pa.array(rows[:, 3]),
                         pa.array(rows[:, 4]), pa.array(rows[:, 2]), pa.array(np.array([len(index.words[i]) for i in rows[:, 1]], np.int64))],
                        ["doc_id", "item_id", "first_word", "end_word", "edits", "item_words"])
        return run

    schema = "doc_id bigint, item_id bigint, first_word bigint, end_word bigint, edits bigint, item_words bigint"
    parts = [docs.mapInArrow(task(index), schema) for index in _indexes(items, max_share, target_recall)]
    return functools.reduce(DataFrame.union, parts)


def without_leaks(docs: DataFrame, items: DataFrame, max_share: float = MAX_SHARE, target_recall: float = TARGET_RECALL) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found."""
    at = docs.columns.index("text")

    def task(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, at, _PIECE):
                    clean = np.ones(part.num_rows, bool)
                    clean[[x[0] for x in _leaks(index, part, at)]] = False
                    yield part.filter(pa.array(clean))
        return run

    for index in _indexes(items, max_share, target_recall):
        docs = docs.mapInArrow(task(index), docs.schema)
    return docs
