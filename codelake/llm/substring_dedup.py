"""Substring deduplication with prefix-partitioned suffix trees.

A word is removed when a window of ``window`` consecutive words that covers
it also starts in a document with a smaller doc_id.

Suffixes are sampled: every window holds exactly one smallest ``gram``-word
run, so equal windows sample the same suffix, and a window whose sampled
prefix occurs in one document only is no repeat.  The sampled prefix also
partitions the suffixes: all occurrences of a prefix, each with the words
its windows need, go to one memory-sized group (many prefixes share a
group).  A prefix too frequent for that is lengthened, window by window, to
the full window depth: such a group is one node of the tree, so its
smallest document is an ordinary aggregate, combined before the shuffle.

In a group the subtree is built by prefix doubling: nodes of depth 1, 2, 4,
... and then of the window's depth, each level naming the pairs of nodes
below it.  A node of window depth with several documents is a repeat;
consecutive ones join into the maximal covered stretch.

Copies of a whole document are settled first: when its word sequence is
that of a smaller doc_id, every word of it is covered, and the smaller one
stands for both as a source.

Defined cases: a very long text is worked on whole, in one task; null text counts as empty; documents shorter than the window
lose nothing; rows with one doc_id never remove each other's words; a row
whose doc_id is null neither removes nor loses words; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm._tables import discard, landed
from codelake.llm._words import K1, K2, Words, grams, mix, pieces

WINDOW = 50
GRAM = 8
HOT_DOCUMENTS = 2_000          # a prefix in more places is lengthened to the full window
HOT_WINDOWS = 2_000_000        # and one with more windows, as texts made of one line or word have (100 bytes each in a task)
GROUP_WINDOWS = 200_000        # windows in a group, about
EMPTY = hashlib.sha256(b"").hexdigest()


def _cells(starts: np.ndarray, run: int) -> np.ndarray:
    """The smallest value of each ``run`` consecutive ones."""
    m, width = starts, 1
    while 2 * width <= run:
        m, width = np.minimum(m[:-width], m[width:]), 2 * width
    return np.minimum(m[:len(starts) - run + 1], m[run - width:]) if run > width else m


class _Rows:
    """Words, whole-sequence digests and sampled prefixes of each window, of some rows."""

    def __init__(self, texts: pa.Array, window: int, gram: int) -> None:
        self.w = w = Words(texts)
        self.h = h = w.hashes()
        at = np.arange(len(h), dtype=np.uint64) - np.repeat(w.first[:-1], w.counts).astype(np.uint64)
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix((h ^ s) + at * K1), dtype=np.uint64)]) for s in (K1, K2)]
        self.digest = [(c[w.first[1:]] - c[w.first[:-1]]).view(np.int64) for c in sums]
        n = len(h) - window + 1
        self.row = w.row_of()
        # for each word: does a window start here, and which prefix does it sample
        self.starts = np.zeros(len(h), bool)
        self.prefix = np.zeros(len(h), np.uint64)
        if n > 0:
            self.prefix[:n] = _cells(grams(h, gram), window - gram + 1)[:n]
            self.starts[:n] = np.arange(n) + window <= w.first[1:][self.row[:n]]

    def words(self, row: int) -> list[bytes]:
        o = self.w.offsets
        return self.w.buf[o[row]:o[row + 1]].tobytes().split()


def profile(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, n_words, sequence digest, SHA-256 of the words, and the prefixes its windows sample, with how many
    windows in a row each time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                x = _Rows(part.column(1), window, gram)
                sha = [hashlib.sha256(b" ".join(x.words(r))).hexdigest() for r in range(x.w.rows)]
                at = np.flatnonzero(x.starts)
                fresh = np.ones(len(at), bool)
                fresh[1:] = (x.prefix[at[1:]] != x.prefix[at[:-1]]) | (x.row[at[1:]] != x.row[at[:-1]])
                windows = np.diff(np.append(np.flatnonzero(fresh), len(at)))
                at = at[fresh]
                edges = np.searchsorted(x.row[at], np.arange(x.w.rows + 1)).astype(np.int32)
                found = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays(
                    [pa.array(x.prefix[at].view(np.int64)), pa.array(windows.astype(np.int32))], ["prefix", "windows"]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(x.w.counts), pa.array(x.digest[0]), pa.array(x.digest[1]), pa.array(sha, pa.string()), found],
                    ["doc_id", "n", "d1", "d2", "sha", "found"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, d1 bigint, d2 bigint, sha string, found array<struct<prefix:bigint,windows:int>>")


def _shared_windows(part: pa.RecordBatch, column: int, window: int, gram: int) -> tuple[_Rows, np.ndarray]:
    """The rows' words, and for each word whether a window with one of the row's listed prefixes starts there."""
    x = _Rows(part.column(1), window, gram)
    lists = part.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    owner = np.repeat(np.arange(part.num_rows, dtype=np.uint64), np.diff(lists.offsets.to_numpy()))
    mark = mix(x.prefix + mix(x.row.astype(np.uint64) * K1))
    return x, x.starts & np.isin(mark, mix(flat + mix(owner * K1)))


def _stretches(x: _Rows, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of each run of marked words with one row and one prefix."""
    at = np.flatnonzero(on)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (x.prefix[at[1:]] != x.prefix[at[:-1]]) | (x.row[at[1:]] != x.row[at[:-1]])
    begin = np.flatnonzero(new)
    return at[begin], at[np.append(begin[1:], len(at)) - 1] if len(at) else at


def fragments(cand: DataFrame, window: int, gram: int) -> DataFrame:
    """The occurrences of each ordinary shared prefix, with the words of the windows that sample it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                x, on = _shared_windows(part, 2, window, gram)
                a, b = _stretches(x, on)
                b = b + window                                   # the word after the last window
                lo, hi = x.w.start[a], x.w.end[b - 1] if len(b) else b
                text = [x.w.buf[i:j].tobytes().decode() for i, j in zip(lo, hi)]
                r = x.row[a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.prefix[a].view(np.int64)), part.column(0).take(pa.array(r)), pa.array(x.digest[0][r]),
                     pa.array(a - x.w.first[r]), pa.array(text, pa.string())], ["prefix", "doc_id", "d1", "at", "words"])

    return cand.select("doc_id", "text", "plain").mapInArrow(run, "prefix bigint, doc_id bigint, d1 bigint, at bigint, words string")


def full_depth(cand: DataFrame, window: int, gram: int) -> DataFrame:
    """The windows of too frequent prefixes, named by their whole word sequence (128 bits with the prefix); equal ones
    in a row, as runs of one word have, are one row with their number ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                x, on = _shared_windows(part, 2, window, gram)
                at = np.flatnonzero(on)
                name = grams(x.h, window)
                name = name[at] if len(at) else np.zeros(0, np.uint64)
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1] + 1) | (name[1:] != name[:-1]) | (x.row[at[1:]] != x.row[at[:-1]])
                n = np.diff(np.append(np.flatnonzero(new), len(at)))
                at, name = at[new], name[new]
                r = x.row[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.prefix[at].view(np.int64)), pa.array(name.view(np.int64)),
                     part.column(0).take(pa.array(r)), pa.array(x.digest[0][r]), pa.array(at - x.w.first[r]), pa.array(n)],
                    ["prefix", "name", "doc_id", "d1", "at", "n"])

    return cand.select("doc_id", "text", "hot").where("size(hot) > 0") \
        .mapInArrow(run, "prefix bigint, name bigint, doc_id bigint, d1 bigint, at bigint, n bigint")


def _names(pairs: np.ndarray) -> np.ndarray:
    """A number for each distinct value."""
    return pa.array(pairs).dictionary_encode().indices.to_numpy().astype(np.int64)


def subtree(words: pa.Array, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeats among the suffixes of one group of fragments.

    Returns the fragment, first word and end word (within the fragment) of
    each maximal stretch whose windows also start in a smaller document."""
    w = Words(words)
    node = _names(w.hashes().view(np.int64))
    depth = 1
    while depth < window and len(node):                       # a node of 2 * depth is a pair of nodes of depth
        step = min(depth, window - depth)
        m = len(node) - step
        if m <= 0:
            node = node[:0]
            break
        node = _names(node[:m] * (int(node.max()) + 1) + node[step:])
        depth += step
    n = len(node)
    part = w.row_of()[:n]
    at = np.flatnonzero(np.arange(n) + window <= w.first[1:][part])
    if not len(at):
        return at, at, at
    node, part = node[at], part[at]
    smallest = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, node, doc[part])
    hit = np.flatnonzero(doc[part] > smallest[node])
    at, part = at[hit], part[hit]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1])
    begin = np.flatnonzero(new)
    end = at[np.append(begin[1:], len(at)) - 1] + window if len(at) else at
    first = w.first[part[begin]]
    return part[begin], at[begin] - first, end - first


def _kept(cand: DataFrame) -> DataFrame:
    """doc_id, d1, n_removed and kept_sha256 of rows (doc_id, text, cuts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                x = _Rows(part.column(1), 1, 1)
                removed, sha = [], []
                for r, cuts in enumerate(part.column(2).to_pylist()):
                    words = x.words(r)
                    gone = np.zeros(len(words) + 1, np.int64)
                    for c in cuts:
                        if c["d1"] == x.digest[0][r]:            # of this very text
                            gone[c["lo"]] += 1
                            gone[c["hi"]] -= 1
                    keep = np.cumsum(gone[:-1]) == 0
                    removed.append(int(len(words) - keep.sum()))
                    sha.append(hashlib.sha256(b" ".join(w for w, k in zip(words, keep) if k)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x.digest[0]), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
                                                 ["doc_id", "d1", "n_removed", "kept_sha256"])

    return cand.select("doc_id", "text", "cuts").mapInArrow(run, "doc_id bigint, d1 bigint, n_removed bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_documents: int = HOT_DOCUMENTS,
                   group_windows: int = GROUP_WINDOWS, hot_windows: int = HOT_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    gram = min(gram, window)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prof = landed(profile(docs, window, gram), "profiles")
    long = prof.where(f"n >= {window} and doc_id is not null")
    same = ["d1", "d2", "n"]
    classes = landed(long.groupBy(*same).agg(F.min("doc_id").alias("rep")), "classes")

    sampled = long.join(classes.withColumnRenamed("rep", "doc_id"), [*same, "doc_id"]) \
        .select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
    shared = sampled.groupBy("prefix").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("uses"),
                                           F.sum("windows").alias("all")).where("lo < hi").select("prefix", "uses", "all")
    # the shared prefixes of each document (bounded by its length); a group takes a prefix only with all of its windows
    plain = (F.col("uses") <= hot_documents) & (F.col("all") <= hot_windows)
    of = landed(sampled.join(shared, "prefix").groupBy("doc_id").agg(
        F.collect_set(F.when(plain, F.col("prefix"))).alias("plain"),
        F.collect_set(F.when(~plain, F.col("prefix"))).alias("hot"), F.sum(F.when(plain, F.col("windows"))).alias("load")), "shared")
    cand = landed(docs.join(of.drop("load"), "doc_id"), "candidates")

    load = of.agg(F.sum("load")).first()[0] or 0
    groups = max(1, -(-load // group_windows))

    def tree(key, group: pa.Table) -> pa.Table:
        doc = group.column("doc_id").to_numpy()
        frag, lo, hi = subtree(group.column("words").combine_chunks(), doc, window)
        base = group.column("at").to_numpy()[frag]
        return pa.table({"doc_id": doc[frag], "d1": group.column("d1").to_numpy()[frag], "lo": base + lo, "hi": base + hi})

    cuts = fragments(cand, window, gram).groupBy(F.pmod(F.col("prefix"), F.lit(groups)).alias("group")) \
        .applyInArrow(lambda key, group: tree(key, group), "doc_id bigint, d1 bigint, lo bigint, hi bigint")
    nodes = landed(full_depth(cand, window, gram), "full-depth")
    heads = nodes.groupBy("prefix", "name").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")) \
        .where("head < last").select("prefix", "name", "head")
    cuts = cuts.union(nodes.join(heads, ["prefix", "name"]).where("doc_id > head")
                      .select("doc_id", "d1", F.col("at").alias("lo"), (F.col("at") + F.col("n") + (window - 1)).alias("hi")))
    cuts = cuts.groupBy("doc_id").agg(F.collect_list(F.struct("d1", "lo", "hi")).alias("cuts"))
    done = landed(_kept(cand.select("doc_id", "text").join(cuts, "doc_id")).distinct(), "kept")
    for t in (cand, of, nodes):
        discard(t)

    copy = (F.col("doc_id") > F.col("rep")) & (F.col("n") >= window)
    return prof.join(classes, same, "left").join(done, ["doc_id", "d1"], "left").select(
        "doc_id", F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


def oracle(window: int = WINDOW) -> str:
    """DuckDB SQL for ``remove_repeats`` of ``documents``."""
    return f"""
with d as (select doc_id, regexp_extract_all(coalesce(text,''), '[^\\x20\\x09-\\x0D]+') w from documents),
p as (select doc_id, unnest(range(len(w)-{window}+1)) p, w from d where len(w)>={window}),
h as (select doc_id, p, md5(array_to_string(w[p+1:p+{window}],' ')) h from p),
m as (select h, min(doc_id) m from h group by h having min(doc_id)<max(doc_id)),
c as (select doc_id, list(p) ps from h join m using(h) where doc_id>m group by doc_id),
k as (select doc_id, i, list_extract(w, i+1) x from (select doc_id, w, unnest(range(len(w))) i from d)),
g as (select distinct doc_id, p+unnest(range({window})) i from (select doc_id, unnest(ps) p from c)),
s as (select k.doc_id, string_agg(x,' ' order by k.i) t, count(*) n from k anti join g on g.doc_id=k.doc_id and g.i=k.i group by k.doc_id)
select d.doc_id, len(w)::bigint n_words, (len(w)-coalesce(s.n,0))::bigint n_removed, sha256(coalesce(s.t,'')) kept_sha256
from d left join s on s.doc_id=d.doc_id"""
