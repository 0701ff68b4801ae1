"""Near-duplicate documents by circulant MinHash.

Two permutations give all signature coordinates: the first spreads a
document's shingles over the 32-bit universe, the second is shifted
circularly by k for coordinate k, and the coordinate is its minimum over
the set (C-MinHash).  Runs of ``rows`` coordinates form ``bands`` bucket
keys; documents that share a bucket are candidates, and a candidate pair is
a link only if its full shingle sets say so.

Copies never make pairs: documents with the same set are one class, stood
for by its smallest doc_id.  A bucket's head is its smallest representative,
and a head's family are the members of the buckets that it heads.  Heads are
compared with their family, and what is linked is joined.  Candidates that
are then still in different components must meet, but a bucket's square is
not needed for that.  For x and y of the family of z, with a = |x & z| and
b = |y & z|, a link implies one of:

* x and y share a shingle that z lacks, among the first n - ceil(t * n) + 1
  shingles of each, in the order that puts shingles outside z first, rare
  ones before frequent ones (prefix filter for similarity t);
* they share none outside z, so |x & y| <= min(a, b), and then
  (1 + t) * min(a, b) >= t * (|x| + |y|).

Only such pairs are compared, found by joins on (z, shingle) and on (z, size
class).  A document's home is the head reached by going to the head with
which it has most in common, as long as that is half of it; documents of one
home join its family and meet only there.  Every candidate pair is thereby compared on full sets, already
connected, or ruled out exactly: the components are those of comparing all
candidate pairs.

With 4 rows and 24 bands a pair at similarity 0.75 shares a bucket with
probability 0.9999.

Defined cases: a very long text is worked on whole, in one task; null text counts as empty; documents without words have an
empty set and are linked with nothing; with fewer than five words the whole
sequence is the one shingle; a row whose doc_id is null takes no part
(component null, kept); rows with one doc_id are one document; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.llm._graph import components
from codelake.llm._sums import BLOCK_SCHEMA, added_up, blocks
from codelake.llm._tables import discard, landed
from codelake.llm._words import K1, Words, grams, mix, pieces

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 24, 4
CELLS = 1 << 18                # counts of shingles by hash, for rarity: a fixed size
BROADCAST_IDS = 1_000_000      # id lists up to this many rows are broadcast, longer ones joined by shuffle
_BLOCK = 1 << 15               # shingles signed at a time, to stay in cache


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle fingerprints of each row, end to end, and the row offsets into them."""
    w = Words(texts, lower=True)
    h = w.hashes()
    g = grams(h, k)
    sets, edges = [], np.zeros(w.rows + 1, np.int64)
    for r in range(w.rows):
        a, b = w.first[r], w.first[r + 1]
        if b - a >= k:
            s = np.sort(g[a:b - k + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            s = grams(h[a:b], b - a) ^ mix(np.full(1, b - a, np.uint64) * K1)
        else:
            s = g[:0]
        sets.append(s)
        edges[r + 1] = edges[r] + len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), edges


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: np.ndarray, edges: np.ndarray, coordinates: int) -> np.ndarray:
    """C-MinHash coordinates of each non-empty set (rows of empty sets are all ones)."""
    n = len(edges) - 1
    out = np.full((n, coordinates), 0xFFFFFFFF, np.uint32)
    spread = (mix(sets ^ K1) >> np.uint64(32)).astype(np.uint32)      # the first permutation
    filled = np.flatnonzero(edges[1:] > edges[:-1])
    i = 0
    while i < len(filled):                                            # blocks of whole rows
        j = max(i + 1, int(np.searchsorted(edges[filled + 1], edges[filled[i]] + _BLOCK, side="right")))
        rows = filled[i:j]
        x, cut = spread[edges[rows[0]]:edges[rows[-1] + 1]], edges[rows] - edges[rows[0]]
        for k in range(coordinates):
            out[rows, k] = np.minimum.reduceat(_second(x - np.uint32(k)), cut)
        i = j
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key per band (the band's number is part of it)."""
    keys = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, np.uint64) * K1
        for c in range(b * rows, (b + 1) * rows):
            h = mix(h + sig[:, c].astype(np.uint64) * K1)
        keys[:, b] = h
    return keys


def signed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set, and the bucket keys, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                sets, edges = shingle_sets(part.column(1), shingle)
                totals = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(s)), dtype=np.uint64)]) for s in (0x51, 0xA7)]
                d1, d2 = ((t[edges[1:]] - t[edges[:-1]]).view(np.int64) for t in totals)
                n = np.diff(edges)
                keys = band_keys(signatures(sets, edges, bands * rows), bands, rows).view(np.int64)
                flat = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), keys.ravel())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(d1), pa.array(d2), flat],
                                                 ["doc_id", "n", "d1", "d2", "keys"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, d1 bigint, d2 bigint, keys array<bigint>")


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> tuple[bool, int]:
    both = np.sort(np.concatenate([p, q]))
    common = int((both[1:] == both[:-1]).sum())
    return common > 0 and 100 * common >= percent * (len(both) - common), common


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    side = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return side.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a") \
        .select("a", "b", "text_a", "text_b")


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _rarity(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many of the texts' shingles fall into each cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for part in pieces(batch, 0):
                sets, _ = shingle_sets(part.column(0), shingle)
                total += np.bincount((sets % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        yield from blocks(total)

    return added_up(texts.select("text").mapInArrow(count, BLOCK_SCHEMA), CELLS)


def _compared(pairs: DataFrame, texts: DataFrame, uses: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) with linked, the number of common shingles, and b's first shingles that a lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2):
                (x, ex), (y, ey) = shingle_sets(part.column(2), shingle), shingle_sets(part.column(3), shingle)
                linked, common, n, own = [], [], [], []
                for r in range(part.num_rows):
                    p, q = x[ex[r]:ex[r + 1]], y[ey[r]:ey[r + 1]]
                    ok, c = _similar(p, q, percent)
                    linked.append(ok)
                    common.append(c)
                    n.append(len(q))
                    first = len(q) + (-percent * len(q)) // 100 + 1
                    q = q[~np.isin(q, p, assume_unique=True)]
                    q = q[np.lexsort((q, uses[(q % np.uint64(CELLS)).astype(np.int64)]))]
                    own.append(q[:first].view(np.int64))
                edges = np.concatenate([[0], np.cumsum([len(o) for o in own])]).astype(np.int32)
                flat = pa.ListArray.from_arrays(edges, np.concatenate(own) if own else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(linked, pa.bool_()), pa.array(common, pa.int64()),
                                                  pa.array(n, pa.int64()), flat], ["a", "b", "linked", "common", "n", "own"])

    return _with_texts(pairs, texts).mapInArrow(run, "a bigint, b bigint, linked boolean, common bigint, n bigint, own array<bigint>")


def _linked(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2):
                (x, ex), (y, ey) = shingle_sets(part.column(2), shingle), shingle_sets(part.column(3), shingle)
                ok = [_similar(x[ex[r]:ex[r + 1]], y[ey[r]:ey[r + 1]], percent)[0] for r in range(part.num_rows)]
                yield part.filter(pa.array(ok, pa.bool_())).select([0, 1])

    return _with_texts(pairs, texts).mapInArrow(run, "a bigint, b bigint")


def _class(size: Column) -> Column:
    """Size classes that grow by a twentieth."""
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(1.05))).cast("int")


def _homes(star: DataFrame) -> DataFrame:
    """b, home: where going from each member to the head it has most in common with, while that is half of it, ends."""
    up = star.groupBy("b").agg(F.max(F.struct("common", (-F.col("a")).alias("a"))).alias("m"), F.max("n").alias("n")) \
        .select("b", F.when(2 * F.col("m.common") >= F.col("n"), -F.col("m.a")).otherwise(F.col("b")).alias("home"))
    up = landed(up, "homes")
    while True:                                       # heads are smaller than their members, so this ends
        further = up.select(F.col("b").alias("home"), F.col("home").alias("next"))
        new = landed(up.join(further, "home", "left").select("b", "home", F.coalesce("next", "home").alias("next")), "homes")
        moved = new.where("next <> home").limit(1).count()
        discard(up)
        up = new.select("b", F.col("next").alias("home"))
        up._codelake_path = new._codelake_path
        if not moved:
            return up


def _meetings(star: DataFrame, homes: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one family, in different components, that the two conditions do not rule out."""
    of = star.join(comps.withColumnRenamed("id", "b"), "b", "left").withColumn("comp", F.coalesce("comp", "b"))
    heads = comps.select(F.col("id").alias("a"), F.col("comp").alias("head_comp"))
    of = of.join(heads, "a", "left").withColumn("rest", F.col("comp") != F.coalesce("head_comp", "a"))
    of = of.join(homes.withColumnRenamed("home", "near"), "b").select(F.col("a").alias("head"), F.col("b").alias("x"), "n", "common", "own", "comp", "rest", "near")
    open_ = of.where("rest").select("head").distinct()
    of = landed(of.join(open_, "head"), "families")
    here = "comp <> y_comp and (near = head or near <> y_near)"
    cols = ("x", "n", "comp", "near")

    own = of.select("head", *cols, "rest", F.explode("own").alias("token"))
    mixed = own.groupBy("head", "token").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("rest").alias("some"), F.min("near").alias("near"), F.max("near").alias("far")) \
        .where("lo < hi and some and (near < far or near = head)").select("head", "token")
    own = landed(own.join(mixed, ["head", "token"]), "outside")
    other = own.select("head", "token", *[F.col(c).alias("y_" + c) for c in cols])
    outside = own.where("rest").join(other, ["head", "token"]).where(here) \
        .where(100 * F.least("n", "y_n") >= percent * F.greatest("n", "y_n"))

    # the largest partner each can have inside the head's set; size classes up to there
    most = F.floor(F.col("common") * (100 + percent) / percent) - F.col("n")
    inside = of.withColumn("most", most).where(100 * F.col("most") >= percent * F.col("n")).select("head", *cols, "rest", "most")
    inside = landed(inside, "inside")
    reach = inside.where("rest").withColumn("class", F.explode(F.sequence(
        _class(F.greatest(F.lit(1), F.floor(F.col("n") * percent / 100))),
        _class(F.least(F.col("most"), F.ceil(F.col("n") * 100 / percent))))))
    partner = inside.select("head", _class(F.col("n")).alias("class"), *[F.col(c).alias("y_" + c) for c in (*cols, "most")])
    within = reach.join(partner, ["head", "class"]).where(here + " and y_n <= most and n <= y_most")
    both = [F.least("x", "y_x").alias("a"), F.greatest("x", "y_x").alias("b")]
    return outside.select(*both).union(within.select(*both)).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = landed(signed(docs, shingle, bands, rows), "signatures")
    able = sig.where("n > 0 and doc_id is not null")
    classes = landed(able.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep")), "classes")

    # one row per class and bucket
    reps = able.join(classes.withColumnRenamed("rep", "doc_id"), ["d1", "d2", "n", "doc_id"])
    placed = reps.select(F.col("doc_id").alias("rep"), F.explode("keys").alias("bucket"))
    first = placed.groupBy("bucket").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).where("head < last") \
        .select("bucket", "head")
    pairs = landed(placed.join(first, "bucket").where("rep > head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct(),
                   "pairs")
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = landed(docs.join(_few(wanted), "doc_id"), "texts")
    uses = _rarity(texts, shingle)
    star = landed(_compared(pairs, texts, uses, shingle, percent), "stars")
    homes = _homes(star)
    far = landed(homes.where("home <> b").select(F.col("home").alias("a"), "b").join(pairs, ["a", "b"], "left_anti"), "far-homes")
    star = landed(star.union(_compared(far, texts, uses, shingle, percent)), "stars")
    edges = star.where("linked").select("a", "b")
    comps = components(edges)
    more = landed(_meetings(star, homes, comps, percent), "meetings")
    found = landed(_linked(more, texts, shingle, percent), "links")
    if found.limit(1).count():
        comps = components(edges.union(found))
    for t in (texts, pairs, star, more):
        discard(t)

    whole = sig.join(classes, ["d1", "d2", "n"], "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.when(F.col("n") > 0, F.coalesce("comp", "rep")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return whole.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, all columns, without the near-duplicates of smaller doc_ids.

    Of rows with one doc_id (or of equal texts without one) the smallest text stays."""
    found = landed(near_duplicates(docs, **settings).select("doc_id", "kept"), "kept")
    gone = found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(_few(gone), docs["doc_id"] == F.col("_gone"), "left_anti")
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        return left
    same = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).orderBy(F.col("text").asc_nulls_last())
    return left.withColumn("_nth", F.row_number().over(same)).where("_nth = 1").drop("_nth")


def oracle(shingle: int = SHINGLE, percent: int = PERCENT) -> str:
    """DuckDB SQL for ``near_duplicates`` of ``documents``."""
    k = shingle
    fold = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
    return f"""
with recursive w as (select doc_id, regexp_extract_all({fold}, '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select distinct doc_id, unnest(case when len(w)=0 then [] when len(w)<{k} then [array_to_string(w,' ')]
      else list_transform(range(1, len(w)-{k}+2), lambda i: array_to_string(w[i:i+{k}-1],' ')) end) s from w),
n as (select doc_id, count(*) n from s group by doc_id),
c as (select x.doc_id a, y.doc_id b, count(*) c from s x join s y on x.s=y.s and x.doc_id<>y.doc_id group by 1,2),
e as (select a, b from c join n p on p.doc_id=a join n q on q.doc_id=b where 100*c>={percent}*(p.n+q.n-c)),
r(id, far) as (select doc_id, doc_id from documents union select r.id, e.b from r join e on e.a=r.far)
select d.doc_id, coalesce(n.n,0)::bigint n_shingles, m.c component_id, d.doc_id=m.c kept
from documents d join (select id, min(far) c from r group by id) m on m.id=d.doc_id left join n on n.doc_id=d.doc_id"""
