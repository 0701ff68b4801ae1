"""Repeated byte strings, by a radix sort of suffixes that stops at ``DEPTH`` bytes.

Every byte of every text starts a suffix.  Suffixes are ordered by their
first ``DEPTH`` bytes only, by most-significant-digit passes; suffixes that
are then still equal are exactly the repeated windows, and the bytes they
cover go.  A pass deals suffixes into buckets, and what is alone in its
bucket is no repeat and leaves.

Passes over the cluster deal by long digits.  A window's digit is its
smallest ``gram``-byte string (by hash): equal windows have the same one,
and neighbouring windows mostly share it, so that a stretch of windows
travels as one row, with a code for its bytes.  Stretches with one code are
equal throughout: all of their windows are repeats, and only one of them
stands for the others from there on, so copies and runs never pile up.

A bucket with several different stretches is sorted in one task: passes by
8-byte digits over the windows in it, down to ``DEPTH``.  Buckets too large
for that go to the next pass over the cluster, with a longer digit, which
deals them into smaller buckets.  The last digit is the whole window; there
a bucket holds equal windows, however many, and nothing is left to sort.

Cuts found this way are merged per text, so a text's rows are bounded by its
length.  Texts are read twice after the first pass, and only those with a
cut or a stretch to compare.

Defined cases: null text counts as empty; matches never cross rows; texts
shorter than the window lose nothing; every occurrence of a repeated string
is removed, in whatever row it stands; rows with one doc_id, or with none,
are separate documents, and equal ones are copies of each other; a very long
text is taken in pieces that overlap by a window; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm._tables import discard, landed
from codelake.llm._words import K1, K2, mix, pieces, text_bytes

DEPTH = 200
GRAMS = (32, 96, 160)          # lengths of the digits of the passes over the cluster, before the whole window
GROUP_WINDOWS = 100_000        # windows sorted in one task at a time, about; a bucket with more is dealt anew
CUT = 4096                     # windows of a stretch at most
CHUNK = 1 << 20                # bytes hashed at a time
EMPTY = hashlib.sha256(b"").hexdigest()
SPANS = "array<struct<lo:bigint,hi:bigint>>"
_STRETCH = "array<struct<g:bigint,code:bigint,at:bigint,w:int,twice:boolean>>"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _eights(buf: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes that start at each position, as one number (zeros beyond the end)."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), kind, padded, strides=(1,))[:len(buf)]


def _gram_hashes(eights: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` bytes (8 or more) from each position on."""
    h = mix(eights + K1)
    width, part = 8, h
    while 2 * width <= min(k, 32):                           # twice as many bytes from two hashes
        part = mix(part[:-width] * _ODD ^ part[width:]) if len(part) > width else part[:0]
        width *= 2
    n = len(eights) - k + 1
    if n <= 0:
        return h[:0]
    out, at = part[:n], width
    while at < k:
        step, source = (width, part) if at + width <= k else (8, h)
        at = min(at, k - step)                               # the last bytes may be taken twice
        out = mix((out + K2) ^ source[at:at + n])
        at += step
    return out


def _smallest(x: np.ndarray, run: int) -> np.ndarray:
    """The minimum of each ``run`` consecutive numbers."""
    out, width = x, 1
    while 2 * width <= run:
        out, width = np.minimum(out[:-width], out[width:]), 2 * width
    return np.minimum(out[:len(x) - run + 1], out[run - width:]) if run > width else out


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64."""

    up = down = np.zeros(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
            cls.up, cls.down = (np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_ODD, inverse))
        return cls.up, cls.down


def stretches(buf: np.ndarray, ok: np.ndarray, gram: int, depth: int) -> tuple[np.ndarray, ...]:
    """Stretches of the windows that ``ok`` names: first window, number of windows, digit, code, digit found twice."""
    none = np.zeros(0, np.int64)
    run = depth - gram + 1
    at = np.flatnonzero(ok[:max(0, len(buf) - depth + 1)])
    if not len(at):
        return none, none, none, none, none.astype(bool)
    eights = _eights(buf)
    h = _gram_hashes(eights, gram)
    low = _smallest(h, run)
    low = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1])
    begin = np.flatnonzero(new)
    nth = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    begin = np.flatnonzero(nth % CUT == 0)
    first, count, g = at[begin], np.diff(np.append(begin, len(at))), low[begin]
    if gram == depth:                                        # a stretch is one string, so its code is the digit
        return first, count, g.view(np.int64), g.view(np.int64), count > 1
    # a sum of hashed bytes times powers, moved to the stretch's start: equal for equal bytes wherever they stand
    end = first + count - 1 + depth
    up, down = _Powers.of(len(buf) + 1)
    ones = mix((buf.astype(np.uint64) + K1) * K2)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ones * up[:len(buf)], dtype=np.uint64)])
    code = mix((total[end] - total[first]) * down[first] ^ mix(g + (end - first).astype(np.uint64)))
    # whether the digit stands at two places of the stretch's bytes
    view = np.lib.stride_tricks.sliding_window_view(h, run)
    twice = np.zeros(len(first), bool)
    for i in range(0, len(first), 4096):
        s = slice(i, i + 4096)
        here = (view[first[s]] == g[s, None]).argmax(1) + first[s]
        last = first[s] + count[s] - 1
        twice[s] = last + run - 1 - (view[last][:, ::-1] == g[s, None]).argmax(1) != here
    return first, count, g.view(np.int64), code.view(np.int64), twice


def _found(buf: np.ndarray, ok: np.ndarray, gram: int, depth: int) -> tuple[np.ndarray, ...]:
    """``stretches`` of a long buffer, in chunks that overlap by a window."""
    parts = []
    for a in range(0, max(1, len(buf)), CHUNK):
        part = stretches(buf[a:a + CHUNK + depth - 1], ok[a:a + CHUNK], gram, depth)
        parts.append((part[0] + a, *part[1:]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _whole_windows(offsets: np.ndarray, depth: int) -> np.ndarray:
    """For each byte of rows laid end to end: does a window that starts there end within its row?"""
    ends = offsets[1:]
    out = np.zeros(int(offsets[-1]) + 1, np.int64)
    last = np.maximum(offsets[:-1], ends - depth + 1)
    np.add.at(out, offsets[:-1], 1)
    np.add.at(out, last, -1)
    return np.cumsum(out[:-1]) > 0


def profile(docs: DataFrame, gram: int, depth: int) -> DataFrame:
    """doc_id, k, v, n, sha, and the stretches of each row's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 5, CHUNK):
                buf, offsets = text_bytes(part.column(5))
                first, count, g, code, twice = _found(buf, _whole_windows(offsets, depth), gram, depth)
                edges = np.searchsorted(first, offsets).astype(np.int32)
                at = first - np.repeat(offsets[:-1], np.diff(edges))
                rows = pa.StructArray.from_arrays([pa.array(g), pa.array(code), pa.array(at), pa.array(count.astype(np.int32)), pa.array(twice)],
                                                  ["g", "code", "at", "w", "twice"])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(5)), pa.ListArray.from_arrays(edges, rows)],
                                                 ["doc_id", "k", "v", "n", "sha", "found"])

    return docs.select("doc_id", "k", "v", "n", "sha", "text").mapInArrow(run, f"doc_id bigint, k bigint, v int, n bigint, sha string, found {_STRETCH}")


def _again(cand: DataFrame, gram: int, depth: int) -> DataFrame:
    """The stretches, by a longer digit, of the windows in each row's ``open`` spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2, CHUNK):
                buf, offsets = text_bytes(part.column(2))
                spans = part.column(3)
                base = np.repeat(offsets[:-1], np.diff(spans.offsets.to_numpy()))
                flat = spans.flatten()
                ok = np.zeros(len(buf) + 1, np.int64)
                np.add.at(ok, flat.field("lo").to_numpy() + base, 1)
                np.add.at(ok, flat.field("hi").to_numpy() + base, -1)
                first, count, g, code, twice = _found(buf, np.cumsum(ok[:-1]) > 0, gram, depth)
                row = np.searchsorted(offsets, first, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g), pa.array(code), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)),
                     pa.array(first - offsets[row]), pa.array(count.astype(np.int32)), pa.array(twice)], ["g", "code", "k", "v", "at", "w", "twice"])

    return cand.select("k", "v", "text", "open").mapInArrow(
        run, "g bigint, code bigint, k bigint, v int, at bigint, w int, twice boolean")


def radix_sorted(buf: np.ndarray, first: np.ndarray, bucket: np.ndarray, depth: int) -> np.ndarray:
    """Which windows (by first byte in ``buf``) equal another one of their bucket.

    A pass takes the next eight bytes of every suffix still in question; groups
    whose digits differ are sorted by them and split, and what is alone leaves."""
    order = np.argsort(bucket, kind="stable")
    pos, b = first[order], bucket[order]
    names = order
    new = np.ones(len(pos), bool)
    new[1:] = b[1:] != b[:-1]
    eights = _eights(buf, ">u8")
    for d in range(0, depth, 8):
        alone = new & np.append(new[1:], True)
        if alone.any():
            pos, names, new = pos[~alone], names[~alone], new[~alone]
        if not len(pos):
            break
        digit = eights[pos + d].astype(np.uint64) >> np.uint64(8 * max(0, 8 - (depth - d)))
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        differs = digit != digit[begin[group]]
        if differs.any():
            split = np.zeros(len(begin), bool)
            split[group[differs]] = True
            at = np.flatnonzero(split[group])
            by = at[np.lexsort((digit[at], group[at]))]
            pos[at], names[at], digit[at] = pos[by], names[by], digit[by]
            new[1:] |= digit[1:] != digit[:-1]
    alone = new & np.append(new[1:], True) if len(pos) else new
    out = np.zeros(len(first), bool)
    out[names[~alone]] = True
    return out


def _cuts_of_windows(first: np.ndarray, row: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and end of each run of windows that overlap or touch (windows in order)."""
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] > first[:-1] + depth) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    end = first[np.append(begin[1:], len(first)) - 1] + depth if len(first) else first
    return row[begin], first[begin], end


def _compared(cand: DataFrame, groups: int, depth: int) -> DataFrame:
    """The cuts (k, v, lo, hi) that follow from sorting the windows of the rows' ``ship`` stretches."""

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2, CHUNK):
                buf, offsets = text_bytes(part.column(2))
                ship = part.column(3)
                row = np.repeat(np.arange(part.num_rows), np.diff(ship.offsets.to_numpy()))
                flat = ship.flatten()
                lo = flat.field("at").to_numpy() + offsets[row]
                hi = lo + flat.field("w").to_numpy() + depth - 1
                body = [buf[i:j].tobytes() for i, j in zip(lo, hi)]
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [flat.field("g"), flat.field("code"), part.column(0).take(rows), part.column(1).take(rows), flat.field("at"), flat.field("settled"),
                     pa.array(body, pa.binary())], ["g", "code", "k", "v", "at", "settled", "body"])

    def sort(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        buf, offsets = text_bytes(group.column("body"))
        first = np.flatnonzero(_whole_windows(offsets, depth))
        row = np.searchsorted(offsets, first, side="right") - 1
        bucket = group.column("g").to_numpy()[row]
        hit = radix_sorted(buf, first, bucket, depth) & ~group.column("settled").to_numpy()[row]
        row, lo, hi = _cuts_of_windows(first[hit], row[hit], depth)
        at = group.column("at").to_numpy()[row] - offsets[row]
        return pa.table({"k": group.column("k").take(pa.array(row)), "v": group.column("v").take(pa.array(row)), "lo": lo + at, "hi": hi + at})

    body = cand.select("k", "v", "text", "ship").where("size(ship) > 0").mapInArrow(
        fragments, "g bigint, code bigint, k bigint, v int, at bigint, settled boolean, body binary")
    # equal rows of the table bring the same stretch more than once
    return body.dropDuplicates(["g", "code"]).groupBy(F.pmod(F.col("g"), F.lit(groups)).alias("group")) \
        .applyInArrow(sort, "k bigint, v int, lo bigint, hi bigint")


def _dealt(found: DataFrame, group_windows: int, depth: int, last: bool) -> tuple[DataFrame, DataFrame]:
    """What a pass settles, and what is left: cuts (k, v, lo, hi) of stretches that occur again, and stretches
    to compare (g, code, k, v, at, w, settled, large), one for each code of a bucket."""
    n = F.sum(F.when(F.col("twice"), F.col("w")).otherwise(1)) if last else F.count(F.lit(1))
    codes = landed(found.groupBy("g", "code").agg(n.alias("n"), F.max("twice").alias("twice"), F.min(F.struct("k", "v", "at", "w")).alias("one")), "radix-codes")
    again = found.join(codes.where("n > 1").select("g", "code"), ["g", "code"], "leftsemi")
    cuts = again.select("k", "v", F.col("at").alias("lo"), (F.col("at") + F.col("w") + (depth - 1)).alias("hi"))
    buckets = codes.groupBy("g").agg(F.count(F.lit(1)).alias("codes"), F.min("n").alias("least"), F.sum("one.w").alias("windows"),
                                     F.max(F.col("twice") & (F.col("n") == 1)).alias("twice"))
    unsettled = buckets.where("least = 1 and (codes > 1 or twice)").select("g", (F.col("windows") > group_windows).alias("large"))
    rest = codes.join(unsettled, "g").select("g", "code", "one.*", (F.col("n") > 1).alias("settled"), "large")
    return cuts, landed(rest, "radix-rest")


def _listed(rest: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """By text (k, v): spans to cut, stretches to ship, spans of windows that stay open."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("g", "bigint"), ("code", "bigint"), ("at", "bigint"), ("w", "int"), ("settled", "boolean"), ("large", "boolean"))]
    rows = rest.select("k", "v", F.lit(None).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi"), "g", "code", "at", "w", "settled", "large")
    if cuts is not None:
        rows = rows.union(cuts.select("k", "v", "lo", "hi", *none))
    return rows.groupBy("k", "v").agg(
        F.collect_list(F.when(F.col("lo").isNotNull(), F.struct("lo", "hi"))).alias("spans"),
        F.collect_list(F.when(~F.col("large"), F.struct("g", "code", "at", "w", "settled"))).alias("ship"),
        F.collect_list(F.when(F.col("large"), F.struct(F.col("at").alias("lo"), (F.col("at") + F.col("w")).alias("hi")))).alias("open"))


def _without(cand: DataFrame) -> DataFrame:
    """The merged spans and the bytes that stay, of rows (k, v, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2, CHUNK):
                buf, offsets = text_bytes(part.column(2))
                spans, merged, kept = part.column(3), [], []
                flat, edges = spans.flatten(), spans.offsets.to_numpy() - spans.offsets[0].as_py()
                lo, hi = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
                for r in range(part.num_rows):
                    own = buf[offsets[r]:offsets[r + 1]]
                    gone = np.zeros(len(own) + 1, np.int64)
                    s = slice(edges[r], edges[r + 1])
                    np.add.at(gone, lo[s], 1)
                    np.add.at(gone, hi[s], -1)
                    keep = np.cumsum(gone[:-1]) == 0
                    turn = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]]).astype(np.int8)))
                    merged.append([{"lo": int(a), "hi": int(b)} for a, b in turn.reshape(-1, 2)])
                    kept.append(own[keep].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(merged, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
                     pa.array(kept, pa.binary())], ["k", "v", "spans", "kept"])

    return cand.select("k", "v", "text", "spans").mapInArrow(run, f"k bigint, v int, spans {SPANS}, kept binary")


def _solved(docs: DataFrame, depth: int, grams: tuple[int, ...], group_windows: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, k, v, n, sha, copies), and for texts without copies that lose bytes k, v, spans and kept.

    ``k`` and ``v`` name a row's doc_id and text by 96 bits."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    docs = docs.withColumns({"k": F.xxhash64("doc_id", "text"), "v": F.hash("text"), "n": F.octet_length("text").cast("bigint"), "sha": F.sha2("text", 256)})
    steps = [g for g in grams if g < depth] + [depth]
    prof = landed(profile(docs, steps[0], depth), "radix-profile")
    rows = prof.select("doc_id", "k", "v", "n", "sha")
    rows = landed(rows.join(rows.groupBy("sha").agg(F.count(F.lit(1)).alias("copies")), "sha"), "radix-rows")
    found = prof.select("k", "v", F.explode("found").alias("s")).select("k", "v", "s.*")
    shared = found.groupBy("g").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("uses")).where("uses > 1").select("g")
    found = landed(found.join(shared, "g"), "radix-shared")
    cuts, rest = _dealt(found, group_windows, depth, len(steps) == 1)
    lists = _listed(rest, cuts)
    # a text with copies goes whole; it is read only if it stands for them in a comparison
    many = rows.where("copies > 1").select("k", "v").distinct().withColumn("many", F.lit(True))
    lists = lists.join(many, ["k", "v"], "left").withColumn("many", F.coalesce("many", F.lit(False)))         .where("not many or size(ship) > 0 or size(open) > 0")
    cand = landed(docs.select("k", "v", "text").join(lists, ["k", "v"]), "radix-texts")
    discard(prof)
    more, left, step = [], cand, 0
    while True:
        size = rest.agg(F.sum(F.when(~F.col("large"), F.col("w"))).alias("ship"), F.count_if("large").alias("open")).first()
        if size["ship"]:
            more.append(_compared(left, -(-size["ship"] // group_windows), depth))
        if not size["open"]:
            break
        step += 1
        found = landed(_again(left.where("size(open) > 0"), steps[step], depth), "radix-again")
        cuts, rest = _dealt(found, group_windows, depth, step == len(steps) - 1)
        more.append(cuts)
        left = landed(left.where("size(open) > 0").select("k", "v", "text").join(_listed(rest), ["k", "v"]), "radix-texts") if not rest.isEmpty() else left
    one = cand.where("not many")
    if more:
        rows_of = more[0]
        for m in more[1:]:
            rows_of = rows_of.union(m)
        late = landed(rows_of.groupBy("k", "v").agg(F.collect_list(F.struct("lo", "hi")).alias("late")), "radix-late")
        busy = F.expr("size(ship) > 0 or size(open) > 0")
        met = one.where(busy).join(late, ["k", "v"], "left").withColumn("spans", F.concat("spans", F.coalesce("late", F.array().cast(SPANS))))
        one = one.where(~busy).select("k", "v", "text", "spans").union(met.select("k", "v", "text", "spans"))
    return rows, _without(one.where("size(spans) > 0"))


def _joined(rows: DataFrame, cut: DataFrame, depth: int) -> DataFrame:
    """Every row with its text's cut, and whether it goes whole."""
    whole = (F.col("copies") > 1) & (F.col("n") >= depth)
    return rows.join(cut, ["k", "v"], "left").withColumn("whole", whole)


def without_repeats(docs: DataFrame, depth: int = DEPTH, grams: tuple[int, ...] = GRAMS, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (the removed bytes, from 0, end exclusive), kept (the remaining
    bytes; null where nothing was removed)."""
    rows, cut = _solved(docs, depth, grams, group_windows)
    d = _joined(rows, cut.dropDuplicates(["k", "v"]), depth)
    all_ = F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), F.col("n").alias("hi")))
    return d.select("doc_id", F.col("n").alias("n_bytes"), F.when(F.col("whole"), all_).otherwise(F.coalesce("spans", F.array().cast(SPANS))).alias("spans"),
                    F.when(F.col("whole"), F.lit(b"")).otherwise(F.col("kept")).alias("kept"))


def removed(docs: DataFrame, depth: int = DEPTH, grams: tuple[int, ...] = GRAMS, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows, cut = _solved(docs, depth, grams, group_windows)
    left = F.octet_length("kept").cast("bigint")
    cut = cut.select("k", "v", left.alias("left"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")).distinct()
    d = _joined(rows, cut, depth)
    return d.select("doc_id", F.col("n").alias("n_bytes"),
                    F.when(F.col("whole"), F.col("n")).otherwise(F.col("n") - F.coalesce("left", "n")).alias("n_removed"),
                    F.when(F.col("whole"), F.lit(1).cast("bigint")).otherwise(F.coalesce("n_spans", F.lit(0))).alias("n_spans"),
                    F.when(F.col("whole"), F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


def oracle(depth: int = DEPTH, block: int = 1000) -> str:
    """DuckDB SQL for ``removed`` of ``documents``; bytes are handled as hex digits, in blocks."""
    return f"""
with d as (select doc_id, row_number() over () r, hex(encode(coalesce(text,''))) x from documents),
b as (select r, unnest(range(0, length(x)//2 - {depth} + 1, {block})) o, x from d where length(x) >= {2 * depth}),
c as (select r, o, substr(x, 2*o+1, {2 * (block + depth - 1)}) y from b),
w as (select r, o + i p, md5(substr(y, 2*i+1, {2 * depth})) h from (select r, o, y, unnest(range(length(y)//2 - {depth} + 1)) i from c)),
s as (select r, p from w semi join (select h from w group by h having count(*) > 1) m using (h)),
f as (select r, p, sum(t) over (partition by r order by p) k from (select r, p, (p > coalesce(lag(p) over (partition by r order by p), -{depth + 1}) + {depth})::int t from s)),
g as (select r, min(p) lo, max(p) + {depth} hi from f group by r, k),
e as (select r, lo, hi, coalesce(lag(hi) over (partition by r order by lo), 0) before from g),
t as (select r, count(*) n, sum(hi - lo) gone, max(hi) last_hi, string_agg(substr(x, 2*before+1, 2*(lo-before)), '' order by lo) front from e join d using (r) group by r)
select doc_id, (length(x)//2)::bigint n_bytes, coalesce(gone, 0)::bigint n_removed, coalesce(n, 0)::bigint n_spans,
  sha256(from_hex(case when n is null then x else front || substr(x, 2*last_hi+1) end)) kept_sha256
from d left join t using (r)"""
