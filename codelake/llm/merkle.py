"""A Merkle manifest of a dataset, by time-forward processing.

Every row is a leaf: the SHA-256 of its fields, each with its length in
front.  The leaves of one ``tree`` column value (a language) in key order
are the bottom of a tree in which every ``FAN`` consecutive nodes become
their hash until one is left, the subroot.  The subroots, in the order of
that column, are the bottom of one more tree, whose top is the root.  A
leaf's proof holds, level by level up to the root, the digests to its left
and to its right; with them anyone can recompute the root from the leaf.

Nodes are labelled in post-order, by (last leaf below it, level), so that a
parent's label is larger than those of its children.  The forward sweep
takes nodes in the order of their labels: a priority queue holds digests
addressed to nodes still to come and gives a node all of its children when
the sweep reaches it.  The reversed sweep takes them in falling order, and
the queue gives a node the proof suffix that its parent sent; the node adds
the siblings of each child and sends it on, down to the leaves.

The queue is external.  Labels are cut into blocks of ``BLOCK`` consecutive
nodes of a level.  A message within a block stays in the task's heap (at
most FAN per level); a message to a node beyond it is a row of the next
round, and Spark's shuffle brings a block all messages addressed to it.  A
round takes log(BLOCK) / log(FAN) levels, so a table of n rows takes
log(n) / log(BLOCK) rounds up and as many down, over tables that shrink by
BLOCK.  A block is all that a task holds, whatever the size of a tree.

Defined cases: a null field is ``-``; null and empty text differ; rows with
one key stand in the order of their leaves; equal rows are separate leaves
next to each other; a null key comes first, a null tree value too; a text of
any length enters by its hash alone; an empty table gives an empty result;
columns that are not named take no part, whatever they are called.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.llm._tables import discard, landed
from codelake.operators.ordering import global_index

FAN = 8
LEVELS = 3                     # levels of a block
BLOCK = FAN ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def field(c: Column) -> Column:
    """A field as it enters a leaf: byte count, colon, value; ``-`` for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and a proof."""
    return F.aggregate(path, start, lambda cur, level: F.sha2(F.concat(level["left"], cur, level["right"]), 256))


def proof_digest(path: Column) -> Column:
    """One digest of all siblings of a proof, from the leaf's level up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), ""), 256)


def _height(n: Column) -> Column:
    """Levels above ``n`` leaves: the smallest h with FAN ** h >= n."""
    return sum((n > FAN ** k).cast("int") for k in range(21))


def forward(leaves: list[str], levels: int) -> tuple[str, list]:
    """The forward sweep over one block: its top digest, and its nodes (label, children) in the order of labels."""
    queue: list = []
    nodes: list = []
    digest = leaves[0] if leaves else ""

    def send(level: int, at: int, digest: str) -> None:
        parent = at // FAN
        last = min((parent + 1) * FAN ** (level + 1), len(leaves)) - 1
        heappush(queue, (last, level + 1, at, digest))

    for i, d in enumerate(leaves if levels else []):
        send(0, i, d)
        while queue and queue[0][0] <= i:                      # a node whose last message has arrived
            label = queue[0][:2]
            kids = []
            while queue and queue[0][:2] == label:
                kids.append(heappop(queue)[2:])
            digest = hashlib.sha256("".join(k[1] for k in kids).encode()).hexdigest()
            nodes.append((label, kids))
            if label[1] < levels:
                send(label[1], kids[0][0] // FAN, digest)
    return digest, nodes


def backward(nodes: list, path: list, n_leaves: int, levels: int) -> list[list]:
    """The reversed sweep over one block whose top has the proof ``path``: the proof of each leaf."""
    if not levels:
        return [path] * n_leaves
    out: list = [None] * n_leaves
    order = 0                                                  # keeps the queue from comparing proofs
    queue = [(-n_leaves + 1, -levels, order, path)]
    for (last, level), kids in reversed(nodes):
        below, depth, _, suffix = heappop(queue)
        assert (-below, -depth) == (last, level)
        for k, (at, _) in enumerate(kids):
            own = {"left": "".join(x[1] for x in kids[:k]), "right": "".join(x[1] for x in kids[k + 1:])}
            if level == 1:
                out[at] = [own, *suffix]
            else:
                order += 1
                end = min((at + 1) * FAN ** (level - 1), n_leaves) - 1
                heappush(queue, (-end, 1 - level, order, [own, *suffix]))
    return out


def _block(group: pa.Table) -> tuple[pa.Table, list[str], int]:
    """A block's rows in order, their digests as hex text, and the levels that lie in the block."""
    rows = group.sort_by("at")
    return rows, [d.hex() for d in rows.column("digest").to_pylist()], max(0, min(LEVELS, rows.column("height")[0].as_py()))


def _up(nodes: DataFrame) -> DataFrame:
    """One round of the forward sweep: the top of each block."""

    def climb(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rows, digests, levels = _block(group)
        top, _ = forward(digests, levels)
        return pa.table({"tree": [key[0].as_py()], "at": [key[1].as_py()], "digest": pa.array([bytes.fromhex(top)], pa.binary()),
                         "height": pa.array([max(0, rows.column("height")[0].as_py() - LEVELS)], pa.int32())})

    return nodes.select("tree", "at", "digest", "height").groupBy("tree", F.expr(f"at div {BLOCK}").alias("block")) \
        .applyInArrow(climb, "tree bigint, at bigint, digest binary, height int")


def _down(nodes: DataFrame, tops: DataFrame, carry: list[str]) -> DataFrame:
    """One round of the reversed sweep: the proof of each node, from those of the blocks' tops (tree, block, path, subroot, root)."""
    kinds = dict(nodes.dtypes)

    def descend(key: tuple[pa.Scalar, ...], group: pa.Table, message: pa.Table) -> pa.Table:
        rows, digests, levels = _block(group)
        _, inner = forward(digests, levels)
        paths = backward(inner, message.column("path")[0].as_py(), rows.num_rows, levels)
        same = {c: pa.array([message.column(c)[0].as_py()] * rows.num_rows, pa.string()) for c in ("subroot", "root")}
        return pa.table({c: rows.column(c) for c in carry} | {"path": pa.array(paths, _PATH)} | same)

    schema = ", ".join([f"{c} {kinds[c]}" for c in carry] + [f"path {PATH}", "subroot string", "root string"])
    nodes = nodes.select(*dict.fromkeys(["tree", "at", "digest", "height", *carry]))
    return nodes.groupBy("tree", F.expr(f"at div {BLOCK}").alias("block")) \
        .cogroup(tops.groupBy("tree", "block")).applyInArrow(descend, schema)


def _rise(leaves: DataFrame) -> list[DataFrame]:
    """The forward sweep in rounds: the tables of ever higher nodes, the last with one node a tree."""
    height = leaves.agg(F.max("height")).first()[0] or 0
    tables = [leaves]
    for _ in range(max(1, -(-height // LEVELS))):
        tables.append(landed(_up(tables[-1]), "merkle-up"))
    return tables


def _fall(tables: list[DataFrame], tops: DataFrame, carry: list[str]) -> DataFrame:
    """The reversed sweep in rounds, from the tops of the trees (tree, path, subroot, root) to the leaves."""
    message = tops.withColumn("block", F.lit(0).cast("bigint"))
    for nodes in tables[-2:0:-1]:
        message = landed(_down(nodes, message, ["tree", "at"]).withColumnRenamed("at", "block"), "merkle-down")
    return _down(tables[0], message, carry)


def proofs(rows: DataFrame, key: str, tree: str, digest: Column, *carry: str) -> DataFrame:
    """One row per row: ``key``, the ``carry`` columns, leaf, subroot, root and path, the proof as (left, right) by level.

    ``digest`` is the leaf (hex); ``key`` orders the leaves of one value of ``tree``."""
    narrow = landed(rows.select(F.col(tree).alias("tree_value"), F.col(key).alias("key"), F.unhex(digest).alias("digest"),
                                F.struct(*carry, F.lit(0).alias("_none")).alias("carried"), F.monotonically_increasing_id().alias("nth")), "merkle-leaves")
    # nth tells equal rows apart, so that a key with very many of them is sorted by many tasks
    sorted_ = landed(global_index(narrow, ["tree_value", "key", "digest", "nth"], "place"), "merkle-sorted")
    trees = sorted_.groupBy("tree_value").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    trees = landed(global_index(trees, ["first"], "tree").withColumn("height", _height(F.col("n")).cast("int")), "merkle-trees")
    leaves = sorted_.join(trees.withColumnRenamed("tree_value", "_value"), F.col("tree_value").eqNullSafe(F.col("_value"))) \
        .select("tree", (F.col("place") - F.col("first")).alias("at"), "digest", "height", "key", "carried")
    leaves = landed(leaves, "merkle-ranked")
    for t in (narrow, sorted_):
        discard(t)

    up = _rise(leaves)
    above = _rise(landed(up[-1].select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("at"), "digest",
                                       _height(F.lit(trees.count())).cast("int").alias("height")), "merkle-subroots"))
    none = F.array().cast(PATH)
    root = above[-1].select("tree", none.alias("path"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
    tops = _fall(above, root, ["at", "digest"]).select(F.col("at").alias("tree"), "path", F.lower(F.hex("digest")).alias("subroot"), "root")
    found = _fall(up, landed(tops, "merkle-tops"), ["key", "digest", "carried"])
    return found.select(F.col("key").alias(key), *[F.col(f"carried.{c}").alias(c) for c in carry],
                        F.lower(F.hex("digest")).alias("leaf"), "subroot", "root", "path")


def manifest(docs: DataFrame, tampered: Column, altered: Column) -> DataFrame:
    """Leaves, roots, proofs' digests, and whether a row still verifies after tampering.

    Rows for which ``tampered`` holds are checked with ``altered`` as their text, the others as they are:
    ``folded_root`` is recomputed from that leaf and the original siblings."""
    kinds = {"doc_id": "bigint", "source": "string", "lang": "string", "n_chars": "bigint", "text": "string"}
    d = docs.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()], tampered.alias("_tampered"), altered.alias("_altered"))
    now = F.when(F.coalesce("_tampered", F.lit(False)), F.col("_altered")).otherwise(F.col("text"))
    d = d.withColumn("_now", F.unhex(leaf(*[F.col(c) for c in FIELDS[:-1]], now)))
    p = proofs(d, "doc_id", "lang", leaf(*[F.col(c) for c in FIELDS]), "_now")
    p = p.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                 folded(F.lower(F.hex("_now")), F.col("path")).alias("folded_root"))
    return p.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 8, top_levels: int = 3) -> str:
    """DuckDB SQL for ``manifest`` of ``documents`` as the query calls it, up to FAN ** levels rows a language."""
    def enc(c: str, value: str | None = None) -> str:
        v = value or f"{c}::varchar"
        return f"coalesce(octet_length(encode({v}))::varchar || ':' || ({v}), '-')"

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    head = " || ".join(enc(c) for c in FIELDS[:-1])
    crc = ("xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(doc_id::varchar)+1), lambda i: ord((doc_id::varchar)[i])::bigint)), "
           "lambda c, b: list_reduce([xor(c, b), 0,0,0,0,0,0,0,0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")
    parts = [f"l as (select *, sha256({head} || {enc('text')}) leaf, sha256({head} || case when ({crc}) % 3 = 0 "
             f"then {enc('text', f'translate(text, {upper!r}, {lower!r})')} else {enc('text')} end) cur from documents)",
             "t0 as (select lang, row_number() over (partition by lang order by doc_id nulls first, leaf)-1 a, leaf d, doc_id, cur from l)",
             "n as (select lang, count(*) n from l group by lang)",
             "f0 as (select t0.*, d leaf, '' p, n.n from t0 join n on t0.lang is not distinct from n.lang)"]

    def climb(t: str, f: str, key: str, n: str, count: int) -> None:
        for k in range(count):
            big = f"{n} > {FAN ** k}"
            parts.append(f"{t}k{k} as (select {t}{k}.{key}, a // {FAN} a, string_agg(d, '' order by a) kids, min(d) one, min(n.n) n from {t}{k} "
                         f"join {'n' if t == 't' else '(select count(*) n from n) n'} on {f'{t}{k}.lang is not distinct from n.lang' if t == 't' else 'true'} group by 1, 2)")
            parts.append(f"{t}{k + 1} as (select {key}, a, case when {big} then sha256(kids) else one end d from {t}k{k})")
            left, right = f"left(kids, (64 * ({f}.a % {FAN}))::bigint)", f"substr(kids, (64 * ({f}.a % {FAN}) + 65)::bigint)"
            cols = "doc_id, leaf" + (", subroot" if t == "s" else "")
            parts.append(f"{f}{k + 1} as (select {cols}, {f}.{key}, {f}.a // {FAN} a, case when {f}.{big} then sha256({left} || cur || {right}) else cur end cur, "
                         f"case when {f}.{big} then p || {left} || {right} else p end p, {f}.n n "
                         f"from {f}{k} {f} join {t}k{k} x on x.{key} is not distinct from {f}.{key} and x.a = {f}.a // {FAN})")

    climb("t", "f", "lang", "n", levels)
    parts.append(f"s0 as (select 0 g, row_number() over (order by lang nulls first)-1 a, d, lang from t{levels})")
    parts.append(f"g0 as (select doc_id, leaf, s0.d subroot, 0 g, s0.a, cur, p, (select count(*) from n) n from f{levels} f join s0 on s0.lang is not distinct from f.lang)")
    climb("s", "g", "g", "n", top_levels)
    return ("with " + ",\n".join(parts) + f"\nselect doc_id, leaf, subroot, s.d root, sha256(p) proof_sha256, cur folded_root, cur = s.d verified "
            f"from g{top_levels} cross join (select d from s{top_levels}) s")
