"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources get token targets by weight (water filling under a cap of
``max_copies`` times their own size).  The mix is made of blocks of equal
token count: blocks are given to sources by highest quotients
(target / (2j + 1)), and each source's blocks to its shards the same way,
so every shard has an integer quota.  A shard's documents stand in a seeded
order, their words cut into blocks; the quota is that many consecutive
blocks, around the ring, from a seeded start, and whole rounds for quotas
above the number of blocks.  A document's share of the chosen blocks is
plain arithmetic on its word range, so no row per block is ever made.

Highest quotients without a row per seat: with n parties, V votes and M
seats, the divisors V/(M - n/2) and V/(M + n/2) give at most and at least M
seats, and the two allocations differ by at most 2n seats.  Only those
quotients are ranked; the result is the exact highest-quotient allocation.

Defined cases: a very long text is worked on whole, in one task; null or empty texts have size 0 and take 0; null sources
form one source, last in order; repeated rows count as rows of their own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.llm._tables import landed
from codelake.operators.ordering import global_index

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)            # by rank of the source, repeating
SHARE = 1.5                    # of all words
MAX_COPIES = 2                 # of any source and any document
BLOCK_WORDS = 32
SHARD_WORDS = 1 << 18
SEED = "mix-1"
BROADCAST_ROWS = 20_000        # source and shard tables up to this many rows are broadcast, else joined by key


def _hash(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``: ``share`` of all words by weight, none above ``cap`` sizes.

    Each round is one aggregate that returns four numbers."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, above = 0.0, -1
    while True:
        capped = F.col("weight") * F.lit(level) > F.col("source_size") * F.lit(float(cap))
        r = sources.agg(F.coalesce(F.sum(F.when(capped, F.col("source_size") * cap)), F.lit(0)).alias("full"),
                        F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)).alias("open"),
                        F.count(F.when(capped, 1)).alias("n")).first()
        if r["n"] == above or not r["open"]:
            break
        above, level = r["n"], (share * total - float(r["full"])) / float(r["open"])
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("source_size") * F.lit(float(cap))))


def apportion(df: DataFrame, votes: str, seats: Column, group: list[str], key: str, out: str) -> DataFrame:
    """Add ``out``: the seats of each row by highest quotients within ``group``; ties go to the smaller ``key``.

    ``seats`` is an aggregate or constant giving a group's seats.  With no
    ``group`` the ranking is a distributed sort."""
    w = Window.partitionBy(*group)
    if group:
        base = df.withColumns({"_m": seats, "_v": F.sum(votes).over(w), "_n": F.count(F.lit(1)).over(w)})
    else:
        t = df.agg(F.sum(votes).alias("v"), F.count(F.lit(1)).alias("n")).first()
        base = df.withColumns({"_m": seats, "_v": F.lit(float(t["v"] or 0)), "_n": F.lit(t["n"])})
    v = F.col(votes).cast("double")
    few, many = F.col("_m") - F.col("_n") / 2, F.col("_m") + F.col("_n") / 2
    base = base.withColumns({
        "_lo": F.when((few > 0) & (F.col("_v") > 0), F.floor(v * few / F.col("_v") + 0.5)).otherwise(F.lit(0)),
        "_hi": F.when(F.col("_v") > 0, F.floor(v * many / F.col("_v") + 0.5)).otherwise(F.lit(0))})
    cand = base.where("_hi > _lo").select(
        *group, key, "_m", F.explode(F.expr("sequence(_lo, _hi - 1)")).alias("_j"), v.alias("_votes")
    ).withColumn("_q", F.col("_votes") / (2 * F.col("_j") + 1))
    if group:
        rest = base.groupBy(*group).agg((F.max("_m") - F.sum("_lo")).alias("_rest"))
        cand = cand.withColumn("_rank", F.row_number().over(w.orderBy(F.desc("_q"), key, "_j")) - 1).join(rest, group)
    else:
        rest = base.agg((F.max("_m") - F.sum("_lo")).alias("r")).first()["r"]
        cand = global_index(cand, [F.desc("_q"), F.col(key), F.col("_j")], "_rank").withColumn("_rest", F.lit(rest))
    won = cand.where("_rank < _rest").groupBy(*group, key).agg(F.count(F.lit(1)).alias("_won"))
    return base.join(won, [*group, key], "left") \
        .withColumn(out, (F.col("_lo") + F.coalesce("_won", F.lit(0))).cast("bigint")) \
        .drop("_m", "_v", "_n", "_lo", "_hi", "_won")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES,
        block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    b = block_words
    sizes = landed(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("bigint"), F.lit(0)).alias("size"),
    ).withColumn("size", F.greatest("size", F.lit(0))).withColumn("key", _hash(seed, F.col("doc_id"))), "sizes")

    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = global_index(sources, [F.col("source").asc_nulls_last()], "rank")
    sources = sources.withColumn("weight", F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    sources = landed(targets(sources, share, max_copies), "targets")
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    sources = apportion(sources, "target", F.lit(int(total / b + 0.5)), [], "rank", "blocks").withColumn(
        "shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)))
    sources = landed(sources, "quotas")

    placed = sizes.join(_sized(sources), sizes["source"].eqNullSafe(sources["source"])).select(
        "doc_id", "size", "key", "rank", "source_size", "target", "blocks",
        (_number(F.col("key")) % F.col("shards")).alias("shard"))
    shards = placed.groupBy("rank", "shard").agg(F.sum("size").alias("words"), F.max("blocks").alias("blocks"))
    shards = apportion(shards, "words", F.col("blocks"), ["rank"], "shard", "quota")
    n = F.ceil(F.col("words") / b)
    shards = shards.withColumn("n", n).withColumn("quota", F.least("quota", max_copies * n)).where("n > 0").select(
        "rank", "shard", F.col("words"), F.expr("quota div n").alias("rounds"), (F.col("quota") % F.col("n")).alias("run"),
        (_number(_hash(seed, F.col("rank"), F.col("shard"))) % F.col("n")).alias("start"), "n")
    shards = landed(shards, "shards")

    at = Window.partitionBy("rank", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("from", F.coalesce(F.sum("size").over(at), F.lit(0))) \
        .join(_sized(shards), ["rank", "shard"], "left")

    def common(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("from") + F.col("size"), hi) - F.greatest(F.col("from"), lo))

    end = F.col("start") + F.col("run")
    taken = F.col("rounds") * F.col("size") \
        + common(F.col("start") * b, F.least(end * b, F.col("words"))) \
        + F.when(end > F.col("n"), common(F.lit(0), (end - F.col("n")) * b)).otherwise(F.lit(0))
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("bigint").alias("taken"))


def oracle(weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES,
           block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: str = SEED) -> str:
    """DuckDB SQL for ``mix`` of ``documents``: every quotient is ranked, targets come from sorted cap levels."""
    b, many = block_words, f"+ {block_words}"
    number = "('0x' || substr({}, 1, 8))::bigint"
    seats = "select {k}, count(*) seats from (select {k}, {m} m, row_number() over ({p} order by q desc, {o}, j) r from {t}) where r <= m group by {k}"
    return f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint size,
  md5('{seed}:' || coalesce(doc_id::varchar, '')) key from documents),
s as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 rank from d group by source),
w as (select *, ({list(weights)}[(rank % {len(weights)} + 1)::int])::double weight, {max_copies}.0 * source_size cap from s),
q as (select *, cap / weight level_cap, ({share} * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, rank
  rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) level from w),
l as (select level from q where level <= level_cap order by level_cap, rank limit 1),
t as (select w.*, least(weight * coalesce((select level from l), 0), cap) target from w),
m as (select floor(sum(target) / {b} + 0.5)::bigint m from t),
tq as (select rank, j, target / (2 * j + 1) q, m from (select *, unnest(range((target / {b})::bigint {many})) j from t, m) where target > 0),
blocks as ({seats.format(k="rank", m="m", p="", o="rank", t="tq")}),
u as (select t.*, coalesce(seats, 0) blocks, greatest(1, ceil(source_size / {shard_words}))::bigint shards from t left join blocks using (rank)),
p as (select d.doc_id, d.size, d.key, u.rank, u.source_size, u.target, u.blocks, {number.format("d.key")} % u.shards shard
  from d join u on d.source is not distinct from u.source),
sh as (select rank, shard, sum(size)::bigint words, max(blocks) blocks from p group by rank, shard),
shq as (select rank, shard, j, words / (2 * j + 1) q, blocks m from (select *, unnest(range((2 * words / {b})::bigint {many})) j from sh) where words > 0),
quota as ({seats.format(k="rank, shard", m="m", p="partition by rank", o="shard", t="shq")}),
n as (select sh.rank, sh.shard, words, ceil(words / {b})::bigint n, least(coalesce(seats, 0), {max_copies} * ceil(words / {b})::bigint) quota
  from sh left join quota using (rank, shard)),
run as (select *, quota // n rounds, quota % n run, {number.format(f"md5('{seed}:' || rank || ':' || shard)")} % n start from n where n > 0),
x as (select p.*, coalesce(sum(size) over (partition by rank, shard order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) a
  from p)
select doc_id, size, source_size, target, coalesce(rounds * size
  + greatest(0, least(a + size, least((start + run) * {b}, words)) - greatest(a, start * {b}))
  + case when start + run > n then greatest(0, least(a + size, (start + run - n) * {b}) - a) else 0 end, 0)::bigint taken
from x left join run using (rank, shard)"""
