"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, seeded block selection.

Sources get shares of all words by weight; a target stops at so many times its
source's size and the excess is shared again. Targets are turned into whole
blocks of equal size by the highest quotients target / (2 k + 1), and each
source's blocks into integer quotas of its shards in the same way. A shard is
a seeded stream of its documents, cut into blocks; every block is used as often
as the quota goes round, and the rest falls on the blocks that a seeded order
puts first. A document takes its overlap with the blocks in use, so no document
is taken more often than the cap says.

The highest quotients are found by bisecting the multiplier m for which
floor(m * weight + 1/2) adds up to the number of seats; ties at the end go by
quotient, then by name.

Sources are compared by code point, a null source is the last one. A null text
has size 0 and is never taken. Null and repeated ids are separate rows with
one order within their shard; a source with no words has target 0. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD, Scratch, table

SEED = "mix-1"
#: Documents of a shard; blocks that an average source is cut into, and the largest block.
SHARD_DOCS, BLOCKS_A_SOURCE, LARGEST_BLOCK = 8192, 10_000, 4096
#: How often a document may be taken.
CAP = 3


def let(value: Column, body) -> Column:
    """Binds a value once, so that it isn't computed again for each use."""
    return F.transform(F.array(value), body)[0]


def multiplier(weights: Column, seats: Column) -> Column:
    """The largest found m for which floor(m * w + 1/2) over the array adds up to no more than seats."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    half = F.size(weights) / F.lit(2.0)

    def step(bounds: Column, _: Column) -> Column:
        mid = (bounds["lo"] + bounds["hi"]) / 2
        filled = F.aggregate(weights, F.lit(0.0), lambda a, w: a + F.floor(mid * w + 0.5))
        return F.when(filled <= seats, F.struct(mid.alias("lo"), bounds["hi"].alias("hi"))).otherwise(F.struct(bounds["lo"].alias("lo"), mid.alias("hi")))

    start = F.struct(F.greatest(F.lit(0.0), (seats - half) / total).alias("lo"), ((seats + half + 1) / total).alias("hi"))
    return F.when(total > 0, F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, step)["lo"]).otherwise(F.lit(0.0))


def apportion(rows: DataFrame, group: list[str], weight: str, seats: str, order: list[str]) -> DataFrame:
    """Adds quota: the seats of each group dealt to its rows by Sainte-Lague. seats is constant in a group."""
    keyed = rows.withColumn("_g", F.struct(*group) if group else F.lit(0))
    m = keyed.groupBy("_g").agg(F.collect_list(F.col(weight).cast("double")).alias("w"), F.max(seats).alias("n")).select("_g", multiplier(F.col("w"), F.col("n")).alias("m"))
    base = keyed.join(m, "_g").withColumn("base", F.floor(F.col("m") * F.col(weight) + 0.5).cast("long"))
    by = "OVER (PARTITION BY _g ORDER BY IF({0} > 0, 0, 1), {0} / (2 * base + 1) DESC, {1})".format(weight, ", ".join(order))
    return base.selectExpr("*", f"row_number() {by} AS _r", "sum(base) OVER (PARTITION BY _g) AS _b").withColumn("quota", F.col("base") + F.when((F.col("_r") <= F.col(seats) - F.col("_b")) & (F.col(weight) > 0), 1).otherwise(0)).drop("_g", "m", "base", "_r", "_b")


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """Adds weight, target and total to sources (source, source_size): one row a source."""
    by = "ORDER BY source ASC NULLS LAST"
    weighed = sources.selectExpr("*", f"CAST((row_number() OVER ({by}) - 1) % 3 + 1 AS LONG) AS weight", "sum(source_size) OVER () AS total")
    room = weighed.selectExpr("*", f"{cap} * source_size / weight AS room")
    order = "ORDER BY room, weight, source ASC NULLS LAST"
    level = room.selectExpr(
        "*",
        f"(total - coalesce(sum({cap} * source_size) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level",
        f"row_number() OVER ({order}) AS step",
    ).selectExpr("*", "min_by(level, IF(room > level, step, NULL)) OVER () AS common")
    return level.selectExpr("source", "source_size", "n_docs", "weight", "total", f"CAST(IF(common IS NULL OR room <= common, {cap} * source_size, weight * common) AS DOUBLE) AS target")


def mix(spark: SparkSession, docs: DataFrame, cap: int = CAP, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken of docs (doc_id, text, source), with the carried columns, which must not have these names."""
    if taken := {"doc_id", "size", "source_size", "target", "taken"} & {c.lower() for c in carry}:
        raise ValueError(f"columns that the mix has itself: {sorted(taken)}")
    scratch = Scratch(spark, "mix")
    carried = [F.struct(*[docs[c].alias(c) for c in carry]).alias("carried")] if carry else []
    sized = scratch.keep(docs.select("doc_id", "source", *carried, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    aimed = targets(per, cap)
    block = f"CAST(greatest(1, least({LARGEST_BLOCK}, floor(total / (count(*) OVER () * {BLOCKS_A_SOURCE}.0)))) AS LONG)"
    aimed = aimed.selectExpr("*", f"{block} AS block").withColumn("seats", F.round(F.col("total") / F.col("block")).cast("long"))
    quotas = scratch.keep(apportion(aimed, [], "target", "seats", ["source"]).withColumnRenamed("quota", "source_quota").withColumn("shards", F.ceil(F.col("n_docs") / SHARD_DOCS)).drop("seats"))

    known = quotas.selectExpr("source AS s", "source_size", "target", "block", "shards", "source_quota")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = sized.join(known, sized["source"].eqNullSafe(known["s"])).withColumn("key", key).withColumn("shard", F.expr("CAST(conv(substr(key, 1, 8), 16, 10) AS LONG) % shards")).drop("s")
    shard = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.max("source_quota").alias("seats"))
    dealt = apportion(shard, ["source"], "shard_size", "seats", ["shard"]).selectExpr("source AS s", "shard AS h", "shard_size", "quota")
    dealt = scratch.keep(dealt)

    more = ", carried" if carry else ""
    stream = f"OVER (PARTITION BY source, shard ORDER BY key, doc_id, size{more} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    at = placed.selectExpr("*", f"coalesce(sum(size) {stream}, 0) AS begin", f"row_number() OVER (PARTITION BY source, shard ORDER BY key, doc_id, size{more}) AS place")
    at = at.join(dealt, at["source"].eqNullSafe(dealt["s"]) & (at["shard"] == dealt["h"])).drop("s", "h")
    parts = at.selectExpr("*", "explode_outer(IF(size > 0, sequence(begin div block, (begin + size - 1) div block), NULL)) AS b", "ceil(shard_size / block) AS blocks")
    ranked = parts.selectExpr("*", f"dense_rank() OVER (PARTITION BY source, shard ORDER BY b IS NULL, md5(concat('{seed}/', shard, '/', b)), b) AS turn", f"least(quota, {cap} * blocks) AS q")
    used = ranked.withColumn("words", F.expr("(least(begin + size, (b + 1) * block) - greatest(begin, b * block)) * (q div blocks + IF(turn <= q % blocks, 1, 0))"))
    key_columns = ["source", "shard", "place", "doc_id", "size", "source_size", "target", *(["carried"] if carry else [])]
    return used.groupBy(*key_columns).agg(F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("taken")).select("doc_id", "size", "source_size", "target", "taken", *(["carried.*"] if carry else []))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, table(spark, sf_dir, "documents"))


#: The same by listing and ranking all quotients; w is the word pattern.
OP2_SQL = f"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM per),
room AS (SELECT *, {CAP}.0::DOUBLE * source_size / weight AS room FROM weighed),
level AS (SELECT *, (total - coalesce(sum({CAP} * source_size) OVER (ORDER BY room, weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(weight) OVER (ORDER BY room, weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER (ORDER BY room, weight, source ASC NULLS LAST) AS step FROM room),
aimed AS (SELECT *, arg_min(level, CASE WHEN room > level THEN step END) OVER () AS common FROM level),
target AS (SELECT source, source_size, n_docs, total, CAST(CASE WHEN common IS NULL OR room <= common THEN {CAP} * source_size ELSE weight * common END AS DOUBLE) AS target,
  CAST(greatest(1, least({LARGEST_BLOCK}, floor(total / (count(*) OVER () * {BLOCKS_A_SOURCE}.0)))) AS BIGINT) AS block FROM aimed),
seats AS (SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source ASC NULLS LAST, k) AS r, total, block
  FROM target, LATERAL (SELECT unnest(range(0, CAST(ceil(1.2 * target / block) + 2 AS BIGINT))) AS k) WHERE target > 0),
quota AS (SELECT source, count(*) AS source_quota FROM seats WHERE r <= round(total / block::DOUBLE) GROUP BY source),
placed AS (SELECT z.doc_id, z.source, z.size, t.source_size, t.target, t.block, coalesce(q.source_quota, 0) AS source_quota, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key, CAST(ceil(n_docs / {SHARD_DOCS}.0) AS BIGINT) AS shards
  FROM sized z JOIN target t ON z.source IS NOT DISTINCT FROM t.source LEFT JOIN quota q ON q.source IS NOT DISTINCT FROM z.source),
sharded AS (SELECT *, CAST('0x' || substr(key, 1, 8) AS BIGINT) % shards AS shard FROM placed),
shard AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS shard_size, max(source_quota) AS seats, max(block) AS block FROM sharded GROUP BY source, shard),
shard_seats AS (SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * k + 1)::DOUBLE DESC, shard, k) AS r, seats
  FROM (SELECT *, sum(shard_size) OVER (PARTITION BY source) AS all_size FROM shard), LATERAL (SELECT unnest(range(0, CAST(ceil(1.2 * seats * shard_size / all_size) + 2 AS BIGINT))) AS k) WHERE shard_size > 0),
shard_quota AS (SELECT source, shard, count(*) AS quota FROM shard_seats WHERE r <= seats GROUP BY source, shard),
stream AS (SELECT d.*, s.shard_size, coalesce(q.quota, 0) AS quota, row_number() OVER w AS place, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin
  FROM sharded d JOIN shard s ON s.source IS NOT DISTINCT FROM d.source AND s.shard = d.shard LEFT JOIN shard_quota q ON q.source IS NOT DISTINCT FROM d.source AND q.shard = d.shard
  WINDOW w AS (PARTITION BY d.source, d.shard ORDER BY key, doc_id, size)),
parts AS (SELECT *, CAST(ceil(shard_size / block::DOUBLE) AS BIGINT) AS blocks FROM stream, LATERAL (SELECT unnest(range(CAST(begin // block AS BIGINT), CAST((begin + size - 1) // block + 1 AS BIGINT))) AS b) WHERE size > 0),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY source, shard ORDER BY md5('{SEED}/' || shard || '/' || b), b) AS turn, least(quota, {CAP} * blocks) AS q FROM parts),
used AS (SELECT source, shard, place, CAST(sum((least(begin + size, (b + 1) * block) - greatest(begin, b * block)) * (q // blocks + CASE WHEN turn <= q % blocks THEN 1 ELSE 0 END)) AS BIGINT) AS taken FROM ranked GROUP BY source, shard, place)
SELECT s.doc_id, s.size, s.source_size, s.target, coalesce(u.taken, 0) AS taken
FROM stream s LEFT JOIN used u ON u.source IS NOT DISTINCT FROM s.source AND u.shard = s.shard AND u.place = s.place
"""
