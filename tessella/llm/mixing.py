"""Operator 5 [native]: mix sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating; together they get ``share`` times all words. No
target goes above ``most`` times its source's size; what a capped source leaves is dealt again by weight. Sorted by
size / weight, the capped sources come first, so one running sum over the sources gives the level at which the rest
share.

Blocks: each source gets as many blocks as the highest quotients target / (2k + 1) give it, and deals them in the same way to
its shards by shard size, a shard being the documents with one hash value (about ``shard_words`` words each, and up to
MOST_SHARDS shards a source, so that neither a source nor the ranking of its shards is a large group). All blocks are equal: of
``block`` words, or a 16th of the smallest target where that is less, but of one word at least. In a shard, documents stand
in seeded order; its words are a circle that begins at a seeded place, and its quota of blocks goes round it from there. So a
document is taken whole as many times as the quota goes round, and once more where the last round reaches it; sums
are exact per shard.

Defined results: null or blank texts have size 0 and are taken 0 times; the null source is a source of its own, last in
order; equal rows are placed each for itself, equal ids in the order of their texts' hashes, null ids by their texts; an empty table gives no rows;
other columns pass through ``apply_mix``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
BLOCK, SHARD_WORDS, MOST_SHARDS, SEED = 16, 200_000, 1 << 16, "mix-1"


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size -> also target. One row for each source goes in; the windows below see those rows only."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_ = Window.partitionBy()
    level = (F.sum("source_size").over(all_) * F.lit(share) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(most)) / F.sum("weight").over(after)
    t = sizes.withColumn("weight", w).withColumn("ratio", F.col("source_size") * F.lit(most) / F.col("weight")).withColumn("level", level)
    t = t.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(all_))
    full = F.col("source_size") * F.lit(most)
    return t.select("source", "source_size", F.least(full, F.coalesce(F.col("level") * F.col("weight"), full)).alias("target"))


def apportion(rows: DataFrame, votes: str, seats: Column, group: list[str], tie: list[Column], out: str) -> DataFrame:
    """Sainte-Laguë: ``seats`` of each group go to its rows by the highest quotients votes / (2k + 1).

    At some divisor d each row has votes / d seats, give or take a half, so of n rows with votes V / d lies within n / 2 of
    the seats. Quotients enter the ranking between the two numbers of seats that this leaves a row; all rows together
    have about 3 n of them, however many a single one has, and what lies below is won in any case.
    """
    all_ = Window.partitionBy(*group)
    total, half = F.sum(votes).over(all_), F.sum((F.col(votes) > 0).cast("long")).over(all_) / 2
    t = rows.withColumn("__seats", seats.cast("long"))
    near = lambda n, off: F.when(total > 0, F.greatest(F.floor(F.col(votes) * n / total + off), F.lit(0))).otherwise(F.lit(0)).cast("long")
    t = t.withColumn("__sure", near(F.col("__seats") - half, -0.5)).withColumn("__most", near(F.col("__seats") + half, 0.5))
    t = t.withColumn("__left", F.col("__seats") - F.sum("__sure").over(all_))
    c = t.withColumn("__k", F.explode(F.sequence("__sure", "__most")))
    quotient = F.col(votes) / (2 * F.col("__k") + 1)
    won = F.row_number().over(Window.partitionBy(*group).orderBy(quotient.desc(), *tie, F.col("__k")))
    keys = [x for x in rows.columns]
    c = c.withColumn("__won", ((won <= F.col("__left")) & (F.col(votes) > 0)).cast("long"))
    return c.groupBy(*keys).agg((F.max("__sure") + F.sum("__won")).alias(out))


def _seeded(seed: str, key: Column) -> Column:
    """A number under 2^60."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, begin of each document, with ``text_key`` to tell equal ids apart.

    ``begin`` is the first word of the part that is taken once more; words past the end go on at the document's start.
    """
    d = docs.select(F.col("doc_id").cast("long"), "source", n_words("text").alias("size"), F.xxhash64("text").alias("text_key"), F.when(F.col("doc_id").isNull(), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("md5"))
    # documents without an id are told apart by their texts, so that they are no large group
    d = common.materialise(d.withColumn("place", _seeded(seed, F.coalesce(F.col("doc_id").cast("string"), "md5"))).drop("md5"), "sizes")
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = targets(sizes, weights)
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy())
    t = t.withColumn("block", F.greatest(F.least(F.floor(smallest / 16), F.lit(block)), F.lit(1)).cast("long"))
    # at the divisor `block` the highest quotients, as many as all sources have blocks, are these of each source
    t = t.withColumn("blocks", F.round(F.col("target") / F.col("block")).cast("long"))
    shards = F.greatest(F.least(F.ceil(F.col("source_size") / shard_words), F.lit(MOST_SHARDS)), F.lit(1))
    t = t.select("source", "source_size", "target", "blocks", "block", shards.cast("long").alias("shards"))
    t = common.materialise(t, "targets")
    # a row for each source; sources can be many, so Spark chooses the join
    d = d.join(t, d["source"].eqNullSafe(t["source"]), "inner").drop(t["source"]).withColumn("shard", F.pmod("place", "shards"))
    s = d.groupBy("source", "source_size", "target", "blocks", "block", "shard").agg(F.sum("size").alias("shard_size"))
    s = apportion(s, "shard_size", F.col("blocks"), ["source"], [F.col("shard")], "quota")
    s = s.select(F.col("source").alias("__s"), F.col("shard").alias("__h"), "shard_size", F.least(F.col("quota") * F.col("block"), 2 * F.col("shard_size")).alias("take"))
    d = d.join(s, d["source"].eqNullSafe(s["__s"]) & (d["shard"] == s["__h"]), "inner").drop("__s", "__h")
    order = Window.partitionBy("source", "shard").orderBy(F.col("place").asc_nulls_last(), "doc_id", "text_key", "size")
    d = d.withColumn("lo", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    z = F.greatest("shard_size", F.lit(1))
    d = d.withColumn("rounds", F.floor(F.col("take") / z).cast("long")).withColumn("rest", F.col("take") - F.col("rounds") * F.col("shard_size"))
    # the circle begins at a block's edge
    edges = F.greatest(F.ceil(F.col("shard_size") / F.col("block")), F.lit(1)).cast("long")
    d = d.withColumn("from", F.pmod(F.pmod(_seeded(seed + ":shard", F.col("shard").cast("string")), edges) * F.col("block"), z))
    hi, end = F.col("lo") + F.col("size"), F.col("from") + F.col("rest")
    inside = F.greatest(F.least(hi, end) - F.greatest("lo", "from"), F.lit(0))
    wrapped = F.greatest(F.least(hi, end - F.col("shard_size")) - F.col("lo"), F.lit(0))
    begin = F.when(inside > 0, F.greatest("lo", "from") - F.col("lo")).otherwise(F.lit(0)).cast("long")
    return d.select("doc_id", "source", "text_key", "size", "source_size", "target", (F.col("rounds") * F.col("size") + inside + wrapped).cast("long").alias("taken"), begin.alias("begin"))


_SPLIT = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def apply_mix(docs: DataFrame, **options: object) -> DataFrame:
    """docs as the mix takes them: a row for each whole copy, and one with the words of the part taken once more.

    Equal rows count as one that takes what each of them would. n_chars, where docs has it, follows the text.
    """
    m = mix(docs, **options).groupBy("doc_id", "text_key").agg(F.sum("taken").alias("taken"), F.max("size").alias("size"), F.min("begin").alias("begin"), F.count("*").alias("times")).filter("taken > 0")
    key = F.xxhash64(F.col("text").cast("string"))
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d0"), key.alias("t0"))
    d = packed.join(m, packed["d0"].eqNullSafe(m["doc_id"]) & packed["t0"].eqNullSafe(m["text_key"]))
    # only rows that repeat with their id and text need another look
    d = d.filter("times = 1").unionByName(d.filter("times > 1").dropDuplicates(["d0", "t0"]))
    words = F.when(F.col("taken") % F.col("size") > 0, F.regexp_extract_all(F.col("row.text").cast("string"), F.lit(_SPLIT), F.lit(0)))
    d = d.withColumns({"words": words, "part": F.col("taken") % F.col("size")})
    head = F.expr("slice(words, CAST(begin + 1 AS INT), CAST(least(part, size - begin) AS INT))")
    wrap = F.expr("slice(words, 1, CAST(greatest(part - (size - begin), 0) AS INT))")
    # a text's last word has no blank behind it: where the part goes on at the start, a line feed stands between
    joined = F.concat(F.array_join(head, ""), F.when(F.size(wrap) > 0, F.lit("\n")).otherwise(F.lit("")), F.array_join(wrap, ""))
    part = F.when(F.col("part") > 0, F.array(joined)).otherwise(F.array().cast("array<string>"))
    copies = F.array_repeat(F.col("row.text").cast("string"), F.floor(F.col("taken") / F.col("size")).cast("int"))
    d = d.select("row", F.explode(F.concat(copies, part)).alias("mixed"))
    row = F.col("row").withField("text", F.col("mixed"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("mixed").cast(docs.schema["n_chars"].dataType))
    return d.select(row.alias("row")).select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST({_WORDS} AS BIGINT) AS size,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS place
  FROM documents),
w AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source),
r AS (SELECT *, source_size * 2.0::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2.0::DOUBLE)
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
m AS (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS lv FROM l),
t0 AS (SELECT source, source_size, least(source_size * 2.0::DOUBLE, coalesce(lv * weight, source_size * 2.0::DOUBLE)) AS target FROM m),
t AS (SELECT *, (SELECT greatest(least(CAST(floor(min(target) / 16) AS BIGINT), {BLOCK}), 1) FROM t0 WHERE target > 0) AS block FROM t0),
sq AS (SELECT t.source, k, target / (2 * k + 1) AS q FROM t, range(0, CAST(ceil(target / block) AS BIGINT) + 2) x(k)),
sr AS (SELECT source, k, row_number() OVER (ORDER BY q DESC, source NULLS LAST, k) AS rn FROM sq),
b AS (SELECT t.source, t.source_size, t.target, t.block, count(sr.k) AS blocks, greatest(least(CAST(ceil(t.source_size / {float(SHARD_WORDS)}) AS BIGINT), {MOST_SHARDS}), 1) AS shards
  FROM t LEFT JOIN sr ON sr.source IS NOT DISTINCT FROM t.source AND sr.rn <= (SELECT CAST(sum(round(target / block)) AS BIGINT) FROM t) GROUP BY ALL),
e AS (SELECT d.*, b.source_size, b.target, b.blocks, b.block, d.place % b.shards AS shard FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
s AS (SELECT source, shard, any_value(blocks) AS blocks, any_value(block) AS block, CAST(sum(size) AS BIGINT) AS z FROM e GROUP BY source, shard),
hq AS (SELECT source, shard, k, row_number() OVER (PARTITION BY source ORDER BY z / (2 * k + 1) DESC, shard, k) AS rn, blocks FROM s, range(0, CAST(ceil(2 * z / block) AS BIGINT) + 8) x(k) WHERE z > 0),
quota AS (SELECT source, shard, count(*) AS quota FROM hq WHERE rn <= blocks GROUP BY source, shard),
f AS (SELECT e.*, s.z, least(coalesce(quota, 0) * e.block, 2 * s.z) AS take FROM e JOIN s ON e.source IS NOT DISTINCT FROM s.source AND e.shard = s.shard
  LEFT JOIN quota ON quota.source IS NOT DISTINCT FROM e.source AND quota.shard = e.shard),
g AS (SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS lo,
  take // greatest(z, 1) AS rounds, ((CAST('0x' || substr(md5('{SEED}:shard:' || shard), 1, 15) AS BIGINT) % greatest(CAST(ceil(z / block) AS BIGINT), 1)) * block) % greatest(z, 1) AS fr FROM f),
h AS (SELECT *, take - rounds * z AS rest FROM g)
SELECT doc_id, size, source_size, target, CAST(rounds * size + greatest(least(lo + size, fr + rest) - greatest(lo, fr), 0) + greatest(least(lo + size, fr + rest - z) - lo, 0) AS BIGINT) AS taken
FROM h
"""
