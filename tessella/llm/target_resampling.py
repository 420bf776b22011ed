"""Operator 12: draw documents whose runs of words are distributed like those of target texts.

Features are all runs of one to three words, hashed by CRC-32 into buckets. Pass one counts the features of the corpus and of the
target: tasks put blocks of texts into word tries (``word_tries``), whose nodes hold counts and CRC states, and return
totals by bucket; Spark adds them up, so one row a bucket comes to the driver. A bucket's gain is the floored, scaled
logarithm of how much likelier the target is to show it. Pass two builds the tries again, attaches the gains to their
nodes and sums them along every text's paths. Gumbel noise from a hash of the id makes the highest scores a weighted
draw without replacement.

Ranks are exact at any size: an approximate quantile leaves little more rows than are drawn, these are dealt out by ranges of the
order, and each range numbers its rows from the count of those before it.

Defined results: null texts, and texts without a word, have no features and weight 0; they are never drawn, as they have fewer
words than ``min_words``. Null ids are hashed as empty text and come last among ties; equal rows are drawn each for itself, equal ids with
equal scores in the order of their numbers of features. An empty target makes every gain that of unseen features; empty tables give
no rows; other columns are ignored, whatever their names. Texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, word_tries

BUCKETS, SCALE, MIN_WORDS, PER_CENT, SEED = 10_000, 1000, 20, 5, "42:"


def totals(texts: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The number of features of the column ``text`` in each bucket, over all rows."""
    common.arrow_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in word_tries.blocks(common.utf8(batch.column("text"))):
                for _, _, counts, crc in block.levels():
                    np.add.at(out, crc % np.uint32(buckets), counts)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out[at])], names=["bucket", "n"])

    out = [0] * buckets
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int], scale: int = SCALE) -> list[int]:
    """By bucket: the scaled logarithm of the smoothed share in the target over that in the corpus, floored."""
    of_corpus, of_target, k = float(sum(corpus)), float(sum(target)), float(len(corpus))
    return [math.floor(scale * math.log((t + 1.0) * (of_corpus + k) / ((s + 1.0) * (of_target + k)))) for s, t in zip(corpus, target)]


def weigh(docs: DataFrame, by_bucket: list[int]) -> DataFrame:
    """doc_id, text_key, n_words, n_features, weight: the gains of each text's features, summed. text_key is a hash of the text."""
    common.arrow_batches(docs.sparkSession)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(np.array(by_bucket, np.int64))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            n = batch.num_rows
            out = np.zeros((3, n), np.int64)  # words, features, weight
            for block in word_tries.blocks(common.utf8(batch.column("text"))):
                for level, (text, node, _, crc) in enumerate(block.levels()):
                    if not len(text):
                        continue
                    worth = gain[crc % np.uint32(len(gain))][node]
                    edge = np.flatnonzero(np.diff(text, prepend=-1))
                    per, mine = np.diff(np.append(edge, len(text))), text[edge]
                    np.add.at(out[1], mine, per)
                    np.add.at(out[2], mine, np.add.reduceat(worth, edge))
                    if level == 0:
                        np.add.at(out[0], mine, per)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *map(pa.array, out)], names=["doc_id", "text_key", "n_words", "n_features", "weight"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, f"doc_id {kind}, text_key long, n_words long, n_features long, weight long")


def noise(doc_id: str, scale: int = SCALE, seed: str = SEED) -> Column:
    """Gumbel noise from the first 32 bits of a hash of the id, scaled and floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(weighed: DataFrame, per_cent: int = PER_CENT, min_words: int = MIN_WORDS) -> DataFrame:
    """weighed with ``score`` and ``rank``: of the N rows with enough words the floor(per_cent * N / 100) highest scores, 1 first."""
    scratch = common.Scratch(weighed.sparkSession)
    scored = weighed.withColumn("score", (F.col("weight") + noise("doc_id")).cast("long")).withColumn("__row", F.monotonically_increasing_id())
    scored = scratch.put("scored", scored)
    able = scored.filter(F.col("n_words") >= min_words)
    n = able.count()
    drawn = per_cent * n // 100
    columns = [c for c in scored.columns if c != "__row"]
    if not drawn:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    # the quantile is off by a 10,000th of the rows at most; more rows than are drawn stay, and that is checked
    bound = able.agg(F.percentile_approx("score", max(0.0, 1 - drawn / n - 0.0003), 10_000)).first()[0]
    near = (F.col("n_words") >= min_words) & (F.col("score") >= bound)
    if scored.filter(near).count() < drawn:
        near = F.col("n_words") >= min_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "n_words", "__row"]
    numbered = common.numbered(scratch, scored.filter(near), order, "rank")
    numbered = numbered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return numbered.select(*columns, "rank").unionByName(scored.filter(~near | F.col("n_words").isNull()).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, min_words: int = MIN_WORDS) -> DataFrame:
    """The drawn rows of docs with all their columns; of rows with equal id and text all go with one that is drawn."""
    drawn = ranked(weigh(docs, gains(totals(docs), totals(target))), per_cent, min_words).filter("rank IS NOT NULL")
    keys = drawn.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text")).distinct()
    return docs.join(keys, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__text")), "left_semi")


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return ranked(weigh(docs, gains(totals(docs), totals(target)))).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 by its definition: a table made by eight shifts, then one step for each byte of the UTF-8 form.
ORACLE_SQL = rf"""
WITH RECURSIVE table_steps(b, v, k) AS (
  SELECT range, CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM table_steps WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM table_steps WHERE k = 8),
texts AS (SELECT 0 AS kind, row_number() OVER () AS rid, text FROM documents UNION ALL SELECT 1, row_number() OVER (), text FROM benchmark),
words AS MATERIALIZED (
  SELECT kind, rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS MATERIALIZED (
  SELECT kind, rid, array_to_string(w[i : i + k - 1], ' ') AS f, count(*) AS n
  FROM (SELECT kind, rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY ALL),
hexed AS MATERIALIZED (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)),
buckets AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(length(h) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INT), 2) AS BIGINT))),
    lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM hexed, crc_table),
sums AS (
  SELECT r.range AS bucket, coalesce(sum(n) FILTER (kind = 0), 0) AS s, coalesce(sum(n) FILTER (kind = 1), 0) AS t
  FROM range({BUCKETS}) r LEFT JOIN (SELECT bucket, kind, n FROM features JOIN buckets USING (f)) x ON x.bucket = r.range GROUP BY r.range),
gain AS (
  SELECT bucket, CAST(floor({SCALE} * ln((CAST(t AS DOUBLE) + 1) * (CAST(sum(s) OVER () AS DOUBLE) + {BUCKETS}) / ((CAST(s AS DOUBLE) + 1) * (CAST(sum(t) OVER () AS DOUBLE) + {BUCKETS})))) AS BIGINT) AS g FROM sums),
weighed AS (
  SELECT rid, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS weight FROM features JOIN buckets USING (f) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY rid),
scored AS (
  SELECT d.doc_id, len(w.w) AS n_words, coalesce(x.n_features, 0) AS n_features, coalesce(x.weight, 0) AS weight,
    coalesce(x.weight, 0) + CAST(floor(-{SCALE} * ln(-ln((CAST(CAST('0x' || substr(sha256('{SEED}' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM (SELECT row_number() OVER () AS rid, doc_id FROM documents) d JOIN words w ON w.kind = 0 AND w.rid = d.rid LEFT JOIN weighed x ON x.rid = d.rid),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= {MIN_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) FILTER (n_words >= {MIN_WORDS}) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {MIN_WORDS} AND place <= {PER_CENT} * able // 100 THEN place END AS rank FROM placed"""
