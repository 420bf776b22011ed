"""Exact vector search, anchors, and rank fusion of several retrieval channels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.registry import Tables, query
from tessella.sources import shared


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Bytes of the queries that one scan answers; queries and vectors whose products are held at a time, and rows found that are held for each query.
SCAN_BYTES, STEP, ROWS, HELD = 64 << 20, 1024, 1024, 4
#: Pairs whose products are taken in doubles at a time.
PAIRS = 1 << 16


def _slack(dim: int) -> float:
    """How far a product of unit vectors in float32 may be off, with half of the fifth decimal to which similarities are rounded, and more."""
    return 1e-5 + dim * 2.5e-7


def _units(column: pa.Array, dim: int) -> np.ndarray:
    """Rows as vectors of length 1; those without a direction, or of another length, as NaN."""
    out = np.full((len(column), dim), np.nan)
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    out[np.asarray(fits)] = column.filter(fits).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        return out / np.linalg.norm(out, axis=1, keepdims=True)


class _Best:
    """The k best of some queries so far, by similarity and id; what is found is held until it pays to sort it in."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.bar, self.last = n, k, np.full(n, -np.inf), np.zeros(n, np.int64)
        self.parts, self.held = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))], 0

    def add(self, at: np.ndarray, found: np.ndarray, sims: np.ndarray) -> None:
        self.parts.append((at.astype(np.int32), found, sims))
        self.held += len(at)
        if self.held > HELD * self.k * self.n:
            self.sort()

    def sort(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, found, sims = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((found, -sims, at))
        at, found, sims = at[order], found[order], sims[order]
        keep = np.arange(len(at)) - np.searchsorted(at, at) < self.k  # searchsorted: where each row's query begins
        at, found, sims = at[keep], found[keep], sims[keep]
        count = np.bincount(at, minlength=self.n)
        full = np.flatnonzero(count == self.k)
        self.bar[full], self.last[full] = (x[np.cumsum(count)[full] - 1] for x in (sims, found))
        self.parts, self.held = [(at, found, sims)], 0
        return at, found, sims


def _nearest(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """For each query the k nearest of a task's vectors, others than itself.

    Products are taken in float32, STEP queries by ROWS vectors at a time; those that may reach a query's k-th best so far are taken again in
    doubles, rounded and compared. So a task holds its queries, k rows (and a few more) for each of them, and one such block.
    """
    starts, slack = range(0, len(ids), STEP), _slack(queries.shape[1])
    narrow, best = queries.astype(np.float32), [_Best(len(ids[q : q + STEP]), k) for q in starts]
    for batch in batches:
        every = np.asarray(batch.column("vec_id"))
        for r in range(0, len(every), ROWS):
            own, v = every[r : r + ROWS], _units(batch.column("embedding").slice(r, ROWS), queries.shape[1])
            few = v.astype(np.float32).T
            for q, b in zip(starts, best):
                mine = ids[q : q + STEP]
                with np.errstate(invalid="ignore"):
                    row, col = np.divmod(np.flatnonzero(narrow[q : q + STEP] @ few >= (b.bar - slack).astype(np.float32)[:, None]), len(own))
                other = mine[row] != own[col]
                row, col = row[other], col[other]
                for p in range(0, len(row), PAIRS):
                    i, j = row[p : p + PAIRS], col[p : p + PAIRS]
                    s = np.round(np.einsum("ij,ij->i", queries[q + i], v[j]), 5)
                    fits = (s > b.bar[i]) | ((s == b.bar[i]) & (own[j] < b.last[i]))
                    if fits.any():
                        b.add(i[fits], own[j[fits]], s[fits])
    for q, b in zip(starts, best):
        at, found, sims = b.sort()
        yield pa.RecordBatch.from_arrays([pa.array(ids[q + at], pa.int64()), pa.array(found, pa.int64()), pa.array(sims, pa.float64())], names=["q_id", "vec_id", "similarity"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int, scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """q_id, vec_id, similarity, place: the k vectors(vec_id, embedding) nearest to each query by cosine, itself left out.

    One scan of the vectors answers as many queries as take ``scan_bytes``, which are broadcast; a task keeps k rows a query, and the
    last ranking sees those alone. Null ids, null vectors, those of another length than most queries, and those of norm 0, which have no
    direction, find nothing and are found by none.
    """
    spark = vectors.sparkSession
    shared.arrow_batches(spark)
    vectors, q = (d.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id IS NOT NULL") for d in (vectors, queries))
    n, dim = q.filter("embedding IS NOT NULL").agg(F.count("*"), F.mode(F.size("embedding"))).first()
    scans = max(-(-n * (dim or 1) * 8 // scan_bytes), 1)
    q = q.withColumn("__block", F.pmod(F.xxhash64("vec_id"), F.lit(scans)))
    found = spark.createDataFrame([], "q_id long, vec_id long, similarity double")
    for b in range(scans if dim else 0):
        rows = q.filter(F.col("__block") == b).orderBy("vec_id").toArrow()
        if not len(rows):
            continue
        rows = rows.combine_chunks()
        sent = spark.sparkContext.broadcast((np.asarray(rows.column("vec_id")), _units(rows.column("embedding").chunk(0), dim)))
        found = found.unionByName(vectors.mapInArrow(lambda it, sent=sent: _nearest(it, *sent.value, k), "q_id long, vec_id long, similarity double"))
    place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.col("similarity").desc(), "vec_id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


@query(
    "vector_topk",
    """
WITH q AS (SELECT vec_id AS q_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0)
SELECT q_id, vec_id, similarity, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, vec_id) AS place FROM (
  SELECT q_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 5) AS similarity FROM embeddings, q WHERE vec_id <> q_id)) WHERE place <= 10
""",
)
def vector_topk(t: Tables) -> DataFrame:
    """The ten nearest vectors of every query, the vectors whose id is divisible by 20."""
    return nearest(t.embeddings, t.embeddings.filter("vec_id % 20 = 0"), 10)


@query(
    "anchor_argmax",
    """
WITH a AS (SELECT vec_id AS anchor, embedding AS a FROM embeddings WHERE vec_id IN (1, 7, 42, 99)),
s AS (SELECT vec_id, anchor, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(a AS DOUBLE[])), 5) AS similarity FROM embeddings, a)
SELECT vec_id, arg_max(anchor, {'s': similarity, 'a': -anchor}) AS anchor, max(similarity) AS similarity FROM s GROUP BY vec_id
""",
)
def anchor_argmax(t: Tables) -> DataFrame:
    """For every vector the nearest of a few anchors, without a shuffle: the anchors are four literal rows in one array."""
    a = t.embeddings.filter("vec_id IN (1, 7, 42, 99)").agg(F.sort_array(F.collect_list(F.struct((-F.col("vec_id")).alias("id"), F.col("embedding").alias("v")))).alias("anchors"))
    d = t.embeddings.join(F.broadcast(a), F.lit(True))
    best = F.array_max(F.transform("anchors", lambda x: F.struct(F.round(cosine(F.col("embedding"), x["v"]), 5).alias("s"), x["id"].alias("id"))))
    return d.select("vec_id", best.alias("b")).select("vec_id", (-F.col("b.id")).alias("anchor"), F.col("b.s").alias("similarity"))


def fuse(channels: list[DataFrame], key: str, k: int = 60, limit: int = 12) -> DataFrame:
    """Reciprocal-rank fusion of channels(key, place): a channel adds 1 / (k + place), agreement a little more."""
    every = channels[0]
    for c in channels[1:]:
        every = every.unionByName(c)
    d = every.groupBy(key).agg(F.sum(1.0 / (k + F.col("place"))).alias("s"), F.count("*").alias("channels"))
    d = d.select(key, F.round(F.col("s") + 0.001 * (F.col("channels") - 1), 8).alias("score"), "channels")
    return d.orderBy(F.col("score").desc(), key).limit(limit)


@query(
    "hybrid_fusion",
    """
WITH a AS (SELECT key, row_number() OVER (ORDER BY hits DESC, key) AS place FROM (SELECT p_partkey AS key, CAST(contains(lower(p_name), 'cold') AS INT) * 2 + CAST(contains(lower(p_type), 'small') AS INT) AS hits FROM part) WHERE hits > 0),
v AS (SELECT vec_id + 1 AS key, row_number() OVER (ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 3) AS DOUBLE[])), 5) DESC, vec_id) AS place FROM embeddings),
u AS (SELECT key, place FROM a WHERE place <= 50 UNION ALL SELECT key, place FROM v WHERE place <= 50)
SELECT key, round(sum(1.0::DOUBLE / (60 + place)) + 0.001 * (count(*) - 1), 8) AS score, count(*) AS channels FROM u GROUP BY key ORDER BY score DESC, key LIMIT 12
""",
)
def hybrid_fusion(t: Tables) -> DataFrame:
    """Twelve best of a word channel and a vector channel. Each channel is cut to its fifty best before ranks are given."""
    hits = F.contains(F.lower("p_name"), F.lit("cold")).cast("int") * 2 + F.contains(F.lower("p_type"), F.lit("small")).cast("int")
    a = t.part.select(F.col("p_partkey").alias("key"), hits.alias("hits")).filter("hits > 0").orderBy(F.col("hits").desc(), "key").limit(50)
    a = a.select("key", F.row_number().over(Window.orderBy(F.col("hits").desc(), "key")).alias("place"))
    q = F.broadcast(t.embeddings.filter("vec_id = 3").select(F.col("embedding").alias("q")))
    v = t.embeddings.join(q, F.lit(True)).select((F.col("vec_id") + 1).alias("key"), F.round(cosine(F.col("embedding"), F.col("q")), 5).alias("s")).orderBy(F.col("s").desc(), "key").limit(50)
    v = v.select("key", F.row_number().over(Window.orderBy(F.col("s").desc(), "key")).alias("place"))
    return fuse([a, v], "key")


