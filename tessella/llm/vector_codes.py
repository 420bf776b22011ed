"""Operator 11: short codes for vectors, by product codebooks and partial-distance search.

Components become integers, floor(scale * x), and vectors are cut into equal consecutive parts. Each part position has a
codebook that starts as that part of the kept vectors with the smallest ids. In each round every part goes to its nearest
entry (squared distance, ties to the lower index) and each entry becomes its parts' componentwise floored mean. A round is one pass
over the table: tasks return sums and counts by entry, which Spark adds up, so that only codebooks come to the driver.

The search takes a part's dimensions in descending variance of its codebook. A part's first candidate is the entry nearest
in the leading dimension, whose whole distance is the bound; the other entries gather their distance dimension by
dimension for all vectors at once, and a mask drops each pair as soon as its integer sum strictly exceeds that vector's bound.

Defined results: rows whose vector is null, empty or holds null or non-finite components are dropped, and so are vectors
whose length differs from that of the kept vector with the smallest id. A length that the number of parts does not divide is
filled up with zeros. Scaled components beyond +-2^25 count as that. Null ids come last, equal ids in the order of their
vectors; with fewer vectors than entries, codebooks are as much smaller. An empty table gives no rows; other columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LARGEST = 1 << 25
#: Sums of labels are broadcast up to this many labels, and joined by shuffles beyond.
MOST_LABELS = 100_000


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows whose vector has only finite components, one at least."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select("vec_id", "label", "embedding").filter((F.size("embedding") > 0) & fine)


def integers(column: pa.ListArray, dim: int) -> np.ndarray:
    """The scaled components of equally long vectors as int64, one row for each dimension; ``dim`` includes the fill."""
    flat = np.asarray(pc.list_flatten(column).to_numpy(zero_copy_only=False), np.float64)
    x = np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64).reshape(len(column), -1).T
    return np.ascontiguousarray(x) if len(x) == dim else np.vstack([x, np.zeros((dim - len(x), x.shape[1]), np.int64)])


def descending_variance(book: np.ndarray) -> list[int]:
    """The dimensions of a codebook (entries, dimensions) by variance, exactly: n * sum of squares - square of the sum."""
    spread = [len(book) * sum(int(v) ** 2 for v in c) - sum(map(int, c)) ** 2 for c in book.T]
    return sorted(range(book.shape[1]), key=lambda d: (-spread[d], d))


def nearest(x: np.ndarray, book: np.ndarray, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each column of x (dimensions, vectors) its nearest entry and the squared distance."""
    lead = order[0]
    first = np.abs(x[lead][:, None] - book[:, lead][None, :]).argmin(axis=1)
    entry, bound = first.copy(), np.zeros(x.shape[1], np.int64)
    for d in order:
        bound += (x[d] - book[first, d]) ** 2
    for j in range(len(book)):
        live = np.flatnonzero(first != j)
        sums = np.zeros(len(live), np.int64)
        for d in order:
            sums += (x[d, live] - book[j, d]) ** 2
            stay = sums <= bound[live]
            if not stay.all():
                live, sums = live[stay], sums[stay]
            if not len(live):
                break
        wins = (sums < bound[live]) | (entry[live] > j)
        live, sums = live[wins], sums[wins]
        entry[live], bound[live] = j, sums
    return entry, bound


class Codebooks:
    """(parts, entries, width) integers, and the order in which each part's dimensions are searched."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.orders = [descending_variance(b) for b in entries]

    @property
    def dim(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries (parts, vectors) and the distances summed over the parts."""
        width = self.entries.shape[2]
        found = [nearest(x[p * width : (p + 1) * width], b, o) for p, (b, o) in enumerate(zip(self.entries, self.orders))]
        return np.array([f[0] for f in found]), np.sum([f[1] for f in found], axis=0)

    def decode(self, code: str) -> list[int]:
        """The integer vector that a code stands for."""
        return [int(v) for p, e in enumerate(bytes.fromhex(code)) for v in self.entries[p, e]]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _start(rows: DataFrame, parts: int, entries: int) -> tuple[Codebooks | None, int]:
    """The first codebooks, and the vectors' length without the fill."""
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    lead = rows.orderBy(*order).limit(1).collect()
    if not lead:
        return None, 0
    length = len(lead[0]["embedding"])
    got = rows.filter(F.size("embedding") == length).orderBy(*order).limit(entries).collect()
    dim = -(-length // parts) * parts
    x = integers(pa.array([r["embedding"] for r in got], pa.list_(pa.float64())), dim)
    return Codebooks(x.T.reshape(len(got), parts, dim // parts).transpose(1, 0, 2).copy()), length


def _sums(books: Codebooks):
    parts, k, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.entries.shape, np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            x = integers(batch.column("embedding"), books.dim)
            chosen, _ = books.assign(x)
            for p in range(parts):
                counts[p] += np.bincount(chosen[p], minlength=k)
                for e in range(k):
                    sums[p, e] += x[p * width : (p + 1) * width, chosen[p] == e].sum(axis=1)
        values = np.concatenate([counts.ravel(), sums.ravel()])
        at = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(values[at])], names=["at", "value"])

    return run


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks | None, int]:
    """Codebooks after ``rounds`` rounds over all vectors, and the length of the vectors that have codes; (None, 0) without vectors."""
    common.arrow_batches(vectors.sparkSession)
    rows = whole(vectors)
    books, length = _start(rows, parts, entries)
    if books is None:
        return None, 0
    mine = rows.filter(F.size("embedding") == length).select("embedding")
    for _ in range(rounds):
        got = mine.mapInArrow(_sums(books), "at long, value long").groupBy("at").agg(F.sum("value").alias("value")).collect()
        values = np.zeros(books.entries.size + books.entries.shape[0] * books.entries.shape[1], np.int64)
        for r in got:
            values[r["at"]] = r["value"]
        n = books.entries.shape[0] * books.entries.shape[1]
        counts, sums = values[:n].reshape(books.entries.shape[:2]), values[n:].reshape(books.entries.shape)
        books = Codebooks(np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books.entries))
    return books, length


def encode(vectors: DataFrame, books: Codebooks, length: int) -> DataFrame:
    """vec_id, label, code, error of every vector that has a code."""
    rows = whole(vectors).filter(F.size("embedding") == length)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    parts = books.entries.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen, error = books.assign(integers(batch.column("embedding"), books.dim))
            digits = np.ascontiguousarray(chosen.T.astype(np.uint8)).tobytes().hex()
            codes = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with ``label_error``, the errors of its label summed; null labels are one label. Rows are never gathered by label."""
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    small = sums.limit(MOST_LABELS + 1).count() <= MOST_LABELS
    return coded.join(F.broadcast(sums) if small else sums, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books, length = fit(vectors)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = common.materialise(encode(vectors, books, length), "coded")
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _oracle(rounds: int = ROUNDS) -> str:
    sql = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
xs AS MATERIALIZED (
  SELECT rid, d, d // (n // {PARTS}) AS p, CAST(floor({SCALE} * CAST(embedding[d + 1] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT rid, embedding, len(embedding) AS n, unnest(range(len(embedding))) AS d FROM kept)),
book0 AS MATERIALIZED (SELECT rid - 1 AS e, d, p, x FROM xs WHERE rid <= {ENTRIES})"""
    for r in range(rounds + 1):
        sql += f""",
near{r} AS MATERIALIZED (
  SELECT rid, p, min(struct_pack(dist := dist, e := e)) AS m
  FROM (SELECT a.rid, a.p, b.e, CAST(sum((a.x - b.x) * (a.x - b.x)) AS BIGINT) AS dist FROM xs a JOIN book{r} b USING (d) GROUP BY a.rid, a.p, b.e) GROUP BY rid, p)"""
        if r < rounds:
            sql += f""",
book{r + 1} AS MATERIALIZED (
  SELECT b.e, b.d, b.p, coalesce(CAST(floor(CAST(s.total AS DOUBLE) / s.n) AS BIGINT), b.x) AS x
  FROM book{r} b LEFT JOIN (SELECT n.m.e AS e, x.d, sum(x.x) AS total, count(*) AS n FROM xs x JOIN near{r} n USING (rid, p) GROUP BY n.m.e, x.d) s USING (e, d))"""
    return f"""{sql},
coded AS (
  SELECT k.vec_id, k.label, string_agg('0' || substr('0123456789abcdef', CAST(n.m.e AS INT) + 1, 1), '' ORDER BY n.p) AS code, CAST(sum(n.m.dist) AS BIGINT) AS error
  FROM kept k JOIN near{rounds} n USING (rid) GROUP BY k.rid, k.vec_id, k.label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, d)) FROM book{rounds}) AS codebooks_sha256
FROM coded"""


ORACLE_SQL = _oracle()
