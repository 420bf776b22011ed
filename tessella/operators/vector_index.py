"""An approximate vector index: cells of a coarse quantizer, probed by query and re-ranked exactly.

Cells are those of spherical k-means, fitted on a sample chosen by hash (at most ``SAMPLE_A_CELL`` vectors a cell); every vector is
indexed. A cell is stored as blocks of at most ``BLOCK`` vectors, so that a cell with a third of all rows is many rows and no
group. Queries find their nearest cells, are gathered by cell in blocks as well, and meet the cells' blocks in a join: a task
multiplies two matrices and keeps the best of each query.

Vectors that are null, of another length, or of norm 0 or without a finite norm have no direction: they are not indexed, and as queries find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.plans.registry import Tables, query
from tessella.sources import shared

from .vectors import nearest

#: NEAR_ROWS vectors are compared with all centres at a time, and TAKEN rows leave a task in one batch.
NEAR_ROWS, TAKEN = 512, 1 << 16
BLOCK, SAMPLE_A_CELL, MOST_CELLS, ROUNDS = 2048, 64, 4096, 6


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (float32) of the rows that have a direction, and these rows' places."""
    rows = column.to_pylist()
    at = [i for i, v in enumerate(rows) if v is not None and len(v) == dim and None not in v]
    m = np.array([rows[i] for i in at], np.float64).reshape(len(at), dim)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.linalg.norm(m, axis=1)
    fine = np.isfinite(norm) & (norm > 0)
    return (m[fine] / norm[fine, None]).astype(np.float32), np.array(at, np.int64)[fine]


def _start(m: np.ndarray, cells: int) -> np.ndarray:
    """First centres: distinct rows, spread over the sample."""
    distinct = np.unique(m, axis=0)
    return distinct[np.linspace(0, len(distinct) - 1, min(cells, len(distinct))).astype(int)]


def _first(s: np.ndarray, probes: int) -> np.ndarray:
    """The places of each row's greatest values, the greatest first, equal ones in their order."""
    return s.argmax(axis=1)[:, None] if probes == 1 else np.argsort(-s, axis=1, kind="stable")[:, :probes]


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.centres, self.kind = spark, path.rstrip("/"), np.zeros((0, 0), np.float32), "float"
        if shared.exists(spark, f"{self.path}/centres"):
            rows = spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()  # MOST_CELLS rows at most
            self.centres, self.kind = np.array([r["centre"] for r in rows], np.float32), rows[0]["kind"]

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def fit(self, vectors: DataFrame, cells: int | None = None, rounds: int = ROUNDS) -> None:
        """Learn the cells from a sample of vectors(vec_id, embedding): about twice the root of their number, if not given."""
        n, dim = vectors.filter("embedding IS NOT NULL").agg(F.count("*"), F.mode(F.size("embedding"))).first()
        cells = min(cells or round(2 * n**0.5), MOST_CELLS)
        if not n or not dim or not cells:
            return
        sample = vectors.filter(F.size("embedding") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_A_CELL * cells).select("embedding")
        sample.write.parquet(f"{self.path}/sample")
        sample = self.spark.read.parquet(f"{self.path}/sample").repartition(max(1, min(200, SAMPLE_A_CELL * cells // 4096)))
        first, _ = matrix(pa.array([r["embedding"] for r in sample.limit(4 * cells).collect()]), dim)
        centres = _start(first, cells)
        for _ in range(rounds):
            centres = self._round(sample, centres)
        self.centres, self.kind = centres, vectors.schema["embedding"].dataType.elementType.simpleString()
        rows = [(i, c.tolist(), self.kind) for i, c in enumerate(centres)]
        self.spark.createDataFrame(rows, "cell int, centre array<float>, kind string").coalesce(1).write.parquet(f"{self.path}/centres")

    def _round(self, sample: DataFrame, centres: np.ndarray) -> np.ndarray:
        sent, dim = self.spark.sparkContext.broadcast(centres), centres.shape[1]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = sent.value
            total, count = np.zeros(c.shape), np.zeros(len(c), np.int64)
            for batch in batches:
                m, _ = matrix(batch.column("embedding"), dim)
                cell = (m @ c.T).argmax(axis=1) if len(m) else np.zeros(0, int)
                np.add.at(total, cell, m)
                count += np.bincount(cell, minlength=len(c))
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at].tolist(), pa.list_(pa.float64()))], names=["cell", "total"])

        parts = sample.mapInArrow(sums, "cell int, total array<double>").select("cell", F.posexplode("total").alias("d", "x"))
        rows = parts.groupBy("cell", "d").agg(F.sum("x").alias("x")).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("v")).collect()
        out = centres.copy()
        for r in rows:
            v = np.array([x["x"] for x in r["v"]])
            norm = np.linalg.norm(v)
            if norm > 0:
                out[r["cell"]] = v / norm
        return out

    def _celled(self, vectors: DataFrame, probes: int) -> DataFrame:
        """cell, id, vector, nth: each vector that has a direction with its nearest cells, the nearest first."""
        sent, dim = self.spark.sparkContext.broadcast(self.centres), self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(0, batch.num_rows, NEAR_ROWS):
                    ids, vectors_ = (batch.column(c).slice(r, NEAR_ROWS) for c in ("vec_id", "embedding"))
                    m, at = matrix(vectors_, dim)
                    if not len(m):
                        continue
                    near = _first(m @ sent.value.T, probes)
                    cell, took, nth = near.ravel(), np.repeat(at, near.shape[1]), np.tile(np.arange(near.shape[1], dtype=np.int32), len(near))
                    for p in range(0, len(cell), TAKEN):
                        take = pa.array(took[p : p + TAKEN])
                        yield pa.RecordBatch.from_arrays([pa.array(cell[p : p + TAKEN], pa.int32()), ids.take(take), vectors_.take(take), pa.array(nth[p : p + TAKEN])], names=["cell", "id", "vector", "nth"])

        shared.arrow_batches(self.spark)
        typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{self.kind}>").alias("embedding"))
        return typed.mapInArrow(run, f"cell int, id long, vector array<{self.kind}>, nth int")

    @staticmethod
    def _blocks(celled: DataFrame) -> DataFrame:
        """cell, ids, flat: rows of a cell in blocks of about BLOCK, dealt by a hash of the id, however large the cell is."""
        sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("n"))  # one row a cell
        d = celled.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("n")))
        listed = d.groupBy("cell", "part").agg(F.sort_array(F.collect_list(F.struct("id", "vector"))).alias("v"))
        return listed.select("cell", F.col("v.id").alias("ids"), F.flatten("v.vector").alias("flat"))

    def add(self, vectors: DataFrame) -> None:
        """Index vectors(vec_id, embedding), all of them; blocks of one cell lie together in the files."""
        if not len(self.centres):
            raise ValueError("fit the index first")
        path = f"{self.path}/celled-{len(self._segments())}"
        self._celled(vectors, 1).write.parquet(path)
        blocks = self._blocks(self.spark.read.parquet(path))
        blocks.repartitionByRange("cell").sortWithinPartitions("cell").write.parquet(f"{self.path}/blocks/segment={len(self._segments())}")

    def _segments(self) -> list[str]:
        if not shared.exists(self.spark, f"{self.path}/blocks"):
            return []
        return [r["segment"] for r in self.spark.read.parquet(f"{self.path}/blocks").select("segment").distinct().collect()]

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """q_id, vec_id, similarity, place of the k best vectors in each query's `probes` nearest cells, itself left out."""
        dim = self.dim
        asked = self._blocks(self._celled(queries, probes)).select("cell", F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"))
        pairs = self.spark.read.parquet(f"{self.path}/blocks").join(asked, "cell").select("ids", "flat", "q_ids", "q_flat")

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, part in ((i, p) for i in range(batch.num_rows) for p in range(0, len(batch.column("q_ids")[i].values), NEAR_ROWS)):
                    ids, q_ids = (np.asarray(batch.column(n)[i].values) for n in ("ids", "q_ids"))
                    v, q = (np.asarray(batch.column(n)[i].values).astype(np.float64).reshape(-1, dim) for n in ("flat", "q_flat"))
                    q_ids, q = q_ids[part : part + NEAR_ROWS], q[part : part + NEAR_ROWS]
                    v, q = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (v, q))
                    s = np.round(q @ v.T, 5)
                    s[q_ids[:, None] == ids] = -np.inf
                    order = np.lexsort((np.broadcast_to(ids, s.shape), -s))[:, :k]
                    found = np.take_along_axis(s, order, 1)
                    keep = np.isfinite(found)
                    yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(q_ids[:, None], order.shape)[keep]), pa.array(ids[order][keep]), pa.array(found[keep])], names=["q_id", "vec_id", "similarity"])

        found = pairs.mapInArrow(best, "q_id long, vec_id long, similarity double").dropDuplicates(["q_id", "vec_id"])
        place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.col("similarity").desc(), "vec_id"))
        return found.withColumn("place", place).filter(F.col("place") <= k)

    def probes_for(self, vectors: DataFrame, queries: DataFrame, k: int, share: float, most: int = 400) -> int:
        """How many cells a search must probe to find `share` of the k nearest, as measured on `most` of the queries, chosen by hash.

        The exact answer tells in which cells the nearest vectors lie; the share is met when that many of them lie in the first ones.
        """
        asked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most)
        exact = nearest(vectors, asked, k).select("q_id", "vec_id").collect()  # most * k rows
        if not exact:
            return 1
        ids = self.spark.createDataFrame([(i,) for i in {r["vec_id"] for r in exact}], "vec_id long")
        cell = {r["id"]: r["cell"] for r in self._celled(vectors.join(F.broadcast(ids), "vec_id", "left_semi"), 1).collect()}
        place = {(q["id"], q["cell"]): q["nth"] for q in self._celled(asked, len(self.centres)).select("id", "cell", "nth").collect()}
        needed = sorted(place[r["q_id"], cell[r["vec_id"]]] for r in exact)
        return needed[min(len(needed) - 1, int(share * len(needed)))] + 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the queries of the exact answer, and the share of its rows that were found."""
    both = exact.select("q_id", "vec_id").join(found.select("q_id", "vec_id").withColumn("hit", F.lit(1)), ["q_id", "vec_id"], "left")
    return both.agg(F.count_distinct("q_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


@query("vector_index_recall", "SELECT count(*) AS queries, TRUE AS reached FROM embeddings WHERE vec_id % 20 = 0")
def vector_index_recall(t: Tables) -> DataFrame:
    """Whether the index finds nine tenths of the ten nearest vectors of all queries, those whose id is divisible by 20."""
    index = VectorIndex(t.spark, shared.shared_dir(t.spark, "vectors"))
    index.fit(t.embeddings)
    index.add(t.embeddings)
    queries = t.embeddings.filter("vec_id % 20 = 0")
    probes = index.probes_for(t.embeddings, queries, 10, 0.93)
    r = recall(index.search(queries, 10, probes), nearest(t.embeddings, queries, 10))
    return r.select("queries", (F.col("recall") >= 0.9).alias("reached"))
