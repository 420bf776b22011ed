"""Operator 10: pack documents into sequences by shortest-pack-first over the histogram of lengths.

Each text is encoded where it lies and cut into pieces of at most ``window`` ids; only (doc_id, start, length, crc) go
on. The histogram of piece lengths (at most ``window`` rows) is packed on the driver: lengths go longest first, each into
the pack that is filled least, and packs that look alike are one pattern with a count. The pieces then take their places
by their rank within their length: ranks are counted in salted groups, so that a length that many pieces share is no
large group, and a place is found by bisection among the patterns' rank intervals.

Defined results: null or empty texts have the end id alone; equal rows are packed each for itself; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, tokenizer_path

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, window: int, max_words: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path, max_words)
    end = np.array([end_id], enc.dtype).tobytes()
    for batch in batches:
        keys, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        rows: list[tuple] = []
        for i in range(0, len(keys), 32):
            for key, raw in zip(keys[i : i + 32], enc.batch(texts.slice(i, 32).to_pylist())):
                ids = np.frombuffer(raw + end, enc.dtype).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    rows.append((key, start, len(piece), zlib.crc32(piece), len(ids)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def shortest_pack_first(histogram: dict[int, int], window: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of each pattern. Work and output are bounded by the distinct lengths and the window, not by the pieces."""
    heap: list[tuple[int, tuple[int, ...], int]] = []  # (-room, lengths, count)
    full: list[tuple[int, tuple[int, ...]]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not heap or -heap[0][0] < length:
                # a new pack is then the one filled least, so it takes pieces of this length until none fits
                each = min(window // length, left)
                opened = left // each
                if each * length < window:
                    heapq.heappush(heap, (each * length - window, (length,) * each, opened))
                else:
                    full.append((opened, (length,) * each))
                left -= opened * each
                continue
            room, pattern, count = heapq.heappop(heap)
            # as many packs of this pattern as pieces are left take one each
            took = min(left, count)
            if took < count:
                heapq.heappush(heap, (room, pattern, count - took))
            if room + length:
                heapq.heappush(heap, (room + length, (*pattern, length), took))
            else:
                full.append((took, (*pattern, length)))
            left -= took
    return sorted([*full, *((count, pattern) for _, pattern, count in heap)], key=lambda x: (x[1], x[0]))


def intervals(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: from which rank on, what to add to the rank for the sequence's number, and the offset there."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            out.setdefault(length, []).append((rank, base - rank, offset))
            used[length] = rank + count
            offset += length
        base += count
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in out.items()}


def _place(batches: Iterator[pa.RecordBatch], table: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = (np.asarray(batch.column(c), np.int64) for c in ("length", "rank"))
        seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for n in np.unique(length).tolist():
            mine = np.flatnonzero(length == n)
            since, shift, offset = table[n]
            k = np.searchsorted(since, rank[mine], side="right") - 1
            seq[mine], off[mine] = rank[mine] + shift[k], offset[k]
        kept = [batch.column(c) for c in ("doc_id", "start")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(length), batch.column("ids_crc32"), batch.column("doc_tokens"), pa.array(seq), pa.array(off)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, group_rows: int = 100_000, max_words: int = 1_200_000) -> DataFrame:
    """A row for each piece of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A worker keeps the ids of max_words words: fewer cost time, more cost memory.
    """
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _pieces(it, tokenizer, end_id, window, max_words), PIECES)
    # rows without an id can be equal in all that is told of them: a number keeps them from being one group
    pieces = common.materialise(pieces.withColumn("__row", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())), "pieces")
    counts = pieces.groupBy("length").count().collect()  # at most `window` rows
    histogram = {r["length"]: r["count"] for r in counts}
    table = intervals(shortest_pack_first(histogram, window))
    spread = pieces.sparkSession.createDataFrame([(k, -(-n // group_rows)) for k, n in histogram.items()], "length int, groups long")
    salted = pieces.join(F.broadcast(spread), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "__row"), "groups"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within).cast("long") - 1).join(offsets, ["length", "salt"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(lambda it: _place(it, table), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
