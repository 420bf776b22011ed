"""Operator 1: token ids in grammar-compressed shards.

Documents are dealt by ranges of doc_id; each task encodes its texts and closes a shard whenever ``shard_tokens`` ids
have come together. Within a shard, Re-Pair replaces frequent neighbouring ids by nonterminals, round by round: a round
takes up to ``rules_per_round`` of the most frequent pairs (one for each hash bucket, so that one table look-up decides
each position) and replaces them from left to right without overlap. Rules and the length each nonterminal expands to
are stored with the shard, so that any range of ids is decoded without expanding the rest.

A shard is one row of a Parquet table (format ``FIELDS``); Spark's committer publishes only files of finished tasks,
and a retried task makes the same shards.

Defined results: null or empty texts have the end id alone; null doc_ids come first and equal doc_ids are ordered by
their texts; an empty table gives no rows; other columns are ignored; texts of any length are read whole (a text longer
than ``shard_tokens`` makes a shard of its own).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, tokenizer_path

FIELDS = "part int, shard long, first long, n_tokens long, doc_ids array<long>, lengths array<int>, width int, vocab int, symbols binary, rules binary, expansions binary"
_BITS = 16


def _bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(32 - _BITS)


def repair(ids: np.ndarray, vocab: int, rounds: int | None = None, rules_per_round: int = 2048, least: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rule k gives the two symbols of nonterminal vocab + k. Pairs seen under ``least`` times stay.

    Rounds go on, unless ``rounds`` bounds them, until no pair is seen so often; each shortens the sequence.
    """
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    made = 0
    for _ in count() if rounds is None else range(rounds):
        if len(seq) < 2 * least:
            break
        h = _bucket(seq[:-1], seq[1:]).astype(np.intp)  # cast once, not by each look-up
        counts = np.bincount(h, minlength=1 << _BITS)
        often = np.flatnonzero(counts >= least)
        if len(often) > 2 * rules_per_round:
            often = often[np.argsort(-counts[often], kind="stable")[: 2 * rules_per_round]]
        if not len(often):
            break
        mark = np.zeros(1 << _BITS, bool)
        mark[often] = True
        at = np.flatnonzero(mark.take(h))
        one_of, next_of = seq.take(at), seq.take(at + 1)
        pairs, n = np.unique(one_of.astype(np.uint64) << np.uint64(32) | next_of, return_counts=True)
        order = np.lexsort((pairs, -n))
        order = order[n[order] >= least]
        ph = _bucket((pairs[order] >> np.uint64(32)).astype(np.uint32), pairs[order].astype(np.uint32))
        _, one = np.unique(ph, return_index=True)  # of the pairs in a bucket the most frequent
        order = order[np.sort(one)][:rules_per_round]
        if not len(order):
            break
        left, right = (pairs[order] >> np.uint64(32)).astype(np.uint32), pairs[order].astype(np.uint32)
        table_l, table_r, table_s = (np.full(1 << _BITS, 0xFFFFFFFF, np.uint32) for _ in range(3))
        b = _bucket(left, right)
        table_l[b], table_r[b] = left, right
        table_s[b] = vocab + made + np.arange(len(order), dtype=np.uint32)
        hb = h.take(at)
        hit = (table_l.take(hb) == one_of) & (table_r.take(hb) == next_of)
        at, hb = at[hit], hb[hit]
        if len(at):  # in a run of neighbouring hits each second one would overlap
            start = np.concatenate(([True], np.diff(at) > 1))
            since = np.arange(len(at)) - np.flatnonzero(start)[np.cumsum(start) - 1]
            keep = since % 2 == 0
            at, hb = at[keep], hb[keep]
            seq[at] = table_s[hb]
            stay = np.ones(len(seq), bool)
            stay[at + 1] = False
            seq = seq[stay]
        rules.append(np.stack([left, right], 1))
        made += len(order)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expansion_lengths(rules: np.ndarray, vocab: int) -> np.ndarray:
    """Ids each nonterminal stands for; a rule only uses symbols made before it."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - vocab] if a >= vocab else 1) + (out[b - vocab] if b >= vocab else 1))
    return np.array(out, np.int64)


def _dictionary(rules: np.ndarray, lengths: np.ndarray, vocab: int) -> tuple[np.ndarray, np.ndarray]:
    """All rules' expansions, one behind the other, and where each starts: every pass puts the two symbols of its rule for each nonterminal left."""
    flat = rules.astype(np.uint32).ravel()
    while (inner := flat >= vocab).any():
        sizes = inner + 1
        pairs = rules[flat[inner] - vocab]
        at = (np.cumsum(sizes) - sizes)[inner]
        flat = np.repeat(flat, sizes)
        flat[at], flat[at + 1] = pairs[:, 0], pairs[:, 1]
    return flat, np.concatenate(([0], np.cumsum(lengths)))


class Shard:
    """Random access to one stored shard."""

    def __init__(self, row: dict):
        self.vocab = row["vocab"]
        self.symbols = np.frombuffer(row["symbols"], f"<u{row['width']}")
        self.rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
        self.lengths = np.frombuffer(row["expansions"], "<u4").astype(np.int64)
        self.flat, self.starts = _dictionary(self.rules, self.lengths, self.vocab)
        self._ends: np.ndarray | None = None

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        sizes = np.ones(len(symbols), np.int64)
        rule = symbols >= self.vocab
        sizes[rule] = self.lengths[symbols[rule].astype(np.int64) - self.vocab]
        return sizes

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        if not len(self.lengths):
            return symbols.astype("<u4")
        sizes = self._sizes(symbols)
        ends = np.cumsum(sizes)
        out = np.repeat(symbols.astype(np.uint32), sizes)
        inner = np.flatnonzero(out >= self.vocab)
        begin = np.repeat(ends - sizes, sizes)[inner]
        out[inner] = self.flat[self.starts[out[inner].astype(np.int64) - self.vocab] + inner - begin]
        return out.astype("<u4", copy=False)

    def ids(self) -> np.ndarray:
        return self.expand(self.symbols)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """ids()[start:stop], expanding only the symbols that reach into it."""
        if self._ends is None:
            self._ends = np.cumsum(self._sizes(self.symbols))
        stop = min(stop, int(self._ends[-1]) if len(self._ends) else 0)
        if start >= stop:
            return np.zeros(0, "<u4")
        i, j = np.searchsorted(self._ends, [start, stop - 1], side="right")
        begin = int(self._ends[i - 1]) if i else 0
        return self.expand(self.symbols[i : j + 1])[start - begin : stop - begin]


def _shards(batches: Iterator[pa.RecordBatch], path: str, end_id: int, shard_tokens: int, rounds: int | None) -> Iterator[pa.RecordBatch]:
    enc, schema = encoder(path), None
    end = np.array([end_id], enc.dtype).tobytes()
    part, size = TaskContext.get().partitionId(), enc.dtype.itemsize
    shard = first = held = 0
    ids: list[bytes] = []
    docs: list[int | None] = []

    def close() -> pa.RecordBatch:
        seq = np.frombuffer(b"".join(ids), enc.dtype)
        symbols, rules = repair(seq, enc.vocab, rounds)
        width = 2 if enc.vocab + len(rules) <= 0xFFFF else 4
        return pa.RecordBatch.from_pydict(
            {
                "part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int64()), "first": pa.array([first], pa.int64()), "n_tokens": pa.array([len(seq)], pa.int64()),
                "doc_ids": pa.array([docs], pa.list_(pa.int64())), "lengths": pa.array([[len(x) // size for x in ids]], pa.list_(pa.int32())), "width": pa.array([width], pa.int32()), "vocab": pa.array([enc.vocab], pa.int32()),
                "symbols": pa.array([symbols.astype(f"<u{width}").tobytes()], pa.binary()), "rules": pa.array([rules.astype("<u4").tobytes()], pa.binary()),
                "expansions": pa.array([expansion_lengths(rules, enc.vocab).astype("<u4").tobytes()], pa.binary()),
            }
        )

    for batch in batches:
        keys, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        for i in range(0, len(keys), 32):
            for key, raw in zip(keys[i : i + 32], enc.batch(texts.slice(i, 32).to_pylist())):
                ids.append(raw + end)
                docs.append(key)
                held += len(raw) // size + 1
                if held >= shard_tokens:
                    yield close()
                    shard, first, held, ids, docs = shard + 1, first + held, 0, [], []
    if docs:
        yield close()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_tokens: int = 1 << 20, rounds: int | None = None) -> None:
    """Write the ids of docs(doc_id, text) as grammar-compressed shards at path, in ascending order of doc_id."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt = dealt.sortWithinPartitions(order[0], F.xxhash64("text"), order[1])
    dealt.mapInArrow(lambda it: _shards(it, tokenizer, end_id, shard_tokens, rounds), FIELDS).write.parquet(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = Shard(row).ids()
            lengths = np.array(row["lengths"], np.int64)
            ends = np.cumsum(lengths)
            raw = memoryview(np.ascontiguousarray(ids).view(np.uint8))
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_pydict({"part": pa.array([row["part"]] * len(crc), pa.int32()), "doc_id": pa.array(row["doc_ids"], pa.int64()), "first": pa.array(row["first"] + ends - lengths, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the stored shards."""
    shards = spark.read.schema(FIELDS).parquet(path)
    # a row for each writing task: few, however many documents there are
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = shards.mapInArrow(_decode, "part int, doc_id long, first long, n_tokens long, ids_crc32 long")
    return rows.join(parts, "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_dir(spark) + "/tokens"
    write_tokens(common.documents(spark, sf_dir), path, tokenizer_path("byte_bpe_50k.json"))
    return read_tokens(spark, path)
