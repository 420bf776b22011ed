"""Connected components of links between binary keys, by alternating large and small stars on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _contract(batches: Iterator[pa.RecordBatch], flush: int = 400_000) -> Iterator[pa.RecordBatch]:
    """The links of a task as (node, least node known) stars: at most one link for each node and flush."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def out() -> pa.RecordBatch:
        rows = [(x, root(x)) for x in list(parent)]
        rows = [r for r in rows if r[0] != r[1]]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = root(a), root(b)
            if a < b:
                parent[b] = a
            elif b < a:
                parent[a] = b
        if len(parent) > flush:
            yield out()
            parent = {}
    if parent:
        yield out()


def _mark(e: DataFrame) -> tuple[int, int]:
    r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]


def components(links: DataFrame, scratch: common.Scratch, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of links(u, v) that isn't its component's least node.

    Each round first contracts links inside tasks, then takes the two star steps; it ends when a round changes nothing.
    Minima are combined before they are shuffled, and joins are Spark's own, so a node with very many links is no
    large group of one task.
    """
    e = scratch.put("stars_0", links.select("u", "v").mapInArrow(_contract, "u binary, v binary").distinct())
    mark = _mark(e)
    for i in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # now u > v on every row: each node's least neighbour below it takes its others
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = scratch.put(f"stars_{i + 1}", small.filter("u <> v").mapInArrow(_contract, "u binary, v binary").distinct())
        scratch.drop(f"stars_{i}")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
