"""Connected components of links on DataFrames, and links between texts of one group that have a long passage in common."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources import shared


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of links(u, v) that isn't the least node of its component; nodes are of any type with an order.

    Large and small stars by turns, each round a written table: minima are combined before they are shuffled and joins are
    Spark's own, so a node with very many links is no group of one task. It ends when a round changes nothing.
    """
    spark, path = links.sparkSession, shared.shared_dir(links.sparkSession, "components")

    def put(i: int, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{path}/{i}")
        return spark.read.schema(df.schema).parquet(f"{path}/{i}")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = put(0, links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    was = mark(e)
    for i in range(1, most_rounds + 1):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = put(i, small.filter("u <> v").distinct())
        if (now := mark(e)) == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


#: Two primes and, for each, two bases: a run's hash is a pair of polynomials, modulo either prime.
_PRIMES = (2_147_483_647, 2_147_483_629)
_BASES = ((1_103_515_245, 1_566_083_941), (1_812_433_253 % _PRIMES[0], 1_664_525_013 % _PRIMES[1]))


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), prime) % prime])
    return out[:n]


class RunHashes:
    """Hashes of all runs of a length in a text, 62 bits, as differences of running sums."""

    def __init__(self, text: str, bases: tuple[int, int] = _BASES[0]):
        x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        self._parts = []
        for prime, base in zip(_PRIMES, bases):
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(x * _powers(base, len(x), prime) % prime)])
            self._parts.append((prime, sums, _powers(pow(base, -1, prime), len(x) + 1, prime)))

    def of(self, length: int) -> np.ndarray:
        one, two = ((sums[length:] - sums[: len(sums) - length]) % prime * back[: len(sums) - length] % prime for prime, sums, back in self._parts)
        return one << 31 | two


def common_length(a: str, b: str) -> int:
    """The length of the longest common substring, by bisection: texts that have a run of some length in common have one of each lesser length.

    Runs are compared by hash, and places with equal ones by their characters; n log n steps for n characters.
    """
    if not a or not b:
        return 0
    x, y = RunHashes(a), RunHashes(b)

    def has(length: int) -> bool:
        p, q = x.of(length), y.of(length)
        _, i, j = np.intersect1d(p, q, return_indices=True)
        return any(a[s : s + length] == b[t : t + length] for s, t in zip(i.tolist(), j.tolist()))

    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if has(mid):
            low = mid
        else:
            high = mid - 1
    return low


#: Two texts are of one passage if one holds the other, or with 20 characters at least by so many, or so much of the shorter, in common.
ALWAYS, SHARE, SHORT = 40, (3, 5), 20


#: Characters up to which the texts of a group are compared in one task, by their order in a partition; runs of larger groups are dealt to all tasks.
TOGETHER = 1 << 20


def _needed(n: int) -> int:
    """How long a run a text of n characters must have in common with one at least as long."""
    return n if n < SHORT else min(ALWAYS, -(-n * SHARE[0] // SHARE[1]))


def _same(value: object) -> object:
    """A group's value so that equal ones compare as in Spark: not-a-number equals itself."""
    if isinstance(value, dict):
        return tuple(map(_same, value.values()))
    return "nan" if isinstance(value, float) and value != value else value


def _own(n: int) -> int:
    """The kind of run that a text of n characters needs: -n, the whole of it, if it is short."""
    return -n if n < SHORT else _needed(n)


def _has(n: int, kind: int) -> bool:
    """Whether a text of n characters gives runs of a kind: whole short texts can stand in any text, other runs matter to texts that need no shorter ones."""
    return n >= -kind if kind < 0 else n >= SHORT and _needed(n) >= kind


def text_roots(texts: list[str]) -> list[int]:
    """For each text of a group the place of the first text of its component; the links are those of passage_links."""
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    hashes = [[RunHashes(t, b) for b in _BASES] for t in texts] if len(texts) > 1 else []
    for kind in {_own(len(t)) for t in texts}:
        of = [i for i, t in enumerate(texts) if _has(len(t), kind)]
        if len(of) < 2:
            continue
        h1, h2 = (np.concatenate([hashes[i][b].of(abs(kind)) for i in of]) for b in (0, 1))
        who = np.repeat(np.array(of), [len(texts[i]) - abs(kind) + 1 for i in of])
        order = np.argsort(h1)
        twice = h1[order][1:] == h1[order][:-1]
        at = order[np.append(twice, False) | np.append(False, twice)]  # most runs stand in one place
        at = at[np.lexsort((who[at], h2[at], h1[at]))]
        begin = np.flatnonzero(np.append(True, (h1[at][1:] != h1[at][:-1]) | (h2[at][1:] != h2[at][:-1]))) if len(at) else at
        own = np.array([_own(len(t)) == kind for t in texts])
        centre = np.minimum.reduceat(np.where(own[who[at]], who[at], len(texts)), begin) if len(at) else at
        centre = np.repeat(centre, np.diff(np.append(begin, len(at))))
        links = np.unique(np.stack([who[at], centre]), axis=1)
        for i, j in links[:, (links[1] < len(texts)) & (links[0] != links[1])].T.tolist():
            i, j = find(i), find(j)
            root[max(i, j)] = min(i, j)
    return [find(i) for i in range(len(texts))]


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in order of g, whole groups in a partition -> u, v: each node that isn't the first of its component, and that one."""
    held: list[pa.RecordBatch] = []
    group: list[str] = []
    last = None

    def links() -> pa.RecordBatch:
        nodes = pa.concat_arrays([b.column("node") for b in held])
        pairs = [(i, r) for i, r in enumerate(text_roots(group)) if i != r]
        u, v = (nodes.take(pa.array([p[k] for p in pairs], pa.int64())) for k in (0, 1))
        return pa.RecordBatch.from_arrays([u, v], names=["u", "v"])

    for batch in batches:
        keys, start = [_same(g) for g in batch.column("g").to_pylist()], 0
        texts = batch.column("text").to_pylist()
        for i in range(len(keys) + 1):
            if i < len(keys) and keys[i] == (keys[i - 1] if i else last):
                continue
            if i > start or i == len(keys):  # the rows from start to i go with what is held
                held.append(batch.slice(start, i - start))
                group += texts[start:i]
            if i < len(keys):
                if len(group) > 1:
                    yield links()
                held, group, start = [], [], i
        last = keys[-1] if keys else last
    if len(group) > 1:
        yield links()


def passage_links(texts: DataFrame, group: str, node: str, text: str) -> DataFrame:
    """u, v: links between nodes of one group whose components are those of all pairs of texts of one passage.

    A text needs a run of some length in common with a longer one (all of it if it is short), and this length depends on
    itself alone. So runs of the lengths that a group's texts need are the keys: all texts that have such a run are linked with one
    that needs no longer run, which proves each link without comparing texts, and a passage that all texts
    share gives one link a text. Lengths are at most ALWAYS, so a text has a bounded number of runs for each character.

    Runs are many times their text. So groups of up to TOGETHER characters are sorted together and compared within a task, which gives one
    link a text and moves nothing but the texts; only runs of larger groups are dealt out by key.
    """
    spark = texts.sparkSession
    d = texts.select(F.col(group).alias("g"), F.col(node).alias("node"), F.col(text).alias("text")).filter(F.length("text") > 0)
    sizes = d.groupBy("g").agg(F.sum(F.length("text")).alias("__size"))
    sized, node_type = d.join(sizes, "g"), d.schema["node"].dataType.simpleString()
    shared.arrow_batches(spark)
    small = sized.filter(F.col("__size") <= TOGETHER).select("g", "node", "text").repartition("g").sortWithinPartitions("g")
    found = small.mapInArrow(_together, f"u {node_type}, v {node_type}")
    d = sized.filter(F.col("__size") > TOGETHER).select("g", "node", "text")
    n = F.length("text")
    needs = F.when(n < SHORT, n).otherwise(F.least(F.lit(ALWAYS), F.ceil(n * SHARE[0] / SHARE[1]))).cast("int")
    # -length for whole short texts, which any text can hold; length for runs, which texts of SHORT characters at least share
    kinds = d.select("g", F.when(n < SHORT, -needs).otherwise(needs).alias("kind")).groupBy("g").agg(F.collect_set("kind").alias("kinds"))  # at most SHORT + ALWAYS a group
    types = {f.name: f.dataType.simpleString() for f in d.schema}

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kind, own, h1, h2, starts = [], [], [], [], [], [0]
            for i, (t, kinds) in enumerate(zip(batch.column("text").to_pylist(), batch.column("kinds").to_pylist())):
                mine = _own(len(t))
                hashes = [RunHashes(t, b) for b in _BASES]
                for k in kinds:
                    if not _has(len(t), k):
                        continue
                    both = np.unique(np.stack([h.of(abs(k)) for h in hashes]), axis=1)
                    at.append(i)
                    kind.append(k)
                    own.append(k == mine)
                    h1.append(both[0])
                    h2.append(both[1])
                    starts.append(starts[-1] + both.shape[1])
            if not at:
                continue
            listed = lambda h: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.concatenate(h)))  # noqa: B023, E731
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("g").take(take), batch.column("node").take(take), pa.array(kind, pa.int32()), pa.array(own), listed(h1), listed(h2)], names=["g", "node", "kind", "own", "h1", "h2"])

    r = d.join(kinds, "g").mapInArrow(runs, f"g {types['g']}, node {types['node']}, kind int, own boolean, h1 array<bigint>, h2 array<bigint>")
    r = r.select("g", "node", "kind", "own", F.explode(F.arrays_zip("h1", "h2")).alias("h")).select("g", "node", "kind", "own", "h.h1", "h.h2")
    path = shared.shared_dir(spark, "runs")
    r.write.parquet(path)
    r = spark.read.schema(r.schema).parquet(path)
    centres = r.groupBy("g", "kind", "h1", "h2").agg(F.min(F.when(F.col("own"), F.col("node"))).alias("centre"), F.count("*").alias("n")).filter("n > 1 AND centre IS NOT NULL").drop("n")
    return found.unionByName(r.join(centres, ["g", "kind", "h1", "h2"]).filter("node <> centre").select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct())
