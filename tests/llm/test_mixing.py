import heapq
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing


def highest_quotients(votes, seats):
    """Sainte-Lague, one seat after the other; of equal quotients the first row's."""
    heap = [(-v, i, 0) for i, v in enumerate(votes) if v]
    heapq.heapify(heap)
    out = [0] * len(votes)
    for _ in range(seats if heap else 0):
        _, i, k = heapq.heappop(heap)
        out[i] += 1
        heapq.heappush(heap, (-votes[i] / (2 * k + 3), i, k + 1))
    return out


def test_apportionment_equals_one_seat_after_the_other(spark):
    rng = random.Random(6)
    cases = [([100] * 400 + [20_000], 3650), ([100] * 400 + [20_000], 3800), ([104] * 400 + [20_000], 4000), ([5] * 9, 4), ([0, 0], 3), ([7, 0, 1], 0), ([1], 50), ([3, 3, 0, 90_000], 7000)]
    cases += [([rng.choice((0, rng.randint(1, 9), rng.randint(1, 3000))) for _ in range(rng.randint(1, 40))], rng.randint(0, 500)) for _ in range(40)]
    rows = [(g, i, v, seats) for g, (votes, seats) in enumerate(cases) for i, v in enumerate(votes)]
    d = spark.createDataFrame(rows, "g int, i int, v long, n long")
    got = mixing.apportion(d, "v", F.col("n"), ["g"], [F.col("i")], "s").collect()
    have = {(r["g"], r["i"]): r["s"] for r in got}
    assert have == {(g, i): s for g, (votes, seats) in enumerate(cases) for i, s in enumerate(highest_quotients(votes, seats))}


def test_many_small_sources_take_nothing_from_a_large_one(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, " ".join(f"a{i}x{j}" for j in range(100)), f"s{i:03}") for i in range(300)] + [(300, " ".join(f"b{j}" for j in range(30_000)), "t")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = Counter()
    for r in mixing.mix(d, weights=(1,)).collect():
        taken[r["source"]] += r["taken"]
        assert r["target"] == (30_000 if r["source"] == "t" else 200)
    assert taken["t"] == 30_000 and set(taken[f"s{i:03}"] for i in range(300)) == {200}
    con = duckdb.connect()
    con.register("documents", d.toArrow())
    want = con.sql(f"SELECT doc_id, taken FROM ({mixing.ORACLE_SQL}) q").fetchall()
    assert sorted((r["doc_id"], r["taken"]) for r in mixing.mix(d).collect()) == sorted(want)


def test_tiny_sources_keep_their_targets(spark):
    rows = [(i, f"a{i} b c", f"s{i:04}") for i in range(1500)] + [(5000, " ".join(f"w{j}" for j in range(40_000)), "t"), (5001, None, "t"), (5001, None, "t"), (None, "a b", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(taken[k] - v) <= 1 for k, v in target.items())
    assert sorted((r["doc_id"] or 0, r["taken"]) for r in mixing.mix(d.repartition(7)).collect()) == sorted((r["doc_id"] or 0, r["taken"]) for r in got)


def test_mixed_rows_hold_the_words_taken(spark, wide):
    want = Counter()
    for r in mixing.mix(wide).collect():
        want[r["doc_id"]] += r["taken"]
    have = Counter()
    rows = mixing.apply_mix(wide)
    assert rows.columns == wide.columns
    for r in rows.collect():
        have[r["doc_id"]] += len((r["text"] or "").encode().split())
        assert r["n_chars"] == len(r["text"])
    assert {k: v for k, v in want.items() if v} == dict(have)
