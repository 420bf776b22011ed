import random

import numpy as np
import pytest

from tessella.llm import jaccard_join

from .test_jaccard import brute, got

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("similarity", [(80, 100), (90, 100), (50, 100), (95, 100)])
def test_linked_sets_share_a_key(similarity):
    """Sets and their differences from a reference, with any mixture of rare and frequent tokens."""
    num, den = similarity
    rng = np.random.default_rng(num)
    universe = np.unique(rng.integers(0, 1 << 64, 400, np.uint64))
    seen = 0
    for _ in range(3000):
        ranks = np.zeros(1 << jaccard_join.SKETCH_BITS, np.uint8)
        ranks[jaccard_join._counter(universe)] = rng.integers(0, 3, len(universe)) * (rng.random() < 0.8)
        base = rng.permutation(universe)[: rng.integers(2, 120)]
        other = rng.permutation(np.setdiff1d(universe, base))
        edited = lambda m: np.sort(np.concatenate((base[rng.permutation(len(base))[: len(base) - m]], other[rng.permutation(40)[:m]])))  # noqa: E731, B023
        x, y = edited(rng.integers(0, 1 + len(base) // 8)), edited(rng.integers(0, 1 + len(base) // 8))
        if not len(x) or not len(y) or np.array_equal(x, y):
            continue
        both = len(np.intersect1d(x, y))
        if den * both < num * (len(x) + len(y) - both):
            continue
        seen += 1
        keys = [set(jaccard_join.prefix_keys(s, ranks, jaccard_join._needed(len(s), num, den), jaccard_join.most_apart(len(s), num, den))[0].tolist()) for s in (x, y)]
        assert keys[0] & keys[1]
        for k in (2, 3, 5, 8):  # or neighbouring tokens
            keys = [set(jaccard_join.run_keys(s, ranks, jaccard_join._needed(len(s), num, den), jaccard_join.most_apart(len(s), num, den), k).tolist()) for s in (x, y)]
            assert keys[0] & keys[1]
        # differences from a reference: linked with it, or linked through it, or they share a key that leaves the link possible
        ref = edited(rng.integers(0, 3))
        unit, found = den + num, []
        for s in (x, y):
            d = np.setxor1d(s, ref)
            e, e_ref = unit * len(d) - (den - num) * len(s), -(den - num) * len(ref)
            far = e + e_ref > 0
            least = max(1, len(d) - jaccard_join.most_apart(len(s), num, den), -((-e - e_ref if far else e_ref - e - 1) // (2 * unit)))
            keys, costs, _ = jaccard_join.prefix_keys(d, ranks, least, jaccard_join.most_apart(len(s), num, den), np.isin(d, ref))
            found.append((far, e, dict(zip(keys.tolist(), (2 * unit * (len(d) - costs) - e).tolist()))))
        (far1, e1, f1), (far2, e2, f2) = found
        if far1 or far2:
            assert any(e1 <= f2[k] and e2 <= f1[k] for k in f1.keys() & f2.keys())
    assert seen > 50


def template_rows(seed, bases, copies, edits, vocabulary):
    """Groups of near copies whose members are mostly not linked with each other, common lines, and chains of small edits."""
    rng = random.Random(seed)
    rows = []
    for b in range(bases):
        words = [f"{rng.choice('abc')}{rng.randrange(3000)}" for _ in range(rng.randint(60, 140))]
        for _ in range(copies):
            w = list(words)
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(len(w))
                if rng.random() < 0.7:
                    w[at] = f"n{rng.randrange(vocabulary)}"
                elif rng.random() < 0.5:
                    del w[at]
                else:
                    w.insert(at, f"n{rng.randrange(vocabulary)}")
            rows.append((len(rows), " ".join(w)))
    chain = [f"c{i}" for i in range(100)]
    for i in range(40):
        chain[(7 * i) % 100] = f"d{i}"
        rows.append((len(rows), " ".join(chain)))
    line = " ".join(f"l{i}" for i in range(12))
    rows += [(len(rows) + i, f"{line} own{i} words{i} here{i}") for i in range(60)]
    return rows


@pytest.mark.parametrize("small,similarity,k,vocabulary", [(2, (90, 100), 3, 5), (8, (80, 100), 5, 200), (3, (80, 100), 3, 3), (4, (50, 100), 3, 4)])
def test_groups_of_near_copies_equal_brute_force(spark, monkeypatch, small, similarity, k, vocabulary):
    monkeypatch.setattr(jaccard_join, "LEAST_FREQUENT", 4)
    rows = template_rows(small, 4, 60, 8, vocabulary)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(jaccard_join.near_duplicates(docs, k, similarity, small)) == brute(rows, k, *similarity)


def test_long_sets_are_linked(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAST_FREQUENT", 3)
    shared = [f"w{i}" for i in range(2503)]
    rows = [(0, " ".join(shared[:2502])), (1, " ".join(shared))]  # 2,500 and 2,501 shingles
    rows += [(2 + j, " ".join([*shared, *(f"d{j}x{i}" for i in range(1000))])) for j in range(6)]  # make them frequent
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert got(jaccard_join.near_duplicates(docs, 3, (80, 100))) == brute(rows, 3, 80, 100)
