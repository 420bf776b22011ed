import numpy as np
import pytest

from tessella.llm import jaccard_join
from tessella.llm.shingles import parity, parity_distance, shingle_sets


def brute(rows, k, num, den):
    sets = []
    for doc_id, text, *_ in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r[0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((r[0] is not None, r[0] or 0, len(s), -1 if least[root(i)] is None else least[root(i)]) for i, (r, s) in enumerate(zip(rows, sets))))


def got(df):
    return sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in df.collect()))


@pytest.mark.parametrize("small,similarity", [(8, (90, 100)), (2, (80, 100)), (3, (90, 100))])
def test_components_equal_brute_force(docs, rows, monkeypatch, small, similarity):
    monkeypatch.setattr(jaccard_join, "LEAST_FREQUENT", 3)
    assert got(jaccard_join.near_duplicates(docs, 3, similarity, small)) == brute(rows, 3, *similarity)


def test_one_of_each_group_stays(wide, rows, empty):
    kept = jaccard_join.keep_one(wide, 5, (80, 100))
    assert kept.columns == wide.columns
    want = brute(rows, 5, 80, 100)
    roots = {c for _, _, n, c in want if n}
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.filter("text rlike '[^ \\\\s]'").collect()) == sorted(roots)
    assert {300, 301, 302} <= {r["doc_id"] for r in kept.collect()}
    assert jaccard_join.keep_one(empty).count() == 0 and jaccard_join.near_duplicates(empty).count() == 0


def test_parity_never_overstates():
    rng = np.random.default_rng(3)
    for n, m, both in ((5, 9, 3), (300, 280, 270), (64, 65, 0), (1000, 90, 50)):
        x = np.unique(rng.integers(0, 1 << 64, n + m, np.uint64))
        a, b = x[:n], x[n - both : n - both + m]
        assert parity_distance(parity(a), parity(b)) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_words_are_cut_at_ascii_blanks_only():
    a, b, c = shingle_sets([b"A\x0bb c", "a b\xa0c".encode(), b""], 3)
    assert len(a) == 1 and len(b) == 1 and len(c) == 0 and a[0] != b[0]
    assert np.array_equal(*shingle_sets([b"ONE two", b"one  TWO"], 3))
