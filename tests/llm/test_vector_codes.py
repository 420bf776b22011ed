import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    """The contract's rule, one vector and one entry after the other."""
    fine = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not fine:
        return []
    fine = [r for r in fine if len(r[1]) == len(fine[0][1])]
    dim = -(-len(fine[0][1]) // parts) * parts
    w = dim // parts
    ints = [[math.floor(4096 * float(np.float32(x))) for x in r[1]] + [0] * (dim - len(r[1])) for r in fine]
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in ints]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p], c)), e) for e, c in enumerate(books[p])) for p in range(parts)] for v in cut]

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, g in zip(cut, got) if g[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    got = assign()
    errors = [sum(d for d, _ in g) for g in got]
    by_label = {}
    for r, e in zip(fine, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted([(r[0], "".join(f"{e:02x}" for _, e in g), err, by_label[r[2]], sha) for r, g, err in zip(fine, got, errors)], key=str)


def of(spark, rows, **named):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    books, length = vector_codes.fit(table, **named)
    got = vector_codes.with_label_errors(vector_codes.encode(table, books, length))
    return sorted([(r["vec_id"], r["code"], r["error"], r["label_error"], books.sha256()) for r in got.collect()], key=str)


def vectors(n, dim, seed=3, coarse=False):
    rng = random.Random(seed)
    pick = (lambda: rng.choice([-0.5, 0.0, 0.25, 0.5])) if coarse else (lambda: rng.gauss(0, 0.3))
    return [(i, [float(np.float32(pick())) for _ in range(dim)], rng.choice([None, 0, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("dim,coarse", [(16, False), (24, True), (64, False), (13, False)])
def test_codes_equal_plain_rule(spark, dim, coarse):
    rows = vectors(150, dim, coarse=coarse)
    rows += [(500, None, 1), (501, [], 1), (502, [None, *rows[0][1][1:]], 1), (503, [float("nan"), *rows[0][1][1:]], 1), (504, [float("-inf"), *rows[0][1][1:]], 1), (505, rows[0][1] + [0.5], 1)]
    rows += [rows[7], rows[7], (None, rows[9][1], None), (None, rows[11][1], None), (7, rows[20][1], 2)]
    assert of(spark, rows) == plain(rows)


def test_few_vectors_and_none(spark):
    rows = vectors(5, 16)
    assert of(spark, rows) == plain(rows)
    assert vector_codes.fit(spark.createDataFrame([], SCHEMA)) == (None, 0)
    assert vector_codes.fit(spark.createDataFrame([(1, None, 0), (2, [], 0)], SCHEMA)) == (None, 0)


def test_search_equals_full_distances():
    rng = np.random.default_rng(5)
    for _ in range(30):
        x, book = rng.integers(-3, 4, (5, 200)), rng.integers(-3, 4, (16, 5))
        entry, bound = vector_codes.nearest(x, book, vector_codes.descending_variance(book))
        full = ((x.T[:, None, :] - book[None]) ** 2).sum(2)
        assert (entry == full.argmin(1)).all() and (bound == full.min(1)).all()


def test_more_labels_than_are_broadcast_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "MOST_LABELS", 1)
    rows = vectors(60, 16)
    table = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in ("code", "error", "at", "value", "__label")})
    books, length = vector_codes.fit(table)
    got = vector_codes.with_label_errors(vector_codes.encode(table, books, length)).collect()
    assert sorted([(r["vec_id"], r["code"], r["error"], r["label_error"], books.sha256()) for r in got], key=str) == plain(rows)
    assert all(len(books.decode(r["code"])) == 16 for r in got)
    assert [sum((a - b) ** 2 for a, b in zip(books.decode(r["code"]), [math.floor(4096 * v) for v in rows[r["vec_id"]][1]])) for r in got] == [r["error"] for r in got]
