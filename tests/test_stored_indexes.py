import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import lexical, resolve, text_index, vector_index, vectors

WORDS = "apple apples apply bean beans bread breads café zoo ζ 12 a".split()


def docs_of(n, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 9))), rng.choice([None, "", "Bread zoo", "apple-pie"])) for i in range(n)]
    return [*rows, (n, None, None), (n + 1, "...", ""), (None, "apple bread", None)]


SCHEMA = "id long, title string, body string"
WEIGHTS = {"title": 3.0, "body": 1.0}


def by_scan(df, words):
    post = lexical.postings(df.filter("id IS NOT NULL"), "id", WEIGHTS)
    return sorted((r["key"], round(r["score"], 9)) for r in lexical.bm25(post, lexical.corpus_stats(post), words).collect())


def found(df):
    return sorted((r["key"], round(r["score"], 9)) for r in df.collect())


@pytest.fixture
def index(spark, tmp_path):
    return text_index.TextIndex(spark, f"file://{tmp_path}/index", docs_a_block=16)


@pytest.mark.parametrize("words", [["appl"], ["apple", "br"], ["a"], ["ζ", "bean", "zo"], ["nothing"], ["café", "nothing"]])
def test_index_gives_what_a_scan_gives(spark, index, words):
    df = spark.createDataFrame(docs_of(300), SCHEMA).repartition(3)
    index.add(df, "id", WEIGHTS)
    assert found(index.search(words)) == by_scan(df, words)


def test_documents_are_added_replaced_and_withdrawn(spark, index):
    rows = docs_of(120)
    first, more = rows[:80], [(i, f"bread {i} apple", None) for i in range(60, 100)]
    schema = SCHEMA
    index.add(spark.createDataFrame(first, schema), "id", WEIGHTS)
    index.add(spark.createDataFrame(more, schema), "id", WEIGHTS)
    index.delete(spark.createDataFrame([(5,), (70,), (999,)], "key long"))
    index.add(spark.createDataFrame([(70, "zoo apple bread", "beans")], schema), "id", WEIGHTS)
    live = {r[0]: r for r in first} | {r[0]: r for r in more}
    live.pop(5)
    live[70] = (70, "zoo apple bread", "beans")
    df = spark.createDataFrame(list(live.values()), schema)
    for words in (["apple", "bread"], ["zoo"], ["7"]):
        assert found(index.search(words)) == by_scan(df, words)
    post = lexical.corpus_stats(lexical.postings(df, "id", WEIGHTS)).first()
    assert index.stats() == (post["docs"], pytest.approx(post["avg_length"]))


def test_a_failed_call_leaves_nothing_that_is_read(spark, index):
    df = spark.createDataFrame(docs_of(50), SCHEMA)
    index.add(df, "id", WEIGHTS)
    commit, text_index.TextIndex._commit = text_index.TextIndex._commit, lambda *a: 1 / 0
    try:
        with pytest.raises(ZeroDivisionError):
            index.add(df.withColumn("title", F.lit("zoo")), "id", WEIGHTS)
    finally:
        text_index.TextIndex._commit = commit
    assert found(index.search(["zoo"])) == by_scan(df, ["zoo"])


def scanned(df):
    """The rows that the scans of a DataFrame's files gave out when it ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString()
    leaves = plan.finalPhysicalPlan().collectLeaves() if "AdaptiveSparkPlan" in text else plan.collectLeaves()
    out, todo = 0, [leaves.apply(i) for i in range(leaves.size())]
    while todo:
        leaf = todo.pop()
        if leaf.nodeName().endswith("QueryStage"):
            inner = leaf.plan().collectLeaves()
            todo += [inner.apply(i) for i in range(inner.size())]
        elif leaf.nodeName().startswith("Scan"):
            out += leaf.metrics().apply("numOutputRows").value()
    return out


def test_a_search_reads_its_terms_only(spark, tmp_path):
    """Files are small, so that statistics of their parts can leave out most terms; a query's rows come from one range of terms."""
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(20_000):05}" for _ in range(30)), None) for i in range(2000)]
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        index = text_index.TextIndex(spark, f"file://{tmp_path}/i", docs_a_block=512)
        index.add(spark.createDataFrame(rows, SCHEMA).repartition(4), "id", WEIGHTS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    everything = spark.read.parquet(f"{tmp_path}/i/postings").count()
    own = index.rows(["w0123"])
    assert "PushedFilters" in own._jdf.queryExecution().executedPlan().toString() and "GreaterThanOrEqual(term,w0123)" in own._jdf.queryExecution().executedPlan().toString()
    assert 0 < own.count() <= scanned(own) < everything / 4


def test_top_reads_few_blocks(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(["common"] * rng.choice([1, 1, 1, 9]) + ["rare"] * (i % 37 == 0) + [f"x{rng.randrange(50)}" for _ in range(rng.randrange(2, 40))]), None) for i in range(3000)]
    index = text_index.TextIndex(spark, f"file://{tmp_path}/i", docs_a_block=16)
    index.add(spark.createDataFrame(rows, SCHEMA).repartition(4), "id", {"title": 1.0})
    for words in (["rare"], ["common", "rare"], ["common"]):
        want = [tuple(r) for r in index.search(words, whole=True).orderBy("score", "key").limit(5).collect()]
        assert [tuple(r) for r in index.top(words, 5, whole=True).collect()] == want
    blocks = spark.read.parquet(f"{tmp_path}/i/postings").select("block").distinct().count()
    index.top(["rare"], 3, whole=True)
    assert 0 < index.blocks_read < blocks / 3


def test_prefix_ranges():
    for p in ("a", "ab\U0010ffff", "z퟿", "é"):
        end = text_index.after_prefix(p)
        assert p < end and p + "\U0010ffff" * 3 < end and not end.startswith(p)
    assert text_index.after_prefix("\U0010ffff") is None


def test_release_search_through_indexes(spark, tmp_path):
    foods = spark.createDataFrame([(1, "Apple, raw", "apple raw", "Fruit", 5, True), (2, "Apple, NFS", "apple nfs", "Fruit", 1, True), (3, "Bread", "bread", "Grain", 1, True), (4, "Apple pie", "apple pie", "x", 9, False)], "food_id long, display_name string, normalized_description string, category_name string, search_priority int, is_searchable boolean")
    terms = spark.createDataFrame([(1, "pomme", "common_name"), (3, "red loaf", "additional_description"), (4, "apple", "common_name")], "food_id long, term string, term_type string")
    indexes = resolve.release_indexes(foods, terms, f"file://{tmp_path}/r")
    for q in ("apple", "red apple", "pomme", 'apple"* OR shell', "loaf red", "nothing"):
        a, b = resolve.search_release(foods, terms, q), resolve.search_release(foods, terms, q, indexes=indexes)
        assert {k: v for k, v in a.items() if k != "items"} == {k: v for k, v in b.items() if k != "items"}
        assert [tuple(r) for r in a["items"].collect()] == [tuple(r) for r in b["items"].collect()]


def exact(rows, queries, k):
    m = np.array([r[1] for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = []
    for q, v in queries:
        s = np.round(m @ (np.array(v, float) / np.linalg.norm(v)), 5)
        best = sorted((-x, i) for (i, _), x in zip(rows, s) if i != q)[:k]
        out += [(q, i, -x, p + 1) for p, (x, i) in enumerate(best)]
    return sorted(out)


def table(spark, n=600, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(8, dim))
    rows = [(i, [float(np.float32(x)) for x in centre[i % 8] * 2 + rng.normal(size=dim)]) for i in range(n)]
    odd = [(n, None), (n + 1, [0.0] * dim), (n + 2, [1.0] * (dim - 1)), (n + 3, [None] + [1.0] * (dim - 1))]
    return rows, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(4)


@pytest.mark.parametrize("scan_bytes", [64 << 20, 800])
def test_nearest_in_few_scans(spark, scan_bytes, monkeypatch):
    monkeypatch.setattr(vectors, "STEP", 7)
    rows, df = table(spark, 300)
    df = df.filter("vec_id < 300")
    got = vectors.nearest(df, df.filter("vec_id % 20 = 0"), 5, scan_bytes)
    assert sorted(tuple(r) for r in got.collect()) == exact(rows, [r for r in rows if r[0] % 20 == 0], 5)
    zero = spark.createDataFrame([(1000, [0.0] * 12)], "vec_id long, embedding array<float>")
    assert vectors.nearest(df.unionByName(zero), zero, 5).count() == 0 and vectors.nearest(df, df.limit(0), 5).count() == 0


def test_vector_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 16)
    rows, df = table(spark)
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/v")
    index.fit(df, cells=20)
    index.add(df.filter("vec_id % 3 = 0 OR vec_id >= 600"))
    index.add(df.filter("vec_id % 3 <> 0 AND vec_id < 600"))
    again = vector_index.VectorIndex(spark, f"file://{tmp_path}/v")
    queries = df.filter("vec_id % 20 = 0")
    want = exact(rows, [r for r in rows if r[0] % 20 == 0], 10)
    assert sorted(tuple(r) for r in again.search(queries, 10, 20).collect()) == want  # all cells: exact
    probes = again.probes_for(df.filter("vec_id < 600"), queries, 10, 0.95)
    r = vector_index.recall(again.search(queries, 10, probes), vectors.nearest(df.filter("vec_id < 600"), queries.filter("vec_id < 600"), 10)).first()
    assert r["queries"] == 30 and r["recall"] >= 0.9 and probes < 20
    blocks = spark.read.parquet(f"{tmp_path}/v/blocks")
    assert blocks.agg(F.sum(F.size("ids"))).first()[0] == 600 and blocks.agg(F.max(F.size("ids"))).first()[0] < 60


def test_vector_index_of_copies_and_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([(i, [1.0, 2.0, 0.5]) for i in range(50)], "vec_id long, embedding array<float>")
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/a")
    index.fit(df)
    index.add(df)
    got = sorted(tuple(r) for r in index.search(df.filter("vec_id = 7"), 3, 1).collect())
    assert got == [(7, 0, 1.0, 1), (7, 1, 1.0, 2), (7, 2, 1.0, 3)]
    none = vector_index.VectorIndex(spark, f"file://{tmp_path}/b")
    none.fit(df.limit(0))
    with pytest.raises(ValueError):
        none.add(df)
