"""Cases that were wrong, or too slow in their form, before the third round's findings."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import autocomplete, evidence, layout, mentions, vectors, wording
from tessella.plans import catalog
from tessella.plans.registry import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_read_many_at_a_time(spark, sf_dir):
    """no group of its own for each page, and words of documents are not shuffled one by one."""
    for name in ("columns_read", "layout_regions"):
        p = plan(QUERIES[name](spark, sf_dir))
        assert "FlatMapGroups" not in p and "Join" not in p, name


def test_pages_with_nulls_and_many_words(spark):
    d = spark.createDataFrame([(1, 0, 5.0, 700.0, 4.0, 10.0, "b"), (1, 1, 0.0, 700.0, 4.0, None, "a"), (None, 2, 1.0, 1.0, None, None, "n"), (2, 3, 1.0, 1.0, 1.0, 1.0, None), (3, 4, 1.0, 1.0, 1.0, 1.0, " ")], "page int, n int, x double, y double, width double, height double, text string")
    got = sorted((tuple(r) for r in layout.page_fragments(d, "page").collect()), key=str)
    assert got == [(1, 0, 0, 0, "a b", 0.0, 9.0), (None, 0, 0, 0, "n", 1.0, 1.0)]
    rows = [(p, float(10 * i), float(10 * i + 8), 0.0, str(i)) for p in range(300) for i in range(3)]
    many = evidence.layout_rows(spark.createDataFrame(rows, "page int, x double, right double, y double, word string"), "page").collect()
    assert sorted(tuple(r) for r in many) == [(p, 0, 0, "0 1 2") for p in range(300)]


def test_keywords_beside_letters_of_other_scripts(spark):
    """the SQL's words are of ASCII letters, and a text that is null has no keyword."""
    d = spark.createDataFrame([("\u00e9las b",), ("las\u00df",), ("xlas las_ las1",), (None,)], "text string")
    got = [r[0] for r in d.select(wording.preparation_state(d["text"], {"las": "third"})).collect()]
    assert got == ["third", "third", "unspecified", "unspecified"]


def test_names_that_overlap_themselves(spark):
    """a name is looked for behind the place where it was found, as SQL's split does."""
    docs = spark.createDataFrame([(1, "the the the"), (2, "bathe the the the the"), (3, "The THE the the")], "doc long, text string")
    got = sorted((r["doc"], r["start"]) for r in mentions.mentions(docs, spark.createDataFrame([(1, "the the")], "id long, name string"), "doc").collect())
    assert got == [(1, 0), (2, 10), (3, 0), (3, 8)]


def test_aliases_in_lower_case(spark):
    """the query's SQL lowers letters and does not fold them."""
    lexicon = spark.createDataFrame([(1, "Stra\u00dfe  x"), (2, "STRASSE x")], "id long, name string")
    docs = spark.createDataFrame([(1, "A stra\u00dfe x"), (2, "strasse\tx\u00a0y strasse x")], "doc long, text string")
    got = sorted(tuple(r) for r in mentions.best_aliases(docs, lexicon, "doc", fold=False).collect())
    assert got == [(1, 1, "stra\u00dfe x", 1), (2, 2, "strasse x", 1)]


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Documents whose texts are odd."""
    path = str(tmp_path_factory.mktemp("odd"))
    texts = ["\u00e9las b", None, "", "he der", "the the the"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_states_count_null_texts(spark, odd_tables):
    got = {(r["state"], r["n"]) for r in catalog.queries()["keyword_states"](spark, odd_tables).collect()}
    assert got == {("third", 1), ("unspecified", 3), ("first", 1)}


def test_nearest_in_bounded_memory():
    """not all products of a batch are held, and many copies give the lowest ids."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(4000, 8))
    v[1::3] = v[1]
    ids = np.arange(4000)[::-1].copy()
    table = pa.record_batch([pa.array(ids), pa.array(v.tolist(), pa.list_(pa.float32()))], names=["vec_id", "embedding"])
    q = vectors._units(table.column("embedding"), 8)
    tracemalloc.start()
    out = pa.Table.from_batches(vectors._nearest(iter(table.slice(i, 1000) for i in range(0, 4000, 1000)), ids, q, 3)).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
    s = np.round(q @ q.T, 5)
    np.fill_diagonal(s, -np.inf)
    got = {}
    for a, b in zip(out["q_id"], out["vec_id"]):
        got.setdefault(a, []).append(b)
    for i in (0, 1, 4, 100, 3997):
        assert sorted(got[ids[i]]) == sorted(ids[np.lexsort((ids, -s[i]))[:3]].tolist())


def test_runs_of_a_list(spark):
    """a list is grouped inside its row."""
    d = spark.createDataFrame([(1, ["b", "a", "b"]), (2, [])], "id int, w array<string>")
    listed = F.transform("w", lambda w, i: F.struct(w.alias("word"), i.alias("p")))
    got = text.with_runs(d, listed, "runs", lambda word, run: F.struct(word.alias("word"), F.transform(run, lambda x: x["p"]).alias("at"))).select("id", "runs").orderBy("id").collect()
    assert [[(x["word"], x["at"]) for x in r["runs"]] for r in got] == [[("a", [1]), ("b", [0, 2])], []]


def test_rows_that_need_no_shuffle(spark, sf_dir):
    """no word is shuffled; F11: requests are neither grouped nor sorted."""
    p = plan(QUERIES["inverted_index_roundtrip"](spark, sf_dir))
    assert "hashpartitioning" not in p and "Generate" not in p
    p = plan(QUERIES["portion_grams"](spark, sf_dir))
    assert "o_orderkey" in p and "hashpartitioning(o_orderkey" not in p and "SortMergeJoin" not in p


def test_documents_of_one_id_stay_apart(spark, tmp_path):
    """SQL gives a row for each row of the table."""
    spark.createDataFrame([(1, "b a b"), (1, "c"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["inverted_index_roundtrip"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_words"]) for r in got) == [(1, 1), (1, 3)]


def test_weights_are_sent_to_the_documents(spark, sf_dir):
    """where few terms are left, the documents' terms are not shuffled for them."""
    p = plan(QUERIES["feedback_score"](spark, sf_dir))
    assert "hashpartitioning(term" not in p and "SortMergeJoin" not in p


def test_names_are_taken_apart_once(spark):
    """points stay a small expression, whose steps are bound."""
    typed = autocomplete.Typed.__new__(autocomplete.Typed)
    typed.plain = typed.with_parens = "aple"
    typed.words, typed.slips = ["aple"], {"aple": ["apple"]}
    d = spark.createDataFrame([("Babyfood, apple (pomme), raw",)], "name string").select(autocomplete.food_points(F.col("name"), typed).alias("p"))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("name#") < 40 and d.first()["p"] is not None
