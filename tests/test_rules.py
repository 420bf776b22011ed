"""Operators that are called on tables of one's own: search, decisions, quotes, layout, records, lookups, states."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import evidence, figures, resolve, wording, workflow
from tessella.sources import xml as xml_source


@pytest.fixture(scope="module")
def release(spark):
    foods = spark.createDataFrame(
        [("1", "Apple, raw", "apple raw", "Fruits", 115, True), ("2", "Apple, NFS", "apple nfs", "Fruits", 80, True), ("3", "Pear juice", "pear juice", "Drinks", 100, True), ("4", "Apple, hidden", "apple hidden", "Fruits", 0, False)],
        "food_id string, display_name string, normalized_description string, category_name string, search_priority int, is_searchable boolean",
    )
    terms = spark.createDataFrame([("1", "pomme", "common_name"), ("1", "pomme rouge", "additional_description"), ("4", "pomme", "common_name")], "food_id string, term string, term_type string")
    return foods, terms


def test_search_is_ranked_paged_and_leaves_hidden_foods_out(release):
    first, second = (resolve.search_release(*release, "apple", limit=1, offset=k) for k in (0, 1))
    assert first["total"] == 2 and first["match_mode"] == "all_terms"
    assert [r["display_name"] for x in (first, second) for r in x["items"].collect()] == ["Apple, raw", "Apple, NFS"]


@pytest.mark.parametrize("q", ['apple"* OR shell', "red apple"])
def test_search_falls_back_to_the_words_that_match(release, q):
    got = resolve.search_release(*release, q)
    assert (got["match_mode"], got["matched_terms"], got["total"]) == ("partial_terms", ["apple"], 2)
    assert got["items"].first()["display_name"] == "Apple, raw"


def test_search_by_source_terms_and_without_words(release):
    (item,) = resolve.search_release(*release, "pomme")["items"].collect()
    assert (item["food_id"], item["matched_via"], item["matched_term"], item["matched_term_type"], item["match_tier"]) == ("1", "source_term", "pomme", "common_name", 2)
    assert resolve.search_release(*release, "zzz")["total"] == 0
    with pytest.raises(ValueError, match="searchable"):
        resolve.search_release(*release, "---")


def test_detail_lists_are_ordered(spark, release):
    n = spark.createDataFrame([("1", 2, "Protein"), ("1", 1, "Energy")], "food_id string, nutrient_order int, name string")
    p = spark.createDataFrame([("1", 1, "1 medium", 182.0)], "food_id string, sequence_number int, description string, gram_weight double")
    w = spark.createDataFrame([("1", "f", 0.9)], "food_id string, factor_id string, edible_fraction double")
    got = {r["food_id"]: r for r in resolve.food_detail(release[0], n, p, w).collect()}
    assert [x["name"] for x in got["1"]["nutrients"]] == ["Energy", "Protein"] and got["1"]["portions"][0]["gram_weight"] == 182.0 and got["2"]["portions"] is None


def test_decisions(spark):
    schema = "req int, rank int, food_id string, name string, query string, spoken string, match_tier int, term_exact boolean, term_type string"
    rows = [
        (1, 1, "a", "Apple", "apple", "an apple", 0, None, None), (1, 2, "b", "Pear", "apple", "an apple", None, None, None),
        (2, 1, "a", "Apple", "apple", "an apple", 0, None, None), (2, 2, "b", "Apple", "apple", "an apple", 0, None, None),  # a rival
        (3, 1, "a", "Apple, NFS", "apple", "", 0, None, None),  # leaves the kind open
        (4, 1, "a", "Apples, raw", "apple", "an apple", 0, None, None), (5, 1, "a", "Apples, raw", "apple", "a raw apple", 0, None, None),
        (6, 1, "a", "Egg, boiled", "egg", "a boiled egg", None, None, None), (7, 1, "a", "Egg, boiled", "egg", "a fried egg", None, None, None),
        (8, 1, "a", "Egg, whole", "eggs", "eggs", None, None, None), (8, 2, "b", "Eggs, white", "eggs", "eggs", None, None, None),  # two heads
        (9, 1, "a", "Malus", "apple", "apple", None, True, "common_name"), (10, 1, "a", "Malus", "apple", "apple", None, True, "other"),
    ]
    got = {r["req"]: r["decision"] for r in resolve.decide(spark.createDataFrame(rows, schema), ["req"]).collect()}
    assert got == {1: "direct", 2: "review", 3: "review", 4: "review", 5: "direct", 6: "direct", 7: "review", 8: "review", 9: "direct", 10: "review"}


def test_assembly_keeps_candidates_only(spark):
    items = spark.createDataFrame([(1, "a", ["b", "x", "b", "a"], ["unit", "unit"]), (2, "z", [], None), (3, None, None, ["food"])], "req int, food_id string, alternatives array<string>, missing array<string>")
    offered = spark.createDataFrame([(1, "a"), (1, "b"), (2, "y")], "req int, food_id string")
    got = {r["req"]: (r["food_id"], r["alternatives"], r["unresolved"]) for r in resolve.assemble(items, offered, ["req"]).collect()}
    assert got == {1: ("a", ["b"], ["unit"]), 2: (None, [], ["food"]), 3: (None, None, ["food"])}


def test_weight_basis(spark):
    rows = [("as_purchased", "with bone", "Chicken", True, "as_purchased"), ("as_purchased", "with bone", "Chicken", False, None), ("edible", "x", "Plum pit", None, "edible"), (None, "chicken with bone", "Chicken", None, None), (None, "plain rice", "Rice", None, "edible")]
    d = spark.createDataFrame(rows, "said string, phrase string, name string, usable boolean, want string")
    assert d.filter(~resolve.weight_basis(*map(F.col, ("said", "phrase", "name", "usable"))).eqNullSafe(F.col("want"))).count() == 0


def test_common_substrings_equal_plain_loops():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randint(0, 14))) for _ in range(2))
        want = max((k for i in range(len(a)) for k in range(1, len(a) - i + 1) if a[i : i + k] in b), default=0)
        assert evidence.common_length(a, b) == want


def test_quotes_of_one_passage_are_put_together(spark):
    long = "the protein of the dried seeds was forty percent by weight of dry matter"
    rows = [(1, 1, long, 2), (1, 2, long[10:60], 1), (1, 3, "something quite different here", 1), (1, 4, None, 1), (2, 5, long, 1), (1, 6, long[30:] + " and more", 4)]
    d = spark.createDataFrame(rows, "page int, id int, quote string, n int")
    got = sorted(tuple(r) for r in evidence.components_longest(d, ["page"]).collect())
    assert got == [(1, 1, long, 7, 3), (1, 3, "something quite different here", 1, 1), (1, 4, None, 1, 1), (2, 5, long, 1, 1)]


def test_layout(spark):
    rows = [(1, 0.0, 10.0, 100.0, "a"), (1, 12.0, 20.0, 101.5, "b"), (1, 60.0, 70.0, 99.0, "c"), (1, 0.0, 5.0, 90.0, "d"), (2, 5.0, 9.0, 50.0, "z")]
    d = spark.createDataFrame(rows, "page int, x double, right double, y double, word string")
    assert sorted(tuple(r) for r in evidence.layout_rows(d, "page").collect()) == [(1, 0, 0, "a b"), (1, 0, 1, "c"), (1, 1, 0, "d"), (2, 0, 0, "z")]


def test_tables_and_records(spark):
    html = "<p>x</p><TABLE id=1><caption>Protein <b>of</b> beans</caption><tr><th>Food</th><th>g</th></tr><tr><td>Bean</td><td> 21 </td></tr></TABLE><table></table>"
    got = wording.tables_of(spark.createDataFrame([(1, html), (2, None)], "id int, html string"), "id", "html").collect()
    assert [(r["id"], r["table"], r["caption"], r["headers"], r["rows"]) for r in got] == [(1, 0, "Protein of beans", ["Food", "g"], [["Bean", "21"]]), (1, 1, "", [], [])]
    xml = "<oai><record><dc:title>A &amp; B</dc:title><dc:creator>x</dc:creator><dc:creator>y</dc:creator></record><record><dc:title/></record></oai>"
    got = xml_source.records(spark.createDataFrame([(1, xml)], "id int, xml string"), "id", "xml", {"title": "title", "people": "creator"}).collect()
    assert [(r["nth"], r["title"], r["people"]) for r in got] == [(0, ["A & B"], ["x", "y"]), (1, [], [])]


def test_word_functions(spark):
    d = spark.createDataFrame([("Ｃafé’s  ﬁne İ",)], "t string").select(text.search_text(F.col("t")).alias("a"), text.without_marks(F.col("t")).alias("b"), text.joined_words(F.lit("Don't re-do x--y")).alias("c"), text.token_variants(F.lit("berry")).alias("d"), text.deletion_variants(F.lit("abcd")).alias("e"), text.edge_ngrams(F.lit("the red bean and salt"), ("the", "and")).alias("f"))
    r = d.first()
    assert r["a"].startswith("café s fine") and r["b"].startswith("cafe’s  fine i") and r["c"] == ["don't", "re-do", "x", "y"]
    assert r["d"] == ["berry", "berrys", "berryoes", "berries"] and r["e"] == ["bcd", "acd", "abd", "abc"] and r["f"] == ["red bean", "bean and salt"]
    forms = spark.createDataFrame([(w,) for w in ("berries", "glass", "potatoes", "bus", "apples", "figs", None)], "w string").select(*(f(F.col("w")).alias(f.__name__) for f in (text.singular, text.singular_term, text.singular_token))).collect()
    assert [tuple(x) for x in forms] == [("berry", "berry", "berry"), ("glass", "glass", "glass"), ("potatoe", "potatoe", "potato"), ("bu", "bus", "bus"), ("apple", "apple", "apple"), ("fig", "figs", "fig"), (None, None, None)]


def test_quotes_with_gaps(spark):
    body = "The beans held 21 g of protein; the seeds, dried, held more than 40 g."
    d = spark.createDataFrame([(body,)], "t string")
    ask = lambda q: d.select(wording.quote_found(F.col("t"), F.lit(q)).alias("x")).first()["x"]
    assert ask("beans held 21 g") and ask("The beans … dried, held") and ask("beans held ... the seeds ... 40 g.") and not ask("dried, held … The beans") and not ask("beans")


def test_errors_and_keywords(spark):
    d = spark.createDataFrame([("429 Quota exceeded", "quota"), ("model not found: models/x for generateContent", "fatal"), ("Read timed out", "retry"), ("", None), (None, None), ("bad json", "other")], "m string, want string")
    assert d.filter(~wording.error_kind(F.col("m")).eqNullSafe(F.col("want"))).count() == 0
    assert d.select(wording.nutrient_section(F.lit("Vitamin C and iron")).alias("s")).first()["s"] == "Minerals"


def test_json(spark):
    rows = [('```json\n{"b": {"z": 1, "a": [2, 1]}}\n``` and {', '{"b":{"a":[2,1],"z":1}}'), ("none {", None), (None, None), ('x [1, {"k": "}"}]', '[1,{"k":"}"}]')]
    d = spark.createDataFrame(rows, "t string, want string")
    assert d.filter(~evidence.canonical_json(evidence.json_inside(F.col("t"))).eqNullSafe(F.col("want"))).count() == 0


def test_state_changes(spark):
    ready, refused = workflow.prepare_hits(spark.createDataFrame([("a", "t1", ""), ("a", "t1", None), ("", "t2", "k"), ("b", "t3", "k")], "id string, title string, hit_key string"), ["id", "title"], F.md5("title"))
    assert ready.count() == 2 and refused.count() == 1
    with pytest.raises(ValueError, match="rows found"):
        workflow.check_counts({"a": ready}, {"a": 3})
    assert workflow.check_counts({"a": ready}, {"a": 2}) == {"a": 2}
    d = spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string")
    with pytest.raises(ValueError, match="different names"):
        figures.union_categories(d, spark.createDataFrame([(1, "z")], "id int, name string"), key="id", name="name")
    assert figures.union_categories(d, d, key="id", name="name").count() == 2
    assert figures.where_given(d, id=None).count() == 2 and figures.where_given(d, id=2).count() == 1 and figures.clamp_limit(None, 1, 50) == 1 and figures.clamp_limit(900, 1, 50) == 50
    index = spark.sql("SELECT map('the', array(0, 2), 'of', array(1)) AS m").select(evidence.abstract_text(F.col("m")).alias("t"))
    assert index.first()["t"] == "the of the"
