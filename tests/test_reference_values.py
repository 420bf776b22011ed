"""Literal cases worked out by hand from the reference's rules."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tessella.operators import planning, wording

PAPERS = [
    # pmcid, doi, title, year, journal, source, source_id, external_id, key
    ("PMC-123", None, "T", None, None, "s", "1", "e", "pmcid:pmc123"),
    ("123", "10.1/x", "T", None, None, "s", "1", "e", "pmcid:pmc123"),
    (" PMC 0042 ", None, None, None, None, None, None, None, "pmcid:pmc0042"),
    (" - ", " 10.1/A  B ", "T", None, None, "s", "1", "e", "doi:10.1/a b"),
    ("", "https://doi.org/10.1/A", "T", None, None, "s", "1", "e", "doi:https://doi.org/10.1/a"),
    (None, None, "  The  Títle: no_2! ", "c. 2020-05-01", "J. of  X", "s", "1", "e", "the títle no 2|2020|j of x"),
    (None, None, "A title", None, "J", "s", "1", "e", "a title|j"),
    (None, None, "A title", "2021", None, " SRC ", "Rec 9", "e", "a title|2021|src:rec 9"),
    (None, None, "A title", "", None, None, "", "Ext", "a title|:ext"),
    (None, None, "A title", None, None, None, None, "", "a title"),
    (None, None, " -- ", None, None, "Src", None, "E 1", "source:src:e 1"),
    (None, None, None, None, None, None, "", "", "source:unknown:unknown"),
]


def test_canonical_keys(spark):
    names = "pmcid doi title year journal source source_id external_id want".split()
    d = spark.createDataFrame(PAPERS, ", ".join(f"{n} string" for n in names)).withColumn("key", planning.canonical_key(*[F.col(n) for n in names[:8]]))
    for r in d.collect():
        want = r["want"]
        if r["key"].startswith("title:"):
            want = "title:" + hashlib.sha1(want.encode()).hexdigest()[:24]
        assert r["key"] == want


@pytest.mark.parametrize("text,kind", [
    ("models/x is not found for generateContent", "fatal"), ("generate_content: models/x NOT FOUND", "fatal"), ("models/x is not supported for generateContent", "fatal"), ("models/x not found", "other"),
    ("429 from Gemini", "quota"), ("429 generate_content", "quota"), ("429", "other"), ("see generativelanguage.googleapis.com", "quota"), ("GEMINI-API says no", "quota"), ("free-tier", "quota"),
    ("AI evaluation exceeded 30 s", "retry"), ("limit exceeded", "other"), ("Deadline reached", "retry"), ("HTTP 503", "retry"), ("  ", None), (None, None), ("429: quota, models/x not found generatecontent", "quota"),
])
def test_error_kinds(spark, text, kind):
    assert spark.createDataFrame([(text,)], "m string").select(wording.error_kind(F.col("m"))).first()[0] == kind


def test_macro_targets(spark):
    rows = [("balanced", "eatWell", 125.0, 225.0, 600 / 9), ("balanced", "loseFat", 150.0, 200.0, 600 / 9), ("balanced", "buildMuscle", 150.0, 200.0, 600 / 9), ("balanced", "performance", 125.0, 250.0, 500 / 9), ("keto", "loseFat", 125.0, 50.0, 1300 / 9), ("keto", "performance", 125.0, 50.0, 1300 / 9), ("blue_zones", "moreEnergy", 75.0, 300.0, 500 / 9), ("other", "eatWell", None, None, None)]
    t = planning.macro_targets(F.lit(2000.0), F.col("diet"), F.col("goal"))
    for r in spark.createDataFrame(rows, "diet string, goal string, p double, c double, f double").select("*", *[v.alias(k) for k, v in t.items()]).collect():
        for want, got in ((r["p"], r["protein"]), (r["c"], r["carbohydrate"]), (r["f"], r["fat"])):
            assert got is None if want is None else got == pytest.approx(want)


def test_meals(spark):
    now = dt.datetime(2024, 5, 1, 20, 0, tzinfo=dt.timezone.utc)
    rows = [("2024-01-01T03:59:59", "UTC", "snacks"), ("2024-01-01T04:00:00", "UTC", "breakfast"), ("2024-01-01T10:59", "Europe/Istanbul", "breakfast"), ("2024-01-01T08:30:00Z", "Europe/Istanbul", "lunch"), ("2024-01-01T08:30:00+03:00", "Europe/Istanbul", "breakfast"), ("2024-01-01 16:00:00", "America/New_York", "dinner"), ("2024-01-01T22:00:00", "Mars/Base", "snacks"), ("2024-01-01T22:30:00-05:00", "Mars/Base", "snacks"), ("not a time", "UTC", "dinner"), ("not a time", "Europe/Istanbul", "snacks"), (None, "UTC", "dinner")]
    d = spark.createDataFrame(rows, "at string, zone string, want string")
    got = d.withColumn("meal", planning.meal_of(F.col("at"), F.col("zone"), ("UTC", "Europe/Istanbul", "America/New_York"), F.lit(now))).collect()
    assert [(r["at"], r["meal"]) for r in got] == [(r[0], r[2]) for r in rows]


@pytest.mark.parametrize("active,total,cursor,want,after", [({"en", "tr"}, 7, 0, {"en": 4, "tr": 3, "de": 0}, 1), ({"en", "tr"}, 7, 1, {"en": 3, "tr": 4, "de": 0}, 0), ({"en", "tr", "de"}, 8, 2, {"en": 3, "tr": 2, "de": 3}, 1), ({"tr"}, 3, 5, {"en": 0, "tr": 3, "de": 0}, 5), (set(), 3, 1, {"en": 0, "tr": 0, "de": 0}, 1), ({"en"}, 0, 1, {"en": 0, "tr": 0, "de": 0}, 1)])
def test_language_budget(active, total, cursor, want, after):
    assert planning.language_budget(["en", "tr", "de"], active, total, cursor) == (want, after)


@pytest.mark.parametrize("n", [1, 2, 3, 11, 12, 31, 1000])
def test_places_of_sorted_values(spark, n):
    values = [float((i * 7919) % 613) for i in range(n)]
    places = planning.latency_places(n)
    got = planning.at_places(spark.createDataFrame([(v,) for v in [*values, None]], "x double"), "x", places)
    assert got == {k: sorted(values)[p] for k, p in places.items()}
    assert places == {"p50": (n - 1) // 2, "p95": round((n - 1) * 0.95)}


CONCEPT = "array<struct<acceptable: array<string>, no_match: boolean, quantity: string, required: array<string>>>"
ITEM = "array<struct<retrieved: array<string>, selected: string, alternatives: array<string>, quantity_status: string, unresolved: array<string>>>"


def test_evaluation(spark):
    cases = [
        ("a", [(["f1", "f2"], False, "given", [])]),
        ("b", [(["f3"], False, "unresolved", ["quantity", "preparation"]), ([], True, "given", [])]),
        ("c", [(["f4"], False, "given", []), (["f5"], False, "given", [])]),
    ]
    answers = [
        ("a", 100.0, [(["f9", "f2"], "f2", ["f9", "zz"], "resolved", [])]),
        ("b", 300.0, [(["f8"] * 12 + ["f3"], "f8", None, "unresolved", ["quantity", "food"]), ([], None, [], "resolved", ["food"])]),
        ("c", 200.0, [(["f4"], "f4", [], "resolved", [])]),
    ]
    c, a = spark.createDataFrame(cases, f"case_id string, concepts {CONCEPT}"), spark.createDataFrame(answers, f"case_id string, latency_ms double, items {ITEM}")
    got = planning.evaluation(c, a)
    # supported: f1/f2, f3, f4, f5; found among the first twelve: only the first. Decisions: 5; right: a, both of b.
    assert got == {"cases": 3, "recall": 0.25, "right_or_clarified": 0.6, "id_validity": 0.75, "no_silent_defaults": 0.5, "p50": 200.0, "p95": 300.0, "passed": False}
    with pytest.raises(ValueError):
        planning.evaluation(c, a.filter("case_id <> 'a'"))
    one = planning.evaluation(c.filter("case_id = 'a'"), spark.createDataFrame([("a", 4000.0, [(["f1"], "f1", [], "resolved", [])])], a.schema))
    assert one["passed"] and one["recall"] == 1
