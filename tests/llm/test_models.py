import numpy as np
import pytest

from tessella.llm import languages, quality_mil, toxicity

rng = np.random.default_rng(1)


def close(f, x, analytic, eps=1e-3):
    num = (f(x + eps) - f(x - eps)) / (2 * eps)
    assert abs(num - analytic) < 2e-2 * max(1, abs(num))


def test_gradients_through_time():
    x = rng.integers(0, 256, (7, 5)).astype(np.uint8)
    table, u = rng.standard_normal((256, 9)), rng.standard_normal((3, 9)) * 0.5
    w = rng.standard_normal((7, 5, 3))
    states, saved = languages._run(x, table, u, True)
    d_table, d_u = languages._back(x, u, saved, w, table)

    def loss(i, j):
        def f(v):
            y = u.copy()
            y[i, j] = v
            return float((languages._run(x, table, y, False)[0] * w).sum())

        return f

    for i, j in ((0, 0), (1, 4), (2, 8)):
        close(loss(i, j), u[i, j], d_u[i, j], 1e-2)


def test_languages_are_learnt_and_odd_texts_have_a_result(docs, empty, spark):
    from pyspark.sql import functions as F

    model = languages.learn(docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang"), per_lang=40)
    d = docs.withColumn("held_out", F.lit(True))
    got = languages.identify(d, model).join(docs.select("doc_id", "lang"), "doc_id").filter("doc_id < 60").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.9
    odd = {r["doc_id"]: r for r in languages.identify(d, model).collect()}
    assert all(odd[k]["lang_pred"] == "und" and odd[k]["score"] == 0 for k in (300, 301, 302))
    assert languages.identify(d, None).filter("lang_pred <> 'und'").count() == 0
    assert languages.identify(empty.withColumn("held_out", F.lit(True)), model).count() == 0
    assert languages.learn(empty.select("doc_id", "text", "lang")) is None


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for i in range(160):
        bad = i % 4 == 0
        words = [f"w{x}" if not bad else f"W{x}!!" for x in rng.integers(0, 400, 60)]
        if i % 5 == 0:
            words.insert(20, "idiot")
        rows.append((i, " ".join(words), int(not bad), int(i % 5 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    return d.select("doc_id", "text"), d.select("doc_id", "quality", "toxic")


def test_attention_tells_quality(spark, labelled, empty):
    from pyspark.sql import functions as F

    docs, labels = labelled
    model = quality_mil.learn(docs, labels)
    got = quality_mil.score(docs.withColumn("held_out", F.lit(False)), model).join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string").withColumn("held_out", F.lit(True))
    assert all(0 <= r["score"] <= 1 for r in quality_mil.score(odd, model).collect())
    assert quality_mil.learn(docs, labels.limit(0)) is None
    assert quality_mil.score(empty.withColumn("held_out", F.lit(True)), None).count() == 0


def test_trees_tell_toxicity_and_keep_columns(spark, labelled, wide, empty):
    docs, labels = labelled
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").collect()
    assert np.mean([(r["__toxicity"] >= 0.5) == bool(r["toxic"]) for r in got]) > 0.95
    kept = toxicity.drop_toxic(wide, model)
    assert kept.columns == wide.columns and kept.count() >= wide.count() - 3
    assert toxicity.drop_toxic(empty, model).count() == 0
    assert set(toxicity.learn(docs, labels.limit(0)).scores(["idiot", None])) == {0.0}


def test_obfuscated_words_are_found():
    lex = toxicity.Lexicon(frozenset({"idiot"}), frozenset())
    for text in ("you 1d10t", "such an i.d.i.o.t here", "i d i o t"):
        assert toxicity.features(text, lex)[3] >= 1
    assert toxicity.features("you idiot", lex)[5] > toxicity.features("you and some other words idiot", lex)[5] > 0


def test_isotonic_is_monotone():
    f = rng.standard_normal(200)
    y = (f + rng.standard_normal(200) > 0).astype(float)
    k, v = toxicity.isotonic(f, y, np.ones(200))
    assert (np.diff(k) >= 0).all() and (np.diff(v) >= 0).all() and 0 <= v.min() <= v.max() <= 1
