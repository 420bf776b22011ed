from pyspark.sql import functions as F

from tessella.llm import languages, mixing, packing, toxicity
from tessella.llm.tokens import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_documents_without_an_id_are_many_shards(spark):
    rows = [(None, f"word{i} " * (1 + i % 7), "en", "s", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    m = mixing.mix(docs, shard_words=100)
    assert abs(m.agg(F.sum("taken")).first()[0] - 1.5 * sum(1 + i % 7 for i in range(3000))) <= mixing.BLOCK
    # begins differ by shard: with one shard there would be at most one document that is taken in part
    assert m.filter("taken % size <> 0").count() > 20


def test_equal_rows_without_an_id_are_many_groups(spark):
    rows = [(None, "the same text", "en", "s", 0)] * 2000 + [(i, f"text {i}", "en", "s", 0) for i in range(50)]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(4), tokenizer_path("word_bpe_49k.json"), group_rows=100)
    got = out.select("sequence_id", "offset", "length").collect()
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert len(got) == 2050


def test_terms_come_from_other_rows_than_the_calibration(spark, monkeypatch):
    rows = [(i, f"some words zork{i % 2} " + ("blargh " if i % 2 else "") + f"mark{i}", None, None, 0) for i in range(600)]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, toxic int")
    seen, plain = [], toxicity._terms
    monkeypatch.setattr(toxicity, "_terms", lambda sample, most: (seen.append({r["doc_id"] for r in sample.collect()}), plain(sample, most))[1])
    fitted, real = [], toxicity.isotonic
    monkeypatch.setattr(toxicity, "isotonic", lambda f, y, w: (fitted.append(len(f)), real(f, y, w))[1])
    model = toxicity.learn(docs, labels)
    assert fitted[0] + len(seen[0]) == 600 and 120 < fitted[0] < 280 and "blargh" in model.lexicon.words
    # labels of documents that are not there take no place in the sample
    far = labels.unionByName(spark.createDataFrame([(10_000 + i, 1) for i in range(5000)], labels.schema))
    assert len(toxicity.learn(docs, far, per_class=100).lexicon.words) >= len(toxicity.INSULTS)
    assert len(seen[1]) > 100


def test_longer_texts_give_more_windows(spark, monkeypatch):
    monkeypatch.setattr(languages, "train", lambda x, y, langs, seed: x)
    rows = [(1, "a" * 6400, "en"), (2, "b" * 640, "en"), (3, "", "en"), (4, "c" * 64, "de")]
    x = languages.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), windows_per_text=8)
    count = {c: sum(w[0] == ord(c) for w in x) for c in "abc"}
    assert count == {"a": 22, "b": 2, "c": 8}
