from collections import Counter

from tessella.llm import languages


def test_a_rare_language_is_kept_among_many(spark, monkeypatch):
    rows = [(1000 * k + i, f"text {k} {i}", f"l{k:02}") for k in range(24) for i in range(300)] + [(90_000 + i, f"rare {i}", "rare") for i in range(3)]
    monkeypatch.setattr(languages, "train", lambda x, y, langs, seed: Counter(langs[i] for i in y))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = languages.learn(d, per_lang=20, most_rows=100, windows_per_text=1)
    assert got == {"rare": 3} | {f"l{k:02}": 4 for k in range(24)}
    got = languages.learn(d, per_lang=20, most_rows=10, windows_per_text=1)
    assert set(got.values()) == {1} and len(got) == 25
