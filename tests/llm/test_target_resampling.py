import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import common, target_resampling, word_tries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10000


def plain(rows, target):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    n, m = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (n + 10000.0) / ((s[b] + 1.0) * (m + 10000.0)))) for b in range(10000)]
    out = []
    for doc_id, text in rows:
        w, f = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        out.append([doc_id, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for i, r in enumerate(able[: 5 * len(able) // 100]):
        r[5] = i + 1
    return sorted((tuple(r[:1] + r[2:]) for r in out), key=str)


TARGET = ["new words here and there, one line", None, "", "Second line here. Two words"]
MORE = [(None, "a b c " * 40), (None, "a b c " * 40), (400, "Ünï_cödé WORDS-with\x00zero bytes ’quoted’ 12,5 " * 9), (401, ("x" * 70 + " " + "é" * 40 + " ") * 30), (402, "...---..."), (403, "İ ẞ K " * 20)]


@pytest.fixture
def tables(spark, rows):
    mine = [(a, b) for a, b, *_ in rows] + MORE
    return mine, spark.createDataFrame(mine, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in TARGET], "text string")


def got(docs, target):
    df = target_resampling.ranked(target_resampling.weigh(docs, target_resampling.gains(target_resampling.totals(docs), target_resampling.totals(target))))
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_rows_equal_plain_rule(tables):
    rows, docs, target = tables
    assert got(docs, target) == plain(rows, TARGET)


def test_clashing_columns_and_empty_tables(tables, spark):
    rows, docs, target = tables
    wide = docs.withColumns({n: F.lit("x") for n in ("rank", "score", "n_words", "__row", "__range", "bucket", "n", "text_key")})
    assert got(wide, target) == plain(rows, TARGET)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert got(none, target) == [] and got(docs, none) == plain(rows, [])


def test_small_blocks_and_long_texts_give_the_same_runs(rows, monkeypatch):
    texts = [(b or "").encode() for _, b, *_ in rows] + [t.encode() for _, t in MORE]
    want = Counter(bucket(f) for t in texts for f in features(t.decode())[1])
    for size in (7, 60, 1000, 1 << 20):
        monkeypatch.setattr(word_tries, "BLOCK", size)
        have, n = Counter(), 0
        for block in word_tries.blocks(texts):
            for text, node, counts, crc in block.levels():
                n += len(text)
                assert len(node) == len(text) == counts.sum() and len(counts) == len(crc)
                for c, k in zip((crc % 10000).tolist(), counts.tolist()):
                    have[c] += k
        assert have == want and n == sum(want.values())


def test_ranks_over_many_ranges_with_ties(spark, monkeypatch):
    rows = [(i % 700 if i % 3 else None, 30, 80 + i % 2, 1000 * (i % 5)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long")
    out = target_resampling.ranked(df, per_cent=40).collect()
    ranks = sorted((r for r in out if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranks] == list(range(1, 1601)) and len(out) == 4000
    key = lambda r: (-r["score"], r["doc_id"] is None, r["doc_id"] or 0, r["n_features"])
    assert [key(r) for r in ranks] == sorted(map(key, out))[:1600]


def test_numbered_has_no_gaps(spark):
    scratch = common.Scratch(spark)
    df = common.numbered(scratch, spark.range(0, 1000, 1, 7).withColumn("x", F.col("id") % 3), [F.col("x").desc(), "id"], "place")
    want = sorted(range(1000), key=lambda i: (-(i % 3), i))
    assert [r["id"] for r in df.orderBy("place").collect()] == want and df.agg(F.min("place"), F.max("place")).first()[:] == (1, 1000)


def test_drawn_rows_keep_their_columns(tables):
    _, docs, target = tables
    wide = docs.withColumn("extra", F.lit(1))
    drawn = target_resampling.resample(wide, target, per_cent=20)
    assert drawn.columns == wide.columns and 15 <= drawn.count() <= 25
