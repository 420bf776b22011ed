"""The pipeline's stages, each against a plain version on its own input."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import common, mixing, quality_rules, registry, toxicity
from tessella.llm.tokens import tokenizer_path

from .conftest import SCHEMA, make_rows
from .test_jaccard import brute
from .test_tokens import plain


def test_stages_on_the_tables(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir))
        if name != "packing":
            assert docs.columns == columns
        if name in ("quality rules", "toxicity", "n-gram Jaccard join"):
            assert 0 < docs.count() <= before
            before = docs.count()
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(docs.columns) and docs.count() > 0


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with nulls in every column, empty, blank and long texts, repeated rows and ids, and columns with clashing names."""
    d = str(tmp_path_factory.mktemp("pipeline"))
    rows = make_rows(9, 90)
    rows += [rows[3], rows[3], rows[101], (3, rows[4][1], "en", None, None), (None, rows[5][1] + " more", None, None, None), (None, rows[6][1], "de", "s2", 7), (400, "you stupid worthless idiot " + rows[8][1], "en", "s0", 1)]
    names = ("q_kept", "q_row", "row", "size", "taken", "sid", "root", "key", "words", "part", "d0", "t0", "times", "once", "label", "length", "salt")
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(i) for i, n in enumerate(names)})
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(80)] + [(None, 1, 1), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def texts(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_each_stage_equals_its_plain_version(spark, tables):
    docs = common.documents(spark, tables)
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name: common.materialise(stages[name](spark, docs, tables))

    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toArrow())
    verdict = {(i, n, w): k for i, n, w, k in con.sql(f"SELECT doc_id, n_words, word_chars, kept FROM ({quality_rules.ORACLE_SQL}) q").fetchall()}
    good = step("quality rules")
    w = lambda t: "".join((t or "").encode().decode()).encode().split()
    measured = lambda r: (r[0], len(w(r[1])), sum(len(x.decode()) for x in w(r[1])))
    assert texts(good) == Counter({r: n for r, n in texts(docs).items() if verdict[measured(r)]})
    assert good.columns == columns and 0 < good.count() < docs.count()

    docs = good
    clean = step("toxicity")
    model = toxicity.learn(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    assert texts(clean) == Counter({r: n for r, n in texts(docs).items() if model.scores([r[1]])[0] < 0.5}) and clean.columns == columns

    docs = clean
    one = step("n-gram Jaccard join")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    place = lambda i: (i is None, i or 0)
    order = sorted(range(len(rows)), key=lambda k: place(rows[k][0]))  # numbers in order of ids, so that a root is the row that stays
    roots = {c for _, _, n, c in brute([(k, rows[at][1]) for k, at in enumerate(order)], 5, 80, 100) if n}
    assert sorted((i for i, _ in texts(one).elements()), key=place) == [rows[order[c]][0] for c in sorted(roots)] and one.columns == columns

    docs = one
    mixed = step("mixing sources")
    taken, have = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    for (i, t), n in texts(mixed).items():
        have[i] += n * len(t.encode().split())
    assert {k: v for k, v in taken.items() if v} == dict(have) and mixed.columns == columns

    docs = mixed
    packed = [r.asDict() for r in step("packing").collect()]
    encode = plain(tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for (i, t), n in texts(docs).items():
        ids = np.array([*encode(t), 2], "<u4")
        for at in range(0, len(ids), 4096):
            want[i, at, min(4096, len(ids) - at), zlib.crc32(ids[at : at + 4096]), len(ids)] += n
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in packed) == want


def test_an_empty_table_goes_through(spark, tables, tmp_path):
    common.documents(spark, tables).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(got.columns)


def test_registry_covers_the_ten():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
