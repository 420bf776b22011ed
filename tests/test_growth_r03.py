"""Steps whose figures grew too fast before the third round's findings, and that they give what they gave."""

import random

import numpy as np
import pytest

from tessella.llm import token_store
from tessella.operators import evidence, linking, review, wording
from tessella.plans import catalog

from .conftest import rows_of


def quotes(seed, pages=4, n=40):
    """Turns put together from few phrases, so that passages of all lengths are shared; some short, equal, empty or null."""
    rng = random.Random(seed)
    phrases = ["".join(rng.choice("abcde ") for _ in range(rng.choice([3, 8, 15, 30, 60]))) for _ in range(12)]
    made = [(rng.choice([*range(pages), None]), i, "".join(rng.choice(phrases) for _ in range(rng.randrange(5))) if rng.random() < 0.95 else None, 1) for i in range(n * pages)]
    return made + made[:3]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_in_one_task_and_dealt_out(spark, monkeypatch, seed):
    """runs of a group are not moved if one task can hold them; those of a larger one are, with the same result."""
    d = spark.createDataFrame(quotes(seed), "page int, id int, quote string, n long")
    want = sorted(map(tuple, evidence.components_longest(d, ["page"]).collect()), key=str)
    monkeypatch.setattr(linking, "TOGETHER", 200)
    assert sorted(map(tuple, evidence.components_longest(d, ["page"]).collect()), key=str) == want
    assert len(want) < d.count()


def test_a_group_gives_one_link_a_text(spark, monkeypatch):
    """four texts with a passage of 100 characters are linked by three links, and none of their runs is written."""
    made, folder = [], linking.shared.shared_dir
    monkeypatch.setattr(linking.shared, "shared_dir", lambda session, name: made.append(folder(session, name)) or made[-1])
    passage = "".join(random.Random(3).choice("abcdefgh ") for _ in range(100))
    texts = [("p", i, x + passage + y) for i, (x, y) in enumerate([("", "one"), ("two ", ""), ("", ""), ("3", "4")])] + [("q", 4, passage), ("p", 5, "another text of twenty characters and more")]
    d = spark.createDataFrame(texts, "page string, id long, quote string")
    links = linking.passage_links(d, "page", "id", "quote").collect()
    assert len(links) == 3 and {x for r in links for x in r} == {0, 1, 2, 3}
    assert [spark.read.parquet(path).count() for path in made] == [0]
    assert linking.text_roots([t[2] for t in texts if t[0] == "p"]) == [0, 0, 0, 0, 4]


def test_groups_that_lie_over_batches(spark):
    """what a group has in one batch is compared with the rest of it in the next ones; not-a-number is one group."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(float("nan") if g == 2 else float(g), 10 * g + i, f"{'word' * 10}{g} number {i}") for g in range(5) for i in range(7)]
        got = evidence.components_longest(spark.createDataFrame([(*r, 1) for r in rows], "page double, id int, quote string, n long"), ["page"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r["members"] for r in got) == [7] * 5


def test_reviews_are_dealt_by_the_size_of_their_table(spark, sf_dir, oracle, monkeypatch):
    """a larger table gives more partitions, not larger ones, from the first step on."""
    monkeypatch.setattr(review, "A_PART", 10_000)
    d = catalog.queries()["review_outcomes"](spark, sf_dir)
    assert "hashpartitioning(l_orderkey#" in (p := d._jdf.queryExecution().executedPlan().toString()) and ", 11), REPARTITION_BY_NUM" in p
    assert rows_of(d) == oracle(catalog.oracle_sql()["review_outcomes"])


@pytest.mark.parametrize("bits", [40, 3])
def test_frequent_values_are_those_of_a_plain_count(spark, monkeypatch, bits):
    """F16: whatever hashes fall together, the values and their numbers are exact; nulls are a value, as in a grouping."""
    monkeypatch.setattr(wording, "HASH_BITS", bits)
    d = spark.createDataFrame([(f"v{i}",) for i in range(60) for _ in range(i % 7)] + [(None,)] * 5, "v string")
    want = [(f"v{i}", i % 7) for i in range(60) if i % 7 >= 5] + [(None, 5)]
    assert sorted(map(tuple, wording.frequent(d, "v", 5).collect()), key=str) == sorted(want, key=str)
    assert wording.frequent(d, "v", 50).count() == 0


def test_rare_phrases_are_not_moved(spark, tmp_path):
    """F16: what reaches the shuffle of phrases is what stands there often enough."""
    rng = random.Random(1)
    rare = ["".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(3000)]
    texts = [(i, f"green apple pie {w} {w[::-1]}") for i, w in enumerate(rare)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    d = catalog.queries()["edge_phrases"](spark, str(tmp_path))
    assert sorted(map(tuple, d.collect())) == [("apple pie", 3000), ("green apple", 3000), ("green apple pie", 3000)]
    assert "likely(" in d._jdf.queryExecution().executedPlan().toString()


def test_rules_are_expanded_many_at_a_time():
    """op1: as one by one, and without a step of Python for each rule of a large grammar."""
    rng = np.random.default_rng(2)
    for n in (0, 1, 500):
        rules = np.array([rng.integers(0, 50 + k, 2) if k < 40 else rng.integers(0, 90, 2) for k in range(n)], np.uint32).reshape(-1, 2)
        expand = lambda x: [x] if x < 50 else [i for y in rules[x - 50].tolist() for i in expand(y)]  # noqa: B023, E731
        want = [expand(50 + k) for k in range(n)]
        lengths = token_store.expansion_lengths(rules, 50)
        flat, starts = token_store._dictionary(rules, lengths, 50)
        assert lengths.tolist() == [len(w) for w in want] and flat.tolist() == [x for w in want for x in w] and starts.tolist() == [0, *np.cumsum(lengths).tolist()]
    reads = []

    class Counted(np.ndarray):
        def tolist(self):
            reads.append(len(self))
            return super().tolist()

    token_store._dictionary(rules.view(Counted), lengths, 50)
    assert not reads
