import random
import time

import pytest
from pyspark.sql import functions as F

from tessella.operators import evidence, linking, mentions


def plain_components(rows):
    """rows (page, id, quote, n) put together by the rule for two quotes, pair by pair."""
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(rows):
        for j in range(i):
            if a[0] == rows[j][0] and a[2] and rows[j][2] and evidence.same_passage(a[2], rows[j][2]):
                up[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r)
    out = []
    for own in groups.values():
        top = min(own, key=lambda r: (-len(r[2]) if r[2] is not None else 1, r[1]))
        out.append((own[0][0], top[1], top[2], sum(r[3] for r in own), len(own)))
    return sorted(out, key=str)


def quotes(seed, n, pages):
    """Cuts of common sentences of many lengths, with changes, and own words: many pairs stand near the rule's limits."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(25)) for _ in range(6)]
    rows = []
    for i in range(n):
        t = rng.choice(texts)
        a = rng.randrange(len(t))
        q = t[a : a + rng.choice([3, 8, 15, 19, 20, 25, 33, 41, 66, 67, 90])].strip()
        if rng.random() < 0.5:
            q = f"{rng.choice(words)} {q} {' '.join(rng.choice(words) for _ in range(rng.randrange(8)))}".strip()
        rows.append((rng.randrange(pages), i, " ".join(q.split()) or None, rng.randrange(5)))
    return [*rows, (0, n, None, 1), (0, n + 1, "", 2)]


@pytest.mark.parametrize("seed", range(3))
def test_quotes_of_one_passage_equal_pairs(spark, seed):
    rows = quotes(seed, 120, 3)
    d = spark.createDataFrame(rows, "page int, id int, quote string, n int").repartition(4)
    assert sorted((tuple(r) for r in evidence.components_longest(d, ["page"]).collect()), key=str) == plain_components(rows)


def test_five_thousand_quotes_on_one_page(spark):
    """One page, a sentence that a third of its quotes share, others alone: links stay in proportion to the quotes."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    common = " ".join(word() for _ in range(8))
    rows = [(1, i, f"{word()} {common} {word()}" if i % 3 == 0 else " ".join(word() for _ in range(6)), 1) for i in range(5000)]
    d = spark.createDataFrame(rows, "page int, id int, quote string, n int").repartition(4)
    texts = d.select("page", "id", "quote")
    assert linking.passage_links(texts, "page", "id", "quote").count() < 40 * len(rows)
    out = evidence.components_longest(d, ["page"]).collect()
    assert sorted(r["members"] for r in out)[-1] == 1667 and len(out) == 5000 - 1666


def test_common_length_of_long_texts():
    rng = random.Random(1)
    a, b = ("".join(rng.choice("ab") for _ in range(30_000)) for _ in range(2))
    b = b[:1000] + a[5000:5700] + b[1700:]
    began = time.time()
    n = linking.common_length(a, b)
    assert n >= 700 and n < 740 and time.time() - began < 20
    # texts whose hashes agree though they don't: the two halves of a Thue-Morse sequence
    t = "a"
    for _ in range(12):
        t += t.translate(str.maketrans("ab", "ba"))
    x, y = t[:2048], t[2048:]
    want = next(k for k in range(2048, 0, -1) if any(x[i : i + k] in y for i in range(len(x) - k + 1)))
    assert linking.common_length(x, y) == want


def test_components_of_long_chains_and_stars(spark):
    chain = [(f"c{i:04}", f"c{i + 1:04}") for i in range(300)]
    star = [("s0000", f"s{i:04}") for i in range(1, 500)]
    links = spark.createDataFrame(chain + star + [("x", "x"), ("z", "y")], "u string, v string").repartition(4)
    got = {r["node"]: r["root"] for r in linking.components(links).collect()}
    assert got == {**{f"c{i:04}": "c0000" for i in range(1, 301)}, **{f"s{i:04}": "s0000" for i in range(1, 500)}, "z": "y"}
    assert linking.components(links.limit(0)).count() == 0


LEXICON = [(1, "Iron"), (2, "iron oxide"), (3, "Vitamin C"), (4, "C"), (5, "iron"), (6, "  "), (7, None), (8, "oxide red"), (9, "é"), (10, "İz")]


def plain_mentions(text, lexicon):
    """Every whole-word place of every name, then earlier and longer ones first."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    word = lambda c: c.isascii() and c.isalnum()
    found = []
    for i, name in lexicon:
        if not name or not name.strip():
            continue
        low_name = "".join(c.lower() if len(c.lower()) == 1 else c for c in name)
        for s in range(len(low) - len(name) + 1):
            e = s + len(name)
            if low[s:e] == low_name and not (s and word(low[s - 1])) and not (e < len(low) and word(low[e])):
                found.append((s, -e, i, name))
    out, free = [], 0
    for s, e, i, name in sorted(found):
        if s >= free:
            out.append((i, name, s, -e, text[s:-e]))
            free = -e
    return out, found


TEXTS = ["Iron, IRON oxide red and vitamin c; irony ironé c", "", None, "İz iz éé é-C C", "iron iron iron oxide", "no " * 50 + "Iron"]


@pytest.mark.parametrize("entries", [1000, 2])
def test_mentions(spark, monkeypatch, entries):
    monkeypatch.setattr(mentions, "ENTRIES", entries)
    docs = spark.createDataFrame([(i % 4, t) for i, t in enumerate(TEXTS)], "doc long, text string").repartition(2)
    lexicon = spark.createDataFrame(LEXICON, "id long, name string")
    got = sorted(tuple(r) for r in mentions.mentions(docs, lexicon, "doc").collect())
    assert got == sorted((i % 4, *m) for i, t in enumerate(TEXTS) for m in plain_mentions(t or "", LEXICON)[0])
    raw = mentions.mentions(docs, lexicon, "doc", overlapping=True).collect()
    assert sorted((r["doc"], r["start"], -r["stop"], r["id"], r["name"]) for r in raw) == sorted((i % 4, *m) for i, t in enumerate(TEXTS) for m in plain_mentions(t or "", LEXICON)[1])
    assert mentions.mentions(docs, lexicon.limit(0), "doc").count() == 0


@pytest.mark.parametrize("entries", [1000, 2])
def test_best_aliases(spark, monkeypatch, entries):
    monkeypatch.setattr(mentions, "ENTRIES", entries)
    names = [(1, "Fuji  apple"), (1, "apple"), (1, "pie"), (2, "Bread"), (3, "dried PEAR"), (3, "Pear, dried"), (4, "fuji apple"), (5, "ig"), (6, "straße")]
    lexicon = spark.createDataFrame(names, "id long, name string")
    docs = spark.createDataFrame([(1, "A Fuji APPLE\n and dried pear, breads"), (2, "dried pear bread STRASSE apple pie"), (3, None), (2, "bread")], "doc long, text string")
    got = sorted(tuple(r) for r in mentions.best_aliases(docs, lexicon, "doc", limit=2).collect())
    assert got == [(1, 1, "fuji apple", 1), (1, 4, "fuji apple", 2), (2, 2, "bread", 1), (2, 3, "dried pear", 1), (2, 6, "strasse", 2)]


def test_texts_through_the_column_function(spark):
    d = spark.createDataFrame([("abcdef", "zcdez"), (None, "x"), ("", "x")], "a string, b string")
    assert [r[0] for r in d.select(evidence.longest_common(F.col("a"), F.col("b"))).collect()] == [3, None, 0]
