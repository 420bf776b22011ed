import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import autocomplete as ac


def norm(t, keep=""):
    out = "".join(c if c.isascii() and c.isalnum() or c in keep else " " for c in t.lower().replace("'", "").replace("’", ""))
    return " ".join(out.split())


def single(w):
    if w in ac.IRREGULAR:
        return ac.IRREGULAR[w]
    if len(w) > 4 and w[-3:] == "ies":
        return w[:-3] + "y"
    if len(w) > 4 and w[-3:] == "oes":
        return w[:-2]
    return w[:-1] if len(w) > 3 and w[-1] == "s" and w[-2:] not in ("ss", "us", "is") else w


def words(t):
    return [single(w) for w in norm(t).split()]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def slip(q, w):
    q, w = single(q), single(w)
    if q == w:
        return False
    if any(q[:i] + q[i + 1] + q[i] + q[i + 2 :] == w for i in range(len(q) - 1)):
        return True
    n = max(len(q), len(w))
    return n >= 4 and edits(q, w) <= (2 if n >= 8 else 1)


def same(q, w):
    return q == w or single(q) == single(w)


def longer(q, w):
    return w.startswith(q) and not same(q, w) and len(w) >= len(q) + 2


def relation(ws, q):
    for kind, test in ((1, same), (2, longer), (3, slip)):
        for i, w in enumerate(ws):
            if test(q, w):
                return kind, i
    return 0, -1


def useless(q, ws):
    s = single(q)
    forms = {x for x in (q, s, s + "s", s + "oes", s[:-1] + "ies" if s.endswith("y") else "") if len(x) >= 2}
    return not any(w in forms or w.startswith(q) or slip(q, w) for w in ws)


def prefixes(ws, q, top, by, step):
    if any(same(q, w) for w in ws):
        return 0
    over = [(len(w) - len(q), i) for i, w in enumerate(ws) if w.startswith(q)]
    return max(0, top - min(over)[0] * by) - min(over)[1] * step if over else 0


def typed_points(qs, lists, whole, step):
    total, matched, first = 0, 0, []
    for q in qs:
        found = [(*relation(ws, q), points) for ws, points in lists]
        got = next((points[kind] for kind in (1, 2, 3) for k, _, points in found if k == kind), 0)
        if got:
            matched += 1
            total += got
            first += [i for _, i, _ in found if i >= 0]
    if qs and matched == len(qs):
        total += whole
    else:
        total -= 180 * (len(qs) - matched)
    return total - (min(first) * step if first else 0)


def food(name, query):
    bits = [b.strip() for b in name.split(",") if b.strip()]
    base = (bits[1] if len(bits) > 1 and norm(bits[0]) in ac.NOISY_PREFIXES else bits[0]) if bits else name
    alias = [a.split(")")[0].strip() for a in name.split("(")[1:] if ")" in a and a.split(")")[0]]
    alias = [a for a in alias if a]
    qs = [w for w in words(query) if w not in ac.STOPWORDS]
    ws, own, other, p, g = words(name), words(base), words(" ".join(alias)), norm(query), len(qs) == 1
    if g and useless(qs[0], ws + other):
        return None
    n = 2000 * (norm(name) == p) + 1700 * (norm(base) == p) + 1600 * any(norm(a) == p for a in alias)
    n += 900 * norm(name).startswith(p) + 1200 * norm(base).startswith(p) + 800 * any(norm(a).startswith(p) for a in alias)
    head = qs[0] if qs else None
    n += sum(points for ws_, points in ((ws, 180), (own, 260), (other, 180)) if (ws_[0] if ws_ else None) == head)
    n += typed_points(qs, [(own, {1: 260, 2: 180 if g else 80, 3: 130 if g else 60}), (ws, {1: 180, 2: 120 if g else 40, 3: 90 if g else 45}), (other, {1: 170, 2: 110 if g else 30, 3: 80 if g else 35})], 260, 35)
    n -= 18 * max(0, len(own) - max(len(qs), 1)) + 10 * max(0, len(ws) - len(own))
    if g:
        q = qs[0]
        has = lambda c: any(same(q, w) for w in c)
        n -= 55 * sum(w in ac.PROCESSING_WORDS and w != q for w in ws)
        n += 120 * (own[:1] == [q] or ws[:1] == [q]) + 220 * has(own) + 100 * has(ws) + 150 * has(other)
        n += 45 * min(2, sum(w in ac.WHOLE_FOOD_HINTS for w in ws)) - 140 * sum(longer(q, w) for w in ws)
        n -= 180 * any(same(q, a) and b in ac.PROCESSING_WORDS for a, b in zip(ws, ws[1:]))
        n -= 180 * ("babyfood" in ws or "baby" in ws) + 180 * ("restaurant" in ws)
        n += prefixes(own, q, 260, 70, 25) + prefixes(ws, q, 170, 55, 18) + prefixes(other, q, 200, 60, 10)
    return n - 8 * name.count(",")


def nutrient(name, query):
    alias = [a for a in (x.split(")")[0].strip() for x in name.split("(")[1:] if ")" in x and x.split(")")[0]) if a]
    qs = [w for w in words(query) if w not in ac.STOPWORDS]
    ws, other, p, g = words(name), words(" ".join(alias)), norm(query, "()"), len(qs) == 1
    if g and useless(qs[0], ws + other):
        return None
    n = 2000 * (norm(name, "()") == p) + 1800 * any(norm(a) == p for a in alias) + 900 * norm(name, "()").startswith(p) + 1000 * any(norm(a).startswith(p) for a in alias)
    n += 220 * bool(ws and ws[0] == (qs[0] if qs else "")) + 260 * bool(other and other[0] == (qs[0] if qs else ""))
    n += typed_points(qs, [(other, {1: 240, 2: 150 if g else 50, 3: 95 if g else 45}), (ws, {1: 180, 2: 110 if g else 30, 3: 80 if g else 35})], 220, 30)
    n -= 20 * max(0, len(ws) - max(len(qs), 1))
    if g:
        q = qs[0]
        n += 280 * any(same(q, w) for w in other) + 120 * any(same(q, w) for w in ws) - 180 * sum(longer(q, w) for w in ws)
        n += prefixes(other, q, 240, 60, 8) + prefixes(ws, q, 140, 45, 14)
    return n


NAMES = [
    "Apples, raw, with skin", "Apple juice, canned", "Babyfood, apples, strained", "Applesauce, sweetened (Apple sauce)", "Pineapple, raw", "Restaurant, apple pie", "Beverages, Apple drink", "Potatoes, boiled", "Potato", "Mice (mouse)", "Geese, roasted",
    "Berries, mixed (blueberries, raspberries)", "Glass, of water", "Bass", "Chicken's breast, fried", "Vitamin C (ascorbic acid)", "Vitamin B-12 (cobalamin)", "Total lipid (fat)", "Fatty acids, total saturated", "Iron, Fe", "Ascorbic", "", ",", "()", "School lunch",
    "Yogurt, plain (yoghurt)", "Appel, drid", "Strawberry",
]
QUERIES = ["apple", "aple", "app", "apple juice", "ascorbc acid", "fat", "the", "berries raw"]


@pytest.fixture(scope="module")
def known(spark, tmp_path_factory):
    d = ac.TermDictionary(spark, f"file://{tmp_path_factory.mktemp('terms')}")
    names = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "id int, name string")
    d.add(names.limit(9), "name")
    d.add(names, "name")
    return d, names


@pytest.mark.parametrize("q", QUERIES)
def test_points_equal_the_plain_rules(known, q):
    d, names = known
    typed = ac.Typed(q, d)
    got = {r["name"]: (r["f"], r["n"]) for r in names.select("name", ac.food_points(F.col("name"), typed).alias("f"), ac.nutrient_points(F.col("name"), typed).alias("n")).collect()}
    assert got == {n: (food(n, q), nutrient(n, q)) for n in NAMES}


def test_suggestions_come_in_order(known):
    d, names = known
    got = ac.suggested(names.unionByName(names), "id", "name", ac.food_points(F.col("name"), ac.Typed("aple", d)), 5).collect()
    want = sorted(((-food(n, "aple"), n, i) for i, n in enumerate(NAMES) if food(n, "aple") is not None))[:5]
    assert [(r["points"], r["name"]) for r in got] == [(-p, n) for p, n, _ in want]


def test_slips_equal_comparing_all(spark, tmp_path):
    rng = random.Random(3)
    make = lambda: "".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 12])))
    terms = sorted({make() for _ in range(150)} | {"ab" * 30, "ab" * 29 + "ba", "c" * 39, "c" * 41, "c" * 42})
    typed = sorted({make() for _ in range(60)} | {"ab" * 30 + "c", "c" * 40, "ba" + "ab" * 29})
    d = ac.TermDictionary(spark, f"file://{tmp_path}/d")
    d.add(spark.createDataFrame([(" ".join(terms),)], "name string"), "name")
    got = {tuple(r) for r in d.near(spark.createDataFrame([(w,) for w in typed], "word string")).collect()}
    assert got == {(q, w) for q in typed for w in {single(t) for t in terms} if slip(q, w)}
