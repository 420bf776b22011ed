"""Names for what is being typed: a dictionary of words found by what is left when letters are deleted, and points for names.

Two words at most d edits apart, or with two neighbouring letters swapped, have a common rest after at most d deletions in each. So the
dictionary is stored by rests, in the order of the rests; a typed word is looked up by its own, and only what meets is compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.plans.registry import Tables, query
from tessella.sources import shared

#: First parts of names that say little, words that are passed over, words of processing, hints of whole foods, odd plurals.
NOISY_PREFIXES = ("babyfood", "baby food", "fast foods", "beverages", "restaurant", "school lunch", "usda commodity")
STOPWORDS = ("and", "or", "with", "without", "in", "of", "for", "the", "a", "an", "to", "from")
PROCESSING_WORDS = (
    "juice", "sauce", "dessert", "babyfood", "baby", "yogurt", "pie", "blend", "concentrate", "canned", "bottled", "frozen", "dried", "strained", "sweetened", "unsweetened",
    "toasted", "microwaved", "cooked", "boiled", "baked", "fried", "roasted", "grilled", "stewed", "powder", "drink", "beverage",
)
WHOLE_FOOD_HINTS = ("raw", "fresh", "with", "skin", "without", "peel")
IRREGULAR = {"mice": "mouse", "geese": "goose", "teeth": "tooth", "feet": "foot", "children": "child", "men": "man", "women": "woman"}

#: Words up to this length are found by deletions, longer ones by comparing them with words of about their length.
LONGEST = 40


def plain(c: Column, keep: str = "") -> Column:
    """Lower case, apostrophes left out, everything but letters, digits and what is kept as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "['’]", ""), f"[^a-z0-9{keep}]+", " "))


def singular(w: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv]), w), text.singular_token(w))


def tokens(c: Column) -> Column:
    return F.transform(F.filter(F.split(plain(c), " "), lambda x: x != ""), singular)


def within(a: Column, b: Column) -> Column:
    """Whether two different words are a slip of the other: two letters swapped, or one edit from four letters on, two from eight on."""
    longer = F.greatest(F.length(a), F.length(b))
    most = F.when(longer >= 8, 2).when(longer >= 4, 1).otherwise(0)
    return (a != b) & (text.one_edit_apart(a, b) | ((most > 0) & (F.levenshtein(a, b) <= most)))


def rests(w: Column) -> Column:
    """A word, and what is left of it without one letter, or without two from six letters on."""
    without = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    none = F.array().cast("array<string>")
    one = F.when(F.length(w) >= 2, without(w)).otherwise(none)
    two = F.when(F.length(w) >= 6, F.flatten(F.transform(F.array_distinct(one), without))).otherwise(none)
    return F.array_distinct(F.concat(F.array(w), one, two))


class TermDictionary:
    """The words of names in a folder, by their rests."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, names: DataFrame, name: str) -> None:
        """Add the words of a column of names that aren't there yet; what is there stays."""
        # distinct names first: they are fewer, and dealt to all tasks, where a small file of many rows is read by one
        words = names.select(F.col(name).alias("name")).distinct().select(F.explode(tokens(F.col("name"))).alias("term")).distinct()
        if shared.exists(self.spark, f"{self.path}/terms"):
            words = words.join(self.spark.read.parquet(f"{self.path}/terms"), "term", "left_anti")
        words = words.withColumn("form", singular(F.col("term")))
        words.write.mode("append").parquet(f"{self.path}/terms")
        short = words.filter(F.length("form") <= LONGEST).select("term", "form", F.explode(rests(F.col("form"))).alias("rest"))
        short.repartitionByRange("rest").sortWithinPartitions("rest").write.mode("append").option("parquet.page.row.count.limit", 1000).parquet(f"{self.path}/rests")

    def near(self, words: DataFrame) -> DataFrame:
        """word, term of words(word) and the dictionary's words that are a slip of theirs."""
        w = words.select("word", singular(F.col("word")).alias("form")).distinct()
        short = w.select("word", F.col("form").alias("f"), F.explode(rests(F.col("form"))).alias("rest")).filter(F.length("f") <= LONGEST)
        found = short.join(self.spark.read.parquet(f"{self.path}/rests"), "rest").select("word", "f", "term", "form").distinct()
        # a long word is compared with those at most two letters longer or shorter
        sizes = F.explode(F.sequence(F.length("f") - 2, F.length("f") + 2))
        long = w.select("word", F.col("form").alias("f")).withColumn("size", sizes).filter((F.length("f") > LONGEST) | (F.col("size") > LONGEST))
        terms = self.spark.read.parquet(f"{self.path}/terms").withColumn("size", F.length("form"))
        found = found.unionByName(long.join(terms, "size").select("word", "f", "term", "form"))
        return found.filter(within(F.col("f"), F.col("form"))).select("word", "term").distinct()


def _has(c: Column, words: tuple[str, ...] | list[str]) -> Column:
    return c.isin(*words) if words else F.lit(False)


def _same(x: Column, q: str) -> Column:
    return (x == q) | (singular(x) == singular(F.lit(q)))


def _longer(x: Column, q: str) -> Column:
    return F.startswith(x, F.lit(q)) & ~_same(x, q) & (F.length(x) - len(q) >= 2)


def _place(words: Column, test) -> Column:
    """Where the first word that passes stands, from 0; -1 if none does."""
    return F.coalesce(F.array_position(F.transform(words, test), F.lit(True)) - 1, F.lit(-1)).cast("int")


class Typed:
    """What is typed: its words, and for each the dictionary's words that are a slip of it."""

    def __init__(self, q: str, dictionary: TermDictionary, stop: tuple[str, ...] = STOPWORDS):
        spark = dictionary.spark
        row = spark.range(1).select(plain(F.lit(q)).alias("p"), plain(F.lit(q), "()").alias("pp"), tokens(F.lit(q)).alias("t")).first()
        self.plain, self.with_parens = row["p"], row["pp"]
        self.words = [w for w in row["t"] if w not in stop]
        self.slips: dict[str, list[str]] = {w: [] for w in self.words}
        if self.words:
            for r in dictionary.near(spark.createDataFrame([(w,) for w in set(self.words)], "word string")).collect():  # the slips of a few words
                self.slips[r["word"]].append(r["term"])

    @property
    def generic(self) -> bool:
        return len(self.words) == 1

    def relation(self, words: Column, q: str) -> Column:
        """How a list of words has q: `kind` 1 itself, 2 as a longer word that begins with it, 3 as a slip, 0 not; and `at`, where the first of that kind is."""
        exact, longer, slip = _place(words, lambda x: _same(x, q)), _place(words, lambda x: _longer(x, q)), _place(words, lambda x: _has(x, self.slips[q]))
        places = F.struct(exact.alias("exact"), longer.alias("longer"), slip.alias("slip"))
        best = lambda p: F.when(p["exact"] >= 0, F.struct(F.lit(1).alias("kind"), p["exact"].alias("at"))).when(p["longer"] >= 0, F.struct(F.lit(2).alias("kind"), p["longer"].alias("at"))).otherwise(F.struct(F.when(p["slip"] >= 0, 3).otherwise(0).alias("kind"), p["slip"].alias("at")))
        return text.bound(places, best)

    def useless(self, *lists: Column) -> Column:
        """For a single word: whether none of the words has anything to do with it."""
        if not self.generic:
            return F.lit(False)
        q = self.words[0]
        one = F.concat(singular(F.lit(q)))
        forms = lambda x: (x == q) | (x == one) | (x == F.concat(one, F.lit("s"))) | (x == F.concat(one, F.lit("oes"))) | (F.endswith(one, F.lit("y")) & (x == F.concat(F.substring(one, F.lit(1), F.length(one) - 1), F.lit("ies"))))
        fits = lambda x: (forms(x) & (F.length(x) >= 2)) | F.startswith(x, F.lit(q)) | _has(x, self.slips[q])
        return ~F.exists(F.concat(*lists), fits)

    def prefix(self, words: Column) -> Column:
        """`least`: how many letters longer the nearest word that begins with the single typed word is (null: none); `at`: the first such word's place."""
        q = self.words[0]
        over = F.transform(words, lambda x: F.when(F.startswith(x, F.lit(q)), F.length(x) - len(q)))
        nearest = lambda o: text.bound(F.array_min(o), lambda least: F.struct(least.alias("least"), (F.array_position(o, least) - 1).cast("int").alias("at")))
        return text.bound(over, nearest)


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _of(test: Column, points: int) -> Column:
    return F.when(test, points).otherwise(0)


def _covered(typed: Typed, lists: list[tuple[Column, dict[int, int]]], whole: int, step: int) -> Column:
    """Points for each typed word by the best kind of match, over lists with their points by kind; for all being there; and for early places."""
    if not typed.words:
        return F.lit(0)

    def one(q: str) -> Column:
        found = F.struct(*[typed.relation(words, q).alias(f"r{i}") for i, (words, _) in enumerate(lists)])

        def scored(r: Column) -> Column:
            got = F.lit(0)
            for kind in (3, 2, 1):
                for i, (_, points) in reversed(list(enumerate(lists))):
                    got = F.when(r[f"r{i}"]["kind"] == kind, points[kind]).otherwise(got)
            at = F.array_min(F.array(*[F.when(r[f"r{i}"]["at"] >= 0, r[f"r{i}"]["at"]) for i in range(len(lists))]))
            return text.bound(got, lambda g: F.struct(g.alias("got"), F.when(g > 0, at).alias("at")))

        return text.bound(found, scored)

    n = len(typed.words)

    def total(every: Column) -> Column:
        matched = F.size(F.filter(every, lambda x: x["got"] > 0))
        first = F.array_min(F.transform(every, lambda x: x["at"]))
        points = F.aggregate(every, F.lit(0), lambda s, x: s + x["got"])
        return points + F.when(matched == n, whole).otherwise((matched - n) * 180) + F.coalesce(first * -step, F.lit(0))

    return text.bound(F.array(*map(one, typed.words)), total)


def _near(typed: Typed, has, lists: list[tuple[Column, int, int, int]]) -> list[Column]:
    """Points for lists without the single typed word by their nearest word that begins with it; (list, most, less by letter, less by place)."""

    def one(c: Column, top: int, by: int, step: int) -> Column:
        points = lambda p: F.when(~has(c) & p["least"].isNotNull(), F.greatest(top - p["least"] * by, F.lit(0)) - p["at"] * step).otherwise(0)
        return text.bound(typed.prefix(c), points)

    return [one(*x) for x in lists]


def food_points(name: Column, typed: Typed) -> Column:
    """Points of a food's name (its base before the first comma, aliases in brackets) for what is typed; null if it has nothing to do with it."""
    parts_of = F.filter(F.transform(F.split(name, ","), lambda x: F.trim(x)), lambda x: x != "")
    noisy = lambda x: (F.size(x) > 1) & _has(plain(F.get(x, F.lit(0))), NOISY_PREFIXES)
    base = text.bound(parts_of, lambda x: F.coalesce(F.when(noisy(x), F.get(x, F.lit(1))).otherwise(F.get(x, F.lit(0))), name))
    # each step is bound, so that a name is taken apart once, however often its parts are used
    first = F.struct(name.alias("name"), base.alias("base"), _aliases(name).alias("aliases"))
    forms = lambda x: F.struct(x["name"], plain(x["name"]).alias("plain_name"), plain(x["base"]).alias("plain_base"), F.transform(x["aliases"], plain).alias("plain_aliases"), tokens(x["name"]).alias("words"), tokens(x["base"]).alias("own"), tokens(F.array_join(x["aliases"], " ")).alias("other"))
    return text.bound(first, lambda x: text.bound(forms(x), lambda y: _food_points(y, typed)))


def _aliases(name: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(name, F.lit(r"\(([^)]+)\)"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")


def _food_points(x: Column, typed: Typed) -> Column:
    name, plain_name, plain_base, plain_aliases, words, own, other = (x[c] for c in ("name", "plain_name", "plain_base", "plain_aliases", "words", "own", "other"))
    p, g = F.lit(typed.plain), typed.generic
    first = lambda c: F.get(c, F.lit(0)).eqNullSafe(F.lit(typed.words[0] if typed.words else None).cast("string"))
    parts = [
        _of(plain_name == p, 2000), _of(plain_base == p, 1700), _of(F.exists(plain_aliases, lambda a: a == p), 1600),
        _of(F.startswith(plain_name, p), 900), _of(F.startswith(plain_base, p), 1200), _of(F.exists(plain_aliases, lambda a: F.startswith(a, p)), 800),
        _of(first(words), 180), _of(first(own), 260), _of(first(other), 180),
    ]
    lists = [(own, {1: 260, 2: 180 if g else 80, 3: 130 if g else 60}), (words, {1: 180, 2: 120 if g else 40, 3: 90 if g else 45}), (other, {1: 170, 2: 110 if g else 30, 3: 80 if g else 35})]
    parts.append(_covered(typed, lists, 260, 35))
    parts += [F.greatest(F.size(own) - max(len(typed.words), 1), F.lit(0)) * -18, F.greatest(F.size(words) - F.size(own), F.lit(0)) * -10]
    if g:
        q = typed.words[0]
        count = lambda test: F.size(F.filter(words, test))
        has = lambda c: F.exists(c, lambda x: _same(x, q))
        after = F.transform(words, lambda x, i: _same(x, q) & F.coalesce(_has(F.get(words, i + 1), PROCESSING_WORDS), F.lit(False)))
        parts += [
            count(lambda x: _has(x, PROCESSING_WORDS) & (x != q)) * -55, _of(F.coalesce((F.get(own, F.lit(0)) == q) | (F.get(words, F.lit(0)) == q), F.lit(False)), 120),
            _of(has(own), 220), _of(has(words), 100), _of(has(other), 150), F.least(count(lambda x: _has(x, WHOLE_FOOD_HINTS)), F.lit(2)) * 45, count(lambda x: _longer(x, q)) * -140,
            _of(F.exists(after, lambda x: x), -180), _of(F.exists(words, lambda x: x.isin("babyfood", "baby")), -180), _of(F.array_contains(words, "restaurant"), -180),
        ]
        parts += _near(typed, has, [(own, 260, 70, 25), (words, 170, 55, 18), (other, 200, 60, 10)])
    parts.append(F.regexp_count(name, F.lit(",")) * -8)
    return F.when(~typed.useless(words, other), _sum(parts)).cast("int")


def nutrient_points(name: Column, typed: Typed) -> Column:
    """Points of a nutrient's name (aliases in brackets) for what is typed; null if it has nothing to do with it."""
    forms = lambda aliases: F.struct(F.transform(aliases, plain).alias("plain_aliases"), plain(name, "()").alias("whole"), tokens(name).alias("words"), tokens(F.array_join(aliases, " ")).alias("other"))
    return text.bound(_aliases(name), lambda x: text.bound(forms(x), lambda y: _nutrient_points(y, typed)))


def _nutrient_points(x: Column, typed: Typed) -> Column:
    plain_aliases, whole, words, other = (x[c] for c in ("plain_aliases", "whole", "words", "other"))
    p, g, q = F.lit(typed.with_parens), typed.generic, typed.words[0] if typed.words else ""
    first = lambda c: F.coalesce(F.get(c, F.lit(0)) == q, F.lit(False))
    parts = [
        _of(whole == p, 2000), _of(F.exists(plain_aliases, lambda a: a == p), 1800), _of(F.startswith(whole, p), 900), _of(F.exists(plain_aliases, lambda a: F.startswith(a, p)), 1000),
        _of(first(words), 220), _of(first(other), 260),
    ]
    lists = [(other, {1: 240, 2: 150 if g else 50, 3: 95 if g else 45}), (words, {1: 180, 2: 110 if g else 30, 3: 80 if g else 35})]
    parts.append(_covered(typed, lists, 220, 30))
    parts.append(F.greatest(F.size(words) - max(len(typed.words), 1), F.lit(0)) * -20)
    if g:
        has = lambda c: F.exists(c, lambda x: _same(x, q))
        parts += [_of(has(other), 280), _of(has(words), 120), F.size(F.filter(words, lambda x: _longer(x, q))) * -180]
        parts += _near(typed, has, [(other, 240, 60, 8), (words, 140, 45, 14)])
    return F.when(~typed.useless(words, other), _sum(parts)).cast("int")


def suggested(names: DataFrame, key: str, name: str, points: Column, limit: int = 15) -> DataFrame:
    """The first names by points, then by name and key; a name of one key counts once."""
    d = names.select(key, name).repartition(key).select(key, name, points.alias("points")).filter("points > -5000").dropDuplicates([key])
    return d.orderBy(F.col("points").desc(), name, key).limit(limit)


@query(
    "dictionary_slips",
    """
WITH w AS (SELECT DISTINCT unnest(string_split(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')), ' ')) AS term FROM part),
f AS (SELECT term, CASE WHEN term LIKE '%s' AND length(term) > 3 AND NOT term LIKE '%ss' AND NOT term LIKE '%us' AND NOT term LIKE '%is' THEN left(term, length(term) - 1) ELSE term END AS form FROM w),
q(word) AS (VALUES ('wigdet'), ('colld'), ('gadge'), ('smal'), ('brokn'), ('ecnomy'), ('standrad'), ('bras'), ('od'), ('stnadard'))
SELECT DISTINCT word, term FROM f, q WHERE word <> form AND ((greatest(length(word), length(form)) >= 4 AND levenshtein(word, form) <= CASE WHEN greatest(length(word), length(form)) >= 8 THEN 2 ELSE 1 END)
  OR (length(word) = length(form) AND len([i for i in range(1, length(word)) if substr(word, 1, i - 1) || substr(word, i + 1, 1) || substr(word, i, 1) || substr(word, i + 2) = form]) > 0))
""",
)
def dictionary_slips(t: Tables) -> DataFrame:
    """The words of the parts' names and kinds that mistyped words may stand for, from a stored dictionary."""
    d = TermDictionary(t.spark, shared.shared_dir(t.spark, "dictionary"))
    names = t.part.select(F.concat_ws(" ", "p_name", "p_type").alias("name"))
    d.add(names, "name")
    words = ("wigdet", "colld", "gadge", "smal", "brokn", "ecnomy", "standrad", "bras", "od", "stnadard")
    return d.near(t.spark.createDataFrame([(w,) for w in words], "word string"))


@query("food_autocomplete")
def food_autocomplete(t: Tables) -> DataFrame:
    """A top-k report: the best parts for a mistyped word, with kinds as parts of the name and brands as aliases; tests compare the points."""
    names = t.part.select("p_partkey", F.concat(F.col("p_name"), F.lit(", "), F.col("p_type"), F.lit(" ("), F.col("p_brand"), F.lit(")")).alias("name"))
    d = TermDictionary(t.spark, shared.shared_dir(t.spark, "dictionary"))
    d.add(names, "name")
    return suggested(names, "p_partkey", "name", food_points(F.col("name"), Typed("wigdet", d)))
