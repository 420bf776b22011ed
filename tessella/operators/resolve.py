"""Finding a food for words, and grams for a quantity: search over release tables, decisions over candidates, portions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.plans.registry import Tables, query

from .lexical import bm25, corpus_stats, postings
from .relational import best
from .text_index import TextIndex

#: The kinds of source terms, best first, and the column weights of the two indexes.
TERM_KINDS = ("common_name", "foodon_label")
NAME_WEIGHTS = {"display_name": 8.0, "normalized_description": 3.0, "category_name": 1.0}
TERM_WEIGHT = 6.0


def query_tokens(q: str) -> list[str]:
    """The distinct words of a query, in order; operators and quotes are text."""
    import re

    return list(dict.fromkeys(re.findall(r"[^\W_]+", q.lower())))


def _searchable(foods: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = foods.filter("is_searchable")
    return own, terms.join(own.select("food_id"), "food_id", "left_semi").withColumn("term_key", F.struct("food_id", "term", "term_type"))


def release_indexes(foods: DataFrame, terms: DataFrame, path: str) -> tuple[TextIndex, TextIndex]:
    """Stored indexes of a release's searchable foods and of their source terms, for `search_release`."""
    own, named = _searchable(foods, terms)
    out = TextIndex(foods.sparkSession, f"{path}/foods"), TextIndex(foods.sparkSession, f"{path}/terms")
    out[0].add(own, "food_id", NAME_WEIGHTS)
    out[1].add(named, "term_key", {"term": TERM_WEIGHT})
    return out


def search_release(foods: DataFrame, terms: DataFrame, q: str, limit: int = 20, offset: int = 0, indexes: tuple[TextIndex, TextIndex] | None = None) -> dict:
    """match_mode, matched_terms, total, and items (a DataFrame) of a prefix search over release tables.

    foods(food_id, display_name, normalized_description, category_name, search_priority, is_searchable),
    terms(food_id, term, term_type). All words must match a food's own texts or one of its source terms; if nothing
    does, the largest set of the first six words that matches something is used, of these the most selective. Order: exact
    name, name that begins with the query, good source terms, others; then priority, relevance, length, name, id.

    With ``indexes`` (of `release_indexes`) only the query's terms are read; without them, all texts are.
    """
    tokens = query_tokens(q)
    if not tokens:
        raise ValueError("the query has no searchable word")
    limit, offset = max(1, min(limit, 50)), max(0, min(offset, 10_000))
    own, named = _searchable(foods, terms)
    if indexes is None:
        post, term_post = postings(own, "food_id", NAME_WEIGHTS), postings(named, "term_key", {"term": TERM_WEIGHT})

    def hits(words: list[str]) -> tuple[DataFrame, DataFrame]:
        if indexes is not None:
            return indexes[0].search(words), indexes[1].search(words)
        return bm25(post, corpus_stats(post), words), bm25(term_post, corpus_stats(term_post), words)

    def marks(words: list[str]) -> DataFrame:
        """Which words each food's texts, and each term, have."""
        if indexes is not None:
            return indexes[0].matches(words).unionByName(indexes[1].matches(words).withColumn("key", F.col("key.food_id")))
        has = lambda w: F.exists("tokens", lambda t: F.startswith(t["token"], F.lit(w)))
        mask = lambda p, key: p.select(F.col(key).alias("key"), *[has(w).alias(f"w{i}") for i, w in enumerate(words)])
        return mask(post, "key").unionByName(mask(term_post, "key.food_id"))

    mode, words = "all_terms", tokens
    if len(tokens) > 1:
        # one pass tells the count of every subset
        first = tokens[:6]
        sets = [list(c) for n in range(len(first) - 1, 0, -1) for c in combinations(range(len(first)), n)]
        every = lambda at: F.count_distinct(F.when(F.expr(" AND ".join(f"w{i}" for i in at)), F.col("key")))
        counts = marks(tokens).agg(*[every(at).alias(str(k)) for k, at in enumerate([list(range(len(tokens))), *sets])]).first()
        if not counts["0"]:
            found = [(-len(at), counts[str(k)], [first[i] for i in at]) for k, at in enumerate(sets, 1) if counts[str(k)]]
            if found:
                mode, words = "partial_terms", min(found)[2]
    primary, via_terms = hits(words)
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, TERM_KINDS)), F.col("term_type")), F.lit(0))
    rank = F.when(kind > 0, kind - 1).otherwise(len(TERM_KINDS))
    source = via_terms.select("key.*", F.col("score").alias("source_score"))
    source = best(source, ["food_id"], rank, F.when(F.lower("term") == q.strip().lower(), 0).otherwise(1), F.col("source_score"), F.length("term"), F.col("term"))
    both = primary.select(F.col("key").alias("food_id"), F.col("score").alias("name_score")).join(source, "food_id", "full")
    name = F.lower("display_name")
    tier = F.when(name == q.strip().lower(), 0).when(F.startswith(name, F.lit(q.strip().lower())), 1).when(F.col("term_type").isin(*TERM_KINDS), 2).when(F.col("term_type") == "additional_description", 3).otherwise(4)
    via = F.col("name_score").isNotNull()
    items = both.join(own.select("food_id", "display_name", "category_name", "search_priority"), "food_id").select(
        "food_id", "display_name", "category_name", "search_priority", tier.alias("match_tier"), F.coalesce("name_score", "source_score").alias("relevance"), F.when(via, "primary_name").otherwise("source_term").alias("matched_via"),
        F.when(via, F.col("display_name")).otherwise(F.col("term")).alias("matched_term"), F.when(via, "primary_name").otherwise(F.col("term_type")).alias("matched_term_type"),
    )
    total = items.count()
    items = items.orderBy("match_tier", F.col("search_priority").desc(), "relevance", F.length("display_name"), "display_name", "food_id")
    return {"match_mode": mode, "matched_terms": words, "total": total, "items": items.offset(offset).limit(limit)}


def food_detail(foods: DataFrame, nutrients: DataFrame, portions: DataFrame, factors: DataFrame) -> DataFrame:
    """Each food with its nutrients, portions and weight factors as ordered lists of structs; all four tables share food_id."""
    listed = lambda df, name, *order: df.groupBy("food_id").agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in ("food_id", *order)]))).alias(name))
    d = foods
    for df, name, order in ((nutrients, "nutrients", "nutrient_order"), (portions, "portions", "sequence_number"), (factors, "weight_factors", "factor_id")):
        d = d.join(listed(df, name, order), "food_id", "left")
    return d


def autocomplete(rows: DataFrame, key: str, name: str, q: str, limit: int = 15) -> DataFrame:
    """key, name and points of the best names for what is typed: whole and leading matches, words by how they match, coverage, length."""
    typed = " ".join(query_tokens(q))
    tokens = query_tokens(q)
    plain, w = F.array_join(text.words(F.col(name)), " "), text.words(F.col(name))
    base = text.words(F.element_at(F.split(F.col(name), ","), 1))
    most = lambda t: 2 if len(t) >= 8 else 1 if len(t) >= 4 else 0
    points = F.when(plain == typed, 2000).otherwise(0) + F.when(F.startswith(plain, F.lit(typed)), 900).otherwise(0) + F.when(F.get(w, F.lit(0)) == tokens[0], 180).otherwise(0)
    matched = F.lit(0)
    for t in tokens:
        exact = F.array_contains(w, t)
        derived = F.exists(w, lambda x: F.startswith(x, F.lit(t)) & (F.length(x) >= len(t) + 2))  # noqa: B023
        near = F.exists(w, lambda x: (F.levenshtein(x, F.lit(t)) <= most(t)) | text.one_edit_apart(F.lit(t), x))  # noqa: B023
        got = F.when(F.array_contains(base, t), 260).when(exact, 180).when(derived, 120 if len(tokens) == 1 else 40).when(near, 90 if len(tokens) == 1 else 45).otherwise(0)
        points, matched = points + got, matched + F.when(got > 0, 1).otherwise(0)
    points = points + F.when(matched == len(tokens), 260).otherwise((matched - len(tokens)) * 180)
    points = points - F.greatest(F.size(base) - len(tokens), F.lit(0)) * 18 - (F.size(w) - F.size(base)) * 10 - (F.size(F.split(F.col(name), ",")) - 1) * 8
    d = rows.select(key, name, points.cast("int").alias("points"), matched.alias("matched")).filter("matched > 0").drop("matched")
    return d.orderBy(F.col("points").desc(), F.length(name), name, key).limit(limit)


@query(
    "autocomplete_score",
    """
WITH w AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS w FROM part),
m AS (SELECT *, CASE WHEN list_contains(w, 'smal') THEN 260 WHEN len([x FOR x IN w IF starts_with(x, 'smal') AND length(x) >= 6]) > 0 THEN 40 WHEN len([x FOR x IN w IF levenshtein(x, 'smal') <= 1 OR (length(x) = 4 AND x IN ('msal', 'saml', 'smla'))]) > 0 THEN 45 ELSE 0 END AS a,
  CASE WHEN list_contains(w, 'wid') THEN 260 WHEN len([x FOR x IN w IF starts_with(x, 'wid') AND length(x) >= 5]) > 0 THEN 40 WHEN len([x FOR x IN w IF x = 'wid' OR x IN ('iwd', 'wdi')]) > 0 THEN 45 ELSE 0 END AS b FROM w),
p AS (SELECT p_partkey, p_name, CAST(a + b + CASE WHEN starts_with(p_name, 'smal wid') THEN 900 ELSE 0 END + CASE WHEN w[1] = 'smal' THEN 180 ELSE 0 END + CASE WHEN a > 0 AND b > 0 THEN 260 ELSE (CASE WHEN a > 0 THEN 1 ELSE 0 END + CASE WHEN b > 0 THEN 1 ELSE 0 END - 2) * 180 END
  - greatest(len(w) - 2, 0) * 18 AS INTEGER) AS points FROM m WHERE a > 0 OR b > 0)
SELECT p_partkey, p_name, points FROM p ORDER BY points DESC, length(p_name), p_name, p_partkey LIMIT 15
""",
)
def autocomplete_score(t: Tables) -> DataFrame:
    """A top-k report: names for `smal wid`."""
    return autocomplete(t.part, "p_partkey", "p_name", "smal wid")


#: Words of units, sizes and states, as the resolution rules know them.
GRAMS = ("g", "gr", "gram", "grams", "gramme", "grammes")
KILOGRAMS = ("kg", "kilogram", "kilograms", "kilo")
SIZES = ("small", "medium", "large", "extra", "thin", "thick", "regular")
COUNTS = ("piece", "item", "adet", "tane")
COOKED = ("boiled", "fried", "baked", "roasted", "grilled")
STATES = ("raw", "cooked", *COOKED, "drained", "skin", "skinless", "bone", "boneless")
NOT_ITEMS = r"(?i)\b(cups?|tbsp|tablespoons?|tsp|teaspoons?|fluid ounces?|fl oz|ounces?|oz|grams?|kilograms?|kg|g|pounds?|lbs?|milliliters?|millilitres?|ml|liters?|litres?|packages?|packets?|containers?|cans?|bottles?|jars?|slices?|wedges?|inches?|cm|linear|servings?|quantity not specified)\b"


def _signature(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(text.words(c), text.singular)))


def decide(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, food_id, decision for each request: `direct` if its first candidate is certain and no other competes, else `review`.

    candidates(keys, rank, food_id, name, query, spoken, match_tier, term_exact, term_type). Certain: the name itself, the same
    words, an exact good source term, or a name that holds all words of the query and begins with one. Never certain: names that
    leave the kind open, and states (raw, cooked, drained, skin, bone) that the request doesn't mention.
    """
    q, n = _signature(F.col("query")), _signature(F.col("name"))
    alias = F.coalesce(F.col("term_exact") & F.col("term_type").isin(*TERM_KINDS), F.lit(False))
    direct = F.coalesce(F.col("match_tier") == 0, F.lit(False))
    head = (F.size(q) > 0) & (F.size(F.array_except(q, n)) == 0) & F.array_contains(q, text.singular(F.get(text.words(F.col("name")), F.lit(0))))
    states = F.array(*map(F.lit, STATES))
    has, said = F.array_intersect(text.words(F.col("name")), states), F.array_intersect(text.words(F.concat_ws(" ", "spoken", "query")), states)
    both = F.array_intersect(has, said)
    cooked = F.array(*map(F.lit, COOKED))
    only = lambda *w: F.arrays_overlap(has, F.array(*map(F.lit, w))) & ~F.arrays_overlap(both, F.array(*map(F.lit, w)))
    plainly = F.array_contains(has, "cooked") & ~F.arrays_overlap(has, cooked) & ~F.array_contains(has, "raw") & ~F.arrays_overlap(said, F.array(*map(F.lit, ("cooked", *COOKED))))
    ask = only("raw") | only(*COOKED) | plainly | only("drained") | only("skin", "skinless") | only("bone", "boneless")
    vague = F.col("name").rlike(r"(?i)\bNFS\b|\bNS\b|not specified")
    c = candidates.withColumns({"__sure": direct | alias | (q == n), "__head": head, "__rival": direct | alias, "__no": vague | ask})
    first = F.col("rank") == 1
    g = c.groupBy(*keys).agg(
        F.max(F.when(first, F.col("food_id"))).alias("food_id"), F.bool_or(first & F.col("__sure") & ~F.col("__no")).alias("sure"), F.bool_or(first & F.col("__head") & ~F.col("__no")).alias("head"),
        F.bool_or(~first & F.col("__rival")).alias("rival"), F.bool_or(~first & F.col("__head")).alias("rival_head"),
    )
    certain = (F.col("sure") | (F.col("head") & ~F.col("rival_head"))) & ~F.col("rival")
    return g.select(*keys, "food_id", F.when(certain, "direct").otherwise("review").alias("decision"))


#: Portions that are sent to all tasks: about 200 bytes each.
SENT_PORTIONS = 200_000


def grams_of(requests: DataFrame, portions: DataFrame, key: str) -> DataFrame:
    """requests with grams, portion_id and state: weights directly, else the only portion with the unit, the size words, or the item.

    requests(key, food_id, value, unit, phrase), portions(food_id, portion_id, description, amount, gram_weight).
    """
    unit = F.lower(F.trim(F.coalesce("unit", F.lit(""))))
    sizes = F.array(*map(F.lit, SIZES))
    said = text.words(F.col("phrase"))
    r = requests.withColumn("__u", unit).withColumn("__size", F.array_sort(F.array_intersect(said, sizes)))
    stem = F.regexp_replace("__u", "s+$", "")
    r = r.withColumns({"__stem": stem, "__counted": F.coalesce(text.singular(F.col("__u")).isin(*COUNTS) | F.array_contains(F.transform(said, text.singular), text.singular(F.col("__u"))), F.lit(False))})
    # a food's portions are one list, which each request filters: requests are neither grouped nor sorted
    one = F.coalesce(F.nullif(F.col("amount"), F.lit(0)), F.lit(1))
    words = text.words(F.col("description"))
    portion = F.struct(words.alias("words"), F.array_sort(F.array_intersect(words, sizes)).alias("size"), ((one == 1) & ~F.col("description").rlike(NOT_ITEMS)).alias("item"), "portion_id", (F.col("gram_weight") / one).alias("each"))
    of_food = portions.groupBy("food_id").agg(F.collect_list(portion).alias("__portions"))
    if portions.count() <= SENT_PORTIONS:
        of_food = F.broadcast(of_food)
    r = r.join(of_food, "food_id", "left")
    tests = {
        "__by_unit": lambda p: (F.col("__stem") != "") & (F.array_contains(p["words"], F.col("__stem")) | F.array_contains(p["words"], F.concat("__stem", F.lit("s")))),
        "__by_size": lambda p: (F.size("__size") > 0) & (p["size"] == F.col("__size")),
        "__by_item": lambda p: F.col("__counted") & p["item"],
    }
    out = r.withColumns({name: F.filter("__portions", ok) for name, ok in tests.items()})
    only = F.coalesce(*[F.when(F.size(name) == 1, F.get(name, F.lit(0))) for name in tests])
    known = F.col("value").isNotNull() & (F.col("__u") != "")
    grams = F.when(F.col("__u").isin(*GRAMS), F.col("value")).when(F.col("__u").isin(*KILOGRAMS), F.col("value") * 1000).otherwise(F.col("value") * only["each"])
    by_weight = F.col("__u").isin(*GRAMS, *KILOGRAMS)
    out = out.withColumns({"grams": F.when(known, grams), "portion_id": F.when(known & ~by_weight, only["portion_id"])})
    return out.withColumn("state", F.when(F.col("grams").isNotNull(), "resolved").otherwise("unresolved")).select(*requests.columns, "grams", "portion_id", "state")


def weight_basis(said: Column, phrase: Column, name: Column, usable_factor: Column) -> Column:
    """as_purchased where said so and a factor is there; edible, unless bones, shells, pits, cores or peel leave it open (null)."""
    bought = (said == "as_purchased") & phrase.rlike(r"(?i)\b(as purchased|with (?:the )?(?:bone|shell|peel|skin|pit|core)s?|whole|unpeeled|in shell)\b")
    parts = F.concat_ws(" ", phrase, name).rlike(r"(?i)\b(bone|shell|pit|core|peel|kemik|kabuk)\b")
    return F.when(bought, F.when(usable_factor, "as_purchased")).when(said == "edible", "edible").when(~parts, "edible")


def assemble(items: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """items(keys, food_id, alternatives, missing) with only those ids that were candidates, and what is unresolved, once each.

    candidates(keys, food_id). A chosen food that was no candidate is dropped and `food` is unresolved.
    """
    offered = candidates.groupBy(*keys).agg(F.collect_set("food_id").alias("__ids"))  # a request's candidates: a dozen
    d = items.join(offered, keys, "left").withColumn("__ids", F.coalesce("__ids", F.array().cast("array<string>")))
    ok = F.array_contains("__ids", F.col("food_id"))
    open_ = F.array_distinct(F.concat(F.when(F.coalesce(ok, F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit("food"))), F.coalesce("missing", F.array().cast("array<string>"))))
    alternatives = F.filter(F.array_distinct("alternatives"), lambda x: F.array_contains("__ids", x) & (x != F.coalesce("food_id", F.lit(""))))
    return d.select(*keys, F.when(ok, F.col("food_id")).alias("food_id"), F.slice(alternatives, 1, 4).alias("alternatives"), open_.alias("unresolved"))


@query(
    "decisions",
    """
WITH c AS (SELECT l_orderkey, p_partkey, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rank FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, CAST(max(p_partkey) FILTER (rank = 1) AS VARCHAR) AS food_id,
  CASE WHEN bool_or(rank = 1 AND list_sort(list_distinct(string_split(p_name, ' '))) = ['cold', 'widget']) AND NOT coalesce(bool_or(p_name = 'cold widget') FILTER (rank > 1), false) THEN 'direct' ELSE 'review' END AS decision
FROM c GROUP BY l_orderkey
""",
)
def decisions(t: Tables) -> DataFrame:
    """Order lines as ranked candidates for `cold widget`."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    c = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).withColumn("rank", F.row_number().over(order))
    c = c.select("l_orderkey", "rank", F.col("p_partkey").cast("string").alias("food_id"), F.col("p_name").alias("name"), F.lit("cold widget").alias("query"), F.lit("").alias("spoken"))
    c = c.withColumns({"match_tier": F.when(F.col("name") == "cold widget", 0).otherwise(4), "term_exact": F.lit(False), "term_type": F.lit(None).cast("string")})
    return decide(c, ["l_orderkey"])


@query(
    "portion_grams",
    """
WITH r AS (SELECT o_orderkey, o_custkey % 3 AS food, o_orderkey % 7 + 1 AS v, ['g', 'kg', 'cups', 'piece', 'bowl'][o_orderkey % 5 + 1] AS u, CASE WHEN o_orderkey % 2 = 0 THEN 'a large one' ELSE 'one' END AS ph FROM orders)
SELECT o_orderkey, CAST(CASE u WHEN 'g' THEN v WHEN 'kg' THEN v * 1000 WHEN 'cups' THEN CASE food WHEN 0 THEN v * 120 WHEN 1 THEN CASE WHEN ph = 'a large one' THEN v * 60 END WHEN 2 THEN v * 75 END
   WHEN 'piece' THEN CASE food WHEN 0 THEN CASE WHEN ph = 'a large one' THEN v * 200 END WHEN 1 THEN CASE WHEN ph = 'a large one' THEN v * 60 ELSE v * 60 END END
   ELSE CASE WHEN food = 0 AND ph = 'a large one' THEN v * 200 WHEN food = 1 AND ph = 'a large one' THEN v * 60 END END AS DOUBLE) AS grams FROM r
""",
)
def portion_grams(t: Tables) -> DataFrame:
    """Quantities of orders by a small table of portions."""
    p = t.spark.createDataFrame([(0, "a", "1 cup", 1.0, 120.0), (0, "b", "1 large", 1.0, 200.0), (0, "c", "1 small", 1.0, 100.0), (1, "d", "1 large", 1.0, 60.0), (1, "e", "1 slice", 1.0, 9.0), (2, "f", "2 cups", 2.0, 150.0), (2, "g", "1 slice", 1.0, 9.0)], "food_id int, portion_id string, description string, amount double, gram_weight double")
    u = F.element_at(F.array(*map(F.lit, ("g", "kg", "cups", "piece", "bowl"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    r = t.orders.select("o_orderkey", (F.col("o_custkey") % 3).cast("int").alias("food_id"), (F.col("o_orderkey") % 7 + 1).cast("double").alias("value"), u.alias("unit"), F.when(F.col("o_orderkey") % 2 == 0, "a large one").otherwise("one").alias("phrase"))
    return grams_of(r, p, "o_orderkey").select("o_orderkey", "grams")
