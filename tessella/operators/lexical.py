"""Ranked text search over postings: prefix terms, BM25 with column weights, alias union, tiers, partial terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.plans.registry import Tables, query

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """key, length and the list of (token, weight) of all weighted columns, a row for each document."""
    weighed = lambda w: lambda t: F.struct(t.alias("token"), F.lit(w).alias("weight"))
    cols = [F.transform(text.words(F.col(c)), weighed(w)) for c, w in weights.items()]
    return docs.select(F.col(key).alias("key"), F.flatten(F.array(*cols)).alias("tokens")).withColumn("length", F.size("tokens")).filter("length > 0")


def bm25(post: DataFrame, stats: DataFrame, terms: list[str]) -> DataFrame:
    """key and score (lower is better) of documents that have a token beginning with each term.

    stats has one row (docs, avg_length). Each term's document frequency counts its prefix matches.
    """
    # each term's weight is summed up inside the document's list, so a document gives a row for each term that it has, and needs no shuffle
    total = lambda x: F.aggregate(F.filter("tokens", lambda t: F.startswith(t["token"], F.lit(x))), F.lit(0.0), lambda s, t: s + t["weight"])
    each = F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("term"), total(x).alias("f")) for i, x in enumerate(terms)]), lambda h: h["f"] > 0)).alias("h")
    hits = post.select("key", "length", each).select("key", "length", "h.term", "h.f")
    df = hits.groupBy("term").agg(F.count("*").alias("n"))
    h = hits.join(F.broadcast(df), "term").join(F.broadcast(stats), F.lit(True))  # a row for each query term; one row
    idf = F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    return h.groupBy("key").agg((-F.sum(part)).alias("score"), F.count("*").alias("terms")).filter(F.col("terms") == len(terms)).drop("terms")


def corpus_stats(post: DataFrame) -> DataFrame:
    return post.agg(F.count("*").alias("docs"), F.avg("length").alias("avg_length"))


_POST = """
p AS (SELECT p_partkey AS key, unnest(list_concat([{'t': x, 'w': 8.0::DOUBLE} for x in regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+')],
  [{'t': x, 'w': 3.0::DOUBLE} for x in regexp_extract_all(lower(p_type), '[\\p{L}\\p{N}]+')])) AS u,
  len(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+')) + len(regexp_extract_all(lower(p_type), '[\\p{L}\\p{N}]+')) AS length FROM part),
s AS (SELECT count(*) AS docs, avg(length) AS avg_length FROM (SELECT key, any_value(length) AS length FROM p GROUP BY key)),
"""
_RANK = """
h AS (SELECT key, length, term, sum(u.w) AS f FROM p, q WHERE starts_with(u.t, prefix) GROUP BY ALL),
n AS (SELECT term, count(*) AS n FROM h GROUP BY term),
m AS (SELECT key, -sum((CASE WHEN ln((docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - n + 0.5) / (n + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / avg_length))) AS score, count(*) AS c
  FROM h JOIN n USING (term), s GROUP BY key)
"""


def search(parts: DataFrame, terms: list[str], limit: int = 20, offset: int = 0) -> DataFrame:
    """Names first, then brands as aliases; exact names, names that begin with the query, alias matches, others."""
    post = postings(parts, "p_partkey", {"p_name": 8.0, "p_type": 3.0})
    name_hits = bm25(post, corpus_stats(post), terms).select("key", F.lit("name").alias("via"), F.col("score"))
    phrase = " ".join(terms)
    brand = F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]+", " "))
    alias = parts.filter(F.startswith(brand, F.lit(phrase))).select(F.col("p_partkey").alias("key"), F.lit("brand").alias("via"), F.lit(0.0).alias("score"))
    best = Window.partitionBy("key").orderBy(F.when(F.col("via") == "name", 0).otherwise(1), "score")
    both = name_hits.unionByName(alias).withColumn("rn", F.row_number().over(best)).filter("rn = 1").drop("rn")
    d = both.join(parts.select(F.col("p_partkey").alias("key"), "p_name", "p_brand"), "key")
    name = F.lower("p_name")
    tier = F.when(name == phrase, 0).when(F.startswith(name, F.lit(phrase)), 1).when(F.col("via") == "brand", 2).otherwise(3)
    d = d.select("key", "p_name", "p_brand", "via", tier.alias("tier"), F.round("score", 6).alias("score"))
    return d.orderBy("tier", "score", F.length("p_name"), "p_name", "key").offset(offset).limit(limit)


@query(
    "search_ranked",
    "WITH " + _POST + "q(term, prefix) AS (VALUES (0, 'cold'), (1, 'wid')),\n" + _RANK + """
, a AS (SELECT key, 'name' AS via, score FROM m WHERE c = 2 UNION ALL SELECT p_partkey, 'brand', 0.0 FROM part WHERE starts_with(lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', ' ', 'g')), 'cold wid')),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE WHEN via = 'name' THEN 0 ELSE 1 END, score) = 1)
SELECT key, p_name, p_brand, via, CAST(CASE WHEN lower(p_name) = 'cold wid' THEN 0 WHEN starts_with(lower(p_name), 'cold wid') THEN 1 WHEN via = 'brand' THEN 2 ELSE 3 END AS INTEGER) AS tier, round(score, 6) AS score
FROM b JOIN part ON p_partkey = key ORDER BY tier, score, length(p_name), p_name, key LIMIT 20
""",
)
def search_ranked(t: Tables) -> DataFrame:
    """A top-k report: twenty best parts for `cold wid...`."""
    return search(t.part, ["cold", "wid"])


@query(
    "search_partial_terms",
    """
WITH p AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[\\p{L}\\p{N}]+')) AS token FROM part),
h AS (SELECT p_partkey, bit_or(CASE WHEN starts_with(token, 'cold') THEN 1 ELSE 0 END | CASE WHEN starts_with(token, 'zebra') THEN 2 ELSE 0 END | CASE WHEN starts_with(token, 'gi') THEN 4 ELSE 0 END) AS mask FROM p GROUP BY p_partkey)
SELECT CAST(mask AS INTEGER) AS mask, CAST(bit_count(mask) AS INTEGER) AS matched, count(*) AS parts, min(p_partkey) AS first_part FROM h WHERE mask > 0 GROUP BY mask
""",
)
def search_partial_terms(t: Tables) -> DataFrame:
    """Which subsets of the query's terms any part matches: the fallback when no part has them all."""
    tokens = text.words(F.concat_ws(" ", "p_name", "p_type"))
    begins = lambda q: lambda x: F.startswith(x, F.lit(q))
    mask = sum((F.when(F.exists(tokens, begins(q)), F.lit(1 << i)).otherwise(F.lit(0)) for i, q in enumerate(("cold", "zebra", "gi"))), F.lit(0))
    d = t.part.select("p_partkey", mask.cast("int").alias("mask")).filter("mask > 0")
    return d.groupBy("mask").agg(F.count("*").alias("parts"), F.min("p_partkey").alias("first_part")).select("mask", F.bit_count("mask").cast("int").alias("matched"), "parts", "first_part")


@query(
    "alias_best_per_key",
    """
SELECT p_partkey, alias, kind, rank FROM (
  SELECT p_partkey, alias, kind, CAST(k AS INTEGER) AS rank, row_number() OVER (PARTITION BY p_partkey ORDER BY k, length(alias), alias) AS rn FROM (
    SELECT p_partkey, lower(p_name) AS alias, 'name' AS kind, 1 AS k FROM part UNION ALL SELECT p_partkey, lower(p_brand), 'brand', 2 FROM part UNION ALL SELECT p_partkey, lower(p_type), 'type', 3 FROM part)
  WHERE alias LIKE '%i%') WHERE rn = 1
""",
)
def alias_best_per_key(t: Tables) -> DataFrame:
    """The best alias of each part that holds an i: names before brands before types, short before long."""
    names = [("p_name", "name", 1), ("p_brand", "brand", 2), ("p_type", "type", 3)]
    a = F.explode(F.array(*[F.struct(F.lower(c).alias("alias"), F.lit(k).alias("kind"), F.lit(r).alias("rank")) for c, k, r in names])).alias("a")
    d = t.part.select("p_partkey", a).select("p_partkey", "a.*").filter(F.col("alias").like("%i%"))
    w = Window.partitionBy("p_partkey").orderBy("rank", F.length("alias"), "alias")
    return d.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("p_partkey", "alias", "kind", "rank")


@query(
    "fuzzy_token_match",
    """
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+')) AS token FROM part),
q(query) AS (VALUES ('wigdet'), ('colld'), ('giant'), ('gadge'), ('smal'), ('brokn'))
SELECT query, token, CASE WHEN token = query THEN 'exact' WHEN starts_with(token, query) AND length(token) - length(query) >= 2 THEN 'prefix'
  WHEN levenshtein(token, query) <= CASE WHEN length(query) >= 8 THEN 2 WHEN length(query) >= 4 THEN 1 ELSE 0 END THEN 'edit' ELSE 'swap' END AS how
FROM w, q WHERE token = query OR (starts_with(token, query) AND length(token) - length(query) >= 2)
  OR levenshtein(token, query) <= CASE WHEN length(query) >= 8 THEN 2 WHEN length(query) >= 4 THEN 1 ELSE 0 END
  OR (length(token) = length(query) AND length(token) >= 2 AND len([i for i in range(1, length(query)) if substr(query, 1, i - 1) || substr(query, i + 1, 1) || substr(query, i, 1) || substr(query, i + 2) = token]) > 0)
""",
)
def fuzzy_token_match(t: Tables) -> DataFrame:
    """Vocabulary tokens that fit a mistyped query: equal, longer, a few edits away, or with two letters swapped."""
    queries = ("wigdet", "colld", "giant", "gadge", "smal", "brokn")
    vocab = t.part.select(F.explode(text.words(F.col("p_name"))).alias("token")).distinct()
    d = vocab.select("token", F.explode(F.array(*map(F.lit, queries))).alias("query"))
    most = F.when(F.length("query") >= 8, 2).when(F.length("query") >= 4, 1).otherwise(0)
    how = F.when(F.col("token") == F.col("query"), "exact").when(F.startswith("token", "query") & (F.length("token") - F.length("query") >= 2), "prefix")
    how = how.when(F.levenshtein("token", "query") <= most, "edit").when(text.one_edit_apart(F.col("query"), F.col("token")), "swap")
    return d.select("query", "token", how.alias("how")).filter("how IS NOT NULL")
