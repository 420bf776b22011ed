"""Choosing what to do next: patterns, identity, budgets and rotations, phrases with priors, distinct top lists, metrics of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.plans.registry import Tables, query

from .relational import best


def like_any(columns: list[str], q: str) -> Column:
    """Whether a column begins with what is typed, or holds it, whatever the case; wildcards in it are blanks."""
    plain = " ".join(q.replace("%", " ").replace("_", " ").split())
    tests = [F.col(c).ilike(p) for c in columns for p in (f"{plain}%", f"%{plain}%")]
    return reduce(lambda a, b: a | b, tests)


@query(
    "pattern_matches",
    "SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%d wid%' OR p_brand ILIKE '%d wid%' ORDER BY length(p_name), p_name, p_partkey LIMIT 60",
)
def pattern_matches(t: Tables) -> DataFrame:
    """A top-k report: sixty rows that fit what is typed."""
    return t.part.filter(like_any(["p_name", "p_brand"], "d_wid")).orderBy(F.length("p_name"), "p_name", "p_partkey").limit(60).select("p_partkey", "p_name", "p_brand")


def free_text(c: Column) -> Column:
    """White space runs as one blank, none at the ends, lower case; null as empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", " ")))


def identity_text(c: Column) -> Column:
    """free_text with everything but letters and digits as one blank."""
    return F.trim(F.regexp_replace(free_text(c), r"(?U)[\W_]+", " "))


def canonical_key(pmcid: Column, doi: Column, title: Column, year: Column, journal: Column, source: Column, source_id: Column, external_id: Column) -> Column:
    """The best identity of a paper: its pmcid, its DOI, a hash of its title with year and journal (failing that source and record), else source and record.

    Parts that are blank are left out of the hash; a year counts by its first four digits; a record is the source's id or, where that
    is absent or empty, the external one.
    """
    bare = F.regexp_replace(free_text(pmcid), "[^a-z0-9]+", "")
    record = free_text(F.coalesce(F.nullif(source_id.cast("string"), F.lit("")), external_id.cast("string")))
    digits = F.substring(F.regexp_replace(free_text(year), "[^0-9]+", ""), 1, 4)
    given = lambda c: F.nullif(c, F.lit(""))
    where = F.coalesce(given(identity_text(journal)), F.when((free_text(source) != "") | (record != ""), F.concat_ws(":", free_text(source), record)))
    hashed = F.concat(F.lit("title:"), F.substring(F.sha1(F.concat_ws("|", identity_text(title), given(digits), where)), 1, 24))
    last = F.concat(F.lit("source:"), F.coalesce(given(free_text(source)), F.lit("unknown")), F.lit(":"), F.coalesce(given(record), F.lit("unknown")))
    by_pmcid = F.concat(F.lit("pmcid:"), F.when(F.startswith(bare, F.lit("pmc")), bare).otherwise(F.concat(F.lit("pmc"), bare)))
    return F.when(bare != "", by_pmcid).when(free_text(doi) != "", F.concat(F.lit("doi:"), free_text(doi))).when(identity_text(title) != "", hashed).otherwise(last)


@query(
    "canonical_keys",
    r"""
WITH p AS (
  SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'PMC-' || page_id WHEN 1 THEN page_id::VARCHAR WHEN 2 THEN ' - ' END AS pmcid, CASE page_id % 9 WHEN 2 THEN ' 10.1/A  ' || page_id WHEN 3 THEN 'https://doi.org/10.1/A' || page_id END AS doi,
    CASE WHEN page_id % 9 BETWEEN 4 AND 6 THEN '  Some ' || chr(160) || ' Títle: no. ' || page_id WHEN page_id % 9 = 7 THEN ' -- ' END AS title, CASE page_id % 9 WHEN 4 THEN '(2020-05)' WHEN 5 THEN 'n.d.' END AS year,
    CASE page_id % 9 WHEN 5 THEN 'J. of X' END AS journal, CASE WHEN page_id % 9 <> 8 THEN 'SRC' END AS source, CASE WHEN page_id % 2 = 0 THEN '' ELSE page_id::VARCHAR END AS source_id, CASE WHEN page_id % 9 <> 8 THEN 'X ' || page_id ELSE '' END AS external_id FROM pages),
n AS (
  SELECT page_id, regexp_replace(lower(coalesce(pmcid, '')), '[^a-z0-9]+', '', 'g') AS pm, lower(trim(regexp_replace(coalesce(doi, ''), '[\s\x{A0}]+', ' ', 'g'))) AS doi, trim(regexp_replace(lower(coalesce(title, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS title,
    left(regexp_replace(coalesce(year, ''), '[^0-9]+', '', 'g'), 4) AS year, trim(regexp_replace(lower(coalesce(journal, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS journal, lower(coalesce(source, '')) AS source, lower(CASE WHEN coalesce(source_id, '') <> '' THEN source_id ELSE external_id END) AS record FROM p)
SELECT page_id, CASE WHEN pm <> '' THEN 'pmcid:' || CASE WHEN starts_with(pm, 'pmc') THEN pm ELSE 'pmc' || pm END WHEN doi <> '' THEN 'doi:' || doi
  WHEN title <> '' THEN 'title:' || left(sha1(title || CASE WHEN year <> '' THEN '|' || year ELSE '' END || CASE WHEN journal <> '' THEN '|' || journal WHEN source <> '' OR record <> '' THEN '|' || source || ':' || record ELSE '' END), 24)
  ELSE 'source:' || CASE WHEN source <> '' THEN source ELSE 'unknown' END || ':' || CASE WHEN record <> '' THEN record ELSE 'unknown' END END AS key FROM n
""",
)
def canonical_keys(t: Tables) -> DataFrame:
    i, kind = F.col("page_id").cast("string"), F.col("page_id") % 9
    text_of = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    pmcid = F.when(kind == 0, text_of("PMC-", i)).when(kind == 1, i).when(kind == 2, " - ")
    doi = F.when(kind == 2, text_of(" 10.1/A  ", i)).when(kind == 3, text_of("https://doi.org/10.1/A", i))
    title = F.when(kind.between(4, 6), text_of("  Some   Títle: no. ", i)).when(kind == 7, " -- ")
    source_id = F.when(F.col("page_id") % 2 == 0, "").otherwise(i)
    key = canonical_key(pmcid, doi, title, F.when(kind == 4, "(2020-05)").when(kind == 5, "n.d."), F.when(kind == 5, "J. of X"), F.when(kind != 8, "SRC"), source_id, F.when(kind != 8, text_of("X ", i)).otherwise(""))
    return t.pages.select("page_id", key.alias("key"))


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b lacks (`missing`) and the other way round (`added`), as often as they are lacking: one aggregation over both."""
    both = a.withColumn("__n", F.lit(1)).unionByName(b.withColumn("__n", F.lit(-1)))
    d = both.groupBy(*a.columns).agg(F.sum("__n").alias("n")).filter("n <> 0")
    return d.select(*a.columns, F.when(F.col("n") > 0, "missing").otherwise("added").alias("side"), F.abs("n").alias("times"))


@query(
    "multiset_diffs",
    """
WITH a AS (SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_linenumber <= 4), b AS (SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_linenumber >= 3),
n AS (SELECT l_orderkey, l_returnflag, sum(x) AS n FROM (SELECT *, 1 AS x FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY ALL)
SELECT l_orderkey, l_returnflag, CASE WHEN n > 0 THEN 'missing' ELSE 'added' END AS side, CAST(abs(n) AS BIGINT) AS times FROM n WHERE n <> 0
""",
)
def multiset_diffs(t: Tables) -> DataFrame:
    d = t.lineitem.select("l_orderkey", "l_returnflag", "l_linenumber")
    return multiset_diff(d.filter("l_linenumber <= 4").drop("l_linenumber"), d.filter("l_linenumber >= 3").drop("l_linenumber"))


def meal_of(local: Column, zone: Column, zones: tuple[str, ...], now: Column | None = None) -> Column:
    """The meal of a time as ISO text: by its hour in the zone, or as it stands if it names no zone of its own.

    A zone that isn't among the known ones counts as UTC; what is no time counts as `now`, the present if not given.
    """
    known = F.when(zone.isin(*zones), zone).otherwise(F.lit("UTC"))
    here = lambda instant: F.convert_timezone(F.current_timezone(), known, instant.cast("timestamp_ntz"))
    own = local.rlike(r"[T ]\d{2}.*([+-]\d{2}(:?\d{2}){0,2}|Z)$")
    stands = F.try_to_timestamp(F.regexp_replace(local, "([+-]\\d{2}:?\\d{2}|Z)$", "")).cast("timestamp_ntz")
    at = F.coalesce(F.when(own, here(F.try_to_timestamp(local))).otherwise(stands), here(now if now is not None else F.current_timestamp()))
    hour = F.hour(at)
    return F.when(hour.between(4, 10), "breakfast").when(hour.between(11, 15), "lunch").when(hour.between(16, 21), "dinner").otherwise("snacks")


@query(
    "meals_by_zone",
    """
WITH e AS (SELECT event_id % 3 AS k, event_id % 2 AS zoned, ts FROM events),
h AS (SELECT CASE k WHEN 0 THEN 'Europe/Istanbul' WHEN 1 THEN 'America/New_York' ELSE 'Mars/Base' END AS zone, hour(CASE WHEN zoned = 0 THEN ts ELSE timezone(CASE k WHEN 0 THEN 'Europe/Istanbul' WHEN 1 THEN 'America/New_York' ELSE 'UTC' END, timezone('UTC', ts)) END) AS h FROM e)
SELECT zone, CASE WHEN h BETWEEN 4 AND 10 THEN 'breakfast' WHEN h BETWEEN 11 AND 15 THEN 'lunch' WHEN h BETWEEN 16 AND 21 THEN 'dinner' ELSE 'snacks' END AS meal, count(*) AS n FROM h GROUP BY ALL
""",
)
def meals_by_zone(t: Tables) -> DataFrame:
    """Events by zone and meal; every other time is written without a zone."""
    zone = F.element_at(F.array(*map(F.lit, ("Europe/Istanbul", "America/New_York", "Mars/Base"))), (F.col("event_id") % 3 + 1).cast("int"))
    local = F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 1, "Z").otherwise(""))
    return t.events.groupBy(zone.alias("zone"), meal_of(local, zone, ("Europe/Istanbul", "America/New_York")).alias("meal")).agg(F.count("*").alias("n"))


def at_places(rows: DataFrame, column: str, places: dict[str, int]) -> dict[str, object]:
    """The values at places (from 0) of a column in its order, nulls left out, exactly and without sorting the table.

    An approximate quantile is off by a 10,000th of the rows at most; of the values between two of them, which are that few, the
    counts are summed up.
    """
    d = rows.select(F.col(column).alias("x")).filter("x IS NOT NULL")
    n = d.count()
    out: dict[str, object] = {}
    for name, place in places.items():
        if not 0 <= place < n:
            out[name] = None
            continue
        low, high = (d.agg(F.percentile_approx("x", min(1.0, max(0.0, place / n + by)), 10_000)).first()[0] for by in (-0.0003, 0.0003))
        below = d.filter(F.col("x") < low).count()
        near = d.filter(F.col("x").between(low, high)).groupBy("x").count().withColumn("upto", F.lit(below) + F.sum("count").over(Window.orderBy("x")))
        out[name] = near.filter(F.col("upto") > place).agg(F.min("x")).first()[0]
    return out


def latency_places(n: int) -> dict[str, int]:
    """Where the middle and the 95th percentile of n sorted times stand; halves are rounded to even places."""
    return {"p50": (n - 1) // 2, "p95": round((n - 1) * 0.95)}


@query(
    "result_metrics",
    """
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place, event_type, value FROM events),
q AS (SELECT user_id, bool_or(place <= 12 AND event_type = 'purchase') AS hit, max(event_type) FILTER (place = 1) AS top, max(value) AS took FROM r GROUP BY user_id),
l AS (SELECT list_sort(list(took)) AS s, count(*) AS n FROM q)
SELECT count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS recall_at_12, round(avg(CASE WHEN top IN ('purchase', 'view') THEN 1.0 ELSE 0 END), 6) AS accuracy,
  (SELECT round(s[(n - 1) // 2 + 1], 6) FROM l) AS p50, (SELECT round(s[CAST(round_even((n - 1) * 0.95, 0) AS INT) + 1], 6) FROM l) AS p95 FROM q
""",
)
def result_metrics(t: Tables) -> DataFrame:
    """Recall among the first twelve, accuracy of the first, and times at the middle and the 95th percentile."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id"))
    r = t.events.select("user_id", "event_type", "value", place.alias("place"))
    q = r.groupBy("user_id").agg(F.bool_or((F.col("place") <= 12) & (F.col("event_type") == "purchase")).alias("hit"), F.max(F.when(F.col("place") == 1, F.col("event_type"))).alias("top"), F.max("value").alias("took"))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    took = at_places(q, "took", latency_places(q.count()))
    return q.agg(F.count("*").alias("n"), share(F.col("hit")).alias("recall_at_12"), share(F.col("top").isin("purchase", "view")).alias("accuracy"), *[F.round(F.lit(v).cast("double"), 6).alias(k) for k, v in took.items()])


#: The fields whose silent default counts against an answer.
GUARDED = ("preparation", "weight_basis", "unspecified_food")


def evaluation(cases: DataFrame, answers: DataFrame, first: int = 12) -> dict[str, object]:
    """The measures of answers to a benchmark's cases, and `passed`, whether they reach its thresholds.

    cases(case_id, concepts: array<struct<acceptable: array<string>, no_match: boolean, quantity: string, required: array<string>>>);
    answers(case_id, latency_ms, items: array<struct<retrieved, selected, alternatives, quantity_status, unresolved>>). A case answered with
    another number of items counts as undecided in all of them. Cases and answers must be the same.
    """
    both = cases.join(answers, "case_id", "full")
    bad = both.filter("concepts IS NULL OR items IS NULL").select("case_id").limit(5).collect()
    if bad:
        raise ValueError(f"cases without an answer, or answers without a case: {[r['case_id'] for r in bad]}")
    fits = F.size("concepts") == F.size("items")
    d = both.withColumn("pair", F.explode_outer(F.arrays_zip("concepts", F.when(fits, F.col("items")).otherwise(F.slice("items", 1, 0)).alias("items")))).withColumn("fits", fits)
    c, a = F.col("pair.concepts"), F.col("pair.items")
    none = F.array().cast("array<string>")
    acceptable, unresolved = F.coalesce(c["acceptable"], none), F.coalesce(a["unresolved"], none)
    retrieved = F.slice(F.coalesce(a["retrieved"], none), 1, first)
    known = F.size(acceptable) > 0
    returned = F.filter(F.concat(F.array(a["selected"]), F.coalesce(a["alternatives"], none)), lambda x: x.isNotNull() & (x != ""))
    clarified = F.arrays_overlap(unresolved, F.coalesce(c["required"], none))
    right = F.when(c["no_match"], a["selected"].isNull() & F.array_contains(unresolved, "food")).otherwise(F.coalesce(F.array_contains(acceptable, a["selected"]), F.lit(False)) | clarified)
    asked = F.filter(F.coalesce(c["required"], none), lambda x: x.isin(*GUARDED))
    quantity = (c["quantity"] == "unresolved") & F.col("fits")
    one = lambda x: F.coalesce(x.cast("int"), F.lit(0))
    if_fits = lambda x: F.when(F.col("fits"), x).otherwise(0)
    sums = d.filter("pair.concepts IS NOT NULL").agg(
        F.sum(one(known)).alias("supported"), F.sum(if_fits(one(known & F.arrays_overlap(retrieved, acceptable)))).alias("hits"), F.count("*").alias("decisions"), F.sum(if_fits(one(right))).alias("right"),
        F.sum(if_fits(F.size(returned))).alias("returned"), F.sum(if_fits(F.size(F.filter(returned, lambda x: F.array_contains(retrieved, x))))).alias("valid"),
        F.sum(one(quantity) + if_fits(F.size(asked))).alias("checks"),
        F.sum(one(quantity & (a["quantity_status"] == "unresolved") & F.array_contains(unresolved, "quantity")) + if_fits(F.size(F.filter(asked, lambda x: F.array_contains(unresolved, x))))).alias("safe"),
    ).first()
    share = lambda x, n: round((sums[x] or 0) / sums[n], 6) if sums[n] else 1
    n = answers.count()
    out: dict[str, object] = {"cases": n, "recall": share("hits", "supported"), "right_or_clarified": share("right", "decisions"), "id_validity": share("valid", "returned"), "no_silent_defaults": share("safe", "checks")}
    out |= at_places(answers.withColumn("__ms", F.col("latency_ms").cast("double")), "__ms", latency_places(n))
    out["passed"] = bool(n) and out["recall"] >= 0.95 and out["right_or_clarified"] >= 0.9 and out["id_validity"] == 1 and out["no_silent_defaults"] == 1 and out["p50"] < 5000 and out["p95"] < 12_000
    return out


def distinct_top(rows: DataFrame, group: str, value: str, limit: int, *order: Column) -> DataFrame:
    """The first rows of each group, `limit` at most, a value counting only in the group and place where it comes first."""
    first = best(rows, [value], *order, F.col(group))
    rn = F.row_number().over(Window.partitionBy(group).orderBy(*order, F.col(value)))
    return first.withColumn("place", rn).filter(F.col("place") <= limit)


@query(
    "distinct_top_terms",
    """
WITH w AS (SELECT p_type, p_name AS term, count(*) AS n FROM part GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, p_type) AS k FROM w)
SELECT p_type, term, n, CAST(place AS INTEGER) AS place FROM (SELECT p_type, term, n, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, term) AS place FROM f WHERE k = 1) WHERE place <= 3
""",
)
def distinct_top_terms(t: Tables) -> DataFrame:
    """Three terms for each type, none of them twice: a report."""
    w = t.part.groupBy("p_type", F.col("p_name").alias("term")).agg(F.count("*").alias("n"))
    return distinct_top(w, "p_type", "term", 3, F.col("n").desc())


def language_budget(languages: list[str], active: set[str], total: int, cursor: int) -> tuple[dict[str, int], int]:
    """Equal numbers of queries for the active languages, none for others, and the cursor for the next turn.

    What equal parts leave goes to one language after the other from the cursor on, which moves on by as many.
    """
    out = dict.fromkeys(languages, 0)
    names = [k for k in languages if k in active]
    if total <= 0 or not names:
        return out, cursor
    each, rest = divmod(total, len(names))
    for i, k in enumerate(names):
        out[k] = each + ((i - cursor) % len(names) < rest)
    return out, (cursor + rest) % len(names) if rest else cursor


def planned(candidates: DataFrame, budget: dict[str, int], lang: str, turn: int, core: float = 0.7) -> DataFrame:
    """candidates(lang, term, score, uses) that a turn's budget takes: the best ones, then, for the rest of it, the least used ones.

    The exploring part begins at another place each turn, so that every term has its day.
    """
    b = F.create_map(*[F.lit(x) for kv in budget.items() for x in kv])
    d = candidates.withColumn("__b", F.coalesce(F.try_element_at(b, F.col(lang)), F.lit(0))).withColumn("__core", F.ceil(F.col("__b") * core))
    d = d.withColumn("__rn", F.row_number().over(Window.partitionBy(lang).orderBy(F.col("score").desc(), "term")))
    n = F.count("*").over(Window.partitionBy(lang))
    d = d.withColumn("__rest", F.greatest(n - F.col("__core"), F.lit(1)))
    rest = d.filter(F.col("__rn") > F.col("__core")).withColumn("__k", F.row_number().over(Window.partitionBy(lang).orderBy("uses", "term")))
    rest = rest.filter(F.pmod(F.col("__k") - 1 - turn * (F.col("__b") - F.col("__core")), F.col("__rest")) < F.col("__b") - F.col("__core"))
    kept = d.filter(F.col("__rn") <= F.least("__core", "__b")).withColumn("part", F.lit("core")).unionByName(rest.drop("__k").withColumn("part", F.lit("explore")))
    return kept.drop("__b", "__core", "__rn", "__rest")


@query(
    "planned_queries",
    """
WITH c AS (SELECT p_type AS lang, p_name AS term, round(avg(p_retailprice), 6) AS score, count(*) AS uses FROM part GROUP BY ALL), b(lang, b, core) AS (VALUES ('ECONOMY', 6, 5), ('PROMO', 5, 4), ('STANDARD', 6, 5)),
d AS (SELECT c.*, b, core, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS rn, count(*) OVER (PARTITION BY lang) - core AS rest FROM c JOIN b USING (lang)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY uses, term) AS k FROM d WHERE rn > core)
SELECT lang, term, 'core' AS part FROM d WHERE rn <= core UNION ALL SELECT lang, term, 'explore' FROM r WHERE ((k - 1 - 3 * (b - core)) % greatest(rest, 1) + greatest(rest, 1)) % greatest(rest, 1) < b - core
""",
)
def planned_queries(t: Tables) -> DataFrame:
    c = t.part.groupBy(F.col("p_type").alias("lang"), F.col("p_name").alias("term")).agg(F.round(F.avg("p_retailprice"), 6).alias("score"), F.count("*").alias("uses"))
    budget, _ = language_budget(["ECONOMY", "MEDIUM", "PROMO", "STANDARD"], {"ECONOMY", "PROMO", "STANDARD"}, 17, 2)  # 6, 0, 5, 6
    return planned(c, budget, "lang", 3).select("lang", "term", "part")


def weighted_terms(counts: DataFrame, good: int, bad: int, priors: dict[str, float], smooth: float = 0.5, least: int = 3) -> DataFrame:
    """counts(term, good_title, bad_title, good_text, bad_text) with log odds in either field and a net score, for terms of some support.

    A seed term's prior is added to its net score, and a seed needs no support.
    """
    odds = lambda g, b: F.log((F.col(g) + smooth) / (good + 2 * smooth)) - F.log((F.col(b) + smooth) / (bad + 2 * smooth))
    seed = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in priors.items() for x in kv]), F.col("term")), F.lit(0.0)) if priors else F.lit(0.0)
    support = F.col("good_title") + F.col("bad_title") + F.col("good_text") + F.col("bad_text")
    d = counts.filter((support >= least) | (seed != 0)).withColumns({"title_net": odds("good_title", "bad_title"), "text_net": odds("good_text", "bad_text")})
    return d.withColumn("net", F.lit(1.5) * F.col("title_net") + F.col("text_net") + seed)


@query(
    "seeded_terms",
    """
WITH d AS (SELECT doc_id, quality, list_distinct(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[\\p{L}\\p{N}]+')) AS a, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS b FROM documents JOIN labels USING (doc_id)),
t AS (SELECT unnest(a) AS term, quality, 1 AS f FROM d UNION ALL SELECT unnest(b), quality, 2 FROM d),
c AS (SELECT term, count(*) FILTER (f = 1 AND quality = 1) AS gt, count(*) FILTER (f = 1 AND quality = 0) AS bt, count(*) FILTER (f = 2 AND quality = 1) AS gx, count(*) FILTER (f = 2 AND quality = 0) AS bx FROM t GROUP BY term),
o AS (SELECT term, ln((gt + 0.5) / 101.0) - ln((bt + 0.5) / 51.0) AS tn, ln((gx + 0.5) / 101.0) - ln((bx + 0.5) / 51.0) AS xn FROM c WHERE gt + bt + gx + bx >= 12 OR term IN ('the', 'water'))
SELECT term, round(1.5 * tn + xn + CASE term WHEN 'the' THEN -0.5 WHEN 'water' THEN 2.0 ELSE 0 END, 6) AS net FROM o
""",
)
def seeded_terms(t: Tables) -> DataFrame:
    """Document frequencies in first lines and in whole texts, as log odds with seed priors."""
    d = t.documents.select("doc_id", "text").join(t.labels.select("doc_id", "quality"), "doc_id")
    field = lambda c, f: F.transform(F.array_distinct(text.words(c)), lambda w: F.struct(w.alias("term"), F.lit(f).alias("f")))
    e = d.select("quality", F.explode(F.concat(field(F.substring_index("text", "\n", 1), 1), field(F.col("text"), 2))).alias("t")).select("quality", "t.*")
    n = lambda f, q: F.count_if((F.col("f") == f) & (F.col("quality") == q))
    c = e.groupBy("term").agg(n(1, 1).alias("good_title"), n(1, 0).alias("bad_title"), n(2, 1).alias("good_text"), n(2, 0).alias("bad_text"))
    return weighted_terms(c, 100, 50, {"the": -0.5, "water": 2.0}, least=12).select("term", F.round("net", 6).alias("net"))


def prefill_stats(rows: DataFrame, key: str, items: str) -> DataFrame:
    """key, items, confirmed, corrected, missing of arrays of struct<status, value>: what a person did with what was filled in."""
    n = lambda f: F.size(F.filter(items, f)).cast("long")
    return rows.select(key, F.greatest(F.size(items), F.lit(0)).cast("long").alias("items"), n(lambda x: x["status"] == "confirmed").alias("confirmed"), n(lambda x: x["status"] == "corrected").alias("corrected"), n(lambda x: x["value"].isNull()).alias("missing"))


@query(
    "prefill_figures",
    """
SELECT l_orderkey, count(*) AS items, count(*) FILTER (l_returnflag = 'A') AS confirmed, count(*) FILTER (l_returnflag = 'R') AS corrected, count(*) FILTER (l_discount > 0.08) AS missing FROM lineitem GROUP BY l_orderkey
""",
)
def prefill_figures(t: Tables) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "R", "corrected").otherwise("open")
    item = F.struct(status.alias("status"), F.when(F.col("l_discount") <= 0.08, F.col("l_quantity")).alias("value"))
    return prefill_stats(t.lineitem.groupBy("l_orderkey").agg(F.collect_list(item).alias("i")), "l_orderkey", "i")


def legacy_build(foods: DataFrame, amounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, claims): foods(code, name) one for each plain name, the lowest code's; amounts(code, nutrient, amount) of those, with bad ones skipped."""
    named = foods.withColumn("key", text.plain(F.col("name"))).filter("key <> ''")
    entities = best(named, ["key"], F.col("code"))
    ok = amounts.withColumn("amount", F.trim(F.col("amount").cast("string")).try_cast("double")).filter(F.col("amount").isNotNull() & ~F.isnan("amount") & (F.abs("amount") < float("inf")))
    return entities, ok.join(entities.select("code", "key"), "code").dropDuplicates(["key", "nutrient"])


@query(
    "legacy_entities",
    """
WITH e AS (SELECT lower(p_name) AS key, min(p_partkey) AS code FROM part GROUP BY 1)
SELECT key, code, count(DISTINCT l_suppkey) FILTER (l_quantity <> 13) AS claims FROM e LEFT JOIN lineitem ON l_partkey = code GROUP BY key, code
""",
)
def legacy_entities(t: Tables) -> DataFrame:
    foods = t.part.select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"))
    amounts = t.lineitem.select(F.col("l_partkey").alias("code"), F.col("l_suppkey").alias("nutrient"), F.when(F.col("l_quantity") == 13, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("amount"))
    entities, claims = legacy_build(foods, amounts)
    return entities.join(claims.groupBy("key").agg(F.count("*").alias("claims")), "key", "left").select("key", "code", F.coalesce("claims", F.lit(0)).alias("claims"))


#: The shares of carbohydrate, protein and fat in the energy of each diet.
DIETS = {
    "balanced": (0.45, 0.25, 0.30),
    "mediterranean": (0.45, 0.20, 0.35),
    "high_protein": (0.35, 0.35, 0.30),
    "plant_powered": (0.55, 0.20, 0.25),
    "keto": (0.10, 0.25, 0.65),
    "blue_zones": (0.60, 0.15, 0.25),
}


def macro_targets(energy: Column, diet: Column, goal: Column) -> dict[str, Column]:
    """Grams of protein, carbohydrate and fat for an energy target: by the diet's shares, moved a little by the goal.

    Building muscle and losing fat take a twentieth from carbohydrate for protein, performance takes it from fat for carbohydrate
    unless the diet is keto; but only from a share of a fifth at least. A diet that isn't known gives null.
    """
    share = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in DIETS.items() for x in (k, v[i])]), diet)
    protein_up = F.when(goal.isin("buildMuscle", "loseFat") & (share(0) >= 0.2), 0.05).otherwise(0.0)
    carbs_up = F.when((goal == "performance") & (diet != "keto") & (share(2) >= 0.2), 0.05).otherwise(0.0)
    return {"protein": energy * (share(1) + protein_up) / 4, "carbohydrate": energy * (share(0) - protein_up + carbs_up) / 4, "fat": energy * (share(2) - carbs_up) / 9}


@query(
    "goal_targets",
    """
WITH d(k, diet, c, p, f) AS (VALUES (0, 'balanced', 0.45, 0.25, 0.30), (1, 'mediterranean', 0.45, 0.20, 0.35), (2, 'high_protein', 0.35, 0.35, 0.30), (3, 'plant_powered', 0.55, 0.20, 0.25), (4, 'keto', 0.10, 0.25, 0.65), (5, 'blue_zones', 0.60, 0.15, 0.25)),
u AS (SELECT user_id, round(sum(value), 2) AS e, ['eatWell', 'loseFat', 'buildMuscle', 'moreEnergy', 'performance'][user_id % 5 + 1] AS goal FROM events GROUP BY user_id),
s AS (SELECT u.*, diet, CAST(c AS DOUBLE) AS c, CAST(p AS DOUBLE) AS p, CAST(f AS DOUBLE) AS f, CASE WHEN goal IN ('buildMuscle', 'loseFat') AND c >= 0.20 THEN 0.05::DOUBLE ELSE 0 END AS a, CASE WHEN goal = 'performance' AND diet <> 'keto' AND f >= 0.20 THEN 0.05::DOUBLE ELSE 0 END AS b FROM u JOIN d ON k = user_id % 6)
SELECT user_id, diet, goal, round(e * (p + a) / 4, 6) AS protein, round(e * (c - a + b) / 4, 6) AS carbohydrate, round(e * (f - b) / 9, 6) AS fat FROM s
""",
)
def goal_targets(t: Tables) -> DataFrame:
    """What each person's energy comes to by a diet and a goal."""
    u = t.events.groupBy("user_id").agg(F.round(F.sum("value"), 2).alias("e"))
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("user_id") % len(names) + 1).cast("int"))
    u = u.withColumns({"diet": pick(list(DIETS)), "goal": pick(["eatWell", "loseFat", "buildMuscle", "moreEnergy", "performance"])})
    return u.select("user_id", "diet", "goal", *[F.round(v, 6).alias(k) for k, v in macro_targets(F.col("e"), F.col("diet"), F.col("goal")).items()])
