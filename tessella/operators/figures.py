"""Figures of tables: averages of times, picked measures, coverage, plausibility, priors, windows of time, diaries."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.registry import Tables, query
from tessella.sources import shared

from .relational import best


def clamp_limit(n: int | None, least: int, most: int) -> int:
    """A caller's limit brought into its bounds; none given is the lowest."""
    return max(least, min(int(n or least), most))


def where_given(df: DataFrame, **least: object) -> DataFrame:
    """Rows at or above each bound that is given; a bound that is None is no predicate at all, so scans stay prunable."""
    for column, bound in least.items():
        if bound is not None:
            df = df.filter(F.col(column) >= F.lit(bound))
    return df


def in_window(ts: Column, start: object = None, end: object = None) -> Column:
    """start <= ts < end, either side open if it is None."""
    test = F.lit(True)
    if start is not None:
        test = test & (ts >= F.lit(start))
    if end is not None:
        test = test & (ts < F.lit(end))
    return test


def preset_window(name: str, now: datetime, start: datetime | None = None, end: datetime | None = None) -> tuple[datetime | None, datetime | None]:
    """(start, end) of a named range; anything unknown is today."""
    back = {"last_24h": 1, "last_7d": 7, "last_30d": 30}
    if name == "all":
        return None, None
    if name == "custom":
        return start, end
    if name in back:
        return now - timedelta(days=back[name]), None
    return now.replace(hour=0, minute=0, second=0, microsecond=0), None


@query(
    "handling_times",
    """
SELECT event_type, count(*) AS n, round(avg(epoch(lead_ts) - epoch(ts)), 1) AS avg_seconds, max(ts) AS last_ts
FROM (SELECT user_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lead_ts FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20') WHERE lead_ts IS NOT NULL GROUP BY event_type
""",
)
def handling_times(t: Tables) -> DataFrame:
    """Mean seconds until the same user's next event, to one place, and the last time, within a half-open window."""
    d = t.events.filter(in_window(F.col("ts"), datetime(2024, 1, 2), datetime(2024, 1, 20))).select("event_id", "user_id", "event_type", "ts")
    d = d.withColumn("next", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("next IS NOT NULL")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    seconds = micros("next") / 1e6 - micros("ts") / 1e6
    return d.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(seconds), 1).alias("avg_seconds"), F.max("ts").alias("last_ts"))


def first_positive(*choices: Column) -> Column:
    """The first choice above 0."""
    return F.coalesce(*[F.when(c > 0, c) for c in choices])


@query(
    "picked_measure_totals",
    """
SELECT l_orderkey, round(sum(CASE WHEN a > 0 THEN a WHEN b > 0 THEN b WHEN c > 0 THEN c END), 4) AS total, count(*) FILTER (NOT coalesce(a > 0 OR b > 0 OR c > 0, false)) AS unknown FROM (
  SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN l_discount END AS a, CASE WHEN l_returnflag = 'A' THEN l_tax END AS b, l_discount - 0.05 AS c FROM lineitem) GROUP BY l_orderkey
""",
)
def picked_measure_totals(t: Tables) -> DataFrame:
    """Of three measures of a row the first that is above 0, summed; rows without any are counted and add nothing."""
    d = t.lineitem.select("l_orderkey", F.when(F.col("l_returnflag") == "R", F.col("l_discount")).alias("a"), F.when(F.col("l_returnflag") == "A", F.col("l_tax")).alias("b"), (F.col("l_discount") - 0.05).alias("c"))
    pick = first_positive(F.col("a"), F.col("b"), F.col("c"))
    return d.groupBy("l_orderkey").agg(F.round(F.sum(pick), 4).alias("total"), F.count_if(pick.isNull()).alias("unknown"))


@query("coverage_dates", "SELECT l_returnflag AS dataset, strftime(min(l_shipdate), '%Y-%m-%d') AS first_day, strftime(max(l_shipdate), '%Y-%m-%d') AS last_day, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def coverage_dates(t: Tables) -> DataFrame:
    """The first and last day that each dataset covers."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return t.lineitem.groupBy(F.col("l_returnflag").alias("dataset")).agg(day(F.min("l_shipdate")).alias("first_day"), day(F.max("l_shipdate")).alias("last_day"), F.count("*").alias("n"))


def mean_confidence(values: str, default: float = 0.5) -> Column:
    """The mean of a group's values, in 0 to 1; the default where no row has one."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(values))), F.lit(default))


@query(
    "mean_confidences",
    "SELECT l_suppkey, round(coalesce(greatest(0.0, least(1.0, avg(CASE WHEN l_returnflag = 'R' THEN l_discount * 15 END))), 0.5), 6) AS confidence FROM lineitem GROUP BY l_suppkey",
)
def mean_confidences(t: Tables) -> DataFrame:
    """Confidence by supplier from its returned lines, a half where there are none."""
    d = t.lineitem.select("l_suppkey", F.when(F.col("l_returnflag") == "R", F.col("l_discount") * 15).alias("v"))
    return d.groupBy("l_suppkey").agg(F.round(mean_confidence("v"), 6).alias("confidence"))


def name_conflicts(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Keys that have more than one name, with the names in order."""
    return rows.groupBy(key).agg(F.count_distinct(name).alias("names"), F.sort_array(F.collect_set(name)).alias("__n")).filter("names > 1").select(key, "names", F.array_join("__n", " | ").alias("found"))


def union_categories(*sources: DataFrame, key: str, name: str) -> DataFrame:
    """One row for each key of several sources, or an error that shows keys with different names."""
    both = sources[0]
    for s in sources[1:]:
        both = both.unionByName(s)
    bad = name_conflicts(both, key, name).limit(5).collect()
    if bad:
        raise ValueError(f"{key} has different names: {[tuple(r) for r in bad]}")
    return both.distinct()


@query(
    "category_conflicts",
    """
SELECT p_size, count(DISTINCT x) AS names, string_agg(DISTINCT x, ' | ' ORDER BY x) AS found FROM (SELECT p_size, p_type AS x FROM part UNION ALL SELECT p_size, p_brand FROM part) GROUP BY p_size HAVING count(DISTINCT x) > 1
""",
)
def category_conflicts(t: Tables) -> DataFrame:
    """Two lists of categories put together: ids that stand for different names."""
    a, b = (t.part.select("p_size", F.col(c).alias("name")) for c in ("p_type", "p_brand"))
    return name_conflicts(a.unionByName(b), "p_size", "name")


def implausible(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows(name, amount, unit, confidence, citation) with `flags`: what is out of the limits(term, unit, low, high) or missing.

    A limit holds where its term is in the name and the whole unit is its own. limits is a small table of rules.
    """
    hit = rows.join(F.broadcast(limits.withColumnRenamed("unit", "limit_unit")), F.contains(F.lower("name"), F.col("term")) & (F.lower("unit") == F.col("limit_unit")), "left")
    bad = F.coalesce(~F.col("amount").between(F.col("low"), F.col("high")), F.lit(False))
    g = hit.groupBy(*rows.columns).agg(F.bool_or(bad).alias("out"))
    flags = F.array_compact(F.array(F.when(F.col("out"), F.lit("implausible")), F.when(F.col("confidence") < 0.5, F.lit("low_confidence")), F.when(F.col("citation").isNull(), F.lit("no_citation"))))
    return g.withColumn("flags", F.array_join(flags, ",")).drop("out")


@query(
    "plausibility_flags",
    """
WITH r(term, u, low, high) AS (VALUES ('error', 'mg', 0.0::DOUBLE, 150.0::DOUBLE), ('click', 'mg', 10.0, 300.0), ('sign', 'g', 0.0, 80.0)),
e AS (SELECT event_id, event_type AS name, value AS amount, CASE WHEN event_id % 2 = 0 THEN 'MG' ELSE 'g' END AS unit, (event_id % 10) / 10.0 AS confidence, CASE WHEN event_id % 4 > 0 THEN 'p. 1' END AS citation FROM events)
SELECT event_id, concat_ws(',', CASE WHEN bool_or(amount NOT BETWEEN low AND high) THEN 'implausible' END, CASE WHEN confidence < 0.5 THEN 'low_confidence' END, CASE WHEN citation IS NULL THEN 'no_citation' END) AS flags
FROM e LEFT JOIN r ON contains(lower(name), term) AND lower(unit) = u GROUP BY event_id, name, amount, unit, confidence, citation
""",
)
def plausibility_flags(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([("error", "mg", 0.0, 150.0), ("click", "mg", 10.0, 300.0), ("sign", "g", 0.0, 80.0)], "term string, unit string, low double, high double")
    i = F.col("event_id")
    rows = t.events.select("event_id", F.col("event_type").alias("name"), F.col("value").alias("amount"), F.when(i % 2 == 0, "MG").otherwise("g").alias("unit"), ((i % 10) / 10).alias("confidence"), F.when(i % 4 > 0, "p. 1").alias("citation"))
    return implausible(rows, rules).select("event_id", "flags")


def composed_score(pair: Column, prior: Column, bias: Column, batch: Column | None = None) -> Column:
    """A pair's own score, 0.15 of its source's prior, a fixed bias, and what its batch yielded."""
    zero = F.lit(0.0)
    s = F.coalesce(pair, zero) + F.lit(0.15) * F.coalesce(prior, zero) + F.coalesce(bias, zero)
    return s if batch is None else s + F.coalesce(batch, zero)


@query(
    "composed_scores",
    """
WITH p AS (SELECT l_partkey, l_suppkey, avg(l_discount) AS pair, sum(l_tax) AS batch FROM lineitem GROUP BY ALL), s AS (SELECT l_suppkey, ln((count(*) FILTER (l_returnflag = 'R') + 1.0) / (count(*) + 1.0)) AS prior FROM lineitem GROUP BY l_suppkey)
SELECT l_partkey, l_suppkey, round(pair + 0.15 * prior + CASE WHEN l_suppkey % 2 = 0 THEN 0.1 ELSE 0 END + batch, 6) AS score FROM p JOIN s USING (l_suppkey)
""",
)
def composed_scores(t: Tables) -> DataFrame:
    p = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.avg("l_discount").alias("pair"), F.sum("l_tax").alias("batch"))
    s = t.lineitem.groupBy("l_suppkey").agg(F.log((F.count_if(F.col("l_returnflag") == "R") + 1) / (F.count("*") + 1)).alias("prior"))
    score = composed_score(F.col("pair"), F.col("prior"), F.when(F.col("l_suppkey") % 2 == 0, 0.1), F.col("batch"))
    return p.join(s, "l_suppkey").select("l_partkey", "l_suppkey", F.round(score, 6).alias("score"))


def exploring_score(good: Column, bad: Column, least: int = 5) -> Column:
    """The share of good uses; 1 while a term has few uses, so that it is tried."""
    return F.when(good + bad < least, F.lit(1.0)).otherwise(good / (good + bad))


@query(
    "best_terms",
    """
WITH u AS (SELECT p_name AS term, count(*) FILTER (l_returnflag = 'R' AND l_discount > 0.07) AS good, count(*) FILTER (l_returnflag = 'A' AND l_discount > 0.09) AS bad FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_name)
SELECT term, good, bad, round(CASE WHEN good + bad < 5 THEN 1.0 ELSE good / (good + bad) END, 6) AS score FROM u ORDER BY score DESC, good DESC, term LIMIT 12
""",
)
def best_terms(t: Tables) -> DataFrame:
    """A top-k report: the twelve best terms, with untried ones first."""
    d = t.part.join(t.lineitem, F.col("l_partkey") == F.col("p_partkey"))
    u = d.groupBy(F.col("p_name").alias("term")).agg(F.count_if((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.07)).alias("good"), F.count_if((F.col("l_returnflag") == "A") & (F.col("l_discount") > 0.09)).alias("bad"))
    return u.withColumn("score", F.round(exploring_score(F.col("good"), F.col("bad")), 6)).orderBy(F.col("score").desc(), F.col("good").desc(), "term").limit(12)


def day_starts(ts: Column, zone: str) -> Column:
    """The instant at which the day of ts began in a named zone."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(ts, zone)), zone)


def rotating_window(day: Column, windows: list[tuple[int, int]]) -> Column:
    """The window whose turn it is, by the day's number since year 1."""
    number = F.datediff(day, F.lit(date(1970, 1, 1))) + 719_163
    return F.element_at(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in windows]), (number % len(windows) + 1).cast("int"))


@query(
    "zoned_days",
    """
SELECT timezone('America/New_York', date_trunc('day', timezone('America/New_York', timezone('UTC', ts)))) AT TIME ZONE 'UTC' AS day_start, count(*) AS n,
  min([1990, 2000, 2010][(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) + 719163) % 3 + 1]) AS first_year FROM events GROUP BY 1
""",
)
def zoned_days(t: Tables) -> DataFrame:
    """Events by the start of their day in New York, and the years that the day's turn asks for."""
    w = rotating_window(F.to_date("ts"), [(1990, 1999), (2000, 2009), (2010, 2019)])
    return t.events.groupBy(day_starts(F.col("ts"), "America/New_York").alias("day_start")).agg(F.count("*").alias("n"), F.min(w["first"]).alias("first_year"))


def add_new(diary: DataFrame, entries: DataFrame, key: str = "id") -> DataFrame:
    """diary with those entries whose id it lacks."""
    return diary.unionByName(entries.dropDuplicates([key]).join(diary.select(key), key, "left_anti").select(*diary.columns))


def replace_by_id(diary: DataFrame, entries: DataFrame, key: str = "id") -> DataFrame:
    """diary with the rows of the entries' ids as the entries have them; other ids are not added."""
    kept = diary.join(entries.select(key), key, "left_anti").select(*diary.columns)
    return kept.unionByName(entries.dropDuplicates([key]).join(diary.select(key), key, "left_semi").select(*diary.columns))


def rescaled(amount: Column, grams: Column, new_grams: Column) -> Column:
    """An amount for another serving; unchanged where the old one has no weight."""
    return F.when(grams > 0, amount * new_grams / grams).otherwise(amount)


@query(
    "diary_after_changes",
    """
WITH d AS (SELECT o_orderkey AS id, o_custkey AS who, o_totalprice AS amount FROM orders WHERE o_orderkey % 4 < 2), n AS (SELECT o_orderkey AS id, o_custkey AS who, o_totalprice * 2 AS amount FROM orders WHERE o_orderkey % 4 IN (1, 2)),
a AS (SELECT * FROM d UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM d)), r AS (SELECT id, who, amount * 50 / 20 AS amount FROM orders JOIN d ON id = o_orderkey WHERE id % 8 = 0),
f AS (SELECT * FROM a WHERE id NOT IN (SELECT id FROM r) UNION ALL SELECT * FROM r)
SELECT who, count(*) AS entries, round(sum(amount), 4) AS amount FROM f WHERE id % 5 <> 0 GROUP BY who
""",
)
def diary_after_changes(t: Tables) -> DataFrame:
    """Entries added if new, some replaced by another serving, some removed; totals by person."""
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("who"), F.col("o_totalprice").alias("amount"))
    d = o.filter("id % 4 < 2")
    a = add_new(d, o.filter("id % 4 IN (1, 2)").withColumn("amount", F.col("amount") * 2))
    r = d.filter("id % 8 = 0").withColumn("amount", rescaled(F.col("amount"), F.lit(20.0), F.lit(50.0)))
    return replace_by_id(a, r).filter("id % 5 <> 0").groupBy("who").agg(F.count("*").alias("entries"), F.round(F.sum("amount"), 4).alias("amount"))


@query(
    "lowest_progress",
    """
WITH m AS (SELECT o_custkey, o_orderstatus AS macro, sum(o_totalprice) / CASE o_orderstatus WHEN 'F' THEN 900000.0 WHEN 'O' THEN 700000.0 ELSE 300000.0 END AS share FROM orders GROUP BY o_custkey, o_orderstatus)
SELECT o_custkey, arg_min(macro, {'s': share, 'm': macro}) AS macro, round(min(share), 4) AS share FROM m GROUP BY o_custkey
""",
)
def lowest_progress(t: Tables) -> DataFrame:
    """Which of a person's amounts is furthest from its target."""
    target = F.when(F.col("o_orderstatus") == "F", 900_000.0).when(F.col("o_orderstatus") == "O", 700_000.0).otherwise(300_000.0)
    m = t.orders.groupBy("o_custkey", F.col("o_orderstatus").alias("macro"), target.alias("target")).agg(F.sum("o_totalprice").alias("amount"))
    m = m.withColumn("share", F.col("amount") / F.col("target"))
    return m.groupBy("o_custkey").agg(F.min_by("macro", F.struct("share", "macro")).alias("macro"), F.round(F.min("share"), 4).alias("share"))


@query(
    "index_report",
    """
SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 500) AS with_text, count(*) FILTER (source IS NOT NULL) AS with_source,
  (SELECT string_agg(source || '=' || c, ', ' ORDER BY c DESC, source) FROM (SELECT source, count(*) AS c FROM documents d2 WHERE d2.lang IS NOT DISTINCT FROM d.lang AND source IS NOT NULL GROUP BY source ORDER BY c DESC, source LIMIT 10)) AS top_sources
FROM documents d GROUP BY lang
""",
)
def index_report(t: Tables) -> DataFrame:
    """What an index holds, by language, with its ten largest sources: a report."""
    d = t.documents.select("lang", "source", "n_chars")
    by = d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 500).alias("with_text"), F.count("source").alias("with_source"))
    top = best_n(d.filter("source IS NOT NULL").groupBy("lang", "source").count(), ["lang"], 10, F.col("count").desc(), F.col("source"))
    top = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct(-F.col("count"), "source", F.concat_ws("=", "source", F.col("count").cast("string")).alias("s")))).alias("t"))
    return by.join(top.withColumnRenamed("lang", "l2"), F.col("lang").eqNullSafe(F.col("l2")), "left").select("lang", "n", "with_text", "with_source", F.array_join(F.transform("t", lambda x: x["s"]), ", ").alias("top_sources"))


def best_n(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rn") <= n).drop("__rn")


def pending_inputs(rows: DataFrame, done: DataFrame, key: str, text: Column) -> DataFrame:
    """Rows whose text isn't what was worked on last: done(key, input_hash)."""
    return rows.withColumn("input_hash", F.sha2(text, 256)).join(done.select(key, "input_hash"), [key, "input_hash"], "left_anti")


@query(
    "pending_embeddings",
    """
WITH d AS (SELECT doc_id, sha256(concat_ws(chr(10), lang, source, text)) AS input_hash FROM documents), e AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'old' ELSE input_hash END AS input_hash FROM d WHERE doc_id % 4 <> 1)
SELECT doc_id, input_hash FROM d WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = d.doc_id AND e.input_hash = d.input_hash)
""",
)
def pending_embeddings(t: Tables) -> DataFrame:
    """Documents that are new or have changed anywhere since they were embedded."""
    text = F.concat_ws("\n", "lang", "source", "text")
    made = t.documents.select("doc_id", F.when(F.col("doc_id") % 10 == 3, "old").otherwise(F.sha2(text, 256)).alias("input_hash")).filter("doc_id % 4 <> 1")
    return pending_inputs(t.documents.select("doc_id", "lang", "source", "text"), made, "doc_id", text).select("doc_id", "input_hash")


@query(
    "default_list",
    "SELECT p_partkey, p_name, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1 ORDER BY length(p_name), p_name, p_partkey LIMIT 15",
)
def default_list(t: Tables) -> DataFrame:
    """What is shown before anything is typed: one row a name, the fifteen shortest."""
    one = best(t.part.withColumn("k", F.lower("p_name")), ["k"], F.col("p_partkey"))
    return one.orderBy(F.length("p_name"), "p_name", "p_partkey").limit(15).select("p_partkey", "p_name", "p_brand")


def display_rank(c: Column, order: list[str]) -> Column:
    """A value's place in a fixed order; others come after all of it."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, i)]), c), F.lit(len(order)))


@query(
    "display_order",
    """
SELECT event_type, unit, n, CAST(row_number() OVER (ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, event_type, unit) AS INTEGER) AS place
FROM (SELECT event_type, CASE WHEN value > 100 THEN 'high' ELSE 'low' END AS unit, count(*) AS n FROM events GROUP BY ALL)
""",
)
def display_order(t: Tables) -> DataFrame:
    """Groups in a fixed order of kinds, then by name and unit. The window sees the few groups, not the events."""
    g = t.events.groupBy("event_type", F.when(F.col("value") > 100, "high").otherwise("low").alias("unit")).agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(display_rank(F.col("event_type"), ["purchase", "view", "click"]), "event_type", "unit")))


def nth_rows(rows: DataFrame, kind: str, order: list[str], n: int) -> DataFrame:
    """Each n-th row of a kind, in order: ranges of kind and order are written and counted, and each range goes on where those before it end."""
    path = shared.shared_dir(rows.sparkSession, "ranges")
    rows.repartitionByRange(kind, *order).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    dealt = rows.sparkSession.read.parquet(path)
    counts = dealt.groupBy(kind, "__range").count()  # a row for each kind and range
    before = F.sum("count").over(Window.partitionBy(kind).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col(kind).alias("__kind"), F.col("__range").alias("__at"), F.coalesce(before, F.lit(0)).alias("__before"))
    d = dealt.join(F.broadcast(starts), dealt[kind].eqNullSafe(F.col("__kind")) & (F.col("__range") == F.col("__at")))
    rn = F.row_number().over(Window.partitionBy("__range", kind).orderBy(*order))
    return d.withColumn("__rn", F.col("__before") + rn).filter(F.col("__rn") % n == 0).select(*rows.columns)


@query(
    "every_nth",
    "SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn % 100 = 0",
)
def every_nth(t: Tables) -> DataFrame:
    """Each hundredth event of a kind, for an audit: a sampling operator."""
    return nth_rows(t.events.select("event_id", "event_type", "ts"), "event_type", ["ts", "event_id"], 100).drop("ts")


@query(
    "refetched_topk",
    """
WITH f AS (SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_name LIKE '%ar%' ORDER BY p_retailprice DESC, p_partkey LIMIT 50)
SELECT p_partkey, p_name FROM f ORDER BY CASE WHEN p_name = 'large widget' THEN 0 ELSE 1 END, CASE WHEN starts_with(p_name, 'large') THEN 0 ELSE 1 END, length(p_name), p_name, p_partkey LIMIT 12
""",
)
def refetched_topk(t: Tables) -> DataFrame:
    """Five times as many rows as asked for (fifty at most) by one order, then the best of these by another: a top-k report."""
    k = 12
    f = t.part.filter(F.col("p_name").like("%ar%")).orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(min(max(5 * k, k), 50))
    exact, begins = F.when(F.col("p_name") == "large widget", 0).otherwise(1), F.when(F.startswith("p_name", F.lit("large")), 0).otherwise(1)
    return f.orderBy(exact, begins, F.length("p_name"), "p_name", "p_partkey").limit(clamp_limit(k, 1, 50)).select("p_partkey", "p_name")


@query(
    "quota_topk",
    """
SELECT lang, doc_id, CAST(rn AS INTEGER) AS place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN n_chars > 300 THEN 1 ELSE 0 END DESC, n_chars % 1000 DESC, n_chars DESC, doc_id) AS rn FROM documents)
WHERE rn <= CASE lang WHEN 'en' THEN 30 WHEN 'de' THEN 20 ELSE 10 END
""",
)
def quota_topk(t: Tables) -> DataFrame:
    """The best candidates of each language by (passes, score, score of the gate), up to its quota."""
    n = F.col("n_chars")
    rn = F.row_number().over(Window.partitionBy("lang").orderBy(F.when(n > 300, 1).otherwise(0).desc(), (n % 1000).desc(), n.desc(), "doc_id"))
    quota = F.when(F.col("lang") == "en", 30).when(F.col("lang") == "de", 20).otherwise(10)
    return t.documents.select("lang", "doc_id", rn.alias("place")).filter(F.col("place") <= quota)
