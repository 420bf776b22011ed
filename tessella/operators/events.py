"""Event tables: latest states, labels, conflicts, quotas, circuits, funnels, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.registry import Tables, query

from .relational import best

_END = "TIMESTAMP '2024-01-15 00:00:00'"


@query(
    "latest_per_key",
    "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM events) WHERE rn = 1",
)
def latest_per_key(t: Tables) -> DataFrame:
    """The latest event of each user and type; of equal times the later row."""
    d = t.events.select("user_id", "event_type", "event_id", "value", "ts")
    return best(d, ["user_id", "event_type"], F.col("ts").desc_nulls_last(), F.col("event_id").desc()).drop("ts")


@query(
    "labels_from_events",
    """
WITH l AS (SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type IN ('purchase', 'error')) WHERE rn = 1),
e AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id)
SELECT l.user_id, CASE WHEN event_type = 'purchase' THEN 'good' WHEN errors >= 2 THEN 'bad' ELSE 'conflict' END AS label FROM l JOIN e USING (user_id)
""",
)
def labels_from_events(t: Tables) -> DataFrame:
    """A label for each user: the last decisive event wins, but a negative one only with a second to back it; one shuffle by user."""
    d = t.events.filter("event_type IN ('purchase', 'error')").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return d.select("user_id", F.when(F.col("last") == "purchase", "good").when(F.col("errors") >= 2, "bad").otherwise("conflict").alias("label"))


@query(
    "conflict_candidates",
    """
SELECT o_custkey, count(*) AS orders, count(DISTINCT o_orderstatus) AS statuses, count(DISTINCT o_orderpriority) AS priorities, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS seen,
  CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'status' WHEN count(DISTINCT o_orderpriority) > 1 THEN 'priority' ELSE 'none' END AS conflict FROM orders GROUP BY o_custkey
""",
)
def conflict_candidates(t: Tables) -> DataFrame:
    """Customers whose orders disagree, and in what; sets are small, so one aggregation serves all the distinct counts."""
    d = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.collect_set("o_orderstatus").alias("s"), F.collect_set("o_orderpriority").alias("p"))
    kind = F.when(F.size("s") > 1, "status").when(F.size("p") > 1, "priority").otherwise("none")
    return d.select("o_custkey", "orders", F.size("s").cast("long").alias("statuses"), F.size("p").cast("long").alias("priorities"), F.array_join(F.sort_array("s"), ",").alias("seen"), kind.alias("conflict"))


@query(
    "stale_requeue",
    f"""
SELECT event_type, CASE WHEN ts < {_END} - INTERVAL 120 MINUTE THEN 'requeued' ELSE 'running' END AS state, count(*) AS n FROM events WHERE ts < {_END} GROUP BY ALL
""",
)
def stale_requeue(t: Tables) -> DataFrame:
    """Tasks under way for over 120 minutes at a given time go back to the queue."""
    d = t.events.filter(F.expr(f"ts < {_END}"))
    return d.groupBy("event_type", F.expr(f"CASE WHEN ts < {_END} - INTERVAL '120' MINUTE THEN 'requeued' ELSE 'running' END").alias("state")).agg(F.count("*").alias("n"))


@query(
    "ops_snapshot",
    """
SELECT CAST(ts AS DATE) AS day, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases,
  greatest(count(*) FILTER (event_type = 'click') - count(*) FILTER (event_type = 'view'), 0) AS backlog, round(coalesce(sum(value), 0), 4) AS total, count(DISTINCT user_id) AS users, max(event_id) AS last_event FROM events GROUP BY day
""",
)
def ops_snapshot(t: Tables) -> DataFrame:
    """A day's figures in one pass of filtered aggregates."""
    of = lambda k: F.count_if(F.col("event_type") == k)
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("events"), of("error").alias("errors"), of("purchase").alias("purchases"), F.greatest(of("click") - of("view"), F.lit(0)).alias("backlog"),
        F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total"), F.count_distinct("user_id").alias("users"), F.max("event_id").alias("last_event"),
    )


@query(
    "failure_circuit",
    """
WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'purchase') AS successes FROM events GROUP BY 1),
w AS (SELECT hour, sum(failures) OVER x AS failures, sum(successes) OVER x AS successes FROM h WINDOW x AS (ORDER BY hour RANGE BETWEEN INTERVAL 5 HOUR PRECEDING AND CURRENT ROW))
SELECT hour, CAST(failures AS BIGINT) AS failures, CAST(successes AS BIGINT) AS successes, failures >= 5 AND successes <= 2 AS tripped FROM w
""",
)
def failure_circuit(t: Tables) -> DataFrame:
    """Whether the last six hours were all failure. Hours are pre-aggregated, so the window over all time sees few rows."""
    h = t.events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count_if(F.col("event_type") == "error").alias("f"), F.count_if(F.col("event_type") == "purchase").alias("s"))
    over = "OVER (ORDER BY hour RANGE BETWEEN INTERVAL '5' HOUR PRECEDING AND CURRENT ROW)"
    d = h.selectExpr("CAST(hour AS TIMESTAMP_NTZ) AS hour", f"sum(f) {over} AS failures", f"sum(s) {over} AS successes")
    return d.withColumn("tripped", (F.col("failures") >= 5) & (F.col("successes") <= 2))


@query(
    "quota_attempts",
    """
SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_hour, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS in_day FROM events
""",
)
def quota_attempts(t: Tables) -> DataFrame:
    """Attempts of a user in the hour before each one, and on its day."""
    return t.events.selectExpr("event_id", "user_id", "count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS in_hour", "count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS in_day")


@query(
    "funnel_corrected",
    """
WITH u AS (SELECT user_id, bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS c, bool_or(event_type = 'purchase') AS p FROM events GROUP BY user_id),
f AS (SELECT count(*) FILTER (v) AS viewed, count(*) FILTER (c) AS clicked, count(*) FILTER (p) AS bought FROM u)
SELECT greatest(viewed, clicked, bought) AS viewed, greatest(clicked, bought) AS clicked, bought, greatest(0, greatest(viewed, clicked, bought) - greatest(clicked, bought)) AS lost_before_click FROM f
""",
)
def funnel_corrected(t: Tables) -> DataFrame:
    """A funnel whose earlier steps count at least as many as later ones."""
    has = lambda k: F.bool_or(F.col("event_type") == k)
    u = t.events.groupBy("user_id").agg(has("view").alias("v"), has("click").alias("c"), has("purchase").alias("p"))
    f = u.agg(F.count_if("v").alias("v"), F.count_if("c").alias("c"), F.count_if("p").alias("bought"))
    f = f.select(F.greatest("v", "c", "bought").alias("viewed"), F.greatest("c", "bought").alias("clicked"), "bought")
    return f.withColumn("lost_before_click", F.greatest(F.lit(0), F.col("viewed") - F.col("clicked")))


@query(
    "json_predicate_rollup",
    "SELECT coalesce(CAST(json_extract(props, '$.k') AS INTEGER) % 5, -1) AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) >= 10 GROUP BY ALL",
)
def json_predicate_rollup(t: Tables) -> DataFrame:
    """A predicate and a grouping on a field of a JSON text."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    d = t.events.select(k.alias("k"), "event_type", "value").filter("k >= 10")
    return d.groupBy((F.col("k") % 5).alias("bucket"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "meal_by_local_hour",
    """
SELECT CASE WHEN h BETWEEN 4 AND 10 THEN 'breakfast' WHEN h BETWEEN 11 AND 15 THEN 'lunch' WHEN h BETWEEN 16 AND 21 THEN 'dinner' ELSE 'snack' END AS meal, count(*) AS n FROM (SELECT hour(ts + INTERVAL 3 HOUR) AS h FROM events) GROUP BY meal
""",
)
def meal_by_local_hour(t: Tables) -> DataFrame:
    """Events by the meal of their local hour, three hours east."""
    h = F.hour(F.expr("ts + INTERVAL '3' HOUR"))
    meal = F.when(h.between(4, 10), "breakfast").when(h.between(11, 15), "lunch").when(h.between(16, 21), "dinner").otherwise("snack")
    return t.events.groupBy(meal.alias("meal")).agg(F.count("*").alias("n"))


@query(
    "recent_distinct",
    "SELECT user_id, event_type, CAST(place AS INTEGER) AS place FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS place FROM (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY ALL)) WHERE place <= 3",
)
def recent_distinct(t: Tables) -> DataFrame:
    """A user's last three different event types, newest first; pre-aggregated before ranking."""
    d = t.events.groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"))
    return d.select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), "event_type")).alias("place")).filter("place <= 3")


@query(
    "daily_totals",
    """
SELECT user_id, CAST(ts AS DATE) AS day, event_type || '|u' AS measure, round(sum(value), 4) AS amount, count(value) AS known, count(*) AS total FROM events GROUP BY ALL
""",
)
def daily_totals(t: Tables) -> DataFrame:
    """Totals by day and composite measure, with how many of the rows had a value: unknown is never zero."""
    key = F.concat("event_type", F.lit("|u")).alias("measure")
    return t.events.groupBy("user_id", F.to_date("ts").alias("day"), key).agg(F.round(F.sum("value"), 4).alias("amount"), F.count("value").alias("known"), F.count("*").alias("total"))


@query(
    "macro_targets",
    """
WITH u AS (SELECT user_id, round(sum(value), 2) AS energy FROM events GROUP BY user_id)
SELECT user_id, energy, round(energy * 0.3 / 4, 6) AS protein, round(energy * 0.4 / 4, 6) AS carbohydrate, round(energy * 0.3 / 9, 6) AS fat FROM u
""",
)
def macro_targets(t: Tables) -> DataFrame:
    """Shares of an energy target in grams."""
    u = t.events.groupBy("user_id").agg(F.round(F.sum("value"), 2).alias("energy"))
    e = F.col("energy")
    return u.select("user_id", "energy", F.round(e * 0.3 / 4, 6).alias("protein"), F.round(e * 0.4 / 4, 6).alias("carbohydrate"), F.round(e * 0.3 / 9, 6).alias("fat"))
