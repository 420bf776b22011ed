"""Review work as tables: stock and deficits, blockers, representative rows, lookups by several keys, metrics, state changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.registry import Tables, query

from .relational import best

#: The order of a slot's states.
SLOT_ORDER = ("submitted", "in_progress", "assigned", "open", "cancelled")


def latest_once(rows: DataFrame, key: str, created: str, seen: Column) -> DataFrame:
    """The newest row of each key; of equally new ones the first seen."""
    return best(rows, [key], F.col(created).desc_nulls_last(), seen)


@query(
    "latest_extractions",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, event_id) AS rn FROM events) WHERE rn = 1",
)
def latest_extractions(t: Tables) -> DataFrame:
    d = t.events.select("user_id", "event_id", "event_type", F.date_trunc("day", "ts").alias("day"))
    return latest_once(d, "user_id", "day", F.col("event_id")).select("user_id", "event_id", "event_type")


def representative(slots: DataFrame, key: str) -> DataFrame:
    """One slot(key, status, assigned_at, slot_key) of each key: by state, then newest assigned, then slot key."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SLOT_ORDER)), F.col("status")), F.lit(0)), F.lit(99))
    return best(slots, [key], place, F.col("assigned_at").desc_nulls_last(), F.col("slot_key"))


@query(
    "training_queue",
    """
WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE o_orderstatus WHEN 'F' THEN 'submitted' WHEN 'P' THEN 'assigned' ELSE 'open' END AS status FROM orders),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE status WHEN 'submitted' THEN 1 WHEN 'assigned' THEN 3 ELSE 4 END, o_orderdate DESC, o_orderkey) AS rn FROM s) WHERE rn = 1),
q AS (SELECT o_custkey, o_orderkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY CASE WHEN status = 'open' THEN 0 ELSE 1 END, o_orderkey) AS place FROM r JOIN customer ON c_custkey = o_custkey)
SELECT o_custkey, o_orderkey, c_mktsegment, CAST(place AS INTEGER) AS place FROM q
""",
)
def training_queue(t: Tables) -> DataFrame:
    """A representative order of each customer, live ones first, with its turn when segments are dealt in rotation."""
    status = F.when(F.col("o_orderstatus") == "F", "submitted").when(F.col("o_orderstatus") == "P", "assigned").otherwise("open")
    s = t.orders.select("o_custkey", status.alias("status"), F.col("o_orderdate").alias("assigned_at"), F.col("o_orderkey").alias("slot_key"))
    r = representative(s, "o_custkey").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.when(F.col("status") == "open", 0).otherwise(1), "slot_key"))
    return r.select("o_custkey", F.col("slot_key").alias("o_orderkey"), "c_mktsegment", place.alias("place"))


@query(
    "reviewer_metrics",
    """
WITH m AS (SELECT o_custkey, count(*) AS submitted, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'F') AS accepted, count(*) FILTER (o_orderstatus = 'P') AS superseded FROM orders GROUP BY o_custkey),
c AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS corrected, count(*) AS corrections FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_discount > 0.08 GROUP BY o_custkey)
SELECT m.*, coalesce(corrected, 0) AS corrected, coalesce(corrections, 0) AS corrections FROM m LEFT JOIN c USING (o_custkey)
""",
)
def reviewer_metrics(t: Tables) -> DataFrame:
    """What each reviewer handed in, by state, and how much of it was corrected."""
    state = lambda s: F.count_if(F.col("o_orderstatus") == s)
    m = t.orders.groupBy("o_custkey").agg(F.count("*").alias("submitted"), state("O").alias("pending"), state("F").alias("accepted"), state("P").alias("superseded"))
    fixed = t.lineitem.filter("l_returnflag = 'R' AND l_discount > 0.08").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    c = t.orders.select("o_orderkey", "o_custkey").join(fixed, "o_orderkey").groupBy("o_custkey").agg(F.count("*").alias("corrected"), F.sum("n").alias("corrections"))
    return m.join(c, "o_custkey", "left").na.fill(0, ["corrected", "corrections"])


def lookup_ladder(rows: DataFrame, known: DataFrame, id_: str, keys: list[str]) -> DataFrame:
    """rows with found_id and found_by: the known row with the same first key, else the second, and so on.

    Of several known rows with one key the smallest id counts; blank and null keys find nothing. Each key is a join of its
    own on distinct keys, so rows aren't multiplied.
    """
    out = rows
    for k in keys:
        index = known.filter(F.trim(F.col(k).cast("string")) != "").groupBy(F.col(k).alias(f"__k_{k}")).agg(F.min(id_).alias(f"__id_{k}"))
        out = out.join(index, out[k] == F.col(f"__k_{k}"), "left").drop(f"__k_{k}")
    found = F.coalesce(*[F.col(f"__id_{k}") for k in keys])
    by = reduce(lambda c, k: c.when(F.col(f"__id_{k}").isNotNull(), k), keys[1:], F.when(F.col(f"__id_{keys[0]}").isNotNull(), keys[0]))
    return out.withColumns({"found_id": found, "found_by": by}).drop(*[f"__id_{k}" for k in keys])


@query(
    "existing_lookup",
    """
WITH r AS (SELECT p_partkey, p_name || p_size AS a, p_brand || p_type || (p_size + 2) AS b, p_size AS c FROM part), k AS (SELECT p_partkey AS id, p_name || (p_size + 7) AS a, p_brand || p_type || p_size AS b, p_size + 1 AS c FROM part)
SELECT p_partkey, coalesce(x.id, y.id, z.id) AS found_id, CASE WHEN x.id IS NOT NULL THEN 'a' WHEN y.id IS NOT NULL THEN 'b' WHEN z.id IS NOT NULL THEN 'c' END AS found_by FROM r
LEFT JOIN (SELECT a, min(id) AS id FROM k GROUP BY a) x ON x.a = r.a LEFT JOIN (SELECT b, min(id) AS id FROM k GROUP BY b) y ON y.b = r.b LEFT JOIN (SELECT c, min(id) AS id FROM k GROUP BY c) z ON z.c = r.c
""",
)
def existing_lookup(t: Tables) -> DataFrame:
    """Which known part a new one is, by the best of three keys; sizes were counted in another way when the known ones were written."""
    keys = lambda a, b, c: [F.concat("p_name", (F.col("p_size") + a).cast("string")).alias("a"), F.concat("p_brand", "p_type", (F.col("p_size") + b).cast("string")).alias("b"), (F.col("p_size") + c).alias("c")]
    rows, known = t.part.select("p_partkey", *keys(0, 2, 0)), t.part.select(F.col("p_partkey").alias("id"), *keys(7, 0, 1))
    return lookup_ladder(rows, known, "id", ["a", "b", "c"]).select("p_partkey", "found_id", "found_by")


def stock(counts: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """counts(kind, ready) as kind, ready, wanted, deficit, for every kind that is wanted."""
    w = counts.sparkSession.createDataFrame(sorted(wanted.items()), "kind string, wanted long")
    return w.join(counts, "kind", "left").select("kind", F.coalesce("ready", F.lit(0)).alias("ready"), "wanted", F.greatest(F.col("wanted") - F.coalesce("ready", F.lit(0)), F.lit(0)).alias("deficit"))


@query(
    "stock_deficits",
    """
WITH r AS (SELECT o_orderpriority AS kind, count(*) AS ready FROM orders WHERE o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1), w(kind, wanted) AS (VALUES ('1-URGENT', 25), ('2-HIGH', 1), ('9-NEVER', 3))
SELECT w.kind, coalesce(ready, 0) AS ready, CAST(wanted AS BIGINT) AS wanted, CAST(greatest(wanted - coalesce(ready, 0), 0) AS BIGINT) AS deficit FROM w LEFT JOIN r USING (kind)
""",
)
def stock_deficits(t: Tables) -> DataFrame:
    """How much ready work of each kind there is, and lacks."""
    blocked = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    ready = t.orders.filter("o_orderstatus = 'P'").join(blocked, "o_orderkey", "left_anti").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("ready"))
    return stock(ready, {"1-URGENT": 25, "2-HIGH": 1, "9-NEVER": 3})


def cancel_on_closed(work: DataFrame, routes: DataFrame, key: str) -> DataFrame:
    """work(key, status) with open work on a closed route(key, closed) cancelled; work that people have begun blocks that."""
    begun = F.bool_or(F.col("status").isin("in_progress", "submitted")).over(Window.partitionBy(key))
    d = work.withColumn("__begun", begun).join(routes, key, "left")
    stop = F.coalesce(F.col("closed"), F.lit(False)) & ~F.col("__begun") & F.col("status").isin("open", "assigned")
    return d.withColumn("status", F.when(stop, "cancelled").otherwise(F.col("status"))).withColumn("blocked", F.coalesce(F.col("closed"), F.lit(False)) & F.col("__begun")).drop("__begun", "closed")


@query(
    "closed_routes",
    """
WITH w AS (SELECT l_orderkey AS k, CASE l_returnflag WHEN 'R' THEN 'in_progress' WHEN 'A' THEN 'assigned' ELSE 'open' END AS status FROM lineitem), b AS (SELECT k, bool_or(status = 'in_progress') AS begun FROM w GROUP BY k),
x AS (SELECT w.k, CASE WHEN o_orderstatus = 'F' AND NOT begun AND status IN ('open', 'assigned') THEN 'cancelled' ELSE status END AS status, o_orderstatus = 'F' AND begun AS blocked FROM w JOIN b USING (k) JOIN orders ON o_orderkey = w.k)
SELECT status, blocked, count(*) AS n FROM x GROUP BY ALL
""",
)
def closed_routes(t: Tables) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "in_progress").when(F.col("l_returnflag") == "A", "assigned").otherwise("open")
    w = t.lineitem.select(F.col("l_orderkey").alias("k"), status.alias("status"))
    routes = t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_orderstatus") == "F").alias("closed"))
    return cancel_on_closed(w, routes, "k").groupBy("status", "blocked").agg(F.count("*").alias("n"))


def recovery_order(first: DataFrame, second: DataFrame, key: str, *order: Column) -> DataFrame:
    """All of the first source, and of the second what the first lacks, with `origin` and `place` in the order given."""
    both = first.withColumn("origin", F.lit(1)).unionByName(second.join(first.select(key), key, "left_anti").select(*second.columns).withColumn("origin", F.lit(2)))
    return both.orderBy(*order, "origin", key)


@query(
    "recovery_ranking",
    """
WITH a AS (SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND n_chars > 400), b AS (SELECT doc_id, n_chars FROM documents WHERE source = 'src0' AND n_chars > 200)
SELECT doc_id, n_chars, origin FROM (SELECT *, 1 AS origin FROM a UNION ALL SELECT *, 2 FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)) ORDER BY n_chars DESC, origin, doc_id LIMIT 60
""",
)
def recovery_ranking(t: Tables) -> DataFrame:
    """The sixty best candidates of two sources: a top-k report."""
    d = t.documents.select("doc_id", "lang", "source", "n_chars")
    a, b = d.filter("lang = 'en' AND n_chars > 400").select("doc_id", "n_chars"), d.filter("source = 'src0' AND n_chars > 200").select("doc_id", "n_chars")
    return recovery_order(a, b, "doc_id", F.col("n_chars").desc()).limit(60)


def prepare_hits(hits: DataFrame, required: list[str], key: Column) -> tuple[DataFrame, DataFrame]:
    """(ready, refused): hits with all required fields, one for each key (`hit_key`, computed where it is missing), and the others."""
    have = reduce(lambda a, b: a & b, [F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)) for c in required])
    own = F.coalesce(F.nullif(F.col("hit_key"), F.lit("")), key) if "hit_key" in hits.columns else key
    good = hits.filter(have).withColumn("hit_key", own)
    return good.dropDuplicates(["hit_key"]), hits.filter(~have)


def next_state(tasks: DataFrame, votes: DataFrame, key: str, needed: int = 2) -> DataFrame:
    """key, state, resolution of each task after its votes(key, who, verdict, ts): each person's latest vote counts.

    `needed` equal votes resolve a task; votes of both kinds by enough people are a conflict; a task with some is in review.
    """
    last = best(votes, [key, "who"], F.col("ts").desc_nulls_last(), F.col("verdict"))
    n = last.groupBy(key).agg(F.count("*").alias("people"), F.count_if(F.col("verdict") == "yes").alias("yes"), F.count_if(F.col("verdict") == "no").alias("no"))
    d = tasks.join(n, key, "left").na.fill(0, ["people", "yes", "no"])
    state = F.when((F.col("yes") > 0) & (F.col("no") > 0) & (F.col("people") >= needed), "conflict").when(F.greatest("yes", "no") >= needed, "resolved").when(F.col("people") > 0, "in_review").otherwise("queued")
    return d.withColumn("state", state).withColumn("resolution", F.when(F.col("state") == "resolved", F.when(F.col("yes") > 0, "yes").otherwise("no")))


@query(
    "resolution_states",
    """
WITH v AS (SELECT user_id % 50 AS task, event_id % 3 AS who, CASE WHEN value > 60 THEN 'yes' ELSE 'no' END AS verdict, ts FROM events WHERE event_type = 'click'),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task, who ORDER BY ts DESC, verdict) AS rn FROM v) WHERE rn = 1),
n AS (SELECT task, count(*) AS p, count(*) FILTER (verdict = 'yes') AS y, count(*) FILTER (verdict = 'no') AS n FROM l GROUP BY task), a AS (SELECT DISTINCT user_id % 50 AS task FROM events)
SELECT task, CASE WHEN y > 0 AND n > 0 AND p >= 2 THEN 'conflict' WHEN greatest(y, n) >= 2 THEN 'resolved' WHEN p > 0 THEN 'in_review' ELSE 'queued' END AS state, CASE WHEN NOT (y > 0 AND n > 0 AND p >= 2) AND greatest(y, n) >= 2 THEN CASE WHEN y > 0 THEN 'yes' ELSE 'no' END END AS resolution FROM a LEFT JOIN n USING (task)
""",
)
def resolution_states(t: Tables) -> DataFrame:
    task = (F.col("user_id") % 50).alias("task")
    v = t.events.filter("event_type = 'click'").select(task, (F.col("event_id") % 3).alias("who"), F.when(F.col("value") > 60, "yes").otherwise("no").alias("verdict"), "ts")
    return next_state(t.events.select(task).distinct(), v, "task").select("task", "state", "resolution")


def not_assignable(assignments: DataFrame, tasks: DataFrame, key: str) -> DataFrame:
    """Assignments whose task isn't there or isn't ready for people: what a guard would refuse."""
    return assignments.join(tasks.filter("human_review_ready").select(key), key, "left_anti")


@query(
    "unready_assignments",
    "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus IN ('O', 'P')) GROUP BY l_orderkey",
)
def unready_assignments(t: Tables) -> DataFrame:
    tasks = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").isin("O", "P").alias("human_review_ready"))
    return not_assignable(t.lineitem.filter("l_returnflag = 'N'").select("l_orderkey"), tasks, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


def advance_cursor(state: DataFrame, batch: DataFrame, source: str, key: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(new, state): rows of a batch past its source's cursor, one for each key, and the cursors after them. state: source, at."""
    d = batch.join(state.select(source, F.col(at).alias("__at")), source, "left").filter(F.col("__at").isNull() | (F.col(at) > F.col("__at"))).drop("__at")
    new = best(d, [key], F.col(at), F.col(source))
    moved = d.groupBy(source).agg(F.max(at).alias(at)).unionByName(state.select(source, at)).groupBy(source).agg(F.max(at).alias(at))
    return new, moved


@query(
    "cursor_state",
    """
WITH s AS (SELECT event_type, max(ts) AS c FROM events WHERE event_id % 2 = 0 AND event_type <> 'view' GROUP BY event_type), n AS (SELECT e.* FROM events e LEFT JOIN s USING (event_type) WHERE s.c IS NULL OR e.ts > s.c)
SELECT event_type, (SELECT count(*) FROM (SELECT user_id, arg_min(event_type, {'t': ts, 'e': event_type}) AS first_type FROM n GROUP BY user_id) WHERE first_type = x.event_type) AS new_users, max(c) AS cursor_ts
FROM (SELECT event_type, c FROM s UNION ALL SELECT event_type, ts FROM n) x GROUP BY event_type
""",
)
def cursor_state(t: Tables) -> DataFrame:
    """What a second batch adds beyond each source's cursor, and where the cursors stand then."""
    e = t.events.select("event_type", "user_id", F.col("ts").alias("at"))
    s = t.events.filter("event_id % 2 = 0 AND event_type <> 'view'").groupBy("event_type").agg(F.max("ts").alias("at"))
    new, moved = advance_cursor(s, e, "event_type", "user_id", "at")
    return moved.join(new.groupBy("event_type").agg(F.count("*").alias("new_users")), "event_type", "left").select("event_type", F.coalesce("new_users", F.lit(0)).alias("new_users"), F.col("at").alias("cursor_ts"))


def sessions(events: DataFrame, who: str, ts: str, gap_seconds: int) -> DataFrame:
    """who, session, first, last, n: a person's events with less than the gap between neighbours. On a stream: F.session_window."""
    w = Window.partitionBy(who).orderBy(ts)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    new = F.coalesce(micros(F.col(ts)) - micros(F.lag(ts).over(w)) >= gap_seconds * 1_000_000, F.lit(True))
    d = events.withColumn("__new", new.cast("int")).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return d.groupBy(who, "session").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))


@query(
    "search_sessions",
    """
WITH d AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 86400000000 THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM d)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, session
""",
)
def search_sessions(t: Tables) -> DataFrame:
    return sessions(t.events.select("user_id", "ts"), "user_id", "ts", 86_400)


def check_counts(tables: dict[str, DataFrame], official: dict[str, int]) -> dict[str, int]:
    """Row counts of the tables, or an error that names those that differ from the official ones."""
    found = {name: tables[name].count() for name in official}
    wrong = {name: (found[name], n) for name, n in official.items() if found[name] != n}
    if wrong:
        raise ValueError(f"rows found and expected: {wrong}")
    return found


def refuse_audit(factors: DataFrame, reviewed: DataFrame) -> DataFrame:
    """factors(food_code, source, refuse, description) as food_code, refuse, state by food.

    One value: `agreed`; several: `conflict`, unless a reviewed(food_code, refuse) value is among them (`reviewed`) or isn't (an
    override that no source has: `unsupported`); a description with several parts (two or more commas or `and`) is `composite`.
    """
    d = factors.groupBy("food_code").agg(F.sort_array(F.collect_set("refuse")).alias("v"), F.max(F.regexp_count(F.coalesce("description", F.lit("")), F.lit(r",|\band\b"))).alias("parts"))
    d = d.join(reviewed.select("food_code", F.col("refuse").alias("r")), "food_code", "left")
    state = F.when(F.col("r").isNotNull(), F.when(F.array_contains("v", F.col("r")), "reviewed").otherwise("unsupported")).when(F.size("v") > 1, "conflict").when(F.col("parts") >= 2, "composite").otherwise("agreed")
    return d.select("food_code", F.coalesce("r", F.when(F.size("v") == 1, F.get("v", F.lit(0)))).alias("refuse"), state.alias("state"))


@query(
    "refuse_factors",
    """
WITH f AS (SELECT l_partkey AS food_code, list_sort(list_distinct(list(CAST(l_discount * 100 AS INTEGER) // 9))) AS v FROM lineitem GROUP BY l_partkey), r AS (SELECT p_partkey AS food_code, p_size % 2 AS r FROM part WHERE p_size % 5 = 0)
SELECT food_code, CAST(coalesce(r, CASE WHEN len(v) = 1 THEN v[1] END) AS INTEGER) AS refuse, CASE WHEN r IS NOT NULL THEN CASE WHEN list_contains(v, r) THEN 'reviewed' ELSE 'unsupported' END WHEN len(v) > 1 THEN 'conflict' ELSE 'agreed' END AS state FROM f LEFT JOIN r USING (food_code)
""",
)
def refuse_factors(t: Tables) -> DataFrame:
    value = F.floor(F.round(F.col("l_discount") * 100) / 9).cast("int")
    f = t.lineitem.select(F.col("l_partkey").alias("food_code"), F.col("l_suppkey").alias("source"), value.alias("refuse"), F.lit("Core").alias("description"))
    # every fifth size was looked at by a person
    return refuse_audit(f, t.part.select(F.col("p_partkey").alias("food_code"), F.when(F.col("p_size") % 5 == 0, F.col("p_size") % 2).alias("refuse")))
