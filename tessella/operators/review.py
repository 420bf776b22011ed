"""Review of papers by several people as steps from one state of tables to the next: work saved, reviews handed in, conflicts decided, papers closed.

A state is a set of tables (see ``SCHEMAS``). A step takes many requests at once and gives the next state and the requests that it refuses,
with the reason; of several requests for one row the earliest that may be done is done, the others are refused or see its
result, as if they had come one after the other. A request that names a version is done only if the row still has it. ``refresh`` then
settles the papers concerned: slots agree or not, and two official slots make an outcome or a conflict.

Each step is joins and aggregations by paper, slot or assignment, so papers are settled side by side. Steps are lazy: write a state
before many more follow.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.plans.registry import Tables, query, stored_bytes

from .relational import best

SCHEMAS = {
    "slots": "paper long, slot string, official boolean, status string, official_id long, submitted_at timestamp, resolved_at timestamp",
    "assignments": "id long, paper long, slot string, reviewer long, role string, user long, status string, latest long, created_at timestamp, saved_at timestamp, submitted_at timestamp, resolved_at timestamp, version int",
    "submissions": "id long, assignment long, paper long, user long, decision string, hash string, at timestamp",
    "conflicts": "id string, paper long, kind string, slot string, left long, right long, status string, chosen long, by long, created_at timestamp, resolved_at timestamp",
    "outcomes": "paper long, decision string, source string, hash string, a long, b long, chosen long, conflict string, by long, at timestamp",
}
#: States of an assignment that saving work leaves as they are, those that take no review, and the decisions of one.
SETTLED, CLOSED, DECISIONS = ("submitted", "resolved", "conflict", "cancelled"), ("resolved", "cancelled"), ("has_data", "no_usable_data")
INTERNAL, EXTERNAL = "internal_slot_conflict", "external_slot_conflict"


@dataclass(frozen=True)
class State:
    slots: DataFrame
    assignments: DataFrame
    submissions: DataFrame
    conflicts: DataFrame
    outcomes: DataFrame


def _first(reasons: list[tuple[str, Column]]) -> Column:
    """The name of the first test that is true; null if none is."""
    return reduce(lambda c, r: c.when(F.coalesce(r[1], F.lit(False)), F.lit(r[0])), reasons[1:], F.when(F.coalesce(reasons[0][1], F.lit(False)), F.lit(reasons[0][0])))


def _split(requests: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(the first request of each key that has no reason, the refused ones); a later one that could be done too is `changed_meanwhile`."""
    fine = best(requests.filter("reason IS NULL"), [key], F.col("at"), F.col("request"))
    late = requests.filter("reason IS NULL").join(fine.select(F.col("request").alias("__done")), F.col("request") == F.col("__done"), "left_anti").withColumn("reason", F.lit("changed_meanwhile"))
    return fine.drop("reason"), requests.filter("reason IS NOT NULL").unionByName(late).select("request", "reason")


def _owned(state: State, requests: DataFrame) -> DataFrame:
    """requests(request, assignment, user, at, may_write, and perhaps expected) with the state of their assignment, if the user has it."""
    r = requests if "expected" in requests.columns else requests.withColumn("expected", F.lit(None).cast("int"))
    a = state.assignments.select(F.col("id").alias("assignment"), F.col("user").alias("owner"), F.col("paper").alias("its_paper"), F.col("status").alias("its_status"), F.col("version").alias("its_version"))
    return r.join(a, "assignment", "left")


def _common() -> list[tuple[str, Column]]:
    return [("read_only", ~F.col("may_write")), ("not_yours", ~F.col("owner").eqNullSafe(F.col("user")))]


def _stale() -> tuple[str, Column]:
    return "changed_meanwhile", F.col("expected").isNotNull() & (F.col("expected") != F.col("its_version"))


def _changed(assignments: DataFrame, done: DataFrame, values: dict[str, Column]) -> DataFrame:
    """assignments with new values (over the columns of done as ``d``) in those that done(assignment ...) names; their versions go up."""
    d = assignments.alias("a").join(done.alias("d"), F.col("a.id") == F.col("d.assignment"), "left")
    hit = F.col("d.assignment").isNotNull()
    new = {c: F.when(hit, values[c]).otherwise(F.col(f"a.{c}")) for c in values} | {"version": F.col("a.version") + hit.cast("int")}
    return d.select(*[new[c].alias(c) if c in new else F.col(f"a.{c}").alias(c) for c in assignments.columns])


def touch(state: State, requests: DataFrame) -> tuple[State, DataFrame]:
    """Save work: requests(request, assignment, user, status, at, may_write). What is handed in, settled or cancelled keeps its status."""
    d = _owned(state, requests)
    d = d.withColumn("reason", _first([("unknown_status", ~F.col("status").isin("assigned", "draft")), *_common(), _stale()]))
    done, refused = _split(d, "assignment")
    status = F.when(F.col("a.status").isin(*SETTLED), F.col("a.status")).otherwise(F.col("d.status"))
    return replace(state, assignments=_changed(state.assignments, done, {"status": status, "saved_at": F.col("d.at")})), refused


def submit(state: State, requests: DataFrame) -> tuple[State, DataFrame]:
    """Hand in reviews: requests(request, assignment, user, decision, hash, foods, nutrients, at, may_write); a submission's id is its request's.

    A review with data needs a food with nutrient rows. Papers concerned are settled.
    """
    d = _owned(state, requests)
    empty = (F.col("decision") == "has_data") & ((F.coalesce("foods", F.lit(0)) <= 0) | (F.coalesce("nutrients", F.lit(0)) <= 0))
    d = d.withColumn("reason", _first([("unknown_decision", ~F.col("decision").isin(*DECISIONS)), *_common(), ("closed", F.col("its_status").isin(*CLOSED)), ("no_rows", empty), _stale()]))
    done, refused = _split(d, "assignment")
    new = done.select(F.col("request").alias("id"), "assignment", F.col("its_paper").alias("paper"), "user", "decision", "hash", "at")
    assignments = _changed(state.assignments, done, {"latest": F.col("d.request"), "status": F.lit("submitted"), "submitted_at": F.col("d.at"), "saved_at": F.col("d.at")})
    after = replace(state, assignments=assignments, submissions=state.submissions.unionByName(new))
    return refresh(after, new.groupBy("paper").agg(F.max("at").alias("now"))), refused


def resolve(state: State, requests: DataFrame) -> tuple[State, DataFrame]:
    """Decide conflicts: requests(request, conflict, chosen, user, at, may_write). The chosen submission is one of its sides. Papers concerned are settled."""
    open_ = state.conflicts.select(F.col("id").alias("conflict"), F.col("paper").alias("its_paper"), "left", "right", F.col("status").alias("its_status"))
    d = requests.join(open_, "conflict", "left")
    d = d.withColumn("reason", _first([("read_only", ~F.col("may_write")), ("not_open", ~F.col("its_status").eqNullSafe(F.lit("open"))), ("not_a_side", ~F.col("chosen").isin(F.col("left"), F.col("right")))]))
    done, refused = _split(d, "conflict")
    c = state.conflicts.alias("c").join(done.alias("d"), F.col("c.id") == F.col("d.conflict"), "left")
    hit = F.col("d.conflict").isNotNull()
    new = {"status": F.lit("resolved"), "chosen": F.col("d.chosen"), "by": F.col("d.user"), "resolved_at": F.col("d.at")}
    conflicts = c.select(*[F.when(hit, new[k]).otherwise(F.col(f"c.{k}")).alias(k) if k in new else F.col(f"c.{k}").alias(k) for k in state.conflicts.columns])
    return refresh(replace(state, conflicts=conflicts), done.groupBy(F.col("its_paper").alias("paper")).agg(F.max("at").alias("now"))), refused


def close_without_data(state: State, requests: DataFrame) -> tuple[State, DataFrame]:
    """Say of whole papers that they have no data: requests(request, assignment, user, note, at, may_write). All their work is cancelled.

    A paper is closed once; a paper with an outcome stays as it is.
    """
    d = _owned(state, requests).join(state.outcomes.select(F.col("paper").alias("its_paper"), F.lit(True).alias("has_outcome")), "its_paper", "left")
    reasons = [("no_reason", F.trim(F.coalesce("note", F.lit(""))) == ""), *_common(), ("closed", F.col("its_status").isin(*CLOSED)), ("has_outcome", F.col("has_outcome")), _stale()]
    done, refused = _split(d.withColumn("reason", _first(reasons)), "its_paper")
    p = done.select(F.col("its_paper").alias("__paper"), F.col("at").alias("__at"), F.col("user").alias("__user"))

    def cancelled(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
        j = df.join(p, df["paper"] == F.col("__paper"), "left")
        hit = F.col("__paper").isNotNull() & where
        return j.select(*[F.when(hit, values[c]).otherwise(df[c]).alias(c) if c in values else df[c] for c in df.columns])

    live = F.col("status") != "cancelled"
    now = F.col("__at")
    outcome = done.select(F.col("its_paper").alias("paper"), F.lit("no_usable_data").alias("decision"), F.lit("global_skip").alias("source"), F.sha2(F.lit('{"decision_kind":"no_usable_data","food_items":[]}'), 256).alias("hash"), *[F.lit(None).cast("long").alias(c) for c in ("a", "b", "chosen")], F.lit(None).cast("string").alias("conflict"), F.col("user").alias("by"), "at")
    after = State(
        slots=cancelled(state.slots, live, {"status": F.lit("cancelled"), "official_id": F.lit(None).cast("long"), "resolved_at": now}),
        assignments=cancelled(state.assignments, live, {"status": F.lit("cancelled"), "resolved_at": now, "version": F.col("version") + 1}),
        submissions=state.submissions,
        conflicts=cancelled(state.conflicts, F.col("status") == "open", {"status": F.lit("cancelled"), "resolved_at": F.coalesce("resolved_at", now)}),
        outcomes=state.outcomes.unionByName(outcome),
    )
    return after, refused


def _decided(conflicts: DataFrame, kind: str, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs(keys, left, right) with the latest decision (chosen, conflict, by) of a conflict between the two, whichever side they were on."""
    ends = lambda d: d.withColumns({"__lo": F.least("left", "right"), "__hi": F.greatest("left", "right")})
    done = ends(conflicts.filter((F.col("kind") == kind) & (F.col("status") == "resolved")))
    done = best(done, [*keys, "__lo", "__hi"], F.col("resolved_at").desc_nulls_last(), F.col("created_at").desc()).select(*keys, "__lo", "__hi", "chosen", F.col("id").alias("conflict"))
    return ends(pairs).join(done, [*keys, "__lo", "__hi"], "left").drop("__lo", "__hi")


def _opened(conflicts: DataFrame, kind: str, pairs: DataFrame) -> DataFrame:
    """conflicts with an open one of a kind for each of pairs(paper, slot, left, right, now): the one that is open, brought up to date, or a new one."""
    p = pairs.select(F.col("paper").alias("__p"), F.col("slot").alias("__s"), F.col("left").alias("__l"), F.col("right").alias("__r"), F.col("now").alias("__now"))
    j = conflicts.join(p, (F.col("paper") == F.col("__p")) & F.col("slot").eqNullSafe(F.col("__s")) & (F.col("kind") == kind) & (F.col("status") == "open"), "left")
    hit = F.col("__p").isNotNull()
    kept = j.select(*[F.when(hit, F.col({"left": "__l", "right": "__r", "created_at": "__now"}[c])).otherwise(F.col(c)).alias(c) if c in ("left", "right", "created_at") else F.col(c) for c in conflicts.columns])
    n = conflicts.filter(F.col("kind") == kind).groupBy(F.col("paper").alias("__cp"), F.col("slot").alias("__cs")).agg(F.count("*").alias("n"), F.max(F.when(F.col("status") == "open", 1)).alias("is_open"))
    new = p.join(n, (F.col("__p") == F.col("__cp")) & F.col("__s").eqNullSafe(F.col("__cs")), "left").filter("is_open IS NULL")
    name = F.concat_ws(":", F.col("__p").cast("string"), F.lit(kind), F.coalesce("__s", F.lit("")), F.coalesce("n", F.lit(0)).cast("string"))
    none = lambda kind_: F.lit(None).cast(kind_)
    new = new.select(name.alias("id"), F.col("__p").alias("paper"), F.lit(kind).alias("kind"), F.col("__s").alias("slot"), F.col("__l").alias("left"), F.col("__r").alias("right"), F.lit("open").alias("status"), none("long").alias("chosen"), none("long").alias("by"), F.col("__now").alias("created_at"), none("timestamp").alias("resolved_at"))
    return kept.unionByName(new)


def refresh(state: State, papers: DataFrame, parts: int | None = None) -> State:
    """Settle papers(paper, now).

    A slot waits until all its live assignments have a submission. If these agree, or their conflict was decided, it has an official
    submission (that of a primary member, or the latest); else it is a conflict. Once the first two official slots both have one, equal
    reviews or a decision between them make the paper's outcome, and different ones a conflict of the paper.
    parts: over how many partitions the assignments are dealt to find their submissions and their slot, which bounds a task's memory; Spark chooses if it is not given.
    """
    dealt = lambda df, *keys: df.repartition(parts, *keys) if parts else df
    a = state.assignments.join(papers, "paper").filter("status <> 'cancelled'")
    s = state.submissions.select(F.col("id").alias("latest"), "hash", F.col("at").alias("__sent"))
    a = dealt(dealt(a, "latest").join(dealt(s, "latest"), "latest", "left"), "paper", "slot")
    sent = F.col("latest").isNotNull()
    pick = lambda order: F.max_by("latest", order)
    per = a.groupBy("paper", "slot", "now").agg(
        F.count("*").alias("n"), F.count_if(sent).alias("sent"), F.count_distinct("hash").alias("hashes"),
        pick(F.when((F.col("role") == "primary") & sent, F.struct("__sent", "latest"))).alias("of_primary"),
        pick(F.when(sent, F.struct(F.coalesce("submitted_at", F.to_timestamp(F.lit("0001-01-01"))), "created_at"))).alias("of_last"),
        F.min_by("latest", F.struct("reviewer", "created_at")).alias("left"), F.max_by("latest", F.struct("reviewer", "created_at")).alias("right"),
    )
    slots = state.slots.join(papers, "paper", "left").join(per.drop("now"), ["paper", "slot"], "left")
    slots = _decided(state.conflicts, INTERNAL, slots, ["paper", "slot"])
    here = F.col("now").isNotNull()
    n, sent_n = F.coalesce("n", F.lit(0)), F.coalesce("sent", F.lit(0))
    waits, agrees = (n == 0) | (sent_n < n), F.col("hashes") == 1
    official = F.when(waits, None).when(agrees, F.coalesce("of_primary", "of_last")).otherwise(F.col("chosen"))
    slots = slots.withColumn("__now", F.col("now")).withColumn("__new", F.when(here, F.when(waits, "pending").when(official.isNotNull(), "submitted").otherwise("conflict")))
    slots = slots.withColumns({
        "official_id": F.when(here, official).otherwise(F.col("official_id")), "status": F.coalesce("__new", "status"),
        "submitted_at": F.when(here & waits & (sent_n == 0), None).when(F.col("__new") == "submitted", F.coalesce("submitted_at", "now")).otherwise(F.col("submitted_at")),
        "resolved_at": F.when(here, None).otherwise(F.col("resolved_at")),
    })
    inner = slots.filter("__new = 'conflict'").select("paper", "slot", "left", "right", "now")
    conflicts = _opened(state.conflicts, INTERNAL, inner)

    # the first two official slots of each paper, if both have an official submission
    two = slots.filter("official AND now IS NOT NULL").groupBy("paper", "now").agg(F.slice(F.sort_array(F.collect_list(F.struct("slot", "official_id"))), 1, 2).alias("two"))
    pairs = two.filter("size(two) = 2 AND two[0].official_id IS NOT NULL AND two[1].official_id IS NOT NULL").select("paper", "now", F.col("two")[0]["official_id"].alias("left"), F.col("two")[1]["official_id"].alias("right"))
    sub = state.submissions.select("id", "decision", "hash", F.col("user").alias("__by"))
    one = lambda side: sub.select(*[F.col(c).alias(f"{side}_{c}") for c in ("decision", "hash")], F.col("id").alias(side))
    pairs = _decided(state.conflicts, EXTERNAL, pairs.join(one("left"), "left").join(one("right"), "right"), ["paper"])
    pairs = pairs.withColumn("same", F.col("left_hash").eqNullSafe(F.col("right_hash"))).withColumn("won", F.when(F.col("same"), F.col("left")).otherwise(F.col("chosen")))
    settled = pairs.filter("won IS NOT NULL").join(sub.withColumnRenamed("id", "won"), "won")
    source = F.when(F.col("same"), "slot_agreement").otherwise("conflict_resolution")
    unless_same = lambda c, kind: F.when(F.col("same"), F.lit(None).cast(kind)).otherwise(F.col(c))
    made = settled.select("paper", "decision", source.alias("source"), "hash", F.col("left").alias("a"), F.col("right").alias("b"), F.col("won").alias("chosen"), unless_same("conflict", "string").alias("conflict"), unless_same("__by", "long").alias("by"), F.col("now").alias("at"))
    outcomes = state.outcomes.join(made.select("paper"), "paper", "left_anti").select(*state.outcomes.columns).unionByName(made)
    conflicts = _opened(conflicts, EXTERNAL, pairs.filter("won IS NULL").select("paper", F.lit(None).cast("string").alias("slot"), "left", "right", "now"))
    ends = pairs.select("paper", F.when(F.col("won").isNotNull(), "resolved").otherwise("conflict").alias("__end"), F.col("same").alias("__same"))
    agreed = ends.filter("__same").select(F.col("paper").alias("__agreed"))
    conflicts = conflicts.join(agreed, F.col("paper") == F.col("__agreed"), "left").join(papers.select(F.col("paper").alias("__pp"), F.col("now").alias("__n")), F.col("paper") == F.col("__pp"), "left")
    shut = F.col("__agreed").isNotNull() & (F.col("kind") == EXTERNAL) & (F.col("status") == "open")
    conflicts = conflicts.withColumn("resolved_at", F.when(shut, F.coalesce("resolved_at", "__n")).otherwise(F.col("resolved_at"))).withColumn("status", F.when(shut, "resolved").otherwise(F.col("status"))).select(*state.conflicts.columns)
    slots = slots.join(ends, "paper", "left")
    ended = F.col("__end").isNotNull() & F.col("official") & here
    slots = slots.withColumn("__final", F.when(ended, F.col("__end")).otherwise(F.col("__new")))
    slots = slots.withColumn("resolved_at", F.when(ended & (F.col("__end") == "resolved"), F.col("now")).otherwise(F.col("resolved_at"))).withColumn("status", F.coalesce("__final", "status"))

    # assignments follow their slot: handed in, in conflict, or resolved
    rules = slots.filter("now IS NOT NULL").select(F.col("paper").alias("__p"), F.col("slot").alias("__s"), "__new", F.when(F.col("official"), F.col("__end")).alias("__end"), "__now")
    x = state.assignments.join(rules, (F.col("paper") == F.col("__p")) & (F.col("slot") == F.col("__s")), "left")
    live, has = F.col("status") != "cancelled", F.col("latest").isNotNull()
    inner_status = F.when((F.col("__new") == "submitted") & has & (F.col("status") != "resolved"), "submitted").when((F.col("__new") == "conflict") & has, "conflict").otherwise(F.col("status"))
    status = F.when(live & (F.col("__end") == "resolved"), "resolved").when(live & F.col("__new").isNotNull(), inner_status).otherwise(F.col("status"))
    x = x.withColumn("__status", status)
    x = x.withColumn("resolved_at", F.when(live & (F.col("__end") == "resolved"), F.col("__now")).otherwise(F.col("resolved_at"))).withColumn("version", F.col("version") + (F.col("__status") != F.col("status")).cast("int")).withColumn("status", F.col("__status"))
    return State(slots.select(*state.slots.columns), x.select(*state.assignments.columns), state.submissions, conflicts, outcomes)


def changes(before: State, after: State) -> DataFrame:
    """table, key, was, is: rows of slots, assignments and conflicts whose status differs, and new conflicts and outcomes."""
    parts = []
    keys = {"slots": F.concat_ws(":", F.col("paper").cast("string"), "slot"), "assignments": F.col("id").cast("string"), "conflicts": F.col("id"), "outcomes": F.col("paper").cast("string")}
    for name, key in keys.items():
        status = F.col("source") if name == "outcomes" else F.col("status")
        was, now = (getattr(s, name).select(key.alias("key"), status.alias(c)) for s, c in ((before, "was"), (after, "is")))
        parts.append(was.join(now, "key", "full").filter(~F.col("was").eqNullSafe(F.col("is"))).select(F.lit(name).alias("table"), "key", "was", "is"))
    return reduce(DataFrame.unionByName, parts)


#: Stored bytes of lines a partition: several times as many in the memory of the sorts that follow.
A_PART = 2 << 20


@query(
    "review_outcomes",
    """
WITH l AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS s, CAST(max(l_quantity) AS INT) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber),
a AS (SELECT l_orderkey AS paper, 'slot' || (l_linenumber % 2) AS slot, l_orderkey * 10 + l_linenumber AS id, CASE WHEN s % 8 <> 0 THEN l_orderkey * 10 + l_linenumber END AS latest, q % 2 AS hash, l_linenumber AS reviewer FROM l),
g AS (SELECT paper, slot, count(*) AS n, count(latest) AS sent, count(DISTINCT hash) FILTER (latest IS NOT NULL) AS hashes, max(latest) FILTER (reviewer <= 2) AS of_primary, max(latest) AS of_last, min(hash) AS hash FROM a GROUP BY paper, slot),
s AS (SELECT *, CASE WHEN sent < n THEN 'pending' WHEN hashes = 1 THEN 'submitted' ELSE 'conflict' END AS st, CASE WHEN sent = n AND hashes = 1 THEN coalesce(of_primary, of_last) END AS official FROM g),
p AS (SELECT paper, count(official) AS n_both, count(DISTINCT hash) AS kinds FROM s GROUP BY paper)
SELECT paper, slot, CASE WHEN n_both = 2 THEN CASE WHEN kinds = 1 THEN 'resolved' ELSE 'conflict' END ELSE st END AS status, official AS official_id, CASE WHEN n_both = 2 AND kinds = 1 THEN 'slot_agreement' END AS source FROM s JOIN p USING (paper)
""",
)
def review_outcomes(t: Tables) -> DataFrame:
    """Orders as papers and their lines as reviews in two official slots, settled."""
    at = F.to_timestamp(F.lit("2024-01-01")) + F.expr("make_interval(0, 0, 0, 0, 0, 0, l_linenumber)")
    null = lambda kind: F.lit(None).cast(kind)
    parts = max(t.spark.sparkContext.defaultParallelism, stored_bytes(t.lineitem) // A_PART)
    # dealt by paper before anything else: slots, papers and their joins need no shuffle of their own, and tasks do not grow with the table
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").repartition(parts, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.max("l_quantity").alias("l_quantity"))
    d = lines.select(F.col("l_orderkey").alias("paper"), F.concat(F.lit("slot"), (F.col("l_linenumber") % 2).cast("string")).alias("slot"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linenumber").cast("long").alias("reviewer"), (F.col("l_suppkey") % 8 != 0).alias("sent"), (F.col("l_quantity").cast("int") % 2).cast("string").alias("hash"), at.alias("at"))
    slots = d.select("paper", "slot").distinct().select("paper", "slot", F.lit(True).alias("official"), F.lit("pending").alias("status"), null("long").alias("official_id"), null("timestamp").alias("submitted_at"), null("timestamp").alias("resolved_at"))
    sent_at = F.when(F.col("sent"), F.col("at"))
    assignments = d.select("id", "paper", "slot", "reviewer", F.when(F.col("reviewer") <= 2, "primary").otherwise("second").alias("role"), F.col("reviewer").alias("user"), F.lit("assigned").alias("status"), F.when(F.col("sent"), F.col("id")).alias("latest"), F.col("at").alias("created_at"), sent_at.alias("saved_at"), sent_at.alias("submitted_at"), null("timestamp").alias("resolved_at"), F.lit(1).alias("version"))
    submissions = d.filter("sent").select("id", F.col("id").alias("assignment"), "paper", F.col("reviewer").alias("user"), F.lit("has_data").alias("decision"), "hash", "at")
    empty = lambda name: t.spark.createDataFrame([], SCHEMAS[name])
    papers = d.select("paper").distinct().withColumn("now", F.to_timestamp(F.lit("2024-02-01")))
    s = refresh(State(slots, assignments, submissions, empty("conflicts"), empty("outcomes")), papers, parts)
    return s.slots.join(s.outcomes.select("paper", "source"), "paper", "left").select("paper", "slot", "status", "official_id", "source")
