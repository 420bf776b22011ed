"""Joins, aggregations, rankings and set operations on the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.ids import zero_filled
from tessella.plans.registry import Tables, query
from tessella.sources.files import require_unique as require_unique


def best(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the order given."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def require_parents(df: DataFrame, key: str, parents: DataFrame, parent_key: str, label: str) -> DataFrame:
    """df, or an error if a key has no parent row."""
    bad = df.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti").select(key).distinct().limit(5).collect()
    if bad:
        raise ValueError(f"{label}: no {parent_key} for {[r[key] for r in bad]}")
    return df


@query(
    "dimension_lookup",
    """
SELECT r_name, n_name, count(*) AS orders, count(DISTINCT c_custkey) AS customers, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name, n_name
""",
)
def dimension_lookup(t: Tables) -> DataFrame:
    """Orders by region and nation; the dimension tables are small enough for Spark to broadcast by their size."""
    d = t.orders.select("o_custkey", "o_totalprice").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    d = d.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    return d.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.count_distinct("c_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "profile_detail",
    """
SELECT p_partkey, p_name, p_brand, count(l_orderkey) AS lines, count(DISTINCT l_suppkey) AS suppliers,
  string_agg(DISTINCT s_name, ' | ' ORDER BY s_name) AS supplier_names, round(sum(l_quantity), 2) AS quantity
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY p_partkey, p_name, p_brand
""",
)
def profile_detail(t: Tables) -> DataFrame:
    """A part with its line and supplier figures and an ordered list of supplier names; parts without lines stay."""
    lines = t.lineitem.select("l_partkey", "l_suppkey", "l_quantity").join(t.supplier.select("s_suppkey", "s_name"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    per = lines.groupBy("l_partkey").agg(
        F.count("*").alias("lines"), F.count_distinct("l_suppkey").alias("suppliers"), F.array_join(F.sort_array(F.collect_set("s_name")), " | ").alias("supplier_names"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )
    d = t.part.join(per, F.col("p_partkey") == F.col("l_partkey"), "left")
    return d.select("p_partkey", "p_name", "p_brand", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"), "supplier_names", "quantity")


@query(
    "crosswalk_union",
    """
SELECT 'customer' AS origin, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS code, n_name, c_acctbal AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'supplier', lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), n_name, s_acctbal FROM supplier JOIN nation ON n_nationkey = s_nationkey
""",
)
def crosswalk_union(t: Tables) -> DataFrame:
    """Two sources brought to one shape through a crosswalk, with keys padded to one width."""
    nation = t.nation.select("n_nationkey", "n_name")
    pad = lambda c: zero_filled(F.col(c), 9).alias("code")
    a = t.customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.lit("customer").alias("origin"), pad("c_custkey"), "n_name", F.col("c_acctbal").alias("balance"))
    b = t.supplier.join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.lit("supplier").alias("origin"), pad("s_suppkey"), "n_name", F.col("s_acctbal").alias("balance"))
    return a.unionByName(b)


@query(
    "precedence_merge",
    """
SELECT nationkey, origin, name, balance FROM (
  SELECT *, row_number() OVER (PARTITION BY nationkey ORDER BY precedence, balance DESC, name) AS rn FROM (
    SELECT s_nationkey AS nationkey, 'supplier' AS origin, s_name AS name, s_acctbal AS balance, 1 AS precedence FROM supplier WHERE s_acctbal > 5000
    UNION ALL SELECT c_nationkey, 'customer', c_name, c_acctbal, 2 FROM customer)) WHERE rn = 1
""",
)
def precedence_merge(t: Tables) -> DataFrame:
    """One row for each nation: a well-funded supplier if there is one, else a customer."""
    s = t.supplier.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("nationkey"), F.lit("supplier").alias("origin"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.lit(1).alias("precedence"))
    c = t.customer.select(F.col("c_nationkey").alias("nationkey"), F.lit("customer").alias("origin"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit(2).alias("precedence"))
    return best(s.unionByName(c), ["nationkey"], F.col("precedence"), F.col("balance").desc(), F.col("name")).drop("precedence")


@query(
    "validity_audit",
    """
WITH d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity IS NULL THEN 'missing' WHEN l_quantity <= 0 OR l_quantity > 45 THEN 'quantity' WHEN l_discount > 0.08 THEN 'discount' WHEN l_tax < 0 THEN 'tax' ELSE 'ok' END AS reason FROM lineitem),
x AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY l_orderkey, l_linenumber) AS rn FROM d)
SELECT reason, count(*) AS n, string_agg(l_orderkey || ':' || l_linenumber, ',' ORDER BY l_orderkey, l_linenumber) FILTER (rn <= 20 AND reason <> 'ok') AS examples FROM x GROUP BY reason
""",
)
def validity_audit(t: Tables) -> DataFrame:
    """Rows by the first rule they break, with up to twenty examples of each: a report, so examples are few by design."""
    q = F.col("l_quantity")
    reason = F.when(q.isNull(), "missing").when((q <= 0) | (q > 45), "quantity").when(F.col("l_discount") > 0.08, "discount").when(F.col("l_tax") < 0, "tax").otherwise("ok")
    d = t.lineitem.select("l_orderkey", "l_linenumber", reason.alias("reason"))
    counts = d.groupBy("reason").agg(F.count("*").alias("n"))
    rn = F.row_number().over(Window.partitionBy("reason").orderBy("l_orderkey", "l_linenumber"))  # Spark keeps 20 of each group before the shuffle
    ex = d.filter("reason <> 'ok'").withColumn("rn", rn).filter("rn <= 20")
    ex = ex.groupBy("reason").agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber"))).alias("e"))
    text = F.array_join(F.transform("e", lambda x: F.concat(x["l_orderkey"].cast("string"), F.lit(":"), x["l_linenumber"].cast("string"))), ",")
    return counts.join(ex, "reason", "left").select("reason", "n", text.alias("examples"))


@query(
    "core_coverage_status",
    """
WITH o AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS flags, count(*) AS lines FROM lineitem GROUP BY l_orderkey)
SELECT CASE WHEN list_has_all(flags, ['A', 'N', 'R']) THEN 'complete' WHEN list_contains(flags, 'N') THEN 'partial' ELSE 'excluded' END AS status, count(*) AS orders, CAST(sum(lines) AS BIGINT) AS lines FROM o GROUP BY status
""",
)
def core_coverage_status(t: Tables) -> DataFrame:
    """Orders by how much of a required set of flags their lines cover."""
    o = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"), F.count("*").alias("lines"))
    need = F.array(F.lit("A"), F.lit("N"), F.lit("R"))
    status = F.when(F.size(F.array_except(need, "flags")) == 0, "complete").when(F.array_contains("flags", "N"), "partial").otherwise("excluded")
    return o.groupBy(status.alias("status")).agg(F.count("*").alias("orders"), F.sum("lines").alias("lines"))


@query("membership_semi", "SELECT c_mktsegment, count(*) AS customers FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY c_mktsegment")
def membership_semi(t: Tables) -> DataFrame:
    """Customers with a large order, by segment: a semi join, so an order is no row of the result."""
    large = t.orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(large, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("customers"))


@query(
    "anti_join_queue",
    """
SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders o
WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
  AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)
""",
)
def anti_join_queue(t: Tables) -> DataFrame:
    """Open orders with no returned line, no outsized line and no customer in debt: the two line tests share one scan and one shuffle."""
    blocked = t.lineitem.filter("l_returnflag = 'R' OR l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    debt = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    d = t.orders.filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    return d.join(blocked, "o_orderkey", "left_anti").join(debt, "o_custkey", "left_anti").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")


@query(
    "queue_claim",
    "SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_totalprice DESC, o_orderdate, o_orderkey LIMIT 50",
)
def queue_claim(t: Tables) -> DataFrame:
    """The next fifty tasks in claiming order: a top-k, which Spark takes without a full sort."""
    return t.orders.filter("o_orderstatus = 'O'").orderBy("o_orderpriority", F.col("o_totalprice").desc(), "o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority", "o_orderdate")


@query(
    "set_diff",
    """
WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A')
SELECT CASE WHEN b.k IS NULL THEN 'only_r' WHEN a.k IS NULL THEN 'only_a' ELSE 'both' END AS side, count(*) AS parts FROM a FULL JOIN b ON a.k = b.k GROUP BY side
""",
)
def set_diff(t: Tables) -> DataFrame:
    """Sets of keys against each other, by one aggregation over both."""
    d = t.lineitem.filter("l_returnflag IN ('R', 'A')").groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_returnflag") == "A").alias("a"))
    side = F.when(~F.col("a"), "only_r").when(~F.col("r"), "only_a").otherwise("both")
    return d.groupBy(side.alias("side")).agg(F.count("*").alias("parts"))


@query(
    "interleave_ranked",
    """
SELECT c_mktsegment, c_custkey, CAST(rn AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 10
""",
)
def interleave_ranked(t: Tables) -> DataFrame:
    """Ten best customers of each segment, dealt in turn: a quota report."""
    rn = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc(), "c_custkey"))
    return t.customer.select("c_mktsegment", "c_custkey", rn.alias("place")).filter("place <= 10").orderBy("place", "c_mktsegment")


@query(
    "balanced_holdout",
    """
SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id DESC) AS rn FROM labels) WHERE rn <= CASE WHEN quality = 1 THEN 40 ELSE 20 END
""",
)
def balanced_holdout(t: Tables) -> DataFrame:
    """The latest 40 positive and 20 negative labels: a sample by design."""
    rn = F.row_number().over(Window.partitionBy("quality").orderBy(F.col("doc_id").desc()))
    return t.labels.withColumn("rn", rn).filter("rn <= CASE WHEN quality = 1 THEN 40 ELSE 20 END").select("doc_id", "quality")


@query(
    "storage_rollup",
    """
SELECT coalesce(r_name, 'orphan') AS reason, count(*) AS objects, round(sum(s_acctbal), 2) AS amount FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_name LIKE '%A%' LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY reason
""",
)
def storage_rollup(t: Tables) -> DataFrame:
    """Counts and sums by the partner that a left join finds, with those that find none under their own name."""
    n = t.nation.filter(F.col("n_name").like("%A%"))
    d = t.supplier.join(n, F.col("n_nationkey") == F.col("s_nationkey"), "left").join(t.region, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return d.groupBy(F.coalesce("r_name", F.lit("orphan")).alias("reason")).agg(F.count("*").alias("objects"), F.round(F.sum("s_acctbal"), 2).alias("amount"))


@query(
    "routing_buckets",
    """
SELECT CASE WHEN l_discount >= 0.09 THEN 'final' WHEN l_discount >= 0.05 THEN 'review' WHEN l_discount >= 0.02 THEN 'screen' ELSE 'drop' END AS bucket,
  l_returnflag = 'N' AND l_discount >= 0.09 AS auto_finalize, count(*) AS n FROM lineitem GROUP BY ALL
""",
)
def routing_buckets(t: Tables) -> DataFrame:
    """Confidence buckets by thresholds, and which rows need no review."""
    d = F.col("l_discount")
    bucket = F.when(d >= 0.09, "final").when(d >= 0.05, "review").when(d >= 0.02, "screen").otherwise("drop")
    return t.lineitem.groupBy(bucket.alias("bucket"), ((F.col("l_returnflag") == "N") & (d >= 0.09)).alias("auto_finalize")).agg(F.count("*").alias("n"))


@query(
    "priority_score",
    """
WITH o AS (SELECT l_orderkey, count(*) AS lines, count(*) FILTER (l_returnflag = 'R') AS returned, max(l_discount) AS top, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CAST(least(lines, 5) * 10 + least(returned, 3) * 25 - CASE WHEN o_orderstatus = 'F' THEN 40 ELSE 0 END + CASE WHEN o_orderpriority LIKE '1%' THEN 50 WHEN o_orderpriority LIKE '2%' THEN 25 ELSE 0 END AS BIGINT) AS priority,
  round(greatest(-1000, least(1000, top * 100 + mean)), 4) AS detail FROM o JOIN orders ON o_orderkey = l_orderkey
""",
)
def priority_score(t: Tables) -> DataFrame:
    """Additive capped terms from an order's lines and its own columns."""
    o = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.max("l_discount").alias("top"), F.round(F.avg("l_quantity"), 6).alias("mean"))
    d = o.join(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")
    p = F.least("lines", F.lit(5)) * 10 + F.least("returned", F.lit(3)) * 25 - F.when(F.col("o_orderstatus") == "F", 40).otherwise(0)
    p = p + F.when(F.startswith("o_orderpriority", F.lit("1")), 50).when(F.startswith("o_orderpriority", F.lit("2")), 25).otherwise(0)
    return d.select("o_orderkey", p.cast("long").alias("priority"), F.round(F.greatest(F.lit(-1000), F.least(F.lit(1000), F.col("top") * 100 + F.col("mean"))), 4).alias("detail"))


@query(
    "payload_build",
    """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'has_data' ELSE 'no_data' END AS decision_kind, count(*) AS items,
  md5(string_agg(l_linenumber || '=' || l_partkey || '@' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ';' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)) AS payload_hash
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus
""",
)
def payload_build(t: Tables) -> DataFrame:
    """A nested document for each order, in canonical order, and its hash."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("quantity"))
    items = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(line)).alias("items"))
    one = lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit("="), x["l_partkey"].cast("string"), F.lit("@"), x["quantity"].cast("long").cast("string"))
    d = t.orders.select("o_orderkey", "o_orderstatus").join(items, "o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "F", "has_data").otherwise("no_data")
    return d.select("o_orderkey", kind.alias("decision_kind"), F.size("items").cast("long").alias("items"), F.md5(F.array_join(F.transform("items", one), ";")).alias("payload_hash"))


@query(
    "payload_diff",
    """
WITH a AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber <= 4), b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber >= 3)
SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, CAST(count(*) FILTER (b.l_partkey IS NULL) AS BIGINT) AS missing, CAST(count(*) FILTER (a.l_partkey IS NULL) AS BIGINT) AS added
FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey GROUP BY 1 HAVING count(*) FILTER (b.l_partkey IS NULL) + count(*) FILTER (a.l_partkey IS NULL) > 0
""",
)
def payload_diff(t: Tables) -> DataFrame:
    """Keys that one version of a document has and the other lacks, counted by document, from one pass over both."""
    d = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.bool_or(F.col("l_linenumber") <= 4).alias("a"), F.bool_or(F.col("l_linenumber") >= 3).alias("b"))
    d = d.groupBy("l_orderkey").agg(F.count_if(F.col("a") & ~F.col("b")).alias("missing"), F.count_if(F.col("b") & ~F.col("a")).alias("added"))
    return d.filter("missing + added > 0")


@query(
    "ambiguous_names",
    """
WITH a AS (SELECT lower(p_name) AS key, p_partkey AS id FROM part UNION ALL SELECT lower(p_brand), p_partkey FROM part),
k AS (SELECT key, count(DISTINCT id) AS ids, min(id) AS id FROM a GROUP BY key)
SELECT key, ids, CASE WHEN ids = 1 THEN id END AS resolved FROM k
""",
)
def ambiguous_names(t: Tables) -> DataFrame:
    """Names and aliases resolved to an id; a key that two ids share resolves to nothing."""
    alias = F.explode(F.array(F.lower("p_name"), F.lower("p_brand"))).alias("key")
    k = t.part.select("p_partkey", alias).groupBy("key").agg(F.count_distinct("p_partkey").alias("ids"), F.min("p_partkey").alias("id"))
    return k.select("key", "ids", F.when(F.col("ids") == 1, F.col("id")).alias("resolved"))


@query(
    "weighted_field_match",
    """
WITH q(term) AS (VALUES ('cold'), ('small'), ('widget'), ('brand')),
m AS (SELECT p_partkey, term, greatest(CASE WHEN contains(lower(p_name), term) THEN 3 ELSE 0 END, CASE WHEN contains(lower(p_type), term) THEN 2 ELSE 0 END, CASE WHEN contains(lower(p_brand), term) THEN 1 ELSE 0 END) AS w FROM part, q)
SELECT p_partkey, CAST(sum(w) AS BIGINT) AS score, count(*) FILTER (w > 0) AS matched FROM m GROUP BY p_partkey HAVING sum(w) >= 4
""",
)
def weighted_field_match(t: Tables) -> DataFrame:
    """For each query term the best field it stands in, summed over the terms, without exploding rows."""
    has = lambda c, x, w: F.when(F.contains(F.lower(c), F.lit(x)), w).otherwise(0)
    w = [F.greatest(has("p_name", x, 3), has("p_type", x, 2), has("p_brand", x, 1)) for x in ("cold", "small", "widget", "brand")]
    total = sum(w[1:], w[0]).cast("long")
    matched = sum([(x > 0).cast("long") for x in w[1:]], (w[0] > 0).cast("long"))
    return t.part.select("p_partkey", total.alias("score"), matched.alias("matched")).filter("score >= 4")


@query(
    "median_by_group",
    "SELECT p_brand, count(*) AS n, round(median(p_retailprice), 6) AS mid, round(quantile_cont(p_retailprice, 0.9), 6) AS p90 FROM part GROUP BY p_brand",
)
def median_by_group(t: Tables) -> DataFrame:
    """Exact middle and upper decile by group."""
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.median("p_retailprice"), 6).alias("mid"), F.round(F.percentile("p_retailprice", 0.9), 6).alias("p90"))
