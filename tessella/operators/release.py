"""An audited star-schema build: validity rules, reject counts, statuses, and a quality report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import ids, text
from tessella.plans.registry import Tables, query
from tessella.sources.files import bad_number, number

from .relational import require_parents, require_unique

NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # RFC 4122: URL


def foods(food: DataFrame, categories: DataFrame, observed: DataFrame, core: list[str], release: str) -> DataFrame:
    """Each food with a stable id, category, status and search priority.

    food(fdc_id, description, category_id); observed(fdc_id, nutrient_code): complete if every core nutrient is there,
    ambiguous if the name leaves the kind open, excluded if nothing was observed.
    """
    require_unique(food, "fdc_id", "food")
    require_parents(food.filter("category_id IS NOT NULL"), "category_id", categories, "category_id", "food")
    have = observed.groupBy("fdc_id").agg(F.collect_set("nutrient_code").alias("have"))
    d = food.join(categories, "category_id", "left").join(have, "fdc_id", "left")
    covered = F.size(F.array_except(F.array(*map(F.lit, core)), F.coalesce("have", F.array().cast("array<string>")))) == 0
    vague = F.col("description").rlike(r"(?i)\bNFS\b|\bNS\b|not specified")
    status = F.when(F.col("have").isNull(), "excluded").when(vague, "ambiguous").when(covered, "complete").otherwise("partial")
    d = d.withColumn("quality_status", status)
    priority = F.when(F.col("quality_status") == "complete", 110).when(F.col("quality_status") == "partial", 100).when(F.col("quality_status") == "ambiguous", 80).otherwise(0)
    raw = F.when(F.col("description").rlike(r"(?i)\braw\b"), 5).otherwise(0)
    return d.select(
        ids.uuid5(NAMESPACE, ids.joined(F.lit("food"), F.lit(release), F.col("fdc_id"))).alias("food_id"), "fdc_id", F.col("description").alias("display_name"), text.plain(F.col("description")).alias("normalized_description"),
        F.col("name").alias("category_name"), "quality_status", (F.col("quality_status") != "excluded").alias("is_searchable"), (priority + raw).alias("search_priority"),
    )


def audit_amounts(rows: DataFrame, amount: str, on_invalid: str = "reject") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows by their amount: blank and negative amounts are rejected with a reason, or are an error."""
    a = F.col(amount)
    reason = F.when(bad_number(a), "not_a_number").when(number(a).isNull(), "blank").when(number(a) < 0, "negative")
    d = rows.withColumn("reject_reason", reason)
    rejected = d.filter("reject_reason IS NOT NULL")
    if on_invalid == "fail" and not rejected.isEmpty():
        raise ValueError(f"invalid {amount}: {[tuple(r) for r in rejected.limit(3).collect()]}")
    return d.filter("reject_reason IS NULL").drop("reject_reason").withColumn(amount, number(a)), rejected


def portions(rows: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) portions: the weight must be above 0; a missing description is made from amount, unit and modifier."""
    d = rows.withColumn("gram_weight", number(F.col("gram_weight"))).join(units.select(F.col("id").alias("measure_unit_id"), F.col("name").alias("unit_name")), "measure_unit_id", "left")
    unit = F.when(F.col("unit_name") != "undetermined", F.col("unit_name"))
    made = F.concat_ws(" ", F.when(number(F.col("amount")) > 0, F.trim("amount")), unit, F.col("modifier"))
    d = d.withColumn("portion_description", ids.first_present(F.col("portion_description"), made, F.lit("portion")))
    ok = F.coalesce(F.col("gram_weight") > 0, F.lit(False))
    return d.filter(ok), d.filter(~ok)


def edible_fraction(refuse_percent: Column) -> Column:
    """The share that is eaten, to six places; null outside 0 to 100."""
    return F.when(refuse_percent.between(0, 100), F.round((100 - refuse_percent) / 100, 6))


def quality_report(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows: one row for each table of a release."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows")).select("table", "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "release_status",
    """
WITH h AS (SELECT l_partkey, list_distinct(list(l_returnflag)) AS have FROM lineitem WHERE l_discount > 0.05 GROUP BY l_partkey)
SELECT CASE WHEN have IS NULL THEN 'excluded' WHEN regexp_matches(p_name, '\\b(cold|new)\\b') THEN 'ambiguous' WHEN list_has_all(have, ['N']) THEN 'complete' ELSE 'partial' END AS quality_status, count(*) AS parts,
  round(sum((100 - (p_size % 40)) / 100.0), 6) AS edible FROM part LEFT JOIN h ON l_partkey = p_partkey GROUP BY 1
""".replace("\\\\", "\\"),
)
def release_status(t: Tables) -> DataFrame:
    """Parts by how well they are observed, with a derived fraction summed up."""
    have = t.lineitem.filter("l_discount > 0.05").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_set("l_returnflag").alias("have"))
    d = t.part.select("p_partkey", "p_name", "p_size").join(have, "p_partkey", "left")
    status = F.when(F.col("have").isNull(), "excluded").when(F.col("p_name").rlike(r"\b(cold|new)\b"), "ambiguous").when(F.array_contains("have", "N"), "complete").otherwise("partial")
    return d.groupBy(status.alias("quality_status")).agg(F.count("*").alias("parts"), F.round(F.sum(edible_fraction(F.col("p_size") % 40)), 6).alias("edible"))


#: Compacted unit texts and the unit and factor they stand for.
UNITS = {"g/100g": ("g/100g", 1.0), "mg/100g": ("mg/100g", 1.0), "ug/100g": ("ug/100g", 1.0), "g/kg": ("g/100g", 0.1), "mg/kg": ("mg/100g", 0.1), "ug/g": ("ug/100g", 100.0), "kcal/100g": ("kcal/100g", 1.0), "%": ("%", 1.0)}


def standard_unit(unit: Column) -> tuple[Column, Column]:
    """(unit, factor) of a unit text; null where it isn't known. Looked up as a whole, so g/100g never stands for mg/100g."""
    c = F.regexp_replace(F.regexp_replace(F.lower(unit), "[µμ]", "u"), r"[\s.]+", "")
    names = F.create_map(*[F.lit(x) for k, (u, _) in UNITS.items() for x in (k, u)])
    factors = F.create_map(*[F.lit(x) for k, (_, f) in UNITS.items() for x in (k, f)])
    return F.try_element_at(names, c), F.try_element_at(factors, c)


@query(
    "unit_standardize",
    """
WITH u(k, raw) AS (VALUES (0, 'mg / 100 g'), (1, 'µg/g'), (2, 'G/KG'), (3, 'IU'), (4, '%')),
e AS (SELECT event_id, value, raw, regexp_replace(replace(lower(raw), 'µ', 'u'), '[\\s.]+', '', 'g') AS c FROM events JOIN u ON k = event_id % 5)
SELECT event_id, CASE c WHEN 'mg/100g' THEN 'mg/100g' WHEN 'ug/g' THEN 'ug/100g' WHEN 'g/kg' THEN 'g/100g' WHEN '%' THEN '%' END AS unit,
  round(value * CASE c WHEN 'mg/100g' THEN 1.0 WHEN 'ug/g' THEN 100.0 WHEN 'g/kg' THEN 0.1 WHEN '%' THEN 1.0 END, 6) AS amount FROM e
""".replace("\\\\", "\\"),
)
def unit_standardize(t: Tables) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ("mg / 100 g", "µg/g", "G/KG", "IU", "%"))), (F.col("event_id") % 5 + 1).cast("int"))
    unit, factor = standard_unit(raw)
    return t.events.select("event_id", unit.alias("unit"), F.round(F.col("value") * factor, 6).alias("amount"))


@query(
    "quantity_to_grams",
    """
WITH q(k, raw) AS (VALUES (0, '1,5 kg'), (1, '250 g'), (2, '2 cups'), (3, '3 bowls'), (4, 'some')), p(unit, grams) AS (VALUES ('cup', 158.0::DOUBLE), ('slice', 30.0)),
d AS (SELECT p_partkey, raw, TRY_CAST(replace(regexp_extract(raw, '([0-9]+(?:[.,][0-9]+)?)', 1), ',', '.') AS DOUBLE) AS n, regexp_extract(raw, '([a-z]+)$', 1) AS u FROM part JOIN q ON k = p_partkey % 5)
SELECT p_partkey, round(CASE WHEN u = 'kg' THEN n * 1000 WHEN u = 'g' THEN n ELSE n * grams END, 4) AS grams, CASE WHEN n IS NULL THEN 'no_quantity' WHEN u IN ('g', 'kg') OR grams IS NOT NULL THEN 'resolved' ELSE 'unknown_unit' END AS state
FROM d LEFT JOIN p ON p.unit = regexp_replace(u, 's$', '')
""",
)
def quantity_to_grams(t: Tables) -> DataFrame:
    """Quantities in words to grams: weights directly, household units by a portion table, others stay open."""
    raw = F.element_at(F.array(*map(F.lit, ("1,5 kg", "250 g", "2 cups", "3 bowls", "some"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    d = t.part.select("p_partkey", raw.alias("raw"))
    n = F.replace(F.regexp_extract("raw", r"([0-9]+(?:[.,][0-9]+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")
    d = d.select("p_partkey", n.alias("n"), F.regexp_extract("raw", "([a-z]+)$", 1).alias("u"))
    grams = F.try_element_at(F.create_map(F.lit("cup"), F.lit(158.0), F.lit("slice"), F.lit(30.0)), F.regexp_replace("u", "s$", ""))
    amount = F.when(F.col("u") == "kg", F.col("n") * 1000).when(F.col("u") == "g", F.col("n")).otherwise(F.col("n") * grams)
    state = F.when(F.col("n").isNull(), "no_quantity").when(F.col("u").isin("g", "kg") | grams.isNotNull(), "resolved").otherwise("unknown_unit")
    return d.select("p_partkey", F.round(amount, 4).alias("grams"), state.alias("state"))
