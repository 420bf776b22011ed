"""Operator 6 [native]: quality rules whose cutoffs come from mergeable quantile sketches per language and source.

Each document is measured by built-in functions alone. Every measure is a non-negative integer; its sketch is a
histogram whose bins are 1 wide below 64 and then keep the six leading bits (relative error under 1/32, at most a few
hundred bins however many rows), so sketches merge by adding counts, in any order, with the same result. A group's upper
cutoff is q75 + ``reach`` * max(q75 - q25, the measure's least spread); word length has a lower cutoff as well. A group
with under ``least_docs`` documents takes the merged sketch of its language, and that of all documents if the language
is small too.

Defined results: null, empty and blank texts have no words, fail the base rule and are not kept; null languages and
sources are groups of their own; equal rows get equal verdicts, each for itself; an empty table gives no rows; other
columns pass through ``keep_good``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: measure: (SQL over the counts, least spread, whether too little is bad as well)
MEASURES = {
    "q_word_len": ("100 * q_word_chars div greatest(q_n_words, 1)", 60, True),
    "q_symbols": ("1000 * q_n_symbols div greatest(q_n_words, 1)", 60, False),
    "q_dup_lines": ("1000 * q_n_dup_lines div greatest(q_n_lines, 1)", 120, False),
    "q_repeats": ("1000 * q_n_repeat_words div greatest(q_n_words, 1)", 100, False),
    "q_capitals": ("1000 * q_n_capitals div greatest(q_word_chars, 1)", 60, False),
}
REACH, LEAST_DOCS, BROADCAST_ROWS = 3, 200, 100_000

_WINDOWS = "CASE WHEN size(q_w) >= 8 THEN transform(sequence(1, size(q_w) - 7), i -> xxhash64(slice(q_w, i, 8))) ELSE array() END"
#: Words under windows found twice or more: sort the windows by hash, keep those with an equal neighbour, and add for each, in text order, the words that the one before does not reach.
_REPEATED = """
CASE WHEN size(array_distinct(q_h)) = size(q_h) THEN 0L ELSE
  transform(array(array_sort(transform(q_h, (x, i) -> struct(x AS h, i AS i)))), s ->
    aggregate(
      array_sort(filter(transform(s, (x, j) -> CASE WHEN get(s, j - 1).h = x.h OR get(s, j + 1).h = x.h THEN x.i END), v -> v IS NOT NULL)),
      struct(0L AS n, -8 AS last), (a, x) -> struct(a.n + least(8, x - a.last) AS n, x AS last), a -> a.n))[0]
END
"""


def measure(docs: DataFrame) -> DataFrame:
    """docs with the counts and measures of its ``text``, all named q_*."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("q_text", text).withColumn("q_w", F.split(F.trim("q_text", F.lit(common.BLANKS)), r"[\x20\x09-\x0D]+"))
    d = d.withColumn("q_w", F.expr("filter(q_w, x -> x <> '')"))
    blank = F.lit(common.BLANKS)
    d = d.withColumns(
        {
            "q_n_words": F.size("q_w").cast("long"),
            "q_word_chars": F.length(F.translate("q_text", common.BLANKS, "")).cast("long"),
            "q_n_symbols": F.regexp_count("q_text", F.lit(r"[#*$%&|<>]")).cast("long"),
            "q_n_capitals": F.regexp_count("q_text", F.lit("[A-ZÀ-ÖØ-Þ]")).cast("long"),
            "q_lines": F.filter(F.split("q_text", "\n"), lambda x: F.length(F.trim(x, blank)) > 0),
            "q_h": F.expr(_WINDOWS),
        }
    )
    d = d.withColumns({"q_n_lines": F.size("q_lines").cast("long"), "q_n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"), "q_n_repeat_words": F.expr(_REPEATED)})
    d = d.drop("q_text", "q_w", "q_lines", "q_h")
    d = d.withColumn("q_base_failed", (F.col("q_n_words") < 20) | (100 * F.col("q_n_repeat_words") > 30 * F.col("q_n_words")))
    return d.withColumns({k: F.expr(v[0]) for k, v in MEASURES.items()})


def _bin(v: str) -> Column:
    return F.expr(f"shiftleft(shiftright({v}, greatest(length(bin({v})) - 6, 0)), greatest(length(bin({v})) - 6, 0))")


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bin, n: the sketch of each measure for each language and source, of documents with words."""
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), _bin(k).alias("bin")) for k in MEASURES])).alias("m")
    return measured.filter("q_n_words > 0").select("lang", "source", long).groupBy("lang", "source", "m.measure", "m.bin").agg(F.count("*").alias("n"))


def cutoffs(sketch: DataFrame, reach: int = REACH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source and, for each measure, its lowest and highest value that pass."""
    by_group = sketch.select(F.lit(0).alias("level"), "lang", "source", "measure", "bin", "n")
    by_lang = sketch.groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source"), "measure", "bin", "n")
    by_all = by_lang.groupBy("measure", "bin").agg(F.sum("n").alias("n")).select(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "measure", "bin", "n")
    every = by_group.unionByName(by_lang).unionByName(by_all)
    key = ["level", "lang", "source", "measure"]
    total, upto = F.sum("n").over(Window.partitionBy(*key)), F.sum("n").over(Window.partitionBy(*key).orderBy("bin"))
    at = every.withColumn("total", total).withColumn("upto", upto)
    q = at.groupBy(*key).agg(F.max("total").alias("total"), *[F.min(F.when(100 * F.col("upto") >= p * F.col("total"), F.col("bin"))).alias(f"q{p}") for p in (25, 75)])
    spread = F.create_map(*[F.lit(x) for k, v in MEASURES.items() for x in (k, v[1])])
    low = F.create_map(*[F.lit(x) for k, v in MEASURES.items() for x in (k, v[2])])
    margin = reach * F.greatest(F.col("q75") - F.col("q25"), spread[F.col("measure")])
    q = q.withColumn("high", F.col("q75") + margin).withColumn("low", F.when(low[F.col("measure")], F.col("q25") - margin).otherwise(F.lit(0)))
    wide = q.groupBy("level", "lang", "source").agg(F.max("total").alias("total"), *[F.max(F.when(F.col("measure") == k, F.struct("low", "high"))).alias(f"q_cut_{k[2:]}") for k in MEASURES])
    cuts = F.struct("total", *[f"q_cut_{k[2:]}" for k in MEASURES])
    g = wide.filter("level = 0").select("lang", "source", cuts.alias("own"))
    la = wide.filter("level = 1").select(F.col("lang").alias("__l"), cuts.alias("of_lang"))
    al = wide.filter("level = 2").select(cuts.alias("of_all"))
    # of_all is one row
    g = g.join(la, F.col("lang").eqNullSafe(F.col("__l")), "left").join(F.broadcast(al), F.lit(True), "left")
    pick = F.when(F.col("own.total") >= least_docs, F.col("own")).when(F.col("of_lang.total") >= least_docs, F.col("of_lang")).otherwise(F.col("of_all")).alias("cut")
    return g.select(F.col("lang").alias("q_lang"), F.col("source").alias("q_source"), pick).select("q_lang", "q_source", "cut.*").drop("total")


def apply_cutoffs(measured: DataFrame, reach: int = REACH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """measured with q_kept. It is read twice, for the sketches and for the verdicts, so give a written table."""
    cuts = common.materialise(cutoffs(sketches(measured), reach, least_docs), "cutoffs")
    if cuts.count() <= BROADCAST_ROWS:  # beyond, a shuffled join, whose large groups Spark splits
        cuts = F.broadcast(cuts)
    d = measured.join(cuts, measured["lang"].eqNullSafe(F.col("q_lang")) & measured["source"].eqNullSafe(F.col("q_source")), "left")
    passed = F.lit(True)
    for k in MEASURES:
        c = F.col(f"q_cut_{k[2:]}")
        passed = passed & (F.col(k) >= c["low"]) & (F.col(k) <= c["high"])
    d = d.withColumn("q_kept", ~F.col("q_base_failed") & F.coalesce(passed, F.lit(False)))
    return d.drop("q_lang", "q_source", *[f"q_cut_{k[2:]}" for k in MEASURES])


def judge(docs: DataFrame, reach: int = REACH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """q_row (a struct of the columns of docs, which may have any names) and q_kept; docs needs text, lang and source."""
    packed = docs.select(F.struct("*").alias("q_row"), *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")))
    judged = apply_cutoffs(common.materialise(measure(packed).drop("text"), "measured"), reach, least_docs)
    return judged.select("q_row", "q_kept")


def keep_good(docs: DataFrame, reach: int = REACH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    return judge(docs, reach, least_docs).filter("q_kept").select("q_row.*")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    slim = common.materialise(measure(docs).drop("text"), "measured")  # what is written between the passes has no texts
    return apply_cutoffs(slim).select("doc_id", *[F.col(f"q_{c}").alias(c) for c in COUNTS])


def _values() -> str:
    return ", ".join(f"('{k[2:]}', {v[1]}, {str(v[2]).lower()})" for k, v in MEASURES.items())


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
c AS (SELECT *, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(regexp_extract_all(t, '[A-ZÀ-ÖØ-Þ]')) AS BIGINT) AS n_capitals,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines FROM w),
win AS (SELECT rid, i, md5(array_to_string(ws[i:i+7], ' ')) AS h FROM c, range(1, greatest(CAST(len(ws) AS BIGINT) - 6, 1)) r(i)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, h) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid),
m AS (SELECT c.*, coalesce(rep.n, 0) AS n_repeat_words FROM c LEFT JOIN rep USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    100 * word_chars // greatest(n_words, 1) AS word_len, 1000 * n_symbols // greatest(n_words, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
    1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 1000 * n_capitals // greatest(word_chars, 1) AS capitals FROM m),
u AS (UNPIVOT (SELECT rid, lang, source, word_len, symbols, dup_lines, repeats, capitals FROM f WHERE n_words > 0) ON word_len, symbols, dup_lines, repeats, capitals INTO NAME measure VALUE v),
b AS (SELECT rid, lang, source, measure, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bin FROM u),
e AS (SELECT 0 AS level, lang, source, measure, bin, count(*) AS n FROM b GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, measure, bin, count(*) FROM b GROUP BY ALL UNION ALL SELECT 2, NULL, NULL, measure, bin, count(*) FROM b GROUP BY ALL),
a AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bin) AS upto FROM e),
q AS (SELECT level, lang, source, measure, max(total) AS total, min(bin) FILTER (100 * upto >= 25 * total) AS q25, min(bin) FILTER (100 * upto >= 75 * total) AS q75 FROM a GROUP BY ALL),
p(measure, spread, two) AS (VALUES {_values()}),
k AS (SELECT q.level, q.lang, q.source, q.measure, total, q75 + {REACH} * greatest(q75 - q25, spread) AS high, CASE WHEN two THEN q25 - {REACH} * greatest(q75 - q25, spread) ELSE 0 END AS low FROM q JOIN p USING (measure)),
j AS (SELECT u.rid, bool_and(v BETWEEN CASE WHEN g.total >= {LEAST_DOCS} THEN g.low WHEN l.total >= {LEAST_DOCS} THEN l.low ELSE x.low END
    AND CASE WHEN g.total >= {LEAST_DOCS} THEN g.high WHEN l.total >= {LEAST_DOCS} THEN l.high ELSE x.high END) AS ok
  FROM u JOIN k g ON g.level = 0 AND g.lang IS NOT DISTINCT FROM u.lang AND g.source IS NOT DISTINCT FROM u.source AND g.measure = u.measure
  JOIN k l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM u.lang AND l.measure = u.measure JOIN k x ON x.level = 2 AND x.measure = u.measure GROUP BY u.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, false) AS kept FROM f LEFT JOIN j USING (rid)
"""
