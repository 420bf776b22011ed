"""Document text: identity and duplicates, n-gram statistics and learnt weights, relevance, contamination, markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import ids, text
from tessella.plans.registry import Tables, query
from tessella.sources import shared

#: Phrases for the relevance queries, in the order in which they are looked for.
LEXICON = ("the", "of the", "in the", "and the", "is the", "that", "under", "data", "license", "copyright")

#: Terms of 40 characters at most that are sent to all tasks: about 100 bytes each.
SENT_TERMS = 1_000_000


@query(
    "canonical_identity",
    r"""
SELECT page_id, CASE WHEN regexp_extract(url, '(\d{3,})', 1) <> '' THEN 'num:' || regexp_extract(url, '(\d{3,})', 1) ELSE 'url:' || substr(sha1(lower(trim(regexp_replace(url, '\s+', ' ', 'g')))), 1, 24) END AS canonical_key,
  md5(lower(trim(url)) || '|' || CAST(length(html) AS VARCHAR)) AS hit_key, sha256(html) AS payload_hash FROM pages
""",
)
def canonical_identity(t: Tables) -> DataFrame:
    """Keys of a page: a ladder from an id in its address to a hash of the address, and hashes of its content."""
    num = F.regexp_extract("url", r"(\d{3,})", 1)
    ladder = ids.first_present(F.when(num != "", F.concat(F.lit("num:"), num)), F.concat(F.lit("url:"), F.substring(F.sha1(F.lower(text.collapse(F.col("url")))), 1, 24)))
    return t.pages.select("page_id", ladder.alias("canonical_key"), F.md5(ids.joined(F.lower(F.trim("url")), F.length("html"))).alias("hit_key"), F.sha2("html", 256).alias("payload_hash"))


@query(
    "dedupe_merge_hits",
    """
SELECT md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS hit_key, count(*) AS copies, min(doc_id) AS first_id, min_by(source, doc_id) AS source, bool_or(lang = 'en') AS any_en FROM documents GROUP BY 1 HAVING count(*) > 1
""".replace("\\\\", "\\"),
)
def dedupe_merge_hits(t: Tables) -> DataFrame:
    """Copies merged by a hash of their collapsed text: the first one's values, flags of any. Sums are combined before the shuffle."""
    key = F.md5(text.collapse(F.col("text"))).alias("hit_key")
    d = t.documents.groupBy(key).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.min_by("source", "doc_id").alias("source"), F.bool_or(F.col("lang") == "en").alias("any_en"))
    return d.filter("copies > 1")


_NGRAMS = """
w AS (SELECT doc_id, quality, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents JOIN labels USING (doc_id)),
g AS (SELECT DISTINCT doc_id, quality, unnest(list_concat(w, list_concat([w[i] || ' ' || w[i + 1] for i in range(1, greatest(len(w), 1))], [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, greatest(len(w) - 1, 1))]))) AS term FROM w)
"""


def term_frequencies(docs: DataFrame) -> DataFrame:
    """term, good_df, bad_df: how many documents with either label hold each n-gram. docs: text, quality."""
    d = docs.select("quality", F.explode(text.distinct_ngrams(text.words(F.col("text")))).alias("term"))
    return d.groupBy("term").agg(F.count_if(F.col("quality") == 1).alias("good_df"), F.count_if(F.col("quality") == 0).alias("bad_df"))


@query(
    "ngram_df_logodds",
    "WITH " + _NGRAMS + """,
d AS (SELECT term, count(*) FILTER (quality = 1) AS good_df, count(*) FILTER (quality = 0) AS bad_df FROM g WHERE length(term) <= 40 GROUP BY term HAVING count(*) >= 8),
n AS (SELECT count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad FROM w)
SELECT term, good_df, bad_df, round(ln((good_df + 0.5) / (good + 1.0)) - ln((bad_df + 0.5) / (bad + 1.0)), 6) AS log_odds FROM d, n
""",
)
def ngram_df_logodds(t: Tables) -> DataFrame:
    """Smoothed log odds of n-grams between good and bad documents, for those that enough documents hold."""
    docs = t.documents.select("doc_id", "text").join(t.labels, "doc_id")
    n = docs.agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    d = term_frequencies(docs).filter("good_df + bad_df >= 8").join(F.broadcast(n), F.lit(True))  # one row
    odds = F.log((F.col("good_df") + 0.5) / (F.col("good") + 1.0)) - F.log((F.col("bad_df") + 0.5) / (F.col("bad") + 1.0))
    return d.select("term", "good_df", "bad_df", F.round(odds, 6).alias("log_odds"))


@query(
    "discovery_terms",
    "WITH " + _NGRAMS + """,
d AS (SELECT term, count(*) FILTER (quality = 1) AS pos_df, count(*) AS df FROM g WHERE length(term) <= 40 AND contains(term, ' ') GROUP BY term), n AS (SELECT count(*) AS n FROM w)
SELECT term, pos_df, df, round(pos_df * ln((1.0 + n) / (1.0 + df)), 6) AS score FROM d, n WHERE pos_df >= 5 ORDER BY score DESC, term LIMIT 100
""",
)
def discovery_terms(t: Tables) -> DataFrame:
    """A report of the hundred phrases that stand out in good documents."""
    docs = t.documents.select("doc_id", "text").join(t.labels, "doc_id")
    n = docs.agg(F.count("*").alias("n"))
    d = term_frequencies(docs).filter(F.contains("term", F.lit(" "))).select("term", F.col("good_df").alias("pos_df"), (F.col("good_df") + F.col("bad_df")).alias("df")).filter("pos_df >= 5")
    score = F.round(F.col("pos_df") * F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))), 6)
    return d.join(F.broadcast(n), F.lit(True)).select("term", "pos_df", "df", score.alias("score")).orderBy(F.col("score").desc(), "term").limit(100)


@query(
    "pair_yield",
    """
SELECT source, lang, count(*) AS retrieved, count(DISTINCT CASE WHEN quality = 1 THEN doc_id END) AS positives, round(ln((count(DISTINCT CASE WHEN quality = 1 THEN doc_id END) + 1.0) / (count(*) + 1.0)), 6) AS prior
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang
""",
)
def pair_yield(t: Tables) -> DataFrame:
    """What share of each source and language turned out good. Labels are joined once; text is never read."""
    d = t.documents.select("doc_id", "source", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    d = d.groupBy("source", "lang").agg(F.count("*").alias("retrieved"), F.count_distinct(F.when(F.col("quality") == 1, F.col("doc_id"))).alias("positives"))
    return d.withColumn("prior", F.round(F.log((F.col("positives") + 1.0) / (F.col("retrieved") + 1.0)), 6))


@query(
    "batch_yield",
    """
WITH b AS (SELECT source, doc_id // 50 AS batch, count(*) AS n, count(*) FILTER (quality = 1) AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL)
SELECT source, count(*) AS batches, CAST(sum(n) AS BIGINT) AS docs, CAST(sum(good) AS BIGINT) AS good, round(avg(good * 1.0 / n), 6) AS mean_yield FROM b GROUP BY source
""",
)
def batch_yield(t: Tables) -> DataFrame:
    """Each batch counts once before sources are summed up."""
    d = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    b = d.groupBy("source", F.expr("doc_id div 50").alias("batch")).agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"))
    return b.groupBy("source").agg(F.count("*").alias("batches"), F.sum("n").alias("docs"), F.sum("good").alias("good"), F.round(F.avg(F.col("good") / F.col("n")), 6).alias("mean_yield"))


@query(
    "concept_yield",
    "SELECT lang, count(*) AS labelled, round((count(*) FILTER (quality = 1) - count(*) FILTER (quality = 0)) * 1.0 / count(*), 6) AS score FROM documents JOIN labels USING (doc_id) GROUP BY lang",
)
def concept_yield(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id")
    score = (F.count_if(F.col("quality") == 1) - F.count_if(F.col("quality") == 0)) / F.count("*")
    return d.groupBy("lang").agg(F.count("*").alias("labelled"), F.round(score, 6).alias("score"))


_LEX = ", ".join(f"'{x}'" for x in LEXICON)


@query(
    "relevance_score",
    rf"""
WITH p AS (SELECT doc_id, ' ' || trim(regexp_replace(regexp_replace(lower(text), '[µμ]', 'u', 'g'), '[^\p{{L}}\p{{N}}_/%]+', ' ', 'g')) || ' ' AS x FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, [t for t in [{_LEX}] if contains(x, ' ' || t || ' ')] AS hits FROM p)
SELECT doc_id, CAST(len(hits) AS INTEGER) AS n_hits, array_to_string(hits[1:3], '|') AS first_hits, CAST(least(len(hits), 3) * 2 + CASE WHEN list_contains(hits, 'license') OR list_contains(hits, 'copyright') THEN -5 ELSE 0 END AS INTEGER) AS score FROM h
""",
)
def relevance_score(t: Tables) -> DataFrame:
    """Which phrases of a lexicon a text holds, in lexicon order, and an additive score with caps."""
    d = t.documents.filter("text IS NOT NULL").select("doc_id", text.padded(F.col("text")).alias("x"))
    d = d.select("doc_id", text.first_hits(F.col("x"), list(LEXICON)).alias("hits"))
    minus = F.when(F.array_contains("hits", "license") | F.array_contains("hits", "copyright"), -5).otherwise(0)
    return d.select("doc_id", F.size("hits").alias("n_hits"), F.array_join(F.slice("hits", 1, 3), "|").alias("first_hits"), (F.least(F.size("hits"), F.lit(3)) * 2 + minus).alias("score"))


@query(
    "feedback_score",
    "WITH " + _NGRAMS + """,
d AS (SELECT term, count(*) FILTER (quality = 1) AS good_df, count(*) FILTER (quality = 0) AS bad_df FROM g WHERE length(term) <= 40 GROUP BY term HAVING count(*) >= 20),
n AS (SELECT count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad FROM w),
s AS (SELECT term, greatest(-2.5, least(2.5, ln((good_df + 0.5) / (good + 1.0)) - ln((bad_df + 0.5) / (bad + 1.0)))) AS weight FROM d, n)
SELECT doc_id, round(greatest(-6, least(6, sum(weight))), 4) AS score, count(*) AS terms FROM g JOIN s USING (term) GROUP BY doc_id
""",
)
def feedback_score(t: Tables) -> DataFrame:
    """Labelled documents scored by the clamped weights of their n-grams. Rare terms are dropped before the join, and where those left are
    few enough to be sent to all tasks, the documents' terms are not shuffled a second time."""
    docs = t.documents.select("doc_id", "text").join(t.labels, "doc_id")
    n = docs.agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    odds = F.log((F.col("good_df") + 0.5) / (F.col("good") + 1.0)) - F.log((F.col("bad_df") + 0.5) / (F.col("bad") + 1.0))
    w = term_frequencies(docs).filter("good_df + bad_df >= 20").join(F.broadcast(n), F.lit(True)).select("term", F.greatest(F.lit(-2.5), F.least(F.lit(2.5), odds)).alias("weight"))
    path = shared.shared_dir(t.spark, "weights")
    w.write.parquet(path)
    w = t.spark.read.schema(w.schema).parquet(path)
    if w.count() <= SENT_TERMS:
        w = F.broadcast(w)
    terms = docs.select("doc_id", F.explode(text.distinct_ngrams(text.words(F.col("text")))).alias("term"))
    return terms.join(w, "term").groupBy("doc_id").agg(F.round(F.greatest(F.lit(-6), F.least(F.lit(6), F.sum("weight"))), 4).alias("score"), F.count("*").alias("terms"))


@query(
    "language_hints",
    """
WITH w AS (SELECT doc_id, lang, length(text) - length(translate(text, 'äöüß', '')) AS de, length(text) - length(translate(text, 'ñíó', '')) AS es, length(text) - length(translate(text, 'çèê', '')) AS fr,
  len([x for x in regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') if x in ('the', 'of', 'and')]) AS en FROM documents),
s AS (SELECT doc_id, lang, CAST(3 * de AS BIGINT) AS de, CAST(3 * es AS BIGINT) AS es, CAST(3 * fr AS BIGINT) AS fr, CAST(en AS BIGINT) AS en FROM w)
SELECT doc_id, lang, CASE WHEN en > greatest(de, es, fr) THEN 'en' WHEN de >= greatest(es, fr) AND de > 0 THEN 'de' WHEN fr >= es AND fr > 0 THEN 'fr' WHEN es > 0 THEN 'es' ELSE 'und' END AS guess FROM s
""",
)
def language_hints(t: Tables) -> DataFrame:
    """A guess by letters that only one language has, three points each, against common English words."""
    lost = lambda chars: 3 * (F.length("text") - F.length(F.translate("text", chars, "")))
    d = t.documents.select("doc_id", "lang", lost("äöüß").alias("de"), lost("ñíó").alias("es"), lost("çèê").alias("fr"), F.size(F.filter(text.words(F.col("text")), lambda x: x.isin("the", "of", "and"))).alias("en"))
    guess = F.when(F.col("en") > F.greatest("de", "es", "fr"), "en").when((F.col("de") >= F.greatest("es", "fr")) & (F.col("de") > 0), "de").when((F.col("fr") >= F.col("es")) & (F.col("fr") > 0), "fr").when(F.col("es") > 0, "es").otherwise("und")
    return d.select("doc_id", "lang", guess.alias("guess"))


@query(
    "benchmark_overlap",
    """
WITH b AS (SELECT DISTINCT item_id, unnest([array_to_string(w[i:i+7], ' ') for i in range(1, greatest(len(w) - 6, 1))]) AS g FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark)),
d AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i+7], ' ') for i in range(1, greatest(len(w) - 6, 1))]) AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents))
SELECT doc_id, item_id, count(*) AS shared FROM b JOIN d USING (g) WHERE g <> '' GROUP BY ALL
""",
)
def benchmark_overlap(t: Tables) -> DataFrame:
    """Runs of eight words that documents share with evaluation items: an equi join on hashes of the runs, not a pair loop."""
    runs = lambda df, key: df.select(key, F.explode(F.array_distinct(F.transform(text.ngrams(text.words(F.col("text")), 8), lambda g: F.xxhash64(g)))).alias("g"))
    items = runs(t.benchmark, "item_id")
    if items.count() <= 1_000_000:  # 16 bytes each; then the documents' runs are not shuffled
        items = F.broadcast(items)
    return runs(t.documents, "doc_id").join(items, "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


@query(
    "inverted_index_roundtrip",
    "SELECT doc_id, md5(array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ')) AS text_hash, CAST(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS BIGINT) AS n_words FROM documents WHERE len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) > 0",
)
def inverted_index_roundtrip(t: Tables) -> DataFrame:
    """Word positions inverted to an index and turned back into text."""
    # a document is inverted and turned back in its own row: no word is shuffled or sorted among those of other documents
    d = t.documents.select("doc_id", text.words(F.col("text")).alias("w")).filter("size(w) > 0")
    places = F.transform("w", lambda w, i: F.struct(w.alias("word"), i.alias("p")))
    index = text.with_runs(d, places, "index", lambda word, run: F.struct(word.alias("word"), F.transform(run, lambda x: x["p"]).alias("at"))).select("doc_id", "index")
    back = index.select("doc_id", F.sort_array(F.flatten(F.transform("index", lambda x: F.transform(x["at"], lambda p: F.struct(p.alias("p"), x["word"].alias("w")))))).alias("t"))
    return back.select("doc_id", F.md5(F.array_join(F.transform("t", lambda x: x["w"]), " ")).alias("text_hash"), F.size("t").cast("long").alias("n_words"))


@query(
    "html_meta_tables",
    r"""
SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '(?i)<a\s')) AS INTEGER) AS links, CAST(len(regexp_extract_all(html, '(?i)<p[ >]')) AS INTEGER) AS paragraphs,
  CAST(len(regexp_extract_all(html, '(?i)<tr[ >]')) AS INTEGER) AS table_rows, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_hash FROM pages
""",
)
def html_meta_tables(t: Tables) -> DataFrame:
    """Title, counts of links, paragraphs and table rows, and a hash of the text without tags."""
    n = lambda p: F.regexp_count("html", F.lit(p))
    plain = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), r"\s+", " "))
    return t.pages.select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), n(r"(?i)<a\s").alias("links"), n("(?i)<p[ >]").alias("paragraphs"), n("(?i)<tr[ >]").alias("table_rows"), F.md5(plain).alias("text_hash"))


@query(
    "reference_strip",
    """
WITH p AS (SELECT doc_id, text, instr(lower(text), 'license') AS pos FROM documents)
SELECT doc_id, CASE WHEN pos > greatest(200, length(text) * 45 // 100) THEN pos - 1 ELSE length(text) END AS kept_chars,
  md5(CASE WHEN pos > greatest(200, length(text) * 45 // 100) THEN substr(text, 1, pos - 1) ELSE text END) AS kept_hash FROM p
""",
)
def reference_strip(t: Tables) -> DataFrame:
    """Texts cut at a marker, if it stands far enough in."""
    at = F.instr(F.lower("text"), F.lit("license"))
    cut = at > F.greatest(F.lit(200), F.expr("length(text) * 45 div 100"))
    kept = F.when(cut, F.substring("text", F.lit(1), at - 1)).otherwise(F.col("text"))
    return t.documents.select("doc_id", F.length(kept).cast("long").alias("kept_chars"), F.md5(kept).alias("kept_hash"))


@query(
    "audit_sample",
    "SELECT doc_id, substr(sha256('audit|' || doc_id), 1, 15) AS place FROM documents WHERE CAST('0x' || substr(sha256('audit|' || doc_id), 1, 15) AS BIGINT) < 115292150460684697",
)
def audit_sample(t: Tables) -> DataFrame:
    """A tenth of the documents by hash: a sampling operator, the same in every run."""
    name = F.concat(F.lit("audit|"), F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", F.substring(F.sha2(name, 256), 1, 15).alias("place")).filter(F.conv("place", 16, 10).cast("long") < 115292150460684697)


@query(
    "stable_ids",
    """
WITH h AS (SELECT p_partkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('part|' || p_partkey || '|' || p_name)) AS h FROM part)
SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4 + 1 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS part_id FROM h
""",
)
def stable_ids(t: Tables) -> DataFrame:
    """Name-based UUIDs from built-in hashing."""
    return t.part.select("p_partkey", ids.uuid5("6ba7b8119dad11d180b400c04fd430c8", ids.joined(F.lit("part"), F.col("p_partkey"), F.col("p_name"))).alias("part_id"))


@query(
    "eval_metrics",
    """
WITH s AS (SELECT quality, toxic, doc_id % 97 AS latency FROM labels), o AS (SELECT list_sort(list(latency)) AS l, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 1 AND toxic = 0) AS clean FROM s)
SELECT n, round(good * 1.0 / n, 6) AS recall, round(clean * 1.0 / greatest(good, 1), 6) AS accuracy, CAST(l[(n - 1) // 2 + 1] AS BIGINT) AS p50, CAST(l[CAST(round((n - 1) * 0.95) AS BIGINT) + 1] AS BIGINT) AS p95 FROM o
""",
)
def eval_metrics(t: Tables) -> DataFrame:
    """Ratios, and nearest-rank percentiles from a histogram of the values rather than a list of all rows."""
    s = t.labels.select("quality", "toxic", (F.col("doc_id") % 97).alias("latency"))
    o = s.agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("clean"))
    h = s.groupBy("latency").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.orderBy("latency")))  # 97 rows
    j = h.join(F.broadcast(o), F.lit(True))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("latency")))
    return j.groupBy("n", F.round(F.col("good") / F.col("n"), 6).alias("recall"), F.round(F.col("clean") / F.greatest("good", F.lit(1)), 6).alias("accuracy")).agg(at(F.expr("(n - 1) div 2")).alias("p50"), at(F.round((F.col("n") - 1) * 0.95)).alias("p95"))


@query(
    "classifier_agreement",
    """
WITH s AS (SELECT quality = 1 AS truth, toxic = 0 AS guess FROM labels)
SELECT count(*) AS n, round(count(*) FILTER (truth = guess) * 1.0 / count(*), 6) AS agreement, round(count(*) FILTER (truth AND guess) * 1.0 / count(*) FILTER (truth), 6) AS recall, round(count(*) FILTER (NOT truth AND guess) * 1.0 / count(*) FILTER (NOT truth), 6) AS false_positive_rate,
  count(*) FILTER (truth AND guess) * 1.0 / count(*) FILTER (truth) >= 0.85 AND count(*) FILTER (NOT truth AND guess) * 1.0 / count(*) FILTER (NOT truth) <= 0.25 AS promoted FROM s
""",
)
def classifier_agreement(t: Tables) -> DataFrame:
    """Two classifiers against each other, and whether the second passes the bar."""
    a, g = F.col("truth"), F.col("guess")
    s = t.labels.select((F.col("quality") == 1).alias("truth"), (F.col("toxic") == 0).alias("guess"))
    recall, fpr = F.count_if(a & g) / F.count_if(a), F.count_if(~a & g) / F.count_if(~a)
    return s.agg(F.count("*").alias("n"), F.round(F.count_if(a == g) / F.count("*"), 6).alias("agreement"), F.round(recall, 6).alias("recall"), F.round(fpr, 6).alias("false_positive_rate"), ((recall >= 0.85) & (fpr <= 0.25)).alias("promoted"))
