"""A stored inverted index: written once, added to without a rebuild, read by term ranges only.

A segment is what one call of `add` or `delete` wrote. Its postings are Parquet rows in the order of their terms: a term, a block of
documents (by hash of the key), and arrays of the keys, weights and lengths of the block's documents that have the term. So a
frequent term is many rows, none of them longer than a block; a prefix is a range of terms, which the files' statistics prune; and
each row's head (number of documents, greatest weight, least length) bounds the scores in its block without its arrays.

A document added again replaces the one with its key: the segment names the rows that it retires. A segment counts once its
`stats` row is there, which is written last; a failed call leaves nothing that is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.plans.registry import Tables, query
from tessella.sources import shared

from .lexical import K1, B, postings

#: PAGE_ROWS rows of postings share the least and greatest term that a reader skips by.
DOCS_A_BLOCK, FIRST_BLOCKS, PAGE_ROWS = 4096, 16, 1000


def after_prefix(p: str) -> str | None:
    """The least text above all that begin with p, by code points; None if there is none."""
    while p:
        c = ord(p[-1]) + 1
        if c <= 0x10FFFF:
            return p[:-1] + chr(0xE000 if 0xD800 <= c <= 0xDFFF else c)
        p = p[:-1]
    return None


def in_range(term: str, p: str) -> Column:
    end = after_prefix(p)
    return (F.col(term) >= p) & (F.col(term) < end) if end is not None else F.col(term) >= p


class TextIndex:
    """The index in a folder. Scores are those of `lexical.bm25`: lower is better, every word must match, words match as prefixes."""

    def __init__(self, spark: SparkSession, path: str, docs_a_block: int = DOCS_A_BLOCK):
        self.spark, self.path, self.docs_a_block = spark, path.rstrip("/"), docs_a_block
        self.blocks_read = 0

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _segments(self) -> list:
        if not shared.exists(self.spark, f"{self.path}/stats"):
            return []
        return self._table("stats").collect()  # one row a segment

    def _next(self) -> int:
        return max((s["segment"] for s in self._segments()), default=-1) + 1

    def _live(self, name: str) -> DataFrame:
        return self._table(name).filter(F.col("segment").isin([s["segment"] for s in self._segments()]))

    def _retired(self) -> DataFrame | None:
        """(key, segment) of documents that a later segment replaces; None while there is none."""
        if not any(s["retired"] for s in self._segments()):
            return None
        return self._live("retired").select("key", F.col("old").alias("segment"))

    def _write(self, df: DataFrame, name: str, segment: int) -> None:
        df.write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.path}/{name}/segment={segment}")

    def _retire(self, keys: DataFrame, segment: int) -> tuple[int, int]:
        """Write which rows of earlier segments `keys` replace; their number and their lengths' sum."""
        if not segment:
            return 0, 0
        old = self._live("documents").withColumnRenamed("segment", "old")
        gone = self._retired()
        if gone is not None:
            old = old.join(gone.withColumnRenamed("segment", "old"), ["key", "old"], "left_anti")
        self._write(old.join(keys.select("key").distinct(), "key", "left_semi").select("key", "old", "length"), "retired", segment)
        r = self.spark.read.parquet(f"{self.path}/retired/segment={segment}").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        return r[0], r[1]

    def _commit(self, segment: int, docs: int, words: int, retired: tuple[int, int], n_blocks: int) -> None:
        row = [(docs, words, *retired, n_blocks)]
        self._write(self.spark.createDataFrame(row, "docs long, words long, retired long, retired_words long, n_blocks long").coalesce(1), "stats", segment)

    def add(self, docs: DataFrame, key: str, weights: dict[str, float]) -> int:
        """Index the texts in the columns of `weights`, a row for each key; rows without a key or a word are left out. Gives the segment."""
        segment = self._next()
        made = postings(docs.filter(F.col(key).isNotNull()), key, weights)
        # a document's terms are summed in its own row, and written once for all that follows
        weigh = lambda term, run: F.struct(term.alias("term"), F.aggregate(run, F.lit(0.0), lambda s, x: s + x["weight"]).alias("w"))
        made = text.with_runs(made, F.col("tokens"), "terms", weigh).select("key", "length", "terms")
        path = shared.shared_dir(self.spark, "terms")
        made.write.parquet(path)
        made = self.spark.read.schema(made.schema).parquet(path)
        n = made.count()
        blocks = max(-(-n // self.docs_a_block), 1)
        made = made.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
        self._write(made.select("key", "length", "block"), "documents", segment)
        # one shuffle, by ranges of term and block, in which they are listed and written; no term is one group
        each = made.select("key", "length", "block", F.explode("terms").alias("t")).select("key", "length", "block", "t.term", "t.w").repartitionByRange("term", "block")
        rows = each.groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("key", "w", "length"))).alias("d"))
        rows = rows.select("term", "block", F.size("d").alias("n"), F.array_max("d.w").alias("top"), F.array_min("d.length").alias("shortest"), F.col("d.key").alias("keys"), F.col("d.w").alias("ws"), F.col("d.length").alias("lengths"))
        self._write(rows.sortWithinPartitions("term", "block"), "postings", segment)
        at = self.spark.read.parquet(f"{self.path}/documents/segment={segment}")
        retired = self._retire(at, segment)
        docs_n, words_n = at.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        self._commit(segment, docs_n, words_n, retired, blocks)
        return segment

    def delete(self, keys: DataFrame) -> int:
        """Retire the documents with the keys in `keys(key)`."""
        segment = self._next()
        retired = self._retire(keys, segment)
        if segment:
            for name in ("documents", "postings"):
                self._write(self._table(name).drop("segment").limit(0), name, segment)
        self._commit(segment, 0, 0, retired, 0)
        return segment

    def stats(self) -> tuple[int, float]:
        """The number of live documents and their mean length."""
        s = self._segments()
        n, words = sum(x["docs"] - x["retired"] for x in s), sum(x["words"] - x["retired_words"] for x in s)
        return n, words / n if n else 0.0

    def rows(self, words: list[str], whole: bool = False) -> DataFrame:
        """The postings' rows that any of the words takes, a row for each (place of the word, as `i`); only their ranges of terms are read."""
        if not self._segments() or not shared.exists(self.spark, f"{self.path}/postings"):
            raise ValueError("the index is empty")
        fits = [F.col("term") == w if whole else in_range("term", w) for w in words]
        d = self._live("postings").filter(reduce(lambda a, b: a | b, fits))
        return d.withColumn("i", F.explode(F.filter(F.array(*[F.when(f, F.lit(i)) for i, f in enumerate(fits)]), lambda x: x.isNotNull())))

    def _hits(self, rows: DataFrame) -> DataFrame:
        """key, segment, length, i, f: the live documents in rows, each once for each word."""
        each = rows.select("segment", "i", F.explode(F.arrays_zip("keys", "ws", "lengths")).alias("d")).select(F.col("d.keys").alias("key"), "segment", F.col("d.lengths").alias("length"), "i", F.col("d.ws").alias("f"))
        gone = self._retired()
        if gone is not None:
            each = each.join(gone, ["key", "segment"], "left_anti")
        return each.groupBy("key", "segment", "length", "i").agg(F.sum("f").alias("f"))

    def _idf(self, counts: DataFrame) -> DataFrame:
        n = self.stats()[0]
        idf = F.log((n - F.col("n") + 0.5) / (F.col("n") + 0.5))
        return counts.select("i", F.when(idf <= 0, F.lit(1e-6)).otherwise(idf).alias("idf"))

    def _part(self, f: str, length: str) -> Column:
        return F.col("idf") * F.col(f) * (K1 + 1) / (F.col(f) + K1 * (1 - B + B * F.col(length) / F.lit(self.stats()[1])))

    def _scored(self, hits: DataFrame, idf: DataFrame, n_words: int) -> DataFrame:
        h = hits.join(F.broadcast(idf), "i")  # a row for each word of the query
        return h.groupBy("key").agg((-F.sum(self._part("f", "length"))).alias("score"), F.count("*").alias("terms")).filter(F.col("terms") == n_words).drop("terms")

    def matches(self, words: list[str]) -> DataFrame:
        """key and, for each word, whether the document has it (w0, w1 ...), for documents that have any."""
        h = self._hits(self.rows(words))
        return h.groupBy("key").agg(*[F.bool_or(F.col("i") == i).alias(f"w{i}") for i in range(len(words))])

    def search(self, words: list[str], whole: bool = False) -> DataFrame:
        """key and score of all documents that have every word."""
        hits = self._hits(self.rows(words, whole))
        return self._scored(hits, self._idf(hits.groupBy("i").agg(F.count("*").alias("n"))), len(words))

    def top(self, words: list[str], k: int, whole: bool = False) -> DataFrame:
        """The k best of `search`, by score and key, from as few blocks as their heads allow.

        Heads bound the score of every block that has all words. The best-looking blocks are read first; their k-th score is
        a bound that all other blocks must reach to be read. Which blocks were read, `blocks_read` tells.
        """
        rows = self.rows(words, whole)
        hits = self._hits(rows)
        idf = self._idf(hits.groupBy("i").agg(F.count("*").alias("n"))).persist()
        heads = rows.groupBy("segment", "block", "i").agg(F.sum("top").alias("f"), F.min("shortest").alias("short"))
        bounds = heads.join(F.broadcast(idf), "i").groupBy("segment", "block").agg(F.sum(self._part("f", "short")).alias("bound"), F.count("*").alias("words")).filter(F.col("words") == len(words)).select("segment", "block", "bound").persist()
        order = [F.col("score"), F.col("key")]
        first = bounds.orderBy(F.col("bound").desc(), "segment", "block").limit(FIRST_BLOCKS)
        got = self._scored(self._hits(rows.join(F.broadcast(first.select("segment", "block")), ["segment", "block"], "left_semi")), idf, len(words))
        best = [r["score"] for r in got.orderBy(*order).limit(k).collect()]
        read = bounds if len(best) < k else bounds.filter(F.col("bound") >= -best[-1] * (1 - 1e-9))
        self.blocks_read = read.count()
        found = self._scored(self._hits(rows.join(read.select("segment", "block"), ["segment", "block"], "left_semi")), idf, len(words))
        return found.orderBy(*order).limit(k)


def built(t: Tables, docs: DataFrame, key: str, weights: dict[str, float]) -> TextIndex:
    index = TextIndex(t.spark, shared.shared_dir(t.spark, "index"))
    index.add(docs, key, weights)
    return index


_BM25 = """
st AS (SELECT count(*) AS docs, avg(length) AS avg_length FROM d),
h AS (SELECT d.key, length, q.i, sum(u.w) AS f FROM (SELECT key, length, unnest(tokens) AS u FROM d) d, q WHERE {match} GROUP BY ALL),
n AS (SELECT i, count(*) AS n FROM h GROUP BY i),
m AS (SELECT key, -sum((CASE WHEN ln((docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - n + 0.5) / (n + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / avg_length))) AS score, count(*) AS c FROM h JOIN n USING (i), st GROUP BY key)
"""
_TOKENS = "[{{'t': x, 'w': {w}::DOUBLE}} for x in regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')]"
_NAME = "CASE WHEN p_size > 25 THEN p_name || ' widget' ELSE p_name END"


@query(
    "index_search",
    f"""
WITH d AS (SELECT key, tokens, len(tokens) AS length FROM (SELECT p_partkey AS key, list_concat({_TOKENS.format(w="8.0", c=_NAME)}, {_TOKENS.format(w="3.0", c="p_type")}) AS tokens FROM part WHERE p_size <> 50) WHERE len(tokens) > 0),
q(i, prefix) AS (VALUES (0, 'co'), (1, 'wid')), {_BM25.format(match="starts_with(u.t, prefix)")}
SELECT key, round(score, 6) AS score FROM m WHERE c = 2
""",
)
def index_search(t: Tables) -> DataFrame:
    """All parts for `co... wid...` from an index in which large parts were added again under longer names, and those of one size withdrawn."""
    weights = {"p_name": 8.0, "p_type": 3.0}
    index = built(t, t.part, "p_partkey", weights)
    index.add(t.part.filter("p_size > 25").withColumn("p_name", F.concat("p_name", F.lit(" widget"))), "p_partkey", weights)
    index.delete(t.part.filter("p_size = 50").select(F.col("p_partkey").alias("key")))
    return index.search(["co", "wid"]).select("key", F.round("score", 6).alias("score"))


@query(
    "index_top",
    f"""
WITH d AS (SELECT key, tokens, len(tokens) AS length FROM (SELECT doc_id AS key, {_TOKENS.format(w="1.0", c="text")} AS tokens FROM documents WHERE doc_id IS NOT NULL) WHERE len(tokens) > 0),
q(i, word) AS (VALUES (0, 'was'), (1, 'ing')), {_BM25.format(match="u.t = word")}
SELECT key, round(score, 6) AS score FROM m WHERE c = 2 ORDER BY m.score, key LIMIT 20
""",
)
def index_top(t: Tables) -> DataFrame:
    """A top-k report: the twenty best documents that have both words, from as few blocks as needed."""
    index = built(t, t.documents, "doc_id", {"text": 1.0})
    return index.top(["was", "ing"], 20, whole=True).select("key", F.round("score", 6).alias("score"))
