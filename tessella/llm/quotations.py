"""Operator 7: chat formatting by quotation linking.

Each message is parsed line by line: ``>`` marks at a line's start give its quote level, lines of one level that follow each
other are a passage, and a line that announces a quote ("... wrote:") goes with it. A passage is normalised (lower case,
letters and digits only) and hashed in pieces: each sentence (of the passage, of each paragraph and of each line), each
line, each paragraph between blank lines, and the whole. So a quote that is re-wrapped, or shortened to some sentences,
lines or paragraphs, still meets its original, however short they are. Of a quoted sentence the longest piece counts that
an earlier message of the conversation says unquoted; it is linked to the latest such message. A message answers the message that most of its outermost linked quotes come from (the latest, if equal); threads are the trees of
answers, found by pointer doubling on DataFrames, so that no conversation is ever in one task's memory.

Rows come back as one for each message, without quotes, ordered by conversation, thread (the turn that began it) and
turn: a reply stands below what it answers.

Defined results: null or empty texts are messages without words or quotes; null conv_id or turn: the message is a thread
of its own; repeated rows stay; of several messages with one (conv_id, turn) any says the sentence, and each is a row; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

_QUOTE = re.compile(r"^((?:[ \t]*>)+)[ \t]?(.*)$")
_WROTE = re.compile(r"^\s*(?:on|am|le|el)\b.*(?:wrote|schrieb|écrit|escribió)\s*:?\s*$", re.I)
_SENTENCE = re.compile(r"[.!?]+(?:\s+|$)")
_PARAGRAPH = re.compile(r"\n\s*\n")
_LINE = re.compile(r"\n")
_WORDS = re.compile(r"[^\W_]+")

_PARSED = "conv_id long, turn long, role string, text string, n_quotes int, own array<long>, quotes array<struct<level:int,hash:long,words:int,sentences:array<long>>>"


def _hash(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words).encode()) - (1 << 63)


def pieces(passage: str) -> list[tuple[int, int, list[int]]]:
    """Hash, number of words, and hashes of the passage's sentences that it lies in, of each piece of the passage."""
    text = passage.lower()
    found = list(_WORDS.finditer(text))
    words, starts, n = [m[0] for m in found], [m.start() for m in found], len(found)
    # where a piece can begin or end, as numbers of words
    sentences, lines, paragraphs = ({bisect_left(starts, m.start()) for m in r.finditer(text)} | {0, n} for r in (_SENTENCE, _LINE, _PARAGRAPH))
    spans = {x for cuts in ({0, n}, sentences, lines, paragraphs, sentences | lines, sentences | paragraphs) for x in pairwise(sorted(cuts))}
    ends = sorted(sentences)
    hashes = [_hash(words[i:j]) for i, j in pairwise(ends)]
    at = lambda word: bisect_left(ends, word + 1) - 1
    return [(_hash(words[i:j]), j - i, hashes[at(i) : at(j - 1) + 1]) for i, j in sorted(spans)]


def parse(text: str | None) -> tuple[str, list[str], list[tuple[int, str]]]:
    """The text without quotes, its own passages, and its quoted passages with their levels."""
    runs: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        m = _QUOTE.match(line)
        level, content = (m[1].count(">"), m[2]) if m else (0, line)
        if level and runs and runs[-1][0] == 0 and runs[-1][1]:
            while runs[-1][1] and not runs[-1][1][-1].strip():
                runs[-1][1].pop()
            if runs[-1][1] and _WROTE.match(runs[-1][1][-1]):
                runs[-1][1].pop()
        if not runs or runs[-1][0] != level:
            runs.append((level, []))
        runs[-1][1].append(content)
    own = ["\n".join(ls).strip("\n") for level, ls in runs if level == 0]
    own = [p for p in own if p.strip()]
    if len(runs) == 1 and runs[0][0] == 0:
        clean = text or ""
    else:
        clean = "\n".join(own)
    quoted = [(level, "\n".join(ls)) for level, ls in runs if level and any(x.strip() for x in ls)]
    return clean, own, quoted


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            clean, own, quoted = parse(text)
            rows.append((clean, len(quoted), list({h for p in own for h, _, _ in pieces(p)}), [{"level": level, "hash": h, "words": n, "sentences": s} for level, p in quoted for h, n, s in pieces(p)]))
        kinds = (pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("words", pa.int32()), ("sentences", pa.list_(pa.int64()))])))
        kept = [batch.column(c) for c in ("conv_id", "turn", "role")]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["conv_id", "turn", "role", "text", "n_quotes", "own", "quotes"])


def answers(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, parent (a turn), n_linked (quoted sentences that are linked) of messages with a linked quote."""
    q = parsed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*")
    said = parsed.select("conv_id", "turn", F.explode("own").alias("hash")).join(q.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi").distinct()
    both = q.unionByName(said.withColumn("level", F.lit(0)), allowMissingColumns=True)
    # as of a quote's turn, who said it last: a running value, not pairs
    earlier = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    last = both.withColumn("source", F.max(F.when(F.col("level") == 0, F.col("turn"))).over(earlier)).filter("level > 0 AND source IS NOT NULL")
    # each sentence has one vote, that of the longest piece found
    one = last.select("conv_id", "turn", "level", "words", "source", F.explode("sentences").alias("sentence"))
    one = one.groupBy("conv_id", "turn", "level", "sentence").agg(F.max_by("source", F.struct("words", "source")).alias("source"))
    votes = one.groupBy("conv_id", "turn", "level", "source").agg(F.count("*").alias("n"))
    return votes.groupBy("conv_id", "turn").agg(F.max_by("source", F.struct(-F.col("level"), F.col("n"), F.col("source"))).alias("parent"), F.sum("n").alias("n_linked"))


def roots(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """conv_id, turn, parent, n_linked -> also thread (the first turn up the answers) and depth."""
    at = common.materialise(links.withColumns({"up": F.col("parent"), "depth": F.lit(1).cast("long")}), "answers")
    for _ in range(most_rounds):
        step = at.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        now = at.join(step, ["conv_id", "up"], "left")
        if now.filter("up2 IS NOT NULL").isEmpty():
            return at.withColumnRenamed("up", "thread")
        now = now.select("conv_id", "turn", "parent", "n_linked", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"))
        at = common.materialise(now, "answers")
    raise RuntimeError(f"answers are deeper than 2^{most_rounds}")


def link_quotations(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, text) as conv_id, thread, turn, depth, reply_to, role, text, n_quotes, n_linked."""
    m = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    parsed = common.materialise(m.mapInArrow(_parse, _PARSED), "messages")
    r = roots(answers(parsed))
    out = parsed.select("conv_id", "turn", "role", "text", "n_quotes").join(r, ["conv_id", "turn"], "left")
    out = out.select("conv_id", F.coalesce("thread", "turn").alias("thread"), "turn", F.coalesce("depth", F.lit(0)).alias("depth"), F.col("parent").alias("reply_to"), "role", "text", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"))
    return out.orderBy("conv_id", "thread", "turn")


def quoting(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, text) with a line that names each message in its own text, and quotes of the two messages before it.

    The message before is quoted at the first level by its naming line, the one before that at the second, as mail programs do.
    """
    turns = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    order = Window.partitionBy("conv_id").orderBy("turn")
    before = turns.withColumns({"b1": F.lag("turn", 1).over(order), "b2": F.lag("turn", 2).over(order)})
    name = lambda turn: F.concat(F.lit("message "), F.col("conv_id").cast("string"), F.lit(" turn "), turn.cast("string"), F.lit(" here."))
    quote = lambda marks, turn: F.when(turn.isNotNull(), F.concat(F.lit(f"{marks} "), name(turn)))
    d = messages.join(before, ["conv_id", "turn"])
    text = F.concat_ws("\n", F.when(F.col("b1").isNotNull(), F.lit("On Monday someone wrote:")), quote(">>", F.col("b2")), quote(">", F.col("b1")), F.coalesce("text", F.lit("")), name(F.col("turn")))
    return d.select("conv_id", "turn", "role", text.alias("text"))


def quoted_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations' messages with quotes put before them, linked: each answers the one before it, in one thread a conversation."""
    linked = link_quotations(quoting(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return linked.select("conv_id", "turn", "thread", "depth", "reply_to", "n_quotes", "n_linked")


THREADS_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
o AS (SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id) AS thread, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS depth, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS reply_to FROM t)
SELECT conv_id, turn, thread, CAST(depth AS BIGINT) AS depth, reply_to, CAST(least(depth, 2) AS INTEGER) AS n_quotes, CAST(least(depth, 2) AS BIGINT) AS n_linked FROM conversations JOIN o USING (conv_id, turn)
"""


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
