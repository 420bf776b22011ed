"""Evidence and payloads: nested rows, canonical and tolerant JSON, grouped places, quotes that overlap, layout of positioned words."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from tessella.functions import text
from tessella.plans.registry import Tables, query
from tessella.sources import shared

from .linking import common_length, components, passage_links


def exploded(rows: DataFrame, payload: str, schema: str, keep: list[str]) -> DataFrame:
    """keep, place, item for each element of a JSON array of the given element schema; what is no such array gives no rows."""
    return rows.select(*keep, F.posexplode(F.from_json(payload, f"array<{schema}>")).alias("place", "item"))


@query(
    "payload_rows",
    """
SELECT l_orderkey, count(*) AS items, round(sum(l_quantity), 2) AS quantity, max(l_linenumber) AS last_line FROM lineitem GROUP BY l_orderkey
""",
)
def payload_rows(t: Tables) -> DataFrame:
    """Lines put into a JSON payload for each order, and taken out of it again as rows."""
    one = F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"))
    made = t.lineitem.groupBy("l_orderkey").agg(F.to_json(F.collect_list(one)).alias("payload"))
    d = exploded(made, "payload", "struct<line:int,quantity:double>", ["l_orderkey"])
    return d.groupBy("l_orderkey").agg(F.count("*").alias("items"), F.round(F.sum("item.quantity"), 2).alias("quantity"), F.max("item.line").alias("last_line"))


@F.pandas_udf(StringType())
def canonical_json(c: pd.Series) -> pd.Series:
    """A JSON text with sorted keys and no blanks; null where it isn't JSON. No built-in function orders keys at every depth."""

    def one(s: str) -> str | None:
        try:
            return json.dumps(json.loads(s), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return c.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def json_inside(c: pd.Series) -> pd.Series:
    """The first complete JSON object or array in a text that may have prose or code fences about it; null if there is none."""
    reader = json.JSONDecoder()

    def one(s: str) -> str | None:
        for at, x in enumerate(s):
            if x in "{[":
                try:
                    _, end = reader.raw_decode(s, at)
                except ValueError:
                    continue
                return s[at:end]
        return None

    return c.map(one, na_action="ignore")


@query(
    "tolerant_payloads",
    """
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE '{"a":[1,2],"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' END AS payload FROM events
""",
)
def tolerant_payloads(t: Tables) -> DataFrame:
    """Payloads inside prose and fences, found and brought to one form."""
    made = F.concat(F.lit('{ "k": '), F.get_json_object("props", "$.k"), F.lit(', "a": [1, 2] }'))
    way = F.when(F.col("event_id") % 4 == 0, made).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Here [it] is: ```json\n"), made, F.lit("\n``` done}"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("{oops "), made)).otherwise(F.lit("nothing { here"))
    return t.events.select("event_id", canonical_json(json_inside(way)).alias("payload"))


def grouped_places(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows(key, food, nutrient, quote, citation, n, seen) as one row a key: names in order, rows summed, the first quote and citation given."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.trim(c) != ""), F.col("seen"))).alias(c)
    names = lambda c, out: F.sort_array(F.collect_set(F.when(F.trim(c) != "", F.trim(c)))).alias(out)
    return rows.groupBy(*key).agg(names("food", "foods"), names("nutrient", "nutrients"), F.sum("n").alias("n"), first("quote"), first("citation"))


@query(
    "evidence_places",
    """
SELECT l_suppkey, l_returnflag, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS foods, CAST(sum(l_linenumber) AS BIGINT) AS n, arg_min(p_name, l_orderkey * 10000000 + l_partkey) FILTER (l_quantity > 25) AS quote
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey, l_returnflag
""",
)
def evidence_places(t: Tables) -> DataFrame:
    d = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    d = d.select("l_suppkey", "l_returnflag", F.col("p_brand").alias("food"), F.col("p_type").alias("nutrient"), F.when(F.col("l_quantity") > 25, F.col("p_name")).alias("quote"), F.lit(None).cast("string").alias("citation"), F.col("l_linenumber").alias("n"), (F.col("l_orderkey") * 10_000_000 + F.col("l_partkey")).alias("seen"))
    return grouped_places(d, ["l_suppkey", "l_returnflag"]).select("l_suppkey", "l_returnflag", F.array_join("foods", ",").alias("foods"), "n", "quote")


@F.pandas_udf(IntegerType())
def longest_common(a: pd.Series, b: pd.Series) -> pd.Series:
    """common_length of two texts; null where either is null."""
    return pd.Series([None if pd.isna(x) or pd.isna(y) else common_length(x, y) for x, y in zip(a, b)], dtype="Int32")


def same_passage(a: str, b: str) -> bool:
    """Whether two quotes are of one passage: equal, one in the other, or 40 characters, or three fifths of the shorter, in common."""
    if not a or not b:
        return False
    if a in b or b in a:
        return True
    shorter = min(len(a), len(b))
    if shorter < 20:
        return False
    n = common_length(a, b)
    return n >= 40 or 5 * n >= 3 * shorter


def components_longest(rows: DataFrame, page: list[str]) -> DataFrame:
    """rows(page, id, quote, n) with quotes of one passage on one page put together: page, id (of the longest quote), quote, n, members.

    Quotes are compared as plain words; of equally long ones the lowest id stands. Rows with equal page, id and quote are one place;
    a quote without words stays alone. Pages of any number of quotes: links come from shared runs, components from joins.
    """
    place = F.struct(*page, "id", F.xxhash64("quote").alias("__h"))
    d = rows.withColumn("__node", place).withColumn("__page", F.struct(*page))
    texts = d.select("__page", "__node", text.plain(F.col("quote")).alias("__plain")).dropDuplicates(["__node"])
    roots = components(passage_links(texts, "__page", "__node", "__plain"))
    d = d.join(roots, F.col("__node") == F.col("node"), "left").withColumn("__root", F.coalesce("root", "__node"))
    top = F.min_by(F.struct("id", "quote"), F.struct(-F.coalesce(F.length("quote"), F.lit(-1)), F.col("id")))
    out = d.groupBy("__page", "__root").agg(top.alias("top"), F.sum("n").alias("n"), F.count("*").alias("members"))
    return out.select(*[F.col(f"__page.{c}").alias(c) for c in page], "top.id", "top.quote", "n", "members")


@query("components_longest")
def merged_quotes(t: Tables) -> DataFrame:
    """Turns of a conversation as quotes of one page."""
    d = t.conversations.filter("conv_id IS NOT NULL AND text IS NOT NULL").select("conv_id", F.col("turn").alias("id"), F.col("text").alias("quote"), F.lit(1).cast("long").alias("n"))
    return components_longest(d, ["conv_id"])


@query("common_passages")
def common_passages(t: Tables) -> DataFrame:
    """How long a passage each answer has in common with the turn before it."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.withColumn("before", before).filter("before IS NOT NULL").select("conv_id", "turn", longest_common(F.col("before"), F.col("text")).alias("common"))


def evidence_status(places: DataFrame, matches: DataFrame) -> DataFrame:
    """places(id) with status and page: a match beats a mapped hint, that a plain hint, that nothing; of equals the first seen.

    matches(id, status, kind, page, seen).
    """
    rank = F.when(F.col("status") == "matched", 0).when((F.col("status") == "hinted") & (F.col("kind") == "mapped_page_hint"), 1).when(F.col("status") == "hinted", 2)
    m = matches.withColumn("__r", rank).filter("__r IS NOT NULL")
    # the first match and the first plain hint hold; of mapped hints the last one does
    order = F.struct("__r", F.when(F.col("__r") == 1, -F.col("seen")).otherwise(F.col("seen")))
    top = m.groupBy("id").agg(F.min_by(F.struct("status", "page"), order).alias("top"))
    return places.join(top, "id", "left").select(*places.columns, F.coalesce("top.status", F.lit("unverified")).alias("status"), F.col("top.page").alias("page"))


@query(
    "evidence_statuses",
    """
WITH m AS (SELECT user_id AS id, event_id, CASE WHEN event_type = 'purchase' AND value > 120 THEN 0 WHEN event_type = 'click' AND value > 100 THEN 1 WHEN event_type = 'view' THEN 2 END AS r FROM events),
x AS (SELECT id, event_id, r, row_number() OVER (PARTITION BY id ORDER BY r, CASE WHEN r = 1 THEN -event_id ELSE event_id END) AS rn FROM m WHERE r IS NOT NULL)
SELECT u.id, CASE r WHEN 0 THEN 'matched' WHEN 1 THEN 'hinted' WHEN 2 THEN 'hinted' ELSE 'unverified' END AS status, x.event_id AS page FROM (SELECT DISTINCT user_id AS id FROM events) u LEFT JOIN x ON x.id = u.id AND rn = 1
""",
)
def evidence_statuses(t: Tables) -> DataFrame:
    e, v = F.col("event_type"), F.col("value")
    status = F.when((e == "purchase") & (v > 120), "matched").when(((e == "click") & (v > 100)) | (e == "view"), "hinted").otherwise("unverified")
    m = t.events.select(F.col("user_id").alias("id"), status.alias("status"), F.when(e == "click", "mapped_page_hint").otherwise("page_hint").alias("kind"), F.col("event_id").alias("page"), F.col("event_id").alias("seen"))
    return evidence_status(t.events.select(F.col("user_id").alias("id")).distinct(), m)


def _rows_of_page(words: list[tuple[float, float, float, str]], row_gap: float, word_gap: float) -> Iterator[tuple[int, int, str]]:
    """(row, fragment, text) of a page's words (x, right, y, word), which come from the top: a word joins a row whose mean height it is near."""
    rows: list[tuple[float, list]] = []
    for x, right, y, word in words:
        if rows and abs(rows[-1][0] - y) <= row_gap:
            mean, own = rows[-1]
            own.append((x, right, word))
            rows[-1] = ((mean * (len(own) - 1) + y) / len(own), own)
        else:
            rows.append((y, [(x, right, word)]))
    for i, (_, own) in enumerate(rows):
        own.sort()
        part, end, piece = 0, None, []
        for x, right, word in own:
            if end is not None and x - end > word_gap:
                yield i, part, " ".join(piece)
                part, piece = part + 1, []
            piece.append(word)
            end = right if end is None else max(end, right)
        yield i, part, " ".join(piece)


def layout_rows(words: DataFrame, page: str, row_gap: float = 3.0, word_gap: float = 12.0) -> DataFrame:
    """page, row, fragment, text from words(page, x, right, y, word): rows by a running mean of heights, fragments by gaps.

    The mean depends on the order, so a page is one list; pages hold a few thousand words at most. Arrow batches bring many pages at a time.
    """
    kind = words.schema[page].dataType.simpleString()
    shared.arrow_batches(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat, sizes = column.flatten(), column.value_lengths().to_numpy()
            x, right, y = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            order = np.lexsort((x, -y, np.repeat(np.arange(len(sizes)), sizes)))
            every = list(zip(x[order].tolist(), right[order].tolist(), y[order].tolist(), flat.field(3).take(pa.array(order)).to_pylist()))
            ends = np.cumsum(sizes)
            found = [(at, *r) for at, (i, j) in enumerate(zip((ends - sizes).tolist(), ends.tolist())) for r in _rows_of_page(every[i:j], row_gap, word_gap)]
            at, row, part, texts = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(row, pa.int32()), pa.array(part, pa.int32()), pa.array(texts, pa.string())], names=[page, "row", "fragment", "text"])

    listed = words.groupBy(page).agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("x", "right", "y")], "word")).alias("words"))
    return listed.mapInArrow(run, f"{page} {kind}, row int, fragment int, text string")


@query("layout_regions")
def layout_regions(t: Tables) -> DataFrame:
    """Lines of orders as words on a page: heights by line number, places by quantity."""
    d = t.lineitem.select("l_orderkey", (F.col("l_quantity") * 10).alias("x"), (F.col("l_quantity") * 10 + 8).alias("right"), (100 - F.col("l_linenumber") * 2.0).alias("y"), F.col("l_partkey").cast("string").alias("word"))
    return layout_rows(d, "l_orderkey", 2.5, 60.0)


def abstract_text(index: Column) -> Column:
    """A text from its inverted index (word: positions), words by position."""
    at = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(at), lambda x: x["w"]), " ")
