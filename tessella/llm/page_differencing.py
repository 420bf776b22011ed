"""Operator 13: the main text of web pages, by differencing pages that are near by URL.

Within each host, pages stand in the order of their URL paths; a page is compared with the two before it and the two after it. The
lines of both (``html_lines``) are aligned by longest common subsequence. A line round the article by its marks (menu, footer,
advert ...) counts as equal when it stands in an equal place, any other one when place and text are equal. Lines that are shared
with at least half of the pages compared are deleted; pages whose source is equal are not compared.

Lines in article elements take part too, but articles are copied, and what is copied is not round an article. So there a near page
that shares half of the article's text or more is a copy and not counted, and of what at least two others and half of all others
share only these go: whole article elements beside one that is the page's own (teasers, notices) and lines that are links from end to end (menus), which
no heading or table holds. Something of the article always stays.

What is marked as standing round an article is deleted even where no near page shares it, as on hosts with one page. Pages with
an article element keep only what is in it; failing that, what is in a main element; failing that, all lines that are left.

Only keys and sizes of lines travel for the comparison: pages are numbered in order by ranges (``common.numbered``), dealt out in blocks of
consecutive numbers with two pages of either neighbour, and each block is aligned by itself, however many pages a host has.

Defined results: null or empty html, and pages without a block of text, give an empty text and n_chars 0. A null url, or one
without a host, is compared with no page. Repeated rows each give a row, with equal values. An empty table gives no rows; other columns
are ignored, whatever their names. Pages of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .html_lines import HEADINGS, Line, lines

NEAR, PAGES_A_BLOCK = 2, 512
#: Bits of alignment rows that are held at once; longer pairs of pages are split in halves first.
MOST_BITS = 1 << 28
#: Links in these blocks are part of an article, though near pages have the same ones.
SAID = HEADINGS | {"caption", "dt", "figcaption", "td", "th"}


def _row(a: list[int], masks: dict[int, int], m: int) -> Iterator[int]:
    """After each element of a: bit j is 0 where b's element j adds to the longest common subsequence with b's elements before it."""
    full = (1 << m) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _masks(b: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for j, x in enumerate(b):
        out[x] = out.get(x, 0) | 1 << j
    return out


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The longest common subsequence of a with each prefix of b, the empty one first."""
    v = (1 << len(b)) - 1
    for v in _row(a, _masks(b), len(b)):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def shared(a: list[int], b: list[int]) -> list[int]:
    """The positions of a that a longest common subsequence of a and b takes."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    both = set(a) & set(b)
    at = [i for i in range(lead, len(a) - tail) if a[i] in both]
    x, y = [a[i] for i in at], [v for v in b[lead : len(b) - tail] if v in both]
    return [*range(lead), *(at[i] for i in _middle(x, y)), *range(len(a) - tail, len(a))]


def _middle(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > MOST_BITS and len(a) > 1:
        half = len(a) // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        return _middle(a[:half], b[:cut]) + [half + i for i in _middle(a[half:], b[cut:])]
    rows = list(_row(a, _masks(b), len(b)))
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                out.append(i)
                j -= 1
    return out[::-1]


def _off(line: Line) -> bool:
    return line.place.strong or line.place.weak


def _key(line: Line) -> int:
    text = b"" if _off(line) else line.text.encode(errors="replace")
    return int.from_bytes(hashlib.blake2b(line.place.slot.to_bytes(4, "little") + text, digest_size=8).digest(), "little", signed=True)


def _wanted(page: list[Line]) -> list[int]:
    """For each line: 0 round the article by its marks or outside of it, 1 wanted unless it is shared, 2 wanted always."""
    best = max((x.place.region for x in page if not _off(x)), default=0)
    want = lambda x: x.place.region == best or (best == 2 and x.place.region == 1 and x.place.block == "h1")
    return [0 if _off(x) or not want(x) else 2 if best == 2 else 1 for x in page]


def _held(page: list[Line]) -> tuple[list[int], list[int]]:
    """For each line that is wanted always twice its length, and one more if it is a link from end to end, 0 for others; their article elements' numbers, if not all are 1."""
    wanted = _wanted(page)
    if 2 not in wanted:
        return [], []
    held = [2 * len(x.text) + (x.linked and x.place.block not in SAID) if w == 2 else 0 for x, w in zip(page, wanted)]
    parts = [x.place.part for x in page]
    return held, parts if any(h and p != 1 for h, p in zip(held, parts)) else []


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, held, parts = [], [], []
        for page in batch.column("html").to_pylist():
            found = lines(page or "")
            keys.append([_key(x) for x in found])
            for out, values in zip((held, parts), _held(found)):
                out.append(values)
        columns = [batch.column(n) for n in ("id1", "id2", "url", "source")] + [pa.array(keys, pa.list_(pa.int64())), pa.array(held, pa.list_(pa.int32())), pa.array(parts, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["id1", "id2", "url", "source", "keys", "held", "parts"])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, wanted = [], []
        for page in batch.column("html").to_pylist():
            found = lines(page or "")
            texts.append([x.text for x in found])
            wanted.append(_wanted(found))
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("page_id", "url", "id1", "id2")] + [pa.array(texts, pa.list_(pa.string())), pa.array(wanted, pa.list_(pa.int32()))], names=["page_id", "url", "id1", "id2", "lines", "wanted"])


def _gone(page: dict, near: list[dict]) -> list[int]:
    """The places of a page's lines that the pages near it take away."""
    n = len(page["keys"])
    held = np.array(page["held"] or [0] * n, np.int64)
    parts = np.array(page["parts"] or [1] * n, np.int64)
    body, sizes, links = (held > 0) & (parts > 0), held // 2, held % 2 > 0
    votes, inner, others = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for x in near:
        at = np.zeros(n, bool)
        at[shared(page["keys"], x["keys"])] = True
        votes += at
        if 2 * sizes[body & at].sum() < sizes[body].sum():
            others += 1
            left = np.bincount(parts[body & ~at], minlength=parts.max() + 1)
            inner += body & at & (links | (left[parts] == 0))
    own = (inner > 1) & (2 * inner >= others)
    if not (body & ~own).any():
        own[:] = False
    return np.flatnonzero(own | ((held == 0) & (votes > 0) & (2 * votes >= len(near)))).tolist()


def _align(table: pa.Table) -> pa.Table:
    """A block of consecutive pages with their neighbours -> for its own pages the places of lines that are shared."""
    rows = sorted(table.to_pylist(), key=lambda r: r["place"])
    out = []
    for i, r in enumerate(rows):
        if not r["own"]:
            continue
        near = [rows[j] for j in range(max(0, i - NEAR), min(len(rows), i + NEAR + 1)) if j != i and abs(rows[j]["place"] - r["place"]) <= NEAR]
        near = [x for x in near if r["host"] and x["host"] == r["host"] and x["source"] != r["source"]]
        out.append((r["id1"], r["id2"], _gone(r, near) if near and r["keys"] else []))
    return pa.table([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int32()))], names=["id1", "id2", "gone"])


def _identified(pages: DataFrame) -> DataFrame:
    """page_id, url, html and 128 bits that identify url and html."""
    h = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", "html", F.xxhash64("url", h, F.lit(1)).alias("id1"), F.xxhash64(F.lit(2), h, "url").alias("id2"), F.xxhash64(h).alias("source"))


def shared_lines(pages: DataFrame) -> DataFrame:
    """id1, id2, gone: for each distinct page with a host the places, among its lines, of those that near pages take away."""
    found = _identified(pages)
    scratch = common.Scratch(pages.sparkSession)
    keyed = found.select("id1", "id2", "url", "source", "html").mapInArrow(_keys, "id1 long, id2 long, url string, source long, keys array<long>, held array<int>, parts array<int>").dropDuplicates(["id1", "id2"])
    address = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)", 2)
    keyed = keyed.withColumn("host", F.lower(address)).withColumn("path", path).filter("host <> ''")
    placed = common.numbered(scratch, keyed, ["host", "path", "url", "id1", "id2"], "place")
    block = lambda by: F.floor((F.col("place") + by) / PAGES_A_BLOCK)
    dealt = placed.withColumn("block", F.explode(F.array_distinct(F.array(block(0), block(-NEAR), block(NEAR))))).withColumn("own", F.col("block") == block(0))
    dealt = dealt.select("block", "own", "place", "host", "source", "id1", "id2", "keys", "held", "parts")
    return dealt.groupBy("block").applyInArrow(_align, "id1 long, id2 long, gone array<int>")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars; n_lines in the page, n_shared of them deleted as shared, n_marked deleted by their marks only."""
    common.arrow_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    read = _identified(pages).select("page_id", "url", "html", "id1", "id2").mapInArrow(_lines, f"page_id {kind}, url string, id1 long, id2 long, lines array<string>, wanted array<int>")
    both = read.join(shared_lines(pages), ["id1", "id2"], "left")
    both = both.withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    kept = F.filter("lines", lambda x, i: (F.get("wanted", i) > 0) & ~F.array_contains("gone", i))
    both = both.withColumn("text", F.array_join(kept, "\n"))
    n = F.size("lines").cast("long")
    marked = F.size(F.filter("wanted", lambda w, i: (w == 0) & ~F.array_contains("gone", i))).cast("long")
    return both.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), n.alias("n_lines"), F.size("gone").cast("long").alias("n_shared"), marked.alias("n_marked"))


def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


#: For pages of the given table's form: one article of headings and paragraphs, with the references &amp; &lt; &gt; &quot; &#x27;
#: and &#39; only. Differencing must leave exactly this.
ORACLE_SQL = r"""
WITH articles AS (SELECT page_id, url, row_number() OVER () AS rid, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS a FROM pages),
blocks AS (
  SELECT page_id, url, rid, unnest(string_split_regex(a, '</?(?:p|h1)>')) AS b, generate_subscripts(string_split_regex(a, '</?(?:p|h1)>'), 1) AS i FROM articles),
bare AS (SELECT page_id, url, rid, i, regexp_replace(b, '<[^>]*>', ' ', 'g') AS t FROM blocks),
signs AS (SELECT page_id, url, rid, i, regexp_replace(regexp_replace(regexp_replace(t, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&#(x27|39);?', chr(39), 'g') AS t FROM bare),
decoded AS (SELECT page_id, url, rid, i, regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS t FROM signs),
trimmed AS (SELECT page_id, url, rid, i, trim(regexp_replace(t, '[\s\p{Z}\x0B\x1C-\x1F\x{85}]+', ' ', 'g')) AS t FROM decoded),
texts AS (SELECT page_id, url, rid, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (t <> ''), '') AS text FROM trimmed GROUP BY page_id, url, rid)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts"""
