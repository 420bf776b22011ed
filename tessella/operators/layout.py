"""Pages of positioned words: columns by gutters, rows and fragments, tables that grow from captions, printed page numbers.

Each of these depends on a whole page, so a page is one group; it holds a few thousand words at most. Heights run upwards, as in
PDF files. Within a page the work is done on arrays.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tessella.functions import text
from tessella.plans.registry import Tables, query
from tessella.sources import shared

WORD = ("n", "x", "y", "width", "height", "text")

#: Factors of the median height or of the median gap between rows, and the bounds of what they give.
LIMITS = {
    "row": ("height", 0.7, 3, 7), "fragment": ("height", 1.7, 16, 26), "margin": ("height", 1.8, 16, 28),
    "merge": ("gap", 2.2, 18, 36), "continue": ("gap", 1.4, 16, 26), "body": ("gap", 1.9, 24, 34),
}
NO_HEIGHT, NO_GAP = 10.0, 14.0
#: Gutters are strips at least 6 points wide that at most 2 bands, or 8 % of them, reach into; pages need 12 words and 100 points.
BIN, STRIP, FEW_BANDS, BAND_SHARE, LEAST_WORDS, LEAST_WIDTH, LEAST_BAND = 2.0, 6.0, 2, 0.08, 12, 100.0, 8.0
#: Patterns of captions, units, table heads, numbers, sample codes and page labels.
CAPTION = re.compile(r"^(?:table|tablo|çizelge)\s+(\d+)(?=$|[\s.:-])", re.I)
UNIT = re.compile(r"\(\s*(?:[<>~]?\d+(?:[.,]\d+)?\s*)?(?:%|g|mg|µg|μg|ug|kg|ml|l|kcal|kj|iu|ppm|w\s*/\s*[wv]|v\s*/\s*v)(?:\s*/\s*[0-9a-zA-Zµμ%]+)?\s*\)", re.I)
HEAD = re.compile(r"\b(%RSD|RSD|ANAL[Iİ]T)\b", re.I)
NUMBER = re.compile(r"^[<>~]?\d+(?:[.,]\d+)?$")
UNIT_CODE = re.compile(r"^\d+(?:g|mg|ug|µg|μg|kg|ml|l|kcal|kj|iu)$", re.I)
SAMPLE = re.compile(r"^(?:[A-Za-z]{1,4}\d{1,3}|\d{1,3}[A-Za-z]{1,4}|[A-Za-z]-\d{1,3}|\d{1,3}-[A-Za-z]|[A-Za-z]{1,4}\d{1,3}-[A-Za-z]{1,4})$")
SHORT_FORM = re.compile(r"^(?:[A-ZÇĞİÖŞÜ]\.){1,4}$")
CONNECTOR = re.compile(r"\b(?:that|which|with|using|revealed|showed|contained|compared|while|because|therefore|however|between|among|through|from|into|after|before)\b", re.I)
LETTERS, LOWER = "A-Za-zÇĞİÖŞÜçğıöşü", "a-zçğıöşü"
PAGE_FIRST = re.compile(r"\b(?:page|p\.?|sayfa)\s*[#:.-]?\s*([0-9]{1,4})\b", re.I)
NUMBER_FIRST = re.compile(r"\b([0-9]{1,4})\s*(?:[|/:.-]\s*)?(?:page|sayfa)\b", re.I)
ALONE = re.compile(r"^[^\w]?([0-9]{1,4})[^\w]?$")
EDGE_SHARE, EDGE_HEIGHTS, LAST_PAGE = 0.16, 4, 5000


def _median(x: np.ndarray, otherwise: float) -> float:
    return float(np.median(x)) if len(x) else otherwise


def measures(words: Mapping[str, np.ndarray]) -> dict[str, float]:
    """The distances that count as near on a page, from its words' heights and the gaps between their middles."""
    heights = np.asarray(words["height"])
    height = _median(heights[heights > 0], NO_HEIGHT)
    gaps = -np.diff(np.sort(np.asarray(words["middle"]))[::-1])
    of = {"height": height, "gap": _median(gaps[gaps > 0], NO_GAP)}
    return {"height": height} | {k: min(max(of[what] * by, low), high) for k, (what, by, low, high) in LIMITS.items()}


def gutters(words: Mapping[str, np.ndarray], height: float) -> list[float]:
    """The middles of the strips between columns: hardly any band of the page has a word there, and many have on either side."""
    wide = np.asarray(words["width"]) > 0
    x, right, y, heights = (np.asarray(words[c])[wide] for c in ("x", "right", "y", "height"))
    if len(x) < LEAST_WORDS:
        return []
    left, most, low = x.min(), right.max(), y.min()
    if most - left < LEAST_WIDTH:
        return []
    band_height = max(height, LEAST_BAND)
    bands = max(1, int(np.ceil(((y + heights).max() - low) / band_height)) + 1)
    bins = int(np.ceil((most - left) / BIN)) + 1
    begin, end = ((c - left) // BIN for c in (x, right))
    band = ((y - low) // band_height).astype(int)
    edges = np.zeros((bands, bins + 1), int)
    np.add.at(edges, (band, np.clip(begin, 0, bins - 1).astype(int)), 1)
    np.add.at(edges, (band, np.clip(end, 0, bins - 1).astype(int) + 1), -1)
    cover = (np.cumsum(edges, axis=1)[:, :bins] > 0).sum(axis=0)
    full = np.flatnonzero(cover > max(FEW_BANDS, bands * BAND_SHARE))
    if not len(full):
        return []
    # between two neighbouring full bins that are far enough apart lies a strip; margins have a full bin on one side only
    wide = np.flatnonzero(np.diff(full) - 1 >= max(1, int(np.ceil(STRIP / BIN))))
    return [left + (full[i] + 1 + full[i + 1]) / 2 * BIN for i in wide.tolist()]


def arranged(words: Mapping[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, float]]:
    """A page's words with their row (from the top), column and fragment (within the row), in reading order of rows, and the measures.

    A word joins the row above it while the mean height of that row is near; words with a gap or a gutter between them are of
    different fragments; a fragment's column is the number of gutters to the left of it.
    """
    said = np.array([t.strip() != "" for t in words["text"]], bool)
    w = {c: np.asarray(words[c])[said] for c in WORD}
    w["right"], w["middle"] = w["x"] + w["width"], w["y"] + w["height"] / 2
    near = measures(w)
    lanes = np.array(gutters(w, near["height"]))
    order = np.lexsort((w["n"], w["x"], -w["middle"]))
    rows, mean, count = [], 0.0, 0
    for y in w["middle"][order].tolist():
        if count and abs(mean - y) <= near["row"]:
            count += 1
            mean += (y - mean) / count
            rows.append(rows[-1])
        else:
            mean, count = y, 1
            rows.append(rows[-1] + 1 if rows else 0)
    row = np.zeros(len(order), int)
    row[order] = rows
    w["row"] = row
    order = np.lexsort((w["n"], w["x"], row))
    w = {c: v[order] for c, v in w.items()}
    first = np.ones(len(order), bool)
    first[1:] = w["row"][1:] != w["row"][:-1]
    w["column"] = np.searchsorted(lanes, w["x"])
    cut = first.copy()
    cut[1:] |= w["x"][1:] - w["right"][:-1] > near["fragment"]
    cut[1:] |= np.searchsorted(lanes, w["right"][:-1], side="right") < w["column"][1:]
    pieces = np.cumsum(cut)
    w["fragment"] = pieces - pieces[first][np.cumsum(first) - 1] if len(order) else pieces
    return w, near


def placed(words: Mapping[str, np.ndarray]) -> tuple[pd.DataFrame, dict[str, float]]:
    """What ``arranged`` gives, as a table."""
    w, near = arranged(words)
    return pd.DataFrame(w), near


def pieces(w: dict[str, np.ndarray]) -> list[tuple[int, int, int, str, float, float]]:
    """column, row, fragment, text, left and right of the fragments of arranged words."""
    if not len(w["row"]):
        return []
    begin = np.flatnonzero(np.r_[True, (w["row"][1:] != w["row"][:-1]) | (w["fragment"][1:] != w["fragment"][:-1])])
    texts, ends = w["text"].tolist(), [*begin[1:].tolist(), len(w["row"])]
    joined = [" ".join(" ".join(texts[i:j]).split()) for i, j in zip(begin.tolist(), ends)]
    return list(zip(w["column"][begin].tolist(), w["row"][begin].tolist(), w["fragment"][begin].tolist(), joined, np.minimum.reduceat(w["x"], begin).tolist(), np.maximum.reduceat(w["right"], begin).tolist()))


def fragments(w: pd.DataFrame) -> pd.DataFrame:
    """A row for each fragment of placed words: its text, span, middle, and what its text speaks for."""
    g = w.groupby(["row", "fragment"], sort=True)
    gap = (w["x"] - w["right"].shift() > 12) & w["fragment"].eq(w["fragment"].shift()) & w["row"].eq(w["row"].shift())
    f = g.agg(column=("column", "first"), text=("text", " ".join), left=("x", "min"), right=("right", "max"), bottom=("y", "min"), height=("height", "max")).reset_index()
    f["text"] = f["text"].map(lambda t: " ".join(t.split()))
    f["clusters"] = gap.groupby([w["row"], w["fragment"]]).sum().to_numpy() + 1
    f["middle"] = f["row"].map(w.groupby("row")["middle"].mean())
    return f.join(pd.DataFrame([signs(t, c) for t, c in zip(f["text"], f["clusters"])], columns=["caption", "words", "data", "header", "prose", "score"], index=f.index))


def signs(t: str, clusters: int) -> tuple[float, int, bool, bool, bool, int]:
    """Of a fragment's text: the number of the table it is the caption of (NaN: none), its words, whether it holds data, a head or unit,
    whether it reads like prose, and its points as part of a table."""
    tokens = t.split()
    bare = [re.sub(r"^[^\w%]+|[^\w%]+$", "", x) for x in tokens]
    numbers = sum(bool(NUMBER.match(x)) for x in bare)
    samples = sum(bool(SAMPLE.match(x)) and not NUMBER.match(x) and not UNIT_CODE.match(x) for x in bare)
    letters, lower = (len(re.findall(f"[{k}]", t)) for k in (LETTERS, LOWER))
    mostly_lower = lower >= 0.45 * max(1, letters)
    capitals = sum(len(x) >= 3 and all(c == c.upper() for c in x) for x in (re.findall(f"[{LETTERS}]", k) for k in tokens))
    digits = len(re.findall(r"\d", t)) / max(1, len(re.sub(r"\s", "", t)))
    caption, head, unit = CAPTION.match(t), bool(HEAD.search(t)), bool(UNIT.search(t))
    n = len(tokens)
    plain = not caption and not head and mostly_lower and not samples
    prose = plain and not unit and n >= 5 and numbers <= 1 and not capitals
    told = len(re.findall("[.!?;]", t)) > 0 or len(re.findall("[,.!?;]", t)) >= 2 or bool(CONNECTOR.search(t))
    narrative = plain and n >= 8 and letters >= 12 and capitals <= 1 and clusters <= 2 and told
    points = 0
    if not prose and not narrative:
        points = 3 * head + 2 * unit + 2 * (capitals > 0 and n <= 3) + 2 * (numbers >= 2) + (digits >= 0.18) + (samples >= 1)
        points += 2 * (sum(bool(SHORT_FORM.match(x)) for x in tokens) >= 2) + (clusters >= 3 and n <= 8) + (n <= 3 and (numbers >= 1 or unit or head))
    return float(caption[1]) if caption else np.nan, n, numbers > 0 or samples > 0, head or unit, prose or narrative, points


def _of_row(f: pd.DataFrame, known: bool, since: int) -> pd.DataFrame:
    """Those fragments of a row below a caption that belong to the table: parts of a table, short heads, or data once data was seen."""
    f = f[~f["prose"]]
    if f.empty:
        return f
    part, short = f["score"] >= 2, f["words"] <= 4
    heads = short.all() and f["words"].sum() <= max(9, 3 * len(f)) and (len(f) >= 2 or f["header"].any() or part.any())
    if part.any():
        return f[part | short] if heads else f[part]
    if known and f["data"].any():
        return f
    return f[short] if heads and (known or since <= 1) else f[:0]


def tables(f: pd.DataFrame, near: dict[str, float]) -> list[dict]:
    """The tables of a page's fragments: captions, the lines that go on with them, and the rows below within their span."""
    rows = {k: g for k, g in f.groupby("row", sort=True)}
    middle = {k: g["middle"].iloc[0] for k, g in rows.items()}
    last = max(rows, default=-1)
    over = lambda g, span: g[(g["right"] >= span[0]) & (g["left"] <= span[1])]
    grown = lambda span, g: (min(span[0], g["left"].min()), max(span[1], g["right"].max()))
    blocks: list[dict] = []
    for i in f.index[f["caption"].notna()]:
        c = f.loc[[i]]
        row, number = int(c["row"].iloc[0]), int(c["caption"].iloc[0])
        b = blocks[-1] if blocks else None
        if b and b["number"] == number and row - b["end"] <= 3 and middle[b["end"]] - middle[row] <= near["merge"] and len(over(c, b["span"])):
            b |= {"parts": [*b["parts"], c], "end": row, "span": grown(b["span"], c)}
        else:
            blocks.append({"number": number, "parts": [c], "start": row, "end": row, "span": grown((np.inf, -np.inf), c)})
    for b in blocks:
        for more in range(3):
            row = b["end"] + 1
            if row > last or middle[row - 1] - middle[row] > near["continue"] or rows[row]["caption"].notna().any():
                break
            c = over(rows[row], b["span"])
            if len(c) != 1 or c["score"].iloc[0] >= 2 or not ((not c["prose"].iloc[0] and c["words"].iloc[0] <= 5) or (more < 2 and c["words"].iloc[0] <= 34)):
                break
            b |= {"parts": [*b["parts"], c], "end": row, "span": grown(b["span"], c)}
    out = []
    for b, following in zip(blocks, [*blocks[1:], None]):
        span = (b["span"][0] - near["margin"], b["span"][1] + near["margin"])
        body, at, known = [], None, False
        for row in range(b["end"] + 1, following["start"] if following else last + 1):
            gap = middle[at] - middle[row] if at is not None else 0.0
            if rows[row]["caption"].notna().any() or gap > near["body"]:
                break
            c = over(rows[row], span)
            if c.empty:
                if gap > near["continue"]:
                    break
                continue
            own = _of_row(c, known, row - b["end"] - 1)
            if own.empty:
                break
            body.append(own)
            at, known, span = row, known or bool(own["data"].any()), grown(span, own)
        cells = pd.concat(body) if body else f[:0]
        if body and (len(body) >= 2 or cells["score"].sum() >= 4 or cells["data"].any()):
            out.append({"number": b["number"], "caption": " ".join(t for p in b["parts"] for t in p["text"]), "body_rows": len(body), "left": float(cells["left"].min()), "right": float(cells["right"].max()), "cells": [r["text"].tolist() for r in body]})
    return out


def printed_number(w: pd.DataFrame, near: dict[str, float], number: float, count: float) -> int | None:
    """The page number that stands at a page's top or bottom: one with a word for page, or one alone that fits the file's own."""
    if not len(w):
        return None
    low, high = w["y"].min(), (w["y"] + w["height"]).max()
    edge = max(max(1.0, high - low) * EDGE_SHARE, near["height"] * EDGE_HEIGHTS)
    rows = w.groupby("row").agg(middle=("middle", "mean"), text=("text", " ".join))
    at_edge = rows[(rows["middle"] <= low + edge) | (rows["middle"] >= high - edge)]["text"]
    fit = lambda m: int(m[1]) if m and 0 < int(m[1]) <= LAST_PAGE else None
    for t in at_edge:
        if found := fit(PAGE_FIRST.search(t)) or fit(NUMBER_FIRST.search(t)):
            return found
    for t in at_edge:
        found = fit(ALONE.match(t.strip()))
        if found and ((count == count and found > count) or found == number):
            return found
    return None


def listed(words: DataFrame, page: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """page and its words as a list of structs, of words(page, n, x, y, width, height, text)."""
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("x", "y", "width", "height")]
    d = words.filter("text IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    return d.groupBy(page).agg(F.collect_list(F.struct(F.col("n").cast("double").alias("n"), *numbers, "text", *[F.col(c).cast("double").alias(c) for c in extra])).alias("words"))


def _per_page(pages: DataFrame, page: str, one: Callable[[dict[str, np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """page and `found`, the list of what `one` makes of the page's words; pages(page, words) are read in Arrow batches of whole pages."""
    shared.arrow_batches(pages.sparkSession)
    out = StructType.fromDDL(f"found array<struct<{schema}>>")
    kind, names = to_arrow_type(out["found"].dataType), out["found"].dataType.elementType.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat, at = column.flatten(), np.r_[0, np.cumsum(column.value_lengths().fill_null(0).to_numpy())]
            fields = {flat.type.field(i).name: flat.field(i) for i in range(flat.type.num_fields)}
            arrays = {c: np.array(v.to_pylist(), object) if c == "text" else v.to_numpy(zero_copy_only=False) for c, v in fields.items()}
            rows = [[dict(zip(names, r)) for r in one({c: v[i:j] for c, v in arrays.items()})] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=[page, "found"])

    return pages.select(page, "words").mapInArrow(run, StructType([pages.schema[page], out["found"]]))


def _rows(found: DataFrame, page: str) -> DataFrame:
    return found.select(page, F.explode("found").alias("found")).select(page, "found.*")


def listed_fragments(pages: DataFrame, page: str) -> DataFrame:
    """page and `found`, the list of its fragments with column, row, fragment, text, left and right; pages(page, words) as ``listed`` gives them."""
    return _per_page(pages, page, lambda g: pieces(arranged(g)[0]), "column int, row int, fragment int, text string, left double, right double")


def page_fragments(words: DataFrame, page: str) -> DataFrame:
    """page, column, row, fragment, text, left, right of words(page, n, x, y, width, height, text). Read column by column."""
    return _rows(listed_fragments(listed(words, page), page), page)


def page_tables(words: DataFrame, page: str) -> DataFrame:
    """page, number, caption, body_rows, left, right, cells (a list for each row) of the tables that a page's captions announce."""

    def one(g: dict[str, np.ndarray]) -> list[tuple]:
        w, near = placed(g)
        return [] if w.empty else [tuple(t.values()) for t in tables(fragments(w), near)]

    return _rows(_per_page(listed(words, page), page, one, "number int, caption string, body_rows int, left double, right double, cells array<array<string>>"), page)


def printed_pages(words: DataFrame, page: str, number: str, count: str) -> DataFrame:
    """page, printed: the number printed on each page that has one; ``number`` and ``count`` are the file's own number and count of pages."""

    def one(g: dict[str, np.ndarray]) -> list[tuple]:
        w, near = placed(g)
        found = printed_number(w, near, g[number][0], g[count][0])
        return [] if found is None else [(found,)]

    return _rows(_per_page(listed(words, page, (number, count)), page, one, "printed int"), page)


LINES, A_LINE = 20, 5


@query(
    "columns_read",
    r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 1) - 1 AS k FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, CAST(k // 200 AS BIGINT) AS page, CAST(CASE WHEN count(*) = 200 THEN 2 ELSE 1 END AS BIGINT) AS columns, md5(string_agg(word, ' ' ORDER BY k)) AS text_hash FROM w GROUP BY doc_id, k // 200
""",
)
def columns_read(t: Tables) -> DataFrame:
    """Documents set on pages of two columns (a last page that isn't full has one), and read again column by column."""
    whole = 2 * LINES * A_LINE
    d = t.documents.filter("doc_id IS NOT NULL").select("doc_id", text.words(F.col("text")).alias("w"))
    sheets = F.transform(F.sequence(F.lit(0), F.ceil(F.size("w") / whole).cast("int") - 1), lambda i: F.slice("w", i * whole + 1, whole))
    d = d.filter("size(w) > 0").select("doc_id", F.posexplode(sheets).alias("page", "w"))
    # rows of one document, if it has several, are set on the same pages
    d = d.groupBy("doc_id", "page").agg(F.collect_list("w").alias("rows"), F.sum(F.size("w")).alias("words"))

    def word(w: Column, at: Column) -> Column:
        c = F.when(F.col("words") == whole, F.floor(at / (LINES * A_LINE))).otherwise(0)
        line = F.floor((at - c * LINES * A_LINE) / A_LINE)
        return F.struct(at.cast("double").alias("n"), (c * 260 + at % A_LINE * 44).cast("double").alias("x"), (800 - line * 14).cast("double").alias("y"), F.lit(42.0).alias("width"), F.lit(10.0).alias("height"), w.alias("text"))

    pages = d.select(F.struct("doc_id", "page").alias("at"), F.flatten(F.transform("rows", lambda r: F.transform(r, word))).alias("words"))
    read = listed_fragments(pages, "at")
    rows = F.array_sort(F.transform("found", lambda f: F.struct(f["column"], f["row"], f["fragment"], f["text"].alias("text"))))
    columns = F.array_max(F.transform("found", lambda f: f["column"])) + 1
    return read.select("at.doc_id", F.col("at.page").cast("long").alias("page"), columns.cast("long").alias("columns"), F.md5(F.array_join(F.transform(rows, lambda f: f["text"]), " ")).alias("text_hash"))
