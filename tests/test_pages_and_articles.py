import random
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pytest

from tessella.operators import layout
from tessella.sources import xml

WORDS = "page int, n int, x double, y double, width double, height double, text string"


def line(page, y, x, texts, height=10.0, gap=3.0):
    out = []
    for t in texts:
        out.append([page, 0, float(x), float(y), 5.0 * len(t), height, t])
        x += 5.0 * len(t) + gap
    return out


def numbered(rows):
    return [(r[0], i, *r[2:]) for i, r in enumerate(rows)]


def two_columns(seed, lines):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9)))
    left, right, rows = [], [], []
    for i in range(lines):
        for x, into in ((40.0, left), (330.0, right)):
            texts, width = [], 0.0
            while True:
                t = word()
                if width + 5 * len(t) > 250:
                    break
                texts.append(t)
                width += 5 * len(t) + 3
            rows += line(1, 700 - 13 * i + rng.uniform(-1, 1), x, texts)
            into.append(" ".join(texts))
    rng.shuffle(rows)
    return numbered(rows), left, right


@pytest.mark.parametrize("seed,lines", [(1, 12), (2, 30), (3, 45)])
def test_columns_are_read_one_after_the_other(spark, seed, lines):
    rows, left, right = two_columns(seed, lines)
    got = layout.page_fragments(spark.createDataFrame(rows, WORDS), "page").orderBy("column", "row", "fragment").collect()
    assert [r["text"] for r in got if r["column"] == 0] == left and [r["text"] for r in got if r["column"] == 1] == right


def plain_gutters(words, height):
    """Two-point bins and bands, counted one by one."""
    w = [x for x in words if x[4] > 0]
    if len(w) < 12:
        return []
    left, right, low = min(x[2] for x in w), max(x[2] + x[4] for x in w), min(x[3] for x in w)
    if right - left < 100:
        return []
    band = max(height, 8)
    bands = max(1, int(np.ceil((max(x[3] + x[5] for x in w) - low) / band)) + 1)
    cover = [set() for _ in range(int(np.ceil((right - left) / 2)) + 1)]
    for x in w:
        for b in range(int((x[2] - left) // 2), min(len(cover) - 1, int((x[2] + x[4] - left) // 2)) + 1):
            cover[b].add(int((x[3] - low) // band))
    free = [len(c) <= max(2, bands * 0.08) for c in cover]
    out, start = [], None
    for b, f in enumerate([*free, False]):
        if f and start is None:
            start = b
        elif not f and start is not None:
            if b - start >= 3 and not all(free[:start]) and not all(free[b:]) and b < len(cover):
                out.append(left + (start + b) / 2 * 2)
            start = None
    return out


@pytest.mark.parametrize("seed", range(8))
def test_gutters_equal_counting(seed):
    rng = random.Random(seed)
    words = [(1, i, rng.choice([0, 150, 320]) + rng.uniform(0, 100), 600 - 12.0 * rng.randrange(30), rng.uniform(5, 60), 10.0, "x") for i in range(rng.choice([5, 40, 300]))]
    w = pd.DataFrame(words, columns=["page", "n", "x", "y", "width", "height", "text"]).assign(right=lambda d: d["x"] + d["width"])
    assert layout.gutters(w, 10.0) == pytest.approx(plain_gutters(words, 10.0))


def test_tables_grow_from_captions(spark):
    rows = line(1, 700, 40, "This study was made with beans that were grown in the north of the country.".split())
    rows += line(1, 680, 40, ["Table", "1.", "Protein", "of", "beans"]) + line(1, 668, 40, ["and", "peas"])
    for i, cells in enumerate([["Food", "Protein", "(g)"], ["Bean", "21.4", "0.3"], ["Pea", "24", "1.1"], ["Nd", "1.50"]]):
        for k, c in enumerate(cells):
            rows += line(1, 652 - 14 * i, 40 + 60 * k, [c])
    rows += line(1, 580, 40, "The values were higher than those of others, which was not expected at all.".split())
    rows += line(1, 540, 40, ["Table", "2", "No", "rows"]) + line(1, 528, 40, "Prose goes on here because it is long enough to be a paragraph, isn't it?".split())
    (t,) = layout.page_tables(spark.createDataFrame(numbered(rows), WORDS), "page").collect()
    assert (t["number"], t["caption"], t["body_rows"]) == (1, "Table 1. Protein of beans and peas", 4)
    assert t["cells"] == [["Food", "Protein", "(g)"], ["Bean", "21.4", "0.3"], ["Pea", "24", "1.1"], ["Nd", "1.50"]]


@pytest.mark.parametrize("edge,number,count,want", [("Page 12", 3, 9, 12), ("12 | Page", 3, 9, 12), ("- 7", 7, 9, None), ("-7-", 7, 9, 7), ("7", 3, 9, None), ("77", 3, 9, 77), ("p. 9999", 1, 2, None), ("0", 1, 2, None), ("x", 1, 2, None)])
def test_printed_page_numbers(spark, edge, number, count, want):
    rows = line(1, 800, 40, ["Journal", "of", "Things"]) + [r for i in range(30) for r in line(1, 760 - 20 * i, 40, ["12", "beans"])] + line(1, 100, 300, [edge])
    d = spark.createDataFrame([(*r, float(number), float(count)) for r in numbered(rows)], f"{WORDS}, number double, pages double")
    assert [r["printed"] for r in layout.printed_pages(d, "page", "number", "pages").collect()] == ([] if want is None else [want])


def test_empty_pages(spark):
    d = spark.createDataFrame([(1, 0, 1.0, 1.0, 2.0, 3.0, " "), (2, 0, None, 1.0, 2.0, 3.0, "a"), (3, 0, 1.0, 1.0, None, None, "a"), (4, 0, 1.0, 1.0, 1.0, 1.0, None)], WORDS)
    assert [(r["page"], r["text"]) for r in layout.page_fragments(d, "page").collect()] == [(3, "a")]
    assert layout.page_tables(d, "page").count() == 0


APART = xml.APART


def walked(e, own_only=False):
    """The text of a tree, blanks round the elements that stand apart."""
    tag = e.tag.rpartition("}")[2]
    out = [" " if tag in APART else "", e.text or ""]
    for c in e:
        name = c.tag.rpartition("}")[2]
        if own_only and name in ("sec", "title"):
            out.append(" ")
        else:
            out.append(walked(c))
        out.append(c.tail or "")
    return "".join([*out, " " if tag in APART else ""])


def one(t):
    return " ".join(t.split())


def made(rng, depth=0):
    word = lambda: rng.choice(["alpha", "b &amp; c", "d&lt;e", "<i>in</i>side", "<sub>2</sub>", "&#233;t&#233;", "<![CDATA[x < y]]>", "\n"])
    text = " ".join(word() for _ in range(rng.randrange(1, 6)))
    table = f"<table-wrap><label>T{depth}</label><caption><p>{word()}</p></caption><table><tr><th>a</th><th>{word()}</th></tr><tr><td>x<table><tr><td>in</td></tr></table></td><td>1</td></tr></table></table-wrap>"
    inner = "".join(made(rng, depth + 1) for _ in range(rng.randrange(3))) if depth < 4 else ""
    return f"<sec><title>S{depth} {word()}</title><p>{text}</p>{table if rng.random() < 0.4 else ''}<p>{text}</p>{inner}</sec>"


@pytest.mark.parametrize("seed", range(4))
def test_articles_equal_a_walk_of_the_tree(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(6):
        body = "".join(made(rng) for _ in range(3))
        rows.append((i, f"""<?xml version="1.0"?><pmc-articleset xmlns:m="u"><article><front><journal-meta><journal-title-group><journal-title>J {i}</journal-title></journal-title-group></journal-meta><article-meta>
<title-group><article-title>On <italic>beans</italic> {i}</article-title></title-group><contrib-group><contrib contrib-type="author"><name><surname>A{i}</surname><given-names>B</given-names></name></contrib><contrib contrib-type="editor"><name><surname>E</surname></name></contrib><contrib contrib-type="author"><name><surname>Z</surname></name></contrib></contrib-group>
<abstract><sec><title>Aim</title><p>To see</p></sec><p>more</p></abstract></article-meta></front><body>{body}</body><back><ref-list><ref><m:note>First <b>ref</b></m:note></ref><ref>Second</ref></ref-list></back></article></pmc-articleset>"""))
    for r in xml.articles(spark.createDataFrame(rows, "id int, xml string").repartition(2), "id", "xml").collect():
        tree = ElementTree.fromstring(rows[r["id"]][1])
        body = tree.find(".//body")
        assert r["error"] is None and r["nth"] == 0 and r["body"] == one(walked(body)) and r["has_full_text"]
        secs = list(body.iter("sec"))
        assert [(s["title"], s["text"]) for s in r["sections"]] == [(one(walked(s.find("title"))), one(walked(s, True))) for s in secs]
        assert (r["title"], r["authors"], r["journal"], r["abstract"]) == (f"On beans {r['id']}", [f"B A{r['id']}", "Z"], f"J {r['id']}", "Aim To see more")
        assert r["references"] == ["First ref", "Second"]
        wraps = [t for t in r["tables"] if t["label"]]
        assert len(wraps) == len(list(body.iter("table-wrap"))) and len(r["tables"]) == 2 * len(wraps)
        assert all(t["rows"][0][0] == "a" and t["rows"][1] == ["x in", "1"] for t in wraps)


def test_faults_entities_and_absent_texts(spark):
    rows = [(1, "<article><front><title-group><article-title>A &nbsp;&alpha; B</article-title></title-group></front><body><p>kept</p><p>cut"), (2, None), (3, " "), (4, "no xml"), (5, "<set><article/><article><body>x</body></article></set>"), (6, '<!DOCTYPE a [<!ENTITY e SYSTEM "file:///etc/passwd">]><article><body>&e;y</body></article>')]
    got = {(r["id"], r["nth"]): r for r in xml.articles(spark.createDataFrame(rows, "id int, xml string"), "id", "xml").collect()}
    assert got[1, 0]["title"] == "A α B" and got[1, 0]["error"] and got[1, 0]["body"] == "kept cut"
    assert got[2, None]["error"] is None and got[3, None]["error"] is None and got[4, None]["error"]
    assert got[5, 0]["has_full_text"] is False and got[5, 1]["body"] == "x" and got[6, 0]["body"] == "y"


def test_records_inside_records(spark):
    t = "<r:set xmlns:r='u'><r:record><title>A</title><part><record><title>B &amp; <b>C</b></title><title>D</title></record></part><title> </title><title>E<record><title>F</title></record>G</title></r:record></r:set>"
    got = xml.records(spark.createDataFrame([("k", t), ("l", None)], "id string, x string"), "id", "x", {"titles": "title", "parts": "part"}).orderBy("nth").collect()
    assert [(r["id"], r["nth"], r["titles"], r["parts"]) for r in got] == [("k", 0, ["A", "EG"], []), ("k", 1, ["B & C", "D"], []), ("k", 2, ["F"], [])]
