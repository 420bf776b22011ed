import random

import pytest

from tessella.llm import page_differencing as diff
from tessella.llm.html_lines import lines

SCHEMA = "page_id long, url string, html string"
PAGES = {
    # the given table's form: script with a tag in a string, unclosed b and p, references in attributes and text
    "article": ('<!DOCTYPE html><html><head><title>T&amp;</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad 0 --><div class="ad">Buy</div>'
                "<article><h1>Head &amp; tail&am</h1><p><b>One<br><p>Two &lt;b&gt; &#233;&nbsp;&eacute;  x\n\ty</p></article><footer>&copy; f</footer></body></html>", "Head & tail&am\nOne\nTwo <b> é é x y"),
    "no_ends": ("<body><header>Site</header><article><p>A<p>B<ul><li>C<li>D</ul><table><tr><td>E<td>F<tr><td>G</table><div class='share-bar'>Share</div><h2>H", "A\nB\nC\nD\nE\nF\nG\nH"),
    "inside": ('<article><header><h1>T</h1></header><p>Text <span class="ad-slot">ad</span>goes <i>o</i>n</p><aside>Side</aside><form><input>Send</form><section id="comments"><article class="comment">No</article></section><p>End</p><footer>By</footer></article>', "T\nText goes on\nEnd"),
    "main": ('<body class="has-sidebar"><div id="sidebar">S</div><div role="navigation">N</div><main><h1>Head</h1><div><p>One</p>two<p>three</main><div class="cookie-notice">Cookies</div>', "Head\nOne\ntwo\nthree"),
    "wrapped": ('<form id="aspnet"><div class="page widget-area"><main><article role="article"><p>In a form</p></article></main></div></form>', "In a form"),
    "plain": ("just text, 1 < 2 <3 and a<b>c</b> &notit; <!-- gone --> end <br>line", "just text, 1 < 2 <3 and ac ¬it; end line"),
    "hidden": ('<div hidden>no</div><div style="display: none">no</div><p>yes</p><p aria-hidden="true">no</p><noscript>js</noscript><svg><text>no</text></svg><select><option>a<option>b</select>', "yes"),
    "attributes": ("<p title='a > b' data-x=\"</p>\">one</p><p class=\"x\"title=\"y>\" >two</p><P ID=q>three</P ><div\nclass=ad\n>no</div>", "one\ntwo\nthree"),
    "scripts": ("<p>a</p><SCRIPT>x</script ><p>b<textarea><p>no</textarea></p><script>if (a</b) <p>never ended", "a\nb"),
    "stray": ("</div></p></article><p>a</b></i></p></li><p>b", "a\nb"),
    "open_comment": ("<p>a</p><!--><p>b</p><!-- open <p>c</p>", "a\nb"),
    "open_tag": ("<p>a</p><p class='x", "a"),
    "teaser": ('<aside><article>Other</article></aside><article><p>Own</p></article><div class="related"><article><p>Second</p></article></div>', "Own\nSecond"),
    "empty": ("", ""), "blank": (" \n ", ""), "marks": ("<nav>x</nav>", ""),
}


def kept(page):
    found = lines(page)
    return "\n".join(x.text for x, w in zip(found, diff._wanted(found)) if w)


@pytest.mark.parametrize("name", sorted(PAGES))
def test_lines_of_pages(name):
    assert kept(PAGES[name][0]) == PAGES[name][1]


def table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t


@pytest.mark.parametrize("bits", [1 << 28, 40])
def test_alignment_is_a_longest_one(bits, monkeypatch):
    monkeypatch.setattr(diff, "MOST_BITS", bits)
    rng = random.Random(4)
    for n in range(300):
        k = rng.choice([2, 5, 40])
        a, b = ([rng.randrange(k) for _ in range(rng.randrange(40))] for _ in range(2))
        at = diff.shared(a, b)
        assert at == sorted(set(at)) and len(at) == table(a, b)[-1][-1]
        it = iter(b)
        assert all(any(a[i] == y for y in it) for i in at)


def soup(host, path, body, menu="Home|About|Contact"):
    items = "".join(f"<div class=m>{x}</div>" for x in menu.split("|"))
    return f"https://{host}/{path}", f"<html><body><div>{items}</div><div class=c>{''.join(f'<p>{x}</p>' for x in body)}</div><div>All rights reserved</div></body></html>"


def test_lines_that_near_pages_share_go(spark):
    rng = random.Random(6)
    words = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(6))
    bodies = {f"{k}/{i}": [words() for _ in range(3)] for k in ("news", "blog") for i in range(9)}
    bodies["news/4"] = bodies["blog/2"]  # a copied text far away by URL
    pages = [(p, *soup("a.example", p, b)) for p, b in bodies.items()]
    pages += [("one", *soup("single.example", "x", ["Only page"], "Start")), ("null", None, soup("a.example", "z", ["No url"])[1]), ("nohost", "mailto:x", soup("a.example", "z", ["No host"])[1])]
    pages += [("same1", *soup("b.example", "x", ["Same"])), ("same2", soup("b.example", "y", [])[0], soup("b.example", "x", ["Same"])[1])]
    rows = [(i, u, h) for i, (_, u, h) in enumerate(pages)] + [(0, *pages[0][1:]), (900, "https://a.example/none", None), (901, None, None)]
    df = diff.extract(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = {(r["page_id"]): r for r in df.collect()}
    assert df.count() == len(rows) and df.filter("page_id = 0").count() == 2
    for i, (name, _, _) in enumerate(pages):
        if name in bodies:
            assert got[i]["text"].split("\n") == bodies[name] and got[i]["n_shared"] == 4
    n = len(bodies)
    whole = lambda menu, text: "\n".join([*menu.split("|"), text, "All rights reserved"])
    assert got[n]["text"] == whole("Start", "Only page") and got[n + 1]["text"] == whole("Home|About|Contact", "No url") and got[n + 2]["text"] == whole("Home|About|Contact", "No host")
    assert got[n + 3]["text"] == got[n + 4]["text"] == whole("Home|About|Contact", "Same")  # equal sources say nothing
    assert got[900]["text"] == got[901]["text"] == "" and got[900]["n_chars"] == 0
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    """Against a plain version that walks the whole order of one hot host."""
    rng = random.Random(8)
    pages = []
    for i in range(70):
        host = "hot.example" if rng.random() < 0.7 else f"h{rng.randrange(5)}.example"
        body = [rng.choice(["common", f"own {i}", f"part {rng.randrange(6)}"]) for _ in range(rng.randrange(4))]
        pages.append((i, *soup(host, f"{rng.choice('abc')}/{rng.randrange(40)}", body, "|".join(rng.sample(["A", "B", "C", "D"], 3)))))
    df = spark.createDataFrame(pages, SCHEMA).repartition(6)
    monkeypatch.setattr(diff, "PAGES_A_BLOCK", 5)
    got = {r["page_id"]: (r["text"], r["n_shared"]) for r in diff.extract(df).collect()}
    ids = {r["page_id"]: (r["id1"], r["id2"]) for r in diff._identified(df).collect()}
    order = {}
    for i, url, page in pages:
        host, path = url[8:].split("/", 1)
        order.setdefault((host, "/" + path, url, *ids[i]), (i, page))
    places = sorted(order)
    for at, key in enumerate(places):
        near = [k for k in places[max(0, at - 2) : at + 3] if k[0] == key[0] and k != key and order[k][1] != order[key][1]]
        found = lines(order[key][1])
        keys, votes = list(map(diff._key, found)), [0] * len(found)
        for k in near:
            other, t = list(map(diff._key, lines(order[k][1]))), diff.shared
            for j in t(keys, other):
                votes[j] += 1
        gone = [bool(v) and 2 * v >= len(near) for v in votes]
        want = ("\n".join(x.text for x, g in zip(found, gone) if not g), sum(gone))
        for i, url, page in pages:
            if ids[i] == key[3:]:
                assert got[i] == want


def test_empty_table_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], SCHEMA)
    assert diff.extract(none).count() == 0
    one = spark.createDataFrame([(None, "http://h/x", PAGES["article"][0])], SCHEMA).withColumns({n: F.lit(1) for n in ("lines", "wanted", "gone", "text", "id1", "source", "host", "place")})
    assert diff.extract(one).first()["text"] == PAGES["article"][1]


def story(host, path, words, teaser="Latest news and a line of it", menu="Home"):
    article = f'<article><h1>{words[0]}</h1><div><a href="/all">All stories</a></div><p>{words[1]}</p><p>A passage that all stories have</p><h2><a href="#how">How</a></h2><p>By <a href="/x">X</a></p><p>{words[2]}</p></article>'
    return f"https://{host}/{path}", f"<html><body><nav>{menu}</nav>{article}<div><article><h3>More</h3><p>{teaser}</p></article></div><footer>f</footer></body></html>"


def test_near_pages_decide_lines_in_article_elements(spark):
    rng = random.Random(9)
    words = lambda: [" ".join(str(rng.randrange(10**6)) for _ in range(12)) for _ in range(3)]
    own, copied = [words() for _ in range(8)], words()
    pages = [story("a.example", i, w) for i, w in enumerate(own)]
    pages += [story("copies.example", i, copied, menu=f"Menu {i}") for i in range(6)]
    pages += [story("two.example", i, own[i]) for i in range(2)] + [story("rare.example", i, own[i], f"Teaser {i}") for i in range(6)]
    rows = [(i, *p) for i, p in enumerate(pages)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [r["text"].split("\n") for r in diff.extract(table).orderBy("page_id").collect()]
    text = lambda w, link=True, teaser=None: [w[0], *["All stories"] * link, w[1], "A passage that all stories have", "How", "By X", w[2], *(["More", teaser] if teaser else [])]
    same = "Latest news and a line of it"
    assert got[:8] == [text(w, False) for w in own]
    assert got[8:14] == [text(copied, True, same)] * 6  # copies of an article say nothing of it
    assert got[14:16] == [text(own[i], True, same) for i in range(2)]  # one near page is not enough
    assert got[16:] == [text(own[i], False, f"Teaser {i}") for i in range(6)]


def test_links_and_article_elements_of_lines():
    page = '<main><article><p><a href="/x">All <b>of</b> it</a> <a href="/y">linked</a></p><p>Not <a href="/x">all</a></p><p><a name="x">No link</a></p></article><p>Between<article><p>Two<article><p>Within</article></article></main>'
    assert [(x.text, x.linked, x.place.part) for x in lines(page)] == [("All of it linked", True, 1), ("Not all", False, 1), ("No link", False, 1), ("Between", False, 0), ("Two", False, 2), ("Within", False, 2)]
