"""The text lines of an HTML page in page order, each with its place in the page's structure.

A tolerant reader: unclosed elements end where their parents do or where HTML implies it, stray end tags are passed over,
unended comments, scripts and tags reach to the end. A line is the text of one block, references decoded, white space
turned into one blank; scripts, styles, titles and comments give none.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from typing import NamedTuple

_START = re.compile(r"""<([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")

RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
    "noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul".split()
)
ENDS_P = BLOCKS - {"body", "caption", "dd", "dt", "head", "html", "li", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr", "noscript", "template", "select", "legend"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A start tag ends these open elements, if they are open above one of those.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    **{k: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}) for k in ("thead", "tbody", "tfoot")}, **{k: (HEADINGS, BLOCKS - HEADINGS) for k in HEADINGS},
}

#: What stands round an article, by element, role, and words in class names and ids.
AROUND = {"nav", "aside", "footer", "dialog", "menu", "noscript", "template", "svg", "head"}
AROUND_WEAK = {"header", "form", "fieldset", "button", "select", "object", "audio", "video", "canvas", "search"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "tooltip", "status", "tablist"}
COMMENTS = {"comment", "comments", "commentlist", "commentary", "disqus", "discussion", "replies", "reply", "respond"}
NAMES = {
    "ad", "ads", "adbox", "adslot", "adsense", "adunit", "advert", "adverts", "advertisement", "advertising", "alert", "aside", "banner", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "footer", "gdpr", "login",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager", "paging", "pagination", "popup", "promo", "promotion", "recommended", "related", "share",
    "sharing", "sidebar", "signup", "skyscraper", "social", "sponsor", "sponsored", "subscribe", "subscription", "teaser", "toolbar", "topbar", "widget",
}
#: A name that begins with one of these tells of a state, not of what the element is.
STATES = {"has", "is", "no", "with", "without", "js", "not", "show", "hide", "enable", "enabled"}


class Place(NamedTuple):
    """Where text stands: round an article by strong or weak signs; in main (1) or an article (2); its path, as a checksum; the block's
    name; the number of the outermost article element on the page, from 1; whether in a link."""

    strong: bool = False
    weak: bool = False
    region: int = 0
    slot: int = 0
    block: str = ""
    part: int = 0
    link: bool = False


class Line(NamedTuple):
    text: str
    place: Place
    linked: bool = False  # all of it stands in links


def _signs(attributes: str) -> tuple[str, str, bool, bool, bool]:
    """role, class names for the path, and whether names speak of comments, of something round an article, and of hiding."""
    found = {}
    for k, a, b, c in _ATTRIBUTE.findall(attributes):
        found.setdefault(k.lower(), html.unescape(a or b or c))
    names = found.get("class", "").split()
    comments = around = False
    for name in (*names, *found.get("id", "").split()):
        words = [w.lower() for w in _NAME_PART.findall(name)]
        if words and words[0] not in STATES:
            comments |= not COMMENTS.isdisjoint(words)
            around |= not NAMES.isdisjoint(words)
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    return found.get("role", "").lower(), " ".join(sorted(_DIGITS.sub("0", n) for n in names)), comments, around, hidden


def _enter(name: str, attributes: str, up: Place) -> Place:
    role, names, comments, around, hidden = _signs(attributes) if attributes.strip(" \t\r\n\f/") else ("", "", False, False, False)
    slot = zlib.crc32(f">{name}.{names}".encode(errors="replace"), up.slot)
    block = name if name in BLOCKS else up.block
    if name == "article" or role == "article":
        if up.strong or comments or hidden:
            return Place(True, up.weak, up.region, slot, block, up.part, up.link)
        return Place(False, up.region == 2 and up.weak, 2, slot, block, up.part, up.link)
    if name == "main" or role == "main":
        return Place(up.strong or hidden, up.region > 0 and up.weak, max(up.region, 1), slot, block, up.part, up.link)
    if name in ("html", "body"):
        return Place(up.strong, up.weak, up.region, slot, block, up.part, up.link)
    strong = up.strong or name in AROUND or comments or hidden or role in ROLES
    weak = up.weak or around or (name in AROUND_WEAK and not (name == "header" and up.region))
    return Place(strong, weak, up.region, slot, block, up.part, up.link or (name == "a" and "href" in attributes.lower()))


class _Reader:
    def __init__(self):
        self.lines: list[Line] = []
        self.stack: list[tuple[str, Place]] = []
        self.open: Counter[str] = Counter()
        self.now = Place()
        self.parts: list[str] = []
        self.at: Place | None = None
        self.linked = True
        self.articles = 0

    def text(self, raw: str) -> None:
        if not raw:
            return
        text, now = (html.unescape(raw) if "&" in raw else raw), self.now
        off = now.strong or now.weak
        if self.at is not None and off != (self.at.strong or self.at.weak) and not text.isspace():
            if off:  # an aside within a line does not end it
                if text := " ".join(text.split()):
                    self.lines.append(Line(text, now, now.link))
                return
            self.flush()
        if self.at is None and not text.isspace():
            self.at = now
        if not now.link and self.linked and not text.isspace():
            self.linked = False
        self.parts.append(text)

    def flush(self) -> None:
        if self.at is not None:
            self.lines.append(Line(" ".join("".join(self.parts).split()), self.at, self.linked))
        self.parts, self.at, self.linked = [], None, True

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            name, self.now = self.stack.pop()
            self.open[name] -= 1

    def close_above(self, names: set[str], bounds: set[str]) -> None:
        if not any(self.open[n] for n in names):
            return
        depth = None
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in bounds:
                break
            if self.stack[i][0] in names:
                depth = i
        if depth is not None:
            self.pop_to(depth)

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.parts.append(" ")
            return
        if name in BLOCKS:
            self.flush()
        if name in ENDS_P and self.open["p"]:
            self.close_above({"p"}, {"table", "td", "th", "button", "caption", "object"})
        if name in IMPLIED:
            self.close_above(*IMPLIED[name])
        if name == "body":
            self.close_above({"head"}, set())
        if name not in VOID:
            up = self.now
            self.stack.append((name, up))
            self.open[name] += 1
            self.now = _enter(name, attributes, up)
            if self.now.region == 2 and up.region < 2:
                self.articles += 1
                self.now = self.now._replace(part=self.articles)

    def end(self, name: str) -> None:
        if name in BLOCKS or name == "br":
            self.flush()
        if name in ("html", "body") or not self.open[name]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                self.pop_to(i)
                return
            if name not in BLOCKS and self.stack[i][0] in BLOCKS:
                return


def lines(page: str) -> list[Line]:
    """All lines of a page, those round its article included."""
    r, at, n = _Reader(), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            r.text(page[at:])
            break
        nxt = page[lt + 1 : lt + 2]
        tag = _START.match(page, lt) if nxt.isascii() and nxt.isalpha() else None
        if not tag and nxt not in ("/", "!", "?") and not (nxt.isascii() and nxt.isalpha()):
            r.text(page[at : lt + 1])  # a plain sign
            at = lt + 1
            continue
        r.text(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            at = n if end < 0 else end + 3
        elif tag:
            name = tag[1].lower()
            at = tag.end()
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                gt = page.find(">", end.end()) if end else -1
                at = n if gt < 0 else gt + 1
            else:
                r.start(name, tag[2])
        else:  # an end tag, a declaration, or a start tag that the page ends in
            gt = page.find(">", lt)
            if nxt == "/" and gt >= 0 and page[lt + 2 : lt + 3].isalpha():
                r.end(re.split(r"[\s/]", page[lt + 2 : gt], maxsplit=1)[0].lower())
            at = n if gt < 0 or nxt not in ("/", "!", "?") else gt + 1
    r.flush()
    return r.lines
