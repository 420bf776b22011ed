"""XML texts read as streams of events over Arrow batches: nested records, and articles with sections, references and tables.

Elements count by their local names. Named characters that only a DTD would define are those of HTML. Text that isn't well formed
gives what stands before the fault, and the fault's name.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame


class Reader:
    """Calls start(name, attributes), end(name) and text(characters) of a handler in the order of the document."""

    def __init__(self, handler):
        self.handler = handler

    def read(self, xml: str) -> str | None:
        """The name of the fault that ended the reading, if any."""
        h = self.handler
        local = lambda name: name.rpartition(":")[2]
        p = expat.ParserCreate()
        p.UseForeignDTD(True)
        p.StartElementHandler = lambda name, attributes: h.start(local(name), attributes)
        p.EndElementHandler = lambda name: h.end(local(name))
        p.CharacterDataHandler = h.text
        p.ExternalEntityRefHandler = lambda *_: 1  # nothing outside of the text is read
        p.SkippedEntityHandler = lambda name, is_parameter: None if is_parameter else h.text(html.unescape(f"&{name};"))
        try:
            p.Parse(xml.encode("utf-8", "replace"), False)
            p.Parse(b"", True)
        except expat.ExpatError as e:
            return expat.ErrorString(e.code)
        return None


def _one(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


class Records:
    """The texts of named fields, by the innermost record that they stand in; records in the order in which they begin."""

    def __init__(self, fields: dict[str, str], record: str):
        self.names = {e: name for name, e in fields.items()}
        self.record = record
        self.rows: list[dict[str, list[str]]] = []
        self.open: list[dict[str, list[str]]] = []
        self.fields: list[tuple[str, int, list[str]]] = []

    def start(self, name: str, attributes: dict) -> None:
        if name == self.record:
            self.rows.append({n: [] for n in self.names.values()})
            self.open.append(self.rows[-1])
        elif name in self.names and self.open:
            self.fields.append((name, len(self.open), []))

    def text(self, characters: str) -> None:
        for _, depth, parts in self.fields:
            if depth == len(self.open):  # a record within a field is no text of that field
                parts.append(characters)

    def end(self, name: str) -> None:
        if name == self.record and self.open:
            self.open.pop()
        elif self.fields and self.fields[-1][0] == name and self.fields[-1][1] == len(self.open):
            _, _, parts = self.fields.pop()
            if found := _one(parts):
                self.open[-1][self.names[name]].append(found)


def records(rows: DataFrame, key: str, xml: str, fields: dict[str, str], record: str = "record") -> DataFrame:
    """key, nth, and a list for each of fields (name: element), for each record element, those inside others included."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, nth, found = [], [], []
            for i, t in enumerate(batch.column("xml").to_pylist()):
                r = Records(fields, record)
                Reader(r).read(t or "")
                at += [i] * len(r.rows)
                nth += range(len(r.rows))
                found += r.rows
            lists = [pa.array([f[name] for f in found], pa.list_(pa.string())) for name in fields]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), pa.array(nth, pa.int32()), *lists], names=["key", "nth", *fields])

    d = rows.selectExpr(f"`{key}` AS key", f"`{xml}` AS xml").mapInArrow(run, f"key {kind}, nth int, " + ", ".join(f"`{n}` array<string>" for n in fields))
    return d.withColumnRenamed("key", key)


#: Parts between which a blank stands where their texts meet.
APART = {"p", "title", "sec", "td", "th", "tr", "label", "caption", "list-item", "abstract", "body", "ref", "table", "table-wrap", "break", "disp-formula", "def", "term", "boxed-text", "disp-quote", "fig"}
ARTICLE = (
    "title string, authors array<string>, journal string, abstract string, has_full_text boolean, body string, sections array<struct<level:int,title:string,text:string>>, "
    "references array<string>, tables array<struct<label:string,caption:string,rows:array<array<string>>>>"
)


class Articles:
    """Title, authors, journal, abstract, body, sections, references and tables of each article element."""

    def __init__(self):
        self.rows: list[dict] = []
        self.path: list[str] = []
        self.into: list[tuple[int, list[str]]] = []  # what gathers text, and from what depth on
        self.sections: list[dict] = []
        self.tables: list[dict] = []
        self.now: dict | None = None
        self.names: dict[str, str] | None = None
        self.heading = 0  # the depth of the section title that is open

    def gather(self) -> list[str]:
        parts: list[str] = []
        self.into.append((len(self.path), parts))
        return parts

    def start(self, name: str, attributes: dict) -> None:
        up = self.path[-1] if self.path else ""
        self.path.append(name)
        if name in APART:
            self.text(" ")
        if name == "article" and "article" not in self.path[:-1]:
            self.now = {"title": None, "authors": [], "journal": None, "abstract": None, "has_full_text": False, "body": None, "sections": [], "references": [], "tables": []}
            self.rows.append(self.now)
            return
        if self.now is None:
            return
        front = "front" in self.path
        if name == "article-title" and front and up == "title-group" and self.now["title"] is None:
            self.now["title"] = self.gather()
        elif name == "journal-title" and front and self.now["journal"] is None:
            self.now["journal"] = self.gather()
        elif name == "abstract" and front and self.now["abstract"] is None:
            self.now["abstract"] = self.gather()
        elif name == "contrib" and front:
            self.names = {} if attributes.get("contrib-type") == "author" else None
        elif name in ("surname", "given-names") and self.names is not None and name not in self.names:
            self.names[name] = self.gather()
        elif name == "body" and self.now["body"] is None:
            self.now["has_full_text"], self.now["body"] = True, self.gather()
        elif name == "sec" and "body" in self.path:
            self.sections.append({"level": len(self.sections) + 1, "title": "", "text": []})
            self.now["sections"].append(self.sections[-1])
        elif name == "title" and up == "sec" and self.sections:
            self.sections[-1]["title"], self.heading = self.gather(), len(self.path)
        elif name == "ref":
            self.now["references"].append(self.gather())
        elif name == "table-wrap" or (name == "table" and not (self.tables and self.tables[-1]["wrap"] and not self.tables[-1]["in_table"])):
            self.tables.append({"label": "", "caption": "", "rows": [], "wrap": name == "table-wrap", "in_table": name == "table"})
            self.now["tables"].append(self.tables[-1])
        elif name == "table":
            self.tables[-1]["in_table"] = True
        elif self.tables and name in ("label", "caption") and not self.tables[-1]["in_table"]:
            self.tables[-1][name] = self.gather()
        elif self.tables and name == "tr":
            self.tables[-1]["rows"].append([])
        elif self.tables and name in ("td", "th") and self.tables[-1]["rows"]:
            self.tables[-1]["rows"][-1].append(self.gather())

    def text(self, characters: str) -> None:
        for _, parts in self.into:
            parts.append(characters)
        if self.sections and not self.heading:
            self.sections[-1]["text"].append(characters)

    def end(self, name: str) -> None:
        depth = len(self.path)
        while self.into and self.into[-1][0] >= depth:
            self.into.pop()
        if depth == self.heading:
            self.heading = 0
        if name in APART:
            self.text(" ")
        self.path.pop()
        if self.now is None:
            return
        if name == "contrib" and self.names is not None:
            if surname := _one(self.names.get("surname", [])):
                self.now["authors"].append(f"{_one(self.names.get('given-names', []))} {surname}".strip())
            self.names = None
        elif name == "sec" and self.sections:
            self.sections.pop()
        elif self.tables and name == ("table-wrap" if self.tables[-1]["wrap"] else "table"):
            self.tables.pop()
        elif name == "article" and "article" not in self.path:
            self.now, self.sections, self.tables, self.into = None, [], [], []

    def finished(self) -> list[dict]:
        text = lambda x: _one(x) if isinstance(x, list) else x
        out = []
        for r in self.rows:
            done = r | {k: text(r[k]) for k in ("title", "journal", "abstract", "body")} | {"references": [text(x) for x in r["references"]]}
            done["sections"] = [{"level": s["level"], "title": text(s["title"]), "text": text(s["text"])} for s in r["sections"]]
            done["tables"] = [{"label": text(t["label"]), "caption": text(t["caption"]), "rows": [[text(c) for c in row] for row in t["rows"]]} for t in r["tables"]]
            out.append(done)
        return out


def articles(rows: DataFrame, key: str, xml: str) -> DataFrame:
    """key, nth, ARTICLE and error of each article element of the texts; a text without one gives a row without a number, with its fault if any.

    A section's text is its own, without its title and the sections inside it; a table inside a cell is a table of its own, and text
    of the cell too. Nothing is cut.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("xml").to_pylist()):
                a = Articles()
                error = Reader(a).read(t) if t and t.strip() else None
                done = a.finished()
                found += [{"key": k, "nth": i, "error": error} | r for i, r in enumerate(done)] if done else [{"key": k, "error": error}]
            yield pa.RecordBatch.from_pylist(found, schema)

    text, texts = pa.string(), pa.list_(pa.string())
    section = pa.list_(pa.struct([("level", pa.int32()), ("title", text), ("text", text)]))
    table = pa.list_(pa.struct([("label", text), ("caption", text), ("rows", pa.list_(texts))]))
    key_kind = {"int": pa.int32(), "bigint": pa.int64(), "string": text}[kind]
    schema = pa.schema([("key", key_kind), ("nth", pa.int32()), ("error", text), ("title", text), ("authors", texts), ("journal", text), ("abstract", text), ("has_full_text", pa.bool_()), ("body", text), ("sections", section), ("references", texts), ("tables", table)])
    d = rows.selectExpr(f"`{key}` AS key", f"`{xml}` AS xml").mapInArrow(run, f"key {kind}, nth int, error string, {ARTICLE}")
    return d.withColumnRenamed("key", key)
