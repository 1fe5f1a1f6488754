"""Markup flattened to rows: one row per element in document order, with interval encoding, from XML or tag soup.

a is an ancestor of d where a.pre < d.pre and d.pre <= a.last. Mixed content keeps its order: text is what stands before
the first child, tail what stands after the element's end.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

DOM = "pre int, last int, parent int, depth int, pos int, tag string, attrs map<string,string>, text string, tail string"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An element that the second set's tags end when it is still open.
_CLOSES = {"p": frozenset("p div ul ol table h1 h2 h3 h4 h5 h6 article section nav footer header blockquote pre form".split()), "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}


class _Flat:
    """Collects elements as they open and close."""

    def __init__(self):
        self.rows: list[dict] = []
        self.open: list[dict] = []
        self.closed: dict | None = None

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        above = self.open[-1] if self.open else None
        row = {"pre": len(self.rows), "last": len(self.rows), "parent": above["pre"] if above else None, "depth": len(self.open), "pos": above["_n"] if above else 0, "tag": tag, "attrs": attrs, "text": "", "tail": "", "_n": 0}
        if above:
            above["_n"] += 1
        self.rows.append(row)
        self.open.append(row)
        self.closed = None

    def end(self) -> None:
        row = self.open.pop()
        row["last"] = len(self.rows) - 1
        self.closed = row

    def data(self, text: str) -> None:
        if self.closed is not None:
            self.closed["tail"] += text
        elif self.open:
            self.open[-1]["text"] += text

    def done(self) -> list[dict]:
        while self.open:
            self.end()
        return self.rows


class _Soup(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.flat = _Flat()

    def handle_starttag(self, tag, attrs):
        flat = self.flat
        while flat.open and tag in _CLOSES.get(flat.open[-1]["tag"], ()):
            flat.end()
        flat.start(tag, {k: v or "" for k, v in attrs})
        if tag in _VOID:
            flat.end()

    def handle_startendtag(self, tag, attrs):
        self.flat.start(tag, {k: v or "" for k, v in attrs})
        self.flat.end()

    def handle_endtag(self, tag):
        if any(x["tag"] == tag for x in self.flat.open):
            while self.flat.open[-1]["tag"] != tag:
                self.flat.end()
            self.flat.end()

    def handle_data(self, data):
        self.flat.data(data)


def html_rows(text: str) -> list[dict]:
    soup = _Soup()
    soup.feed(text)
    soup.close()
    return soup.flat.done()


def xml_rows(text: str) -> list[dict]:
    """Raises ExpatError for text that isn't well formed. External entities are never read."""
    from xml.parsers import expat

    flat, parser = _Flat(), expat.ParserCreate(namespace_separator="}")
    local = lambda n: n if "}" not in n else ("mml:" if n.startswith("http://www.w3.org/1998/Math/MathML}") else "") + n.rsplit("}", 1)[1]
    parser.buffer_text = True
    parser.StartElementHandler = lambda tag, attrs: flat.start(local(tag), {local(k): v for k, v in attrs.items()})
    parser.EndElementHandler = lambda tag: flat.end()
    parser.CharacterDataHandler = flat.data
    parser.Parse(text, True)
    return flat.done()


def dom(df: DataFrame, id_col: str, text_col: str, kind: str = "html", family: bool = False) -> DataFrame:
    """id and one row per element. Null and empty texts have none; XML that isn't well formed gives one row with tag
    '#error' and the message as text. family: also the parent's tag, null for a root, and the tags of the children in order, as the parser
    knows both. No shuffle; a task holds one document's elements at a time."""
    read, id_type = (html_rows if kind == "html" else xml_rows), df.select(id_col).schema[0].dataType.simpleString()
    names = ["pre", "last", "parent", "depth", "pos", "tag", "attrs", "text", "tail"] + ["parent_tag", "children"] * family
    types = [pa.int32()] * 5 + [pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string()] + [pa.string(), pa.list_(pa.string())] * family

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                try:
                    rows = read(text) if text else []
                except Exception as e:  # the text, not the job, is at fault
                    rows = [{"pre": 0, "last": 0, "parent": None, "depth": 0, "pos": 0, "tag": "#error", "attrs": {}, "text": str(e), "tail": ""}]
                if family:
                    for r in rows:
                        r["children"], r["parent_tag"] = [], None
                    for r in rows:
                        if r["parent"] is not None:
                            r["parent_tag"] = rows[r["parent"]]["tag"]
                            rows[r["parent"]]["children"].append(r["tag"])
                if rows:
                    cols = [pa.array([list(r[n].items()) if n == "attrs" else r[n] for r in rows], t) for n, t in zip(names, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(rows))), *cols], [id_col, *names])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, {DOM}" + ", parent_tag string, children array<string>" * family)
