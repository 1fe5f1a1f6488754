"""Markup as HTML for reading, by mapping elements; made from dom rows in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumframe.sources.xml_out import serialize

#: HTML elements for those of the markup; others are divisions with the element's name as class.
TAGS = {"p": "p", "title": "h2", "bold": "b", "italic": "i", "sup": "sup", "sub": "sub", "list": "ul", "list-item": "li", "table": "table", "tr": "tr", "td": "td", "th": "th", "thead": "thead", "tbody": "tbody", "sec": "section", "xref": "a", "fig": "figure", "caption": "figcaption"}
INLINE = ["target", "named-content", "ext-link", "sc", "monospace", "underline", "label"]


def html(dom: DataFrame, doc: str) -> DataFrame:
    """doc, html. References become links, ids stay."""
    tag = F.col("tag")
    known = F.element_at(F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv]), tag)
    name = F.when(known.isNotNull(), known).when(tag.isin(*INLINE), "span").otherwise("div")
    one = lambda key, value: F.when(value.isNotNull(), F.create_map(F.lit(key), value)).otherwise(F.create_map().cast("map<string,string>"))
    attrs = F.map_concat(one("id", F.element_at("attrs", "id")), one("href", F.concat(F.lit("#"), F.when(tag == "xref", F.element_at("attrs", "rid")))), one("class", F.when(known.isNull(), tag)))
    rows = dom.withColumns({"attrs": attrs, "tag": name})
    made = serialize(rows, doc)
    body = F.regexp_replace("xml", r"^<\?xml[^\n]*\n", "")
    return made.select(doc, F.concat(F.lit("<!DOCTYPE html><html><body>"), body, F.lit("</body></html>")).alias("html"))
