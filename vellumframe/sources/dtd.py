"""Document type definitions as rule tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_COMMENT = re.compile(r"<!--.*?-->", re.S)
_ENTITY = re.compile(r"<!ENTITY\s+%\s+([\w.:-]+)\s+(?:\"([^\"]*)\"|'([^']*)')\s*>", re.S)
_ELEMENT = re.compile(r"<!ELEMENT\s+([\w.:-]+)\s+(.*?)>", re.S)
_ATTLIST = re.compile(r"<!ATTLIST\s+([\w.:-]+)\s+(.*?)>", re.S)
_ATTRIBUTE = re.compile(r"([\w.:-]+)\s+(\([^)]*\)|[A-Z]+(?:\s*\([^)]*\))?)\s+(#REQUIRED|#IMPLIED|(?:#FIXED\s+)?(?:\"[^\"]*\"|'[^']*'))", re.S)


def parse(text: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Elements (name, content, mixed), children (parent, child) and attributes (element, name, type, required). Parameter
    entities are put in; of two definitions of one the first counts."""
    text = _COMMENT.sub(" ", text)
    entities: dict[str, str] = {}
    for m in _ENTITY.finditer(text):
        entities.setdefault(m[1], m[2] if m[2] is not None else m[3])
    text = _ENTITY.sub(" ", text)
    for _ in range(20):
        put = re.sub(r"%([\w.:-]+);", lambda m: entities.get(m[1], " "), text)
        if put == text:
            break
        text = put
    elements, children, attributes = [], [], []
    for m in _ELEMENT.finditer(text):
        content = " ".join(m[2].split())
        elements.append((m[1], content, "#PCDATA" in content))
        names = [] if content in ("EMPTY", "ANY") else re.findall(r"[\w:][\w.:-]*", content.replace("#PCDATA", ""))
        children += [(m[1], c) for c in dict.fromkeys(names)]
    for m in _ATTLIST.finditer(text):
        attributes += [(m[1], a[1], " ".join(a[2].split()), a[3] == "#REQUIRED") for a in _ATTRIBUTE.finditer(m[2])]
    return elements, children, attributes


def tables(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    elements, children, attributes = parse(text)
    return (
        spark.createDataFrame(elements, "element string, content string, mixed boolean"),
        spark.createDataFrame(children, "parent string, child string"),
        spark.createDataFrame(attributes, "element string, attribute string, type string, required boolean"),
    )


def missing_attributes(dom: DataFrame, doc: str, attributes: DataFrame) -> DataFrame:
    """doc, pre, tag, attribute: required attributes that an element lacks."""
    from pyspark.sql import functions as F

    rules = attributes.where("required").select(F.col("element").alias("_e"), "attribute")
    met = dom.select(doc, "pre", "tag", "attrs").join(rules, F.col("tag") == F.col("_e"))
    return met.where(F.element_at("attrs", F.col("attribute")).isNull()).select(doc, "pre", "tag", "attribute")
