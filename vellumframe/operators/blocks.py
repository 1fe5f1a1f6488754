"""The block machine: a unit's lines and regions, in reading order, become sections, paragraphs, lists, formulas, references
and floats. Its state runs from item to item, so a unit (a chapter) is one pandas group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from vellumframe.functions.parsers import is_reference_heading

NODE = "node int, parent int, kind string, level int, label string, text string, page int"


class Machine:
    """items: kind (line, region, page), text, page, x0, level of a heading or null, starts (a paragraph may begin),
    list_type and marker of a list item or null, math, region (figure, table, box)."""

    def __init__(self, em: float):
        self.em, self.nodes = em, []
        self.sections: list[tuple[int, int]] = []  # level, node
        self.paragraph: int | None = None
        self.lists: list[dict] = []  # x, type, list node, item node
        self.floats: list[dict] = []
        self.marks: list[str] = []
        self.references: int | None = None  # level of the heading that began them
        self.last: dict | None = None

    def add(self, kind: str, parent: int | None, page: int, text: str = "", level: int | None = None, label: str | None = None) -> int:
        self.nodes.append([len(self.nodes), parent, kind, level, label, text, page])
        return len(self.nodes) - 1

    def home(self) -> int | None:
        return self.sections[-1][1] if self.sections else None

    def close(self) -> None:
        """Ends the open paragraph; floats that waited for its end follow it."""
        self.paragraph = None
        for f in self.floats:
            self.add(f["region"], self.home(), f["page"], f["text"] or "")
        self.floats = []

    def end_lists(self) -> None:
        self.close()
        self.lists = []

    def say(self, node: int, text: str) -> None:
        """Joins text to a node; page marks that wait stand at the break."""
        old = self.nodes[node][5]
        mark = "".join(self.marks)
        self.marks = []
        space = "" if not old or old.endswith(("–", "—", "/")) else " "
        self.nodes[node][5] = old + mark + space + text if old else mark + text

    def heading(self, item: dict) -> None:
        level, text = int(item["level"]), item["text"].strip()
        if self.last and self.last.get("level") == item["level"] and self.last["kind"] == "line" and self.sections and not item["starts"]:
            self.say(self.sections[-1][1], text)  # a heading of several lines
            return
        self.end_lists()
        while self.sections and self.sections[-1][0] >= level:
            self.sections.pop()
        if self.references is not None and level <= self.references:
            self.references = None
        if is_reference_heading(text):
            self.references = level
        node = self.add("ref-list" if self.references == level and is_reference_heading(text) else "sec", self.home(), item["page"], level=level)
        self.say(node, text)
        self.sections.append((level, node))

    def list_item(self, item: dict) -> None:
        self.close()
        x, kind = item["x0"], item["list_type"]
        while self.lists and x < self.lists[-1]["x"] - 0.6 * self.em:
            self.lists.pop()
        same = self.lists[-1] if self.lists and abs(x - self.lists[-1]["x"]) <= 0.6 * self.em else None
        # A single letter may be a numeral where the open list has these.
        if same and same["type"] != kind and not (same["type"].startswith("roman") and kind.startswith("alpha")):
            self.lists.pop()
            same = None
        if same is None:
            parent = self.lists[-1]["item"] if self.lists else self.home()
            same = {"x": x, "type": kind, "list": self.add("list", parent, item["page"], label=kind)}
            self.lists.append(same)
        same["item"] = self.add("list-item", same["list"], item["page"], label=item["marker"])
        self.paragraph = self.add("p", same["item"], item["page"])
        self.say(self.paragraph, item["text"].strip())

    def region(self, item: dict) -> None:
        if self.lists and self.paragraph is not None and item["region"] != "box":
            self.add(item["region"], self.paragraph, item["page"], item["text"] or "")
        elif self.paragraph is not None and item["region"] != "box":
            self.floats.append(item)
        else:
            self.end_lists()
            self.add("boxed-text" if item["region"] == "box" else item["region"], self.home(), item["page"], item["text"] or "")

    def take(self, item: dict) -> None:
        if item["kind"] == "page":
            self.marks.append(f"[[{item['text']}]]")
            return
        if item["kind"] == "region":
            self.region(item)
        elif item["level"] is not None:
            self.heading(item)
        elif self.references is not None:
            if item["starts"] or self.paragraph is None:
                self.close()
                self.paragraph = self.add("ref", self.home(), item["page"])
            self.say(self.paragraph, item["text"].strip())
        elif item["math"]:
            self.close()
            self.add("disp-formula", self.home(), item["page"], item["text"].strip())
        elif item["list_type"]:
            self.list_item(item)
        elif self.lists and self.paragraph is not None and item["x0"] > self.lists[-1]["x"] + 0.3 * self.em:
            self.say(self.paragraph, item["text"].strip())
        elif item["starts"] or self.paragraph is None or self.lists:
            self.end_lists()
            self.paragraph = self.add("p", self.home(), item["page"])
            self.say(self.paragraph, item["text"].strip())
        else:
            self.say(self.paragraph, item["text"].strip())
        self.last = item

    def done(self) -> list[list]:
        """Marks that are left stand at the end of the last paragraph."""
        self.end_lists()
        last = next((n for n in reversed(self.nodes) if n[2] == "p"), None)
        if self.marks and last:
            last[5] += "".join(self.marks)
        return self.nodes


def blocks(items: list[dict], em: float) -> list[list]:
    machine = Machine(em)
    for item in items:
        machine.take(item)
    return machine.done()


def parse(items: DataFrame, em: float) -> DataFrame:
    """book_id, unit and nodes of each unit: items (book_id, unit, ord, kind, text, page, x0, level, starts, list_type, marker,
    math, region). A unit that fails gives its lines as paragraphs and a node of kind #UNIT_FAILED with the message."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord")
        records = group.astype(object).where(group.notna(), None).to_dict("records")
        try:
            nodes = blocks(records, em)
        except Exception as e:  # one unit, not the job
            nodes = [[0, None, "#UNIT_FAILED", None, None, str(e), 0]] + [[i + 1, None, "p", None, None, r["text"], r["page"]] for i, r in enumerate(r for r in records if r["kind"] == "line")]
        out = pd.DataFrame(nodes, columns=["node", "parent", "kind", "level", "label", "text", "page"]).astype({"parent": "Int64", "level": "Int64"})
        out.insert(0, "unit", group["unit"].iloc[0])
        out.insert(0, "book_id", group["book_id"].iloc[0])
        return out

    columns = ["book_id", "unit", "ord", "kind", "text", "page", "x0", "level", "starts", "list_type", "marker", "math", "region"]
    return items.select(*columns).groupBy("book_id", "unit").applyInPandas(run, f"book_id string, unit int, {NODE}")
