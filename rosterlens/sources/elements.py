"""Pages to element rows.

Each page is tokenised once, inside ``mapInArrow``; everything after that is DataFrame work.
A row holds an element's tag, classes, attributes, the text below it, and its ancestors.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements without an end tag, and elements whose text is not page text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style"}
# An element that starts ends these open ones, up to the given boundary.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

SCHEMA = (
    "page_id bigint, url string, ord int, tag string, id string, classes array<string>, attrs map<string,string>, "
    "cell int, text string, lineage array<struct<ord:int,mark:string>>"
)
ARROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("ord", pa.int32()), ("tag", pa.string()), ("id", pa.string()), ("classes", pa.list_(pa.string())),
    ("attrs", pa.map_(pa.string(), pa.string())), ("cell", pa.int32()), ("text", pa.string()),
    ("lineage", pa.list_(pa.struct([("ord", pa.int32()), ("mark", pa.string())]))),
])
ROWS_PER_BATCH = 4000
LETTERS_PER_BATCH = 4_000_000


class _Elements(HTMLParser):
    """Collects element rows in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        ended, boundary = ENDS.get(tag, ((), ()))
        while ended and self.open and self.open[-1]["tag"] not in boundary and any(
            e["tag"] in ended for e in self._above(boundary)
        ):
            self.open.pop()
        values = {k: v or "" for k, v in attrs}
        classes = values.get("class", "").split()
        parent = self.open[-1] if self.open else None
        cell = None
        if tag in ("td", "th") and parent:
            cell = parent["cells"]
            parent["cells"] += 1
        row = {
            "ord": len(self.rows), "tag": tag, "id": values.get("id"), "classes": classes, "attrs": values, "cell": cell,
            "text": [], "lineage": [(e["ord"], e["mark"]) for e in self.open], "cells": 0,
            "mark": " ".join(["", tag, *[f".{c}" for c in classes], *([f"#{values['id']}"] if values.get("id") else []), ""]),
        }
        self.rows.append(row)
        if tag not in VOID:
            self.open.append(row)

    def _above(self, boundary):
        for e in reversed(self.open):
            if e["tag"] in boundary:
                return
            yield e

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open and self.open[-1] is self.rows[-1]:
            self.open.pop()

    def handle_endtag(self, tag):
        if any(e["tag"] == tag for e in self.open):
            while self.open.pop()["tag"] != tag:
                pass

    def handle_data(self, data):
        inner = self.open[-1:] if self.open and self.open[-1]["tag"] in RAW else self.open
        for e in inner:
            e["text"].append(data)


def tokenise(html: str) -> list[dict]:
    parser = _Elements()
    parser.feed(html)
    parser.close()
    for row in parser.rows:
        row["text"] = "".join(row["text"]).strip()
    return parser.rows


def _to_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages become Python texts one at a time, and rows go out in blocks bounded by their number and their letters."""
    out: list[dict] = []
    size = 0
    for batch in batches:
        columns = [batch.column(c) for c in ("page_id", "url", "html")]
        for i in range(batch.num_rows):
            page_id, url, html = (c[i].as_py() for c in columns)
            for row in tokenise(html):
                out.append({
                    **{c: row[c] for c in ("ord", "tag", "id", "classes", "cell", "text")}, "page_id": page_id, "url": url,
                    "attrs": list(row["attrs"].items()), "lineage": [{"ord": o, "mark": m} for o, m in row["lineage"]],
                })
                size += len(row["text"])
                if len(out) >= ROWS_PER_BATCH or size >= LETTERS_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(out, ARROW)
                    out, size = [], 0
    yield pa.RecordBatch.from_pylist(out, ARROW)


def page_elements(pages: DataFrame, html: str = "html") -> DataFrame:
    """Element rows of every page (page_id, url, html). Pages without text have none."""
    slim = pages.where(f"{html} is not null").selectExpr("page_id", "url", f"{html} as html")
    return slim.mapInArrow(_to_rows, SCHEMA)
