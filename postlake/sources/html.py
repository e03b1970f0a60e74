"""HTML as rows: a small tree by the standard library's parser, and what extractors read from it.

Trees live only within a batch; what leaves it are arrays of plain structs, so that
everything after parsing is DataFrame expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A tag that opens closes these before it, up to the nearest container.
_CLOSES = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
_CONTAINERS = frozenset("table ul ol dl body html div section article main select".split())
_BLOCKS = frozenset("p div li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer main br dt dd nav".split())
#: Subtrees without a posting's text (fixed values).
PRUNED = ("nav", "header", "footer", "script", "style")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def find_all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def strings(self) -> Iterator[str]:
        todo: list[Node | str] = list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                yield c
            elif c.tag not in ("script", "style"):
                todo += reversed(c.children)

    def text(self, between: str = "") -> str:
        return between.join(self.strings())

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag, attrs):
        closes = _CLOSES.get(tag, ())
        n = self.at
        while closes and n is not None and n.tag not in _CONTAINERS:
            if n.tag in closes:
                self.at = n.parent
            n = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[^\t\n\f <&#;]{1,32};)?")


def ended_references(html: str) -> str:
    """The page with every ampersand escaped that begins no whole reference: what lacks its semicolon stays as it is written."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:], html)


def parse(html: str | None, ended: bool = False) -> Node:
    """The page's tree. Like browsers it reads `&amp` without a semicolon as a reference; with ended it does not."""
    b = _Builder()
    b.feed(ended_references(html or "") if ended else html or "")
    b.close()
    return b.root


def squeeze(text: str) -> str:
    return " ".join(text.split())


def prune(root: Node, tags=PRUNED) -> Node:
    """The tree without the subtrees of these tags."""
    for n in [root, *root.walk()]:
        n.children = [c for c in n.children if isinstance(c, str) or c.tag not in tags]
    return root


def _first_link(n: Node) -> Node | None:
    return next((a for a in n.find_all("a") if "href" in a.attrs), None)


def table_rows(html: str | None) -> list[dict]:
    """Every row of every table in order: table_no, row_no (in its table), cells, and the row's first link."""
    root, out = parse(html), []
    tables = {id(t): i for i, t in enumerate(root.find_all("table"))}
    counts: dict[int, int] = {}
    for tr in root.find_all("tr"):
        up = tr.parent
        while up is not None and up.tag != "table":
            up = up.parent
        no = tables.get(id(up), -1)
        cells = []
        for c in tr.find_all("td", "th"):
            a = _first_link(c)
            cells.append({"tag": c.tag, "scope": c.attrs.get("scope", ""), "text": squeeze(c.text()), "href": a.attrs["href"] if a else None, "link_text": squeeze(a.text()) if a else None})
        link = _first_link(tr)
        out.append({"table_no": no, "row_no": counts.get(no, 0), "cells": cells, "href": link.attrs["href"] if link else None, "link_text": squeeze(link.text()) if link else None})
        counts[no] = counts.get(no, 0) + 1
    return out


def links(html: str | None) -> list[dict]:
    """Every link: its place, href, text, and the card around it (up to six levels up, while it holds one link)."""
    out = []
    for i, a in enumerate(x for x in parse(html).find_all("a") if "href" in x.attrs):
        card = a
        for _ in range(6):
            up = card.parent
            if up is None or up.tag in ("#root", "body") or len(up.find_all("a")) > 1:
                break
            card = up
        out.append({"link_no": i, "href": a.attrs["href"], "text": squeeze(a.text()), "card": squeeze(card.text(" "))})
    return out


def accordions(html: str | None) -> list[dict]:
    """Accordion blocks: button text, the content's text, and its paragraphs and list items."""
    out = []
    for i, block in enumerate(n for n in parse(html).find_all("div") if n.has_class("accordion-wrap")):
        button = next((a for a in block.find_all("a") if a.has_class("accordion-btn")), None)
        if button is None:
            continue
        content = next((d for d in block.find_all("div") if d.has_class("accordion-content")), None)
        parts = [squeeze(p.text(" ")) for p in content.find_all("p", "li")] if content else []
        out.append({"block_no": i, "button": squeeze(button.text()), "body": content.text() if content else "", "parts": parts})
    return out


def paragraphs(html: str | None, cls: str | None = None) -> list[str]:
    """Texts of the paragraphs, of the first element of a class if one is named."""
    root = prune(parse(html))
    at = next((n for n in root.find_all("div") if n.has_class(cls)), None) if cls else root
    return [squeeze(p.text(" ")) for p in at.find_all("p")] if at else []


def blocks(html: str | None, *tags: str, ended: bool = False) -> list[str]:
    """Texts of the elements of these tags, navigation and scripts left out; ended as in parse."""
    return [squeeze(n.text(" ")) for n in prune(parse(html, ended)).find_all(*(tags or ("div", "td", "section", "article", "main")))]


def detail(html: str | None, cls: str, *tags: str) -> dict:
    """A detail page by one parse: the paragraphs of the first element of the class, all blocks of the tags, and the whole text."""
    root = parse(html)
    whole = root.text()
    prune(root)
    at = next((n for n in root.find_all("div") if n.has_class(cls)), None)
    return {"parts": [squeeze(p.text(" ")) for p in at.find_all("p")] if at else [], "blocks": [squeeze(n.text(" ")) for n in root.find_all(*tags)], "whole": whole}


def elements(html: str | None, most: int, *tags: str) -> list[dict]:
    """The first elements of the tags with tag, class, id and the first 100 characters of their text, if any."""
    out = []
    for n in prune(parse(html)).find_all(*tags)[:most]:
        text = squeeze(n.text(" "))[:100]
        if text:
            out.append({"tag": n.tag, "cls": n.attrs.get("class", ""), "dom_id": n.attrs.get("id", ""), "text": text})
    return out


def body_text(html: str | None) -> str:
    """The page's text, a line for each block."""
    out: list[str] = []
    todo: list[Node | str] = [parse(html)]
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag not in ("script", "style", "head"):
            if c.tag in _BLOCKS:
                out.append("\n")
                todo.append("\n")
            todo += reversed(c.children)
    return "\n".join(x for x in (squeeze(line) for line in "".join(out).split("\n")) if x)


def windows(text: str | None, pattern: str, before: int, after: int) -> list[dict]:
    """Every match: its place, first group, and the text around it."""
    t = text or ""
    return [{"match_no": i, "value": m[1] if m.re.groups else m[0], "before": t[max(0, m.start() - before) : m.start()], "after": t[m.end() : m.end() + after]} for i, m in enumerate(re.finditer(pattern, t))]


def nearest_links(html: str | None, label: str, marker: str, levels: int = 12) -> list[dict]:
    """For each text `label: number`, the link with marker in the largest container that holds no other label."""
    out, root = [], parse(html)
    for n in [root, *root.walk()]:
        for c in n.children:
            m = re.fullmatch(rf"{re.escape(label)}: (\d+)", c.strip()) if isinstance(c, str) else None
            if not m:
                continue
            card = up = n
            for _ in range(levels):
                if up is None or up.text().count(f"{label}:") > 1:
                    break
                card, up = up, up.parent
            a = next((a for a in card.find_all("a") if marker in a.attrs.get("href", "")), None)
            if a is not None:
                out.append({"reference": m[1], "href": a.attrs["href"]})
    return out


def page_numbers(html: str | None) -> list[str]:
    """Labels of buttons, of which the largest number is the number of pages."""
    return [squeeze(b.text()) for b in parse(html).find_all("button")]


def next_link(html: str | None) -> str | None:
    """The address of the page's link to a next one, empty if it has none of its own; None without an enabled link."""
    a = next((a for a in parse(html).find_all("a", "button") if a.attrs.get("title") == "Next" or a.attrs.get("aria-label") == "Next" or squeeze(a.text()).lower() == "next"), None)
    if a is None or "disabled" in a.attrs or re.search("disabled|inactive", a.attrs.get("class", "").lower()):
        return None
    href = a.attrs.get("href", "")
    return "" if href.startswith(("#", "javascript:")) else href


#: Bytes of a batch that comes to a Python worker at once, but for a longer row, and rows that are read before their results leave.
BATCH_BYTES, PARSED_ROWS = "8m", 64

_S, _L = pa.string(), pa.int64()
CELL = pa.struct([("tag", _S), ("scope", _S), ("text", _S), ("href", _S), ("link_text", _S)])
TYPES = {
    "rows": pa.list_(pa.struct([("table_no", _L), ("row_no", _L), ("cells", pa.list_(CELL)), ("href", _S), ("link_text", _S)])),
    "links": pa.list_(pa.struct([("link_no", _L), ("href", _S), ("text", _S), ("card", _S)])),
    "accordions": pa.list_(pa.struct([("block_no", _L), ("button", _S), ("body", _S), ("parts", pa.list_(_S))])),
    "texts": pa.list_(_S), "text": _S, "flag": pa.bool_(),
    "windows": pa.list_(pa.struct([("match_no", _L), ("value", _S), ("before", _S), ("after", _S)])),
    "detail": pa.struct([("parts", pa.list_(_S)), ("blocks", pa.list_(_S)), ("whole", _S)]),
    "elements": pa.list_(pa.struct([("tag", _S), ("cls", _S), ("dom_id", _S), ("text", _S)])),
    "urls": pa.list_(pa.struct([("reference", _S), ("href", _S)])),
}


def with_parsed(df: DataFrame, column: str, name: str, kind: str, read: Callable) -> DataFrame:
    """df without column, and with read(column) of a TYPES kind as name.

    Batches pass through Arrow, nothing is shuffled. The parsed column does not ride
    back; whoever needs it keeps a copy under another name. Select what is needed before.
    What a worker holds does not grow with the rows: batches are bounded by bytes, and
    trees and structs are those of PARSED_ROWS rows.
    """
    from pyspark.sql.pandas.types import from_arrow_type

    kept = [c for c in df.columns if c not in (name, column)]
    schema = StructType([df.schema[c] for c in kept] + [StructField(name, from_arrow_type(TYPES[kind]))])
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PARSED_ROWS):
                b = whole.slice(at, PARSED_ROWS)
                values = pa.array([read(x.as_py()) for x in b.column(n)], TYPES[kind])
                yield pa.RecordBatch.from_arrays([*b.columns[:n], values], [*kept, name])

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.select(*kept, column).mapInArrow(run, schema)
