"""HTML: visible text, and markup made safe with what was taken out."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements without visible text; elements and attributes that run or load something.
SILENT = {"script", "style"}
BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "nav", "ul", "ol", "table", "title"}
ACTIVE = {"script", "iframe", "object", "embed", "applet", "form", "base", "link", "meta", "frame", "frameset"}
# Active elements whose contents go with them; of the others only the tags go.
ENCLOSED = {"script", "object", "applet"}
ADDRESSES = {"href", "src", "action", "background", "srcset", "poster", "data", "formaction", "xlink:href"}
VOID = {"br", "hr", "img", "input", "col", "area", "wbr", "source", "track", "param"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in SILENT
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.silent = max(0, self.silent - (tag in SILENT))
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data)


def visible_text(html: str) -> str:
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = (" ".join(line.split()) for line in "".join(parser.out).split("\n"))
    return "\n".join(line for line in lines if line)


class _Clean(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.inside: list[str] = []
        self.removed: dict[str, int] = {}

    def note(self, what: str) -> None:
        self.removed[what] = self.removed.get(what, 0) + 1

    def handle_starttag(self, tag, attrs):
        if tag in ACTIVE:
            self.note(tag)
            if tag in ENCLOSED:
                self.inside.append(tag)
            return
        if self.inside:
            return
        kept = []
        for name, value in attrs:
            if name.startswith("on"):
                self.note("event handler")
            elif name in ADDRESSES and not (value or "").startswith(("#", "data:image/")):
                self.note("remote address" if "://" in (value or "") or (value or "").startswith("//") else "script address" if (value or "").strip().lower().startswith("javascript") else "address")
            elif name == "style" and ("url(" in (value or "").lower() or "expression" in (value or "").lower()):
                self.note("style address")
            else:
                kept.append(f' {name}="{escape(value or "", quote=True)}"')
        self.out.append(f"<{tag}{''.join(kept)}>")

    def handle_endtag(self, tag):
        if self.inside:
            if tag == self.inside[-1]:
                self.inside.pop()
        elif tag not in ACTIVE and tag not in VOID:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.inside:
            self.out.append(escape(data, quote=False))

    def handle_entityref(self, name):
        if not self.inside:
            self.out.append(f"&{name};")

    def handle_charref(self, name):
        if not self.inside:
            self.out.append(f"&#{name};")

    def handle_comment(self, data):
        self.note("comment")


def sanitise(html: str) -> tuple[str, dict[str, int]]:
    parser = _Clean()
    parser.feed(html)
    parser.close()
    return "".join(parser.out), parser.removed


def texts(pages: DataFrame) -> DataFrame:
    """(node, text) of (node, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([visible_text(x or "") for x in batch.column(1).to_pylist()], pa.string())], ["node", "text"])

    return pages.select("node", "html").mapInArrow(run, "node long, text string")


def sanitised(pages: DataFrame) -> DataFrame:
    """(node, html, removed) of (node, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sanitise(x or "") for x in batch.column(1).to_pylist()]
            removed = pa.array([list(r.items()) for _, r in made], pa.map_(pa.string(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h for h, _ in made], pa.string()), removed], ["node", "html", "removed"])

    return pages.select("node", "html").mapInArrow(run, "node long, html string, removed map<string,int>")
