"""Article XML to clean text: one Arrow function, in two variants.

The XML functions of the engine fail the whole job on a malformed document and lose the order of
mixed content, so the walk runs in Python, an Arrow batch at a time. Entities beyond the predefined
ones are never expanded: a document that declares any is treated as malformed.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.vocab import SKIPPED_SECTIONS_V1, SKIPPED_SECTIONS_V2


class Element:
    """A node: local name, children in document order, strings between them."""

    __slots__ = ("content", "name")

    def __init__(self, name: str):
        self.name, self.content = name, []

    def children(self, *names: str) -> Iterator[Element]:
        return (c for c in self.content if isinstance(c, Element) and (not names or c.name in names))

    def every(self, *names: str) -> Iterator[Element]:
        """This node and all below it, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            if not names or node.name in names:
                yield node
            todo.extend(reversed(list(node.children())))

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                todo.extend(reversed(node.content))
        return "".join(out)


def parse(source: str) -> Element | None:
    """The root, or None for what is not well formed or declares entities."""
    parser = expat.ParserCreate(namespace_separator="}")
    top = Element("")
    stack = [top]

    def start(name: str, _: dict) -> None:
        node = Element(name.rpartition("}")[2])
        stack[-1].content.append(node)
        stack.append(node)

    def refuse(*_: object) -> None:
        raise ValueError("declared entity")

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _: stack.pop()
    parser.CharacterDataHandler = lambda data: stack[-1].content.append(data)
    parser.EntityDeclHandler = refuse
    parser.SkippedEntityHandler = refuse
    try:
        parser.Parse(source, True)
    except (expat.ExpatError, ValueError):
        return None
    return next(top.children(), None)


def normalized(text: str, variant: str) -> str:
    flat = re.sub(r"\s+", " ", html.unescape(text))
    if variant == "v2":
        return flat.strip()
    flat = re.sub(r"\[[0-9,\-– ]+\]", "", flat).strip()
    flat = re.sub("^([A-Za-z]+)([A-Z])", r"\1 \2", flat)
    return re.sub("([.!?])([A-Z]{2,})([A-Z][a-z])", r"\1 \2 \3", flat)


def skipped(title: str, variant: str) -> bool:
    low = title.strip().lower()
    if variant == "v1":
        return re.sub(r"[^a-z\s]", "", low) in SKIPPED_SECTIONS_V1
    return any(phrase in low for phrase in SKIPPED_SECTIONS_V2)


def section(node: Element, variant: str) -> Iterator[str]:
    """Title, paragraphs, list items and nested sections in order; nothing of a skipped section."""
    title = next((normalized(t.text(), variant) for t in node.children("title")), "")
    if title:
        if skipped(title, variant):
            return
        yield title
    for child in node.children("p", "list", "sec"):
        if child.name == "sec":
            yield from section(child, variant)
        else:
            for part in [child] if child.name == "p" else child.children("list-item", "li"):
                yield normalized(part.text(), variant)


def _parts_v1(root: Element) -> Iterator[str]:
    front = next(root.children("front"), root)
    below = lambda name: (normalized(n.text(), "v1") for n in front.every(name) if n is not front)
    yield next(filter(None, below("article-title")), "")
    yield from below("abstract")
    if body := next(root.every("body"), None):
        for sec in body.children("sec"):
            yield from section(sec, "v1")


def _parts_v2(root: Element) -> Iterator[str]:
    titles = (normalized(n.text(), "v2") for n in root.every("article-title", "title"))
    yield next((t for t in titles if len(t) > 5), "")
    for n in root.every("abstract"):
        yield normalized(n.text(), "v2")
    for container in ("body", "back"):
        for n in root.every(container):
            for child in n.children("p", "sec"):
                if child.name == "p":
                    yield normalized(child.text(), "v2")
                else:
                    yield from section(child, "v2")


def clean(root: Element | None, variant: str) -> str | None:
    """Clean text; null if the document can't be parsed. Without any content: '' in v1, null in v2."""
    if root is None:
        return None
    found = "\n\n".join(filter(None, _parts_v1(root) if variant == "v1" else _parts_v2(root)))
    return found if found or variant == "v1" else None


def journal(root: Element | None) -> str | None:
    return next(filter(None, (normalized(n.text(), "v1") for n in root.every("journal-title"))), None) if root else None


def read_xml(c: Column, variant: str = "v2") -> Column:
    """(clean_text, journal) of a document, parsed once: its clean text and the first journal title in it."""
    if variant not in ("v1", "v2"):
        raise ValueError(f"no such variant: {variant}")

    @F.pandas_udf("clean_text string, journal string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            roots = [parse(x) if x else None for x in s]
            yield pd.DataFrame({"clean_text": pd.Series([clean(r, variant) for r in roots], dtype=object), "journal": pd.Series([journal(r) for r in roots], dtype=object)})

    return run(c)


def clean_xml(c: Column, variant: str = "v2") -> Column:
    return read_xml(c, variant)["clean_text"]


def xml_journal(c: Column) -> Column:
    return read_xml(c, "v1")["journal"]


def unescape(c: Column) -> Column:
    """HTML entities to characters."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(html.unescape, na_action="ignore")

    return run(c)
