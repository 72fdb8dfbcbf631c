"""Listing pages as a source: a template of named paths, read from each page's tree of elements, checked, with a page's errors beside its entries.

A path is a descent of steps: an element's name, or `*`, with `.class`, `#id` and `[attribute=value]` as conditions; `>` before a
step asks for a child. `@name` behind a path takes an attribute in place of the text. Embedded JSON (script elements of
type application/ld+json) is taken out as text, to be read by Spark with a schema. Pages are parsed each on its own inside
tasks, whole; nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements without content, and elements that an opening of the given kinds ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"]),
}
_STEP = re.compile(r"(\*|[a-z][a-z0-9-]*)?((?:[.#][\w-]+|\[[\w-]+(?:=[^\]]*)?\])*)$")
_CONDITION = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:=([^\]]*))?\]")


@dataclass(frozen=True)
class Field:
    """Where a value stands, whether a page must have one, and what each value must look like."""

    path: str
    required: bool = False
    pattern: str | None = None


class Element:
    __slots__ = ("name", "attributes", "parent", "parts")

    def __init__(self, name: str, attributes: dict[str, str], parent: Element | None):
        self.name, self.attributes, self.parent, self.parts = name, attributes, parent, []

    def text(self) -> str:
        """All text inside, white space as single blanks. Elements may be nested deeply, so this does not recur."""
        out, left = [], [self]
        while left:
            part = left.pop()
            if isinstance(part, str):
                out.append(part)
            else:
                left += reversed(part.parts)
        return " ".join("".join(out).split())


class Tree(HTMLParser):
    """A page's elements in order. Elements that nothing closes end with what they are in."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.top = Element("", {}, None)
        self.open, self.elements = [self.top], []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while len(self.open) > 1 and tag in ENDED_BY.get(self.open[-1].name, ()):
            self.open.pop()
        element = Element(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].parts.append(element)
        self.elements.append(element)
        if tag not in VOID:
            self.open.append(element)
        elif tag == "br":
            element.parts.append(" ")

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


Step = tuple[bool, str, list[tuple[str, str | None]]]


def steps_of(path: str) -> tuple[list[Step], str]:
    """The steps of a path (whether a child, name, conditions on attributes) and the attribute that it takes."""
    way, _, attribute = path.partition("@")
    steps, child = [], False
    for word in way.replace(">", " > ").split():
        if word == ">":
            child = True
            continue
        m = _STEP.match(word)
        if m is None:
            raise ValueError(f"not a step: {word}")
        conditions = [({".": "class", "#": "id"}[kind], name) if kind else (key, value or None) for kind, name, key, value in _CONDITION.findall(m[2])]
        steps.append((child, m[1] or "*", conditions))
        child = False
    if not steps:
        raise ValueError(f"no step in {path!r}")
    return steps, attribute


def _fits(element: Element, step: Step) -> bool:
    _, name, conditions = step
    held = element.attributes
    return name in ("*", element.name) and all(k in held and (v is None or v == held[k] or k == "class" and v in held[k].split()) for k, v in conditions)


def found(tree: Tree, steps: list[Step]) -> list[Element]:
    """The elements that a path leads to, in page order."""

    def reached(element: Element, i: int) -> bool:
        if not _fits(element, steps[i]):
            return False
        if not i:
            return True
        above = element.parent
        while above is not None:
            if reached(above, i - 1):
                return True
            if steps[i][0]:
                return False
            above = above.parent
        return False

    return [e for e in tree.elements if reached(e, len(steps) - 1)]


_PAGE = T.StructType([
    T.StructField("entries", T.ArrayType(T.StructType([T.StructField("field", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("value", T.StringType())]))),
    T.StructField("json", T.ArrayType(T.StringType())), T.StructField("errors", T.ArrayType(T.StringType())),
])


def scraped(pages: DataFrame, template: dict[str, Field], html: str = "html") -> DataFrame:
    """pages without html, with entries (field, place, value), json and errors: missing and misfit fields, and JSON that is none."""
    ways = {name: (*steps_of(f.path), f, re.compile(f.pattern) if f.pattern else None) for name, f in template.items()}

    def of_page(text: str | None) -> tuple:
        tree, entries, errors = Tree(text or ""), [], []
        for name, (steps, attribute, field, pattern) in ways.items():
            values = [e.attributes.get(attribute, "") if attribute else e.text() for e in found(tree, steps)]
            if field.required and not any(values):
                errors.append(f"{name}: missing")
            for place, value in enumerate(values, 1):
                if pattern and not pattern.fullmatch(value):
                    errors.append(f"{name} {place}: {value[:80]}")
                elif value:
                    entries.append((name, place, value))
        held = []
        for i, element in enumerate((e for e in tree.elements if e.name == "script" and e.attributes.get("type", "").lower() == "application/ld+json"), 1):
            raw = "".join(p for p in element.parts if isinstance(p, str))
            try:
                value = json.loads(raw)
            except (ValueError, RecursionError):
                errors.append(f"json {i}: not JSON")
                continue
            held += [json.dumps(v, ensure_ascii=False) for v in (value if isinstance(value, list) else [value])]
        return entries, held, errors

    @F.pandas_udf(_PAGE)
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([of_page(t) for t in batch], columns=["entries", "json", "errors"])

    return pages.withColumn("_page", parsed(F.col(html))).select(*(F.col(c) for c in pages.columns if c != html), "_page.*")


def entries(pages: DataFrame) -> DataFrame:
    """A row per entry of scraped pages: their columns with field, place and value."""
    kept = [c for c in pages.columns if c not in ("entries", "json", "errors")]
    return pages.select(*kept, F.inline("entries"))


def embedded(pages: DataFrame, schema: str, name: str = "item") -> DataFrame:
    """A row per embedded JSON object, read with a schema; what has another shape is null in the fields that differ."""
    kept = [c for c in pages.columns if c not in ("entries", "json", "errors")]
    return pages.select(*kept, F.explode("json").alias("_j")).select(*kept, F.from_json("_j", schema).alias(name))
