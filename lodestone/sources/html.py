"""Postings inside web pages: typed JSON-LD nodes and cards, read in Arrow batches with the standard library's parsers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..storage import ship

_SCRIPT = re.compile(r"""<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>""", re.I | re.S)
_BRACE = re.compile(r"[{}]")
#: Elements without an end tag.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def _documents(raw: str) -> Iterator[object]:
    """JSON values of a script: one list, or objects one after another; unreadable ones are left out."""
    raw = raw.strip()
    spans, depth, start = [], 0, 0
    if not raw.startswith("["):
        for m in _BRACE.finditer(raw):
            if m.group() == "{":
                start = m.start() if depth == 0 else start
                depth += 1
            elif depth:
                depth -= 1
                if depth == 0:
                    spans.append(raw[start : m.end()])
    for part in spans or [raw]:
        try:
            yield json.loads(part)
        except ValueError:
            continue


def first_node(html: str | None, kind: str) -> dict | None:
    """The first object of type ``kind`` in reading order, at any depth; ignoring the type's case."""
    for script in _SCRIPT.findall(html or ""):
        for value in _documents(script):
            stack = [value]
            while stack:
                node = stack.pop()
                if isinstance(node, dict):
                    types = node.get("@type")
                    if any(str(t).lower() == kind.lower() for t in (types if isinstance(types, list) else [types])):
                        return node
                    stack.extend(reversed(node.values()))
                elif isinstance(node, list):
                    stack.extend(reversed(node))
    return None


def typed_nodes(pages: DataFrame, html: str = "html", kind: str = "JobPosting") -> DataFrame:
    """``pages`` with ``node``: the JSON of the first typed node of each page; pages without one go.

    Null and empty pages have none; a column named ``node`` is replaced.  The search counts as not deterministic, so that the
    optimizer neither runs it twice (for the filter and for the column) nor moves it in front of a shuffle that deals the pages.
    """

    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def find(pages: pd.Series) -> pd.Series:
        found = [first_node(p, kind) for p in pages]
        return pd.Series([None if n is None else json.dumps(n, ensure_ascii=False) for n in found], dtype=object)

    find = find.asNondeterministic()
    likely = F.col(html).rlike("(?i)ld\\+json") & F.contains(F.lower(html), F.lit(kind.lower()))
    return pages.where(likely).withColumn("node", find(F.col(html))).where(F.col("node").isNotNull())


class _Cards(HTMLParser):
    """Collects, for every element of the card's class, the texts and attributes of its parts."""

    def __init__(self, card: str, fields: dict[str, tuple[str, str | None]]):
        super().__init__(convert_charrefs=True)
        self.card, self.fields, self.cards = card, fields, []
        self.depth, self.open_parts = 0, []

    def _is(self, part: str, tag: str, classes: list[str]) -> bool:
        name, _, cls = part.partition(".")
        return (not name or tag == name) and (not cls or cls in classes)

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        classes = (values.get("class") or "").split()
        if not self.depth:
            if not self._is(self.card, tag, classes):
                return
            self.cards.append({})
        if tag not in _VOID:
            self.depth += 1
        for name, (part, attribute) in self.fields.items():
            if name not in self.cards[-1] and self._is(part, tag, classes):
                if attribute:
                    if values.get(attribute):
                        self.cards[-1][name] = values[attribute]
                elif tag not in _VOID:
                    self.cards[-1][name] = ""
                    self.open_parts.append((name, self.depth))

    def handle_endtag(self, tag):
        if self.depth and tag not in _VOID:
            self.open_parts = [p for p in self.open_parts if p[1] != self.depth]
            self.depth -= 1

    def handle_data(self, data):
        for name, _ in self.open_parts:
            self.cards[-1][name] += data


def cards(pages: DataFrame, card: str, fields: dict[str, tuple[str, str | None]], html: str = "html") -> DataFrame:
    """A row per card of each page with its place and fields; ``pages`` columns stay, but for the html.

    ``card`` and the parts of ``fields`` are "tag.class" (either may be missing); a field is an attribute of
    the first such part, or its text with white space collapsed; null if the part is missing or empty.  Cards don't nest.
    """
    ship(pages.sparkSession)
    kind = "array<struct<place:int," + ",".join(f"{n}:string" for n in fields) + ">>"

    @F.pandas_udf(kind)
    def read(pages: pd.Series) -> pd.Series:
        out = []
        for page in pages:
            parser = _Cards(card, fields)
            parser.feed(page or "")
            parser.close()
            out.append([{"place": i} | {n: " ".join(c.get(n, "").split()) or None for n in fields} for i, c in enumerate(parser.cards)])
        return pd.Series(out, dtype=object)

    keep = [c for c in pages.columns if c not in (html, "place", *fields)]
    return pages.select(*keep, F.explode(read(F.col(html))).alias("__c")).select(*keep, "__c.*")


def card_id(urn: str = "urn", href: str = "href"):
    """The digits at the end of a card's urn, or else those at the end of its link's path."""
    digits = lambda x, p: F.nullif(F.regexp_extract(F.coalesce(F.col(x), F.lit("")), p, 1), F.lit(""))
    return F.coalesce(digits(urn, r":(\d+)$"), digits(href, r"(\d{5,})/?(?:[?#].*)?$"))
