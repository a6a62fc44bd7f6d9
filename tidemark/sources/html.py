"""Text and embedded data of HTML pages, in Arrow batches."""

from __future__ import annotations

import json
import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HIDDEN = {"script", "style", "noscript", "template"}
MOST_DESCRIPTION = 5_000


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN
        self.parts.append(" ")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in HIDDEN))
        self.parts.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def text_of(html: str | None, closed: bool = False) -> str | None:
    """Visible text with entities decoded, white space as single spaces, none before a comma or full stop.

    With closed, a named entity counts only with its semicolon; without, HTML's old names count bare too.
    """
    if html is None:
        return None
    if closed:
        html = re.sub("&[A-Za-z][A-Za-z0-9]*;?", lambda m: m[0] if m[0].endswith(";") and m[0][1:] in html5 else "&amp;" + m[0][1:], html)
    parser = _Text()
    parser.feed(html)
    parser.close()
    return re.sub(r" ([,.])", r"\1", re.sub(r"[\s ]+", " ", "".join(parser.parts)).strip())


@F.pandas_udf(StringType())
def clean_text(html: pd.Series) -> pd.Series:
    return html.map(text_of, na_action="ignore")


@F.pandas_udf(StringType())
def closed_text(html: pd.Series) -> pd.Series:
    return html.map(lambda x: text_of(x, closed=True), na_action="ignore")


def clean_description(html: Column, closed: bool = False) -> Column:
    text = closed_text(html) if closed else clean_text(html)
    return F.when(F.length(text) > MOST_DESCRIPTION, F.concat(F.substring(text, 1, MOST_DESCRIPTION - 1), F.lit("…"))).otherwise(text)


class _Scripts(HTMLParser):
    def __init__(self, kind: str) -> None:
        super().__init__()
        self.kind, self.open, self.found = kind, False, []

    def handle_starttag(self, tag, attrs):
        if tag == "script" and dict(attrs).get("type", "").lower() == self.kind:
            self.open = True
            self.found.append("")

    def handle_endtag(self, tag):
        self.open = self.open and tag != "script"

    def handle_data(self, data):
        if self.open:
            self.found[-1] += data


def events_of(html: str | None) -> list[dict]:
    """JSON-LD items whose type is an event, out of lists and graphs; broken scripts are passed over."""
    parser = _Scripts("application/ld+json")
    parser.feed(html or "")
    parser.close()
    found: list[dict] = []

    def walk(node) -> None:
        if isinstance(node, list):
            for item in node:
                walk(item)
        elif isinstance(node, dict):
            kinds = node.get("@type", [])
            if any(str(k).endswith("Event") for k in (kinds if isinstance(kinds, list) else [kinds])):
                found.append(node)
            walk(node.get("@graph", []))

    for script in parser.found:
        try:
            walk(json.loads(script))
        except ValueError:
            continue
    return found


def _first(value, *keys):
    for key in keys:
        value = value[0] if isinstance(value, list) and value else value
        value = value.get(key) if isinstance(value, dict) else None
    value = value[0] if isinstance(value, list) and value else value
    return None if value is None or isinstance(value, (dict, list)) else str(value)


LISTING = "name string, start_date string, end_date string, url string, image string, venue string, price string, currency string"


def jsonld_events(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, listing fields) of every event in the pages' JSON-LD."""

    @F.pandas_udf(f"array<struct<{', '.join(f.replace(' ', ': ') for f in LISTING.split(', '))}>>")
    def extract(html: pd.Series) -> pd.Series:
        def row(e: dict) -> dict:
            image = _first(e, "image") or _first(e.get("image"), "url")
            return {"name": _first(e, "name"), "start_date": _first(e, "startDate"), "end_date": _first(e, "endDate"), "url": _first(e, "url"), "image": image, "venue": _first(e, "location", "name"), "price": _first(e, "offers", "price"), "currency": _first(e, "offers", "priceCurrency")}

        return html.map(lambda h: [row(e) for e in events_of(h)])

    return pages.select(id_col, F.explode(extract(F.col(html_col))).alias("e")).select(id_col, "e.*")
