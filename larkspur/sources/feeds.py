"""RSS 2, RSS 1 and Atom documents -> items, by Arrow batches."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = "struct<title: string, link: string, description: string, content: string, author: string, published: string, guid: string, categories: array<string>>"
FEED = f"struct<format: string, title: string, link: string, items: array<{ITEM}>>"


def _name(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _child(node: ET.Element, *names: str) -> ET.Element | None:
    for name in names:
        for c in node:
            if _name(c.tag) == name:
                return c
    return None


def _text(node: ET.Element, *names: str) -> str | None:
    for name in names:
        for c in node:
            if _name(c.tag) == name and "".join(c.itertext()).strip():
                return "".join(c.itertext()).strip()
    return None


def _item(node: ET.Element, atom: bool) -> dict:
    links = [c for c in node if _name(c.tag) == "link"]
    if atom:
        best = next((c for c in links if c.get("rel", "alternate") == "alternate"), links[0] if links else None)
        link = best.get("href") if best is not None else None
    else:
        link = _text(node, "link")
    author = _child(node, "author", "creator")
    who = (_text(author, "name") or "".join(author.itertext()).strip()) if author is not None else None
    encoded = next((c for c in node if c.tag.endswith("}encoded")), None)
    content = "".join(encoded.itertext()).strip() if encoded is not None else _text(node, "content")
    cats = [(c.get("term") or "".join(c.itertext()).strip()) for c in node if _name(c.tag) in ("category", "subject")]
    return {"title": _text(node, "title"), "link": link, "description": _text(node, "summary", "description"), "content": content, "author": who, "published": _text(node, "pubdate", "published", "updated", "date"), "guid": _text(node, "guid", "id"), "categories": [c for c in cats if c]}


def parse_feed(document: str | None) -> dict | None:
    """A feed as a dictionary; None if the document is no feed or not well formed."""
    if not document:
        return None
    try:
        root = ET.fromstring(document.strip().encode())
    except ET.ParseError:
        return None
    kind = {"rss": "rss2", "rdf": "rss1", "feed": "atom"}.get(_name(root.tag))
    if kind is None:
        return None
    head = root if kind == "atom" else _child(root, "channel")
    if head is None:
        return None
    items = [c for c in (head if kind != "rss1" else root) if _name(c.tag) == ("entry" if kind == "atom" else "item")]
    link = _child(head, "link")
    return {"format": kind, "title": _text(head, "title"), "link": None if link is None else link.get("href") or "".join(link.itertext()).strip(), "items": [_item(i, kind == "atom") for i in items]}


def feed(document: Column) -> Column:
    """A parsed feed; null where the document is none."""

    @F.pandas_udf(FEED)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            empty = {"format": None, "title": None, "link": None, "items": None}
            yield pd.DataFrame([parse_feed(x) or empty for x in batch], columns=["format", "title", "link", "items"])

    return parse(document)


def feed_items(df: DataFrame, key: str, document: str) -> DataFrame:
    """One row for each item, with its position from 1."""
    parsed = df.select(key, feed(F.col(document)).alias("f")).filter("f.format IS NOT NULL")
    rows = parsed.select(key, F.col("f.format").alias("format"), F.col("f.title").alias("feed_title"), F.posexplode("f.items").alias("pos", "i"))
    return rows.select(key, "format", "feed_title", (F.col("pos") + 1).alias("pos"), "i.*")


def item_count(document: Column) -> Column:
    """Items by counting their opening tags, well formed or not."""
    return F.regexp_count(document, F.lit("<(?:item|entry)[ >]"))


def looks_like_feed(document: Column) -> Column:
    """Does the first kilobyte carry a feed's marks?"""
    return F.lower(F.substring(document, 1, 1024)).rlike("<rss|<feed|<rdf:rdf|application/rss|application/atom")


def usable(document: Column, least: int = 3) -> Column:
    """A feed with enough items whose title does not speak of comments."""
    title = F.regexp_extract(document, r"(?is)<title[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</title>", 1)
    return looks_like_feed(document) & (item_count(document) >= least) & ~F.lower(title).contains("comment")
