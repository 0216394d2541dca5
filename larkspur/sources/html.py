"""HTML pages: title, content, author, dates, links, feeds, sitemaps."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.urls import resolve

_SKIP = frozenset("script style nav footer header noscript aside form svg".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset("p div li tr h1 h2 h3 h4 h5 h6 br section article main blockquote pre td".split())


class _Reader(HTMLParser):
    """Collects text by container: the whole page, article, main, content-like and paragraphs."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.skip = 0
        self.parts: dict[str, list[str]] = {"all": [], "article": [], "main": [], "content": []}
        self.paragraphs: list[list[str]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCK:
            self._add("\n")
        if tag in _VOID:
            return
        marks = " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower()
        kinds = tuple(k for k, hit in (("article", tag == "article"), ("main", tag == "main"), ("content", any(w in marks for w in ("content", "article", "post", "entry")))) if hit)
        self.stack.append((tag, kinds))
        self.skip += tag in _SKIP
        if tag == "p" and not self.skip:
            self.paragraphs.append([])

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            t, _ = self.stack.pop()
            self.skip -= t in _SKIP
            if t == tag:
                break
        if tag in _BLOCK:
            self._add("\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self._add(data)
            if any(t == "p" for t, _ in self.stack) and self.paragraphs:
                self.paragraphs[-1].append(data)

    def _add(self, data: str) -> None:
        if self.skip:
            return
        self.parts["all"].append(data)
        for k in {k for _, ks in self.stack for k in ks}:
            self.parts[k].append(data)


def _squeeze(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def page_texts(page: str | None) -> tuple[str, str]:
    """(main content, all visible text) of a page."""
    if not page:
        return "", ""
    r = _Reader()
    r.feed(page)
    r.close()
    body = _squeeze(r.parts["all"])
    for k in ("article", "main", "content"):
        text = _squeeze(r.parts[k])
        if text:
            return text, body
    return " ".join(filter(None, (_squeeze(p) for p in r.paragraphs[:10]))), body


def content(page: Column, most: int = 2000) -> Column:
    """Main content: article, main, content-like containers, else the first ten paragraphs."""

    @F.pandas_udf("string")
    def main(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: page_texts(x)[0][:most])

    return main(page)


def visible_text(page: Column) -> Column:
    """All text but scripts, styles and page furniture."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: page_texts(x)[1])

    return text(page)


def _meta(page: Column, name: str) -> Column:
    a = F.regexp_extract(page, rf"(?is)<meta[^>]+(?:property|name)=[\"']{name}[\"'][^>]+content=[\"']([^\"']*)", 1)
    b = F.regexp_extract(page, rf"(?is)<meta[^>]+content=[\"']([^\"']*)[\"'][^>]+(?:property|name)=[\"']{name}[\"']", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def title(page: Column) -> Column:
    """og:title, else h1, else title."""
    inner = lambda tag: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(page, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", "")), F.lit(""))
    return F.coalesce(_meta(page, "og:title"), inner("h1"), inner("title"))


def author(page: Column) -> Column:
    return F.coalesce(_meta(page, "author"), _meta(page, "article:author"))


def published(page: Column) -> Column:
    return F.coalesce(_meta(page, "article:published_time"), _meta(page, "date"), F.nullif(F.regexp_extract(page, r"(?i)<time[^>]+datetime=[\"']([^\"']+)", 1), F.lit("")))


def links(df: DataFrame, key: str, page: str) -> DataFrame:
    """(key, pos, href, text) of the links of a page."""
    found = F.regexp_extract_all(F.col(page), F.lit(r"(?is)(<a\s[^>]*href=[\"'][^\"']*[\"'][^>]*>.*?</a>)"), F.lit(1))
    rows = df.select(key, F.posexplode(found).alias("pos", "a"))
    text = F.trim(F.regexp_replace(F.regexp_replace("a", "<[^>]*>", ""), r"\s+", " "))
    return rows.select(key, (F.col("pos") + 1).alias("pos"), F.regexp_extract("a", r"(?i)href=[\"']([^\"']*)", 1).alias("href"), text.alias("text"))


def feed_links(page: Column) -> Column:
    """Feeds a page announces (either order of attributes) or links to."""
    tags = F.regexp_extract_all(page, F.lit(r"(?is)(<link[^>]+application/(?:rss|atom)\+xml[^>]*>)"), F.lit(1))
    announced = F.transform(tags, lambda t: F.regexp_extract(t, r"(?i)href=[\"']([^\"']+)", 1))
    linked = F.regexp_extract_all(page, F.lit(r"(?i)<a\s[^>]*href=[\"']([^\"']*(?:rss|feed)[^\"']*)[\"']"), F.lit(1))
    return F.array_distinct(F.filter(F.concat(announced, linked), lambda x: x != ""))


def _same_site(df: DataFrame, key: str, page: str, url: str) -> DataFrame:
    """(key, url, text) of the links of a page that stay on its host, absolute, once each."""
    base = F.struct(F.col(key).alias("k"), F.col(url).alias("u"))  # the page's address goes along, so nothing is joined
    found = links(df.select(base.alias("__b"), page), "__b", page).select(F.col("__b.k").alias(key), F.col("__b.u").alias("__base"), "pos", "href", "text")
    absolute = found.withColumn("url", resolve(F.col("__base"), F.col("href")))
    return absolute.filter(host("url") == host("__base")).groupBy(key, "url").agg(F.min_by("text", "pos").alias("text"), F.min("pos").alias("pos"))


def host(column: str) -> Column:
    return F.lower(F.regexp_extract(column, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def article_links(df: DataFrame, key: str, page: str, url: str) -> DataFrame:
    """(key, url) of the links that look like articles of the same site: by path or by a numbered parameter."""
    return _same_site(df, key, page, url).filter(F.col("url").rlike(r"(?i)/(view|read|detail|article|news)[?/]|(?i)(seq|idx|id|no)=\d+")).select(key, "url")


# Parts of the addresses of news pages.
NEWS_PATHS = ("/news/", "/press/", "/article/", "/blog/", "/release/", "/update/", "/announcement/", "/post/")


def news_links(df: DataFrame, key: str, page: str, url: str) -> DataFrame:
    """(key, url, title) of the links of the same site with a news path; titles of at most 100 characters."""
    rows = _same_site(df, key, page, url)
    return rows.filter(F.exists(F.array(*[F.lit(p) for p in NEWS_PATHS]), lambda p: F.contains(F.lower("url"), p))).select(key, "url", F.substring(F.trim("text"), 1, 100).alias("title"))


def sitemap_urls(document: Column) -> Column:
    """The locations of a sitemap or of a sitemap index."""
    return F.regexp_extract_all(document, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))


def sitemap_pages(maps: DataFrame, url: str, document: str, depth: int = 3) -> DataFrame:
    """(site, page) of all sitemaps in a table of fetched ones (``url``, ``document``): an index
    is followed into its children, ``depth`` levels deep; ``site`` is the sitemap that no index names."""
    rows = maps.select(F.col(url).alias("map"), F.explode(sitemap_urls(F.col(document))).alias("loc"), F.lower(document).rlike("<sitemapindex").alias("is_index"))
    children = rows.filter("is_index").select("loc").distinct()
    roots = rows.select("map").distinct().join(children.select(F.col("loc").alias("map")), "map", "left_anti")
    open_ = roots.select(F.col("map").alias("site"), "map")
    found = None
    for _ in range(depth):
        met = open_.join(rows, "map")
        pages = met.filter("NOT is_index").select("site", F.col("loc").alias("page"))
        found = pages if found is None else found.unionByName(pages)
        open_ = met.filter("is_index").select("site", F.col("loc").alias("map"))
    return found.distinct()


def search_results(page: Column) -> Column:
    """(url, title) of the hits of a result page: links that leave the site, with their
    target taken out of a redirecting address (uddg=, url=, q=)."""
    tags = F.regexp_extract_all(page, F.lit(r"(?is)(<a\s[^>]*href=[\"'][^\"']*[\"'][^>]*>.*?</a>)"), F.lit(1))

    def hit(a: Column) -> Column:
        href = F.replace(F.regexp_extract(a, r"(?i)href=[\"']([^\"']*)", 1), F.lit("&amp;"), F.lit("&"))
        inner = F.try_url_decode(F.regexp_extract(href, r"[?&](?:uddg|url|q)=(https?(?:%3A|:)[^&]+)", 1))
        target = F.coalesce(F.nullif(inner, F.lit("")), F.when(href.rlike("^https?://"), href))
        return F.struct(target.alias("url"), F.trim(F.regexp_replace(F.regexp_replace(a, "<[^>]*>", ""), r"\s+", " ")).alias("title"))

    return F.filter(F.transform(tags, hit), lambda h: h["url"].isNotNull() & (h["title"] != ""))


def news_urls(urls: Column, words: list[str], most: int) -> Column:
    """URLs with one of the words or a news-like path."""
    hit = lambda u: u.rlike(r"(?i)/(news|article|blog|post|story|20\d{2})/") | F.exists(F.array(*[F.lit(w.lower()) for w in words[:5]]), lambda w: F.contains(F.lower(u), w))
    return F.slice(F.filter(urls, hit), 1, most)


def feed_candidates(domain: Column) -> Column:
    """Addresses at which a site's feed usually is."""
    paths = ("/feed", "/rss", "/rss.xml", "/feed.xml", "/atom.xml", "/index.xml", "/feeds", "/blog/feed")
    return F.array(*[F.concat(F.lit("https://"), domain, F.lit(p)) for p in paths])
