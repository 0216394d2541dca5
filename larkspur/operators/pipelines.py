"""Composite pipelines: topic analysis, source generation, bootstrap, seeds, crawling, export.

Each is a chain of DataFrame transformations; side effects happen only in the
``write_*`` functions at the end."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import scores, text, urls
from larkspur.operators import curate
from larkspur.operators.vectors import keyword_relevance, smoothed_rank
from larkspur.sources import html

# Related words of common topics.
EXPANSIONS = {
    "energy": ["power", "electricity", "grid", "oil", "gas", "solar", "wind"], "health": ["medicine", "clinical", "hospital", "drug", "patient"], "finance": ["market", "stock", "bank", "economy"],
    "law": ["court", "case", "legal", "judge", "bill"], "ai": ["machine learning", "model", "neural", "data"], "food": ["recipe", "cooking", "nutrition"], "politics": ["vote", "congress", "bill", "election"],
}


@dataclass
class Topic:
    """Keywords of a topic and the expression that searches for it."""

    name: str
    keywords: list[str] = field(default_factory=list)
    expression: str = ""


def analyse_topic(topic: str, most: int = 10) -> Topic:
    """Related words where the topic is known, else its own words with -s and -ing; an OR of the first ten."""
    words = text.query_terms(topic)
    related = [w for t in words for w in EXPANSIONS.get(t, [])]
    found = list(dict.fromkeys([*words, *(related or [w + end for w in words for end in ("s", "ing")])]))
    return Topic(topic, found, " OR ".join(f'"{w}"' if " " in w else w for w in found[:most]))


#: kind of source -> (template of its address, trust)
TEMPLATES = {
    "academic": ("https://export.arxiv.org/api/query?search_query=all:%s", 0.9), "repository": ("https://api.github.com/search/repositories?q=%s", 0.7), "government": ("https://api.federalregister.gov/v1/documents.json?conditions[term]=%s", 0.9),
    "news": ("https://news.google.com/rss/search?q=%s", 0.6), "video": ("https://www.youtube.com/results?search_query=%s", 0.5),
}


def generate_sources(spark: SparkSession, topic: Topic) -> DataFrame:
    """(kind, keyword, url, trust): every template with every keyword, from an array in each row."""
    kinds = spark.createDataFrame([(k, u, t, topic.keywords) for k, (u, t) in TEMPLATES.items()], "kind string, template string, trust double, keywords array<string>")
    return kinds.select("kind", F.explode("keywords").alias("keyword"), "template", "trust").select("kind", "keyword", F.replace("template", F.lit("%s"), F.url_encode("keyword")).alias("url"), "trust")


def source_trust(kind: Column, reachable: Column, feed_trust: Column) -> Column:
    """0.9 for an API, 0.7 for the releases of a repository that answers and 0.5 otherwise, else the feed's own trust."""
    return F.when(kind == "api", 0.9).when(kind == "repository", F.when(reachable, 0.7).otherwise(0.5)).otherwise(F.coalesce(feed_trust, F.lit(0.5)))


def relevance_default(samples: Column) -> Column:
    """Relevance of a feed where no model judges it: 0.3 without samples, else 0.5."""
    return F.when(F.size(samples) > 0, 0.5).otherwise(0.3)


def bootstrap(sources: DataFrame, topic: Topic, key: str, words: str, most: int = 1000, least: int = 10, cut: float = 0.3) -> DataFrame:
    """Sources that fit a topic: scored, cut at 0.3, re-ranked by the first ten strong ones, tiered, under quotas.

    ``sources`` has ``key``, the text column ``words``, ``kind`` and ``url``."""
    scored = sources.withColumn("relevance", F.round(keyword_relevance(F.col(words), topic.keywords), 6)).filter(F.col("relevance") >= cut)
    unique = curate.keep_first(scored.withColumn("norm", urls.normal_url(F.col("url"))), F.col("norm"), F.desc("relevance"), key)
    strong = unique.filter(F.col("relevance") > 0.6).orderBy(F.desc("relevance"), key).limit(10)
    ranked = unique.join(smoothed_rank(unique.select(key, words), strong.select(key, words), key, words), key)
    trusted = ranked.withColumn("trust", F.round(scores.clamp(0.6 * F.col("relevance") + 0.4 * F.col("score")), 6))
    return curate.tier_quota(trusted.withColumn("tier", scores.tier(F.col("kind"), F.col("trust"))), key, most, least)


def tier_feeds(feeds: DataFrame) -> DataFrame:
    """Feeds as the curation takes them, with defaults for what is missing."""
    blank = lambda c, default: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))
    return feeds.select("url", blank("title", "").alias("name"), blank("language", "en").alias("language"), blank("feed_type", "rss").alias("feed_type"), F.lit(2).alias("tier"), F.coalesce(F.col("quality_score") / 100, F.lit(0.5)).alias("trust_score"))


def seed_sets(feeds: DataFrame, per_language: int, size: int) -> DataFrame:
    """Up to ``per_language`` feeds of each known language in an order by hash, unique by address, ``size`` in all."""
    known = feeds.filter("language IS NOT NULL AND language NOT IN ('', 'unknown')").withColumn("norm", urls.normal_url(F.col("url"))).withColumn("draw", F.xxhash64("url", F.lit(7)))
    unique = curate.keep_first(known, F.col("norm"), "id")
    from pyspark.sql import Window as W

    return unique.withColumn("turn", F.row_number().over(W.partitionBy("language").orderBy("draw", "id"))).filter(F.col("turn") <= per_language).orderBy("turn", "language", "id").limit(size).drop("norm", "draw")


def crawl_order(pages: DataFrame, key: str, keywords: list[str], most: int) -> DataFrame:
    """Pages of each site by where they were found - list, sitemap, main page - and only the best kind there is; then the relevant ones, at most ``most`` a site.

    ``pages`` has ``key``, ``site``, ``origin``, ``url`` and ``page``."""
    from pyspark.sql import Window as W

    rank = F.when(F.col("origin") == "list", 1).when(F.col("origin") == "sitemap", 2).otherwise(3)
    best = pages.withColumn("rank", rank).withColumn("best", F.min("rank").over(W.partitionBy("site"))).filter("rank = best")
    read = best.withColumn("title", html.title(F.col("page"))).withColumn("content", html.content(F.col("page"), 500))
    low = F.lower(F.concat_ws(" ", "title", "content"))
    kept = read.filter(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w.lower())) for w in keywords[:10]], F.lit(not keywords)))
    return kept.withColumn("n", F.row_number().over(W.partitionBy("site").orderBy(key))).filter(F.col("n") <= most).select(key, "site", "origin", "url", "title", "content")


def digest(hits: DataFrame, k: int = 3) -> DataFrame:
    """The best hits as lines: title, snippet of 200 characters, address of 60."""
    top = hits.orderBy(F.desc("score"), "url").limit(k)
    return top.select(F.concat_ws(" - ", "title", text.truncate(F.col("snippet"), 200, "..."), F.concat(F.lit("<"), text.truncate(F.col("url"), 57, "..."), F.lit(">"))).alias("line"))


def video_rows(items: DataFrame) -> DataFrame:
    """Feed items of a video channel: id, title, description up to 2,000 characters, publication time."""
    return items.select(F.regexp_extract("guid", "([A-Za-z0-9_-]{11})$", 1).alias("video_id"), "title", F.substring("description", 1, 2000).alias("description"), scores.parse_date(F.col("published")).alias("published_at"), "link")


def channel_id(page: Column) -> Column:
    """A channel's id, wherever its page mentions it first."""
    found = [F.regexp_extract(page, p, 1) for p in (r'"channelId":"(UC[A-Za-z0-9_-]{22})"', r'"externalId":"(UC[A-Za-z0-9_-]{22})"', r"channel/(UC[A-Za-z0-9_-]{22})")]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])


def write_tiers(df: DataFrame, path: str) -> None:
    """Tiered feeds as JSON lines, one folder a tier."""
    df.write.mode("overwrite").partitionBy("tier").json(path)


def write_by(df: DataFrame, column: str, path: str) -> None:
    """JSON lines, one folder for each value of a column."""
    df.write.mode("overwrite").partitionBy(column).json(path)


def write_urls(df: DataFrame, column: str, path: str) -> None:
    """A text file of the valid addresses."""
    df.filter(F.col(column).rlike("^https?://")).select(F.col(column).alias("value")).write.mode("overwrite").text(path)
