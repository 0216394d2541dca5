"""A facade over tables in a folder: the tools a user calls by name.

Each tool takes plain arguments and gives a DataFrame (or, for settings, plain
values). Nothing here computes on its own; it puts operators together."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import lang, scores, text, urls
from larkspur.operators import curate, search, store, trends, vectors
from larkspur.operators.feedback import find_seeds
from larkspur.session import table
from larkspur.sources import apis, feeds, html


@dataclass
class Vertical:
    """A topic with its own tables: name, keywords, languages and settings."""

    name: str
    domain: str = ""
    description: str = ""
    keywords: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=lambda: ["en"])
    min_fit_percent: float = 30.0
    max_feeds: int = 1000
    min_feeds: int = 10
    prune_threshold: float = 0.3
    fetch_interval: str = "3h"
    enabled_apis: list[str] = field(default_factory=list)
    excluded_domains: list[str] = field(default_factory=list)


class Verticals:
    """Verticals kept as one JSON file each under a folder."""

    def __init__(self, folder: str):
        self.folder = folder
        self.current: str | None = None

    def _path(self, name: str) -> str:
        if not name or os.sep in name or name.startswith("."):
            raise ValueError(f"not a name for a vertical: {name!r}")
        return os.path.join(self.folder, name, "config.json")

    def create(self, v: Vertical) -> Vertical:
        if os.path.exists(self._path(v.name)):
            raise FileExistsError(v.name)
        os.makedirs(os.path.dirname(self._path(v.name)), exist_ok=True)
        return self.update(v)

    def update(self, v: Vertical) -> Vertical:
        with open(self._path(v.name), "w", encoding="utf-8") as f:
            json.dump(asdict(v), f, ensure_ascii=False, indent=1)
        return v

    def get(self, name: str) -> Vertical:
        with open(self._path(name), encoding="utf-8") as f:
            return Vertical(**json.load(f))

    def names(self) -> list[str]:
        if not os.path.isdir(self.folder):
            return []
        return sorted(n for n in os.listdir(self.folder) if os.path.exists(os.path.join(self.folder, n, "config.json")))

    def delete(self, name: str, confirm: bool = False) -> bool:
        """Removes the settings; only with ``confirm``."""
        if not confirm or name not in self.names():
            return False
        os.remove(self._path(name))
        return True

    def switch(self, name: str) -> Vertical:
        v = self.get(name)
        self.current = name
        return v


class Engine:
    """Tools over the tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def documents(self) -> DataFrame:
        d = self._table("documents")
        return d.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("title", F.substring_index("text", "\n", 1))

    # fetching: payloads in, rows out
    def fetch(self, payloads: DataFrame, source: str, **how) -> DataFrame:
        """Rows of one source from its payloads (``payload``)."""
        return apis.parse(payloads, source, **how)

    def fetch_group(self, payloads: DataFrame, group: str) -> DataFrame:
        """Rows counted by source, for a domain's sources."""
        return apis.parse_group(payloads, group)

    def feed_items(self, bodies: DataFrame, key: str, body: str = "body") -> DataFrame:
        return feeds.feed_items(bodies, key, body)

    # search
    def search(self, query: str, limit: int = 20, mode: str = "and", phrase: bool = False) -> DataFrame:
        """Documents by BM25; where all terms together match nothing, any term does."""
        d = self.documents()
        if phrase:
            d = search.match_phrase(d, query, "text")
        hits = search.bm25(d, "doc_id", "text", query, mode)
        if mode == "and" and hits.isEmpty():
            hits = search.bm25(d, "doc_id", "text", query, "or")
        top = search.exact_boost(hits, F.col("text"), query).orderBy(F.desc("raw_score"), "doc_id").limit(limit)
        return top.select("doc_id", "title", text.truncate(F.col("text"), 200, "...").alias("snippet"), "url", "source", "score")

    def semantic(self, vector: list[float], limit: int = 20) -> DataFrame:
        return search.nearest(self._table("embeddings"), "vec_id", "embedding", vector, limit)

    def hybrid(self, query: str, vector: list[float], limit: int = 20) -> DataFrame:
        """Both, three times over-fetched, fused by reciprocal ranks."""
        from pyspark.sql import Window as W

        ranked = lambda df, k: df.orderBy(F.desc("score"), k).limit(3 * limit).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), k))).select(F.col(k).alias("doc_id"), "rank")
        a = ranked(search.bm25(self.documents(), "doc_id", "text", query), "doc_id")
        b = ranked(self.semantic(vector, 3 * limit), "vec_id")
        return search.fuse(a, b, "doc_id").orderBy(F.desc("score"), "doc_id").limit(limit)

    def expand_query(self, seeds: list[str], rounds: int = 3) -> DataFrame:
        d = self.documents()
        return find_seeds(lambda terms: search.match_any(d, terms, "text"), seeds, "doc_id", "text", rounds)

    # judging
    def score_relevance(self, words: list[str], threshold: float = 0.3) -> DataFrame:
        d = self.documents().withColumn("score", F.round(vectors.keyword_relevance(F.col("text"), words), 6))
        found = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower("text"), F.lower(w))) if words else F.array().cast("array<string>")
        return d.select("doc_id", "score", (F.col("score") >= threshold).alias("relevant"), found.alias("matched_keywords"))

    def detect_language(self) -> DataFrame:
        t = F.col("text")
        r = self.documents().select("doc_id", lang.language_result(t).alias("r"), lang.languages_by_share(t).alias("shares"))
        return r.select("doc_id", F.when(F.col("r.confidence") < lang.LEAST_SURE, "unknown").otherwise(F.col("r.language")).alias("language"), "r.script", "r.confidence", "shares")

    def validate_feeds(self, bodies: DataFrame, body: str = "body") -> DataFrame:
        b = F.col(body)
        return bodies.withColumn("valid", feeds.usable(b)).withColumn("n_items", feeds.item_count(b))

    def validate_sources(self, least: float = 0.5) -> DataFrame:
        """Feeds with their trust and tier, best first."""
        f = self._table("feeds").withColumn("trust", scores.trust(F.col("source"), F.lit(0), F.lit(True), F.lit(2)))
        return f.withColumn("tier", scores.tier(F.col("source"), F.col("trust"), F.col("domain"), F.col("feed_type"))).filter(F.col("trust") >= least).orderBy(F.desc("trust"), "id")

    def discover(self, pages: DataFrame, key: str, page: str = "page") -> DataFrame:
        """Feeds that pages announce, one row each."""
        return pages.select(key, F.explode(html.feed_links(F.col(page))).alias("href"))

    def classify_feeds(self) -> DataFrame:
        f = self._table("feeds")
        domain = urls.bare_domain(F.col("url"))
        return f.select("id", domain.alias("domain"), urls.country(domain).alias("country"), urls.category(F.concat_ws(" ", domain, F.col("title"))).alias("category"), urls.domain_quality(domain).alias("quality"))

    # curation
    def auto_curate(self, most: int = 1000, least: int = 10) -> DataFrame:
        f = self.validate_sources(0.0)
        unique = curate.keep_first(f.withColumn("norm", urls.normal_url(F.col("url"))), F.col("norm"), "id").drop("norm")
        return curate.tier_quota(unique, "id", most, least)

    def seeds(self, target: int) -> DataFrame:
        return curate.round_robin(self._table("feeds").filter("category IS NOT NULL"), "category", "id", target)

    # briefings
    def trends(self, previous: str, since: str, until: str, k: int = 20) -> dict[str, DataFrame]:
        rows = trends.windowed(self.documents(), "created_at", previous, since, until)
        counts = trends.counts_by_window(rows, trends.trend_keywords(F.col("text")))
        return {"hot": trends.hot(counts, k), "burst": trends.bursts(counts, k), "emerging": trends.emerging(rows, F.col("text"), k), "by_source": trends.matrix(rows, "source", trends.trend_keywords(F.col("text")))}

    def generate_briefing(self, since: str, limit: int = 10) -> str:
        """The newest documents since a moment, as Markdown; at most ``limit`` rows come to the driver."""
        d = self.documents().filter(F.col("created_at") > F.lit(since).cast("timestamp")).orderBy(F.desc("created_at"), "doc_id").limit(limit)
        lines = [f"- **{r['source'] or 'Unknown'}**: {r['title'][:200]}" for r in d.select("source", "title").collect()]
        return "\n".join(["# Briefing", "", *lines]) if lines else "# Briefing\n\nNothing new."

    def stats(self) -> DataFrame:
        return store.group_stats(self._table("feeds"), ["language", "country", "category", "status", "feed_type"])

    def health(self) -> DataFrame:
        """Which tables can be read, and whether they hold rows."""
        rows = []
        for name in ("documents", "feeds", "embeddings"):
            try:
                rows.append((name, "healthy" if not self._table(name).limit(1).isEmpty() else "degraded"))
            except Exception as e:  # noqa: BLE001 - a missing table is the finding
                rows.append((name, f"unhealthy: {type(e).__name__}"))
        return self.spark.createDataFrame(rows, "component string, state string")
