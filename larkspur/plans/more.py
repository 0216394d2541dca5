"""Further queries: extraction, filters, set operations, health, round trips of payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larkspur.functions import scores, text, urls
from larkspur.operators import curate, search
from larkspur.plans.search import documents
from larkspur.session import table
from larkspur.sources import apis, feeds, html

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_D = "d AS (SELECT doc_id, coalesce(text, '') AS text, split_part(coalesce(text, ''), chr(10), 1) AS title, source, lang, feed_id, created_at FROM documents)"


# ---- payloads: tables packed into an API's form and read back ----
@query("SELECT DISTINCT nct_id, coalesce(title, '') AS title, coalesce(sponsor, '') AS sponsor, coalesce(brief_summary, '') AS brief_summary FROM clinical_trials")
def src01_trials(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "clinical_trials").groupBy("nct_id").agg(*[F.coalesce(F.max(c), F.lit("")).alias(c) for c in ("title", "sponsor", "brief_summary")])
    study = F.struct(
        F.struct(
            F.struct(F.col("nct_id").alias("nctId"), F.col("title").alias("briefTitle"), F.struct(F.col("sponsor").alias("fullName")).alias("organization")).alias("identificationModule"),
            F.struct(F.col("brief_summary").alias("briefSummary")).alias("descriptionModule"),
        ).alias("protocolSection")
    )
    return apis.parse(t.select(F.to_json(F.struct(F.array(study).alias("studies"))).alias("payload")), "clinical_trials").select("nct_id", "title", "sponsor", "brief_summary")


@query("SELECT DISTINCT case_id, case_name, court, coalesce(snippet, '') AS snippet FROM (SELECT 'cl_' || regexp_extract(case_id, '[0-9]+') AS case_id, case_name, court, snippet FROM legal_cases)")
def src11_cases(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "legal_cases").select(F.regexp_extract("case_id", "[0-9]+", 0).cast("bigint").alias("id"), F.col("case_name").alias("caseName"), "court", F.coalesce("snippet", F.lit("")).alias("snippet"))
    return apis.parse(t.select(F.to_json(F.struct(F.array(F.struct("*")).alias("results"))).alias("payload")), "court_cases").select("case_id", "case_name", "court", "snippet")


@query("SELECT DISTINCT ON (series_id, period) series_id, period, count(*) OVER (PARTITION BY series_id, period) AS n FROM eia_series WHERE series_id IS NOT NULL AND period IS NOT NULL")
def src26_eia(s: SparkSession, d: str) -> DataFrame:
    """Monthly series read from their payloads: one row for each key, with its number of records."""
    t = table(s, d, "eia_series")
    point = F.struct("period", "value", F.col("series_id").alias("series-id"), F.col("name").alias("product-name"), "units")
    rows = apis.parse(t.select("id", F.to_json(F.struct(F.struct(F.array(point).alias("data")).alias("response"))).alias("payload")), "eia_series", keep=("id",))
    return rows.groupBy("series_id", "period").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT country_code, timestamp::VARCHAR AS timestamp, load_mw FROM (SELECT country_code, strptime(timestamp, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, max(load_mw) AS load_mw FROM entsoe_load WHERE load_mw IS NOT NULL GROUP BY ALL)")
def src33_load(s: SparkSession, d: str) -> DataFrame:
    """Grid load written as one XML document for each quarter hour and read back; times come from start and position."""
    t = table(s, d, "entsoe_load").filter("load_mw IS NOT NULL").groupBy("country_code", "timestamp").agg(F.max("load_mw").alias("load_mw"))
    start = F.concat(F.substring("timestamp", 1, 16), F.lit("Z"))
    xml = F.concat(F.lit("<GL_MarketDocument><TimeSeries><Period><timeInterval><start>"), start, F.lit("</start></timeInterval><Point><position>1</position><quantity>"), F.col("load_mw").cast("string"), F.lit("</quantity></Point></Period></TimeSeries></GL_MarketDocument>"))
    rows = apis.parse(t.select("country_code", xml.alias("payload")), "entsoe_load", keep=("country_code",))
    return rows.select("country_code", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "load_mw")


@query("SELECT DISTINCT vote_id, question, total_yes, total_no FROM congress_votes")
def src42_votes(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "congress_votes")
    vote = F.struct("congress", "session", "chamber", "roll_call", "question", F.struct(F.col("total_yes").alias("yes"), F.col("total_no").alias("no")).alias("total"))
    payload = F.to_json(F.struct(F.struct(F.struct(vote.alias("vote")).alias("votes")).alias("results")))
    return apis.parse(t.select(payload.alias("payload")), "congress_votes").select("vote_id", "question", "total_yes", "total_no")


def _rss(s: SparkSession, d: str) -> DataFrame:
    """Titles of each feed category's documents as one RSS text for each document."""
    docs = documents(s, d).select("doc_id", F.regexp_replace(F.regexp_replace("title", "&", "&amp;"), "<", "&lt;").alias("t"))
    return docs.select("doc_id", F.concat(F.lit("<rss><channel><title>c</title><item><title>"), F.col("t"), F.lit("</title><link>https://x.example/"), F.col("doc_id").cast("string"), F.lit("</link></item></channel></rss>")).alias("body"))


@query(f"WITH {_D} SELECT doc_id, nullif(trim(title, ' ' || chr(9) || chr(13)), '') AS title, 'https://x.example/' || doc_id AS link FROM d")
def src48_rss(s: SparkSession, d: str) -> DataFrame:
    """Every document's title packed into an RSS feed and read back."""
    return feeds.feed_items(_rss(s, d), "doc_id", "body").select("doc_id", "title", "link")


@query(f"""WITH {_D} SELECT doc_id % 4 AS form, doc_id % 4 < 3 AS is_feed, CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END::BIGINT AS n_items, count(*) AS n FROM d GROUP BY ALL""")
def flt16_feed_marks(s: SparkSession, d: str) -> DataFrame:
    """Texts in three feed formats and as pages, told apart by their marks, with their items."""
    t = F.regexp_replace(F.regexp_replace("title", "&", "&amp;"), "<", "&lt;")
    rss = F.concat(F.lit("<?xml version='1.0'?><RSS><channel><item><title>"), t, F.lit("</title></item><item><title>b</title></item></channel></RSS>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>'), t, F.lit("</title></entry></feed>"))
    rdf = F.concat(F.lit("<rdf:RDF><channel/><item><title>"), t, F.lit("</title></item></rdf:RDF>"))
    page = F.concat(F.lit("<html><body><p>"), t, F.lit("</p></body></html>"))
    x = documents(s, d).select((F.col("doc_id") % 4).alias("form"), F.get(F.array(rss, atom, rdf, page), (F.col("doc_id") % 4).cast("int")).alias("body"))
    return x.groupBy("form", feeds.looks_like_feed(F.col("body")).alias("is_feed"), feeds.item_count(F.col("body")).cast("bigint").alias("n_items")).agg(F.count(F.lit(1)).alias("n"))


def _pages(s: SparkSession, d: str) -> DataFrame:
    docs = documents(s, d)
    body = F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;")
    head = F.regexp_replace(F.regexp_replace("title", "&", "&amp;"), "<", "&lt;")
    return docs.select("doc_id", "text", "title", F.concat(F.lit("<html><head><title>site</title><script>x<1</script></head><body><nav>menu</nav><h1>"), head, F.lit("</h1><article><p>"), body, F.lit("</p></article><a href='/more?id="), F.col("doc_id").cast("string"), F.lit("'>more</a></body></html>")).alias("page"))


@query(f"WITH {_D} SELECT doc_id, '/more?id=' || doc_id AS href, 'more' AS label FROM d")
def htm05_links(s: SparkSession, d: str) -> DataFrame:
    return html.links(_pages(s, d), "doc_id", "page").select("doc_id", "href", F.col("text").alias("label"))


@query(f"WITH {_D} SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[\\s\\x{{00A0}}\\x{{3000}}\\x{{2028}}\\x{{0085}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}]+'), lambda x: x <> ''), ' ')  AS content FROM d")
def htm02_content(s: SparkSession, d: str) -> DataFrame:
    """Main content of pages made of every document, white space squeezed."""
    return _pages(s, d).select("doc_id", html.content(F.col("page"), 1_000_000).alias("content"))


# ---- filters, joins and sets ----
@query(f"WITH {_D} SELECT doc_id FROM d WHERE contains(lower(text), 'trial') OR contains(lower(text), 'grid') OR contains(lower(text), 'reservoir')")
def flt07_any_keyword(s: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    return documents(s, d).filter(F.exists(F.array(*[F.lit(w) for w in ("trial", "grid", "reservoir")]), lambda w: F.contains(low, w))).select("doc_id")


@query("WITH t(topic, kw) AS (VALUES ('health', 'trial'), ('health', 'dose'), ('energy', 'grid'), ('law', 'reservoir')), h AS (SELECT DISTINCT topic, d.doc_id FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'))) AS kw FROM documents) d JOIN t USING (kw)) SELECT topic, count(*) AS n FROM h GROUP BY topic")
def flt12_topic_match(s: SparkSession, d: str) -> DataFrame:
    """Documents of each topic: an equi-join of their distinct words with the topics' words."""
    topics = s.createDataFrame([("health", "trial"), ("health", "dose"), ("energy", "grid"), ("law", "reservoir")], "topic string, kw string")
    words = documents(s, d).select("doc_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("kw"))
    return words.join(F.broadcast(topics), "kw").select("topic", "doc_id").distinct().groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT d.doc_id, coalesce(f.title, 'Unknown') AS feed FROM documents d LEFT JOIN feeds f ON d.feed_id = f.id ORDER BY d.created_at DESC, d.doc_id LIMIT 50")
def flt17_recent(s: SparkSession, d: str) -> DataFrame:
    """The fifty newest documents with the name of their feed: the limit is taken before the join."""
    top = table(s, d, "documents").select("doc_id", "feed_id", "created_at").orderBy(F.desc("created_at"), "doc_id").limit(50)
    f = table(s, d, "feeds").select(F.col("id").alias("feed_id"), "title")
    return top.join(f, "feed_id", "left").select("doc_id", F.coalesce("title", F.lit("Unknown")).alias("feed"))


@query("WITH t AS (SELECT title, extract('year' FROM min(created_at) OVER (PARTITION BY title)) AS y FROM clinical_trials WHERE title IS NOT NULL) SELECT DISTINCT title FROM t WHERE title NOT IN (SELECT title FROM pubmed_articles WHERE title IS NOT NULL)")
def set08_difference(s: SparkSession, d: str) -> DataFrame:
    a, b = table(s, d, "clinical_trials").select("title").dropna(), table(s, d, "pubmed_articles").select("title").dropna()
    return a.distinct().join(b.distinct(), "title", "left_anti")


@query("SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(coalesce(title, '')), '[\\p{L}\\p{N}]+')) AS w FROM clinical_trials) JOIN (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(title, '')), '[\\p{L}\\p{N}]+')) AS w FROM pubmed_articles) USING (w)")
def set07_intersection(s: SparkSession, d: str) -> DataFrame:
    words = lambda t: table(s, d, t).select(F.explode(text.tokens(F.col("title"))).alias("w")).distinct()
    return words("clinical_trials").join(words("pubmed_articles"), "w")


@query("WITH f AS (SELECT id, domain, quality_score FROM feeds), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY quality_score DESC NULLS LAST, id) AS rn FROM f) SELECT domain, id FROM r WHERE rn = 1")
def top03_best_of_key(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "feeds").select("id", "domain", "quality_score")
    return curate.keep_first(f, F.col("domain"), F.desc_nulls_last("quality_score"), "id").select("domain", "id")


@query(f"WITH {_D}, w AS (SELECT source, lower(w) AS w, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(text, '[0-9A-Za-z_]+')) AS w FROM d) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS rn FROM w) SELECT source, w, n FROM r WHERE rn <= 5")
def win04_top_words(s: SparkSession, d: str) -> DataFrame:
    w = documents(s, d).select("source", F.explode(text.words(F.col("text"))).alias("w")).groupBy("source", F.lower("w").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.withColumn("rn", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), "w"))).filter("rn <= 5").drop("rn")


# ---- health, samples ----
@query("WITH h AS (SELECT status, count(*) AS n FROM feeds GROUP BY status) SELECT CASE WHEN sum(n) FILTER (WHERE status = 'active') = sum(n) THEN 'healthy' WHEN sum(n) FILTER (WHERE status = 'active') * 2 >= sum(n) THEN 'degraded' ELSE 'unhealthy' END AS state, sum(n)::BIGINT AS n FROM h")
def agg23_health(s: SparkSession, d: str) -> DataFrame:
    h = table(s, d, "feeds").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "active").alias("up"))
    return h.select(F.when(F.col("up") == F.col("n"), "healthy").when(F.col("up") * 2 >= F.col("n"), "degraded").otherwise("unhealthy").alias("state"), "n")


@query(f"WITH {_D} SELECT source, round(avg((contains(lower(text), 'trial')::INT + contains(lower(text), 'dose')::INT + contains(lower(text), 'grid')::INT) / 3.0), 6) AS fit FROM d GROUP BY source")
def agg20_quick_check(s: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    hits = sum((F.contains(low, F.lit(w)).cast("int") for w in ("trial", "dose", "grid")), F.lit(0))
    return documents(s, d).groupBy("source").agg(F.round(F.avg(hits / 3.0), 6).alias("fit"))


@query(f"WITH {_D} SELECT doc_id, round(length(text) / 150.0 * 60, 6) AS seconds FROM d")
def dat04_reading_time(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select("doc_id", F.round(scores.reading_seconds(F.col("text")), 6).alias("seconds"))


@query("SELECT id, 'https://' || domain || path AS candidate FROM feeds, (VALUES ('/feed'), ('/rss'), ('/rss.xml'), ('/feed.xml'), ('/atom.xml'), ('/index.xml'), ('/feeds'), ('/blog/feed')) p(path)")
def dsc02_candidates(s: SparkSession, d: str) -> DataFrame:
    """Addresses to probe for each domain, as an array in its row and not as a join."""
    return table(s, d, "feeds").select("id", F.explode(html.feed_candidates(F.col("domain"))).alias("candidate"))


@query("""SELECT id, CASE id % 8 WHEN 0 THEN 'https://a' || id || '.blogspot.com/feeds/posts/default' WHEN 1 THEN 'https://medium.com/feed/a' || id WHEN 2 THEN 'https://a' || id || '.substack.com/feed' WHEN 3 THEN 'https://a' || id || '.wordpress.com/feed/'
  WHEN 4 THEN 'https://a' || id || '.tistory.com/rss' WHEN 5 THEN 'https://rss.blog.naver.com/a' || id || '.xml' WHEN 6 THEN 'https://a' || id || '.ghost.io/rss/' ELSE regexp_replace(url, '/$', '') || '/feed' END AS guess FROM feeds""")
def url09_guess(s: SparkSession, d: str) -> DataFrame:
    """Feed addresses of sites on seven platforms and on their own."""
    name = F.concat(F.lit("a"), F.col("id").cast("string"))
    sites = ["https://%s.blogspot.com/2024/post.html", "https://medium.com/%s/", "https://%s.substack.com/p/one", "https://%s.wordpress.com/", "https://%s.tistory.com/17", "https://blog.naver.com/%s/22?x=1", "https://%s.ghost.io"]
    site = F.get(F.array(*[F.replace(F.lit(x), F.lit("%s"), name) for x in sites], F.col("url")), (F.col("id") % 8).cast("int"))
    return table(s, d, "feeds").select("id", urls.guess_rss(site).alias("guess"))


@query("""SELECT id, CASE id % 7 WHEN 0 THEN 'channel' WHEN 1 THEN 'user' WHEN 2 THEN 'handle' WHEN 3 THEN 'playlist' WHEN 4 THEN 'video' WHEN 5 THEN 'custom' END AS kind,
  CASE id % 7 WHEN 0 THEN 'UC' || lpad(id::VARCHAR, 22, 'x') WHEN 1 THEN 'u' || id WHEN 2 THEN 'h' || id WHEN 3 THEN 'PL' || id WHEN 4 THEN lpad(id::VARCHAR, 11, 'v') WHEN 5 THEN 'c' || id END AS ident FROM feeds""")
def url10_video_kind(s: SparkSession, d: str) -> DataFrame:
    """Kinds and ids of video links, read back from links built of the ids."""
    n = F.col("id").cast("string")
    links = [F.concat(F.lit("https://www.youtube.com/channel/UC"), F.lpad(n, 22, "x")), F.concat(F.lit("https://youtube.com/user/u"), n), F.concat(F.lit("https://www.youtube.com/@h"), n), F.concat(F.lit("https://www.youtube.com/playlist?list=PL"), n), F.concat(F.lit("https://youtu.be/"), F.lpad(n, 11, "v")), F.concat(F.lit("https://www.youtube.com/c/c"), n), F.lit("https://example.org/watch")]
    kind = F.split(urls.video_kind(F.get(F.array(*links), (F.col("id") % 7).cast("int"))), ":")
    return table(s, d, "feeds").select("id", F.get(kind, F.lit(0)).alias("kind"), F.get(kind, F.lit(1)).alias("ident"))


@query("SELECT source, count(*) AS n FROM (SELECT coalesce(source, 'Unknown') AS source FROM documents) GROUP BY source ORDER BY n DESC, source LIMIT 10")
def brf01_summary(s: SparkSession, d: str) -> DataFrame:
    """The ten largest sources of a briefing."""
    return documents(s, d).groupBy(F.coalesce("source", F.lit("Unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query(f"""WITH {_D}, w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '[\\s\\p{{Zs}}]+', ' ', 'g')), ' ') AS w FROM d),
p AS (SELECT doc_id, w, list_position(list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), 'reservoir') AS pos FROM w), q AS (SELECT *, greatest(pos - 20, 1) AS start FROM p WHERE pos > 0)
SELECT doc_id, CASE WHEN start > 1 THEN '...' ELSE '' END || regexp_replace(array_to_string(w[start:start + 63], ' '), '(?i)(reservoir)', '<mark>\\1</mark>', 'g') || CASE WHEN len(w) >= start + 64 THEN '...' ELSE '' END AS snippet FROM q""")
def fts06_snippet(s: SparkSession, d: str) -> DataFrame:
    """Up to 64 words around the first hit of a query word, hits marked."""
    words = F.split(text.squeeze(F.col("text")), " ")
    hits = documents(s, d).filter(F.contains(F.lower("text"), F.lit("reservoir"))).withColumn("w", words)
    at = F.array_position(F.transform("w", lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")), F.lit("reservoir")).cast("int")
    start = F.greatest(F.col("at") - 20, F.lit(1))
    whole = F.concat(F.when(start > 1, "...").otherwise(""), text.highlight(F.array_join(F.slice("w", start, 64), " "), "reservoir"), F.when(F.size("w") >= start + 64, "...").otherwise(""))
    return hits.withColumn("at", at).filter("at > 0").select("doc_id", whole.alias("snippet"))
