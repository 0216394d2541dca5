"""Queries of source discovery and briefings: links of one site, sitemaps, result pages, names, topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import scores, text, urls
from larkspur.operators import vectors
from larkspur.plans.search import SQL as SEARCH_SQL
from larkspur.plans.search import documents, str10_specificity
from larkspur.session import table
from larkspur.sources import html

_PAGE = """concat('<a href="/news/', id, '">  One  <b>news</b></a><a href="https://', domain, '/view?id=', id, '">Two</a><a href="https://other.example/news/', id, '">Off</a><a href="/about">About</a>
<a href="/press/', id, '?x=1">Press</a><a href="/news/', id, '">Again</a><a href="list?seq=', id, '">Three</a>')"""


def _pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "feeds").selectExpr("id", "concat('https://', domain, '/') AS url", f"{_PAGE} AS page")


def htm06_articles(s: SparkSession, d: str) -> DataFrame:
    """Article-like links that stay on the page's host."""
    return html.article_links(_pages(s, d), "id", "page", "url")


def htm07_news(s: SparkSession, d: str) -> DataFrame:
    """Links with a news path that stay on the page's host, with their titles."""
    return html.news_links(_pages(s, d), "id", "page", "url")


def htm09_sitemaps(s: SparkSession, d: str) -> DataFrame:
    """An index of two sitemaps for each domain, followed to the pages."""
    f = table(s, d, "feeds").select("domain").distinct()
    index = f.selectExpr("concat('https://', domain, '/sitemap.xml') AS url", "concat('<sitemapindex><sitemap><loc>https://', domain, '/a.xml</loc></sitemap><sitemap><loc> https://', domain, '/b.xml </loc></sitemap></sitemapindex>') AS doc")
    leaves = [f.selectExpr(f"concat('https://', domain, '/{x}.xml') AS url", f"concat('<urlset><url><loc>https://', domain, '/{x}/1</loc></url><url><loc>https://', domain, '/{x}/2</loc></url></urlset>') AS doc") for x in "ab"]
    return html.sitemap_pages(index.unionByName(leaves[0]).unionByName(leaves[1]), "url", "doc")


def htm10_results(s: SparkSession, d: str) -> DataFrame:
    """Hits of result pages whose links redirect."""
    page = "concat('<a href=\"/settings\">Settings</a><a class=r href=\"//duck.example/l/?uddg=https%3A%2F%2F', domain, '%2Fp%3Fq%3D', id, '&amp;rut=1\">Hit <b>one</b></a><a href=\"https://', domain, '/two\">Two</a><a href=\"https://x.example\"></a>') AS page"
    hits = table(s, d, "feeds").selectExpr("id", page).select("id", F.posexplode(html.search_results(F.col("page"))).alias("pos", "h"))
    return hits.select("id", "pos", "h.url", "h.title")


def str29_source_names(s: SparkSession, d: str) -> DataFrame:
    """Publishers of addresses in two languages."""
    sites = ["https://www.korea.kr/x", "https://youtube.com/watch?v=1", "https://youtube.com/watch?v=2", "https://www.yna.co.kr/a", "https://hani.co.kr", "https://khan.co.kr", "https://news.chosun.com", "https://donga.com", "https://joongang.co.kr", "https://else.example"]
    url = F.get(F.array(*[F.lit(x) for x in sites]), (F.col("id") % 10).cast("int"))
    name = F.when(F.col("id") % 10 == 2, F.lit("")).otherwise(F.col("title"))
    return table(s, d, "feeds").select("id", urls.source_name(url, name).alias("en"), urls.source_name(url, name, "ko").alias("ko"))


def str11_specific(s: SparkSession, d: str) -> DataFrame:
    """Words of titles that are specific to few categories, and those never seen in any."""
    spec = str10_specificity(s, d)
    words = spec.select("kw").unionByName(s.createDataFrame([("neverseen",)], "kw string"))
    return vectors.filter_specific(words, spec, 0.5)


def flt12_topic_contains(s: SparkSession, d: str) -> DataFrame:
    """Documents of each topic by containment in either direction: a topic's word in a word of the text, or the reverse."""
    topics = {"health": ["trials", "dos"], "energy": ["grids", "kilowatt"], "law": ["court", "appeals"]}
    found = text.tokens(F.col("text"), 3)
    hit = lambda words: F.exists(found, lambda t: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w) | F.contains(w, t)))
    names = F.array_compact(F.array(*[F.when(hit(w), k) for k, w in topics.items()]))
    return documents(s, d).select("doc_id", F.explode(names).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def win09_first_three(s: SparkSession, d: str) -> DataFrame:
    """The first three events of each user and kind."""
    from pyspark.sql import Window as W

    e = table(s, d, "events").select("user_id", "event_type", "event_id", "ts")
    return e.withColumn("rn", F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))).filter("rn <= 3").select("user_id", "event_type", "event_id", F.col("rn").cast("bigint").alias("rn"))


def agg23_worst(s: SparkSession, d: str) -> DataFrame:
    """The state of each country's feeds as components, and the worst of them for each category."""
    one = table(s, d, "feeds").groupBy("category", "country").agg((F.count_if(F.col("status") == "active") / F.count(F.lit(1))).alias("up"))
    state = F.when(F.col("up") == 1, "healthy").when(F.col("up") >= 0.5, "degraded").otherwise("unhealthy")
    return one.groupBy("category").agg(text.worst_state(F.collect_set(state)).alias("state"), F.count(F.lit(1)).alias("n"))


def dat01_layouts(s: SparkSession, d: str) -> DataFrame:
    """Moments written in five layouts and read back."""
    t = F.from_unixtime(F.lit(1_700_000_000) + F.col("id") * 86_461, "yyyy-MM-dd HH:mm:ss").cast("timestamp")
    forms = [F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss +0000"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssXXX"), F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.date_format(t, "yyyy-MM-dd"), F.date_format(t, "MMM d, yyyy"), F.lit("soon")]
    text_ = F.get(F.array(*forms), (F.col("id") % 6).cast("int"))
    return table(s, d, "feeds").select("id", F.date_format(scores.parse_date(text_), "yyyy-MM-dd HH:mm:ss").alias("moment"))


def dat03_in_html(s: SparkSession, d: str) -> DataFrame:
    """The first possible date that stands in a page."""
    page = F.concat(F.lit("<p>v1.2 of "), F.get(F.array(F.lit("2024.3.9"), F.lit("2024-13-40"), F.lit("2023-11-05"), F.lit("none")), (F.col("id") % 4).cast("int")), F.lit("</p>"))
    return table(s, d, "feeds").select("id", F.date_format(scores.date_in_html(page), "yyyy-MM-dd").alias("day"))


def url05_resolved(s: SparkSession, d: str) -> DataFrame:
    """Relative links against a page's address."""
    href = F.get(F.array(F.lit("../x"), F.lit("/y?z=1"), F.lit("//cdn.example/a"), F.lit("https://b.example/c"), F.lit("?q=2")), (F.col("id") % 5).cast("int"))
    return table(s, d, "feeds").select("id", urls.resolve(F.concat(F.lit("https://"), F.col("domain"), F.lit("/p/q/r")), href).alias("url"))


def arr02_split(s: SparkSession, d: str) -> DataFrame:
    """Lists written with commas, trimmed, without empty parts, and a membership test that ignores case."""
    parts = text.split_list(F.concat(F.lit(" A, "), F.col("category"), F.lit(",, "), F.col("status"), F.lit(" ,")))
    return table(s, d, "feeds").filter("category IS NOT NULL AND status IS NOT NULL").select("id", F.array_join(parts, "|").alias("parts"), text.contains_folded(parts, F.lit("ACTIVE")).alias("active"))


def _typed_lists(s: SparkSession, d: str) -> DataFrame:
    """Keyword lists as people type them: mixed case, blanks, repeats, stop words, numbers."""
    raw = F.array(F.lit(" Grid "), F.lit("the"), F.lit("GRID"), F.lit(""), F.lit("2024"), F.col("category"), F.lit("x"), F.lit("Price"), F.upper("category"))
    return table(s, d, "feeds").filter("category IS NOT NULL").select("id", "category", raw.alias("raw"))


def str09_clean(s: SparkSession, d: str) -> DataFrame:
    """Keyword lists without stop words, numbers, blanks and repeats; order and first casing kept."""
    return _typed_lists(s, d).select("id", F.array_join(text.clean_keywords(F.col("raw"), F.lit("en")), "|").alias("kws"))


def str14_filter(s: SparkSession, d: str) -> DataFrame:
    """Keywords of two bytes and more that are not digits alone, the first five."""
    return _typed_lists(s, d).select("id", F.array_join(text.keyword_filter(F.col("raw"), 5), "|").alias("kws"))


def set05_merged(s: SparkSession, d: str) -> DataFrame:
    """Two keyword lists, the first's words first, without repeats under case."""
    first, then = F.array(F.lit("News"), F.col("category")), F.array(F.lit("NEWS"), F.lit("extra"), F.upper("category"))
    return _typed_lists(s, d).select("id", F.array_join(text.merge_keywords(first, then), "|").alias("kws"))


def str05_runs(s: SparkSession, d: str) -> DataFrame:
    """Runs of letters in titles, by how often they stand there."""
    return table(s, d, "feeds").select(F.explode(text.letter_runs(F.col("title"))).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def str19_plain(s: SparkSession, d: str) -> DataFrame:
    """Text written with tags, CDATA and entities, and made plain again."""
    raw = F.concat(F.lit("<![CDATA[<b>Feed</b>  &amp; co]]> <i>&#39;"), F.col("category"), F.lit("&#39;</i>\n &lt;x&gt; "))
    return table(s, d, "feeds").filter("category IS NOT NULL").select("id", text.strip_html(raw).alias("plain"))


def htm11_visible(s: SparkSession, d: str) -> DataFrame:
    """Text of pages without scripts, styles and furniture, and their main content."""
    page = F.concat(F.lit("<html><head><style>p{}</style></head><body><nav>Menu</nav><header>Top</header><article><p>Main "), F.col("id").cast("string"), F.lit("</p></article> <p>Side</p><script>var a=1</script><footer>End</footer></body></html>"))
    return table(s, d, "feeds").select("id", html.visible_text(page).alias("visible"), html.content(page).alias("main"))


QUERIES = {f.__name__: f for f in (str09_clean, str14_filter, set05_merged, str05_runs, str19_plain, htm11_visible, dat01_layouts, dat03_in_html, url05_resolved, arr02_split, htm06_articles, htm07_news, htm09_sitemaps, htm10_results, str29_source_names, str11_specific, flt12_topic_contains, win09_first_three, agg23_worst)}

_TOK3 = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'), lambda t: strlen(t) >= 3)"
SQL = {
    "str09_clean": "SELECT id, ' Grid |' || CASE WHEN lower(category) = 'other' THEN '' ELSE category || '|' END || 'Price' AS kws FROM feeds WHERE category IS NOT NULL",
    "str14_filter": "SELECT id, ' Grid |the|GRID|' || category || '|Price' AS kws FROM feeds WHERE category IS NOT NULL",
    "set05_merged": "SELECT id, 'News|' || CASE WHEN lower(category) = 'news' THEN '' ELSE category || '|' END || 'extra' AS kws FROM feeds WHERE category IS NOT NULL",
    "str05_runs": "SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(title, '')), '\\p{L}+')) AS run FROM feeds) GROUP BY run",
    "str19_plain": "SELECT id, 'Feed & co ' || chr(39) || category || chr(39) || ' <x>' AS plain FROM feeds WHERE category IS NOT NULL",
    "htm11_visible": "SELECT id, 'Main ' || id || ' Side' AS visible, 'Main ' || id AS main FROM feeds",
    "dat01_layouts": "SELECT id, CASE WHEN id % 6 = 5 THEN NULL WHEN id % 6 IN (3, 4) THEN strftime(make_timestamp((1700000000 + id * 86461) * 1000000), '%Y-%m-%d 00:00:00') ELSE strftime(make_timestamp((1700000000 + id * 86461) * 1000000), '%Y-%m-%d %H:%M:%S') END AS moment FROM feeds",
    "dat03_in_html": "SELECT id, CASE id % 4 WHEN 0 THEN '2024-03-09' WHEN 2 THEN '2023-11-05' END AS day FROM feeds",
    "url05_resolved": "SELECT id, CASE id % 5 WHEN 0 THEN 'https://' || domain || '/p/x' WHEN 1 THEN 'https://' || domain || '/y?z=1' WHEN 2 THEN 'https://cdn.example/a' WHEN 3 THEN 'https://b.example/c' ELSE 'https://' || domain || '/p/q/r?q=2' END AS url FROM feeds",
    "arr02_split": "SELECT id, 'A|' || category || '|' || status AS parts, lower(status) = 'active' OR lower(category) = 'active' AS active FROM feeds WHERE category IS NOT NULL AND status IS NOT NULL",
    "htm06_articles": "SELECT id, unnest(['https://' || domain || '/news/' || id, 'https://' || domain || '/view?id=' || id, 'https://' || domain || '/list?seq=' || id]) AS url FROM feeds",
    "htm07_news": "SELECT id, 'https://' || domain || '/news/' || id AS url, 'One news' AS title FROM feeds UNION ALL SELECT id, 'https://' || domain || '/press/' || id || '?x=1', 'Press' FROM feeds",
    "htm09_sitemaps": "SELECT 'https://' || domain || '/sitemap.xml' AS site, 'https://' || domain || p AS page FROM (SELECT DISTINCT domain FROM feeds), (VALUES ('/a/1'), ('/a/2'), ('/b/1'), ('/b/2')) v(p)",
    "htm10_results": "SELECT id, 0 AS pos, 'https://' || domain || '/p?q=' || id AS url, 'Hit one' AS title FROM feeds UNION ALL SELECT id, 1, 'https://' || domain || '/two', 'Two' FROM feeds",
    "str29_source_names": """SELECT id, CASE id % 10 WHEN 0 THEN 'Government Policy' WHEN 1 THEN coalesce(nullif(title, ''), 'YouTube') WHEN 2 THEN 'YouTube' WHEN 3 THEN 'Yonhap News' WHEN 4 THEN 'Hankyoreh' WHEN 5 THEN 'Kyunghyang' WHEN 6 THEN 'Chosun Ilbo' WHEN 7 THEN 'Donga Ilbo' WHEN 8 THEN 'JoongAng Ilbo' ELSE 'News' END AS en,
      CASE id % 10 WHEN 0 THEN '정책브리핑' WHEN 1 THEN coalesce(nullif(title, ''), '유튜브') WHEN 2 THEN '유튜브' WHEN 3 THEN '연합뉴스' WHEN 4 THEN '한겨레' WHEN 5 THEN '경향신문' WHEN 6 THEN '조선일보' WHEN 7 THEN '동아일보' WHEN 8 THEN '중앙일보' ELSE '뉴스' END AS ko FROM feeds""",
    "str11_specific": f"SELECT kw FROM ({SEARCH_SQL['str10_specificity']}) WHERE specificity >= 0.5 UNION ALL SELECT 'neverseen'",
    "flt12_topic_contains": f"""WITH t AS (SELECT doc_id, {_TOK3} AS t FROM documents), k(topic, w) AS (VALUES ('health', ['trials', 'dos']), ('energy', ['grids', 'kilowatt']), ('law', ['court', 'appeals']))
      SELECT topic, count(*) AS n FROM t, k WHERE len(list_filter(t, lambda x: len(list_filter(w, lambda y: contains(x, y) OR contains(y, x))) > 0)) > 0 GROUP BY topic""",
    "win09_first_three": "SELECT user_id, event_type, event_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 3",
    "agg23_worst": """WITH c AS (SELECT category, country, CASE WHEN count(*) FILTER (WHERE status = 'active') = count(*) THEN 0 WHEN count(*) FILTER (WHERE status = 'active') * 2 >= count(*) THEN 1 ELSE 2 END AS bad FROM feeds GROUP BY category, country)
      SELECT category, CASE max(bad) WHEN 0 THEN 'healthy' WHEN 1 THEN 'degraded' ELSE 'unhealthy' END AS state, count(*) AS n FROM c GROUP BY category""",
}
