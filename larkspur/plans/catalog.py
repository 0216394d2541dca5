"""Queries of columns, joins, aggregates, windows and keyed tables with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larkspur.functions import lang, scores, text, urls
from larkspur.operators import curate, store
from larkspur.plans.search import documents
from larkspur.session import table
from larkspur.streaming import metrics

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
_RANGES = {k: f"length(regexp_replace(text, '[^{r}]', '', 'g'))" for k, r in lang.SCRIPTS.items()}
_S = "s AS (SELECT *, " + ", ".join(f"{v} AS n_{k}" for k, v in _RANGES.items()) + " FROM d)"
_MOST = "greatest(" + ", ".join(f"n_{k}" for k in _RANGES) + ")"
_DOM = "CASE " + " ".join(f"WHEN n_{k} = {_MOST} AND {_MOST} > 0 THEN '{k}'" for k in _RANGES) + " END"


# ---- URLs ----
@query("SELECT id, lower(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '^[^@]*@', '')) AS host FROM feeds")
def url01_host(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "feeds").select("id", urls.host(F.col("url")).alias("host"))


#: endings given to the feed domains in turn, with country and language as a plain list
_ENDINGS = [("co.kr", "kr", "ko"), ("or.jp", "jp", "ja"), ("com.br", "br", "pt"), ("pl", "pl", "pl"), ("se", "se", "sv"), ("ch", "ch", "de"), ("com.sg", "sg", "en"), ("com.tr", "tr", "tr"), ("co.za", "za", "en"), ("ua", "ua", "uk"), ("org", "global", "en"), ("io", "global", "en"), ("example", "unknown", "unknown"), ("com.co", "co", "es"), ("co.il", "il", "he"), ("CO.UK", "uk", "en")]


@query("SELECT id, e[1 + id % 16].c AS country, e[1 + id % 16].l AS language FROM feeds, (SELECT [" + ", ".join(f"{{'c': '{c}', 'l': '{x}'}}" for _, c, x in _ENDINGS) + "] AS e)")
def url02_country(s: SparkSession, d: str) -> DataFrame:
    """Country and language of domains with endings of many kinds."""
    ending = F.get(F.array(*[F.lit(e) for e, _, _ in _ENDINGS]), (F.col("id") % len(_ENDINGS)).cast("int"))
    host = F.concat(F.regexp_extract("domain", r"^([^.]+)", 1), F.lit("."), ending)
    c = urls.country(host)
    return table(s, d, "feeds").select("id", c.alias("country"), urls.country_language(c).alias("language"))


@query("SELECT id, regexp_replace(regexp_replace(regexp_replace(lower(url), '/$', ''), '^https?://', ''), '^www\\.', '') AS norm FROM feeds")
def url04_normalise(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "feeds").select("id", urls.normal_url(F.col("url")).alias("norm"))


@query("""SELECT category, count(*) AS n FROM (SELECT CASE
  WHEN regexp_matches(x, 'news|noticias|nachrichten|actualite|nyheter|nyhet|nieuws|wiadomosci|zpravy|noviny|novosti|뉴스|ニュース|新闻') THEN 'news'
  WHEN regexp_matches(x, 'tech|digital|cyber|software|hardware|gadget|geek|nerd|coding|developer|programming|ai|ml|cloud|startup|テック|科技|테크|tecnologia') THEN 'tech'
  WHEN regexp_matches(x, 'finance|finanz|financial|money|invest|stock|market|economy|economic|business|bank|trading|crypto|bitcoin|経済|财经|금융|경제') THEN 'finance'
  WHEN regexp_matches(x, 'sport|football|soccer|basketball|baseball|tennis|golf|nfl|nba|mlb|espn|スポーツ|体育|스포츠') THEN 'sports'
  WHEN regexp_matches(x, 'entertainment|movie|film|music|celebrity|tv|television|drama|anime|manga|game|gaming|エンタメ|娱乐|연예') THEN 'entertainment'
  WHEN regexp_matches(x, 'science|research|scientific|nature|biology|physics|chemistry|space|nasa|科学|과학') THEN 'science'
  WHEN regexp_matches(x, 'health|medical|medicine|doctor|hospital|wellness|fitness|diet|nutrition|健康|건강') THEN 'health'
  WHEN regexp_matches(x, 'politic|government|election|vote|congress|parliament|minister|president|政治|정치') THEN 'politics'
  WHEN regexp_matches(x, 'blog|wordpress|medium|substack|tumblr|tistory|note\\.com') THEN 'blog' WHEN regexp_matches(x, 'youtube\\.com|youtu\\.be') THEN 'youtube' ELSE 'other' END AS category
FROM (SELECT lower(url || ' ' || coalesce(title, '')) AS x FROM feeds)) GROUP BY category""")
def url07_category(s: SparkSession, d: str) -> DataFrame:
    """Categories by the words of addresses and titles."""
    return table(s, d, "feeds").groupBy(urls.category(F.concat_ws(" ", "url", "title")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, CASE WHEN domain = 'grid.example' OR domain LIKE '%.grid.example' THEN 'premium' WHEN contains(domain, 'blogspot.com') OR contains(domain, 'wordpress.com') OR contains(domain, 'medium.com') OR contains(domain, 'substack.com') OR contains(domain, 'tumblr.com') OR contains(domain, 'blogger.com') OR contains(domain, 'tistory.com') OR contains(domain, 'note.com') THEN 'blog' ELSE 'standard' END AS quality FROM feeds")
def url08_quality(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "feeds").select("id", urls.domain_quality(F.col("domain"), ("grid.example",)).alias("quality"))


# ---- languages ----
@query(f"WITH {_D}, {_S} SELECT script, count(*) AS n FROM (SELECT {_DOM} AS script FROM s) GROUP BY script")
def lng01_scripts(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).groupBy(lang.dominant_script(F.col("text")).alias("script")).agg(F.count(F.lit(1)).alias("n"))


_TOTAL = " + ".join(f"n_{k}" for k in _RANGES)
_LANG2 = f"CASE WHEN strlen(text) < 3 OR script IS NULL THEN 'unknown' WHEN script = 'han' THEN CASE WHEN n_hiragana + n_katakana > 0.05 * ({_TOTAL}) THEN 'ja' ELSE 'zh' END " + " ".join(f"WHEN script = '{k}' THEN '{v}'" for k, v in lang.SCRIPT_LANGUAGE.items()) + " ELSE 'latin' END"


@query(f"WITH {_D}, {_S} SELECT lang, detected, count(*) AS n FROM (SELECT lang, {_LANG2} AS detected FROM (SELECT *, {_DOM} AS script FROM s)) GROUP BY ALL")
def lng02_language(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).groupBy("lang", lang.script_language(F.col("text")).alias("detected")).agg(F.count(F.lit(1)).alias("n"))


#: the rules of the Latin-script languages as SQL; letters and weights are stated here once more, on purpose
_LETTERS_SQL = "CASE WHEN length(regexp_replace(low, '[^ăâđêôơưảạấầẩẫậắằẳẵặảẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữự]', '', 'g')) >= 2 THEN 'vi' WHEN length(regexp_replace(low, '[^ğışçöüİ]', '', 'g')) >= 2 THEN 'tr' WHEN length(regexp_replace(low, '[^ąćęłńśźż]', '', 'g')) >= 2 THEN 'pl' WHEN length(regexp_replace(low, '[^åäö]', '', 'g')) >= 2 THEN 'sv' END"
_TRIPLES_SQL = {
    "en": "the 15 ing 10 ght 8 tha 7 nth 6 thi 6 ith 6 fth 5 his 5 whi 5 whe 5 hin 5 hat 5 ome 4 ble 4 eve 4 nce 4 ake 4",
    "de": "sch 15 ich 12 ein 10 und 10 der 9 die 9 ung 8 cht 8 den 7 ber 7 eit 7 auf 6 aus 6 mit 6 das 6 ist 6 gen 5 nen 5 ern 5 ach 5",
    "fr": "ait 12 eux 10 ais 9 ous 9 oir 8 eau 8 lle 7 que 7 tre 7 our 6 eur 6 aux 6 ent 6 pas 6 ien 5 eme 5 omm 5 est 5 sse 5 rai 5",
    "es": "ado 12 ión 10 los 9 las 9 nte 8 aci 8 que 7 ndo 7 sta 6 ent 6 tra 6 una 5 ara 5 era 5 ido 5",
    "pt": "ção 15 ões 12 ndo 8 ado 8 nte 7 que 7 uma 6 ara 6 dos 6 das 6 por 5 com 5 ser 5 ais 5 ica 5",
    "it": "zio 15 gli 12 tti 10 ell 9 lla 8 ato 8 che 7 one 7 ita 6 ere 6 nti 6 ess 5 per 5 ono 5 ano 5",
    "nl": "aar 12 oor 10 een 9 het 9 van 8 ijn 8 erd 7 aan 7 wor 6 cht 6 eer 6 ond 5 gel 5 ste 5 oel 5",
}
_WORDS_SQL = {
    "en": "the and of to in is that for with was", "de": "der die und das ist nicht mit von für den", "fr": "le la les des et est une dans pour que", "es": "el los las una del en por que con para",
    "it": "il che di non per della sono gli una con", "pt": "os não uma com para dos que mais por em", "nl": "het een van niet voor dat met zijn op aan",
}


def _latin_sql() -> str:
    triples = ", ".join(f"('{k}', '{g}', {w})" for k, v in _TRIPLES_SQL.items() for g, w in zip(v.split()[::2], v.split()[1::2]))
    words = ", ".join(f"('{k}', '{w}')" for k, v in _WORDS_SQL.items() for w in v.split())
    order = ", ".join(f"('{k}', {i})" for i, k in enumerate(_TRIPLES_SQL))
    return f"""WITH {_D}, l AS (SELECT doc_id, lang, lower(text) AS low FROM d), g(k, g, w) AS (VALUES {triples}), v(k, word) AS (VALUES {words}), o(k, i) AS (VALUES {order}),
runs AS (SELECT doc_id, unnest(regexp_extract_all(low, '\\p{{L}}{{3,}}')) AS run FROM l),
t AS (SELECT doc_id, substr(run, i, 3) AS tri, count(*) AS n FROM (SELECT doc_id, run, unnest(generate_series(1, length(run) - 2)) AS i FROM runs) GROUP BY ALL),
ts AS (SELECT doc_id, k, sum(n * w) AS s FROM t JOIN g ON g = tri GROUP BY ALL),
ws AS (SELECT doc_id, k, 3 * count(*) AS s FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(low, '\\p{{L}}+')) AS word FROM l) JOIN v USING (word) GROUP BY ALL),
sc AS (SELECT doc_id, k, i, coalesce(ts.s, 0) + coalesce(ws.s, 0) AS s FROM l CROSS JOIN o LEFT JOIN ts USING (doc_id, k) LEFT JOIN ws USING (doc_id, k)),
b AS (SELECT doc_id, arg_max(k, s * 100 - i) AS best, max(s) AS most FROM sc GROUP BY doc_id)
SELECT lang, coalesce({_LETTERS_SQL}, best) AS latin, count(*) AS n FROM l JOIN b USING (doc_id) GROUP BY ALL"""


@query(_latin_sql())
def lng03_latin(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).groupBy("lang", lang.latin_language(F.col("text")).alias("latin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_D}, {_S} SELECT doc_id, {_DOM} AS script, round(CAST(n_hangul AS DOUBLE) / ({_TOTAL}), 6) AS confidence, CASE WHEN CAST(n_hangul AS DOUBLE) / ({_TOTAL}) < 0.3 THEN 'unknown' ELSE 'ko' END AS detected
FROM (SELECT *, {_DOM} AS dom FROM s) WHERE dom = 'hangul'""")
def lng02_confidence(s: SparkSession, d: str) -> DataFrame:
    """Certainty of the texts that are mostly Hangul, and what is left of them under the least certainty."""
    t = F.col("text")
    r = documents(s, d).select("doc_id", lang.language_result(t).alias("r"), lang.detect(t).alias("detected")).filter("r.script = 'hangul'")
    return r.select("doc_id", "r.script", F.round("r.confidence", 6).alias("confidence"), "detected")


_SHARES = "list_filter([" + ", ".join(f"{{'p': -floor(n_{k} * 100 / greatest({_TOTAL}, 1)), 'k': '{k}'}}" for k in _RANGES) + "], lambda x: x.p <= -5)"


@query(f"WITH {_D}, {_S} SELECT doc_id, array_to_string(list_transform(list_sort({_SHARES})[1:5], lambda x: x.k || ':' || (-x.p)::BIGINT), ',') AS shares FROM s")
def lng04_shares(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select("doc_id", lang.languages_by_share(F.col("text")).alias("shares"))


@query(f"WITH {_D} SELECT simple, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(text, '[\\x{{AC00}}-\\x{{D7A3}}]{{3,}}') THEN 'ko' WHEN regexp_matches(text, '[\\x{{3040}}-\\x{{30FF}}]{{3,}}') THEN 'ja' WHEN regexp_matches(text, '[\\x{{4E00}}-\\x{{9FFF}}]{{3,}}') THEN 'zh' WHEN regexp_matches(text, '[\\x{{0400}}-\\x{{04FF}}]{{3,}}') THEN 'ru' ELSE 'en' END AS simple FROM d) GROUP BY simple")
def lng06_simple(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).groupBy(lang.simple_language(F.col("text")).alias("simple")).agg(F.count(F.lit(1)).alias("n"))


# ---- text ----
@query("SELECT DISTINCT title, CASE WHEN slug = '' THEN 'vertical' ELSE slug END AS slug FROM (SELECT title, regexp_replace(substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\x{AC00}-\\x{D7A3}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 30), '-+$', '') AS slug FROM feeds WHERE title IS NOT NULL)")
def str16_slug(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "feeds").filter("title is not null").select("title", text.slug(F.col("title")).alias("slug")).distinct()


@query(f"WITH {_D} SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet FROM d")
def str17_truncate(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select("doc_id", text.truncate(F.col("text"), 200, "...").alias("snippet"))


@query(f"WITH {_D} SELECT doc_id, regexp_replace(regexp_replace(title, '(?i)(trial)', '<mark>\\1</mark>', 'g'), '(?i)(note)', '<mark>\\1</mark>', 'g') AS marked FROM d")
def str20_highlight(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select("doc_id", text.highlight(F.col("title"), "trial note").alias("marked"))


_SPAM = "(" + " + ".join(f"contains(lower(text), '{p}')::INT" for p in ("click here", "buy now", "free money", "limited time", "act now", "call now", "100% free", "no obligation", "work from home", "$$")) + ")"


@query(f"WITH {_D} SELECT source, count(*) FILTER (WHERE strlen(text) < 20 OR {_SPAM} >= 3) AS n_spam, round(avg(greatest(1.0 - CASE WHEN strlen(text) < 50 THEN 0.3 ELSE 0 END - CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0 AND length(regexp_replace(text, '[^A-Z]', '', 'g')) > 0.5 * length(regexp_replace(text, '[^A-Za-z]', '', 'g')) THEN 0.2 ELSE 0 END - CASE WHEN strlen(text) < 20 OR {_SPAM} >= 3 THEN 0.4 ELSE 0 END, 0)), 6) AS quality FROM d GROUP BY source")
def str25_quality(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return documents(s, d).groupBy("source").agg(F.count_if(text.is_spam(t)).alias("n_spam"), F.round(F.avg(text.text_quality(t)), 6).alias("quality"))


@query("WITH k AS (SELECT category, lower(trim(unnest(string_split(title, ' ')))) AS kw FROM feeds WHERE title IS NOT NULL) SELECT kw, count(DISTINCT category) AS n_categories FROM k WHERE kw <> '' GROUP BY kw")
def set04_keywords(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "feeds").filter("title is not null").select("category", F.explode(F.split("title", " ")).alias("kw")).select("category", F.lower(F.trim("kw")).alias("kw"))
    return k.filter("kw != ''").groupBy("kw").agg(F.countDistinct("category").alias("n_categories"))


# ---- scores ----
_FOUND = "CASE id % 5 WHEN 0 THEN 'gov_search' WHEN 1 THEN 'site_discovery' WHEN 2 THEN 'path_discovery' WHEN 3 THEN 'feedspot' END"
_PROVENANCE = "CASE id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'pattern' WHEN 2 THEN 'sitemap' END"
_F = f"""f AS (SELECT *, {_FOUND} AS found_by, {_PROVENANCE} AS provenance, id % 13 AS items, 1 + id % 3 AS given FROM feeds),
t AS (SELECT *, round(CAST(least(greatest(0.5 + CASE WHEN found_by IN ('feedspot', 'gov_search') THEN 0.2 WHEN found_by IN ('site_discovery', 'path_discovery') THEN 0.1 ELSE 0 END
  + CASE WHEN items >= 10 THEN 0.1 WHEN items >= 5 THEN 0.05 ELSE 0 END + CASE WHEN country = 'us' THEN 0.1 ELSE 0 END + CASE given WHEN 1 THEN 0.15 WHEN 3 THEN -0.1 ELSE 0 END, 0), 1) AS DOUBLE), 6) AS trust FROM f),
r AS (SELECT *, CASE WHEN found_by = 'gov_search' OR trust >= 0.8 OR feed_type = 'api' OR contains(lower(domain), 'lab') THEN 1 WHEN trust < 0.5 OR (found_by = 'path_discovery' AND trust < 0.6) THEN 3 ELSE 2 END AS tier FROM t)"""


def _tiered(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "feeds").selectExpr("*", f"{_FOUND} AS found_by", f"{_PROVENANCE} AS provenance", "id % 13 AS items", "1 + id % 3 AS given")
    ok = F.coalesce(F.col("country") == "us", F.lit(False))
    f = f.withColumn("trust", F.round(scores.trust(F.col("found_by"), F.col("items"), ok, F.col("given")), 6))
    return f.withColumn("tier", scores.tier(F.col("found_by"), F.col("trust"), F.col("domain"), F.col("feed_type"), ("lab",)))


@query(f"WITH {_F} SELECT id, trust, tier::INT AS tier FROM r")
def scr01_trust(s: SparkSession, d: str) -> DataFrame:
    return _tiered(s, d).select("id", "trust", "tier")


@query(f"WITH {_F} SELECT tier::INT AS tier, found_by, count(*) AS n FROM r GROUP BY ALL")
def scr03_tiers(s: SparkSession, d: str) -> DataFrame:
    return _tiered(s, d).groupBy("tier", "found_by").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_F} SELECT id, round(CAST(CASE WHEN items >= 10 THEN 0.3 WHEN items >= 5 THEN 0.2 WHEN items >= 1 THEN 0.1 ELSE 0 END + CASE WHEN coalesce(title, '') <> '' THEN 0.2 ELSE 0 END
  + CASE WHEN starts_with(url, 'https://') THEN 0.1 ELSE 0 END + CASE provenance WHEN 'html' THEN 0.2 WHEN 'pattern' THEN 0.15 WHEN 'sitemap' THEN 0.1 ELSE 0 END
  + CASE WHEN lower(url) LIKE '%/feed' OR lower(url) LIKE '%/rss' OR lower(url) LIKE '%/feed.xml' OR lower(url) LIKE '%/rss.xml' THEN 0.15 ELSE 0 END AS DOUBLE), 6) AS score FROM r""")
def scr02_feed_score(s: SparkSession, d: str) -> DataFrame:
    return _tiered(s, d).select("id", F.round(scores.feed_score(F.col("items"), F.col("title"), F.col("url"), F.col("provenance")), 6).alias("score"))


@query(f"WITH {_F} SELECT tier::INT AS tier, count(*) AS n, round(avg(CASE WHEN quality_score IS NOT NULL THEN least(greatest(quality_score / 100 + CASE tier WHEN 1 THEN 0.2 WHEN 3 THEN -0.1 ELSE 0 END, 0), 1) END), 6) AS adjusted FROM r GROUP BY tier")
def scr04_adjusted(s: SparkSession, d: str) -> DataFrame:
    f = _tiered(s, d)
    q = F.col("quality_score") / 100
    return f.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(q.isNotNull(), scores.tier_adjusted(q, F.col("tier")))), 6).alias("adjusted"))


@query("SELECT id, round(1 / (1 + exp(-(quality_score - 50) / 10)), 6) AS logistic, floor(quality_score * 100 + 0.5) / 100 AS two FROM feeds")
def mth01_logistic(s: SparkSession, d: str) -> DataFrame:
    q = F.col("quality_score")
    return table(s, d, "feeds").select("id", F.round(scores.logistic(q, 50.0, 10.0), 6).alias("logistic"), scores.two_decimals(q).alias("two"))


# ---- curation ----
@query(f"WITH {_F}, q AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY trust DESC, id) AS rn FROM r), k AS (SELECT * FROM q WHERE rn <= CASE tier WHEN 1 THEN 20 WHEN 2 THEN 30 ELSE 15 END ORDER BY tier, trust DESC, id LIMIT 60), rest AS (SELECT * FROM q WHERE rn > CASE tier WHEN 1 THEN 20 WHEN 2 THEN 30 ELSE 15 END ORDER BY tier, trust DESC, id LIMIT greatest(0, 40 - (SELECT count(*) FROM k))) SELECT id, tier::INT AS tier, trust FROM (SELECT * FROM k UNION ALL SELECT * FROM rest)")
def win01_tier_quota(s: SparkSession, d: str) -> DataFrame:
    return curate.tier_quota(_tiered(s, d).select("id", "tier", "trust"), "id", 60, 40)


@query("WITH t AS (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY id) AS turn FROM feeds WHERE category IS NOT NULL) SELECT id, category, turn FROM t ORDER BY turn, category, id LIMIT 50")
def win03_round_robin(s: SparkSession, d: str) -> DataFrame:
    return curate.round_robin(table(s, d, "feeds").filter("category is not null").select("id", "category"), "category", "id", 50)


@query("WITH w AS (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT day::DATE AS day, event_type, n, round(n / lag(n) OVER (PARTITION BY event_type ORDER BY day), 6) AS ratio FROM w")
def win08_period_ratio(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("ratio", F.round(F.col("n") / F.lag("n").over(W.partitionBy("event_type").orderBy("day")), 6))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) SELECT user_id, event_type, event_id FROM r WHERE rn = 1")
def win09_first_per_key(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", "event_type", "event_id", "ts")
    return curate.keep_first(e.withColumn("k", F.struct("user_id", "event_type")), F.col("k"), "ts", "event_id").select("user_id", "event_type", "event_id")


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean3 FROM events")
def win07_rolling_mean(s: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return table(s, d, "events").select("user_id", "event_id", F.round(F.avg("value").over(w), 6).alias("mean3"))


@query(f"WITH {_F} SELECT t.tier::INT AS tier, coalesce(n, 0) AS n FROM (VALUES (1), (2), (3)) t(tier) LEFT JOIN (SELECT tier, count(*) AS n FROM r GROUP BY tier) USING (tier)")
def agg17_tier_histogram(s: SparkSession, d: str) -> DataFrame:
    return curate.tier_histogram(_tiered(s, d))


RATIOS = {"en": 0.4, "de": 0.15, "fr": 0.1, "ko": 0.2, "vi": 0.15}
_RATIO = ", ".join(f"('{k}', {int(v * 5000)})" for k, v in RATIOS.items())


@query(f"WITH w(lang, target) AS (VALUES {_RATIO}), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT lang, target::BIGINT AS target, coalesce(n, 0) AS n, target - coalesce(n, 0) AS gap, target - coalesce(n, 0) > 500 AS critical FROM w LEFT JOIN n USING (lang) WHERE target > coalesce(n, 0)")
def agg18_language_gaps(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return curate.gaps(n, RATIOS, 5000, 500)


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY id) AS rn FROM feeds) SELECT id, domain FROM r WHERE rn = 1")
def set02_dedupe_domain(s: SparkSession, d: str) -> DataFrame:
    return curate.keep_first(table(s, d, "feeds").select("id", "domain"), F.col("domain"), "id")


@query("WITH f AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(lower(url), '/$', ''), '^https?://', ''), '^www\\.', '') AS norm FROM feeds), r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY id) AS rn FROM f) SELECT id, norm FROM r WHERE rn = 1")
def set03_dedupe_url(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "feeds").select("id", urls.normal_url(F.col("url")).alias("norm"))
    return curate.keep_first(f, F.col("norm"), "id")


@query("SELECT 'feed' AS kind, count(*) AS n, count(DISTINCT domain) AS n_hosts FROM feeds UNION ALL SELECT 'document', count(*), count(DISTINCT regexp_extract(url, '^https?://([^/]*)', 1)) FROM documents")
def set01_union_sources(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "feeds").select(F.lit("feed").alias("kind"), F.col("domain").alias("host"))
    b = table(s, d, "documents").select(F.lit("document").alias("kind"), F.when(F.col("url").isNotNull(), urls.host(F.col("url"))).alias("host"))
    return a.unionByName(b).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("host").alias("n_hosts"))


# ---- joins ----
@query("SELECT d.doc_id, coalesce(f.domain, 'Unknown') AS domain, f.category FROM documents d LEFT JOIN feeds f ON d.feed_id = f.id")
def jon01_left(s: SparkSession, d: str) -> DataFrame:
    """Documents with their feeds; the salt keeps one feed with a third of all documents from one task."""
    docs, feeds = table(s, d, "documents").select("doc_id", F.col("feed_id").alias("id")), table(s, d, "feeds").select("id", "domain", "category")
    from larkspur.operators.orphans import salted_join

    return salted_join(docs, feeds, ["id"], by="doc_id").select("doc_id", F.coalesce("domain", F.lit("Unknown")).alias("domain"), "category")


@query("SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey")
def jon02_inner(s: SparkSession, d: str) -> DataFrame:
    o, c, n = table(s, d, "orders"), table(s, d, "customer"), table(s, d, "nation")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("WITH h AS (SELECT doc_id, regexp_extract(lower(url), '^https?://([^/]*)', 1) AS host FROM documents WHERE url IS NOT NULL), x AS (SELECT doc_id, array_to_string(labels[i:], '.') AS suffix FROM (SELECT doc_id, string_split(host, '.') AS labels, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM h)), k AS (SELECT DISTINCT doc_id, f.domain FROM x JOIN feeds f ON f.domain = x.suffix) SELECT d.doc_id, k.domain FROM documents d LEFT JOIN k USING (doc_id)")
def jon03_contains_host(s: SparkSession, d: str) -> DataFrame:
    """Documents whose host is, or lies under, the domain of a feed: an equi-join on host suffixes of two labels or more (a bare ending is no domain and would be one hot key), where a containment test would compare all pairs."""
    docs = table(s, d, "documents").select("doc_id", F.split(urls.host(F.col("url")), r"\.").alias("labels"))
    suffixes = docs.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("labels") - 1, F.lit(1))), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))).alias("domain"))
    hits = suffixes.join(table(s, d, "feeds").select("domain").distinct(), "domain").distinct()
    return docs.select("doc_id").join(hits, "doc_id", "left")


@query("SELECT c.c_custkey, count(o.o_orderkey) AS n_orders, round(coalesce(sum(o.o_totalprice), 0), 2) AS total FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
def jon05_left_agg(s: SparkSession, d: str) -> DataFrame:
    """Orders are summed by customer before the join, so it moves one row a customer."""
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t"))
    c = table(s, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_orders"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))


@query("SELECT id, url FROM feeds f WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.feed_id = f.id)")
def jon10_anti(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "feeds").select("id", "url").join(table(s, d, "documents").select(F.col("feed_id").alias("id")).distinct(), "id", "left_anti")


# ---- aggregates ----
@query("SELECT count(*) AS n, round(avg(quality_score), 6) AS avg_quality, count(*) FILTER (WHERE status = 'active') AS n_active FROM feeds")
def agg01_totals(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "feeds").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality_score"), 6).alias("avg_quality"), F.count_if(F.col("status") == "active").alias("n_active"))


_DIMS = ["language", "country", "category", "status", "feed_type"]


@query(" UNION ALL ".join(f"SELECT '{x}' AS dimension, coalesce({x}, '') AS key, count(*) AS n FROM feeds GROUP BY coalesce({x}, '')" for x in _DIMS))
def agg02_group_stats(s: SparkSession, d: str) -> DataFrame:
    return store.group_stats(table(s, d, "feeds"), _DIMS)


@query("SELECT feed_id, count(*) AS n, count(*) FILTER (WHERE text ILIKE '%trial%') AS n_fit FROM documents GROUP BY feed_id HAVING count(*) > 5 AND count(*) FILTER (WHERE text ILIKE '%trial%') / count(*) < 0.2")
def agg05_having(s: SparkSession, d: str) -> DataFrame:
    """Feeds with more than five documents of which under a fifth fit the topic."""
    g = table(s, d, "documents").groupBy("feed_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").ilike("%trial%")).alias("n_fit"))
    return g.filter((F.col("n") > 5) & (F.col("n_fit") / F.col("n") < 0.2))


_TABLES = ["documents", "feeds", "clinical_trials", "pubmed_articles", "congress_bills", "congress_votes", "legal_cases", "ercot_prices", "eia_series", "entsoe_load"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def agg06_table_counts(s: SparkSession, d: str) -> DataFrame:
    out = None
    for t in _TABLES:
        one = table(s, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("WITH r AS (SELECT category, substr(title, 1, 50) AS t, row_number() OVER (PARTITION BY category ORDER BY id) AS rn FROM feeds), c AS (SELECT category, count(*) AS n FROM feeds GROUP BY category), l AS (SELECT category, string_agg(coalesce(t, ''), ' / ' ORDER BY rn) AS samples FROM r WHERE rn <= 3 GROUP BY category) SELECT c.category, c.n, l.samples FROM c JOIN l ON c.category IS NOT DISTINCT FROM l.category")
def agg16_samples(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "feeds").select("id", "category", F.coalesce(F.substring("title", 1, 50), F.lit("")).alias("t"))
    r = f.withColumn("rn", F.row_number().over(W.partitionBy("category").orderBy("id")))
    return r.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.struct("rn", "t")))), lambda x: x["t"]), " / ").alias("samples"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def agg21_latency(s: SparkSession, d: str) -> DataFrame:
    return metrics.latency(table(s, d, "events"), ["event_type"])


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def agg22_counters(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT chamber, count(*) AS total, count(*) FILTER (WHERE result = 'Passed') AS passed, floor(100.0 * count(*) FILTER (WHERE result = 'Passed') / count(*))::BIGINT AS percent FROM congress_votes GROUP BY chamber")
def agg25_rate(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "congress_votes").groupBy("chamber").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("result") == "Passed").alias("passed"))
    return v.withColumn("percent", F.floor(F.col("passed") * 100 / F.col("total")))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def agg_pricing_summary(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    price = F.col("l_extendedprice")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count(F.lit(1)).alias("n"))


# ---- filters ----
@query("SELECT id, quality_score FROM feeds WHERE status = 'active' AND feed_type = 'rss' ORDER BY quality_score DESC NULLS LAST, id LIMIT 25")
def flt01_list(s: SparkSession, d: str) -> DataFrame:
    return store.list_rows(table(s, d, "feeds").select("id", "quality_score", "status", "feed_type"), {"status": "active", "feed_type": "rss", "country": None}, [F.desc_nulls_last("quality_score"), "id"], 25).select("id", "quality_score")


@query("SELECT doc_id FROM documents WHERE created_at > TIMESTAMP '2024-01-01' AND created_at <= TIMESTAMP '2024-07-01'")
def flt03_window(s: SparkSession, d: str) -> DataFrame:
    t = F.col("created_at")
    return table(s, d, "documents").filter((t > F.lit("2024-01-01").cast("timestamp")) & (t <= F.lit("2024-07-01").cast("timestamp"))).select("doc_id")


@query("SELECT doc_id, url FROM documents WHERE (text IS NULL OR text = '') AND url NOT ILIKE '%youtube%' ORDER BY doc_id LIMIT 50")
def flt04_missing(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").filter((F.col("text").isNull() | (F.col("text") == "")) & ~F.col("url").ilike("%youtube%"))
    return x.select("doc_id", "url").orderBy("doc_id").limit(50)


@query("SELECT DISTINCT series_id, name FROM eia_series WHERE name ILIKE '%gas%' OR description ILIKE '%gas%'")
def flt06_like(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eia_series").filter(F.col("name").ilike("%gas%") | F.col("description").ilike("%gas%")).select("series_id", "name").distinct()


# ---- keyed tables ----
def _batches(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Trials as first stored, and the rows that came later for some of them."""
    t = table(s, d, "clinical_trials").select("nct_id", "title", "phase", "status", "created_at")
    return t.filter(F.col("created_at") <= F.lit("2024-10-01").cast("timestamp")), t.filter(F.col("created_at") > F.lit("2024-10-01").cast("timestamp"))


_B = "o AS (SELECT nct_id, title, phase, status, created_at FROM clinical_trials WHERE created_at <= TIMESTAMP '2024-10-01'), n AS (SELECT nct_id, title, phase, status, created_at FROM clinical_trials WHERE created_at > TIMESTAMP '2024-10-01')"


@query(f"WITH {_B}, b AS (SELECT *, 0 AS batch FROM o UNION ALL SELECT *, 1 FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY nct_id ORDER BY batch DESC, created_at DESC) AS rn FROM b) SELECT nct_id, title, status FROM r WHERE rn = 1")
def snk01_replace(s: SparkSession, d: str) -> DataFrame:
    old, new = _batches(s, d)
    return store.replace_on_key(old, new, "nct_id", "created_at").select("nct_id", "title", "status")


@query(f"WITH {_B}, r AS (SELECT *, row_number() OVER (PARTITION BY nct_id ORDER BY created_at) AS rn FROM n) SELECT nct_id, title, status FROM r WHERE rn = 1 AND nct_id NOT IN (SELECT nct_id FROM o)")
def snk02_ignore(s: SparkSession, d: str) -> DataFrame:
    old, new = _batches(s, d)
    return store.insert_ignore(old, new, "nct_id", "created_at").select("nct_id", "title", "status")


@query(f"WITH {_B}, o1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nct_id ORDER BY created_at) AS rn FROM o) WHERE rn = 1), n1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nct_id ORDER BY created_at) AS rn FROM n) WHERE rn = 1) SELECT coalesce(n1.nct_id, o1.nct_id) AS nct_id, CASE WHEN o1.nct_id IS NOT NULL THEN o1.title ELSE n1.title END AS title, coalesce(n1.phase, o1.phase) AS phase, CASE WHEN n1.nct_id IS NOT NULL THEN n1.status ELSE o1.status END AS status FROM o1 FULL JOIN n1 ON o1.nct_id = n1.nct_id")
def snk03_upsert(s: SparkSession, d: str) -> DataFrame:
    old, new = _batches(s, d)
    first = lambda df: curate.keep_first(df, F.col("nct_id"), "created_at").drop("created_at")
    return store.upsert(first(old), first(new), "nct_id", ["phase"], ["status"]).select("nct_id", "title", "phase", "status")


@query("SELECT id, quality_score FROM feeds WHERE NOT coalesce(quality_score < 40, false)")
def snk06_prune(s: SparkSession, d: str) -> DataFrame:
    return store.delete_where(table(s, d, "feeds").select("id", "quality_score"), F.col("quality_score") < 40)


@query("SELECT id, CASE WHEN created_at < 1700000000 AND status = 'active' THEN 'inactive' ELSE status END AS status FROM feeds")
def snk07_stale(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "feeds").select("id", "status", "created_at")
    return store.update_where(f, (F.col("created_at") < 1_700_000_000) & (F.col("status") == "active"), "status", F.lit("inactive")).select("id", "status")


# ---- event windows, batch form ----
@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stm03_tumbling(s: SparkSession, d: str) -> DataFrame:
    return metrics.tumbling(table(s, d, "events"), "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH b AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start, event_type, value FROM events) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM b GROUP BY ALL")
def stm_sliding(s: SparkSession, d: str) -> DataFrame:
    return metrics.tumbling(table(s, d, "events"), "1 hour", "30 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, session")
def stm_session(s: SparkSession, d: str) -> DataFrame:
    return metrics.sessions(table(s, d, "events"), "30 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))
