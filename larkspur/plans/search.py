"""Queries of search, ranking and trends with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larkspur.functions.text import SCRIPT_RUN, TOKEN, entities, keywords, letter_count, stop_set, tokens
from larkspur.operators import search, trends, vectors
from larkspur.operators.feedback import find_seeds
from larkspur.session import shared_folder, table

QUERY = "trial grid reservoir"
WORDS = ["clinical trial", "patients", "dose", "mg"]
#: windows of the trend queries
PREVIOUS, SINCE, UNTIL = "2024-01-01 00:00:00", "2024-06-01 00:00:00", "2025-12-31 00:00:00"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, title (first line), source, lang, feed_id, created_at; null texts are empty."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "lang", "feed_id", "created_at")
    return d.withColumn("title", F.substring_index("text", "\n", 1))


def _ranked(df: DataFrame, n: int) -> DataFrame:
    top = df.orderBy(F.desc("score"), "doc_id").limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "doc_id")).cast("bigint"))


def fts01_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the inverted index: postings, documents and terms by column."""
    p = search.postings(documents(spark, sf_dir), "doc_id", "title", "text")
    return p.groupBy("col").agg(F.count(F.lit(1)).alias("n_postings"), F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("term").alias("n_terms"))


def fts02_match_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.match_all(documents(spark, sf_dir), "trial dose", "text").select("doc_id")


def fts03_match_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.match_any(documents(spark, sf_dir), ["grid operator", "reservoir"], "title", "text").select("doc_id")


def fts04_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.match_phrase(documents(spark, sf_dir), "grid operator", "text").select("doc_id")


def fts05_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents by BM25."""
    return _ranked(search.bm25(documents(spark, sf_dir), "doc_id", "text", QUERY), 20).select("doc_id", "score", "rank")


def fts05_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same twenty from postings written once, of which the query's terms alone are read."""
    index = search.StoredIndex.build(documents(spark, sf_dir), "doc_id", "text", shared_folder(spark, "index"))
    return _ranked(index.bm25(QUERY).withColumnRenamed("key", "doc_id"), 20).select("doc_id", "score", "rank")


def fts07_exact_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.bm25(documents(spark, sf_dir), "doc_id", "text", "grid operator")
    top = search.exact_boost(hits, F.col("text"), "grid operator").orderBy(F.desc("raw_score"), "doc_id").limit(20)
    return top.select("doc_id", "raw_score", "score")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


def sem01_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty vectors nearest to vector 0."""
    return search.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), 20)


def rrf01_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of full text and of vectors (vec_id as doc_id), thirty each, fused."""
    a = _ranked(search.bm25(documents(spark, sf_dir), "doc_id", "text", QUERY), 30)
    near = search.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), 30).withColumnRenamed("vec_id", "doc_id")
    return search.fuse(a, _ranked(near, 30), "doc_id").select("doc_id", "rank_a", "rank_b", "score", "source")


def _query_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every row whose id is divisible by 100."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0")


def sem01_cosine_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty vectors nearest to each vector of the query set."""
    return search.nearest_each(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_rows(spark, sf_dir), 20)


def rrf01_hybrid_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of full text fused with those of each vector of the query set, thirty each."""
    queries = _query_rows(spark, sf_dir)
    top = _ranked(search.bm25(documents(spark, sf_dir), "doc_id", "text", QUERY), 30).collect()  # thirty rows
    hits = F.array(*[F.struct(F.lit(r["doc_id"]).alias("doc_id"), F.lit(r["rank"]).alias("rank")) for r in top]).cast("array<struct<doc_id:bigint,rank:bigint>>")
    a = queries.select(F.col("vec_id").alias("query_id"), F.inline(hits))
    b = search.nearest_each(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", queries, 30).withColumnRenamed("vec_id", "doc_id")
    return search.fuse(a, b, ["query_id", "doc_id"]).select("query_id", "doc_id", "rank_a", "rank_b", "score", "source")


def srt01_multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search over trials, articles and cases, ten of each."""
    out = None
    for name, key, col in (("clinical_trials", "nct_id", "title"), ("pubmed_articles", "pmid", "title"), ("legal_cases", "case_id", "snippet")):
        df = table(spark, sf_dir, name).groupBy(F.col(key).alias("doc_id")).agg(F.max(col).alias("t"))
        hits = search.match_any(df, ["study", "migraine", "notice"], "t").orderBy("doc_id").limit(10).select(F.lit(name).alias("source"), "doc_id")
        out = hits if out is None else out.unionByName(hits)
    return out


def str04_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("source", tokens(F.col("text"), 2).alias("t"))
    return d.groupBy("source").agg(F.sum(F.size("t")).cast("bigint").alias("n_tokens"), F.sum(F.size(F.array_distinct("t"))).cast("bigint").alias("n_distinct"))


def agg10_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.document_frequency(vectors.term_counts(documents(spark, sf_dir), "doc_id", "text")).orderBy(F.desc("df"), "term").limit(100)


def agg11_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf = vectors.augmented_tf(vectors.term_counts(documents(spark, sf_dir), "doc_id", "text"), "doc_id")
    return tf.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("tf"), 6).alias("tf_sum"))


def str10_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 for a word of one feed category, else ln(N/df)/ln N over categories."""
    words = table(spark, sf_dir, "feeds").filter("category is not null").select("category", F.explode(tokens(F.col("title"), 3)).alias("kw")).distinct()
    n = float(words.select("category").distinct().count())
    df = words.groupBy("kw").agg(F.count(F.lit(1)).alias("df"))
    spec = F.when((F.col("df") == 1) | F.lit(n <= 1), 1.0).otherwise(F.greatest(F.ln(n / F.col("df")) / F.ln(F.lit(max(n, 2.0))), F.lit(0.0)))
    return df.select("kw", "df", F.round(spec, 6).alias("specificity"))


def rnk01_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.round(vectors.keyword_relevance(F.col("text"), WORDS), 6).alias("score"))


def _positive(df: DataFrame) -> DataFrame:
    return df.filter((F.col("source") == "med-abstracts") & (F.col("lang") == "en"))


def rnk02_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine of every document with the English medical abstracts."""
    d = documents(spark, sf_dir)
    return vectors.tfidf_relevance(d, _positive(d), "doc_id", "text")


def rnk05_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return vectors.smoothed_rank(d, _positive(d), "doc_id", "text")


def rnk07_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from 0.3 on by keywords; how many of each source pass, and how many pass 0.6."""
    d = documents(spark, sf_dir).withColumn("score", vectors.keyword_relevance(F.col("text"), WORDS))
    return d.filter("score >= 0.3").groupBy("source").agg(F.count(F.lit(1)).alias("n_pass"), F.count_if(F.col("score") > 0.6).alias("n_strong"))


def agg13_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = vectors.feedback_terms(documents(spark, sf_dir), "doc_id", "text", F.col("source") == "med-abstracts")
    return terms.orderBy(F.desc("score"), "term").limit(100)


def agg14_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.match_any(documents(spark, sf_dir), ["dose"], "text")
    return hits.agg(F.round(F.avg((F.col("source") == "med-abstracts").cast("double")), 6).alias("precision"), F.count(F.lit(1)).alias("n"))


def fbk04_find_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of searching and learning from the hits."""
    d = documents(spark, sf_dir)
    return find_seeds(lambda terms: search.match_any(d, terms, "text"), ["trial", "dose", "patients"], "doc_id", "text")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.windowed(documents(spark, sf_dir), "created_at", PREVIOUS, SINCE, UNTIL)


def trd01_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.hot(trends.counts_by_window(_windows(spark, sf_dir), keywords(F.col("text"))), 20)


def trd01_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.bursts(trends.counts_by_window(_windows(spark, sf_dir), keywords(F.col("text"))), window=2000)


def trd01_emerging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.emerging(_windows(spark, sf_dir), F.col("text"), window=5000)


def win05_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.matrix(_windows(spark, sf_dir), "source", keywords(F.col("text")))


def trd02_cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("source").isin("gridwire", "energy-brief", "market-hour"), "news").otherwise("blog")
    return trends.cross_source(_windows(spark, sf_dir), kind, keywords(F.col("text")), "news", "blog")


def str01_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = documents(spark, sf_dir).select("lang", keywords(F.col("text")).alias("k"))
    return k.groupBy("lang").agg(F.sum(F.size("k")).cast("bigint").alias("n_keywords"))


def str02_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = documents(spark, sf_dir).select(F.explode(entities(F.col("text"))).alias("entity"))
    return e.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.max(letter_count(F.col("entity"))).cast("bigint").alias("letters")).orderBy(F.desc("n"), "entity").limit(100)


def agg15_title_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent words of the thousand newest titles."""
    top = documents(spark, sf_dir).select("doc_id", "created_at", "title").orderBy(F.desc("created_at"), "doc_id").limit(1000)
    w = top.select(F.explode(F.split(F.lower("title"), " ")).alias("word")).filter(F.octet_length("word") >= 2)
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(50)


def agg07_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of documents with one of the topic's words, in percent."""
    d = documents(spark, sf_dir)
    hit = F.exists(tokens(F.col("text")), lambda t: t.isin("trial", "dose", "patients"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit.cast("double")) * 100, 4).alias("fit_percent"))


def top09_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three sentences of each source by the number of topic words."""
    s = documents(spark, sf_dir).select("source", "doc_id", F.posexplode(F.split("text", r"[.!?。]\s+")).alias("pos", "sentence")).filter(F.octet_length("sentence").between(20, 500))
    low = F.lower("sentence")
    score = sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in WORDS), F.lit(0))
    ranked = s.withColumn("score", score).filter("score > 0").withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy(F.desc("score"), "doc_id", "pos")).cast("bigint"))
    return ranked.filter("rank <= 3").select("source", "rank", "doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("score").cast("bigint").alias("score"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[:3] in {"fts", "sem", "rrf", "srt", "str", "agg", "rnk", "fbk", "trd", "win", "top"} and "_" in k}

_T = TOKEN.replace("'", "''")
_D = "d AS (SELECT doc_id, coalesce(text, '') AS text, split_part(coalesce(text, ''), chr(10), 1) AS title, source, lang, feed_id, created_at FROM documents)"
_TOK = f"regexp_extract_all(lower(text), '{_T}')"
_STOP = ", ".join(f"'{w}'" for w in stop_set())
_KW = f"list_filter(regexp_extract_all(lower(text), '{SCRIPT_RUN}'), lambda x: strlen(x) >= 3 AND x NOT IN ({_STOP}))"
_ENT = r"list_concat(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+'), regexp_extract_all(text, '(?:^|[^0-9A-Za-z_])([A-Z]{2,5})(?:$|[^0-9A-Za-z_])', 1))"


def _bm25_sql(terms: list[str]) -> str:
    values = ", ".join(f"('{t}')" for t in terms)
    return f"""{_D}, t AS (SELECT doc_id, text, {_TOK} AS toks FROM d), s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t),
    q(term) AS (VALUES {values}), tf AS (SELECT doc_id, term, len(toks) AS dl, len(list_filter(toks, lambda x: x = term)) AS tf FROM t, q),
    f AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY term),
    b AS (SELECT doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
          FROM tf JOIN f USING (term), s GROUP BY doc_id HAVING sum(tf) > 0)"""


_BM = _bm25_sql(QUERY.split())
_NEAR = "v AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings)"
_NEAR_SET = """qs AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0),
    v AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e), 6) AS score FROM embeddings, qs),
    near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM v)"""
_TC = f"{_D}, tc AS (SELECT doc_id, source, lang, term, count(*) AS n FROM (SELECT doc_id, source, lang, unnest(list_filter({_TOK}, lambda x: strlen(x) >= 2)) AS term FROM d) GROUP BY ALL), tf AS (SELECT *, 0.5 + 0.5 * n / max(n) OVER (PARTITION BY doc_id) AS tf FROM tc)"
_CUR = f"(created_at > TIMESTAMP '{SINCE}' AND created_at <= TIMESTAMP '{UNTIL}')"
_PRE = f"(created_at > TIMESTAMP '{PREVIOUS}' AND created_at <= TIMESTAMP '{SINCE}')"
_WIN = f"{_D}, w AS (SELECT *, {_CUR} AS cur FROM d WHERE {_CUR} OR {_PRE})"


def _counts(items: str) -> str:
    return f"{_WIN}, c AS (SELECT kw, count(*) FILTER (WHERE cur) AS n, count(*) FILTER (WHERE NOT cur) AS before FROM (SELECT cur, unnest({items}) AS kw FROM w) GROUP BY kw)"


def _relevance() -> str:
    n = len(WORDS)
    weights = [1 + (n - i) / n for i in range(n)]
    terms = " + ".join(f"CASE WHEN list_contains(toks, '{w}') THEN {x!r}::DOUBLE WHEN contains(lower(text), '{w}') THEN {0.8 * x!r}::DOUBLE ELSE 0 END" for w, x in zip(WORDS, weights))
    return f"{_D}, r AS (SELECT doc_id, source, CASE WHEN len(toks) = 0 THEN 0.0 ELSE least(({terms}) / {sum(weights)!r}::DOUBLE, 1.0) END AS score FROM (SELECT *, list_filter({_TOK}, lambda x: strlen(x) >= 2) AS toks FROM d))"


SQL = {
    "fts01_postings": f"WITH {_D}, p AS (SELECT 'title' AS col, doc_id, unnest(regexp_extract_all(lower(title), '{_T}')) AS term FROM d UNION ALL SELECT 'text', doc_id, unnest({_TOK}) FROM d) SELECT col, count(*) AS n_postings, count(DISTINCT doc_id) AS n_docs, count(DISTINCT term) AS n_terms FROM p GROUP BY col",
    "fts02_match_and": f"WITH {_D} SELECT doc_id FROM d WHERE list_has_all({_TOK}, ['trial', 'dose'])",
    "fts03_match_or": f"WITH {_D} SELECT doc_id FROM d WHERE (list_has_all({_TOK}, ['grid', 'operator'])) OR list_contains({_TOK}, 'reservoir')",
    "fts04_phrase": f"WITH {_D} SELECT doc_id FROM d WHERE contains(' ' || array_to_string({_TOK}, ' ') || ' ', ' grid operator ')",
    "fts05_bm25": f"WITH {_BM} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b ORDER BY score DESC, doc_id LIMIT 20",
    "fts07_exact_boost": f"WITH {_bm25_sql(['grid', 'operator'])} SELECT doc_id, score AS raw_score, round(CASE WHEN contains(lower(text), 'grid operator') THEN score * 1.5 ELSE score END, 6) AS score FROM b JOIN d USING (doc_id) ORDER BY b.score DESC, doc_id LIMIT 20",
    "sem01_cosine": f"WITH {_NEAR} SELECT vec_id, score FROM v ORDER BY score DESC, vec_id LIMIT 20",
    "rrf01_hybrid": f"""WITH {_BM}, {_NEAR}, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank_a FROM b ORDER BY score DESC, doc_id LIMIT 30),
        n AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank_b FROM v ORDER BY score DESC, vec_id LIMIT 30)
        SELECT doc_id, rank_a, rank_b, round(coalesce(0.5 / (60 + rank_a), 0) + coalesce(0.5 / (60 + rank_b), 0), 8) AS score,
        CASE WHEN rank_a IS NOT NULL AND rank_b IS NOT NULL THEN 'hybrid:both' WHEN rank_a IS NOT NULL THEN 'hybrid:fts' ELSE 'hybrid:semantic' END AS source FROM a FULL JOIN n USING (doc_id)""",
    "sem01_cosine_set": f"WITH {_NEAR_SET} SELECT query_id, vec_id, score, rank FROM near WHERE rank <= 20",
    "rrf01_hybrid_set": f"""WITH {_BM}, {_NEAR_SET}, top AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank_a FROM b ORDER BY score DESC, doc_id LIMIT 30),
        a AS (SELECT query_id, doc_id, rank_a FROM top, qs), n AS (SELECT query_id, vec_id AS doc_id, rank AS rank_b FROM near WHERE rank <= 30)
        SELECT query_id, doc_id, rank_a, rank_b, round(coalesce(0.5 / (60 + rank_a), 0) + coalesce(0.5 / (60 + rank_b), 0), 8) AS score,
        CASE WHEN rank_a IS NOT NULL AND rank_b IS NOT NULL THEN 'hybrid:both' WHEN rank_a IS NOT NULL THEN 'hybrid:fts' ELSE 'hybrid:semantic' END AS source FROM a FULL JOIN n USING (query_id, doc_id)""",
    "srt01_multi_source": " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{n}' AS source, doc_id FROM (SELECT {k} AS doc_id, max({c}) AS t FROM {n} GROUP BY {k}) WHERE list_has_any(regexp_extract_all(lower(coalesce(t, '')), '{_T}'), ['study', 'migraine', 'notice']) ORDER BY doc_id LIMIT 10)"
        for n, k, c in (("clinical_trials", "nct_id", "title"), ("pubmed_articles", "pmid", "title"), ("legal_cases", "case_id", "snippet"))
    ),
    "str04_tokens": f"WITH {_D} SELECT source, sum(len(t))::BIGINT AS n_tokens, sum(len(list_distinct(t)))::BIGINT AS n_distinct FROM (SELECT source, list_filter({_TOK}, lambda x: strlen(x) >= 2) AS t FROM d) GROUP BY source",
    "agg10_document_frequency": f"WITH {_TC} SELECT term, count(*) AS df FROM tc GROUP BY term ORDER BY df DESC, term LIMIT 100",
    "agg11_tf": f"WITH {_TC} SELECT doc_id, count(*) AS n_terms, round(sum(tf), 6) AS tf_sum FROM tf GROUP BY doc_id",
    "str10_specificity": f"WITH w AS (SELECT DISTINCT category, kw FROM (SELECT category, unnest(list_filter(regexp_extract_all(lower(coalesce(title, '')), '{_T}'), lambda x: strlen(x) >= 3)) AS kw FROM feeds WHERE category IS NOT NULL)), n AS (SELECT count(DISTINCT category)::DOUBLE AS n FROM w) SELECT kw, count(*) AS df, round(CASE WHEN count(*) = 1 OR n <= 1 THEN 1.0 ELSE greatest(ln(n / count(*)) / ln(greatest(n, 2)), 0) END, 6) AS specificity FROM w, n GROUP BY kw, n",
    "rnk01_relevance": f"WITH {_relevance()} SELECT doc_id, round(score, 6) AS score FROM r",
    "rnk02_tfidf": f"""WITH {_TC}, p AS (SELECT * FROM tf WHERE source = 'med-abstracts' AND lang = 'en'), np AS (SELECT count(*)::DOUBLE AS n FROM d WHERE source = 'med-abstracts' AND lang = 'en'),
        idf AS (SELECT term, ln((max(n_) + 1) / (count(*) + 1)) AS idf FROM (SELECT p.term, np.n AS n_ FROM p, np) GROUP BY term),
        pv AS (SELECT doc_id, term, tf * idf AS v FROM p JOIN idf USING (term)), pn AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM pv GROUP BY doc_id),
        c AS (SELECT term, sum(v / norm) / max(np.n) AS c FROM pv JOIN pn USING (doc_id), np WHERE norm > 0 GROUP BY term),
        cv AS (SELECT doc_id, term, tf * idf AS v FROM tf JOIN idf USING (term)),
        s AS (SELECT doc_id, sum(v * coalesce(c, 0)) AS dot, sqrt(sum(v * v)) AS norm FROM cv LEFT JOIN c USING (term) GROUP BY doc_id)
        SELECT doc_id, round(coalesce(CASE WHEN norm > 0 THEN dot / norm END, 0), 6) AS score FROM d LEFT JOIN s USING (doc_id)""",
    "rnk05_smoothed": f"""WITH {_TC}, np AS (SELECT count(*)::DOUBLE AS n FROM d WHERE source = 'med-abstracts' AND lang = 'en'), p AS (SELECT * FROM tf WHERE source = 'med-abstracts' AND lang = 'en'),
        vocab AS (SELECT term FROM p GROUP BY term HAVING count(*) >= 2), tot AS (SELECT np.n + count(*) AS total FROM d, np GROUP BY np.n),
        df AS (SELECT term, count(*) AS df FROM (SELECT term FROM p UNION ALL SELECT term FROM tf) GROUP BY term),
        idf AS (SELECT term, ln(total / (df + 1)) AS idf FROM vocab JOIN df USING (term), tot),
        mean AS (SELECT term, sum(tf * idf) / max(np.n) AS m, max(idf) AS idf FROM p JOIN idf USING (term), np GROUP BY term),
        k AS (SELECT sqrt(sum(m * m)) AS len, count(*)::DOUBLE AS size FROM mean),
        parts AS (SELECT doc_id, sum(tf * idf * m) AS dot, sqrt(sum(tf * idf * tf * idf)) AS norm, count(*) FILTER (WHERE tf * idf > 0) AS hits FROM tf JOIN mean USING (term) GROUP BY doc_id)
        SELECT d.doc_id, round(coalesce((n / (n + 5)) * (0.7 * CASE WHEN norm > 0 AND len > 0 THEN dot / (norm * len) ELSE 0 END + 0.3 * hits / size) + (1 - n / (n + 5)) * 0.5, (1 - n / (n + 5)) * 0.5), 6) AS score FROM d LEFT JOIN parts USING (doc_id), np, k""",
    "rnk07_two_stage": f"WITH {_relevance()} SELECT source, count(*) AS n_pass, count(*) FILTER (WHERE score > 0.6) AS n_strong FROM r WHERE score >= 0.3 GROUP BY source",
    "agg13_feedback": f"WITH {_TC} SELECT term, round(sum(CASE WHEN source = 'med-abstracts' THEN tf ELSE -0.5 * tf END), 6) AS score FROM tf GROUP BY term ORDER BY score DESC, term LIMIT 100",
    "agg14_precision": f"WITH {_D} SELECT round(avg((source = 'med-abstracts')::INT), 6) AS precision, count(*) AS n FROM d WHERE list_contains({_TOK}, 'dose')",
    "trd01_hot": f"WITH {_counts(_KW)} SELECT kw, n FROM c WHERE n > 0 ORDER BY n DESC, kw LIMIT 20",
    "trd01_burst": f"WITH {_counts(_KW)}, t AS (SELECT * FROM c WHERE n > 0 ORDER BY n DESC, kw LIMIT 2000), b AS (SELECT kw, n, before, floor((CASE WHEN before = 0 THEN n * 10.0::DOUBLE ELSE n / before END) * 100 + 0.5) / 100 AS burst FROM t WHERE n >= 5) SELECT * FROM b WHERE burst >= 1.5 ORDER BY burst DESC, n DESC, kw LIMIT 20",
    "trd01_emerging": f"WITH {_counts(_ENT)}, t AS (SELECT * FROM c WHERE n > 0 ORDER BY n DESC, kw LIMIT 5000) SELECT kw, n FROM t WHERE n >= 3 AND before = 0 AND length(regexp_replace(kw, '[^\\p{{L}}]', '', 'g')) > 2 ORDER BY n DESC, kw LIMIT 20",
    "win05_matrix": f"WITH {_WIN}, k AS (SELECT source, kw, count(*) AS n FROM (SELECT source, unnest({_KW}) AS kw FROM w WHERE cur AND source IS NOT NULL) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, kw) AS rank FROM k), top AS (SELECT * FROM r WHERE rank <= 10), best AS (SELECT source FROM top GROUP BY source ORDER BY count(*) DESC, source LIMIT 20) SELECT source, rank, kw, n FROM top WHERE source IN (SELECT source FROM best)",
    "trd02_cross_source": f"WITH {_WIN}, k AS (SELECT kw, count(*) FILTER (WHERE news) AS n_a, count(*) FILTER (WHERE NOT news) AS n_b FROM (SELECT coalesce(source IN ('gridwire', 'energy-brief', 'market-hour'), false) AS news, unnest({_KW}) AS kw FROM w WHERE cur) GROUP BY kw) SELECT kw, n_a, n_b, n_a + n_b AS total FROM k WHERE n_a >= 3 AND n_b >= 2 ORDER BY total DESC, kw LIMIT 20",
    "str01_keywords": f"WITH {_D} SELECT lang, sum(len({_KW}))::BIGINT AS n_keywords FROM d GROUP BY lang",
    "str02_entities": f"WITH {_D} SELECT entity, count(*) AS n, max(length(regexp_replace(entity, '[^\\p{{L}}]', '', 'g'))) AS letters FROM (SELECT unnest({_ENT}) AS entity FROM d) GROUP BY entity ORDER BY n DESC, entity LIMIT 100",
    "agg15_title_words": f"WITH {_D}, t AS (SELECT title FROM d ORDER BY created_at DESC, doc_id LIMIT 1000) SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(title), ' ')) AS word FROM t) WHERE strlen(word) >= 2 GROUP BY word ORDER BY n DESC, word LIMIT 50",
    "agg07_fit": f"WITH {_D} SELECT source, count(*) AS n, round(avg(list_has_any({_TOK}, ['trial', 'dose', 'patients'])::INT) * 100, 4) AS fit_percent FROM d GROUP BY source",
    "top09_sentences": f"WITH {_D}, s AS (SELECT source, doc_id, unnest(string_split_regex(text, '[.!?。]\\s+')) AS sentence, generate_subscripts(string_split_regex(text, '[.!?。]\\s+'), 1) - 1 AS pos FROM d), k AS (SELECT source, doc_id, pos, ({' + '.join(f'contains(lower(sentence), {chr(39)}{w}{chr(39)})::INT' for w in WORDS)}) AS score FROM s WHERE strlen(sentence) BETWEEN 20 AND 500), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id, pos) AS rank FROM k WHERE score > 0) SELECT source, rank, doc_id, pos::BIGINT AS pos, score::BIGINT AS score FROM r WHERE rank <= 3",
}
SQL["fts05_stored"] = SQL["fts05_bm25"]
