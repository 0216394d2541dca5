"""Term vectors in long form: tf, idf, cosine, relevance, smoothed ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larkspur.functions.text import tokens
from larkspur.session import cut


def term_counts(df: DataFrame, key: str, text: str, least_bytes: int = 2) -> DataFrame:
    """(key, term, n)."""
    return df.select(key, F.explode(tokens(F.col(text), least_bytes)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """(term, df) of a (key, term) table that has each pair once."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def augmented_tf(counts: DataFrame, key: str) -> DataFrame:
    """(key, term, n, tf) with tf = 0.5 + 0.5 n / the largest n of the document."""
    return counts.withColumn("tf", 0.5 + 0.5 * F.col("n") / F.max("n").over(W.partitionBy(key)))


def keyword_relevance(text: Column, words: list[str]) -> Column:
    """Weighted share of the keywords found: as a token with full weight, else as a part of the text with 0.8."""
    folded = list(dict.fromkeys(w.lower() for w in words if w.strip()))
    if not folded:
        return F.lit(0.5)
    n = len(folded)
    weights = {w: 1 + (n - i) / n for i, w in enumerate(folded)}
    found, low = tokens(text, 2), F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0.0)
    for w, x in weights.items():
        total = total + F.when(F.array_contains(found, F.lit(w)), x).when(F.contains(low, F.lit(w)), 0.8 * x).otherwise(0.0)
    return F.when(F.size(found) == 0, 0.0).otherwise(F.least(total / sum(weights.values()), F.lit(1.0)))


def tfidf_relevance(candidates: DataFrame, positives: DataFrame, key: str, text: str) -> DataFrame:
    """(key, score): mean cosine of a candidate with the positive documents.

    The mean of cosines is one dot product with the sum of the positives' unit
    vectors, so candidates meet a single vector and never every positive."""
    p = augmented_tf(term_counts(positives, key, text), key)
    n = positives.count()
    idf = document_frequency(p).select("term", F.ln((F.lit(float(n)) + 1) / (F.col("df") + 1)).alias("idf"))
    pv = p.join(idf, "term").withColumn("v", F.col("tf") * F.col("idf"))
    unit = pv.withColumn("norm", F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy(key)))).filter("norm > 0")
    centre = unit.groupBy("term").agg((F.sum(F.col("v") / F.col("norm")) / n).alias("c"))
    cv = augmented_tf(term_counts(candidates, key, text), key).join(idf, "term").withColumn("v", F.col("tf") * F.col("idf"))
    scored = cv.join(centre, "term", "left").groupBy(key).agg(F.sum(F.col("v") * F.coalesce("c", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return candidates.select(key).join(scored, key, "left").select(key, F.round(F.coalesce(F.when(F.col("norm") > 0, F.col("dot") / F.col("norm")), F.lit(0.0)), 6).alias("score"))


def smoothed_rank(candidates: DataFrame, positives: DataFrame, key: str, text: str) -> DataFrame:
    """(key, score) in 0..1: similarity to the mean positive vector blended with
    its overlap, weighted by how much evidence there is (n / (n + 5))."""
    n = positives.count()
    if not n:
        return candidates.select(key, F.lit(0.5).alias("score"))
    pt = augmented_tf(term_counts(positives, key, text), key)
    ct = cut(augmented_tf(term_counts(candidates, key, text), key))  # read three times below
    vocab = document_frequency(pt).filter("df >= 2").select("term", F.col("df").alias("df_p"))
    everything = float(n + candidates.count())
    df = vocab.join(document_frequency(ct), "term", "left").select("term", (F.col("df_p") + F.coalesce("df", F.lit(0))).alias("df"))
    idf = df.select("term", F.ln(F.lit(everything) / (F.col("df") + 1)).alias("idf"))
    mean = cut(pt.join(idf, "term").groupBy("term").agg((F.sum(F.col("tf") * F.col("idf")) / n).alias("m"), F.first("idf").alias("idf")))
    stats = mean.agg(F.count(F.lit(1)).alias("size"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("length")).first()  # one row
    size, length = float(max(stats["size"], 1)), float(stats["length"] or 0.0)
    joined = ct.join(mean, "term").withColumn("v", F.col("tf") * F.col("idf"))
    parts = joined.groupBy(key).agg(F.sum(F.col("v") * F.col("m")).alias("dot"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.count_if(F.col("v") > 0).alias("hits"))
    alpha = n / (n + 5.0)
    cos = F.when((F.col("norm") > 0) & F.lit(length > 0), F.col("dot") / (F.col("norm") * F.lit(length or 1.0))).otherwise(0.0)
    score = alpha * (0.7 * cos + 0.3 * F.col("hits") / size) + (1 - alpha) * 0.5
    return candidates.select(key).join(parts, key, "left").select(key, F.round(F.coalesce(score, F.lit((1 - alpha) * 0.5)), 6).alias("score"))


def feedback_terms(df: DataFrame, key: str, text: str, relevant: Column) -> DataFrame:
    """(term, score): tf of relevant pages less half the tf of others."""
    tf = augmented_tf(term_counts(df, key, text), key).join(df.select(key, relevant.alias("rel")), key)
    return tf.groupBy("term").agg(F.round(F.sum(F.when(F.col("rel"), F.col("tf")).otherwise(-0.5 * F.col("tf"))), 6).alias("score"))


def relevance(candidates: DataFrame, positives: DataFrame | None, key: str, text: str, words: list[str]) -> DataFrame:
    """(key, score): keyword relevance, blended 0.6 to 0.4 with the likeness to positive documents if there are any."""
    by_words = candidates.select(key, keyword_relevance(F.col(text), words).alias("w"))
    if positives is None or positives.isEmpty():
        return by_words.select(key, F.round("w", 6).alias("score"))
    blended = by_words.join(tfidf_relevance(candidates, positives, key, text).withColumnRenamed("score", "t"), key)
    return blended.select(key, F.round(0.6 * F.col("w") + 0.4 * F.col("t"), 6).alias("score"))


def filter_specific(keywords: DataFrame, specificity: DataFrame, least: float) -> DataFrame:
    """Keywords (``kw``) whose specificity reaches ``least``; those without one are kept."""
    known = specificity.select(F.lower("kw").alias("__kw"), F.col("specificity").alias("__s"))
    rows = keywords.join(known, F.lower(keywords["kw"]) == F.col("__kw"), "left")
    return rows.filter(F.col("__s").isNull() | (F.col("__s") >= least)).drop("__kw", "__s")
