"""Trends over two adjacent half-open windows: hot, bursting, new, by dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larkspur.functions.scores import two_decimals
from larkspur.functions.text import entities, keywords, letter_count


def windowed(df: DataFrame, time: str, previous: str, since: str, until: str) -> DataFrame:
    """Rows of the current window (since, until] and the previous (previous, since], marked ``cur``."""
    t = F.col(time)
    cur = (t > F.lit(since).cast("timestamp")) & (t <= F.lit(until).cast("timestamp"))
    prev = (t > F.lit(previous).cast("timestamp")) & (t <= F.lit(since).cast("timestamp"))
    return df.filter(cur | prev).withColumn("cur", cur)


def counts_by_window(rows: DataFrame, items: Column) -> DataFrame:
    """(kw, n, before): occurrences now and before, in one aggregation."""
    return rows.select("cur", F.explode(items).alias("kw")).groupBy("kw").agg(F.count_if("cur").alias("n"), F.count_if(~F.col("cur")).alias("before"))


def hot(counts: DataFrame, k: int) -> DataFrame:
    return counts.filter("n > 0").select("kw", "n").orderBy(F.desc("n"), "kw").limit(k)


def bursts(counts: DataFrame, k: int = 20, least: int = 5, ratio: float = 1.5, window: int = 100) -> DataFrame:
    """Among the ``window`` most frequent: ten times the count if new, else the ratio to before; kept from ``ratio``."""
    top = counts.filter("n > 0").orderBy(F.desc("n"), "kw").limit(window)
    burst = two_decimals(F.when(F.col("before") == 0, F.col("n") * 10.0).otherwise(F.col("n") / F.col("before")))
    return top.filter(F.col("n") >= least).select("kw", "n", "before", burst.alias("burst")).filter(F.col("burst") >= ratio).orderBy(F.desc("burst"), F.desc("n"), "kw").limit(k)


def emerging(rows: DataFrame, title: Column, k: int = 20, least: int = 3, window: int = 50) -> DataFrame:
    """Entities of the current window that did not occur before."""
    counts = counts_by_window(rows, entities(title))
    top = counts.filter("n > 0").orderBy(F.desc("n"), "kw").limit(window)
    return top.filter((F.col("n") >= least) & (letter_count(F.col("kw")) > 2) & (F.col("before") == 0)).select("kw", "n").orderBy(F.desc("n"), "kw").limit(k)


def matrix(rows: DataFrame, dimension: str, items: Column, per_key: int = 10, keys: int = 20) -> DataFrame:
    """(dimension, rank, kw, n): the most frequent keywords of each value, of the values with the longest lists."""
    counts = rows.filter("cur").filter(F.col(dimension).isNotNull()).select(dimension, F.explode(items).alias("kw")).groupBy(dimension, "kw").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy(dimension).orderBy(F.desc("n"), "kw"))).filter(F.col("rank") <= per_key)
    best = ranked.groupBy(dimension).agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), dimension).limit(keys).select(dimension)
    return ranked.join(best, dimension, "left_semi").select(dimension, F.col("rank").cast("bigint").alias("rank"), "kw", "n")


def cross_source(rows: DataFrame, kind: Column, items: Column, a: str, b: str, least_a: int = 3, least_b: int = 2, k: int = 20) -> DataFrame:
    """Keywords frequent in two kinds of source at once."""
    n = rows.filter("cur").select(kind.alias("kind"), F.explode(items).alias("kw")).groupBy("kw").agg(F.count_if(F.col("kind") == a).alias("n_a"), F.count_if(F.col("kind") == b).alias("n_b"))
    return n.filter((F.col("n_a") >= least_a) & (F.col("n_b") >= least_b)).select("kw", "n_a", "n_b", (F.col("n_a") + F.col("n_b")).alias("total")).orderBy(F.desc("total"), "kw").limit(k)


def trend_keywords(text: Column) -> Column:
    return keywords(text, 3)
