"""Curation of sources: quotas by tier, stratified samples, dedupe, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def keep_first(df: DataFrame, by: Column, *order: Column | str) -> DataFrame:
    """One row for each value of ``by``: the first in ``order``."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter("_rn = 1").drop("_rn")


def tier_quota(df: DataFrame, key: str, most: int, least: int) -> DataFrame:
    """At most ``most`` rows by tier then trust: a third of tier 1, half of tier
    2 (which any other tier counts as), a quarter of tier 3; filled up to ``least`` from the rest.

    Each tier's best are taken by a limit of their own, which keeps no more than
    the quota in any task; the one ordered partition holds at most ``most`` rows of each tier."""
    of = F.when(F.col("tier").isin(1, 3), F.col("tier")).otherwise(2)
    order = [of, F.desc("trust"), key]
    parts = [df.filter(of == t).orderBy(F.desc("trust"), key).limit(quota) for t, quota in ((1, most // 3), (2, most // 2), (3, most // 4))]
    kept = parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy(*order).limit(most)
    lacking = max(0, least - kept.count())
    if lacking:
        # the kept rows are fewer than ``least`` here
        rest = df.join(F.broadcast(kept.select(key)), key, "left_anti").select(*df.columns).orderBy(*order).limit(lacking)
        kept = kept.unionByName(rest)
    return kept


def round_robin(df: DataFrame, stratum: str, order: str, target: int) -> DataFrame:
    """``target`` rows, taken in turn from each stratum in alphabetical order.

    No stratum gives more than ``target``, so each task keeps but that many before the shuffle."""
    turns = df.withColumn("turn", F.row_number().over(W.partitionBy(stratum).orderBy(order)).cast("bigint")).filter(F.col("turn") <= target)
    return turns.orderBy("turn", stratum, order).limit(target)


def tier_histogram(df: DataFrame) -> DataFrame:
    """Rows for tiers 1 to 3, zero included; any other tier counts as 2."""
    tiers = df.sparkSession.createDataFrame([(1,), (2,), (3,)], "tier int")
    n = df.groupBy(F.when(F.col("tier").isin(1, 2, 3), F.col("tier")).otherwise(2).alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    return tiers.join(n, "tier", "left").na.fill({"n": 0})


def gaps(counts: DataFrame, ratios: dict[str, float], size: int, critical: int) -> DataFrame:
    """(lang, target, n, gap, critical) where fewer rows exist than the ratio of ``size`` asks for."""
    want = counts.sparkSession.createDataFrame([(k, int(v * size)) for k, v in ratios.items()], "lang string, target bigint")
    return want.join(counts, "lang", "left").na.fill({"n": 0}).withColumn("gap", F.col("target") - F.col("n")).filter("gap > 0").withColumn("critical", F.col("gap") > critical)
