"""Keyed tables without a transactional format: the new state is a DataFrame.

Write it to a new path and swap; never overwrite a path that is being read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def replace_on_key(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The last writer of a key wins with its whole row; within ``new`` the highest ``order``."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(F.desc("_batch"), F.desc(order)))).filter("_rn = 1").drop("_rn", "_batch")


def insert_ignore(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of ``new`` to add: keys not in ``old``, the first of each in ``order``."""
    first = new.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(order))).filter("_rn = 1").drop("_rn")
    return first.join(old.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, prefer_new: list[str], overwrite: list[str]) -> DataFrame:
    """New values win where not null (``prefer_new``) or always (``overwrite``); other columns stay."""
    o, n = old.alias("o"), new.alias("n")
    matched = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    out = [F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key)]
    for c in old.columns:
        if c == key:
            continue
        exists = F.col(f"n.{key}").isNotNull()
        if c in overwrite:
            out.append(F.when(exists, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        elif c in prefer_new:
            out.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.when(F.col(f"o.{key}").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return matched.select(*out)


def update_where(df: DataFrame, cond: Column, col: str, value: Column) -> DataFrame:
    return df.withColumn(col, F.when(F.coalesce(cond, F.lit(False)), value).otherwise(F.col(col)))


def delete_where(df: DataFrame, cond: Column) -> DataFrame:
    """Rows for which the condition is not true (unknown keeps a row)."""
    return df.filter(~F.coalesce(cond, F.lit(False)))


def list_rows(df: DataFrame, where: dict[str, object], order: list, limit: int | None = None) -> DataFrame:
    """Rows equal on every given column, ordered, optionally limited."""
    for c, v in where.items():
        if v not in (None, ""):
            df = df.filter(F.col(c) == F.lit(v))
    df = df.orderBy(*order)
    return df.limit(limit) if limit else df


def group_stats(df: DataFrame, dims: list[str]) -> DataFrame:
    """(dimension, key, n) for each dimension, in one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("")).alias("key")) for d in dims])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.key").agg(F.count(F.lit(1)).alias("n"))
