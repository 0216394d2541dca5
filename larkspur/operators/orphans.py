"""References to keys that do not exist, for composite keys with nulls.

References are grouped by their null mask (which key columns are null); each
mask that occurs is anti-joined on its non-null columns only, under the declared
match semantics of SQL foreign keys:

* ``simple``: a reference with any null column is satisfied;
* ``partial``: the non-null columns must occur together in one key, an
  all-null reference is satisfied;
* ``full``: all columns null is satisfied, some null fails, none null must match.

References are pre-aggregated to distinct key tuples before the shuffle, so a
key that a third of all rows refer to is joined once. Where each reference has
to meet its key again, only keys found hot are salted.

Defined results: an empty key table makes every checked reference an orphan; an
empty reference table gives an empty table; repeated keys and rows change
nothing but counts; any number of key columns will do; columns beside those
named are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHES = ("simple", "partial", "full")


def null_mask(on: list[str]) -> Column:
    """One character for each column: 1 where it is null, else 0."""
    return F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in on])


def orphan_keys(refs: DataFrame, keys: DataFrame, on: list[str], match: str = "simple") -> DataFrame:
    """The distinct tuples of ``on`` in ``refs`` that fail to match ``keys``,
    with ``null_mask`` (a character for each column, 1: null) and ``n_refs``."""
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    names = [F.col(f"`{c}`") for c in on]
    tuples = refs.select(*names).groupBy(*names).agg(F.count(F.lit(1)).alias("n_refs")).withColumn("null_mask", null_mask(on))
    none, everything = "0" * len(on), "1" * len(on)
    # the masks that occur, at most one for each subset of the columns; a simple match needs no other than the full key
    masks = [none] if match == "simple" else [r["null_mask"] for r in tuples.select("null_mask").distinct().collect()]
    parts = [tuples.filter("false").select(*names, "null_mask", "n_refs")]
    for m in sorted(masks):
        if m == everything:
            continue
        part = tuples.filter(F.col("null_mask") == m)
        if m == none or match == "partial":
            given = [c for c, null in zip(on, m) if null == "0"]
            part = part.join(keys.select(*[F.col(f"`{c}`") for c in given]).dropna().distinct(), given, "left_anti")
        parts.append(part.select(*names, "null_mask", "n_refs"))
    return reduce(DataFrame.unionByName, parts)


def failed_references(
    refs: DataFrame, keys: DataFrame, removals: DataFrame, on: list[str], seen: str, stored: str, removed: str, by: str, match: str = "simple", hot: DataFrame | None = None
) -> DataFrame:
    """The rows of ``refs`` whose key fails at the moment ``seen``, with ``kind``.

    kind is ``deleted`` if ``removals`` has the key with ``removed`` no later
    than that moment, else ``missing`` if the key is an orphan (see
    :func:`orphan_keys`), else ``late`` if the key's earliest ``stored`` is after
    that moment. ``by``: a column of ``refs`` that tells rows of one key apart;
    ``hot``: keys to salt, for instance from :func:`hot_keys`."""
    key = F.to_json(F.struct(*[F.col(f"`{c}`") for c in on])).alias("__key")  # leaves nulls out, so masks keep apart
    first_stored = keys.select(key, F.col(f"`{stored}`").alias("t")).groupBy("__key").agg(F.min("t").alias("__stored"))
    first_removed = removals.select(key, F.col(f"`{removed}`").alias("t")).groupBy("__key").agg(F.min("t").alias("__removed"))
    missing = orphan_keys(refs, keys, on, match).select(key, F.lit(True).alias("__missing"))
    # one row for every key that may fail; unique on the key
    state = first_stored.join(first_removed, "__key", "full").join(missing, "__key", "full")
    joined = salted_join(refs.select("*", key), state, ["__key"], by=by, hot=hot.select(key).distinct() if hot is not None else None)
    moment = F.col(f"`{seen}`")
    kind = F.when(F.col("__removed") <= moment, "deleted").when(F.col("__missing"), "missing").when(F.col("__stored") > moment, "late")
    return joined.withColumn("kind", kind).filter("kind is not null").drop("__key", "__stored", "__removed", "__missing")


def hot_keys(df: DataFrame, on: list[str], share: float = 1 / 64) -> DataFrame:
    """The tuples of ``on`` that hold more than ``share`` of all rows: fewer than 1 / share."""
    most = df.count() * share  # one number
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most).select(*on)


def salted_join(big: DataFrame, small: DataFrame, on: list[str], by: str, how: str = "left", salts: int = 16, hot: DataFrame | None = None) -> DataFrame:
    """Joins ``big`` to ``small`` (unique on ``on``); the rows of one hot key go
    to ``salts`` tasks, chosen by the hash of column ``by`` of ``big``, and only
    hot keys of ``small`` are repeated. ``hot``: a table of few keys (fewer than
    1 / share by :func:`hot_keys`, which is applied to ``big`` if none is given)."""
    marked = F.broadcast((hot_keys(big, on) if hot is None else hot).select(*on, F.lit(True).alias("__hot")))
    salted = big.join(marked, on, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("__hot")
    copies = small.join(marked, on, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")
