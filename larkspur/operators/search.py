"""Full-text, semantic and hybrid search over DataFrames.

Query terms are few, so term statistics are computed by array functions inside
each document's row: nothing is exploded or shuffled but one row of corpus
statistics. For repeated use :class:`StoredIndex` keeps postings in files
partitioned by the hash of the term, of which a query reads its own terms' alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larkspur.functions.text import query_terms, tokens

K1, B, FLOOR = 1.2, 0.75, 1e-6


def postings(df: DataFrame, key: str, *cols: str) -> DataFrame:
    """(key, col, term, pos): the inverted index of text columns, positions from 0."""
    parts = [df.select(key, F.lit(c).alias("col"), F.posexplode(tokens(F.col(c))).alias("pos", "term")) for c in cols]
    return reduce(DataFrame.unionByName, parts).select(key, "col", "term", "pos")


def match_all(df: DataFrame, query: str, *cols: str) -> DataFrame:
    """Rows in which every term of the query occurs in some column."""
    return df.filter(reduce(lambda a, b: a & b, [_any(cols, t) for t in query_terms(query)], F.lit(True)))


def match_any(df: DataFrame, phrases: list[str], *cols: str) -> DataFrame:
    """Rows in which one of the expressions holds; terms within one are joined by AND."""
    hits = [reduce(lambda a, b: a & b, [_any(cols, t) for t in query_terms(p)]) for p in phrases if query_terms(p)]
    return df.filter(reduce(lambda a, b: a | b, hits, F.lit(False)))


def _any(cols: tuple[str, ...], term: str) -> Column:
    return reduce(lambda a, b: a | b, [F.array_contains(tokens(F.col(c)), F.lit(term)) for c in cols])


def match_phrase(df: DataFrame, phrase: str, *cols: str) -> DataFrame:
    """Rows in which the terms stand next to each other in one column."""
    want = " " + " ".join(query_terms(phrase)) + " "
    return df.filter(reduce(lambda a, b: a | b, [F.contains(F.concat(F.lit(" "), F.array_join(tokens(F.col(c)), " "), F.lit(" ")), F.lit(want)) for c in cols]))


def _occurrences(term: str) -> Column:
    return F.size(F.filter("_t", lambda x: x == F.lit(term)))


def bm25(df: DataFrame, key: str, text: str, query: str, mode: str = "or") -> DataFrame:
    """``df`` with ``score`` (rounded to 6 places) for the documents that match."""
    terms = query_terms(query)
    df = df.withColumn("_t", tokens(F.col(text))).withColumn("_len", F.size("_t"))
    counted = df.select("*", *[_occurrences(t).alias(f"_n{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("_len").alias("avg"), *[F.count_if(F.col(f"_n{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()  # one row
    mean = float(stats["avg"] or 1.0) or 1.0
    score, hits = F.lit(0.0), []
    for i in range(len(terms)):
        n = F.col(f"_n{i}").cast("double")
        idf = F.greatest(F.ln((F.lit(float(stats["n"])) - stats[f"df{i}"] + 0.5) / (F.lit(float(stats[f"df{i}"])) + 0.5)), F.lit(FLOOR))
        score = score + idf * n * (K1 + 1) / (n + K1 * (1 - B + B * F.col("_len") / mean))
        hits.append(F.col(f"_n{i}") > 0)
    want = reduce((lambda a, b: a & b) if mode == "and" else (lambda a, b: a | b), hits, F.lit(mode == "and"))
    extra = ["_t", "_len", *[f"_n{i}" for i in range(len(terms))]]
    return counted.withColumn("score", F.round(score, 6)).filter(want).drop(*extra)


class StoredIndex:
    """Postings (term, key, occurrences, length of the document) in Parquet files, partitioned
    by the hash of the term and sorted by term, with the corpus statistics beside them.

    A query reads the partitions of its terms, and of these the row groups that hold them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.stats = spark.read.parquet(f"{path}/stats").first()  # one row

    @classmethod
    def build(cls, df: DataFrame, key: str, text: str, path: str, buckets: int = 256) -> StoredIndex:
        docs = df.select(F.col(key).alias("key"), tokens(F.col(text)).alias("t"))
        counted = docs.select("key", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("key", "len", "term").agg(F.count(F.lit(1)).alias("n"))
        rows = counted.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        # a term of a third of all documents spreads over several files of its partition
        spread = rows.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(4))).sortWithinPartitions("bucket", "term")
        spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("mean"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/stats")
        return cls(df.sparkSession, path)

    def postings(self, terms: list[str]) -> DataFrame:
        """(term, key, n, len) of some terms."""
        of = [F.pmod(F.xxhash64(F.lit(t)), F.lit(int(self.stats["buckets"]))).cast("int").alias(f"b{i}") for i, t in enumerate(terms)]
        wanted = sorted(set(self.spark.range(1).select(*of).first())) if terms else []
        return self.spark.read.parquet(f"{self.path}/postings").filter(F.col("bucket").isin(*wanted) & F.col("term").isin(*terms)).select("term", "key", "n", "len")

    def bm25(self, query: str, mode: str = "or") -> DataFrame:
        """(key, score) of the documents that match, rounded to 6 places."""
        terms = query_terms(query)
        hits = self.postings(terms)
        frequency = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row for each query term
        mean, total = float(self.stats["mean"] or 1.0) or 1.0, float(self.stats["n"])
        idf = {t: max(math.log((total - d + 0.5) / (d + 0.5)), FLOOR) for t, d in frequency.items()}
        if not idf:
            return hits.select("key", F.lit(0.0).alias("score")).limit(0)
        weight = F.try_element_at(F.create_map(*[F.lit(x) for kv in idf.items() for x in kv]), F.col("term"))
        part = weight * F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("len") / mean))
        # documents that hold a query term, summed before the shuffle
        scored = hits.groupBy("key").agg(F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("found"))
        return scored.filter(F.col("found") == len(terms)).drop("found") if mode == "and" else scored.drop("found")


def exact_boost(df: DataFrame, text: Column, phrase: str, factor: float = 1.5) -> DataFrame:
    """Multiplies ``score`` where the phrase stands in the text; the order stays that of the raw score."""
    return df.withColumn("raw_score", F.col("score")).withColumn("score", F.round(F.when(F.contains(F.lower(text), F.lit(phrase.lower())), F.col("score") * factor).otherwise(F.col("score")), 6))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def nearest(df: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The ``k`` rows closest by cosine: brute force in one pass, top-k without a full sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.select(key, F.round(cosine(F.col(vector), q), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


class VectorBlock:
    """A block of query vectors, scored against batches of rows."""

    def __init__(self, queries: list[tuple], k: int):
        self.keys, self.k = [q for q, _ in queries], k
        self.groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by length: vectors of other lengths score 0
        for n in {len(v) for _, v in queries if v is not None and len(v)}:
            at = [i for i, (_, v) in enumerate(queries) if v is not None and len(v) == n]
            self.groups[n] = np.array(at), _unit([queries[i][1] for i in at])

    def scores(self, vectors: list) -> np.ndarray:
        """Cosines rounded to 6 places, a row for each query; 0 where a norm is 0."""
        out = np.zeros((len(self.keys), len(vectors)))
        for n, (at, unit) in self.groups.items():
            rows = [j for j, v in enumerate(vectors) if v is not None and len(v) == n]
            if rows:
                out[np.ix_(at, rows)] = unit @ _unit([vectors[j] for j in rows]).T
        return np.round(out, 6) + 0.0

    def best(self, batches: Iterator[tuple[list, list]], step: int = 1000) -> list[tuple]:
        """(query, key, score): the ``k`` best rows of all batches for each query."""
        kept: list[list[tuple]] = [[] for _ in self.keys]
        for keys, vectors in batches:
            for start in range(0, len(keys), step):
                some, score = keys[start : start + step], self.scores(vectors[start : start + step])
                for i, row in enumerate(score):
                    least = kept[i][-1][0] if len(kept[i]) == self.k else math.inf
                    if len(row) > self.k:
                        least = min(least, -np.partition(row, -self.k)[-self.k])
                    found = [(-float(row[j]), some[j]) for j in np.flatnonzero(row >= -least)]
                    kept[i] = sorted(kept[i] + found)[: self.k]
        return [(q, key, -score) for q, best in zip(self.keys, kept) for score, key in best]


def _unit(vectors: list) -> np.ndarray:
    m = np.array([np.asarray(v, np.float64) for v in vectors])
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def nearest_each(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int, block: int = 2000) -> DataFrame:
    """(query_id, ``key``, score, rank): for each row of ``queries`` the ``k`` rows of ``df`` closest by cosine.

    Queries are broadcast in blocks of about ``block``, each scored against all
    rows; only the ``k`` best of a partition and query are shuffled."""
    spark = df.sparkSession
    q_type, key_type = queries.schema[key].dataType.simpleString(), df.schema[key].dataType.simpleString()
    wanted = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("vector"))
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    blocks = max(1, math.ceil(wanted.count() / block))
    parts = []
    for b in range(blocks):
        some = wanted.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast(VectorBlock([(r["query_id"], r["vector"]) for r in some], k))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            found = shared.value.best((batch["key"].tolist(), batch["vector"].tolist()) for batch in batches)
            yield pd.DataFrame(found, columns=["query_id", "key", "score"])

        parts.append(rows.mapInPandas(scan, f"query_id {q_type}, key {key_type}, score double"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "key")
    found = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(best).cast("bigint")).filter(F.col("rank") <= k)
    return found.select("query_id", F.col("key").alias(key), "score", "rank")


def fuse(a: DataFrame, b: DataFrame, key: str | list[str], wa: float = 0.5, wb: float = 0.5, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two short ranked lists (``key``, ``rank``)."""
    keys = [key] if isinstance(key, str) else key
    x, y = a.select(*keys, F.col("rank").alias("rank_a")), b.select(*keys, F.col("rank").alias("rank_b"))
    both = x.join(y, keys, "full")
    score = F.coalesce(wa / (k + F.col("rank_a")), F.lit(0.0)) + F.coalesce(wb / (k + F.col("rank_b")), F.lit(0.0))
    found = F.when(F.col("rank_a").isNotNull() & F.col("rank_b").isNotNull(), "hybrid:both").when(F.col("rank_a").isNotNull(), "hybrid:fts").otherwise("hybrid:semantic")
    return both.select(*keys, "rank_a", "rank_b", F.round(score, 8).alias("score"), found.alias("source"))
