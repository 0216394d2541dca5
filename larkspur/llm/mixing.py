"""Mixing sources to target shares of the total size, in tokens.

1. The texts of each source are sized in tokens of a public tokenizer and summed.
2. The total size is given, or else that of all available texts of the wanted
   sources. A source that cannot fill its share of it even when every text is
   used ``max_repeats`` times gives all it may; the rest is its shortfall.
3. The rate of a source is its wanted tokens over its available tokens. Each
   document is emitted floor(rate) times, plus once more with the probability of
   the fraction, decided by a hash of its key and a seed - the same on every run.

Scale: one pass to size the documents, one aggregate of one row a source, one
pass to emit, which reads the texts again and holds no token counts. The rates
are one row for each target; they are counted before they are broadcast.

Defined results: null, empty and blank texts are never emitted and not counted; a
source without target is not used; a target whose source does not exist, is
empty or may not be repeated reports its whole share as shortfall; shares that are
null or not positive want nothing; a document key that occurs twice is emitted for each row.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.session import cut, small_side

_loaded: dict[str, object] = {}


def _encoding(path: str):
    """The tokenizer at ``path``, loaded once in each worker."""
    if path not in _loaded:
        if path.endswith(".tiktoken"):
            import tiktoken

            try:
                from public_tokenizers import PATTERN
            except ImportError:  # Fixed value: the splitting pattern of byte-level BPE
                PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _loaded[path] = lambda texts: [len(own.encode_ordinary(t)) for t in texts]
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.encode_special_tokens = True
            _loaded[path] = lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    return _loaded[path]


def token_count(text: Column, tokenizer: str) -> Column:
    """Number of tokens of a text (0 if null)."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes = _encoding(tokenizer)
        for batch in batches:
            yield pd.Series(sizes([t if isinstance(t, str) else "" for t in batch]), dtype="int32")

    return count(text)


def source_rates(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """One row for each target: available and wanted tokens and the rate.

    ``sizes``: (source, tokens). ``targets``: (source, target_share, max_repeats)."""
    have = sizes.groupBy("source").agg(F.sum("tokens").cast("bigint").alias("available"), F.count(F.lit(1)).alias("n_documents"))
    targets = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = targets.join(have, "source", "left").na.fill({"available": 0, "n_documents": 0}).withColumn("share", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)))
    if total_tokens is None:
        total_tokens = float(rows.filter("share > 0").agg(F.sum("available")).first()[0] or 0)  # one number
    most = F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).cast("double")
    rows = rows.withColumn("wanted", F.col("share") * F.lit(total_tokens))
    return rows.withColumn("rate", F.when(F.col("available") > 0, F.least(F.col("wanted") / F.col("available"), most)).otherwise(0.0))


def copies_of(key: Column, rate: Column, seed: int) -> Column:
    """floor(rate) copies, and one more with the probability of the rest, drawn from a hash of the key."""
    draw = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix_sources(documents: DataFrame, targets: DataFrame, key: str, text: str, source: str, tokenizer: str, total_tokens: float | None = None, seed: int = 20_240_901) -> tuple[DataFrame, DataFrame]:
    """(emitted, report).

    emitted: (key, copy, source, text), one row for each copy of each document, copies numbered from 1.
    report: one row for each target with its actual tokens and share, and shortfall.
    ``tokenizer``: path of the vocabulary file, readable by every executor."""
    rows = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").cast("string").alias("text")).filter(F.col("text").rlike(r"\S"))
    sized = cut(rows.select("key", "source", token_count(F.col("text"), tokenizer).alias("tokens")).filter("tokens > 0"))
    rates = cut(source_rates(sized, targets, total_tokens))
    rate_of = small_side(rates.select("source", "rate"))

    def copied(df: DataFrame) -> DataFrame:
        return df.join(rate_of, "source").withColumn("copies", copies_of(F.col("key"), F.col("rate"), seed)).filter("copies > 0").drop("rate")

    # a text that is not blank has a token at least
    texts = copied(rows).select("key", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "source", "text")
    emitted = copied(sized)
    actual = emitted.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).cast("bigint").alias("actual_tokens"), F.count(F.lit(1)).alias("n_used"), F.max("copies").alias("most_copies"))
    report = rates.join(actual, "source", "left").na.fill({"actual_tokens": 0, "n_used": 0, "most_copies": 0})
    report = cut(report)
    mixed = float(report.agg(F.sum("actual_tokens")).first()[0] or 0)  # one number
    report = report.select(
        "source", "target_share", "max_repeats", "n_documents", "available", F.round("rate", 6).alias("rate"), "n_used", "most_copies", "actual_tokens",
        F.round(F.col("actual_tokens") / F.lit(mixed or 1.0), 6).alias("actual_share"),
        F.greatest(F.round(F.col("wanted") - F.col("rate") * F.col("available"), 0), F.lit(0.0)).cast("bigint").alias("shortfall_tokens"),
    )
    return texts, report
