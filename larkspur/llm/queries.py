"""The pN_ queries of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.language import language_segments
from larkspur.llm.leaks import find_leaks
from larkspur.llm.mixing import mix_sources
from larkspur.llm.names import link_names, name_pairs
from larkspur.llm.sentences import split_sentences
from larkspur.session import table


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = table(spark, sf_dir, "clinical_trials").select(F.lit("clinical_trials.sponsor").alias("field"), F.lit("organisation").alias("kind"), F.col("sponsor").alias("name"))
    bills = table(spark, sf_dir, "congress_bills").select(F.lit("congress_bills.sponsor_name").alias("field"), F.lit("person").alias("kind"), F.col("sponsor_name").alias("name"))
    return link_names(trials.unionByName(bills), "field", "kind", "name")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of different spellings of one entity within a field."""
    return name_pairs(_names(spark, sf_dir))


def p1_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with its entity and the number of spellings it is linked to."""
    linked = _names(spark, sf_dir)
    sizes = linked.groupBy("field", "entity").agg((F.count(F.lit(1)) - 1).alias("n_links"))
    return linked.join(sizes, ["field", "entity"]).select("field", "name", "n_rows", "entity", "n_links")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    feeds = table(spark, sf_dir, "feeds").select(F.col("id").alias("feed_id"), "title", "language")
    return language_segments(feeds, "feed_id", "title", "language")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of every title that is not wholly in its stated language."""
    rows = _segments(spark, sf_dir)
    wrong = F.col("stated").isNull() | (F.col("n_segments") > 1) | (F.col("language") != F.col("stated"))
    return rows.filter(wrong & F.col("feed_id").isNotNull()).select("feed_id", "segment", "language").distinct()


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every title with its language and calibrated confidence."""
    return _segments(spark, sf_dir).select("feed_id", "stated", "segment", "language", F.round("confidence", 4).alias("confidence"), "segment_text")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the evaluation items leaked into them."""
    return _leaks(spark, sf_dir).filter("doc_id is not null and item_id is not null").select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items leaked, into how many documents, and how completely."""
    leaks = _leaks(spark, sf_dir)
    benchmark = table(spark, sf_dir, "eval_items").select("item_id", "benchmark")
    return leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("matched_words").alias("most_words")).join(benchmark, "item_id")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tokenizer = spark.conf.get("spark.larkspur.tokenizer", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), "doc_id", "text", "source", tokenizer)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached per wanted source, with any shortfall."""
    return _mix(spark, sf_dir)[1]


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture itself: one row for each copy of each document, with its text."""
    return _mix(spark, sf_dir)[0].withColumnRenamed("key", "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence unit of every document with its place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter("doc_id is not null")
    return split_sentences(docs, "doc_id", "text")


def p10_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and length of the sentence units of each language label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").filter("doc_id is not null")
    units = split_sentences(docs.withColumn("key", F.struct("doc_id", "lang")), "key", "text").select("key.lang", (F.col("end_char") - F.col("start_char")).alias("n"))
    return units.groupBy("lang").agg(F.count(F.lit(1)).alias("n_units"), F.sum("n").cast("bigint").alias("n_chars"), F.max("n").alias("longest"))


QUERIES = {
    "p1_found": p1_found,
    "p1_spellings": p1_spellings,
    "p5_found": p5_found,
    "p5_segments": p5_segments,
    "p8_found": p8_found,
    "p8_items": p8_items,
    "p9_mix": p9_mix,
    "p9_documents": p9_documents,
    "p10_found": p10_found,
    "p10_lengths": p10_lengths,
}
