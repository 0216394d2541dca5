from pyspark.sql import functions as F

from larkspur.llm.mixing import mix_sources, token_count

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def test_shares(spark):
    docs = [(i, "a" if i < 3000 else "b" if i < 3300 else "c", "one two three four five") for i in range(3400)] + [(9000, "a", None), (9001, "a", ""), (9002, None, "x")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "1 as tokens", "2 as rate")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.1, 2), ("ghost", 0.05, 9), ("off", 0.0, 1), (None, 0.05, 1)], "source string, target_share double, max_repeats int")
    emitted, report = mix_sources(d, t, "doc_id", "text", "source", TOKENIZER)
    r = {x.source: x for x in report.collect()}
    total = 3400 * 5
    assert abs(r["a"].actual_tokens - 0.5 * total) < 0.03 * total  # 1700 of 3000 documents
    assert r["a"].most_copies == 1 and r["a"].shortfall_tokens == 0
    assert r["b"].rate == round(0.3 * total / 1500, 6) and r["b"].most_copies <= 4 and abs(r["b"].actual_tokens - 0.3 * total) < 0.02 * total
    assert r["c"].most_copies == 2 and r["c"].actual_tokens == 1000 and r["c"].shortfall_tokens == round(0.1 * total) - 1000
    assert r["ghost"].actual_tokens == 0 and r["ghost"].shortfall_tokens == round(0.05 * total)
    assert r["off"].actual_tokens == 0 and abs(sum(x.actual_share for x in r.values()) - 1) < 1e-5
    assert emitted.columns == ["key", "copy", "source", "text"]
    tokens = {x.source: x.n for x in emitted.groupBy("source").agg(F.sum(token_count(F.col("text"), TOKENIZER)).alias("n")).collect()}
    assert tokens == {k: x.actual_tokens for k, x in r.items() if x.actual_tokens}
    copies = {(x.source, x.n) for x in emitted.groupBy("source", "key").agg(F.count("*").alias("n"), F.max("copy").alias("last")).filter("n = last").collect()}
    whole = int(0.3 * total / 1500)
    assert copies == {("a", 1), ("b", whole), ("b", whole + 1), ("c", 2)}  # floor(rate) and one more at the most
    again, _ = mix_sources(d.repartition(7), t, "doc_id", "text", "source", TOKENIZER)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, emitted.collect()))  # the same on every run


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, source string, text string")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    emitted, report = mix_sources(d, t, "doc_id", "text", "source", TOKENIZER)
    assert emitted.count() == 0 and report.first().actual_share == 0.0
    assert mix_sources(d, t.limit(0), "doc_id", "text", "source", TOKENIZER)[1].count() == 0


def test_tokenizers(spark):
    df = spark.createDataFrame([("hello world",), (None,), ("",), ("<|endoftext|>",)], "t string")
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"):
        n = [r.n for r in df.select(token_count(F.col("t"), f"/opt/tokenizers/{name}").alias("n")).collect()]
        assert n[0] in (2, 3) and n[1] == n[2] == 0 and n[3] > 1, name
