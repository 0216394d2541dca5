import pytest
from pyspark.sql import functions as F

from larkspur.operators import curate, search, store, vectors
from larkspur.operators.feedback import Expander, learn


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "Clinical trial of a new drug"), (2, "weather is fine"), (3, "the trial, the clinical one"), (4, ""), (5, None), (6, "drug trial drug")]
    return spark.createDataFrame(rows, "id int, text string")


def test_matching(docs):
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(search.match_all(docs, "clinical trial", "text")) == [1, 3]
    assert ids(search.match_any(docs, ["weather", "drug trial"], "text")) == [1, 2, 6]
    assert ids(search.match_phrase(docs, "clinical trial", "text")) == [1]
    assert {(r.term, r.pos) for r in search.postings(docs.filter("id = 2"), "id", "text").collect()} == {("weather", 0), ("is", 1), ("fine", 2)}
    top = search.bm25(docs, "id", "text", "drug").orderBy(F.desc("score")).collect()
    assert [r.id for r in top] == [6, 1] and search.bm25(docs.limit(0), "id", "text", "drug").count() == 0
    assert ids(search.bm25(docs, "id", "text", "drug clinical", mode="and")) == [1]


def test_fusion(spark):
    a, b = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int"), spark.createDataFrame([(2, 1), (3, 2)], "id int, rank int")
    got = {r.id: (r.source, r.score) for r in search.fuse(a, b, "id").collect()}
    assert got[2] == ("hybrid:both", round(0.5 / 62 + 0.5 / 61, 8)) and got[1][0] == "hybrid:fts" and got[3][0] == "hybrid:semantic"


def test_relevance(docs):
    got = {r.id: r.s for r in docs.select("id", vectors.keyword_relevance(F.col("text"), ["clinical trial", "drug"]).alias("s")).collect()}
    assert got[1] > 0.5 and got[2] == 0.0 and got[4] == 0.0 and got[5] == 0.0
    assert docs.select(vectors.keyword_relevance(F.col("text"), []).alias("s")).first().s == 0.5


def test_smoothed_rank(spark):
    pos = spark.createDataFrame([(i, t) for i, t in enumerate(["deep learning model", "deep neural learning", "learning deep networks", "model of deep learning", "neural model learning"])], "id int, text string")
    cand = spark.createDataFrame([(1, "deep learning neural model"), (2, "cooking pasta at home"), (3, "learning deep model"), (4, "sunny beach")], "id int, text string")
    s = {r.id: r.score for r in vectors.smoothed_rank(cand, pos, "id", "text").collect()}
    assert s[1] + s[3] > s[2] + s[4]
    assert [r.score for r in vectors.smoothed_rank(cand.limit(1), pos.limit(0), "id", "text").collect()] == [0.5]
    assert vectors.smoothed_rank(cand.limit(0), pos, "id", "text").count() == 0


def test_store(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, u string, v string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", None)], "id int, u string, v string")
    got = {tuple(r) for r in store.upsert(old, new, "id", ["u"], ["v"]).select("id", "u", "v").collect()}
    assert got == {(1, "a", "x"), (2, "b", "y"), (3, "c", None)}
    assert {r.id for r in store.insert_ignore(old, new, "id", "u").collect()} == {3}
    assert {tuple(r) for r in store.replace_on_key(old, new, "id", "u").collect()} == {(1, "a", "x"), (2, None, "y"), (3, "c", None)}
    assert store.delete_where(old, F.col("v") == "x").count() == 1
    assert {(r.dimension, r.key, r.n) for r in store.group_stats(old, ["v"]).collect()} == {("v", "x", 1), ("v", "", 1)}


def test_quota(spark):
    df = spark.createDataFrame([(i, 1 + i % 3, 1.0 / (1 + i)) for i in range(60)], "id int, tier int, trust double")
    n = {r.tier: r["count"] for r in curate.tier_quota(df, "id", 12, 5).groupBy("tier").count().collect()}
    assert n == {1: 4, 2: 6, 3: 2}
    assert curate.tier_quota(df, "id", 12, 20).count() == 20
    assert [r.id for r in curate.round_robin(df.withColumn("s", F.col("tier").cast("string")), "s", "id", 4).collect()] == [0, 1, 2, 3]


@pytest.mark.parametrize(
    ("words", "text", "low", "high"),
    [
        (["clinical trial", "FDA", "drug", "pharmaceutical"], "The FDA approved the drug after a clinical trial by a pharmaceutical firm", 0.5, 1.0),
        (["clinical trial", "FDA", "drug", "pharmaceutical"], "FDA warns about a drug", 0.2, 0.7),
        (["clinical trial", "FDA", "drug", "pharmaceutical"], "Sunny weather all week", 0.0, 0.1),
        (["clinical trial", "FDA", "drug", "pharmaceutical"], "", 0.0, 0.0),
        (["C++", "C#", ".NET"], "Programming in C++, C# and .NET", 0.3, 1.0),
    ],
)
def test_relevance_bounds(spark, words, text, low, high):
    s = spark.createDataFrame([(text,)], "text string").select(vectors.keyword_relevance(F.col("text"), words).alias("s")).first().s
    assert low <= s <= high


def test_relevance_grows_with_matches_and_ignores_case(spark):
    words = ["AI", "machine learning", "deep learning"]
    texts = ["AI here", "AI and machine learning", "AI and machine learning and deep learning", "ai AND MACHINE LEARNING AND DEEP LEARNING"]
    s = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i").select(vectors.keyword_relevance(F.col("text"), words).alias("s")).collect()]
    assert s[0] < s[1] < s[2] == s[3]


def test_nearest_of_a_set_of_queries(spark):
    rows = [(i, [float(i % 7) - 3, float(i % 5) - 2, 1.0]) for i in range(40)] + [(40, None), (41, [0.0, 0.0, 0.0]), (42, [1.0]), (43, [])]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    queries = df.filter("id % 10 = 0")  # 40 has no vector
    want = {}
    for q in (0, 10, 20, 30):
        want[q] = [(r.id, r.score) for r in search.nearest(df, "id", "v", rows[q][1], 6).orderBy(F.desc("score"), "id").collect()]
    for block in (100, 2):
        got = {}
        for r in search.nearest_each(df, "id", "v", queries, 6, block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, r.score))
        assert {q: got[q] for q in want} == want and set(got) == {*want, 40} and got[40] == [(i, 0.0) for i in range(6)]
    assert search.nearest_each(df, "id", "v", queries.limit(0), 6).count() == 0 and search.nearest_each(df.limit(0), "id", "v", queries, 6).count() == 0


def test_feedback_updates_every_term_in_every_round(spark):
    """A term that gained in the first round falls in the second, however many other terms the second has."""
    first = spark.createDataFrame([(1, "seed gained gained " + "other")], "id int, t string")
    many = " ".join(f"word{i}" for i in range(700))
    second = spark.createDataFrame([(1, f"seed {many}"), (2, "gained"), (3, "gained"), (4, "gained")], "id int, t string")
    e = Expander(["seed"])
    learn(e, first, "id", "t", F.col("id") == 1)
    assert e.scores["gained"] == 1.0 and e.scores["seed"] == 1.75
    e.query = ["seed"]
    learn(e, second, "id", "t", F.col("id") == 1)
    total = {r.term: r.total for r in e.totals.collect()}
    assert len(total) == 703 and total["gained"] == -0.5 and total["word5"] == 1.0 and total["other"] == 0.75
    assert total["seed"] == pytest.approx(2.75 / 4) and e.scores["seed"] == pytest.approx(total["seed"])
    assert "gained" not in e.best(5) and len(e.scores) <= 13


def test_stored_index_reads_only_its_terms_and_gives_the_same_scores(spark, tmp_path):
    import os
    import random

    from larkspur.operators.search import StoredIndex, bm25

    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(400)] + [(1000, None), (1001, "")], "id int, t string")
    index = StoredIndex.build(docs, "id", "t", str(tmp_path / "index"))
    for query, mode in (("w5 w77 w1200", "or"), ("w5 W77", "and"), ("absent", "or"), ("w9", "and")):
        want = {(r.id, r.score) for r in bm25(docs, "id", "t", query, mode).select("id", "score").collect()}
        assert {(r.key, r.score) for r in index.bm25(query, mode).collect()} == want, query
    plan = index.postings(["w5", "w77"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "bucket" in plan.split("PartitionFilters")[1][:200]
    size = lambda d: sum(os.path.getsize(os.path.join(r, f)) for r, _, fs in os.walk(d) for f in fs)
    of = [r.b for r in spark.sql("select pmod(xxhash64(x), 256) b from values ('w5'), ('w77'), ('w1200') t(x)").collect()]
    assert sum(size(tmp_path / "index" / "postings" / f"bucket={b}") for b in of) < 0.1 * size(tmp_path / "index" / "postings")


def test_quotas_treat_other_tiers_as_the_second(spark):
    from larkspur.operators.curate import tier_quota

    rows = [(i, 1 + i % 3, i / 100) for i in range(60)] + [(100 + i, 7, 0.99) for i in range(5)]
    out = [tuple(r) for r in tier_quota(spark.createDataFrame(rows, "id int, tier int, trust double"), "id", 24, 0).collect()]
    count = lambda t: sum(r[1] == t for r in out)
    assert count(1) == 8 and count(2) + count(7) == 12 and count(7) == 5 and count(3) == 4  # 24 in all
