from pyspark.sql import functions as F

from larkspur.operators import pipelines as p


def test_topics():
    t = p.analyse_topic("Clean Energy")
    assert t.keywords[:3] == ["clean", "energy", "power"] and t.expression.startswith("clean OR energy")
    assert p.analyse_topic("zebra").keywords == ["zebra", "zebras", "zebraing"]


def test_sources_and_bootstrap(spark):
    topic = p.analyse_topic("energy")
    made = p.generate_sources(spark, topic)
    assert made.count() == len(p.TEMPLATES) * len(topic.keywords)
    assert made.filter("keyword = 'power' AND kind = 'news'").first().url.endswith("q=power")
    rows = [(i, f"https://a{i % 8}.example/{i}/", "power grid oil gas energy" if i % 2 else "cooking at home", "news") for i in range(30)] + [(99, "https://A1.example/1", "power grid energy", "news")]
    got = p.bootstrap(spark.createDataFrame(rows, "id int, url string, words string, kind string"), topic, "id", "words", 12, 5)
    assert 5 <= got.count() <= 12 and got.filter("words LIKE 'cooking%'").count() == 0 and got.filter("id = 99").count() == 0


def test_rest(spark, tmp_path):
    df = spark.createDataFrame([("api", True, None), ("repository", True, None), ("repository", False, 0.9), ("rss", True, 0.8), ("rss", True, None)], "kind string, up boolean, t double")
    assert [r.x for r in df.select(p.source_trust(F.col("kind"), F.col("up"), F.col("t")).alias("x")).collect()] == [0.9, 0.7, 0.5, 0.8, 0.5]
    feeds = spark.createDataFrame([(i, f"https://x/{i % 40}", "", "en" if i % 3 else "de", None, 50.0) for i in range(60)], "id int, url string, title string, language string, feed_type string, quality_score double")
    t = p.tier_feeds(feeds).first()
    assert (t.feed_type, t.tier, t.trust_score) == ("rss", 2, 0.5)
    s = p.seed_sets(feeds, 5, 8).collect()
    assert len(s) == 8 and {r.language for r in s} == {"en", "de"} and [r.id for r in p.seed_sets(feeds.repartition(3), 5, 8).collect()] == [r.id for r in s]
    pages = spark.createDataFrame([(1, "s", "main", "u", "<h1>power</h1>"), (2, "s", "list", "u2", "<h1>Power play</h1>"), (3, "s", "list", "u3", "<h1>other</h1>"), (4, "t", "sitemap", "u4", "<article>grid power</article>")], "id int, site string, origin string, url string, page string")
    assert sorted(r.id for r in p.crawl_order(pages, "id", ["power"], 5).collect()) == [2, 4]
    hits = spark.createDataFrame([("t", "s" * 300, "https://u/" + "x" * 100, 1.0)], "title string, snippet string, url string, score double")
    line = p.digest(hits).first().line
    assert "s" * 200 + "..." in line and len(line) < 280
    assert spark.createDataFrame([('"channelId":"UC' + "a" * 22 + '"',), ("none",)], "x string").select(p.channel_id(F.col("x")).alias("c")).collect()[1].c is None
    p.write_by(feeds, "language", str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 60
    p.write_urls(feeds.select("url"), "url", str(tmp_path / "u"))
    assert spark.read.text(str(tmp_path / "u")).count() == 60
