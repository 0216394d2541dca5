import pytest

from larkspur.engine import Engine, Vertical, Verticals


def test_tools(spark, data):
    e = Engine(spark, data)
    assert e.search("trial dose", 5).count() <= 5 and e.search("zzzz trial").count() > 0
    v = spark.read.parquet(f"{data}/embeddings.parquet").filter("vec_id = 0").first()["embedding"]
    assert e.semantic(v, 3).first()["vec_id"] == 0 and e.hybrid("trial", v, 5).count() == 5
    r = e.score_relevance(["trial", "dose"]).filter("score > 0.5").first()
    assert r is None or r["matched_keywords"]
    for df in (e.detect_language(), e.classify_feeds(), e.auto_curate(20, 5), e.seeds(7), e.stats(), e.validate_sources(), e.expand_query(["trial"], 2)):
        assert df.count() > 0
    assert e.auto_curate(20, 5).count() <= 20 and e.seeds(7).count() == 7
    assert set(e.trends("2024-01-01", "2024-06-01", "2025-12-31")) == {"hot", "burst", "emerging", "by_source"}
    assert e.generate_briefing("2020-01-01", 3).count("\n- ") == 3 and "Nothing new" in e.generate_briefing("2099-01-01")
    assert {r.state for r in e.health().collect()} == {"healthy"}
    assert any("unhealthy" in r.state for r in Engine(spark, "/nowhere").health().collect())
    pages = spark.createDataFrame([(1, '<link type="application/rss+xml" href="/f">'), (2, None)], "id int, page string")
    assert [x.href for x in e.discover(pages, "id").collect()] == ["/f"]
    bodies = spark.createDataFrame([(1, "<rss><title>n</title>" + "<item>" * 3), (2, "<html>")], "id int, body string")
    assert [x.valid for x in e.validate_feeds(bodies).orderBy("id").collect()] == [True, False]


def test_verticals(tmp_path):
    v = Verticals(str(tmp_path))
    assert v.names() == []
    v.create(Vertical("grid", keywords=["power"]))
    with pytest.raises(FileExistsError):
        v.create(Vertical("grid"))
    with pytest.raises(ValueError):
        v.create(Vertical("../x"))
    assert v.get("grid").keywords == ["power"] and v.switch("grid").name == "grid" and v.current == "grid"
    v.update(Vertical("grid", max_feeds=5))
    assert v.get("grid").max_feeds == 5
    assert not v.delete("grid") and v.delete("grid", confirm=True) and v.names() == []
