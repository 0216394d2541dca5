import json

import pytest
from pyspark.sql import functions as F

from larkspur.sources import apis, feeds, html


def rows(spark, source, *payloads, **kw):
    return apis.parse(spark.createDataFrame([(p if isinstance(p, str) else json.dumps(p),) for p in payloads], "payload string"), source, **kw).collect()


def test_every_source_resolves_and_survives_bad_payloads(spark):
    for name, s in apis.SOURCES.items():
        df = apis.parse(spark.createDataFrame([("{oops",), (None,), ("",), ("{}",), ("<a/>",)], "payload string"), name)
        assert set(s.key) <= set(df.columns), name
        assert df.count() == 0, name


def test_trials(spark):
    study = {"protocolSection": {"identificationModule": {"nctId": "NCT1", "briefTitle": "T", "organization": {"fullName": "Org"}}, "statusModule": {"overallStatus": "DONE", "startDateStruct": {"date": "2020-01"}}, "designModule": {"phases": ["PHASE1", "PHASE2"]}, "conditionsModule": {"conditions": ["A", "B"]}, "armsInterventionsModule": {"interventions": [{"name": "x", "type": "DRUG"}, {"name": "y", "type": "DEVICE"}]}, "descriptionModule": {"briefSummary": "s"}}}
    (r,) = rows(spark, "clinical_trials", {"studies": [study, study]})
    assert (r.nct_id, r.phase, r.conditions, r.interventions) == ("NCT1", "PHASE1, PHASE2", "A; B", "DRUG: x; DEVICE: y")


def test_pubmed_xml(spark):
    xml = '<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>7</PMID><DateCompleted><Year>2021</Year></DateCompleted><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>A</AbstractText><AbstractText>B</AbstractText></Abstract><AuthorList><Author><LastName>L</LastName><ForeName>F</ForeName></Author><Author><LastName>M</LastName><ForeName>G</ForeName></Author></AuthorList><Journal><Title>J</Title><ISOAbbreviation>j</ISOAbbreviation></Journal><ELocationID EIdType="pii">p</ELocationID><ELocationID EIdType="doi">10.1/x</ELocationID></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>'
    (r,) = rows(spark, "pubmed", xml)
    assert (r.pmid, r.abstract, r.authors, r.pub_year, r.doi) == ("7", "A B", "L F; M G", 2021, "10.1/x")


def test_fda(spark):
    (r,) = rows(spark, "fda_approvals", {"results": [{"application_number": "N1", "sponsor_name": "S", "products": [{"brand_name": "B", "active_ingredients": [{"name": "g"}]}], "submissions": [{"submission_type": "ORIG", "submission_status": "TA", "submission_status_date": "1"}, {"submission_type": "SUPPL", "submission_status": "AP", "submission_status_date": "2"}]}]})
    assert (r.brand_name, r.generic_name, r.approval_date, r.submission_type) == ("B", "g", "2", "SUPPL")


def test_defaults_and_fallbacks(spark):
    (a,) = rows(spark, "semantic_scholar", {"data": [{"paperId": "p", "title": "t", "abstract": "", "year": 2020, "authors": [{"name": "x"}, {"name": ""}]}]})
    assert (a.abstract, a.published, a.authors, a.citation_count) == ("No abstract available", "2020", "x", 0)
    (b,) = rows(spark, "papers_with_code", {"results": [{"id": "", "arxiv_id": "1.2", "title": "t"}]})
    assert b.paper_id == "pwc:1.2"
    models = rows(spark, "huggingface_models", {"models": [{"modelId": "", "id": "m", "tags": ["a", "b"]}, {"id": "secret", "private": True}, {"tags": []}]})
    assert [(m.model_id, m.tags) for m in models] == [("m", "a, b")]
    (q,) = rows(spark, "stock_quotes", {"quoteResponse": {"result": [{"symbol": "S", "shortName": "short", "longName": "", "regularMarketPrice": 2.5}]}})
    assert (q.name, q.price) == ("short", 2.5)
    (s,) = rows(spark, "state_bills", {"data": {"bills": {"edges": [{"node": {"id": "b", "sponsorships": [{"name": "n1", "primary": False}, {"name": "n2", "primary": True}]}}]}}})
    assert s.sponsor == "n2"


def test_series(spark):
    got = rows(spark, "fred_observations", {"seriess": [{"id": "G", "title": "t"}], "observations": [{"date": "d1", "value": "."}, {"date": "d2", "value": "1.5"}]})
    assert [(r.series_id, r.observation_date, r.value) for r in got] == [("G", "d2", 1.5)]
    days = rows(spark, "stock_daily_prices", {"Meta Data": {"2. Symbol": "S"}, "Time Series (Daily)": {"2024-01-02": {"1. open": "1", "4. close": "2", "5. volume": "3"}, "2024-01-03": {"1. open": "x"}}})
    assert sorted((r.date, r.open, r.close, r.volume) for r in days) == [("2024-01-02", 1.0, 2.0, 3), ("2024-01-03", None, None, None)]
    (e,) = rows(spark, "eia_series", {"response": {"data": [{"period": "2020", "value": 1.0, "series-id": "S", "product-name": "P", "area-name": ""}]}})
    assert e.name == "P"


def test_grid_xml(spark):
    xml = "<GL_MarketDocument><TimeSeries><MktPSRType><psrType>B16</psrType></MktPSRType><Period><timeInterval><start>2024-01-01T00:00Z</start></timeInterval><Point><position>1</position><quantity>5</quantity></Point><Point><position>3</position><quantity>6</quantity></Point></Period></TimeSeries></GL_MarketDocument>"
    got = sorted((r.production_type, str(r.timestamp), r.generation_mw) for r in rows(spark, "entsoe_generation", xml))
    assert got == [("Solar", "2024-01-01 00:00:00", 5.0), ("Solar", "2024-01-01 00:30:00", 6.0)]


def test_food(spark):
    (f,) = rows(spark, "usda_foods", {"foods": [{"fdcId": 1, "description": "d", "brandOwner": "", "brandName": "n", "foodNutrients": [{"nutrientId": 1008, "value": 1}, {"nutrientId": 1008, "value": 2}]}]})
    assert (f.fdc_id, f.brand, f.calories, f.protein_g) == ("1", "n", 2.0, 0.0)
    (o,) = rows(spark, "open_food", {"products": [{"code": "9", "product_name": "p", "serving_size": "30 g", "nutriments": {"sodium_100g": 0.5}}, {"code": "8", "product_name": ""}]})
    assert (o.fdc_id, o.serving_size, o.sodium_mg) == ("OFF_9", 30.0, 500.0)
    (m,) = rows(spark, "meals", {"meals": [{"idMeal": "5", "strMeal": "Soup", "strIngredient1": "Salt", "strMeasure1": "1 tsp", "strIngredient2": " ", "strIngredient3": "Water", "strMeasure3": ""}]})
    assert (m.recipe_id, m.ingredients) == ("MDB_5", "1 tsp Salt; Water")


def test_politics_and_zone(spark):
    got = rows(spark, "congress_members", {"results": [{"congress": "118", "chamber": "House", "members": [{"id": "a"}, {"id": "b"}]}]})
    assert sorted((r.member_id, r.chamber) for r in got) == [("a", "House"), ("b", "House")]
    (v,) = rows(spark, "congress_votes", {"results": {"votes": {"vote": {"congress": 118, "session": 1, "chamber": "House", "roll_call": 5, "total": {"yes": 1, "no": 2, "not_voting": 3}}}}})
    assert (v.vote_id, v.total_no) == ("118-1-House-5", 2)
    got = rows(spark, "ercot_prices", {"data": [{"deliveryDate": "d", "hourEnding": "01:00", "settlementPoint": "LZ_NORTH_ABC", "spp": 1.0}, {"deliveryDate": "d", "hourEnding": "01:00", "settlementPoint": "UNKNOWN_POINT", "spp": 2.0}]})
    assert sorted(r.zone for r in got) == ["LZ_NORTH", "UNKNOWN_POINT"]


def test_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("point,time,price\nLZ_WEST_1,t1,1.5\nX,t2,oops\n")
    assert sorted((r.zone, r.price) for r in apis.ercot_csv(spark, str(tmp_path / "p.csv")).collect()) == [("LZ_WEST", 1.5), ("X", 0.0)]
    (tmp_path / "bad.csv").write_text("point,time,price\nLZ_WEST_1,t1\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED"):
        apis.ercot_csv(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "a.jsonl").write_text('{"topic":"t","url":"u","tier":1}\nnot json\n{"topic":"t","url":"v","trust_score":0.5}\n')
    assert sorted((r.url, r.trust_score) for r in apis.authority_registry(spark, str(tmp_path / "a.jsonl")).collect()) == [("u", 0.95), ("v", 0.5)]
    (tmp_path / "u.txt").write_text(" https://a.example \nftp://b\n\nhttp://c\n")
    assert [r.url for r in apis.url_lines(spark, str(tmp_path / "u.txt")).collect()] == ["https://a.example", "http://c"]
    (tmp_path / "k.json").write_text('{\n "tech": ["a", "b"],\n "law": []\n}')
    assert sorted((r.category, r.kw) for r in apis.keyword_file(spark, str(tmp_path / "k.json")).collect()) == [("tech", "a"), ("tech", "b")]


RSS = '<?xml version="1.0"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>News</title><link>https://n.example</link><item><title><![CDATA[A & B]]></title><link>https://n.example/1</link><dc:creator>Jo</dc:creator><category>x</category><category>y</category><content:encoded>full</content:encoded><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate><guid>g</guid></item><item><title>T2</title></item></channel></rss>'
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><title>At</title><link href="https://a.example"/><entry><title>E</title><link rel="self" href="s"/><link href="https://a.example/e"/><author><name>Al</name></author><summary>sum</summary><id>i</id><updated>2024-01-01T00:00:00Z</updated><category term="t"/></entry></feed>'
RDF = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"><channel><title>R</title></channel><item><title>I</title><link>l</link></item></rdf:RDF>'


def test_feeds(spark):
    df = spark.createDataFrame([(1, RSS), (2, ATOM), (3, RDF), (4, "<html/>"), (5, None), (6, "<rss"), (7, "")], "id int, body string")
    got = {(r.id, r.pos): r for r in feeds.feed_items(df, "id", "body").collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (3, 1)}
    a = got[1, 1]
    assert (a.title, a.author, a.categories, a.content, a.guid, a.format) == ("A & B", "Jo", ["x", "y"], "full", "g", "rss2")
    b = got[2, 1]
    assert (b.link, b.author, b.description, b.categories, b.format) == ("https://a.example/e", "Al", "sum", ["t"], "atom")
    assert got[3, 1].link == "l"
    flags = {r.id: (r.n, r.f) for r in df.select("id", feeds.item_count(F.col("body")).alias("n"), feeds.looks_like_feed(F.col("body")).alias("f")).collect()}
    assert flags[1] == (2, True) and flags[4] == (0, False) and flags[5] == (None, None)


PAGE = '<html><head><title>Head</title><meta content="Og" property="og:title"><meta name="author" content="Ann"><link type="application/rss+xml" href="/f.xml"><script>var x="no"</script></head><body><nav>menu</nav><h1>H <b>one</b></h1><article><p>First &amp; best.</p><p>Second<br>line.</p></article><a href="/x">  L <i>1</i> </a><a href="https://o.example/feed">F</a><footer>foot</footer></body></html>'


def test_html(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<h1>Only</h1><p>a</p><p>b"), (3, None), (4, "")], "id int, page string")
    p = F.col("page")
    got = {r.id: r for r in df.select("id", html.title(p).alias("t"), html.author(p).alias("a"), html.content(p).alias("c"), html.visible_text(p).alias("v"), html.feed_links(p).alias("f")).collect()}
    assert (got[1].t, got[1].a, got[1].c) == ("Og", "Ann", "First & best. Second line.")
    assert "menu" not in got[1].v and "var" not in got[1].v and "H one" in got[1].v
    assert got[1].f == ["/f.xml", "https://o.example/feed"]
    assert (got[2].t, got[2].c) == ("Only", "a b") and got[3].t is None and got[3].c == "" and got[4].c == ""
    links = {(r.id, r.pos): (r.href, r.text) for r in html.links(df, "id", "page").collect()}
    assert links == {(1, 1): ("/x", "L 1"), (1, 2): ("https://o.example/feed", "F")}
    (s,) = spark.createDataFrame([("<urlset><loc> https://a/news/1 </loc><loc>https://a/about</loc></urlset>",)], "d string").select(html.sitemap_urls(F.col("d")).alias("u"), html.news_urls(html.sitemap_urls(F.col("d")), ["zzz"], 5).alias("n")).collect()
    assert s.u == ["https://a/news/1", "https://a/about"] and s.n == ["https://a/news/1"]
