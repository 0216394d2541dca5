import pytest
from pyspark.sql import functions as F

from larkspur.functions import lang, scores, text, urls
from larkspur.operators.feedback import Expander


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in cols.items()))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(("word", "code", "want"), [("the", "en", True), ("있는", "ko", True), ("する", "ja", True), ("的", "zh", True), ("www", "ko", True), ("the", "ko", True), ("technology", "en", False), ("인공지능", "ko", False), ("人工智能", "zh", False), ("a", "en", True), ("123", "en", True), ("AI", "ja", False)])
def test_stopwords(spark, word, code, want):
    assert one(spark, text.is_stopword(F.col("w"), F.col("l")), w=word, l=code) is want


def test_keyword_lists(spark):
    assert one(spark, text.clean_keywords(F.col("k"), F.lit("en")), k=["AI", "the", "machine learning", "and", "AI", "technology", "123"]) == ["AI", "machine learning", "technology"]
    assert one(spark, text.fold_distinct(F.col("k")), k=["AI", "ai", "Machine Learning", "machine learning", "NVIDIA"]) == ["AI", "Machine Learning", "NVIDIA"]
    assert one(spark, text.merge_keywords(F.array(*map(F.lit, ["AI", "machine learning"])), F.col("k")), k=["technology", "ai"]) == ["AI", "machine learning", "technology"]
    assert one(spark, text.keyword_filter(F.col("k"), 2), k=["1", "12", "ab", "c", "de", "fg"]) == ["ab", "de"]
    assert one(spark, text.nfc_lower(F.col("k")), k="  Café ") == "café"
    assert one(spark, text.split_list(F.col("k")), k=" a, ,b,") == ["a", "b"]


def test_json_keywords(spark):
    assert one(spark, text.json_keywords(F.col("t")), t='Sure: {"keywords": ["a", "b", "a"]} done') == ["a", "b"]
    assert one(spark, text.json_keywords(F.col("t")), t='{"keywords": {"en": ["a"], "ko": ["b", "a"]}}') == ["a", "b"]
    assert one(spark, text.json_keywords(F.col("t")), t="nothing") == []


def test_cleaning(spark):
    assert one(spark, text.strip_html(F.col("t")), t="<![CDATA[<p>a &amp; b</p>]]>\n<b>c</b>") == "a & b c"
    assert one(spark, text.slug(F.col("t")), t="  Clean Power & Grid!! ") == "clean-power-grid"
    assert one(spark, text.slug(F.col("t")), t="!!!") == "vertical"
    assert one(spark, text.truncate(F.col("t"), 3, "..."), t="abcd") == "abc..."
    assert one(spark, text.highlight(F.col("t"), "ab c++"), t="AB c++ x") == "<mark>AB</mark> <mark>c++</mark> x"
    assert one(spark, text.highlight(F.col("t"), "mark a"), t="a mark") == "<mark>a</mark> <mark>mark</mark>"


def test_urls(spark):
    assert one(spark, urls.host(F.col("u")), u="https://Jo:pw@WWW.A.co.kr:8080/x?y") == "www.a.co.kr:8080"
    assert one(spark, urls.country(F.col("u")), u="news.a.co.kr") == "kr"
    for domain, want in {"a.com": "global", "a.pl": "pl", "A.SE": "se", "x.com.tr:80": "tr", "a.example": "unknown", "localhost": "unknown", "b.com.sg": "sg"}.items():
        assert one(spark, urls.country(F.col("u")), u=domain) == want
    for code, want in {"kr": "ko", "pl": "pl", "ch": "de", "global": "en", "unknown": "unknown"}.items():
        assert one(spark, urls.country_language(F.col("u")), u=code) == want
    assert one(spark, urls.category(F.col("u")), u="https://a.example/Wellness") == "health" and one(spark, urls.category(F.col("u")), u="https://q.example/x") == "other"
    assert one(spark, urls.video_kind(F.col("u")), u="https://www.youtube.com/c/Some.Name") == "custom:Some.Name"
    assert one(spark, urls.is_channel_id(F.col("u")), u="UC" + "a" * 22) and not one(spark, urls.is_video_id(F.col("u")), u="short")
    assert one(spark, urls.normal_url(F.col("u")), u="HTTPS://www.A.com/Feed/") == "a.com/feed"
    assert one(spark, urls.resolve(F.lit("https://a.com/b/c"), F.col("u")), u="../d") == "https://a.com/d"
    assert one(spark, urls.domain_quality(F.col("u"), ("b.com",)), u="x.b.com") == "premium"
    assert one(spark, urls.looks_like_feed(F.col("u")), u="https://a/comments/feed") is False
    for u, want in {"https://youtu.be/abcdefghijk": "video:abcdefghijk", "https://www.youtube.com/watch?v=abcdefghijk&t=1": "video:abcdefghijk", "https://youtube.com/@name": "handle:name", "https://youtube.com/user/me": "user:me", "https://a.com/watch?v=abcdefghijk": None}.items():
        assert one(spark, urls.video_kind(F.col("u")), u=u) == want


def test_languages(spark):
    for t, want in {"안녕하세요 세계": "ko", "これは日本語の文章です": "ja", "这是中文": "zh", "Привет мир": "ru", "สวัสดี": "th", "hello world": "latin", "a": "unknown", "": "unknown"}.items():
        assert one(spark, lang.script_language(F.col("t")), t=t) == want, t
    for t, want in {"the cat and the dog": "en", "der Hund und die Katze": "de", "le chat et les chiens dans une rue": "fr", "phóng sự và ý kiến về đời sống ấn tượng": "vi", "mười tỷ": "vi", "zzz qqq": "en", "günaydın şehir": "tr", "het weer in de stad is vandaag niet goed voor een wandeling": "nl"}.items():
        assert one(spark, lang.latin_language(F.col("t")), t=t) == want, t
    assert one(spark, lang.languages_by_share(F.col("t")), t="hello 안녕하세요") == "hangul:50,latin:50"
    r = one(spark, lang.language_result(F.col("t")), t="안녕하세요 ab")
    assert (r.language, r.script) == ("ko", "hangul") and r.confidence == pytest.approx(5 / 7)
    r = one(spark, lang.language_result(F.col("t")), t="phóng sự và ý kiến về đời sống")
    assert r.language == "vi" and r.confidence == pytest.approx(0.9)
    assert one(spark, lang.language_result(F.col("t")), t="the thing that was in the other thing").confidence == pytest.approx(0.85)
    assert one(spark, lang.detect(F.col("t")), t="가 Ж ก ا א α あ ア 中 क z") == "unknown"  # no script holds three tenths


def test_dates_and_scores(spark):
    for t, want in {"Mon, 02 Jan 2006 15:04:05 +0000": "2006-01-02 15:04:05", "2024-01-02T03:04:05+02:00": "2024-01-02 01:04:05", "Jan 2, 2024": "2024-01-02 00:00:00", "2.1.24": "None"}.items():
        assert str(one(spark, scores.parse_date(F.col("t")), t=t)) == want
    assert str(one(spark, scores.date_in_html(F.col("t")), t="<p>x 2024.2.9 y")) == "2024-02-09"
    assert one(spark, scores.date_in_html(F.col("t")), t="2024-13-40") is None
    assert one(spark, scores.two_decimals(F.col("x")), x=1.005) in (1.0, 1.01)
    assert one(spark, scores.logistic(F.col("x"), 0.0, 1.0), x=0.0) == 0.5
    for (found, items, ok, tier), want in {("feedspot", 12, True, 1): 1.0, ("path_discovery", 5, False, 3): 0.55, (None, 0, False, None): 0.5, ("site_discovery", 3, True, 2): 0.7}.items():
        assert one(spark, scores.trust(F.col("f"), F.col("n"), F.col("o") == 1, F.col("t")), f=found, n=items, o=int(ok), t=tier) == pytest.approx(want)
    for (found, trust, domain, kind), want in {("openalex", 0.1, "a", "rss"): 1, (None, 0.8, "a", "rss"): 1, ("path_discovery", 0.55, "a", "rss"): 3, (None, 0.55, "a", "rss"): 2, (None, 0.4, "a", "rss"): 3, (None, 0.4, "x.Who.int", "rss"): 1, (None, 0.4, "a", "api"): 1}.items():
        assert one(spark, scores.tier(F.col("f"), F.col("t"), F.col("d"), F.col("k"), ("who.int",)), f=found, t=trust, d=domain, k=kind) == want
    for (items, title, url, origin), want in {(10, "t", "https://a/feed", "html"): 0.95, (1, None, "http://a/x", None): 0.1, (5, "t", "https://a/RSS.xml", "sitemap"): 0.75}.items():
        assert one(spark, scores.feed_score(F.col("n"), F.col("t"), F.col("u"), F.col("o")), n=items, t=title, u=url, o=origin) == pytest.approx(want)
    assert one(spark, scores.reading_seconds(F.col("t")), t="x" * 150) == 60


def test_expander():
    e = Expander(["a", "b", "c", "d"])
    assert e.query == ["a", "b", "c"] and e.scores["b"] == pytest.approx(0.95)
    e.scores |= {"new": 3.0, "old": 2.0, "bad": -1.0}
    e.adjust(0.2)  # low precision: one term more; the best of all, none of them a first seed
    assert e.query == ["a", "old", "d"] and e.used == {"a", "b", "c"} and e.scores["a"] == pytest.approx(0.2)
    e.scores["b"] = 9.0
    e.adjust(0.9)  # high precision: one term less; b is best of all though used, new the best unused one
    assert e.query == ["b", "new"]
    e.precisions = [0.1, 0.1, 0.1]
    assert not e.goes_on()
    assert e.search_strings()[1].endswith("RSS feed")
