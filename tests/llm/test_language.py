import pytest
from pyspark.sql import functions as F

from larkspur.llm.language import LANGUAGES, LanguageModel, calibrate, corpus_counts, distinct_texts, fit_languages, known_words, label_of, language_segments, pieces_of


@pytest.mark.parametrize(("label", "want"), [("en-US", "en"), ("English", "en"), ("eng", "en"), ("pt_BR", "pt"), ("Deutsch", "de"), ("zh-CN", "zh"), ("n/a", None), ("", None), (None, None), ("und", None), ("français", "fr")])
def test_labels(spark, label, want):
    assert spark.createDataFrame([(label,)], "l string").select(label_of(F.col("l")).alias("x")).first().x == want


def test_pieces():
    assert pieces_of("A b | C d – E f\nG (h) i. J") == ["A b", "C d", "E f", "G", "h", "i", "J"]
    assert pieces_of("l'énergie well-known") == ["l'énergie well-known"]
    assert pieces_of(None) == pieces_of("") == []


@pytest.fixture(scope="module")
def feeds(spark, data):
    return spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/feeds.parquet")


@pytest.fixture(scope="module")
def model(feeds):
    votes = distinct_texts(feeds, "title", "language")
    return fit_languages(votes, corpus_counts(votes))


def test_held_out_accuracy(model):
    """Sentences that are not in the training tables."""
    texts = {
        "en": "The council postponed the vote until after the summer break", "de": "Der Rat hat die Abstimmung auf den Herbst verschoben", "fr": "Le conseil a reporté le vote après les vacances d'été",
        "es": "El consejo aplazó la votación hasta después del verano", "ru": "Совет отложил голосование до осени", "ko": "위원회는 투표를 가을까지 연기했다", "ja": "委員会は投票を秋まで延期した", "zh": "委员会将投票推迟到秋天",
        "nl": "De raad heeft de stemming uitgesteld tot na de zomer", "it": "Il consiglio ha rinviato il voto a dopo le vacanze", "pt": "O conselho adiou a votação para depois das férias", "vi": "Hội đồng đã hoãn cuộc bỏ phiếu đến mùa thu",
    }
    from larkspur.llm.language import LANGUAGES

    right = sum(LANGUAGES[model.probabilities(t).argmax()] == k for k, t in texts.items())
    assert right >= 10
    assert (model.weights == 0).mean() > 0.5  # sparse


def test_segments(spark, feeds, model):
    rows = [(1, "en", "Daily news on the electricity market"), (2, "de", "Daily news on the electricity market"), (3, "en", "Daily news on the grid | Tägliche Nachrichten über den Strommarkt"), (4, None, "Zorbax"), (5, "en", None), (6, "en", ""), (7, "xx", "Zorbax: Нeзависимый взгляд на рынок электричества и цены"), (7, "xx", "x" * 3000)]
    df = spark.createDataFrame(rows, "id int, language string, title string").selectExpr("*", "1 as segment", "2 as stated")
    ask = feeds.select("id", "language", "title").unionByName(df.select(F.col("id").cast("bigint") + 10_000_000, "language", "title").toDF("id", "language", "title"))
    out = language_segments(ask, "id", "title", "language", model).filter("id > 10000000")
    got = {(r.id - 10_000_000, r.segment): (r.stated, r.language) for r in out.collect() if len(r.segment_text) < 2000}
    assert got[1, 1] == ("en", "en") and got[2, 1] == ("de", "en")
    assert (got[3, 1][1], got[3, 2][1]) == ("en", "de")
    assert got[7, 1] == (None, "ru") and not {4, 5, 6} & {k[0] for k in got}
    assert all(0 <= r.confidence <= 1.0001 for r in out.collect())


def test_empty(spark):
    df = spark.createDataFrame([], "id int, title string, language string")
    assert language_segments(df, "id", "title", "language").count() == 0
    assert "the" in known_words(corpus_counts(distinct_texts(df, "title", "language")))


def test_no_held_out_row_leaves_the_temperature_at_one_and_one_row_moves_it_little():
    import numpy as np

    model = LanguageModel(np.ones(1 << 16))
    calibrate(model, [], [])
    assert abs(model.temperature - 1.0) < 0.03
    model.bias[0] = 3.0
    model.weights[:] = 0.01
    calibrate(model, ["the news of the day"], [1])
    assert 0.2 < model.temperature < 5


def test_repeated_rows_and_rare_languages(spark):
    rows = [(f"Notes on the market and prices {i}", "en") for i in range(300)] + [(f"Tin tức về thị trường điện {'abcdefgh'[i]}", "vi") for i in range(8)]
    df = spark.createDataFrame(rows, "title string, language string")
    once = known_words(corpus_counts(distinct_texts(df, "title", "language")))
    assert once == known_words(corpus_counts(distinct_texts(df.unionByName(df).unionByName(df), "title", "language")))
    assert {"market", "prices", "trường", "điện"} <= once  # eight texts of 308 are measured by their own language
    wide = df.unionByName(spark.range(20_000).selectExpr("concat('Report number ', id, ' on the grid') as title", "'en' as language"))
    assert {"trường", "điện"} <= known_words(corpus_counts(distinct_texts(wide, "title", "language")))


def test_planted_titles_are_found(spark):
    """Wrong labels and mixed titles among many right ones."""
    import random

    rng = random.Random(3)
    parts = {
        "en": ["Daily notes on the electricity market and its prices", "What experts think about medical trials and their results"], "de": ["Tägliche Notizen über den Strommarkt und seine Preise", "Was Fachleute über klinische Studien und ihre Ergebnisse denken"],
        "fr": ["Notes du jour sur le marché de l'électricité et ses prix", "Ce que pensent les experts des essais et de leurs résultats"], "ru": ["Ежедневные заметки о рынке электричества и ценах", "Что думают эксперты про испытания и их итоги"],
        "ja": ["毎日お届けする電力市場の記録とその価格", "専門家が語る治験とその結果"], "es": ["Notas del día sobre el mercado eléctrico y sus precios", "Lo que piensan los expertos de los ensayos y sus resultados"],
    }
    rows, want = [], set()
    for i in range(900):
        a, b = rng.sample(sorted(parts), 2)
        if i % 10 == 0:
            rows.append((i, f"{rng.choice(parts[a])} | {rng.choice(parts[b])}", a))
            want |= {(i, 1, a), (i, 2, b)}
        elif i % 10 == 1:
            rows.append((i, rng.choice(parts[a]), b))
            want.add((i, 1, a))
        else:
            rows.append((i, f"{rng.choice(parts[a])} – {''.join(rng.choice(['Zor', 'bel', 'mi', 'vax', 'tu', 'rol']) for _ in range(4))}", a))
    out = language_segments(spark.createDataFrame(rows, "id int, title string, language string"), "id", "title", "language")
    got = {(r.id, r.segment, r.language) for r in out.filter("n_segments > 1 or language != stated").collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
