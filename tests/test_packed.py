from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.operators.packed import LetterBits, Model, candidate_parses, pick_by_letters, split_packed


def best(text, ampersand=False):
    """The parse chosen where nothing is known of the field."""
    p = candidate_parses(text, ampersand)
    return p[pick_by_letters(Model({}, {}), "f", p)][3] if p else []


def test_dialects():
    assert best("Insomnia; Hepatitis B;") == ["Insomnia", "Hepatitis B"]
    assert best('"Diabetes Mellitus, Type 2", Asthma') == ["Diabetes Mellitus, Type 2", "Asthma"]
    assert best("1) Stroke, Acute; 2) Asthma") == ["Stroke, Acute", "Asthma"]
    assert best('["\\"Keep Moving\\" Program", "Device: X"]') == ['"Keep Moving" Program', "Device: X"]
    assert best('"""Keep Moving"" Program", Other') == ['"Keep Moving" Program', "Other"]
    assert best("A b;C d | E f|G h;;") == ["A b", "C d", "E f", "G h"]
    assert best("Gait/Balance Disorder / Asthma") == ["Gait/Balance Disorder", "Asthma"]
    assert best("Vujas A, Tegemom B & Fakix C", True) == ["Vujas A", "Tegemom B", "Fakix C"]
    assert best("rulu + fimu") == ["rulu + fimu"]
    assert best("a\r\nb\r\n") == ["a", "b"]
    assert best(None) == best("") == best("  ") == []
    assert best(";;;") == []


def test_unclosed_quote_and_long_text():
    assert best('5" tube; other') == ['5" tube', "other"]
    assert len(best("; ".join(f"value {i}" for i in range(5000)))) == 5000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcdefgh ,;\"'", min_size=1, max_size=12).map(str.strip).filter(lambda x: x and x[0].isalpha()), min_size=2, max_size=6))
def test_round_trip_of_quoted_lists(items):
    packed = "; ".join('"' + x.replace('"', '""') + '"' for x in items)
    assert [p for p in candidate_parses(packed) if p[0] == "strong"][0][3] == items


def test_operator(spark):
    rows = [("t.a", "1", "Asthma; Gout"), ("t.a", "2", '"Stroke, Acute", Asthma'), ("t.a", "2", '"Stroke, Acute", Asthma'), ("t.a", "3", None), ("t.a", "4", " ; "), ("t.b", "1", "X Y & Z W"), (None, "9", "q"), ("t.a", "5", "Gout")]
    df = spark.createDataFrame(rows, "field string, row_key string, text string").selectExpr("*", "1 as n", "2 as item", "3 as parses")
    got = {(r.field, r.row_key, r.pos): r["item"] for r in split_packed(df, "field", "row_key", "text", ("t.b",)).collect()}
    assert got == {("t.a", "1", 1): "Asthma", ("t.a", "1", 2): "Gout", ("t.a", "2", 1): "Stroke, Acute", ("t.a", "2", 2): "Asthma", ("t.b", "1", 1): "X Y", ("t.b", "1", 2): "Z W", ("t.a", "5", 1): "Gout"}
    assert split_packed(df.limit(0), "field", "row_key", "text").count() == 0


def found(spark, texts):
    df = spark.createDataFrame([("f", str(k), t) for k, t in enumerate(texts)], "field string, row_key string, text string")
    out = {}
    for r in sorted(split_packed(df, "field", "row_key", "text").collect(), key=lambda r: r.pos):
        out.setdefault(int(r.row_key), []).append(r["item"])
    return [out.get(k, []) for k in range(len(texts))]


def test_value_codes_decide(spark):
    """The same text is one value where the field knows it as one, and two where it knows the parts."""
    whole = [f'"Diabetes Mellitus, Type 2"; Gout{k}x' for k in "abcdefgh"] + ["Asthma; Flu"] * 3
    parts = [f"Diabetes Mellitus; Type 2; Gout{k}x" for k in "abcdefgh"] + ["Asthma; Flu"] * 3
    assert found(spark, [*whole, "Diabetes Mellitus, Type 2"])[-1] == ["Diabetes Mellitus, Type 2"]
    assert found(spark, [*parts, "Diabetes Mellitus, Type 2"])[-1] == ["Diabetes Mellitus", "Type 2"]


def test_codes_outweigh_the_declared_precedence(spark):
    """A semicolon inside well-known values does not separate them."""
    known = [f'"Rep. A; B act", "Fund C; D list", item{k}y' for k in "abcdefghijkl"]
    assert found(spark, [*known, "Rep. A; B act, Fund C; D list"])[-1] == ["Rep. A; B act", "Fund C; D list"]
    assert found(spark, ["one, two; three", "four; five", "six; seven"])[0] == ["one, two", "three"]


def test_planted_lists_are_found(spark):
    import random

    rng = random.Random(6)
    vocabulary = [f"{rng.choice(['Acute', 'Chronic', 'Mild', 'Late'])} {''.join(rng.choice(['ra', 'mo', 'ti', 'lu', 'ke']) for _ in range(3))}{rng.choice(['', ', Type 2', ', Unspecified'])}" for _ in range(60)]
    texts, want = [], []
    for _ in range(600):
        items = rng.sample(vocabulary, rng.randint(1, 5))
        kind = rng.choice(["; ", " | ", "\n", ", ", "json"])
        if kind == "json":
            texts.append("[" + ", ".join(f'"{x}"' for x in items) + "]")
        else:
            texts.append(kind.join(f'"{x}"' if kind == ", " and "," in x or len(items) == 1 and "," in x else x for x in items))
        want.append(items)
    got = found(spark, texts)
    assert sum(g == w for g, w in zip(got, want)) >= 0.99 * len(want)


def test_letters():
    bits = LetterBits({"a": 96, ";": 1})
    assert bits["aaa"] < bits["a;"] < bits["z;"]
    assert bits[""] > 0 and bits["x" * 500] == bits["x" * 500]


def test_texts_of_one_key_that_agree_are_one(spark):
    df = spark.createDataFrame([("f", "1", "Asthma; Gout"), ("f", "1", "Asthma | Gout"), ("f", "2", "Asthma")], "field string, row_key string, text string")
    assert sorted((r.row_key, r.pos, r["item"]) for r in split_packed(df, "field", "row_key", "text").collect()) == [("1", 1, "Asthma"), ("1", 2, "Gout"), ("2", 1, "Asthma")]
