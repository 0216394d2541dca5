import pytest

from larkspur.llm.names import edits, link_names, name_pairs, organisation, person


def test_edits():
    assert edits("abcd", "abdc") == 1 and edits("abc", "abc") == 0 and edits("abc", "xyz", 2) == 3 and edits("", "ab") == 2


@pytest.mark.parametrize(
    ("name", "anchors", "kind"),
    [
        ("Bidafotrum Intl. Labs Corp. (BILC)", ["bidafotrum"], "international laboratories"),
        ("International Laboratories Corp., Bidáfotrum", ["bidafotrum"], "international laboratories"),
        ("Child. Hospital, Klino", ["klino"], "children hospital"),
        ("U. of Nivex", ["nivex"], "university"),
        ("CH de Jem", ["jem"], "hospitalier"),
        ("JEPO", ["jepo"], ""),
        ("+ Toto Clinical Research Ltd., Lino", ["lino", "toto"], "clinical research"),
        ("...", [], ""),
    ],
)
def test_organisation(name, anchors, kind):
    assert organisation(name) == (anchors, kind, "")


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Henry T. Vuguz", (["vuguz"], "henry", "t")),
        ("hank t vuguz", (["vuguz"], "henry", "t")),
        ("Vuguz, H.T.", (["vuguz"], "h", "t")),
        ("VUGUZ, HANK", (["vuguz"], "henry", "")),
        ("Vuguz Hnery", (["vuguz"], "henry", "")),
        ("Hon. Liz Vuguz", (["vuguz"], "elizabeth", "")),
        ("Rep. Vuguz, Tom [D-MI]", (["vuguz"], "thomas", "")),
    ],
)
def test_person(name, want):
    assert person(name) == want


def test_link(spark):
    orgs = ["Nivehitix University", "University of Nivehitix", "University of Nivehitix", "U. of Nivehitx", "Nivehitix Children's Hospital", "NIVEHITIX", "Dukerirem Therapeutics Inc.", "Dukerirem Tx Inc.", " ", "", None, "123"]
    people = ["Robert C. Tusofasis", "Tusofasis, Bob", "R. C. Tusofasis", "William F. Tusofasis", "Bill Tusofasis", "Tusofasos, W.F.", "x" * 5000]
    rows = [("o", "organisation", n) for n in orgs] + [("p", "person", n) for n in people]
    df = spark.createDataFrame(rows, "field string, kind string, name string").selectExpr("*", "1 as n", "2 as root", "3 as entity")
    got = {(r.name_a, r.name_b) for r in name_pairs(link_names(df, "field", "kind", "name")).collect()}
    pair = lambda *names: {tuple(sorted((a, b))) for i, a in enumerate(names) for b in names[i + 1 :]}
    want = pair("Nivehitix University", "University of Nivehitix", "U. of Nivehitx", "NIVEHITIX") | pair("Dukerirem Therapeutics Inc.", "Dukerirem Tx Inc.")
    want |= pair("Robert C. Tusofasis", "Tusofasis, Bob", "R. C. Tusofasis") | pair("William F. Tusofasis", "Bill Tusofasis", "Tusofasos, W.F.")
    assert got == want
    assert link_names(df.limit(0), "field", "kind", "name").count() == 0


def test_prefix_join_finds_every_close_pair(spark):
    """Against brute force over all pairs of tokens."""
    import random

    from larkspur.llm.names import close_tokens

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeiklmnorstuvz") for _ in range(rng.randint(5, 10))) for _ in range(60)]
    words += [w[:2] + w[3:] for w in words[:20]] + [w[:3] + "q" + w[3:] for w in words[20:40]] + [w[:1] + w[2] + w[1] + w[3:] for w in words[40:]]
    rows = [("f", w, 50 - i % 50) for i, w in enumerate(sorted(set(words)))]
    got = {r.token for r in close_tokens(spark.createDataFrame(rows, "field string, token string, n int")).collect()}
    want = {a for _, a, n in rows if len(a) > 3 and any(edits(a, b, 2) == 1 and (m > n or (m == n and b < a)) for _, b, m in rows)}
    assert want <= got


def pairs_of(spark, rows):
    df = spark.createDataFrame(rows, "field string, kind string, name string")
    return {(r.name_a, r.name_b) for r in name_pairs(link_names(df, "field", "kind", "name")).collect()}


def test_unlisted_given_names_long_tokens_and_repeated_rows(spark):
    people = ["Priscilla A. Tobiarsen", "Priscila Tobiarsen", "Tobiarsen, P. A.", "Gwendolyn Marqueset", "Gwendolin Marqueset", "Marqueset, Bertram", "Jean Dorovany", "Joan Dorovany", "Jane Dorovany"]
    long = "a" + "bcdefghij" * 20
    rows = [("p", "person", n) for n in people] + [("o", "organisation", f"{long} University"), ("o", "organisation", f"University of {long[:90] + long[91:]}"), ("o", "organisation", "Xyz University"), ("o", "organisation", "Xyw University")]
    got = pairs_of(spark, rows)
    pair = lambda a, b: tuple(sorted((a, b)))
    assert {pair("Priscilla A. Tobiarsen", "Priscila Tobiarsen"), pair("Priscilla A. Tobiarsen", "Tobiarsen, P. A."), pair("Gwendolyn Marqueset", "Gwendolin Marqueset"), pair(rows[9][2], rows[10][2])} <= got
    assert not any("Bertram" in a + b or "Dorovany" in a + b or "Xy" in a for a, b in got)  # others, and names an edit of which is too much
    assert pairs_of(spark, rows * 3) == got


def test_planted_variants_are_linked(spark):
    import random

    rng = random.Random(12)
    stem = lambda: "".join(rng.choice(["ba", "kor", "ti", "lu", "mex", "sa", "vin", "dro", "pel", "gus"]) for _ in range(4)).capitalize()
    kinds = [("University", ["University of {}", "U. of {}", "{} Univ.", "UNIVERSITY OF {}"]), ("Children's Hospital", ["{} Children's Hospital", "Childrens Hosp., {}", "{} Childrens Hospital"]), ("Pharma", ["{} Pharmaceuticals Inc.", "{} Pharma", "{} Pharmaceuticals, Inc"])]
    rows, want = [], set()
    for _ in range(120):
        name = stem()
        _, forms = rng.choice(kinds)
        typo = name[:3] + name[4:]
        names = {f.format(name) for f in forms} | {forms[0].format(typo)}
        rows += [("o", "organisation", n) for n in names for _ in range(rng.randint(1, 3))]
        want |= {(a, b) for a in names for b in names if a < b}
    given = {"Robert": ["Robert", "Bob", "Rob"], "Elizabeth": ["Elizabeth", "Liz", "Beth"], "Thomas": ["Thomas", "Tom", "Tommy"]}
    for _ in range(120):
        family, (full, short), middle = stem(), rng.choice(sorted(given.items())), rng.choice("ABCDEFG")
        names = {f"{full} {middle}. {family}", f"{family}, {short[1]}", f"{full[0]}. {middle}. {family}", f"{short[2]} {family}", f"{family.upper()}, {full.upper()}", f"Rep. {full} {family[:4] + family[5] + family[4] + family[6:]}"}
        rows += [("p", "person", n) for n in names]
        want |= {(a, b) for a in names for b in names if a < b}
    got = pairs_of(spark, rows)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.01 * len(got)
