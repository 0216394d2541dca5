"""Linking the spellings of names typed by people.

Names become profiles: *anchor* tokens that are rare and tell entities apart
(the invented word of an organisation, the family name of a person) and
*qualifiers* that tell apart entities sharing an anchor (the kind of an
organisation; given name and middle initial of a person).

1. Tokens are compared by a prefix-filtered set-similarity join on their
   q-grams: two tokens within k edits share one of the 4k + 1 rarest q-grams of
   each, at places at most k apart, so only those prefixes are joined.
2. Joined tokens are verified by their similarity (edits by length, see
   ``ALIKE``); each token points to its most frequent close neighbour, and
   pointers are followed to a root. Given names that are on no list are led to
   one another in the same way, among the people of one family name.
3. Names with the same roots are verified by a soft weighted similarity of all
   their tokens, in which rare tokens (by distinct names) count more: a name goes
   to the entity it fits best; a token that contradicts makes it another entity.

Scale: rows are reduced to distinct names, names to distinct profiles and
tokens before any join; counts are of distinct names, so repeated rows change
nothing; a group holds the distinct qualifiers of one root that begin with one letter.

Defined results: null, blank and letterless names are never linked; names equal
after trimming are still different strings and are linked; tokens of any length
are compared; ties go to the alphabetically first; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larkspur.session import cut

# Kind words of organisations and their abbreviations.
KIND_WORDS = {
    "university": "university univ u universitat universidad universite",
    "hospital": "hospital hosp hospitals",
    "children": "children childrens child",
    "medical": "medical med",
    "center": "center centre ctr cntr",
    "clinical": "clinical clin",
    "research": "research res",
    "cancer": "cancer",
    "foundation": "foundation found fdn",
    "institute": "institute inst",
    "technology": "technology tech",
    "national": "national natl nat",
    "international": "international intl",
    "laboratories": "laboratories laboratory labs lab",
    "therapeutics": "therapeutics therapeutic therap tx",
    "pharmaceuticals": "pharmaceuticals pharmaceutical pharma pharm",
    "biosciences": "biosciences bioscience biosci bio",
    "health": "health hlth",
    "system": "system systems sys",
    "klinikum": "universitatsklinikum universitaetsklinikum uniklinikum klinikum ukl uk uniklinik",
    "hospitalier": "hospitalier hospier hosptalier hospitaller",
    "college": "college coll",
    "school": "school sch",
    "clinic": "clinic clinics",
    "trust": "trust",
    "society": "society soc",
    "department": "department dept",
    "group": "group grp",
}
# Legal forms and small words, which never tell entities apart.
FILLER = frozenset("inc incorporated corp corporation ltd limited llc plc co company gmbh ag sa srl the of de du des la le and und et y for in at".split())
HONORIFICS = frozenset("hon honorable mr mrs ms dr sen senator rep representative jr sr ii iii iv the gov".split())
# Given names with their short forms.
GIVEN = {
    "alexandra": "alex sandra sandy lexi", "charles": "charlie chuck chas", "deborah": "deb debbie debby", "edward": "ed eddie ted ned",
    "elizabeth": "liz beth betty eliza lizzie", "francesca": "fran frankie", "gregory": "greg", "henry": "hank harry", "irene": "rena renie",
    "james": "jim jimmy jamie", "joseph": "joe joey", "katherine": "kate kathy katie kathryn kay", "leonard": "len lenny leo", "margaret": "peggy meg maggie marge",
    "michael": "mike mick mickey", "nathaniel": "nate nat nathan", "octavia": "tavia tavi tavy", "patricia": "pat patty trish tricia", "richard": "dick rick rich ricky",
    "robert": "bob rob bobby robbie", "susan": "sue susie suzy", "theodora": "thea dora theo", "thomas": "tom tommy", "veronica": "ronnie vera roni", "william": "bill will billy liam",
    "zachary": "zach zack zac", "john": "jack johnny", "mary": "molly", "daniel": "dan danny", "matthew": "matt", "anthony": "tony", "andrew": "andy drew",
    "steven": "steve stephen", "david": "dave", "samuel": "sam sammy", "benjamin": "ben", "jennifer": "jen jenny", "rebecca": "becky", "barbara": "barb",
    "victoria": "vicky tori", "christopher": "chris", "nicholas": "nick", "timothy": "tim", "kenneth": "ken", "ronald": "ron", "lawrence": "larry",
}
#: least similarity of two spellings of one token: an edit needs four letters, two need eight
ALIKE = 0.75
#: the same for given names, which differ by less
GIVEN_ALIKE = 0.8
#: a token in no more distinct names is rare: two edits link only two rare tokens
RARE_NAMES = 1
_KIND = {w: k for k, ws in KIND_WORDS.items() for w in ws.split()}
_GIVEN = {w: g for g, ws in GIVEN.items() for w in [g, *ws.split()]}


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def edits(a: str, b: str, most: int = 3) -> int:
    """Edit distance with adjacent swaps, in a band of ``most`` around the diagonal; anything over ``most`` is ``most + 1``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    before: dict[int, int] = {}
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        new: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if not j:
                new[j] = i
                continue
            y = b[j - 1]
            d = min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before.get(j - 2, far) + 1)
            new[j] = d
        if min(new.values()) > most:
            return far
        before, row = row, new
    return min(row[len(b)], far)


def _letters(text: str) -> int:
    """The set of a word's letters as bits; k edits change at most 2k of them."""
    bits = 0
    for c in text:
        bits |= 1 << (ord(c) & 63)
    return bits


def _nearest(token: str, words: list[tuple[str, int]], most: int) -> str | None:
    """The first of ``words`` within ``most`` edits of a token."""
    bits = _letters(token)
    return next((w for w, b in words if abs(len(w) - len(token)) <= most and (b ^ bits).bit_count() <= 2 * most and edits(token, w, most) <= most), None)


_GIVEN_LONG = [(g, _letters(g)) for g in GIVEN if len(g) > 4]
_GIVEN_LONGER = [(g, b) for g, b in _GIVEN_LONG if len(g) > 6]
_KIND_LONG = [(k, _letters(k)) for k in KIND_WORDS if len(k) > 5]


@lru_cache(maxsize=65_536)
def _close_given(token: str) -> str | None:
    """The given name that a token is, or misspells by one edit, if long by two."""
    if token in _GIVEN:
        return _GIVEN[token]
    if len(token) < 4:
        return None
    return _nearest(token, _GIVEN_LONG, 1) or (_nearest(token, _GIVEN_LONGER, 2) if len(token) > 4 else None)


@lru_cache(maxsize=65_536)
def _kind_of(token: str) -> str | None:
    """The kind word that a token is, abbreviates, or misspells by one edit."""
    return _KIND.get(token) or (_nearest(token, _KIND_LONG, 1) if len(token) > 5 else None)


def organisation(name: str) -> tuple[list[str], str, str]:
    """(anchors, kind, "")."""
    text = fold(name).replace("int'l", "intl").replace("’", "'")
    text = re.sub(r"(?<=\s)\([^()\s]{1,8}\)", " ", text)  # an acronym
    text = text.replace("children's", "childrens").replace("hosp.ier", "hospitalier")
    text = re.sub(r"\bc\.?h\.? de\b|\bch (?=de\b)", "centre hospitalier de", text)
    tokens = re.findall(r"[^\W_]+", text.replace("'", ""))
    anchors, kinds = [], set()
    for t in tokens:
        if t in FILLER:
            continue
        kind = _kind_of(t)
        if kind:
            kinds.add(kind)
        elif len(t) > 1:
            anchors.append(t)
    if "hospitalier" in kinds or kinds == {"center", "hospital"}:
        kinds = {"hospitalier"}
    if "klinikum" in kinds:
        kinds = {"klinikum"}
    if not anchors and kinds:  # a name of kind words only
        anchors, kinds = sorted(kinds), set()
    return sorted(set(anchors)), " ".join(sorted(kinds)), ""


def person(name: str) -> tuple[list[str], str, str]:
    """([family], given name or initial, middle initial)."""
    text = re.sub(r"\[[^\]]*\]|\([^)]*\)", " ", fold(name))  # a party and state
    before, comma, after = text.partition(",")
    words = lambda t: [w for w in re.findall(r"[^\W_]+", t.replace("'", "")) if w not in HONORIFICS]
    if comma and words(before) and words(after):
        families, rest = words(before), words(after)
    else:
        tokens = words(text)
        long = [t for t in tokens if len(t) > 1]
        if not long:
            return [], "", ""
        known = [_close_given(t) is not None for t in long]
        # the last word is the family name unless it is a given name and another word is not
        family = long[-1] if not (known[-1] and not all(known)) else [t for t, k in zip(long, known) if not k][0]
        at = len(tokens) - 1 - tokens[::-1].index(family)
        families, rest = [family], tokens[:at] + tokens[at + 1 :]
    given = next((t for t in rest if len(t) > 1), None)
    initials = [t for t in rest if len(t) == 1]
    if given:
        canonical = _close_given(given) or given
        return ["".join(families)], canonical, initials[0] if initials else ""
    return ["".join(families)], initials[0] if initials else "", initials[1] if len(initials) > 1 else ""


PROFILES = {"organisation": organisation, "person": person}


def _profile(kinds: pd.Series, names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([PROFILES[k](n) for k, n in zip(kinds, names)], columns=["anchors", "q1", "q2"])


def _grams(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: [{"gram": f"^^{t}$$"[i : i + 3], "at": i} for i in range(len(t) + 2)])


def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    bits = {w: _letters(w) for w in {*a, *b}}
    return pd.Series([edits(x, y, 2) if (bits[x] ^ bits[y]).bit_count() <= 4 else 3 for x, y in zip(a, b)], dtype="int32")


def close_tokens(tokens: DataFrame, alike: float = ALIKE, max_edits: int = 2) -> DataFrame:
    """(field, token, n) -> (field, token, hub): the most frequent token that
    ``token`` misspells, among those at least ``alike``. Tokens one edit apart are linked; two edits apart only
    if both are rare (two misspellings of a form that does not occur).

    An edit touches at most four of a token's trigrams and moves the others by
    one place at most, so two tokens within k edits share one of the 4k + 1 rarest
    trigrams of each, at places k apart at most: only these prefixes are joined,
    and every pair within ``max_edits`` is found. ``n`` counts distinct names."""
    grams = tokens.withColumn("g", F.explode(F.pandas_udf(_grams, "array<struct<gram: string, at: int>>")("token"))).select("field", "token", "n", "g.gram", "g.at")
    df = grams.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("df"))
    ranked = grams.join(df, ["field", "gram"]).withColumn("rank", F.row_number().over(W.partitionBy("field", "token").orderBy("df", "gram", "at")))
    # edits that a token of this length and one longer by as many can be apart and still be alike
    room = F.least(F.lit(max_edits), F.floor((F.length("token") + max_edits) * (1 - alike)))
    prefix = ranked.filter(F.col("rank") <= 4 * room + 1).select("field", "gram", "at", "token", "n")
    a, b = prefix.alias("a"), prefix.alias("b")
    more = (F.col("b.n") > F.col("a.n")) | ((F.col("b.n") == F.col("a.n")) & (F.col("b.token") < F.col("a.token")))
    close = (F.abs(F.length("a.token") - F.length("b.token")) <= max_edits) & (F.abs(F.col("a.at") - F.col("b.at")) <= max_edits)
    pairs = a.join(b, (F.col("a.field") == F.col("b.field")) & (F.col("a.gram") == F.col("b.gram")) & more & close)
    pairs = pairs.select(F.col("a.field").alias("field"), F.col("a.token").alias("token"), F.col("a.n").alias("n"), F.col("b.token").alias("hub"), F.col("b.n").alias("hub_n")).distinct()
    near = pairs.withColumn("d", F.pandas_udf(_edits, "int")("token", "hub")).filter(F.col("d") <= F.greatest(F.length("token"), F.length("hub")) * (1 - alike))
    near = near.filter((F.col("d") == 1) | ((F.col("d") <= max_edits) & (F.col("hub_n") <= RARE_NAMES)))
    best = near.groupBy("field", "token").agg(F.min(F.struct("d", -F.col("hub_n"), "hub")).alias("best"))
    return best.select("field", "token", F.col("best.hub").alias("hub"))


def token_roots(tokens: DataFrame, alike: float = ALIKE) -> DataFrame:
    """(field, token, root): pointers to hubs, followed to their ends."""
    hubs = cut(close_tokens(tokens, alike))
    roots = tokens.select("field", "token").join(hubs, ["field", "token"], "left").select("field", "token", F.coalesce("hub", "token").alias("root"))
    step = hubs.select("field", F.col("token").alias("root"), "hub")
    while True:
        moved = roots.join(step, ["field", "root"], "left")
        new = cut(moved.select("field", "token", F.coalesce("hub", "root").alias("root"), F.col("hub").isNotNull().alias("moved")))
        roots = new.select("field", "token", "root")
        if new.filter("moved").isEmpty():
            return roots


def token_similarity(x: str, y: str) -> float:
    """1 for equal tokens, less for an initial or a misspelling, 0 for tokens that contradict each other."""
    if x == y:
        return 1.0
    if (len(x) == 1 or len(y) == 1) and x[0] == y[0]:
        return 0.8
    alike = 1 - edits(x, y, 2) / max(len(x), len(y))
    return alike if alike >= GIVEN_ALIKE else 0.0


def soft_similarity(a: tuple[str, str], b: tuple[str, str], weights: dict[str, float]) -> float:
    """Soft weighted similarity of the tokens of two names of one root, in 0..1.

    The roots are equal, and count as one token; a token that one of the names
    lacks is neutral; tokens of one place (given name or kind, middle initial) that contradict each other
    make the names different (0)."""
    total = got = 1.0
    for x, y in zip(a, b):
        if not x or not y:
            continue
        alike = token_similarity(x, y)
        if not alike:
            return 0.0
        w = max(weights.get(x, 1.0), weights.get(y, 1.0))
        total, got = total + w, got + w * alike
    return got / total


def _resolve(quals: list[tuple[str, str, int, float]]) -> list[str]:
    """The entity of each of the distinct qualifiers (q1, q2, names, weight) of a root that begin alike, in their order."""
    weights = {q[0]: q[3] for q in quals}
    names = {q[:2]: q[2] for q in quals}
    ranked = sorted(names, key=lambda q: (-names[q], q))
    full = [q for q in ranked if len(q[0]) > 1]
    with_second = {q[0] for q in full if q[1]}
    # entities: each q1 with each of its q2; a q1 that never has one stands alone
    entities = [q for q in full if q[1] or q[0] not in with_second] or [q for q in ranked if q[0]]
    own, first, second = set(entities), defaultdict(list), defaultdict(list)
    for e in entities:
        first[e[0]].append(e)
        second[e[1]].append(e)
    out = []
    for q in (x[:2] for x in quals):
        best = q
        if q not in own:
            # a whole q1 meets its own entities; an initial meets those with its middle initial and those with none
            pool = first[q[0]] if len(q[0]) > 1 else [*second[q[1]], *second[""]] if q[1] else entities
            fits = [(soft_similarity(q, e, weights), names[e], e) for e in pool]
            fits = [f for f in fits if f[0] > 0]
            best = max(fits, key=lambda f: (f[0], f[1]))[2] if fits else q
        out.append("|".join(best))
    return out


def _entities(groups: pd.Series) -> pd.Series:
    return groups.map(lambda g: _resolve([(x["q1"], x["q2"], x["n"], x["w"]) for x in g]))


def _given_roots(rooted: DataFrame) -> DataFrame:
    """(field, root, q1, given): given names that are on no list and rare, led to the name they misspell among those of their family."""
    people = rooted.filter((F.col("kind") == "person") & (F.length("q1") > 1))
    families = people.groupBy("field", "q1").agg(F.countDistinct("root").alias("families"))
    group = F.to_json(F.struct("field", "root"))
    tokens = people.groupBy("field", "root", "q1").agg(F.count(F.lit(1)).alias("n"))
    close = close_tokens(tokens.select(group.alias("field"), F.col("q1").alias("token"), "n"), GIVEN_ALIKE)
    rare = tokens.join(families, ["field", "q1"]).filter((F.col("families") <= RARE_NAMES) & ~F.col("q1").isin(*GIVEN))
    return rare.withColumn("group", group).join(close.select(F.col("field").alias("group"), F.col("token").alias("q1"), F.col("hub").alias("given")), ["group", "q1"]).select("field", "root", "q1", "given")


def link_names(df: DataFrame, field: str, kind: str, name: str) -> DataFrame:
    """(field, name, n_rows, entity) for every distinct name.

    ``kind`` is a column of ``organisation`` or ``person``."""
    names = df.select(F.col(f"`{field}`").alias("field"), F.col(f"`{kind}`").alias("kind"), F.col(f"`{name}`").cast("string").alias("name")).filter("name is not null").groupBy("field", "kind", "name").agg(F.count(F.lit(1)).alias("n"))
    profiles = cut(names.withColumn("p", F.pandas_udf(_profile, "struct<anchors: array<string>, q1: string, q2: string>")("kind", "name")).select("field", "kind", "name", "n", "p.*").filter(F.size("anchors") > 0))
    anchors = profiles.select("field", "kind", "name", "n", "q1", "q2", F.explode("anchors").alias("token"))
    roots = token_roots(anchors.groupBy("field", "token").agg(F.count(F.lit(1)).alias("n")))
    rooted = anchors.join(roots, ["field", "token"]).groupBy("field", "kind", "name").agg(F.array_join(F.array_sort(F.collect_set("root")), " ").alias("root"), F.first("q1").alias("q1"), F.first("q2").alias("q2"), F.first("n").alias("n_rows"))
    rooted = cut(rooted)
    given = _given_roots(rooted)
    rooted = rooted.join(given, ["field", "root", "q1"], "left").withColumn("q1", F.coalesce("given", "q1")).drop("given", "kind")
    rooted = cut(rooted)
    rare = rooted.groupBy("field", "q1").agg(F.count(F.lit(1)).alias("df"))
    total = rooted.groupBy("field").agg(F.count(F.lit(1)).alias("names"))  # one row a field
    weights = rare.join(F.broadcast(total), "field").select("field", "q1", F.log1p(F.col("names") / F.col("df")).alias("w"))
    distinct = rooted.groupBy("field", "root", "q1", "q2").agg(F.count(F.lit(1)).alias("n")).join(weights, ["field", "q1"])
    # one row a root and first letter with its distinct qualifiers, resolved in Arrow batches of many roots
    letter = F.substring("q1", 1, 1)
    grouped = distinct.filter("q1 != ''").groupBy("field", "root", letter.alias("letter")).agg(F.sort_array(F.collect_list(F.struct("q1", "q2", "n", "w"))).alias("quals"))
    resolved = grouped.select("field", "root", F.explode(F.arrays_zip("quals", F.pandas_udf(_entities, "array<string>")("quals").alias("entity"))).alias("x"))
    resolved = cut(resolved.select("field", "root", "x.quals.q1", "x.quals.q2", "x.quals.n", "x.entity"))
    # a name of the root alone goes to its entity of most names, if there is any
    most = resolved.groupBy("field", "root", "entity").agg(F.sum("n").alias("n"), F.max(F.when(F.length("q1") > 1, 1).otherwise(0)).alias("full")).groupBy("field", "root").agg(F.min(F.struct(-F.col("full"), -F.col("n"), "entity"))["entity"].alias("entity"))
    bare = distinct.filter("q1 = ''").join(most, ["field", "root"], "left").select("field", "root", "q1", "q2", F.coalesce("entity", F.concat(F.lit("|"), "q2")).alias("entity"))
    entities = resolved.drop("n").unionByName(bare)
    return rooted.join(entities, ["field", "root", "q1", "q2"]).select("field", "name", "n_rows", F.concat_ws("|", "root", "entity").alias("entity"))


def name_pairs(linked: DataFrame) -> DataFrame:
    """(field, name_a, name_b), name_a < name_b, for names of one entity."""
    a, b = linked.alias("a"), linked.alias("b")
    joined = a.join(b, (F.col("a.field") == F.col("b.field")) & (F.col("a.entity") == F.col("b.entity")) & (F.col("a.name") < F.col("b.name")))
    return joined.select(F.col("a.field").alias("field"), F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"))
