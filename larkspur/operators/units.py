"""Converting quantities recorded in many units to common units.

A unit as written is read as marks of scale (thousand, MM, k, giga, 10^6),
currency and ratio, and the rest, which names a base unit (barrels, cf, therm).
Every distinct spelling is taken once: its rest is matched to the catalogue's
base units - a character n-gram inverted index proposes candidates (an equi-join
on n-grams), a weighted edit distance in which plurals, spaces and hyphens cost
little verifies them - and its marks give the scale. The alias dictionary that
results is joined to all rows. M means thousand in barrels, gallons and cubic
feet, and MM million; in watthours and joules M is mega.

Words are first led to the known words they misspell (``milion`` is
``million``), so that a typing error in a word of scale does not change the
scale; a word as near to two of them (``nillion``) is left as it is and matches nothing.

Defined results: a row without value gives null; a row whose unit is nowhere
stated or matches nothing is kept with null factor; equal spellings give equal
results; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.session import cut, small_side

# Conversion constants.
GALLONS_PER_BARREL = 42
M3_PER_BARREL = 0.158987294928
M3_PER_CUBIC_FOOT = 0.028316846592
MMBTU_PER_THERM = 0.1
GJ_PER_MWH = 3.6

@dataclass(frozen=True)
class Group:
    """A series group: the factor of one base unit (in cents, if it is a price) to the common unit, by base unit, and the common unit's name."""

    bases: dict[str, float]
    common: str
    price: bool = False


#: What the series groups are measured in, the base units and their value in the common unit.
CATALOGUE = {
    "PET.STK": Group({"barrel": 1e-3, "gallon": 1e-3 / GALLONS_PER_BARREL, "cubic metre": 1e-3 / M3_PER_BARREL}, "thousand barrels"),
    "PET.PRC": Group({"barrel": 1.0, "gallon": 1.0 * GALLONS_PER_BARREL, "cubic metre": M3_PER_BARREL}, "cents per barrel", price=True),
    "NG.PROD": Group({"cubic foot": 1e-6, "cubic metre": 1e-6 / M3_PER_CUBIC_FOOT}, "million cubic feet"),
    "NG.PRC": Group({"btu": 1e6, "therm": 1.0 / MMBTU_PER_THERM}, "cents per million Btu", price=True),
    "ELEC.GEN": Group({"watthour": 1e-6, "joule": 1e-9 / GJ_PER_MWH}, "megawatthours"),
}
#: Names of base units.
BASES = {
    "barrel": ["barrels", "bbl"], "gallon": ["gallons", "gal"], "cubic metre": ["cubic metres", "m3", "cm"], "cubic foot": ["cubic feet", "cu ft", "cf"],
    "btu": ["btu"], "therm": ["therm", "thm"], "watthour": ["watthours", "wh"], "joule": ["joules", "j"],
}
#: Words and signs of scale.
SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "mn": 1e6, "bn": 1e9, "kilo": 1e3, "mega": 1e6, "giga": 1e9, "tera": 1e12, "peta": 1e15, "k": 1e3}
#: Letters of scale before a short base unit: those of trade, and those of the SI.
TRADE, SI = {"m": 1e3, "mm": 1e6, "b": 1e9, "k": 1e3, "": 1.0}, {"k": 1e3, "m": 1e6, "g": 1e9, "t": 1e12, "p": 1e15, "": 1.0}
_SAYS_NOTHING = r"^\s*(see (name|title|description|notes?)|n/?a|unknown|none|-|\?)?\s*$"


def _edits(a: str, b: str) -> int:
    """Edit distance with adjacent swaps."""
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return row[-1]


#: the words long enough to be told from their misspellings
_WORDS = sorted({w for names in BASES.values() for name in names for w in re.findall(r"[a-z]{5,}", name)} | {w for w in SCALES if len(w) > 4} | {"barrel", "gallon", "dollars", "dollar", "cents", "meters", "metres", "megawatthours", "gigawatthours", "kilowatthours", "terawatthours", "gigajoules", "terajoules", "megajoules", "petajoules"})


@lru_cache(maxsize=65_536)
def corrected(word: str) -> str:
    """The known word that a word misspells by one edit, or two from nine letters on; itself if that is none or several."""
    if len(word) < 5 or not word.isalpha() or word in _WORDS:
        return word
    near = sorted((d, w) for w in _WORDS if abs(len(w) - len(word)) <= 2 and (d := _edits(word, w)) <= (1 if len(word) < 9 else 2))
    if not near or (len(near) > 1 and near[0][0] == near[1][0] and _scaled(near[0][1]) != _scaled(near[1][1])):
        return word
    return near[0][1]


def plain_unit(text: str) -> str:
    """A unit spelling without what never tells units apart, its words corrected.
    Case is kept only in short marks, where m and M may differ."""
    t = " ".join(text.replace("³", "3").replace("US$", "$").split()).strip()
    while len(t) > 2 and t[0] in "([" and t[-1] in ")]" and t.count("(") + t.count("[") == 1:
        t = t[1:-1].strip()
    t = re.sub(r"\bU\.?S\.?\s+(?=gal|cent|dollar)", "", t)
    return " ".join(w if len(w) <= 3 else re.sub(r"[a-z]{5,}", lambda m: corrected(m[0]), w.lower()) for w in t.split())


def _scaled(word: str) -> tuple[float, str]:
    """The scale that a word carries (megawatthours, million) and what is left of it."""
    if word in SCALES:
        return SCALES[word], ""
    for prefix in ("kilo", "mega", "giga", "tera", "peta"):
        if word.startswith(prefix):
            return SCALES[prefix], word[len(prefix) :]
    return 1.0, word


_SHORT = re.compile(r"^(mm|[mkbgtp])?(bbls?|btu|cf|gal|cm|wh|j)$")


def _amount(text: str) -> tuple[float, str]:
    """(scale, base as written) of an amount such as "thousand barrels", "MMcf" or "10^3 m3"."""
    scale, rest = 1.0, []
    for w in text.split():
        if hit := re.fullmatch(r"10\^(\d+)", w):
            scale *= 10.0 ** int(hit[1])
        elif re.fullmatch(r"1(?:,?000)+", w):
            scale *= float(w.replace(",", ""))
        elif hit := _SHORT.match(w.lower()):
            letters = SI if hit[2] in ("wh", "j") else TRADE
            if (hit[1] or "") not in letters:
                return 1.0, ""  # a letter that this unit never has
            scale *= letters[hit[1] or ""]
            rest.append(hit[2])
        else:
            more, left = _scaled(w.lower())
            scale *= more
            rest.append(left)
    return scale, " ".join(x for x in rest if x)


_MONEY = re.compile(r"(?i)^(?:us\s*)?(us\s*dollars?|dollars?|usd|\$|us\s*cents?|cents?|¢|c)\s*(?:per\b|/)\s*")


def read_unit(text: str) -> tuple[float | None, float, str]:
    """(cents of the currency if it is a price, scale, base as written) of a spelling."""
    t = plain_unit(text)
    t = re.sub(r"(?<=\S)\s*\([^()]*\)$", "", t)  # the same once more, abbreviated
    money = _MONEY.match(t)
    scale, base = _amount(t[money.end() :] if money else t)
    return (1.0 if "c" in money[1].lower()[:1] or "cent" in money[1].lower() or money[1] == "¢" else 100.0) if money else None, scale, base


def base_distance(a: str, b: str) -> float:
    """Weighted edit distance in 0..1 of two names of base units."""

    def cost(c: str) -> float:
        return 0.1 if c in " -.s()" else 1.0

    row = [0.0]
    for c in b:
        row.append(row[-1] + cost(c))
    for c in a:
        new = [row[0] + cost(c)]
        for j, d in enumerate(b, 1):
            swap = 0.0 if c == d else (0.3 if {c, d} <= set("er") else 1.0)
            new.append(min(row[j] + cost(c), new[-1] + cost(d), row[j - 1] + swap))
        row = new
    return row[-1] / max(len(a), len(b), 1)


def unit_distance(a: str, b: str) -> float:
    """Distance of two spellings; 1 if their currency or scale differs."""
    (money_a, scale_a, base_a), (money_b, scale_b, base_b) = read_unit(a), read_unit(b)
    return base_distance(base_a, base_b) if (money_a, scale_a) == (money_b, scale_b) else 1.0


def stated_unit(units: Column, *texts: Column) -> Column:
    """The unit as written: ``units`` if it says anything, else what the first
    of ``texts`` gives in square brackets, after "Units:" or "values in", or in
    round brackets at its end."""
    said = F.when(~F.coalesce(units, F.lit("")).rlike(f"(?i){_SAYS_NOTHING}"), units)
    found = [said]
    for text in texts:
        for pattern in (r"^\[([^\]]+)\]", r"\b[Uu]nits:\s*(.+?)\.\s+[A-Z]", r"(?i)\bunits:\s*(.+?)\.?$", r"(?i)\bvalues? (?:are )?in\s+(.+?)\.?$", r"(?i)\bin units of\s+(.+?)\.?$", r"\(((?:[^()]|\([^()]*\))+)\)\s*$"):
            found.append(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")))
    return F.trim(F.coalesce(*found))


def alias_dictionary(spellings: DataFrame, nearest: float = 0.34, gram: int = 2) -> DataFrame:
    """(unit_group, spelling) -> (factor, unit, distance) for a table of distinct spellings.

    Candidates share a character n-gram with a base unit of their group; the
    closest within ``nearest`` is taken, and the spelling's marks give the scale."""
    spark = spellings.sparkSession
    rows = [(g, n, b, float(f), group.price) for g, group in CATALOGUE.items() for b, f in group.bases.items() for n in BASES[b]]
    known = spark.createDataFrame(pd.DataFrame(rows, columns=["unit_group", "known", "base", "value", "price"]))

    @F.pandas_udf("array<string>")
    def grams(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: sorted({f"^{x}$"[i : i + gram] for i in range(len(x) + 3 - gram)}))

    @F.pandas_udf("struct<money: double, scale: double, written: string>")
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_unit(t) for t in texts], columns=["money", "scale", "written"]).astype({"money": float, "scale": float})

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([base_distance(x, y) for x, y in zip(a, b)])

    left = spellings.select("unit_group", "spelling").distinct().withColumn("r", read("spelling")).select("unit_group", "spelling", "r.*")
    index = known.select("*", F.explode(grams("known")).alias("gram"))  # bounded: the catalogue
    pairs = left.withColumn("gram", F.explode(grams("written"))).join(F.broadcast(index), ["unit_group", "gram"]).drop("gram").distinct()
    # a price needs a currency, an amount has none
    fits = pairs.filter(F.col("price") == (F.col("money").isNotNull() & ~F.isnan("money"))).withColumn("distance", distance("written", "known")).filter(F.col("distance") <= nearest)
    best = fits.groupBy("unit_group", "spelling").agg(F.min(F.struct("distance", "known", "base", "value", "price", "money", "scale")).alias("b"))
    factor = F.when(F.col("b.price"), F.col("b.money") * F.col("b.value") / F.col("b.scale")).otherwise(F.col("b.scale") * F.col("b.value"))
    unit = F.concat_ws(" ", F.when(F.col("b.price"), F.concat(F.format_number("b.money", 0), F.lit(" cents per"))), F.when(F.col("b.scale") != 1, F.format_string("%.0f", F.col("b.scale"))), "b.base")
    return best.select("unit_group", "spelling", factor.alias("factor"), unit.alias("unit"), F.col("b.distance").alias("distance"))


def convert_units(df: DataFrame, group: str, units: str, value: str, texts: list[str]) -> DataFrame:
    """Adds ``unit``, ``factor`` (null: not known) and ``common_value``."""
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("unit", "factor", "common_value")]
    named = df.select(*keep, F.col(f"`{group}`").alias("__group"), stated_unit(F.col(f"`{units}`"), *[F.col(f"`{t}`") for t in texts]).alias("__spelling"), F.col(f"`{value}`").alias("__value"))
    # distinct spellings only: pre-aggregated before any comparison
    spelled = named.select(F.col("__group").alias("unit_group"), F.col("__spelling").alias("spelling")).dropna().distinct()
    aliases = alias_dictionary(spelled).select(F.col("unit_group").alias("__group"), F.col("spelling").alias("__spelling"), "unit", "factor")
    joined = named.join(small_side(cut(aliases)), ["__group", "__spelling"], "left")
    return joined.select(*keep, "unit", "factor", (F.col("__value") * F.col("factor")).alias("common_value"))


# What a load may be recorded as, in megawatts: MW, GW, kW, and MWh, GWh, kWh of a quarter hour.
LOAD_FACTORS = (1.0, 1000.0, 0.001, 4.0, 4000.0, 0.004)


def load_in_megawatts(df: DataFrame, area: str, time: str, load: str, forecast: str, span_s: int = 3600) -> DataFrame:
    """Adds ``factor`` and ``common_value`` (megawatts) for loads of unstated scale.

    The scale is the one that brings the load closest to its forecast (in
    ratio). Without a forecast, the mean forecast of the area over the hour and
    its neighbours stands in, else the area's mean forecast. ``time``: seconds
    since 1970. A load that is null or not positive, or an area without any
    forecast, gives null."""
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("factor", "common_value")]
    rows = df.select(*keep, F.col(f"`{area}`").alias("__area"), F.floor(F.col(f"`{time}`") / span_s).alias("__at"), F.col(f"`{load}`").alias("__load"), F.when(F.col(f"`{forecast}`") > 0, F.col(f"`{forecast}`")).alias("__f"))
    known = rows.select("__area", "__at", "__f").filter("__f IS NOT NULL")
    hourly = known.groupBy("__area", "__at").agg(F.sum("__f").alias("s"), F.count("__f").alias("n"))
    around = hourly.select("__area", F.explode(F.array(F.col("__at") - 1, F.col("__at"), F.col("__at") + 1)).alias("__at"), "s", "n")
    near = cut(around.groupBy("__area", "__at").agg((F.sum("s") / F.sum("n")).alias("__near")))
    areas = hourly.groupBy("__area").agg((F.sum("s") / F.sum("n")).alias("__all"))
    has = rows.filter("__f IS NOT NULL").withColumn("__level", F.col("__f"))
    lacks = rows.filter("__f IS NULL").join(near, ["__area", "__at"], "left").join(areas, "__area", "left").withColumn("__level", F.coalesce("__near", "__all"))
    both = has.unionByName(lacks.drop("__near", "__all"))
    off = F.array(*[F.struct(F.abs(F.ln(F.col("__load") * f / F.col("__level"))).alias("off"), F.lit(f).alias("factor")) for f in LOAD_FACTORS])
    best = F.when((F.col("__load") > 0) & (F.col("__level") > 0), F.array_min(off)["factor"])
    return both.withColumn("__factor", best).select(*keep, F.col("__factor").alias("factor"), (F.col("__load") * F.col("__factor")).alias("common_value"))
