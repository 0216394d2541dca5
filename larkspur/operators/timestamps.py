"""Normalising dates and times written in many forms.

A text is split into an optional weekday, a date, and an optional time of day
with an optional zone. Every date layout that yields a possible date is one
*parse* of the text. Slashed dates may have two parses (month first or day
first); which one holds is decided per source by expectation-maximisation over
a mixture of layouts and of unreadable noise: each date contributes its
likelihood under each valid parse, weighed by the prior that is declared for the
field, and the posterior chooses. The EM sees only counts of parse signatures
per source, taken from the distinct slashed dates, never the rows.

A wall-clock time that daylight saving repeats has two parses of equal weight
(the earlier is given), one that it skips has none (the time is moved on by the
gap): both are marked ``ambiguous``, as is every choice with a posterior below ``sure``.

Parsing runs in Arrow batches: the same rules as built-in expressions make a
plan of some ten thousand nodes, which took 24 s to build and ten times as long to run.

Defined results: null, empty, placeholder and impossible texts give
``normal_form`` null; white space of any length counts as one blank, and texts
of any length are read; equal rows give equal results; an
empty table gives an empty table; extra columns are kept untouched unless they
carry one of the four output names, which are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from calendar import monthrange
from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.session import cut, small_side

OUTPUT = ("normal_form", "layout", "posterior", "ambiguous")
#: likelihood of a date as noise, and prior of the order that a field is declared not to use
NOISE, UNDECLARED = 1e-4, 1e-6
#: longer texts are read as well, but not remembered
REMEMBERED = 80

# Month names by language (lower case, without accents).
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "en3": "jan feb mar apr may jun jul aug sep oct nov dec",
    "en4": "jan feb mar apr may june july aug sept oct nov dec",
    "de": "januar februar marz april mai juni juli august september oktober november dezember",
    "de3": "jan feb mrz apr mai jun jul aug sep okt nov dez",
    "fr": "janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre",
    "fr3": "janv fevr mars avr mai juin juil aout sept oct nov dec",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "es3": "ene feb mar abr may jun jul ago sep oct nov dic",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "pt": "janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro",
    "nl": "januari februari maart april mei juni juli augustus september oktober november december",
}
# Zone abbreviations in minutes east of UTC.
ZONES = {"z": 0, "ut": 0, "utc": 0, "gmt": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "cet": 60, "cest": 120, "bst": 60, "jst": 540, "kst": 540}

_MONTH_OF = {name: i for names in MONTHS.values() for i, name in enumerate(names.split(), 1)}
_WEEKDAY = re.compile(r"^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,?\s+")
_ZONE = r"(?P<zone>z|utc?|gmt|[ecmp][sd]t|cest|cet|bst|jst|kst|[+-]\d{2}(?::?\d{2})?)"
_CLOCK = re.compile(rf"^(?P<date>.*?)(?:\s*t\s*|\s+)(?P<h>\d{{1,2}}):(?P<m>\d{{2}})(?::(?P<s>\d{{2}})(?:[.,]\d+)?)?\s*(?P<half>[ap]\.?m\.?)?\s*{_ZONE}?$")
_COMPACT = re.compile(rf"^(?P<date>\d{{8}})t(?P<h>\d{{2}})(?P<m>\d{{2}})(?P<s>\d{{2}})?(?P<half>)(?:[.,]\d+)?{_ZONE}?$")
_N = r"[^\W\d_]+"  # a name

#: layout -> pattern; y, m, d are year, month and day, l is the last month of a span
LAYOUTS = {
    "ymd": r"(?P<y>\d{4})[-/.](?P<m>\d{1,2})[-/.](?P<d>\d{1,2})",
    "ymd_compact": r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})",
    "ym": r"(?P<y>\d{4})[-/.](?P<m>\d{1,2})",
    "y": r"(?P<y>\d{4})",
    "slash_mdy": r"(?P<m>\d{1,2})/(?P<d>\d{1,2})/(?P<y>\d{4}|\d{2})",
    "slash_dmy": r"(?P<d>\d{1,2})/(?P<m>\d{1,2})/(?P<y>\d{4}|\d{2})",
    "dot_dmy": r"(?P<d>\d{1,2})\.\s?(?P<m>\d{1,2})\.\s?(?P<y>\d{4}|\d{2})",
    "dash_dmy": r"(?P<d>\d{1,2})-(?P<m>\d{1,2})-(?P<y>\d{4})",
    "day_name_year": rf"(?P<d>\d{{1,2}})(?:st|nd|rd|th|er|º)?\.?[\s-]+(?:de\s+)?(?P<m>{_N})\.?,?[\s-]+(?:de\s+)?(?P<y>\d{{4}}|\d{{2}})",
    "name_day_year": rf"(?P<m>{_N})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})",
    "year_name_day": rf"(?P<y>\d{{4}})[\s-]+(?P<m>{_N})\.?[\s-]+(?P<d>\d{{1,2}})",
    "year_name": rf"(?P<y>\d{{4}})[\s-]+(?P<m>{_N})\.?",
    "name_year": rf"(?P<m>{_N})\.?,?[\s-]+(?:de\s+)?(?P<y>\d{{4}})",
    "year_names": rf"(?P<y>\d{{4}})\s+(?P<m>{_N})\.?\s?[-–/]\s?(?P<l>{_N})\.?",
    "names_year": rf"(?P<m>{_N})\.?\s?[-–/]\s?(?P<l>{_N})\.?,?\s+(?P<y>\d{{4}})",
    "cjk_ymd": r"(?P<y>\d{4})\s?[年년]\s?(?P<m>\d{1,2})\s?[月월]\s?(?P<d>\d{1,2})\s?[日일号]",
    "cjk_ym": r"(?P<y>\d{4})\s?[年년]\s?(?P<m>\d{1,2})\s?[月월]",
    "cjk_y": r"(?P<y>\d{4})\s?[年년]",
    "day_number": r"(?P<days>\d{5})",
    "epoch_s": r"(?P<secs>-?\d{9,10})",
    "epoch_ms": r"(?P<ms>-?\d{12,13})",
}
_PATTERNS = {k: re.compile(v) for k, v in LAYOUTS.items()}


_ZEROS = str.maketrans("123456789", "000000000")


def _layouts_of(shape: str) -> tuple[str, ...]:
    """The layouts of a text whose digits are all 0: no pattern tells one digit from another."""
    return tuple(k for k, p in _PATTERNS.items() if p.fullmatch(shape))


def _clock_of(shape: str) -> tuple[tuple[int, int], ...] | None:
    """Where the parts of a time of day stand in such a text, if it ends with one:
    the spans of date, hour, minute, second, half of the day and zone."""
    hit = next((m for m in (p.match(shape) for p in (_COMPACT, _CLOCK)) if m), None)
    return tuple(hit.span(g) for g in ("date", "h", "m", "s", "half", "zone")) if hit else None


def _month(text: str) -> int | None:
    return int(text) if text.isdigit() else _MONTH_OF.get("".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)))


def _utc(t: datetime) -> str:
    return f"{t.year:04d}-{t.month:02d}-{t.day:02d}T{t.hour:02d}:{t.minute:02d}:{t.second:02d}Z"


def _seconds(h: str, m: str, s: str, half: str, zone: str) -> tuple[int | None, int | None]:
    """Seconds of the day and minutes east of UTC; None: impossible, not given."""
    hour, minute, second, half = int(h), int(m), int(s or 0), half[:1]
    if minute > 59 or second > 59 or hour > 24 or (hour == 24 and (minute or second)) or (half and not 1 <= hour <= 12):
        return None, None
    if half:
        hour = hour % 12 + 12 * (half == "p")
    secs = hour * 3600 + minute * 60 + second
    if not zone:
        return secs, None
    if zone in ZONES:
        return secs, ZONES[zone]
    digits = re.sub(r"\D", "", zone).ljust(4, "0")
    return secs, (-1 if zone[0] == "-" else 1) * (int(digits[:2]) * 60 + int(digits[2:]))


def _day_offset(zone: str, y: int, m: int, d: int) -> timedelta | None:
    """What a zone's clock is ahead of UTC all through a day; None if that changes on it."""
    local, day = ZoneInfo(zone), datetime(y, m, d)
    offsets = {(day + timedelta(hours=h)).replace(tzinfo=local, fold=f).utcoffset() for h in (-1, 0, 12, 24, 25) for f in (0, 1)}
    return offsets.pop() if len(offsets) == 1 else None


def _on_the_clock(t: datetime, zone: str) -> tuple[str, bool]:
    """UTC of a wall-clock time, the earlier if it occurs twice, and whether it occurs exactly once."""
    local = ZoneInfo(zone)
    first, second = t.replace(tzinfo=local), t.replace(tzinfo=local, fold=1)
    return _utc(first.astimezone(UTC)), first.utcoffset() == second.utcoffset()


def _dates(day: str) -> tuple[tuple[str, int, int, int, str], ...]:
    """Every reading of a date as (layout, year, month, day, normal form); day 0 where it takes no time of day."""
    found = []
    for layout in (_known_layouts if len(day) <= REMEMBERED else _layouts_of)(day.translate(_ZEROS)):
        part = _PATTERNS[layout].fullmatch(day).groupdict()
        try:
            if "days" in part:
                found.append((layout, 0, 0, 0, (date(1899, 12, 30) + timedelta(days=int(part["days"]))).isoformat()))
                continue
            if "y" not in part:
                found.append((layout, 0, 0, 0, _utc(datetime(1970, 1, 1) + timedelta(seconds=int(part["secs"]) if "secs" in part else int(part["ms"]) // 1000))))
                continue
            y = int(part["y"]) + 2000 * (len(part["y"]) == 2)
            m, d, last = (_month(part["m"]) if "m" in part else None), (int(part["d"]) if "d" in part else None), (_month(part["l"]) if "l" in part else None)
            if y < 1000 or ("m" in part and not (m and 1 <= m <= 12)) or ("d" in part and not 1 <= d <= monthrange(y, m)[1]) or ("l" in part and not (last and last > m)):
                continue
            form = f"{y:04d}-{m:02d}/{y:04d}-{last:02d}" if last else f"{y:04d}" + (f"-{m:02d}" if m else "") + (f"-{d:02d}" if d else "")
            found.append((layout, y, m or 0, d or 0, form))
        except (ValueError, OverflowError):
            continue
    return tuple(found)


# Dates, times of day and shapes repeat where whole texts do not.
_known_layouts, _known_clock, _known_seconds, _known_offset, _known_dates = (lru_cache(maxsize=65_536)(f) for f in (_layouts_of, _clock_of, _seconds, _day_offset, _dates))


def parses(raw: str | None, zone: str | None = None) -> tuple[tuple[str, str, bool], ...]:
    """Every reading of a text as (layout, normal form, whether its moment is certain).

    ``zone``: of a time written without one (UTC if None)."""
    if raw is None:
        return ()
    text = " ".join(raw.lower().split())
    if text and text[0].isalpha():
        text = _WEEKDAY.sub("", text)
    short = len(text) <= REMEMBERED
    spans = (_known_clock if short else _clock_of)(text.translate(_ZEROS))
    if spans is None:
        return tuple((layout, form, True) for layout, _, _, _, form in (_known_dates if short else _dates)(text))
    (_, end), *parts = spans
    secs, east = (_known_seconds if short else _seconds)(*(text[a:b] if a >= 0 else "" for a, b in parts))
    if secs is None:
        return ()
    found = []
    for layout, y, m, d, _ in (_known_dates if short else _dates)(text[:end].rstrip(", ")):
        if not d:
            continue
        try:
            t = datetime(y, m, d) + timedelta(seconds=secs)
            if east is not None:
                found.append((layout, _utc(t - timedelta(minutes=east)), True))
            elif not zone:
                found.append((layout, _utc(t), True))
            elif (offset := _known_offset(zone, y, m, d)) is not None:
                found.append((layout, _utc(t - offset), True))
            else:
                found.append((layout, *_on_the_clock(t, zone)))
        except (ValueError, OverflowError):
            continue
    return tuple(found)


def mixture(counts: list[tuple[dict[str, float], int]], prior: dict[str, float], rounds: int = 200) -> dict[str, float]:
    """Weights of the layouts of one source: EM over signatures (the likelihood
    of a text under each layout that reads it) with their counts; ``prior`` adds pseudo-counts."""
    names = sorted({x for s, _ in counts for x in s})
    weight = {x: 1.0 / len(names) for x in names}
    for _ in range(rounds):
        mass = {x: prior.get(x, 0.0) + 1e-3 for x in names}
        for s, n in counts:
            total = sum(weight[x] * like for x, like in s.items())
            for x, like in s.items():
                mass[x] += n * weight[x] * like / total
        total = sum(mass.values())
        new = {x: mass[x] / total for x in names}
        moved = max(abs(new[x] - weight[x]) for x in names)
        weight = new
        if moved < 1e-9:
            break
    return weight


#: signature of a slashed date -> the layouts that read it; a date read alike by both (05/05/2020) says nothing
_BOTH, _MONTH_ONLY, _DAY_ONLY, _NEITHER = "both", "slash_mdy", "slash_dmy", "none"


def _signature(slashed: str) -> str:
    forms = {layout: form for layout, form, _ in parses(slashed) if layout.startswith("slash")}
    if len(forms) == 2:
        return _BOTH if len(set(forms.values())) == 2 else ""
    return next(iter(forms), _NEITHER)


def slashed_orders(counts: dict[str, int], prior: dict[str, float]) -> tuple[float, float]:
    """Posteriors that a date readable in both orders is month first, and that
    one readable day first only is a date at all, from one source's counts of signatures."""
    likes = {name: {**{k: prior[k] for k in ((_MONTH_ONLY, _DAY_ONLY) if name == _BOTH else (name,)) if k in prior}, _NEITHER: NOISE} for name in (_BOTH, _MONTH_ONLY, _DAY_ONLY, _NEITHER)}
    # with no evidence at all, month first is somewhat likelier
    weight = mixture([(likes[name], n) for name, n in [*counts.items(), (_BOTH, 0)] if name in likes], {_MONTH_ONLY: 0.05})
    month, day, noise = (weight.get(k, 0.0) * p for k, p in ((_MONTH_ONLY, prior[_MONTH_ONLY]), (_DAY_ONLY, prior[_DAY_ONLY]), (_NEITHER, NOISE)))
    return month / (month + day), day / (day + noise)


def _read(text: str | None, zone: str | None, month: float, day_only: float, sure: float) -> tuple[str | None, str | None, float | None, bool | None]:
    """(normal form, layout, posterior, ambiguous) of a text, given the orders of its source."""
    found = parses(text, zone)
    slashed = [p for p in found if p[0].startswith("slash")]
    if len(slashed) == 2 and slashed[0][1] != slashed[1][1]:
        pick = slashed[0 if month >= 0.5 else 1]
        posterior = max(month, 1.0 - month)
    elif slashed and slashed[0][0] == _DAY_ONLY:
        if day_only < 0.5:
            return None, None, None, None
        pick, posterior = slashed[0], day_only
    elif found:
        pick, posterior = found[0], 1.0
    else:
        return None, None, None, None
    if not pick[2]:
        posterior *= 0.5
    return pick[1], pick[0], posterior, posterior < sure


def _column(value: object) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def normalise_times(df: DataFrame, col: str, source: str | None = None, zone: str | Column | None = None, month_first: bool | Column = False, sure: float = 0.9) -> DataFrame:
    """Adds ``normal_form``, ``layout``, ``posterior`` and ``ambiguous`` for the text in ``col``.

    ``source``: column that says where a row comes from; each source has its own
    mixture of layouts. ``zone``: zone of times written without one (UTC if
    None). ``month_first``: the field is declared to write slashed dates month
    first, which is the prior of the mixture. Both may be columns, where fields
    are united. ``ambiguous`` is true where the posterior is below ``sure``, as
    it is for a time that the zone's clock shows twice or skips."""
    keep = [F.col(f"`{c}`") for c in df.columns if c not in OUTPUT]
    df = df.select(*keep, F.col(f"`{col}`").cast("string").alias("__text"), (F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")) if source else F.lit("")).alias("__source"), _column(zone).cast("string").alias("__zone"), _column(month_first).alias("__declared"))

    @F.pandas_udf("string")
    def signature(slashed: pd.Series) -> pd.Series:
        return slashed.map(_signature)

    def em(part: pd.DataFrame) -> pd.DataFrame:
        declared = bool(part["__declared"].iloc[0])
        month, day_only = slashed_orders(dict(zip(part["sig"], part["n"].astype(int))), {_MONTH_ONLY: 1.0, _DAY_ONLY: UNDECLARED if declared else 1.0})
        return pd.DataFrame({"__source": [part["__source"].iloc[0]], "__declared": [declared], "__month": [month], "__day_only": [day_only]})

    # distinct slashed dates only: the calendar bounds them, whatever the rows
    by = ["__source", "__declared"]
    dates = df.select(*by, F.regexp_extract("__text", r"(?i)^\s*(?:[a-z]+,?\s+)?(\d{1,2}/\d{1,2}/(?:\d{4}|\d{2}))(?![\d/])", 1).alias("slashed")).filter("slashed != ''").groupBy(*by, "slashed").agg(F.count(F.lit(1)).alias("n"))
    counts = dates.groupBy(*by, signature("slashed").alias("sig")).agg(F.sum("n").alias("n"))
    orders = counts.groupBy(*by).applyInPandas(em, "__source string, __declared boolean, __month double, __day_only double")  # a group holds the few signatures of one source
    if source:
        joined = df.join(small_side(cut(orders)), by, "left")
    else:  # one mixture, so one row (two if the declaration is a column), which needs no join
        found = {r["__declared"]: r for r in orders.collect()}
        pick = lambda c: F.when(F.col("__declared"), F.lit(found[True][c] if True in found else 1.0)).otherwise(F.lit(found[False][c] if False in found else 1.0))
        joined = df.withColumn("__month", pick("__month")).withColumn("__day_only", pick("__day_only"))

    @F.arrow_udf("struct<form: string, layout: string, posterior: double, ambiguous: boolean>")
    def read(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        types = (pa.string(), pa.string(), pa.float64(), pa.bool_())
        for batch in batches:
            columns = list(zip(*(_read(t, z, m, d, sure) for t, z, m, d in zip(*(x.to_pylist() for x in batch))))) or [[]] * 4
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["form", "layout", "posterior", "ambiguous"])

    joined = joined.withColumn("__p", read("__text", "__zone", F.coalesce("__month", F.lit(1.0)), F.coalesce("__day_only", F.lit(1.0))))
    return joined.select(*keep, *[F.col(f"__p.{a}").alias(b) for a, b in zip(("form", "layout", "posterior", "ambiguous"), OUTPUT)])
