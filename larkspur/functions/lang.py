"""Rule-based language columns: script shares, simple and Latin detectors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Scripts by code-point range, in order of precedence.
SCRIPTS = {
    "hangul": r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}", "hiragana": r"\x{3040}-\x{309F}", "katakana": r"\x{30A0}-\x{30FF}", "han": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}",
    "cyrillic": r"\x{0400}-\x{04FF}", "arabic": r"\x{0600}-\x{06FF}", "thai": r"\x{0E00}-\x{0E7F}", "devanagari": r"\x{0900}-\x{097F}", "greek": r"\x{0370}-\x{03FF}",
    "hebrew": r"\x{0590}-\x{05FF}", "latin": r"A-Za-z\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}",
}
SCRIPT_LANGUAGE = {"hangul": "ko", "hiragana": "ja", "katakana": "ja", "cyrillic": "ru", "arabic": "ar", "thai": "th", "devanagari": "hi", "greek": "el", "hebrew": "he"}
#: common words of Latin-script languages, our own choice; a parameter of :func:`latin_language`
COMMON = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "for", "with", "was"], "de": ["der", "die", "und", "das", "ist", "nicht", "mit", "von", "für", "den"],
    "fr": ["le", "la", "les", "des", "et", "est", "une", "dans", "pour", "que"], "es": ["el", "los", "las", "una", "del", "en", "por", "que", "con", "para"],
    "it": ["il", "che", "di", "non", "per", "della", "sono", "gli", "una", "con"], "pt": ["os", "não", "uma", "com", "para", "dos", "que", "mais", "por", "em"],
    "nl": ["het", "een", "van", "niet", "voor", "dat", "met", "zijn", "op", "aan"],
}
# Letter triples of Latin-script languages with their weights.
TRIGRAMS = {
    "en": {"the": 15, "ing": 10, "ght": 8, "tha": 7, "nth": 6, "thi": 6, "ith": 6, "fth": 5, "his": 5, "whi": 5, "whe": 5, "hin": 5, "hat": 5, "ome": 4, "ble": 4, "eve": 4, "nce": 4, "ake": 4},
    "de": {"sch": 15, "ich": 12, "ein": 10, "und": 10, "der": 9, "die": 9, "ung": 8, "cht": 8, "den": 7, "ber": 7, "eit": 7, "auf": 6, "aus": 6, "mit": 6, "das": 6, "ist": 6, "gen": 5, "nen": 5, "ern": 5, "ach": 5},
    "fr": {"ait": 12, "eux": 10, "ais": 9, "ous": 9, "oir": 8, "eau": 8, "lle": 7, "que": 7, "tre": 7, "our": 6, "eur": 6, "aux": 6, "ent": 6, "pas": 6, "ien": 5, "eme": 5, "omm": 5, "est": 5, "sse": 5, "rai": 5},
    "es": {"ado": 12, "ión": 10, "los": 9, "las": 9, "nte": 8, "aci": 8, "que": 7, "ndo": 7, "sta": 6, "ent": 6, "tra": 6, "una": 5, "ara": 5, "era": 5, "ido": 5},
    "pt": {"ção": 15, "ões": 12, "ndo": 8, "ado": 8, "nte": 7, "que": 7, "uma": 6, "ara": 6, "dos": 6, "das": 6, "por": 5, "com": 5, "ser": 5, "ais": 5, "ica": 5},
    "it": {"zio": 15, "gli": 12, "tti": 10, "ell": 9, "lla": 8, "ato": 8, "che": 7, "one": 7, "ita": 6, "ere": 6, "nti": 6, "ess": 5, "per": 5, "ono": 5, "ano": 5},
    "nl": {"aar": 12, "oor": 10, "een": 9, "het": 9, "van": 8, "ijn": 8, "erd": 7, "aan": 7, "wor": 6, "cht": 6, "eer": 6, "ond": 5, "gel": 5, "ste": 5, "oel": 5},
}
# Letters of which two tell a language, in this order.
DIACRITICS = {"vi": "ăâđêôơưảạấầẩẫậắằẳẵặảẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữự", "tr": "ğışçöüİ", "pl": "ąćęłńśźż", "sv": "åäö"}
# Certainty of a Latin-script language told by its letters, by a high score, and by a low one.
LETTERS_SURE, SCORE_SURE, SCORE_UNSURE = {"vi": 0.9, "tr": 0.8, "pl": 0.8, "sv": 0.8}, 0.85, 0.7
HIGH_SCORE, LEAST_SURE = 10, 0.3


@lru_cache(maxsize=1)
def _script_table() -> np.ndarray:
    """The place in SCRIPTS of every code point, 255 for none."""
    table = np.full(0x110000, 255, np.uint8)
    for i, ranges in reversed(list(enumerate(SCRIPTS.values()))):
        for low, high in re.findall(r"(\\x\{[0-9A-F]+\}|\w)-(\\x\{[0-9A-F]+\}|\w)", ranges):
            first, last = (int(x[3:-1], 16) if len(x) > 1 else ord(x) for x in (low, high))
            table[first : last + 1] = i
    return table


def _code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a batch in a row, each with the place of its text; texts are parted by a line break."""
    joined = "\n".join(t or "" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t or "") + 1 for t in texts])
    return points, np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))[: len(points)]


def _script_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Letters of each script: one look-up a code point for a whole batch, some twenty times faster than a pattern for each script."""
    n = len(SCRIPTS)
    for texts in batches:
        points, owner = _code_points(texts.to_pylist())
        script = _script_table()[points]
        hit = script < n
        counts = np.bincount(owner[hit].astype(np.int64) * n + script[hit], minlength=len(texts) * n).astype(np.int32)
        yield pa.FixedSizeListArray.from_arrays(pa.array(counts), n).cast(pa.list_(pa.int32()))


def _triple_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The weights of each language's triples that stand in a text, overlapping, summed."""
    known = sorted({g for v in TRIGRAMS.values() for g in v}, key=lambda g: [ord(c) for c in g])
    keys = np.array([(ord(g[0]) << 42) | (ord(g[1]) << 21) | ord(g[2]) for g in known], np.int64)
    weights = np.array([[TRIGRAMS[k].get(g, 0) for k in TRIGRAMS] for g in known], np.int64)
    n = len(TRIGRAMS)
    for texts in batches:
        points, owner = _code_points(texts.to_pylist())
        p = points.astype(np.int64)
        sums = np.zeros((len(texts), n), np.int64)
        if len(p) > 2:
            triple = (p[:-2] << 42) | (p[1:-1] << 21) | p[2:]  # the parting line breaks are in no known triple
            at = np.minimum(np.searchsorted(keys, triple), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == triple)
            np.add.at(sums, owner[hit], weights[at[hit]])
        yield pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel().astype(np.int32)), n).cast(pa.list_(pa.int32()))


def _script_counts(text: Column) -> Column:
    return F.arrow_udf(_script_batches, "array<int>")(text)


def _triple_scores(low: Column) -> Column:
    return F.arrow_udf(_triple_batches, "array<int>")(low)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _counts(text: Column) -> Column:
    return _let(_script_counts(text), lambda n: F.struct(*[n[i].alias(k) for i, k in enumerate(SCRIPTS)]))


def _dominant(n: Column) -> Column:
    most = F.greatest(*[n[k] for k in SCRIPTS])
    out = None
    for k in SCRIPTS:
        hit = (n[k] == most) & (most > 0)
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out


def dominant_script(text: Column) -> Column:
    """The script of most letters; the earlier in SCRIPTS on ties; null if none."""
    return _let(_counts(text), _dominant)


def _latin_parts(text: Column) -> Column:
    """What the Latin-script languages are told by: the text in lower case, the weights of its triples, its words."""
    low = F.lower(text)
    return F.struct(low.alias("low"), _triple_scores(low).alias("sums"), F.array_distinct(F.regexp_extract_all(low, F.lit(r"\p{L}+"), F.lit(0))).alias("found"))


def _latin(parts: Column, share: Column, common: dict[str, list[str]]) -> Column:
    """(language, confidence): letters of vi, tr, pl, sv first, else the best score - common words
    that occur, 3 each, and the weights of triples; English unless another scores higher, the earlier in TRIGRAMS on ties."""
    names = list(TRIGRAMS)
    scores = F.struct(*[(F.size(F.array_intersect(parts["found"], F.array(*[F.lit(w) for w in common[k]]))) * 3 + parts["sums"][i]).alias(k) for i, k in enumerate(names)])

    def best(n: Column) -> Column:
        most = F.greatest(*[n[k] for k in names])
        out = F.when(n["en"] == most, "en")
        for k in names:
            out = out.when(n[k] == most, k)
        return F.struct(out.alias("language"), (share * F.when(most > HIGH_SCORE, SCORE_SURE).otherwise(SCORE_UNSURE)).alias("confidence"))

    out, low = None, parts["low"]
    for k, chars in DIACRITICS.items():
        hit, value = F.length(low) - F.length(F.translate(low, chars, "")) >= 2, F.struct(F.lit(k).alias("language"), (share * LETTERS_SURE[k]).alias("confidence"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(_let(scores, best))


def latin_language(text: Column, common: dict[str, list[str]] = COMMON) -> Column:
    """The language of a text in Latin letters."""
    return _let(_latin_parts(text), lambda parts: _latin(parts, F.lit(1.0), common))["language"]


def language_result(text: Column, common: dict[str, list[str]] = COMMON) -> Column:
    """(language, confidence, script) by the dominant script, its share of the letters being the confidence;
    Han with more than 5 % kana is Japanese; Latin is told by letters, words and triples; under three bytes unknown with 0."""

    def judge(x: Column) -> Column:
        n, script = x["n"], x["script"]
        total = sum((n[k] for k in SCRIPTS), F.lit(0))
        share = sum((F.when(script == k, n[k]).otherwise(0) for k in SCRIPTS), F.lit(0)) / total
        of = lambda language: F.struct(language.alias("language"), share.alias("confidence"), script.alias("script"))
        out = F.when((x["bytes"] < 3) | script.isNull(), F.struct(F.lit("unknown").alias("language"), F.lit(0.0).alias("confidence"), script.alias("script")))
        out = out.when(script == "han", of(F.when(n["hiragana"] + n["katakana"] > 0.05 * total, "ja").otherwise("zh")))
        for k, language in SCRIPT_LANGUAGE.items():
            out = out.when(script == k, of(F.lit(language)))
        return out.otherwise(_let(_latin(x["latin"], share, common), lambda r: F.struct(r["language"].alias("language"), r["confidence"].alias("confidence"), script.alias("script"))))

    parts = F.struct(_counts(text).alias("n"), F.octet_length(text).alias("bytes"), _latin_parts(text).alias("latin"))
    return _let(parts, lambda p: _let(F.struct(p["n"].alias("n"), _dominant(p["n"]).alias("script"), p["bytes"].alias("bytes"), p["latin"].alias("latin")), judge))


def detect(text: Column) -> Column:
    """The language of :func:`language_result`, or unknown under the least confidence."""
    return _let(language_result(text), lambda r: F.when(r["confidence"] < LEAST_SURE, "unknown").otherwise(r["language"]))


def script_language(text: Column) -> Column:
    """Language by dominant script, latin for Latin letters; under 3 bytes unknown."""

    def judge(both: Column) -> Column:
        n, script = both["n"], both["script"]
        total = sum((n[k] for k in SCRIPTS), F.lit(0))
        out = F.when((F.octet_length(text) < 3) | script.isNull(), "unknown").when(script == "han", F.when(n["hiragana"] + n["katakana"] > 0.05 * total, "ja").otherwise("zh"))
        for k, lang in SCRIPT_LANGUAGE.items():
            out = out.when(script == k, lang)
        return out.otherwise("latin")

    return _let(_let(_counts(text), lambda n: F.struct(n.alias("n"), _dominant(n).alias("script"))), judge)


def simple_language(text: Column) -> Column:
    """By the presence of runs of at least three characters of a script."""
    return F.when(text.rlike(r"[\x{AC00}-\x{D7A3}]{3,}"), "ko").when(text.rlike(r"[\x{3040}-\x{30FF}]{3,}"), "ja").when(text.rlike(r"[\x{4E00}-\x{9FFF}]{3,}"), "zh").when(text.rlike(r"[\x{0400}-\x{04FF}]{3,}"), "ru").otherwise("en")


def languages_by_share(text: Column, least: float = 0.05, most: int = 5) -> Column:
    """Scripts of at least ``least`` of the letters, by share, as "script:percent"."""

    def shares(n: Column) -> Column:
        total = F.greatest(sum((n[k] for k in SCRIPTS), F.lit(0)), F.lit(1))
        rows = F.array(*[F.struct((-F.floor(n[k] * 100 / total)).alias("p"), F.lit(k).alias("k")) for k in SCRIPTS])
        kept = F.filter(rows, lambda r: r["p"] <= -int(least * 100))
        return F.array_join(F.transform(F.slice(F.array_sort(kept), 1, most), lambda r: F.concat(r["k"], F.lit(":"), (-r["p"]).cast("string"))), ",")

    return _let(_counts(text), shares)
