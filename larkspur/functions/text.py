"""Text columns: tokens, keywords, entities, cleaning, quality."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
#: runs of one script, as the trend tokeniser sees them (explicit ranges, equal in Java and RE2)
SCRIPT_RUN = r"[\x{AC00}-\x{D7AF}]+|[\x{3040}-\x{30FF}]+|[\x{4E00}-\x{9FFF}]+|[\x{0400}-\x{04FF}]+|[a-z\x{00DF}-\x{00FF}0-9]+"
# Stop words by language; our own short list.
STOPWORDS = {
    "any": "www http https com org net html rss feed",
    "en": "the a an and or of to in is are was were be been with for from on at by as it its this that these those not no has have had will would can after before under over their his her they them than then who which while when where what why how all some more most other into out up down only own same so too very just also",
    "de": "der die das und ist nicht mit von für ein eine auf den dem zu im am",
    "fr": "le la les des et est une un du dans pour sur que avec au aux",
    "es": "el la los las y es una un del en para sobre que con por",
    "ko": "있는 그리고 하는 이 그 및",
    "ja": "する の は を に が で",
    "zh": "的 和 是 在 了",
}


def tokens(text: Column, least_bytes: int = 0) -> Column:
    """Lower-case runs of letters and digits, optionally of at least so many bytes."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: F.octet_length(t) >= least_bytes) if least_bytes else found


def words(text: Column) -> Column:
    """ASCII word runs."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9A-Za-z_]+"), F.lit(0))


def letter_runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))


def stop_set(*langs: str) -> list[str]:
    return sorted({w for k in ("any", "en", *langs) for w in STOPWORDS.get(k, "").split()})


def keywords(text: Column, least_bytes: int = 3, stop: list[str] | None = None) -> Column:
    """Trend keywords: script runs of at least ``least_bytes`` bytes that are no stop words."""
    stop = stop_set() if stop is None else stop
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(SCRIPT_RUN), F.lit(0))
    return F.filter(found, lambda t: (F.octet_length(t) >= least_bytes) & ~t.isin(stop))


def entities(text: Column) -> Column:
    """Capitalised phrases, then acronyms of 2 to 5 letters; repeats are kept."""
    t = F.coalesce(text, F.lit(""))
    phrases = F.regexp_extract_all(t, F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+)+"), F.lit(0))
    acronyms = F.regexp_extract_all(t, F.lit("(?:^|[^0-9A-Za-z_])([A-Z]{2,5})(?:$|[^0-9A-Za-z_])"), F.lit(1))
    return F.concat(phrases, acronyms)


def letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def is_stopword(word: Column, lang: Column) -> Column:
    """Universal, then of the language, then English; shorter than two characters; digits only."""
    known = F.lower(F.trim(word))
    by_lang = [(k, sorted(v.split())) for k, v in STOPWORDS.items()]
    hit = known.isin(stop_set())
    for k, ws in by_lang:
        if k not in ("any", "en"):
            hit = hit | ((lang == k) & known.isin(ws))
    return hit | (F.length(known) < 2) | known.rlike(r"^\p{Nd}+$")


def nfc_lower(text: Column) -> Column:
    """Trimmed, composed (NFC), lower case."""

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x.strip()).lower())

    return nfc(text)


def fold_distinct(items: Column) -> Column:
    """An array without repeats under trimming and case; first casing and order are kept."""
    keys = F.transform(items, lambda x: F.lower(F.trim(x)))
    return F.filter(items, lambda x, i: F.array_position(keys, F.lower(F.trim(x))) == (i + 1).cast("bigint"))


def clean_keywords(items: Column, lang: Column) -> Column:
    """Without empty items and stop words, without repeats, order and casing kept."""
    return fold_distinct(F.filter(items, lambda x: (F.trim(x) != "") & ~is_stopword(x, lang)))


def merge_keywords(first: Column, then: Column) -> Column:
    return fold_distinct(F.concat(first, then))


def keyword_filter(items: Column, most: int = 100) -> Column:
    """At least two bytes, not all ASCII digits, at most ``most``."""
    return F.slice(F.filter(items, lambda x: (F.octet_length(x) >= 2) & ~x.rlike("^[0-9]+$")), 1, most)


def slug(topic: Column, most_bytes: int = 30) -> Column:
    """A name for a topic: lower case, other characters to hyphens."""
    s = F.regexp_replace(F.lower(topic), r"[^a-z0-9\x{AC00}-\x{D7A3}]+", "-")
    s = F.regexp_replace(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, most_bytes), "-+$", "")
    return F.when(s == "", "vertical").otherwise(s)


def truncate(text: Column, most: int, mark: str = "") -> Column:
    """At most ``most`` characters, with ``mark`` where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def squeeze(text: Column) -> Column:
    """White space runs to one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Zs}]+", " "))


def strip_html(text: Column) -> Column:
    """Without tags and CDATA marks, entities unescaped, white space squeezed."""

    @F.pandas_udf("string")
    def unescape(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else html.unescape(x))

    bare = F.regexp_replace(F.regexp_replace(text, r"<!\[CDATA\[|\]\]>", ""), "<[^>]*>", " ")
    return squeeze(unescape(bare))


def highlight(text: Column, query: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Each hit of a query word, whatever its case, between marks."""
    words = sorted({w.lower() for w in query.split()}, key=lambda w: (-len(w), w))
    # one alternation: a mark that is set cannot be hit again
    return F.regexp_replace(text, "(?i)(" + "|".join(map(re.escape, words)) + ")", f"{before}$1{after}") if words else text


def query_terms(query: str) -> list[str]:
    """The distinct terms of a query, as the index has them."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))


#: Phrases of unwanted posts.
SPAM = ("click here", "buy now", "free money", "limited time", "act now", "call now", "100% free", "no obligation", "work from home", "$$")


def spam_hits(text: Column) -> Column:
    low = F.lower(text)
    return sum((F.when(F.contains(low, F.lit(p)), 1).otherwise(0) for p in SPAM), F.lit(0))


def is_spam(text: Column) -> Column:
    return (F.octet_length(text) < 20) | (spam_hits(text) >= 3)


def text_quality(text: Column) -> Column:
    """1, less 0.3 if short, 0.2 if mostly capitals, 0.4 if spam; never below 0."""
    caps, letters = F.length(F.regexp_replace(text, "[^A-Z]", "")), F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    score = F.lit(1.0) - F.when(F.octet_length(text) < 50, 0.3).otherwise(0.0) - F.when((letters > 0) & (caps > 0.5 * letters), 0.2).otherwise(0.0) - F.when(is_spam(text), 0.4).otherwise(0.0)
    return F.greatest(score, F.lit(0.0))


def contains_folded(items: Column, x: Column) -> Column:
    return F.array_contains(F.transform(items, F.lower), F.lower(x))


def split_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def json_keywords(text: Column) -> Column:
    """Keywords of the JSON object inside a free text, written as a list or as lists by language; flattened, without repeats."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    listed = F.from_json(body, "keywords array<string>")["keywords"]
    by_lang = F.flatten(F.map_values(F.from_json(body, "keywords map<string, array<string>>")["keywords"]))
    return F.array_distinct(F.coalesce(listed, by_lang, F.array().cast("array<string>")))


def worst_state(states: Column) -> Column:
    """The worst of several health states: unhealthy, then degraded, else healthy."""
    return F.when(F.array_contains(states, "unhealthy"), "unhealthy").when(F.array_contains(states, "degraded"), "degraded").otherwise("healthy")
