"""Scalar scores: normalisation, trust, feed quality, tiers, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def logistic(x: Column, middle: float, slope: float) -> Column:
    return 1 / (1 + F.exp(-(x - middle) / slope))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def two_decimals(x: Column) -> Column:
    """Half up, as floor(100 x + 0.5) / 100."""
    return F.floor(x * 100 + 0.5) / 100


# How a source was found, and what that is worth.
FOUND_BONUS = {"feedspot": 0.2, "gov_search": 0.2, "site_discovery": 0.1, "path_discovery": 0.1}
# Where a feed's address comes from, and what that is worth.
PROVENANCE_BONUS = {"html": 0.2, "pattern": 0.15, "sitemap": 0.1}
# Finders whose sources are always of the first tier.
FIRST_TIER_FINDERS = ("gov_search", "openalex", "arxiv", "semantic_scholar")


def _worth(key: Column, values: dict[str, float]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(0.0))


def trust(found_by: Column, items: Column, lang_ok: Column, tier: Column) -> Column:
    """0.5 with additions for how a source was found, its items, a wanted language and its tier (2 if none is set), in 0..1."""
    s = F.lit(0.5) + _worth(found_by, FOUND_BONUS) + F.when(items >= 10, 0.1).when(items >= 5, 0.05).otherwise(0.0) + F.when(lang_ok, 0.1).otherwise(0.0)
    return clamp(s + F.when(tier == 1, 0.15).when(tier == 3, -0.1).otherwise(0.0))


def feed_score(items: Column, title: Column, url: Column, provenance: Column) -> Column:
    """Score of a discovered feed by its items, title, scheme, provenance and the end of its path."""
    return (
        F.when(items >= 10, 0.3).when(items >= 5, 0.2).when(items >= 1, 0.1).otherwise(0.0)
        + F.when(F.coalesce(title, F.lit("")) != "", 0.2).otherwise(0.0)
        + F.when(F.startswith(url, F.lit("https://")), 0.1).otherwise(0.0)
        + _worth(provenance, PROVENANCE_BONUS)
        + F.when(F.lower(url).rlike(r"/(feed|rss)(\.xml)?$"), 0.15).otherwise(0.0)
    )


def tier(found_by: Column, trust_: Column, domain: Column | None = None, feed_type: Column | None = None, authorities: tuple[str, ...] = ()) -> Column:
    """1 for a domain that contains an authority, a scholarly or government finder, an
    API or trust from 0.8 on; 3 for trust under 0.5, or under 0.6 if a path was only guessed; else 2."""
    first = found_by.isin(*FIRST_TIER_FINDERS) | (trust_ >= 0.8)
    for name in authorities if domain is not None else ():
        first = first | F.contains(F.lower(domain), F.lit(name))
    if feed_type is not None:
        first = first | (feed_type == "api")
    return F.when(F.coalesce(first, F.lit(False)), 1).when((trust_ < 0.5) | (F.coalesce(found_by == "path_discovery", F.lit(False)) & (trust_ < 0.6)), 3).otherwise(2)


def tier_adjusted(quality: Column, tier_: Column) -> Column:
    return clamp(quality + F.when(tier_ == 1, 0.2).when(tier_ == 3, -0.1).otherwise(0.0))


def reading_seconds(text: Column, per_minute: int = 150) -> Column:
    """Speaking time by characters."""
    return F.length(text) / per_minute * 60


def parse_date(text: Column) -> Column:
    """The first layout that fits, as a timestamp in the session's zone; a weekday is dropped first."""
    t = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", "")
    layouts = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MMM d, yyyy", "MM/dd/yyyy", "dd.MM.yyyy"]
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(x)) for x in layouts])


def date_in_html(text: Column) -> Column:
    """The first y-m-d with . or - that is a possible date."""
    p = r"(20\d{2})[.-](\d{1,2})[.-](\d{1,2})"
    return F.try_to_date(F.concat_ws("-", F.regexp_extract(text, p, 1), F.regexp_extract(text, p, 2), F.regexp_extract(text, p, 3)), "yyyy-M-d")
