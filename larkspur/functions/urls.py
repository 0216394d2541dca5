"""URL columns: host, country, language, normal form, classes, video ids."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Countries told by the last label of a domain, which is their code.
COUNTRIES = (
    "kr jp cn tw hk sg my th vn id ph in pk bd uk de fr es it nl be at ch se no dk fi pl cz ru ua pt gr ro hu sk bg hr rs si "
    "us ca mx br ar cl co pe ve ec ae sa il tr eg za ng ke au nz"
).split()
# Last labels that tell no country.
GLOBAL_LABELS = ("com", "org", "net", "io", "ai")
# The first language of a country.
COUNTRY_LANGUAGE = {
    "kr": "ko", "jp": "ja", "cn": "zh", "tw": "zh", "hk": "zh", "vn": "vi", "th": "th", "id": "id", "my": "ms", "de": "de", "at": "de", "ch": "de", "fr": "fr", "be": "fr",
    "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "pe": "es", "ve": "es", "ec": "es", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "ru": "ru", "ua": "uk", "pl": "pl", "cz": "cs", "sk": "sk",
    "se": "sv", "no": "no", "dk": "da", "fi": "fi", "gr": "el", "tr": "tr", "ro": "ro", "hu": "hu", "bg": "bg", "hr": "hr", "rs": "sr", "si": "sl", "in": "hi", "pk": "ur", "bd": "bn",
    "ae": "ar", "sa": "ar", "eg": "ar", "il": "he", "us": "en", "uk": "en", "ca": "en", "au": "en", "nz": "en", "sg": "en", "ph": "en", "ng": "en", "ke": "en", "za": "en", "global": "en",
}
# Words of an address that tell what a feed is about, the first category that has one.
CATEGORY_WORDS = {
    "news": "news noticias nachrichten actualite nyheter nyhet nieuws wiadomosci zpravy noviny novosti 뉴스 ニュース 新闻".split(),
    "tech": "tech technology digital cyber software hardware gadget geek nerd coding developer programming ai ml cloud startup テック 科技 테크 tecnologia".split(),
    "finance": "finance finanz financial money investment invest stock market economy economic business bank trading crypto bitcoin 経済 财经 금융 경제".split(),
    "sports": "sport sports football soccer basketball baseball tennis golf nfl nba mlb espn スポーツ 体育 스포츠".split(),
    "entertainment": "entertainment movie film music celebrity tv television drama anime manga game gaming エンタメ 娱乐 연예".split(),
    "science": "science research scientific nature biology physics chemistry space nasa 科学 과학".split(),
    "health": "health medical medicine doctor hospital wellness fitness diet nutrition 健康 건강".split(),
    "politics": "politics political government election vote congress parliament minister president 政治 정치".split(),
    "blog": "blog wordpress blogger medium substack tumblr tistory naver.com/blog note.com".split(),
    "youtube": "youtube.com youtu.be".split(),
}
# Hosts of many small authors.
PLATFORMS = ("wordpress.com", "blogspot.com", "blogger.com", "medium.com", "substack.com", "tumblr.com", "tistory.com", "note.com")


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def host(url: Column) -> Column:
    """Host with its port, without user, lower case."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), r"^[^@]*@", ""))


def bare_domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def country(domain: Column) -> Column:
    """Country of a domain by its last label; global for a label of no country, unknown for any other or none.

    A label before the last (co.kr, com.br) never changes the country."""
    labels = F.split(F.lower(F.regexp_replace(domain, r":\d+$", "")), r"\.")
    last = F.try_element_at(labels, F.lit(-1))
    return F.when(F.size(labels) < 2, "unknown").when(last.isin(*COUNTRIES), last).when(last.isin(*GLOBAL_LABELS), "global").otherwise("unknown")


def country_language(code: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(COUNTRY_LANGUAGE), code), F.lit("unknown"))


def normal_url(url: Column) -> Column:
    """Lower case without scheme, www. and one final slash."""
    u = F.regexp_replace(F.lower(url), "/$", "")
    return F.regexp_replace(F.regexp_replace(u, "^https?://", ""), r"^www\.", "")


def category(text: Column) -> Column:
    """The first category of CATEGORY_WORDS of which a word occurs, else other."""
    low = F.lower(text)
    out = None
    for name, words in CATEGORY_WORDS.items():
        hit = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def domain_quality(domain: Column, premium: tuple[str, ...] = ()) -> Column:
    """premium (the domain or one it ends with), blog (a platform), else standard."""
    top = F.lit(False)
    for p in premium:
        top = top | (domain == p) | F.endswith(domain, F.lit("." + p))
    blog = F.lit(False)
    for p in PLATFORMS:
        blog = blog | F.contains(domain, F.lit(p))
    return F.when(top, "premium").when(blog, "blog").otherwise("standard")


def guess_rss(url: Column) -> Column:
    """The feed of a site, by its platform."""
    u = F.regexp_replace(url, "/$", "")
    site = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    on = lambda name: F.contains(F.lower(site), F.lit(name))
    return (
        F.when(on("blogspot.com"), F.concat(site, F.lit("/feeds/posts/default")))
        .when(on("medium.com"), F.regexp_replace(u, r"^(https?://(?:www\.)?medium\.com)/", "$1/feed/"))
        .when(on("substack.com"), F.concat(site, F.lit("/feed")))
        .when(on("wordpress.com"), F.concat(u, F.lit("/feed/")))
        .when(on("tistory.com"), F.concat(site, F.lit("/rss")))
        .when(on("blog.naver.com"), F.concat(F.lit("https://rss.blog.naver.com/"), F.regexp_extract(url, r"blog\.naver\.com/([^/?#]+)", 1), F.lit(".xml")))
        .when(on("ghost.io"), F.concat(u, F.lit("/rss/")))
        .otherwise(F.concat(u, F.lit("/feed")))
    )


def video_kind(url: Column) -> Column:
    """kind:id of a video, channel, user, handle or playlist link; null if none."""
    video = F.regexp_extract(url, r"(?:youtu\.be/|[?&]v=|/embed/|/shorts/)([A-Za-z0-9_-]{11})(?:$|[^A-Za-z0-9_-])", 1)
    channel = F.regexp_extract(url, "/channel/(UC[A-Za-z0-9_-]{22})", 1)
    playlist = F.regexp_extract(url, "[?&]list=([A-Za-z0-9_-]+)", 1)
    user, handle, custom = F.regexp_extract(url, "/user/([A-Za-z0-9_-]+)", 1), F.regexp_extract(url, "/@([A-Za-z0-9_.-]+)", 1), F.regexp_extract(url, "/c/([A-Za-z0-9_.%-]+)", 1)
    tube = url.rlike(r"(?i)youtube\.com|youtu\.be")
    out = None
    for kind, found in (("video", video), ("channel", channel), ("playlist", playlist), ("user", user), ("handle", handle), ("custom", custom)):
        hit = F.concat(F.lit(kind + ":"), found)
        out = F.when(tube & (found != ""), hit) if out is None else out.when(tube & (found != ""), hit)
    return out


def is_video_id(text: Column) -> Column:
    return text.rlike("^[A-Za-z0-9_-]{11}$")


def is_channel_id(text: Column) -> Column:
    return text.rlike("^UC[A-Za-z0-9_-]{22}$")


def video_thumbnail(ident: Column) -> Column:
    return F.concat(F.lit("https://img.youtube.com/vi/"), ident, F.lit("/hqdefault.jpg"))


def video_feed(kind: Column, ident: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/feeds/videos.xml?"), F.when(kind == "playlist", "playlist_id=").when(kind == "user", "user=").otherwise("channel_id="), ident)


def resolve(base: Column, href: Column) -> Column:
    """An absolute URL of a link."""

    @F.pandas_udf("string")
    def join(b: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([None if y is None else urljoin(x or "", y) for x, y in zip(b, h)])

    return join(base, href)


def looks_like_feed(url: Column) -> Column:
    return url.rlike(r"(?i)(rss|feed|atom|\.xml)") & ~url.rlike(r"(?i)(comment|feedback)")


# Names of publishers by a part of their address, in this order.
PUBLISHERS = {
    "en": {"korea.kr": "Government Policy", "youtube": "YouTube", "yna.co.kr": "Yonhap News", "hani.co.kr": "Hankyoreh", "khan.co.kr": "Kyunghyang", "chosun": "Chosun Ilbo", "donga": "Donga Ilbo", "joongang": "JoongAng Ilbo", "": "News"},
    "ko": {"korea.kr": "정책브리핑", "youtube": "유튜브", "yna.co.kr": "연합뉴스", "hani.co.kr": "한겨레", "khan.co.kr": "경향신문", "chosun": "조선일보", "donga": "동아일보", "joongang": "중앙일보", "": "뉴스"},
}


def source_name(url: Column, feed_name: Column, language: str = "en") -> Column:
    """The name of who published an address; a video is named by its feed, if that has a name."""
    out = None
    for part, name in PUBLISHERS[language].items():
        value = F.coalesce(F.nullif(feed_name, F.lit("")), F.lit(name)) if part == "youtube" else F.lit(name)
        hit = F.contains(url, F.lit(part))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(PUBLISHERS[language][""])
