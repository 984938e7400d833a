"""Fields of raw HTML pages as Column expressions; only joining addresses needs Python."""

from __future__ import annotations

from html import unescape
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skald.functions.text import crawl_host, cut_bytes, doc_id_of, embed_target

# What each pattern takes out of a page.
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
DESCRIPTION = r"(?is)<meta\s+(?:name|property)=[\"']description[\"']\s+content=[\"']([^\"']*)[\"'][^>]*>"
PROPERTY = r"(?is)<meta\s+property=[\"']{0}[\"']\s+content=[\"']([^\"']+)[\"'][^>]*>"
LINK = r"(?is)<a\s+[^>]*href=[\"']([^\"']+)[\"'][^>]*>"
SOURCE_OF = r"(?is)<{0}\s+[^>]*src=[\"']([^\"']+)[\"'][^>]*>"
JSON_LD = r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>([\s\S]*?)</script>"
ELEMENT = r"(?is)<{0}[^>]*>([\s\S]*?)</{0}>"
NOISE = (r"(?s)<!--.*?-->", r"(?is)<script[^>]*>[\s\S]*?</script>", r"(?is)<style[^>]*>[\s\S]*?</style>", r"(?is)<[^>]+>")
LOC = r"(?is)<loc>\s*([^<\s]+)\s*</loc>"


def spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def plain(c: Column) -> Column:
    """Text without comments, scripts, styles and tags, its white space collapsed."""
    for pattern in NOISE:
        c = F.regexp_replace(c, pattern, " ")
    return spaces(c)


def title(html: Column) -> Column:
    return spaces(F.regexp_extract(html, TITLE, 1))


def description(html: Column) -> Column:
    return spaces(F.regexp_extract(html, DESCRIPTION, 1))


def meta_property(html: Column, name: str) -> Column:
    return F.regexp_extract(html, PROPERTY.format(name), 1)


def main_text(html: Column, most: int = 4000) -> Column:
    """The first article, main or body element that has content, else the page; in bytes at most ``most``."""
    picked = F.coalesce(*(F.nullif(F.regexp_extract(html, ELEMENT.format(e), 1), F.lit("")) for e in ("article", "main", "body")), html)
    return cut_bytes(plain(picked), most)


def headings(html: Column, most: int = 2000) -> Column:
    """All first-level headings, then all second-level ones and so on."""
    found = F.flatten(F.array(*(F.regexp_extract_all(html, F.lit(ELEMENT.format(f"h{k}")), 1) for k in range(1, 7))))
    return cut_bytes(F.array_join(F.filter(F.transform(found, plain), lambda x: x != ""), " \n "), most)


def sources_of(html: Column, element: str) -> Column:
    return F.regexp_extract_all(html, F.lit(SOURCE_OF.format(element)), 1)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(LINK), 1)


def html_language(html: Column) -> Column:
    return F.lower(F.regexp_extract(html, r"(?is)<html[^>]*\slang=[\"']([a-zA-Z]{2})", 1))


def sitemap_urls(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(LOC), 1)


def _join(base: str | None, ref: str | None) -> str:
    if not base or ref is None or ref[:5].lower() == "data:":
        return ""
    try:
        full = urljoin(base, ref)
        return full if urlsplit(full).scheme in ("http", "https") else ""
    except ValueError:
        return ""


@F.pandas_udf(StringType())
def absolute_url(base: pd.Series, ref: pd.Series) -> pd.Series:
    """``ref`` resolved against ``base``; empty unless it is http or https."""
    return pd.Series([_join(b, r) for b, r in zip(base, ref, strict=True)])


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unescape(t))


def snippet_plain(marked: Column) -> Column:
    return unescaped(F.regexp_replace(marked, "</?mark>", ""))


def page_documents(pages: DataFrame, now: str) -> DataFrame:
    """Documents of the web vertical from ``url, html``: one narrow projection, no shuffle."""
    html = F.coalesce(F.col("html"), F.lit(""))
    got = pages.select("url", html.alias("html")).select("url", title(F.col("html")).alias("title"), description(F.col("html")).alias("snippet"), main_text(F.col("html")).alias("body"), headings(F.col("html")).alias("headings"), html_language(F.col("html")).alias("lang"))
    filled = got.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "url"))
    return filled.select(doc_id_of(F.col("url")).alias("id"), "title", F.col("url"), F.coalesce(F.nullif("snippet", F.lit("")), "title").alias("snippet"), "body", "headings", crawl_host(F.col("url")).alias("source"), F.lit(now).alias("date"), "lang")


def page_media(pages: DataFrame, now: str) -> DataFrame:
    """Image, video and news records of pages: ``kind, id, title, url, thumb, source, date``."""
    html = F.coalesce(F.col("html"), F.lit(""))
    own = title(html)
    base = pages.select("url", html.alias("html"), F.coalesce(F.nullif(own, F.lit("")), F.col("url")).alias("title"))
    found = []
    for kind, element in (("image", "img"), ("video", "video"), ("video", "source"), ("embed", "iframe")):
        found.append(base.select("url", "title", F.lit(kind).alias("kind"), F.explode(sources_of(F.col("html"), element)).alias("ref")))
    for kind, name in (("image", "og:image"), ("video", "og:video")):
        found.append(base.select("url", "title", F.lit(kind).alias("kind"), meta_property(F.col("html"), name).alias("ref")).where("ref <> ''"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    rows = rows.withColumn("at", absolute_url("url", "ref")).where("at <> ''")
    watch, thumb = embed_target(F.col("at"))
    rows = rows.withColumn("watch", F.when(F.col("kind") == "embed", watch).otherwise(F.col("at"))).withColumn("thumb", F.when(F.col("kind") == "embed", thumb).when(F.col("kind") == "image", F.col("at")).otherwise("")).where("watch <> ''")
    media = rows.select(F.when(F.col("kind") == "embed", "video").otherwise(F.col("kind")).alias("kind"), doc_id_of(F.col("watch")).alias("id"), "title", F.col("watch").alias("url"), "thumb", crawl_host(F.col("watch")).alias("source"), F.lit(now).alias("date"))
    published = meta_property(F.col("html"), "article:published_time")
    news = base.where(F.lower(meta_property(F.col("html"), "og:type")) == "article").select(F.lit("news").alias("kind"), doc_id_of(F.col("url")).alias("id"), "title", "url", F.lit("").alias("thumb"), crawl_host(F.col("url")).alias("source"), F.coalesce(F.nullif(published, F.lit("")), F.lit(now)).alias("date"))
    scripts = base.select(F.explode(F.regexp_extract_all(F.col("html"), F.lit(JSON_LD), 1)).alias("script"))
    videos = json_ld_videos(scripts, "script", now).select(F.lit("video").alias("kind"), "id", "title", "url", "thumb", "source", "date")
    return media.unionByName(news).unionByName(videos)


def json_ld_videos(raw: DataFrame, column: str, now: str) -> DataFrame:
    """Video records of JSON-LD texts: an array or a single object, union types flattened."""
    v = F.try_parse_json(F.trim(column))
    rows = raw.select(v.alias("v")).where("v is not null")
    kind = F.schema_of_variant("v")
    items = rows.select(F.explode(F.when(kind.startswith("ARRAY"), F.expr("try_cast(v as array<variant>)")).otherwise(F.array("v"))).alias("v"))

    def text(path: str) -> Column:
        return F.trim(F.coalesce(F.try_variant_get("v", path, "string"), F.lit("")))

    types = F.coalesce(F.expr("try_variant_get(v, '$[\"@type\"]', 'array<string>')"), F.array(F.expr("try_variant_get(v, '$[\"@type\"]', 'string')")))
    items = items.where(F.exists(types, lambda t: F.lower(F.trim(t)) == "videoobject"))
    thumbs = F.coalesce(F.expr("try_variant_get(v, '$.thumbnailUrl', 'array<string>')"), F.array(text("$.thumbnailUrl")))
    first = F.coalesce(F.get(F.filter(thumbs, lambda t: t != ""), F.lit(0)), F.lit(""))
    got = items.select(text("$.name").alias("title"), F.coalesce(F.nullif(text("$.contentUrl"), F.lit("")), text("$.embedUrl")).alias("at"), first.alias("own"), F.coalesce(F.nullif(text("$.uploadDate"), F.lit("")), F.nullif(text("$.datePublished"), F.lit("")), F.lit(now)).alias("date")).where("at <> ''")
    watch, thumb = embed_target(F.col("at"))
    placed = got.withColumn("watch", watch).withColumn("thumb", F.coalesce(F.nullif(thumb, F.lit("")), F.col("own")))
    placed = placed.withColumn("url", F.coalesce(F.nullif("watch", F.lit("")), F.col("at")))
    return placed.select(doc_id_of(F.col("url")).alias("id"), "title", "url", "thumb", crawl_host(F.col("url")).alias("source"), "date")
