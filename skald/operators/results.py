"""Result pages in the layout of each kind of search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skald.functions.html import snippet_plain, unescaped
from skald.operators import search
from skald.operators.highlight import highlighted

#: Results a page.
SIZES = {"images": 30}


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def web_results(page: DataFrame, query: str, plain: bool = False) -> DataFrame:
    """Titles as text, snippets marked and as text; ``snippet`` is the plain one for news."""
    marked = page.select("*", highlighted(_text("snippet"), query).alias("snippetHtml"))
    both = marked.withColumn("snippetPlain", snippet_plain(F.col("snippetHtml")))
    return both.select(unescaped(_text("title")).alias("title"), "url", F.col("snippetPlain" if plain else "snippetHtml").alias("snippet"), "snippetHtml", "snippetPlain", "source")


def image_results(page: DataFrame) -> DataFrame:
    """An image document keeps its thumbnail as the snippet and the image as the address."""
    return page.select("title", F.col("snippet").alias("thumbnailUrl"), F.col("url").alias("imageUrl"), "source")


def video_results(page: DataFrame) -> DataFrame:
    """A video document keeps its duration as the snippet and its thumbnail as the body."""
    return page.select(unescaped(_text("title")).alias("title"), "url", F.col("snippet").alias("duration"), F.col("body").alias("thumbnailUrl"), "source")


def transport_results(page: DataFrame) -> DataFrame:
    return page.select(unescaped(_text("title")).alias("title"), "url", "snippet", "source", "meta")


def results(found: DataFrame, kind: str, query: str, number: int = 1, sort: str = "relevance", per_source: int = search.PER_SOURCE, docs: DataFrame | None = None) -> DataFrame:
    """Page ``number`` of the ranked and filtered rows ``found``, diversified, in the layout of ``kind``; ``docs`` hold its text."""
    page = search.page_of(search.diversified(found, per_source, sort), number, SIZES.get(kind, search.PAGE), sort)
    if docs is not None:
        page = search.with_documents(page, docs).orderBy(*search.rank_order(sort))
    if kind in ("all", "news"):
        return web_results(page, query, plain=kind == "news")
    return {"images": image_results, "videos": video_results, "transport": transport_results}[kind](page)
