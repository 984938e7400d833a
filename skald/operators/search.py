"""Ranked search: candidates, TF-IDF, boosts, filters, facets, diversification, pages."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skald.functions.text import parse_date
from skald.operators import index
from skald.operators.expand import expand
from skald.operators.query import Parsed, parse, tokens

# Field weights, hits kept, hits of a source, hits on a page.
WEIGHTS = {"title": 2.0, "snippet": 1.0, "body": 0.7, "url": 1.2, "headings": 1.4}
CAP, PER_SOURCE, PAGE = 10_000, 3, 10


@dataclass
class Settings:
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    priors: dict[str, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    prefix: bool = True
    fuzzy: bool = True
    least_prefix: int = 2
    per_source: int = PER_SOURCE
    cap: int | None = CAP


def whole_text(docs_alias: str = "") -> Column:
    return F.lower(F.concat_ws(" ", *(F.coalesce(F.col(f"{docs_alias}{c}"), F.lit("")) for c in ("title", "snippet", "body", "url", "headings"))))


def prior(source: Column, priors: dict[str, float]) -> Column:
    """The largest multiplier whose suffix matches, at least 1: a few rules, folded into one expression."""
    rules = [F.when(F.lower(source).endswith(k.strip().lower()), F.lit(float(v))).otherwise(1.0) for k, v in priors.items() if k.strip() and v > 0]
    return F.greatest(F.lit(1.0), F.lit(1.0), *rules)


#: Variants up to which a query's tokens are pushed to the scan as literals and its variants are broadcast.
MOST_VARIANTS = 10_000


def variants_of(idx: index.Index, asked: list[str], settings: Settings) -> tuple[DataFrame, list[str] | None]:
    """``q_token, token, mult, df`` of the variants that documents have, and their tokens unless they are too many to push down."""
    spark = idx.vocabulary.sparkSession
    found = expand(idx.vocabulary, asked, settings.synonyms, settings.prefix, settings.fuzzy, settings.least_prefix)
    known = found.join(idx.vocabulary, "token").select("q_token", "token", "mult", "df")
    some = known.limit(MOST_VARIANTS + 1).collect()
    if len(some) > MOST_VARIANTS:
        return known, None
    rows = spark.createDataFrame(some, "q_token string, token string, mult double, df long")
    return F.broadcast(rows), sorted({r.token for r in some})


def candidates(docs: DataFrame, hits: DataFrame, q: Parsed) -> DataFrame:
    """Ids of the documents that a query without required and optional tokens asks for: all without a negated token's variant in title or snippet."""
    return docs.select("id").distinct().join(hits.where(F.col("head") & F.col("q_token").isin(q.negated)).select("id"), "id", "left_anti")


def scores(docs: DataFrame, q: Parsed, settings: Settings, idx: index.Index | None = None) -> DataFrame:
    """``id, score`` of every document that scores.

    One aggregation per document decides whether it is a candidate (every required token's variant,
    or any optional one's, and no negated one's, in title or snippet) and adds up its weights."""
    idx = idx or index.Index.of(docs)
    asked = sorted({*q.required, *q.optional, *q.negated, *q.scored})
    variants, pushed = variants_of(idx, asked, settings)
    rows = idx.entries if pushed is None else idx.entries.where(F.col("token").isin(pushed))
    weight = sum((F.col(f"tf_{f}") * F.lit(settings.weights[f]) for f in index.FIELDS), F.lit(0.0))
    idf = F.log(1 + F.lit(idx.total) / (1 + F.col("df")))
    head = (F.col("tf_title") > 0) | (F.col("tf_snippet") > 0)
    hits = rows.join(variants, "token").select("id", "q_token", head.alias("head"), (weight * idf * F.col("mult")).alias("w"))
    needed = q.required or q.optional
    has = F.collect_set(F.when(F.col("head"), F.col("q_token"))).alias("has")
    # Sums run over the sorted weights, so that a document's score never depends on task order.
    ws = F.array_sort(F.collect_list(F.when(F.col("q_token").isin(q.scored), F.col("w")))).alias("ws")
    each = hits.groupBy("id").agg(has, ws)
    if needed:
        every = q.required or [None]
        wanted = F.arrays_overlap("has", F.array(*map(F.lit, needed)))
        if q.required:
            wanted = reduce(Column.__and__, (F.array_contains("has", t) for t in every))
        each = each.where(wanted)
    if q.negated:
        each = each.where(~F.arrays_overlap("has", F.array(*map(F.lit, q.negated))))
    sums = each.where(F.size("ws") > 0).select("id", F.aggregate("ws", F.lit(0.0), lambda a, x: a + x).alias("s"), F.aggregate("ws", F.lit(0.0), lambda a, x: a + x * x).alias("n"))
    boost = boosts(docs, each.select("id") if needed else candidates(docs, hits, q), q, idx)
    both = sums if boost is None else sums.join(boost, "id", "full_outer")
    b = F.coalesce("boost", F.lit(0.0)) if boost is not None else F.lit(0.0)
    s, n = F.coalesce("s", F.lit(0.0)) + b, F.coalesce("n", F.lit(0.0))
    return both.select("id", F.when(n > 0, s / F.sqrt(n)).otherwise(s).alias("score"))


def phrase_hits(idx: index.Index, words: list[str]) -> DataFrame:
    """Ids of the documents that have ``words`` at consecutive positions of one field."""
    rows = idx.entries.where(F.col("token").isin(words)).select("id", "token", "places")
    each = rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("token", "places"))).alias("at"))
    places = lambda w: F.coalesce(F.element_at("at", F.lit(w)), F.array().cast("array<int>"))
    follows = lambda p: reduce(Column.__and__, (F.array_contains(places(w), p + i) for i, w in enumerate(words) if i), F.lit(True))
    return each.where(F.exists(places(words[0]), follows)).select("id")


def boosts(docs: DataFrame, found: DataFrame, q: Parsed, idx: index.Index) -> DataFrame | None:
    """``id, boost`` of phrases and travel intents, over the candidates ``found`` only."""
    parts: list[Column] = []
    rows = docs.join(found, "id", "left_semi")
    for n, phrase in enumerate(p for p in q.phrases if tokens(p)):
        exact = phrase_hits(idx, tokens(phrase)).withColumn(f"_phrase{n}", F.lit(True))
        rows = rows.join(exact, "id", "left")
        parts.append(F.when(F.col(f"_phrase{n}"), 2.0).when(F.contains(whole_text(), F.lit(phrase.lower())), 0.5).otherwise(0.0))
    for some, every, value in q.intents:
        text = whole_text()
        any_of = F.lit(False)
        for word in some:
            any_of |= F.contains(text, F.lit(word))
        for word in every:
            any_of &= F.contains(text, F.lit(word))
        parts.append(F.when(any_of, value).otherwise(0.0))
    if not parts:
        return None
    return rows.select("id", sum(parts, F.lit(0.0)).alias("boost")).where("boost > 0")


def rank_order(sort: str = "relevance") -> list[Column]:
    base = [F.round("score", 9).desc(), F.col("id"), F.col("url")]
    return [F.col("date_ts").desc_nulls_last(), *base] if sort == "latest" else base


#: What filters, facets and order need; everything else of a document is fetched for a page.
NARROW = ("url", "source", "lang", "date", "meta")


def search(docs: DataFrame, text: str, settings: Settings | None = None, idx: index.Index | None = None) -> DataFrame:
    """``id, score``, the narrow columns and ``date_ts`` of the documents found, at most ``settings.cap`` of them."""
    settings = settings or Settings()
    narrow = docs.select("id", *(c for c in NARROW if c in docs.columns))
    found = scores(docs, parse(text), settings, idx).join(narrow, "id")
    found = found.withColumn("score", F.col("score") * prior(F.col("source"), settings.priors)).withColumn("date_ts", parse_date(F.col("date")))
    return found.orderBy(*rank_order()).limit(settings.cap) if settings.cap else found


def with_documents(page: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of a page with all columns of their documents."""
    return page.join(docs.select("id", *(c for c in docs.columns if c not in page.columns)), "id")


def filtered(results: DataFrame, source: str = "", lang: str = "", from_: str = "", to: str = "", meta: dict[str, str] | None = None) -> DataFrame:
    """Source, language, date range (undated rows pass, unreadable bounds don't bind) and transport fields."""
    if source:
        results = results.where(F.col("source") == source)
    if lang:
        results = results.where(F.lower(F.trim("lang")) == lang.strip().lower())
    for bound, test in ((from_, lambda d, b: d >= b), (to, lambda d, b: d <= b)):
        if bound.strip():
            b = parse_date(F.lit(bound))
            results = results.where(b.isNull() | F.col("date_ts").isNull() | test(F.col("date_ts"), b))
    for key, value in (meta or {}).items():
        value = value.strip()
        if value:
            have = F.coalesce(F.element_at("meta", key), F.lit(""))
            results = results.where(F.lower(have) == value.lower() if key in ("from", "to") else F.contains(have, F.lit(value)))
    return results


def facet(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def language_facet(page: DataFrame) -> DataFrame:
    lang = F.coalesce(F.nullif(F.lower(F.trim("lang")), F.lit("")), F.lit("unknown"))
    return page.groupBy(lang.alias("lang")).agg(F.count("*").alias("n"))


def diversified(results: DataFrame, per_source: int = PER_SOURCE, sort: str = "relevance") -> DataFrame:
    """The first ``per_source`` rows of each source (0 keeps all): Spark limits groups before the shuffle."""
    if per_source <= 0:
        return results
    order = Window.partitionBy("source").orderBy(*rank_order(sort))
    return results.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_source).drop("_n")


def page_of(results: DataFrame, page: int = 1, size: int = PAGE, sort: str = "relevance") -> DataFrame:
    return results.orderBy(*rank_order(sort)).offset((max(page, 1) - 1) * size).limit(size)


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """``first``, or ``second`` where ``first`` is empty: decided inside the plan."""
    empty = first.limit(1).agg((F.count("*") == 0).alias("_empty"))
    return first.unionByName(second.crossJoin(F.broadcast(empty)).where("_empty").drop("_empty"))
