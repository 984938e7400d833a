"""The registered queries of the engine and their DuckDB equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skald.engine import Engine
from skald.functions import html, text
from skald.operators import crawl, expand, index, results, search
from skald.operators.highlight import highlighted
from skald.operators.query import parse
from skald.plans import oracles as sql
from skald.plans.corpora import NOW, indexed, parts, shared_folder, table, trips, vocabulary_of, web
from skald.sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SYNONYMS = {"red": ["blue", "hot"], "thin": ["that", "ring"]}
PRIORS = {"src0": 1.5, "src1": 0.5, "3": 1.2}
#: Query texts over ``documents`` and over ``part``.
TERM, PAIR, PART = "thon", "the thin reand", "cold widget"


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def hits(rows: DataFrame, n: int = 10) -> DataFrame:
    return search.page_of(rows, 1, n).select("id", F.round("score", 6).alias("score"))


def _searching(name: str, docs, docs_sql: str, q: str, boost: str = "0.0", settings: search.Settings | None = None, n: int = 10) -> None:
    QUERIES[name] = lambda spark, sf_dir: hits(search.search(docs(spark, sf_dir), q, settings, indexed(spark, sf_dir, docs.__name__)), n)
    ORACLES[name] = sql.top(sql.search(parse(q), docs_sql, settings, boost), n)


def _phrase(*pairs: tuple[str, str]) -> str:
    cases = (f"CASE WHEN len(list_filter(coalesce(lines, []), lambda x: contains(x, ' {toks} '))) > 0 THEN 2.0 WHEN contains({sql.TEXT}, '{raw.lower()}') THEN 0.5 ELSE 0.0 END" for raw, toks in pairs)
    return " + ".join(cases)


def _intent(some: list[str], every: list[str], value: float) -> str:
    any_of = " OR ".join(f"contains({sql.TEXT}, '{w}')" for w in some)
    all_of = "".join(f" AND contains({sql.TEXT}, '{w}')" for w in every)
    return f"CASE WHEN ({any_of}){all_of} THEN {value} ELSE 0.0 END"


# Searches: one per kind of query text.
_searching("search_single_term", web, sql.WEB, TERM)
_searching("search_and", web, sql.WEB, PAIR)
_searching("search_or", web, sql.WEB, "OR thin reand")
_searching("search_sticky_or", web, sql.WEB, "thin OR reand the")
_searching("search_not_is_optional", web, sql.WEB, "NOT thin reand")
_searching("search_negated", web, sql.WEB, "thin -that")
_searching("search_only_negated", web, sql.WEB, "-thon")
_searching("search_prefix_short", parts, sql.PARTS, "ri")
_searching("search_fuzzy", parts, sql.PARTS, "widgot")
_searching("search_parts_and", parts, sql.PARTS, PART, n=50)
_searching("search_synonyms", parts, sql.PARTS, "red", settings=search.Settings(synonyms=SYNONYMS), n=50)
_searching("domain_prior", web, sql.WEB, TERM, settings=search.Settings(priors=PRIORS), n=50)
_searching("search_phrase", parts, sql.PARTS, '"cold widget"', _phrase(("cold widget", "cold widget")), n=50)
_searching("search_phrase_and_term", parts, sql.PARTS, 'widget "red ring"', _phrase(("red ring", "red ring")), n=50)
_searching("phrase_substring_fallback", parts, sql.PARTS, '"d ri"', _phrase(("d ri", "ri")), n=50)
_searching("search_all_docs", parts, sql.PARTS, '"widget"', _phrase(("widget", "widget")), n=50)
_searching("intent_flights_to", trips, sql.TRIPS, "flights to city", _intent(["flight", "airline", "airfare", "ticket"], ["city"], 1.2), n=50)
_searching("intent_hotels_near", trips, sql.TRIPS, "OR hotels near town", _intent(["hotel", "accommodation", "lodging", "stay"], ["town"], 1.0), n=50)
_searching("intent_flights_from_to", parts, sql.PARTS, "OR red flights from ring to widget", _intent(["flight"], ["ring", "widget"], 1.3))
_searching("intent_lodging", parts, sql.PARTS, "OR red hotel near widget", _intent(["hotel", "accommodation", "lodging", "stay"], ["widget"], 1.0))

_RES = sql.search(parse(TERM), sql.WEB)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Filters, facets and totals count every match, as their SQL does: without the reference's cap.
    return search.search(web(spark, sf_dir), TERM, search.Settings(cap=None), indexed(spark, sf_dir, "web"))


def _on_results(name: str, f, oracle: str) -> None:
    wide = f.__code__.co_argcount == 2  # takes the documents too, to fetch a page's text
    QUERIES[name] = lambda spark, sf_dir: f(_results(spark, sf_dir), web(spark, sf_dir)) if wide else f(_results(spark, sf_dir))
    ORACLES[name] = oracle


_on_results("filter_source", lambda r: hits(search.filtered(r, source="src0"), 30), sql.top(_RES, 30, where="source = 'src0'"))
_on_results("filter_lang", lambda r: hits(search.filtered(r, lang=" EN "), 30), sql.top(_RES, 30, where="lower(trim(lang)) = 'en'"))
_on_results("filter_date_range", lambda r: hits(search.filtered(r, from_="2024-02-01", to="2024-05-31"), 50), sql.top(_RES, 50, where="date_ts IS NULL OR (date_ts >= TIMESTAMP '2024-02-01' AND date_ts <= TIMESTAMP '2024-05-31')"))
_on_results("filter_bad_date", lambda r: hits(search.filtered(r, from_="soon"), 30), sql.top(_RES, 30))
_on_results("facet_source_hits", lambda r: search.facet(r, "source"), f"{_RES} SELECT source, count(*) AS n FROM res GROUP BY source")
_on_results("facet_lang_page", lambda r: search.language_facet(search.page_of(search.diversified(r))), f"{_RES}, p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {sql.ORDER}) AS k FROM res) WHERE k <= 3 ORDER BY {sql.ORDER} LIMIT 10) SELECT coalesce(nullif(lower(trim(lang)), ''), 'unknown') AS lang, count(*) AS n FROM p GROUP BY 1")
_on_results("sort_latest", lambda r: search.page_of(r, 1, 40, "latest").select("id", "date"), f"{_RES} SELECT id, date FROM (SELECT * FROM res ORDER BY {sql.LATEST} LIMIT 40)")
_on_results("diversify_top3", lambda r: hits(search.diversified(r), 100), sql.top(_RES, 100, per_source=3))
_on_results("page_2", lambda r: search.page_of(search.diversified(r), 2).select("id", F.round("score", 6).alias("score")), sql.top(_RES, 10, 10, per_source=3))
_on_results("total_after_diversification", lambda r: search.diversified(r).agg(F.count("*").alias("n")), f"{_RES} SELECT count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY source ORDER BY {sql.ORDER}) AS k FROM res) WHERE k <= 3")
_on_results("escape_html", lambda r, docs: search.with_documents(search.page_of(r), docs).select("id", text.escape_html(F.col("snippet")).alias("escaped")), f"{_RES} SELECT id, replace(replace(replace(replace(replace(snippet, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM (SELECT * FROM res ORDER BY {sql.ORDER} LIMIT 10)")
_on_results("results_videos", lambda r, docs: results.results(r, "videos", TERM, docs=docs), f"{_RES}, p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {sql.ORDER}) AS k FROM res) WHERE k <= 3) SELECT title, url, snippet AS duration, body AS \"thumbnailUrl\", source FROM p ORDER BY {sql.ORDER} LIMIT 10")
_on_results("results_images", lambda r, docs: results.results(r, "images", TERM, docs=docs), f"{_RES}, p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {sql.ORDER}) AS k FROM res) WHERE k <= 3) SELECT title, snippet AS \"thumbnailUrl\", url AS \"imageUrl\", source FROM p ORDER BY {sql.ORDER} LIMIT 30")
for _kind in ("all", "news"):
    QUERIES[f"results_{_kind}"] = lambda spark, sf_dir, kind=_kind: results.results(_results(spark, sf_dir), kind, TERM, docs=web(spark, sf_dir))
QUERIES["highlight"] = lambda spark, sf_dir: search.with_documents(search.page_of(_results(spark, sf_dir)), web(spark, sf_dir)).select("id", highlighted(F.col("snippet"), TERM).alias("marked"))


# Text functions.
def _web_sql(select: str) -> str:
    return f"WITH {sql.WEB} {select}"


@query(_web_sql(f"SELECT id, {sql.norm('body')} AS folded FROM web"))
def normalize_fold(spark, sf_dir):
    return web(spark, sf_dir).select("id", text.normalize(F.col("body")).alias("folded"))


def _token_counts(lang: str, name: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: text.exploded_tokens(web(spark, sf_dir).where(F.col("lang") == lang if lang == "en" else F.col("lang") != "en"), "body", "lang", "id").groupBy("id", "token").agg(F.count("*").alias("tf"), F.min("pos").alias("first_pos"))
    test = "lang = 'en'" if lang == "en" else "lang <> 'en'"
    ORACLES[name] = f"WITH {sql.WEB} SELECT id, token, count(*) AS tf, min(pos) AS first_pos FROM ({sql.tokens(f'(SELECT * FROM web WHERE {test})', 'body', 'body')}) GROUP BY id, token"


_token_counts("en", "tokenize_en")
_token_counts("other", "tokenize_other_lang")


@query(_web_sql(f"SELECT id, pos, token FROM ({sql.tokens('web', 'url', 'url')})"))
def url_tokens(spark, sf_dir):
    return web(spark, sf_dir).select("id", F.posexplode(text.raw_tokens(F.col("url"))).alias("pos", "token"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN length(regexp_replace(t, '[^a-z ]', '', 'g')) >= 20 AND floor(length(regexp_replace(t, '[^\\x00-\\x7f]', '', 'g')) * 100 / length(t)) > 90 AND (contains(t, ' the ') OR contains(t, ' and ') OR contains(t, ' of ') OR contains(t, ' to ')) THEN 'en' ELSE '' END AS lang FROM (SELECT doc_id, lower(trim(text)) AS t FROM documents)")
def detect_language(spark, sf_dir):
    return web(spark, sf_dir).select("id", text.guess_language(F.col("body")).alias("lang"))


@query(_web_sql("SELECT id, CASE WHEN regexp_full_match(date, '\\d{4}-\\d\\d-\\d\\d') THEN strftime(try_cast(date AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ') END AS at FROM web"))
def parse_dates(spark, sf_dir):
    return web(spark, sf_dir).select("id", text.rfc3339(text.parse_date(F.col("date"))).alias("at"))


# The index.
_TOK = f"WITH {sql.WEB}, {sql.all_tokens()}"


@query(f"{_TOK} SELECT field, token, id, CAST(list_sort(list(pos)) AS VARCHAR) AS positions, count(*) AS tf FROM tok GROUP BY field, token, id")
def postings_tf(spark, sf_dir):
    shown = F.concat(F.lit("["), F.array_join(F.col("positions").cast("array<string>"), ", "), F.lit("]"))
    return index.postings(web(spark, sf_dir)).select("field", "token", "id", shown.alias("positions"), "tf")


QUERIES["postings_positions"], ORACLES["postings_positions"] = postings_tf, ORACLES["postings_tf"]


@query(f"{_TOK}, {sql.TF} SELECT token, df FROM df")
def doc_freq(spark, sf_dir):
    return vocabulary_of(spark, sf_dir, "web").select("token", "df")


@query(f"{_TOK} SELECT DISTINCT token FROM tok")
def vocabulary(spark, sf_dir):
    return vocabulary_of(spark, sf_dir, "web").select("token")


@query("SELECT count(*) AS n FROM documents")
def corpus_total(spark, sf_dir):
    return web(spark, sf_dir).agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def facet_source_all(spark, sf_dir):
    return search.facet(web(spark, sf_dir), "source")


@query(_web_sql("SELECT id, title FROM web ORDER BY id LIMIT 50 OFFSET 100"))
def list_docs_page(spark, sf_dir):
    return web(spark, sf_dir).orderBy("id").offset(100).limit(50).select("id", "title")


_VOCAB = f"WITH {sql.PARTS}, {sql.all_tokens()}, {sql.TF}"


def _expansion(name: str, asked: list[str], synonyms: dict | None = None, **switches) -> None:
    QUERIES[name] = lambda spark, sf_dir: expand.expand(indexed(spark, sf_dir, "parts").vocabulary, asked, synonyms, **switches)
    ORACLES[name] = f"{_VOCAB}, {sql.variants(asked, synonyms)} SELECT q_token, token, mult FROM var"


_expansion("expand_prefix", ["wi", "ri", "wid"])
_expansion("expand_fuzzy", ["widgot", "rng", "rinx"])
_expansion("expand_synonym", ["red"], SYNONYMS)
_expansion("expand_priority", ["red", "ring", "blu", "ho"], {"red": ["red", "reds", "blue"], "blu": ["blue", "azure"]})


# Transport fields, fallback.
@query(sql.top(sql.search(parse("ring"), sql.PARTS), 30, where="lower(m_from) = 'port3' AND lower(m_to) = 'port1' AND contains(m_depart, '2024-03')"))
def transport_meta_filter(spark, sf_dir):
    found = search.search(parts(spark, sf_dir), "ring", idx=indexed(spark, sf_dir, "parts"))
    return hits(search.filtered(found, meta={"from": " PORT3", "to": "port1", "depart": "2024-03"}), 30)


@query(sql.top(sql.search(parse("ring"), sql.PARTS), 20))
def news_fallback(spark, sf_dir):
    none = search.search(web(spark, sf_dir), "qqqqzzzz", idx=indexed(spark, sf_dir, "web"))
    other = search.search(parts(spark, sf_dir), "ring", idx=indexed(spark, sf_dir, "parts")).drop("meta")
    return hits(search.with_fallback(none, other.select(none.columns)), 20)


# Extraction.
_SPACES = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_X = lambda pattern, c="html": f"regexp_extract({c}, '{pattern}', 1)"
_STRIP = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script[^>]*>[\\s\\S]*?</script>', ' ', 'g'), '(?is)<style[^>]*>[\\s\\S]*?</style>', ' ', 'g'), '(?is)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_SPACES.format(_X('(?is)<title[^>]*>(.*?)</title>'))} AS title, coalesce(nullif({_SPACES.format(_X('(?is)<meta\\s+(?:name|property)=[\"'']description[\"'']\\s+content=[\"'']([^\"'']*)[\"''][^>]*>'))}, ''), {_SPACES.format(_X('(?is)<title[^>]*>(.*?)</title>'))}) AS description FROM pages")
def extract_title_desc(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", html.title(h).alias("title"), F.coalesce(F.nullif(html.description(h), F.lit("")), html.title(h)).alias("description"))


# The whole text, cut where the reference cuts it: after 4000 bytes, a letter that is cut becoming the replacement character.
_LETTERS = "[octet_length(encode(c)) FOR c IN string_split(body, '')]"
_MAIN = f"""WITH p AS (SELECT page_id, {_STRIP.format("coalesce(" + ", ".join(f"nullif({_X(f'(?is)<{e}[^>]*>([\\s\\S]*?)</{e}>')}, '')" for e in ("article", "main", "body")) + ", html)")} AS body FROM pages),
    n AS (SELECT page_id, body, {_LETTERS} AS sizes FROM p),
    k AS (SELECT page_id, body, sizes, len(list_filter(range(1, len(sizes) + 1), lambda i: list_sum(sizes[1:i]) <= 4000)) AS kept FROM n WHERE octet_length(encode(body)) > 4000)
    SELECT page_id, body FROM p WHERE octet_length(encode(body)) <= 4000
    UNION ALL SELECT page_id, left(body, kept) || CASE WHEN list_sum(sizes[1:kept]) < 4000 THEN chr(65533) ELSE '' END FROM k"""


@query(_MAIN)
def extract_main_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.main_text(F.col("html")).alias("body"))


QUERIES["extract_main_text_whole"], ORACLES["extract_main_text_whole"] = extract_main_text, _MAIN


@query(f"SELECT page_id, array_to_string(list_filter([{_STRIP.format('x')} FOR x IN regexp_extract_all(html, '(?is)<h1[^>]*>([\\s\\S]*?)</h1>', 1)], lambda x: x <> ''), ' ' || chr(10) || ' ') AS headings FROM pages")
def extract_headings(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.headings(F.col("html")).alias("headings"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s+[^>]*href=[\"'']([^\"'']+)[\"''][^>]*>', 1)) AS href FROM pages")
def extract_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(html.links(F.col("html"))).alias("href"))


@query("SELECT page_id, sha1(url) AS id, regexp_extract(url, '^https?://(?:[^@/?#]*@)?([^/?#]+)', 1) AS host FROM pages")
def doc_id_and_host(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.doc_id_of(u).alias("id"), text.crawl_host(u).alias("host"))


@query("SELECT regexp_extract(url, '^https?://(?:[^@/?#]*@)?([^/?#]+)', 1) AS host, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY 1")
def pages_by_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(text.crawl_host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.sum(F.length("html")).alias("chars"))


_LOG = "log AS (SELECT 'host' || (user_id % 50) || '.example.com' AS host, CASE WHEN event_id % 7 = 0 THEN 'blocked' ELSE 'fetched' END AS status, ts FROM events)"


@query(f"WITH {_LOG} SELECT host, count(*) FILTER (status = 'fetched') AS pages_fetched, count(*) FILTER (status = 'blocked') AS blocked_by_robots, strftime(max(ts) FILTER (status = 'fetched'), '%Y-%m-%dT%H:%M:%SZ') AS last_fetch FROM log GROUP BY host")
def host_stats(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.concat(F.lit("host"), F.col("user_id") % 50, F.lit(".example.com")).alias("host"), F.when(F.col("event_id") % 7 == 0, "blocked").otherwise("fetched").alias("status"), "ts")
    return crawl.host_stats(log).withColumn("last_fetch", text.rfc3339(F.col("last_fetch").cast("timestamp")))


@query("SELECT url, page_id FROM (SELECT url, page_id, row_number() OVER (PARTITION BY url ORDER BY page_id) AS k FROM pages) WHERE k = 1")
def seen_dedupe(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"))


@query("SELECT host, url, depth FROM (SELECT host, url, depth, row_number() OVER (PARTITION BY host ORDER BY depth, url) AS k FROM (SELECT regexp_extract(url, '^https?://(?:[^@/?#]*@)?([^/?#]+)', 1) AS host, url, CAST(page_id % 4 AS INTEGER) AS depth FROM pages)) WHERE k <= 2")
def host_cap(spark, sf_dir):
    items = table(spark, sf_dir, "pages").select("url", (F.col("page_id") % 4).cast("int").alias("depth"))
    return crawl.host_capped(items, 2).select(text.crawl_host(F.col("url")).alias("host"), "url", "depth")


@query("SELECT page_id, NOT (starts_with(p, '/a') OR starts_with(p, '/p')) OR starts_with(p, '/ar') AS allowed FROM (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS p FROM pages)")
def robots_allowed(spark, sf_dir):
    rules = lambda *r: F.array(*map(F.lit, r))
    return table(spark, sf_dir, "pages").select("page_id", crawl.allowed(F.col("url"), rules("/ar", ""), rules("/a", "", "/p")).alias("allowed"))


@query("""WITH l AS (SELECT url, CAST(page_id % 5 AS INTEGER) AS depth, unnest(regexp_extract_all(html, '(?is)<a\\s+[^>]*href=["'']([^"'']+)["''][^>]*>', 1)) AS href FROM pages WHERE page_id % 5 < 4),
    t AS (SELECT CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^https?://[^/?#]*') ELSE '' END || href AS url, depth + 1 AS depth FROM l)
    SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM t WHERE url NOT IN (SELECT url FROM pages) GROUP BY url""")
def frontier_step(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    start = pages.select("url", "html", (F.col("page_id") % 5).cast("int").alias("depth"))
    return crawl.frontier_step(start, None, pages.select("url"))


@query(f"""WITH p AS (SELECT url, html, {_SPACES.format(_X('(?is)<title[^>]*>(.*?)</title>'))} AS t, {_SPACES.format(_X('(?is)<meta\\s+(?:name|property)=["'']description["'']\\s+content=["'']([^"'']*)["''][^>]*>'))} AS d FROM pages)
    SELECT sha1(url) AS id, coalesce(nullif(t, ''), url) AS title, url, coalesce(nullif(d, ''), nullif(t, ''), url) AS snippet, regexp_extract(url, '^https?://(?:[^@/?#]*@)?([^/?#]+)', 1) AS source, '{NOW}' AS date, lower(regexp_extract(html, '(?is)<html[^>]*\\slang=["'']([a-zA-Z]{{2}})', 1)) AS lang FROM p""")
def page_heads(spark, sf_dir):
    return html.page_documents(table(spark, sf_dir, "pages"), NOW).drop("body", "headings")


@query()
def page_documents(spark, sf_dir):
    return html.page_documents(table(spark, sf_dir, "pages"), NOW)


@query()
def page_media(spark, sf_dir):
    return html.page_media(table(spark, sf_dir, "pages"), NOW)


# The store.
@query(_web_sql("SELECT id, title, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'new ' || source ELSE source END AS source FROM web"))
def upsert_latest(spark, sf_dir):
    docs = web(spark, sf_dir)
    third = docs.where(F.col("id").cast("long") % 3 == 0)
    new = third.withColumn("seq", F.lit(1)).unionByName(third.withColumn("source", F.concat(F.lit("new "), "source")).withColumn("seq", F.lit(2)))
    return index.upsert(docs, new).select("id", "title", "source")


@query(_web_sql("SELECT id FROM web WHERE NOT (source = 'src1' AND regexp_extract(url, '^https?://([^/?#]+)', 1) = 'src1.example.com')"))
def remove_by_host(spark, sf_dir):
    return index.clear_by(web(spark, sf_dir), "src1", "src1.example.com", text.host_of).select("id")


# Rules on literal rows: what is expected is written out, not computed by the code's own patterns.
_PAGE = """<html lang="en"><title> A
 B &amp; C</title><body><nav>N</nav><article><p>Hi<br>you</p><script>z</script></article><h2>B</h2><h1>A <b>x</b></h1>
<img src="../c.png"><video src="v.mp4"></video><iframe src="https://www.youtube.com/embed/AbC?x=1"></iframe><iframe src="mailto:a@b.c"></iframe>
<meta property="og:type" content="Article"><meta property="article:published_time" content="2024-05-01">
<script type="application/ld+json">[{"@type":["Thing","videoobject"],"name":" N ","embedUrl":"https://youtu.be/Q1","thumbnailUrl":["","t"]}]</script></body></html>"""


def _fixture(name: str, schema: str, rows: list[tuple], f: Callable[[DataFrame], DataFrame], columns: str, *expected: str) -> None:
    """A query over literal ``rows``, and its result as SQL rows."""
    QUERIES[name] = lambda spark, sf_dir: f(spark.createDataFrame(rows, schema))
    ORACLES[name] = f"SELECT * FROM (VALUES {', '.join(expected)}) v({columns})"


_fixture("media_of_a_page", "url string, html string", [("https://ex.com/a/b", _PAGE), ("https://ex.com/none", "<p>no media</p>"), ("https://ex.com/null", None)], lambda p: html.page_media(p, NOW), "kind, id, title, url, thumb, source, date",
         f"('image', sha1('https://ex.com/c.png'), 'A B &amp; C', 'https://ex.com/c.png', 'https://ex.com/c.png', 'ex.com', '{NOW}')", f"('video', sha1('https://ex.com/a/v.mp4'), 'A B &amp; C', 'https://ex.com/a/v.mp4', '', 'ex.com', '{NOW}')",
         f"('video', sha1('https://www.youtube.com/watch?v=AbC'), 'A B &amp; C', 'https://www.youtube.com/watch?v=AbC', 'https://i.ytimg.com/vi/AbC/hqdefault.jpg', 'www.youtube.com', '{NOW}')",
         f"('video', sha1('https://www.youtube.com/watch?v=Q1'), 'N', 'https://www.youtube.com/watch?v=Q1', 'https://i.ytimg.com/vi/Q1/hqdefault.jpg', 'www.youtube.com', '{NOW}')", "('news', sha1('https://ex.com/a/b'), 'A B &amp; C', 'https://ex.com/a/b', '', 'ex.com', '2024-05-01')")
_fixture("document_of_a_page", "url string, html string", [("https://ex.com/a/b", _PAGE)], lambda p: html.page_documents(p, NOW), "id, title, url, snippet, body, headings, source, date, lang",
         f"(sha1('https://ex.com/a/b'), 'A B &amp; C', 'https://ex.com/a/b', 'A B &amp; C', 'Hi you', 'A x ' || chr(10) || ' B', 'ex.com', '{NOW}', 'en')")
_fixture("absolute_addresses", "base string, ref string", [("https://ex.com/a/b", r) for r in ("../c#x", "//cdn.ex.com/i.png", "mailto:a@b.c", "data:x")], lambda r: r.select("ref", html.absolute_url("base", "ref").alias("target")), "ref, target",
         "('../c#x', 'https://ex.com/c#x')", "('//cdn.ex.com/i.png', 'https://cdn.ex.com/i.png')", "('mailto:a@b.c', '')", "('data:x', '')")
_fixture("embedded_players", "url string", [(u,) for u in ("https://www.youtube.com/embed/AbC?x=1", "https://player.vimeo.com/video/42#t", "https://www.dailymotion.com/embed/video/x9", "https://ex.com/embed/1")], lambda r: r.select("url", text.embed_target(F.col("url"))[0].alias("watch")), "url, watch",
         "('https://www.youtube.com/embed/AbC?x=1', 'https://www.youtube.com/watch?v=AbC')", "('https://player.vimeo.com/video/42#t', 'https://vimeo.com/42')", "('https://www.dailymotion.com/embed/video/x9', 'https://www.dailymotion.com/video/x9')", "('https://ex.com/embed/1', '')")
_fixture("seed_addresses", "raw string", [(" ex.com ",), ("//ex.com",), ("HTTP://ex.com",), (" ",)], lambda r: r.select("raw", text.normalize_seed(F.col("raw")).alias("seed")), "raw, seed", "(' ex.com ', 'https://ex.com')", "('//ex.com', 'https://ex.com')", "('HTTP://ex.com', 'HTTP://ex.com')", "(' ', NULL)")
_fixture("sitemap_addresses", "xml string", [("<url><loc> https://ex.com/1 </loc></url><url><LOC>https://ex.com/2</LOC></url>",)], lambda r: r.select(F.explode(html.sitemap_urls(F.col("xml"))).alias("url")), "url", "('https://ex.com/1')", "('https://ex.com/2')")
_ROBOTS = "User-agent: ExampleBot\nUser-agent: OtherBot\nDisallow: /a\nUser-agent: *\nDisallow: /private\nAllow: /private/ok\nCrawl-delay: 1.5\nSitemap: https://ex.com/s.xml"
_fixture("robots_rules", "host string, body string", [("ex.com", _ROBOTS), ("own.com", "User-agent: ExampleBot # ours\nuser-agent: examplebot\nDisallow: /x\n# Disallow: /y\nUser-agent: *\nDisallow: /")], lambda r: crawl.robots_policies(r, "ExampleBot").select("host", F.array_join("disallow", " ").alias("disallow"), F.array_join("allow", " ").alias("allow"), "delay", F.array_join("sitemaps", " ").alias("sitemaps")), "host, disallow, allow, delay, sitemaps",
         "('ex.com', '/private', '/private/ok', 1, 'https://ex.com/s.xml')", "('own.com', '/x', '', 0, '')")
_fixture("highlight_rules", "snippet string, q string", [("Best running shoes for trail", "running shoes"), ('Tom &amp; "Jerry"', "tom"), ("Trail maps", "zzz"), (" ".join(f"w{i:02d}" for i in range(40)), "w20")], lambda r: reduce(DataFrame.unionByName, (r.where(F.col("q") == q).select("q", highlighted(F.col("snippet"), q).alias("marked")) for q in ("running shoes", "tom", "zzz", "w20"))), "q, marked",
         "('running shoes', 'Best <mark>running</mark> <mark>shoes</mark> for trail')", "('tom', '<mark>Tom</mark> &amp; &quot;Jerry&quot;')", "('zzz', 'Trail maps')", f"('w20', '. {' '.join(f'<mark>w{i}</mark>' if i == 20 else f'w{i:02d}' for i in range(8, 32))} .')")
_FOUND = [("1", "A &amp; B", "https://ex.com/1", "red ring &lt;", "thumb", "s", {"from": "x"}, 2.0, None), ("2", None, "https://ex.com/2", None, "", "s", None, 1.0, None)]
_FOUND_SCHEMA = "id string, title string, url string, snippet string, body string, source string, meta map<string,string>, score double, date_ts timestamp"
for _kind, _columns, _rows in (
    ("all", "title, url, snippet, \"snippetHtml\", \"snippetPlain\", source", ("('A & B', 'https://ex.com/1', 'red <mark>ring</mark> &lt;', 'red <mark>ring</mark> &lt;', 'red ring <', 's')", "('', 'https://ex.com/2', '', '', '', 's')")),
    ("news", "title, url, snippet, \"snippetHtml\", \"snippetPlain\", source", ("('A & B', 'https://ex.com/1', 'red ring <', 'red <mark>ring</mark> &lt;', 'red ring <', 's')", "('', 'https://ex.com/2', '', '', '', 's')")),
    ("transport", "title, url, snippet, source, \"from\"", ("('A & B', 'https://ex.com/1', 'red ring &lt;', 's', 'x')", "('', 'https://ex.com/2', NULL, 's', NULL)")),
):
    _fixture(f"layout_{_kind}", _FOUND_SCHEMA, _FOUND, lambda r, kind=_kind: results.results(r, kind, "ring") if kind != "transport" else results.results(r, kind, "ring").withColumn("from", F.col("meta")["from"]).drop("meta"), _columns, *_rows)
_fixture("video_api_items", "body string", [('{"items":[{"id":{"videoId":"v1"},"snippet":{"title":"T","publishedAt":"2024-01-01T00:00:00Z"}},{"id":{},"snippet":{"title":"no id"}}]}',)], lambda r: store.video_items(r, "body", NOW), "id, title, url, duration, \"thumbnailUrl\", source, date",
         "(sha1('https://www.youtube.com/watch?v=v1'), 'T', 'https://www.youtube.com/watch?v=v1', '', 'https://i.ytimg.com/vi/v1/hqdefault.jpg', 'www.youtube.com', '2024-01-01T00:00:00Z')")
_fixture("video_api_list", "body string", [('{"list":[{"title":"T","url":"https://d.com/v","duration":61,"thumbnail_url":"t","created_time":86400}]}',)], lambda r: store.video_list(r, "body"), "id, title, url, duration, \"thumbnailUrl\", source, date",
         "(sha1('https://d.com/v'), 'T', 'https://d.com/v', '61s', 't', 'd.com', '1970-01-02T00:00:00Z')")
_fixture("instants", "s string", [(x,) for x in ("2024-02-01T10:00:00Z", "2024-02-01T10:00:00+02:00", "2024-02-30", "not-a-date", "")], lambda r: r.select("s", text.rfc3339(text.parse_date(F.col("s"))).alias("instant")), "s, instant",
         "('2024-02-01T10:00:00Z', '2024-02-01T10:00:00Z')", "('2024-02-01T10:00:00+02:00', '2024-02-01T08:00:00Z')", "('2024-02-30', NULL)", "('not-a-date', NULL)", "('', NULL)")

#: A site of two hosts for the crawl: a blocked path, a missing page, a sitemap, a link to a third host.
_SITE = [("https://a.com", '<a href="/1"><a href="/private/x"><a href="https://b.com/"><a href="https://c.com/">'), ("https://a.com/1", '<a href="/2"><a href="/gone">'), ("https://a.com/2", '<a href="/3">'), ("https://a.com/3", "<p>deep</p>"), ("https://a.com/listed", "<p>by sitemap</p>"), ("https://b.com/", '<a href="/b1"><a href="/b2">'), ("https://b.com/b1", "<p>x</p>"), ("https://b.com/b2", ""), ("https://c.com/", "<p>other host</p>")]


def _crawled(spark: SparkSession, **limits) -> crawl.Crawl:
    policies = crawl.robots_policies(spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /private\nCrawl-delay: 2\nSitemap: https://a.com/s.xml")], "host string, body string"), "ExampleBot")
    maps = spark.createDataFrame([("https://a.com/s.xml", "<loc>https://a.com/listed</loc>")], "url string, xml string")
    seeds = spark.createDataFrame([("a.com",), (" //b.com/ ",)], "url string")
    return crawl.crawl(seeds, spark.createDataFrame(_SITE, "url string, html string"), f"{shared_folder(spark)}/skald-crawl-{uuid.uuid4().hex}", policies, maps, **limits)


QUERIES["crawl_pages"] = lambda spark, sf_dir: _crawled(spark, max_depth=2).fetched
ORACLES["crawl_pages"] = "SELECT url, CAST(depth AS INTEGER) AS depth, host FROM (VALUES ('https://a.com', 0, 'a.com'), ('https://b.com/', 0, 'b.com'), ('https://a.com/1', 1, 'a.com'), ('https://a.com/listed', 1, 'a.com'), ('https://b.com/b1', 1, 'b.com'), ('https://a.com/2', 2, 'a.com')) v(url, depth, host)"
QUERIES["crawl_capped_by_host"] = lambda spark, sf_dir: _crawled(spark, per_host=2).fetched.select("url")
ORACLES["crawl_capped_by_host"] = "SELECT * FROM (VALUES ('https://a.com'), ('https://b.com/'), ('https://a.com/1'), ('https://b.com/b1')) v(url)"
QUERIES["crawl_capped_by_pages"] = lambda spark, sf_dir: _crawled(spark, max_pages=3).fetched.select("url")
ORACLES["crawl_capped_by_pages"] = "SELECT * FROM (VALUES ('https://a.com'), ('https://b.com/'), ('https://a.com/1')) v(url)"
QUERIES["crawl_any_host"] = lambda spark, sf_dir: _crawled(spark, same_domain=False, max_depth=1).fetched.select("url")
ORACLES["crawl_any_host"] = "SELECT * FROM (VALUES ('https://a.com'), ('https://b.com/'), ('https://a.com/1'), ('https://a.com/listed'), ('https://b.com/b1'), ('https://c.com/')) v(url)"


def _crawl_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _crawled(spark)
    policies = crawl.robots_policies(spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /private\nCrawl-delay: 2\nSitemap: https://a.com/s.xml")], "host string, body string"), "ExampleBot")
    return done.stats(policies)


QUERIES["crawl_stats"] = _crawl_stats
ORACLES["crawl_stats"] = "SELECT * FROM (VALUES ('a.com', 5::BIGINT, 1::BIGINT, 2, 1), ('b.com', 2, 0, 0, 0)) v(host, pages_fetched, blocked_by_robots, crawl_delay_seconds, sitemap_count)"


# The engine over one folder: append, replace, statistics.
def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    engine = Engine(spark, f"{shared_folder(spark)}/skald-engine-{uuid.uuid4().hex}", search.Settings(per_source=0))
    engine.ingest(parts(spark, sf_dir).where("cast(id as int) % 2 = 0"))
    engine.ingest(parts(spark, sf_dir).where("cast(id as int) % 3 = 0").withColumn("title", F.concat("title", F.lit(" again"))))
    return engine


QUERIES["ingest_append"] = lambda spark, sf_dir: _engine(spark, sf_dir).documents().select("id", "title", "source")
ORACLES["ingest_append"] = "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' again' ELSE '' END AS title, p_brand AS source FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0"


def _replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    engine.ingest(parts(spark, sf_dir).where("cast(id as int) % 5 = 0"), mode="replace")
    engine.remove(source="Brand#13")
    return engine.stats().sources


QUERIES["ingest_replace"] = _replaced
ORACLES["ingest_replace"] = "SELECT p_brand AS source, count(*) AS n FROM part WHERE p_partkey % 5 = 0 AND p_brand <> 'Brand#13' GROUP BY 1"
QUERIES["engine_search"] = lambda spark, sf_dir: _engine(spark, sf_dir).search("again widget", page=2).results.select("title", "url", "source")
ORACLES["engine_search"] = sql.engine_page("again widget")
