"""Rules of text, parsing, ranking, extraction, crawling, storage and streaming on small fixtures."""

import json
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skald.engine import Engine
from skald.functions import html, text
from skald.operators import crawl, index, results, search
from skald.operators.highlight import mark
from skald.operators.query import parse, stem_word, tokens
from skald.plans import catalog
from skald.sources import store
from skald.streaming import ingest

STEMS = "docs→doc bodies→body dies→die ies→ies classes→class glass→glass boxes→box buses→bus houses→hou house→house running→run string→str sing→sing meetings→meet added→ad speed→spe need→need pages→page news→new queries→query".split()
DOCS = [
    ("d1", "Running shoes guide", "Best running shoes for trail", "Trail running needs grip.", "Grip", "https://shop.example.com/running", "shop.example.com", "2024-01-05", "en"),
    ("d2", "Trail maps", "Maps of every trail", "shoes optional", "", "https://maps.example.org/trail", "maps.example.org", "2024-02-01T10:00:00Z", "en"),
    ("d3", "Chaussures café", "Les chaussures de course", "course", "", "https://fr.example.com/course", "fr.example.com", "", "fr"),
    ("d4", "Shoe repair", "Fix a shoe", "", "", "https://shop.example.com/repair", "shop.example.com", "not-a-date", ""),
    ("d5", "Hotels in Nairobi", "Stay near the park", "hotel rooms", "Rooms", "https://stay.example.ke/nairobi", "stay.example.ke", "2024-03-01", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id string, title string, snippet string, body string, headings string, url string, source string, date string, lang string").cache()


def test_stems_agree(spark):
    rows = spark.createDataFrame([tuple(p.split("→")) for p in STEMS], "t string, s string")
    assert [r.t for r in rows.where(text.stem(F.col("t")) != F.col("s")).collect()] == []
    assert [stem_word(p.split("→")[0]) for p in STEMS] == [p.split("→")[1] for p in STEMS]


@pytest.mark.parametrize(("raw", "lang", "expected"), [("The Café-Straße's Œuvre, v2.0", "en", "cafe strasse oeuvre v2"), ("The Café docs", "fr", "the cafe docs"), ("Nairobi: flights & hotels", "en", "nairobi flight hotel"), ("AT&amp;T", "en", "amp"), ("naïve İstanbul", "en", "naive istanbul")])
def test_tokens(spark, raw, lang, expected):
    rows = spark.createDataFrame([(raw, lang)], "b string, lang string")
    assert [r.token for r in text.exploded_tokens(rows, "b").orderBy("pos").collect()] == expected.split()
    if lang == "en":
        assert tokens(raw) == expected.split()


@pytest.mark.parametrize(("q", "required", "optional", "negated"), [("shoes OR maps", "shoe", "map", ""), ("NOT shoes maps", "", "map shoe", ""), ("shoes -trail", "shoe", "", "trail"), ("shoe-repair", "shoe", "", ""), ("the", "", "", ""), ('a "b c', "", "", "")])
def test_boolean_parser(q, required, optional, negated):
    p = parse(q)
    assert (p.required, p.optional, p.negated) == (required.split(), optional.split(), negated.split())


RANKED = [("shoes", "d1 1.207087, d4 1.207087"), ("running shoes", "d1 1.621178"), ("shoes OR maps", "d1 1.207087, d4 1.207087"), ("OR shoes maps", "d2 1.363691, d1 1.207087, d4 1.207087"), ("shoes -trail", "d4 1.207087"), ('"running shoes"', "d1 2.0"), ('"shoes for"', "d1 2.0, d2 2.0, d4 2.0"), ('trail "running shoes"', "d1 2.199465, d2 1.0"), ("hotels in nairobi", "d5 1.599814"), ("shoez", "d1 1.0, d4 1.0"), ("sh", "d1 1.335695, d4 1.335695"), ("cafe", "d3 1.0"), ("grip", ""), ("the", "")]


@pytest.mark.parametrize(("q", "expected"), RANKED)
def test_ranking(docs, q, expected):
    got = search.page_of(search.search(docs, q)).select("id", F.round("score", 6).alias("s")).collect()
    assert ", ".join(f"{r.id} {r.s}" for r in got) == expected


def test_filters_sorts_and_groups(docs):
    every = docs.withColumn("score", F.lit(1.0)).withColumn("date_ts", text.parse_date(F.col("date")))
    assert sorted(r.id for r in search.filtered(every, from_="2024-01-10").collect()) == ["d2", "d3", "d4", "d5"]
    assert [r.id for r in search.page_of(every, sort="latest").collect()] == ["d5", "d2", "d1", "d3", "d4"]
    shoes = search.search(docs, "shoes")
    assert [r.id for r in search.diversified(shoes, 1).collect()] == ["d1"]
    assert search.facet(shoes, "source").collect()[0].n == 2
    assert search.page_of(shoes, 9).collect() == []


def test_highlight():
    assert mark("Best running shoes for trail", "running shoes") == "Best <mark>running</mark> <mark>shoes</mark> for trail"
    assert mark('Tom &amp; "Jerry"', "tom") == "<mark>Tom</mark> &amp; &quot;Jerry&quot;"
    assert mark("Trail maps", "zzz") == "Trail maps"
    long = mark(" ".join(f"w{i:02d}" for i in range(40)), "w20")
    assert long.startswith(". w08 ") and long.endswith(" w31 .") and "<mark>w20</mark>" in long


def test_extraction(spark):
    page = "<title> A\n B &amp; C</title><body><nav>N</nav><article><p>Hi<br>you</p><script>z</script></article><h2>B</h2><h1>A <b>x</b></h1></body>"
    row = spark.createDataFrame([(page,)], "h string").select(html.title(F.col("h")).alias("t"), html.main_text(F.col("h")).alias("b"), html.headings(F.col("h")).alias("k")).first()
    assert (row.t, row.b, row.k) == ("A B &amp; C", "Hi you", "A x \n B")
    refs = spark.createDataFrame([("https://ex.com/a/b", r) for r in ("../c#x", "//cdn.ex.com/i.png", "mailto:a@b.c", "data:x")], "b string, r string")
    assert [r[0] for r in refs.select(html.absolute_url("b", "r")).collect()] == ["https://ex.com/c#x", "https://cdn.ex.com/i.png", "", ""]
    watch, thumb = text.embed_target(F.col("u"))
    urls = spark.createDataFrame([("https://www.youtube.com/embed/AbC?x=1",), ("https://player.vimeo.com/video/42#t",)], "u string").select(watch.alias("w"), thumb.alias("t")).collect()
    assert [(r.w, r.t) for r in urls] == [("https://www.youtube.com/watch?v=AbC", "https://i.ytimg.com/vi/AbC/hqdefault.jpg"), ("https://vimeo.com/42", "")]
    raw = spark.createDataFrame([('[{"@type":["Thing","videoobject"],"name":" N ","embedUrl":"https://youtu.be/Q1","thumbnailUrl":["","t"]}]',), ('{"@graph":[{"@type":"VideoObject","contentUrl":"https://e.com/v"}]}',), ("broken",)], "j string")
    got = html.json_ld_videos(raw, "j", "now").collect()
    assert [(r.title, r.url, r.thumb) for r in got] == [("N", "https://www.youtube.com/watch?v=Q1", "https://i.ytimg.com/vi/Q1/hqdefault.jpg")]


def test_robots(spark):
    body = "User-agent: ExampleBot\nUser-agent: OtherBot\nDisallow: /a\nUser-agent: *\nDisallow: /private\nAllow: /private/ok\nCrawl-delay: 1.5\nSitemap: https://ex.com/s.xml"
    rules = crawl.robots_policies(spark.createDataFrame([("ex.com", body)], "host string, body string"), "ExampleBot")
    r = rules.first()
    assert (r.disallow, r.allow, r.delay, r.sitemaps) == (["/private"], ["/private/ok"], 1, ["https://ex.com/s.xml"])
    urls = spark.createDataFrame([("https://ex.com/private/ok/x",), ("https://ex.com/private/x",), ("https://ex.com/a",)], "u string").crossJoin(rules)
    assert [x[0] for x in urls.select(crawl.allowed(F.col("u"), F.col("allow"), F.col("disallow"))).collect()] == [True, False, True]
    root = spark.createDataFrame([("https://ex.com",), ("https://ex.com/",)], "u string")
    assert [x[0] for x in root.select(crawl.allowed(F.col("u"), F.lit(None).cast("array<string>"), F.array(F.lit("/")))).collect()] == [True, False]


def test_store_and_upsert(spark, docs, tmp_path):
    for payload in ([{"ID": "1", "Title": "t", "x": 1}], {"data": [{"ID": "1", "Title": "t"}]}, {"docs": [{"ID": "1", "Title": "t"}]}):
        got = store.payload_documents(spark.createDataFrame([(json.dumps(payload),)], "value string")).collect()
        assert [(r.id, r.title, r.lang) for r in got] == [("1", "t", "")]
    store.save_snapshot(docs.withColumn("vertical", F.lit("web")), str(tmp_path / "s"))
    assert store.load_snapshot(spark, str(tmp_path / "s"), "web").count() == 5
    new = docs.where("id = 'd1'").withColumn("title", F.lit("new")).withColumn("seq", F.lit(1))
    assert {r.id: r.title for r in index.upsert(docs, new).collect()}["d1"] == "new"


def test_result_layouts(spark):
    doc = [("1", "A &amp; B", "https://ex.com/1", "red <b>ring</b> &lt;", "thumb", "s", {"from": "x"}, 2.0, None), ("2", None, "https://ex.com/2", None, "", "s", None, 1.0, None)]
    found = spark.createDataFrame(doc, "id string, title string, url string, snippet string, body string, source string, meta map<string,string>, score double, date_ts timestamp")
    rows = {k: results.results(found, k, "ring").collect() for k in ("all", "news", "images", "videos", "transport")}
    a = rows["all"][0]
    assert (a.title, a.snippet, a.snippetPlain) == ("A & B", a.snippetHtml, "red <b>ring</b> <")
    assert "<mark>" in a.snippetHtml and "<b>" not in a.snippetHtml
    assert rows["news"][0].snippet == a.snippetPlain and [r.title for r in rows["all"]] == ["A & B", ""]
    assert tuple(rows["images"][0]) == ("A &amp; B", "red <b>ring</b> &lt;", "https://ex.com/1", "s")
    assert (rows["videos"][0].duration, rows["videos"][0].thumbnailUrl) == ("red <b>ring</b> &lt;", "thumb")
    assert rows["transport"][0].meta == {"from": "x"}
    assert results.results(found, "all", "ring", 2).count() == 0 and results.results(found, "videos", "ring", per_source=1).count() == 1


def test_frontier_and_settings(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"queue": [{"u": "https://ex.com", "depth": 2}], "seen": ["a", "b"], "lastRun": "x"}, indent=1))
    queue, seen = store.import_frontier(spark, str(tmp_path / "f.json"))
    store.save_frontier(queue, seen.union(seen), str(tmp_path / "f"))
    queue, seen = store.load_frontier(spark, str(tmp_path / "f"))
    assert [tuple(r) for r in queue.collect()] == [("https://ex.com", 2)] and sorted(r.url for r in seen.collect()) == ["a", "b"]
    store.save_settings(spark, str(tmp_path / "s"), synonyms={" Red ": [" Blue", ""]}, priors={"EX.com": 1.5, "no": 0.0})
    assert store.load_settings(spark, str(tmp_path / "s")) == {"synonyms": {"red": ["blue"]}, "priors": {"ex.com": 1.5}}


def test_streaming_ingest(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([(k, f"https://ex.com/{k}", f"<title>T{k}</title>"), (9, "https://ex.com/9", f"<title>V{k}</title>")], "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = ingest.ingest(ingest.pages_stream(spark, str(tmp_path / "in"), files=1), str(tmp_path / "out"), str(tmp_path / "cp"), "now")
    q.awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out" / "v=1")).collect()) == ["https://ex.com/0", "https://ex.com/1", "https://ex.com/9"]


def test_main_text_whole(spark, tmp_path):
    """Against the rule in Python: the text beyond 800 characters is returned, up to 4000 bytes."""
    pages = [(r.page_id, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").collect()]
    pages += [(-1, "<body><article>" + "é" * 5000 + "</article></body>"), (-2, "<body>" + "<p>word</p> " * 300 + "</body>")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = {}
    for i, page in pages:
        found = (re.search(rf"(?is)<{e}[^>]*>([\s\S]*?)</{e}>", page) for e in ("article", "main", "body"))
        body = next((m[1] for m in found if m and m[1]), page)
        for pattern in (r"(?s)<!--.*?-->", r"(?is)<script[^>]*>[\s\S]*?</script>", r"(?is)<style[^>]*>[\s\S]*?</style>", r"(?is)<[^>]+>", r"(?a:\s+)"):
            body = re.sub(pattern, " ", body)
        want[i] = body.strip(" ").encode()[:4000].decode(errors="replace")
    assert {r.page_id: r.body for r in catalog.QUERIES["extract_main_text_whole"](spark, str(tmp_path)).collect()} == want
    assert len(want[-1]) == 2000 and sum(len(x) > 800 for x in want.values()) > 10


def test_whole_position_lists(spark):
    """Every position of every posting, against the tokens of each text in order."""
    sf_dir = "/root/testdata/sf0.001"
    want = {}
    for r in text.exploded_tokens(catalog.web(spark, sf_dir), "body", "lang", "id").select("id", "pos", "token").collect():
        want.setdefault((r.id, r.token), []).append(r.pos)
    rows = catalog.QUERIES["postings_positions"](spark, sf_dir).where("field = 'body'").collect()
    assert {(r.id, r.token): json.loads(r.positions) for r in rows} == {k: sorted(v) for k, v in want.items()}
    assert all(len(json.loads(r.positions)) == r.tf for r in rows) and max(r.tf for r in rows) > 5
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = catalog.QUERIES["postings_positions"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(catalog.ORACLES["postings_positions"]).fetchall())


def test_facets_and_totals_beyond_the_cap(spark, tmp_path):
    """More matches than the reference keeps: every one of them is counted."""
    n = search.CAP + 50
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit("thon").alias("text"), F.lit("en").alias("lang"), F.lit("src0").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.n for r in catalog.QUERIES["facet_source_hits"](spark, str(tmp_path)).collect()] == [n]


def test_three_forms_of_the_stemmer_agree(spark):
    rng = random.Random(3)
    ends = ["", "s", "es", "ss", "sses", "ies", "ing", "ed", "ches", "shes", "xes", "zes", "nning", "pped", "y"]
    words = sorted({"".join(rng.choice("abesxzching") for _ in range(rng.randint(0, 5))) + rng.choice(ends) + rng.choice(["", "", "s", "es"]) for _ in range(3000)} - {""})
    rows = spark.createDataFrame([(w, stem_word(w)) for w in words], "t string, s string")
    got = text.stemmed(rows, "t", F.lit(True), "u").withColumn("v", text.stem(F.col("t")))
    assert got.where("u <> s or v <> s").collect() == []


def test_stored_index_gives_what_a_fresh_one_gives(spark, docs, tmp_path):
    index.Index.store(docs, str(tmp_path / "i"))
    stored = index.Index.open(spark.newSession(), str(tmp_path / "i"))
    assert stored.total == 5
    stored = index.Index.open(spark, str(tmp_path / "i"))
    for q in ("shoes", "trail \"running shoes\"", "OR shoes maps", "shoes -trail", "\"shoes for\"", "zzz"):
        rows = lambda idx, q=q: [tuple(r) for r in search.page_of(search.search(docs, q, idx=idx)).select("id", F.round("score", 9)).collect()]
        assert rows(stored) == rows(None), q


def test_engine_of_one_folder(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"), constants={"default": [("Home", "https://ex.com", "start here", "ex.com")], "books": [("Books", "https://ex.com/b", "read", "ex.com")]})
    assert engine.seed([("1", "Red shoes", "https://ex.com/1", "red shoes here", "ex.com"), ("1", "Blue shoes", "https://ex.com/1", "blue shoes here", "ex.com"), ("2", "Maps", "https://ex.com/2", "maps of towns", "ex.com")]) == 3
    (tmp_path / "p.json").write_text(json.dumps({"data": [{"ID": "9", "Title": "Shoe news", "Url": "https://n.com/9", "Snippet": "shoe fair", "Source": "n.com"}]}))
    assert engine.ingest(str(tmp_path / "p.json"), "news") == 1
    found = engine.search("shoes")
    assert found.total == 1 and [r.title for r in found.results.collect()] == ["Blue shoes"] and [tuple(r) for r in found.sources.collect()] == [("ex.com", 1)]
    assert [r.title for r in engine.search("fair").results.collect()] == ["Shoe news"]  # nothing on the web: news
    assert [r.title for r in engine.search(" ").results.collect()] == ["Home"] == [r.title for r in engine.search("x", "odd").results.collect()]
    assert [r.title for r in engine.search("x", "books").results.collect()] == ["Books"] and engine.search("x", "map").total == 0
    again = Engine(spark, str(tmp_path / "e"))
    assert again.search("maps").total == 1 and again.stats("news").total == 1
    assert again.remove(source="ex.com") == 2 and again.documents().count() == 0 and again.flush() == ["web"]
    assert again.ingest(engine.documents("news"), "transport", "replace") == 1
    again.export(str(tmp_path / "x"), "news")
    (out,) = (tmp_path / "x").glob("part-*")
    assert [d["ID"] for d in json.loads(out.read_text())] == ["9"]
    with pytest.raises(ValueError):
        again.ingest(engine.documents("news"), "forums")
    query = again.autosave(1)
    again.dirty.add("news")
    query.processAllAvailable()
    query.stop()
    assert again.dirty <= {"transport"} or not again.dirty


def test_export_of_many_documents_is_one_array(spark, docs, tmp_path):
    store.export_json(docs, str(tmp_path / "x"), array=True)
    (out,) = (tmp_path / "x").glob("part-*")
    assert [d["ID"] for d in json.loads(out.read_text())] == ["d1", "d2", "d3", "d4", "d5"]
    store.export_json(docs.limit(0), str(tmp_path / "none"), array=True)
    assert [json.loads(f.read_text()) for f in (tmp_path / "none").glob("part-*")] == [[]]


def test_crawl_goes_on_from_a_saved_frontier(spark, tmp_path):
    pages = spark.createDataFrame([("https://a.com", '<a href="/1"><a href="/2">'), ("https://a.com/1", '<a href="/3">'), ("https://a.com/2", "<p>x</p>"), ("https://a.com/3", "<p>x</p>")], "url string, html string")
    seeds = spark.createDataFrame([("a.com",)], "url string")
    first = crawl.crawl(seeds, pages, str(tmp_path / "one"), max_pages=2)
    assert sorted(r.url for r in first.fetched.collect()) == ["https://a.com", "https://a.com/1"] and first.visited == 2
    store.save_frontier(first.queue, first.seen, str(tmp_path / "f"))
    none = seeds.limit(0)
    second = crawl.crawl(none, pages, str(tmp_path / "two"), saved=store.load_frontier(spark, str(tmp_path / "f")), same_domain=False)
    assert sorted(r.url for r in second.fetched.collect()) == ["https://a.com/2", "https://a.com/3"] and second.queue.count() == 0
    assert {r.url for r in second.seen.collect()} == {"https://a.com", "https://a.com/1", "https://a.com/2", "https://a.com/3"}


def test_changes_of_a_stream(spark, tmp_path):
    rows = [[(1, "https://ex.com/1", "<title>A</title>"), (2, "https://ex.com/2", "<title>B</title>"), (3, "https://ex.com/1", "<title>A2</title>")], [(4, "https://ex.com/2", "<title>B2</title>")], [(5, "https://ex.com/5", "<title>C</title>")]]
    for batch in rows:
        spark.createDataFrame(batch, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.ingest_changes(ingest.pages_stream(spark, str(tmp_path / "in"), files=1), str(tmp_path / "out"), str(tmp_path / "cp"), "now").awaitTermination()
    titles = lambda folder, upto=None: sorted(r.title for r in ingest.current(spark, str(tmp_path / folder), upto).collect())
    assert titles("out") == ["A2", "B2", "C"]
    ingest.compact(spark, str(tmp_path / "out"), str(tmp_path / "less"), 1)
    assert titles("less") == ["A2", "B2", "C"] and len(titles("less", 1)) <= 3 and len(list((tmp_path / "less").glob("epoch=*"))) == 2
    ingest.ingest_changes(ingest.pages_stream(spark, str(tmp_path / "in"), files=1), str(tmp_path / "once"), str(tmp_path / "cp2"), "now", first_only=True).awaitTermination()
    assert len(titles("once")) == 3


def test_pages_of_a_host_are_limited_over_the_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, f"https://a.com/{k}", ""), (k, f"https://b{k}.com/", "")], "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    limited = ingest.host_limited(ingest.pages_stream(spark, str(tmp_path / "in"), files=1), 2)
    limited.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = [(r.host, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [("a.com", 1), ("a.com", 2), ("b0.com", 1), ("b1.com", 1), ("b2.com", 1)]


def test_page_source(spark):
    pages = spark.createDataFrame([("a", "x" * 10, 200), ("b", "", 200), ("c", None, 200), ("d", "x", 404), ("e", "éé", None)], "url string, html string, status int")
    assert [(r.url, r.html) for r in store.page_source(pages, 3).orderBy("url").collect()] == [("a", "xxx"), ("e", "é\ufffd")]


def test_crawl_statistics_are_saved(spark, tmp_path):
    stats = spark.createDataFrame([("a.com", 5, 1, 2, 1), ("b.com", 2, 0, 0, 0)], "host string, pages_fetched long, blocked_by_robots long, crawl_delay_seconds int, sitemap_count int")
    store.save_crawl_stats(stats, str(tmp_path / "s"), "now")
    assert sorted(tuple(r) for r in store.load_crawl_stats(spark, str(tmp_path / "s")).collect()) == [("a.com", 5, 1, 2, 1, None, "now"), ("b.com", 2, 0, 0, 0, None, "now")]
    (tmp_path / "f.json").write_text(json.dumps({"hosts": {"c.com": {"pagesFetched": 3, "lastFetch": "x"}}, "timestamp": "t"}))
    assert [tuple(r) for r in store.load_crawl_stats(spark, str(tmp_path / "f.json")).collect()] == [("c.com", 3, None, None, None, "x", "t")]


def test_pages_of_one_address_give_links_at_their_own_depth(spark, tmp_path):
    rows = [(4, "https://a.com/x", '<a href="/late">'), (10, "https://a.com/x", '<a href="/deep"><a href="/both">'), (13, "https://a.com/x", '<a href="/both"><a href="/later">'), (15, "https://a.com/y", '<a href="/x"><a href="/both">')]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.QUERIES["frontier_step"](spark, str(tmp_path))
    assert sorted((r.url, r.depth) for r in got.collect()) == [("https://a.com/both", 1), ("https://a.com/deep", 1), ("https://a.com/later", 4)]
    items = spark.createDataFrame([("https://a.com/x", 2), ("https://a.com/x", 1), ("https://a.com/y", 4)], "url string, depth int")
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet")
    assert {(r.url, r.depth) for r in crawl.frontier_step(items, pages.where("page_id = 10"), pages).collect()} == {("https://a.com/both", 2), ("https://a.com/deep", 2)}


def test_tokens_grouped_in_a_document_are_those_of_an_aggregation(spark):
    letters = "AaBbSsEeDdIiNnGgXxZzÉéŒœßİŸ '’-_1٣\n🙂"
    draw = random.Random(3)
    words = [*"classes boxes glass running STRING added pages the and Œuvre straße x I'm sses buses éé".split(), *("".join(draw.choices(letters, k=draw.randint(0, 9))) for _ in range(150))]
    text_of = lambda k: draw.choice(["", None, " ", " ".join(draw.choices(words, k=k))])
    rows = [(f"d{i}" if i % 7 else "same", text_of(5), text_of(9), text_of(60), text_of(4), f"https://the.ex.com/pages/{i}", draw.choice(["en", "fr", "", None])) for i in range(60)]
    schema = "id string, title string, snippet string, body string, headings string, url string, lang string"
    for some in (rows, [r for r in rows if r[0] != "same"]):
        docs = spark.createDataFrame(some, schema).repartition(3)
        expected = index.tokens_of(docs).groupBy("field", "token", "id").agg(F.array_sort(F.collect_list("pos")).alias("positions"), F.count("*").alias("tf"))
        want = sorted((r.field, r.token, r.id, tuple(r.positions), r.tf) for r in expected.collect())
        assert len(want) > 500 and sorted((r.field, r.token, r.id, tuple(r.positions), r.tf) for r in index.postings(docs).collect()) == want
        entries = {(r.token, r.id): r for r in index.entries(docs).collect()}
        assert sorted((index.FIELDS[p >> index.FIELD_BITS], t, i, p & ((1 << index.FIELD_BITS) - 1)) for (t, i), r in entries.items() for p in r.places) == sorted((f, t, i, p) for f, t, i, ps, _ in want for p in ps)
        assert all(r[f"tf_{f}"] == sum(p >> index.FIELD_BITS == n for p in r.places) for r in entries.values() for n, f in enumerate(index.FIELDS))
        assert sorted(map(tuple, index.vocabulary(docs).collect())) == sorted(map(tuple, index.document_frequencies(index.entries(docs)).collect()))
        for rows_of in (index.entries, index.postings) if some is not rows else ():
            assert "Aggregate" not in rows_of(docs)._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_grouped_in_slices_of_words(monkeypatch):
    docs = pa.RecordBatch.from_pydict({"id": [f"d{i}" for i in range(9)], "english": [True] * 9, **{f: [["pages", "a", f"w{i % 4}"] * i for i in range(9)] for f in index.FIELDS}})
    whole = pa.Table.from_batches(index._grouping("entries")(iter([docs]))).to_pylist()
    monkeypatch.setattr(index, "SLICE", 50)
    parts = list(index._grouping("entries")(iter([docs])))
    assert len(whole) == 24 and len(parts) > 3 and sorted(map(str, pa.Table.from_batches(parts).to_pylist())) == sorted(map(str, whole))
