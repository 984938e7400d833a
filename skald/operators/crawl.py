"""Crawl analytics: robots rules, the frontier, host statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skald.functions.html import absolute_url, links, sitemap_urls
from skald.functions.text import crawl_host, leading_int, normalize_seed

MAX_DEPTH, MAX_PAGES, MAX_PER_HOST = 4, 250, 20


def robots_policies(robots: DataFrame, agent: str) -> DataFrame:
    """``host, disallow, allow, delay, sitemaps`` from ``host, body``: our group if it has rules, else the star group."""
    line = robots.select("host", F.posexplode(F.split("body", "\n")).alias("n", "line")).select("host", "n", F.trim(F.regexp_replace("line", r"^[\s]+|[\s]+$", "")).alias("line")).where("line <> '' and not startswith(line, '#') and instr(line, ':') > 0")
    pairs = line.select("host", "n", F.lower(F.trim(F.regexp_extract("line", "^([^:]*):", 1))).alias("key"), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("value"))
    # The last agent line above a rule decides, also among consecutive ones.
    so_far = Window.partitionBy("host").orderBy("n")
    ruled = pairs.withColumn("agent", F.last(F.when(F.col("key") == "user-agent", F.lower("value")), ignorenulls=True).over(so_far))

    def values(key: str, who: str) -> Column:
        hit = (F.col("key") == key) & (F.col("agent") == who)
        return F.transform(F.array_sort(F.collect_list(F.when(hit, F.struct("n", "value")))), lambda x: x["value"])

    def delay(who: str) -> Column:
        d = leading_int(F.col("value"))
        return F.coalesce(F.max_by(F.when(d > 0, d), F.when((F.col("key") == "crawl-delay") & (F.col("agent") == who) & (d > 0), F.col("n"))), F.lit(0))

    sitemaps = F.transform(F.array_sort(F.collect_list(F.when(F.col("key") == "sitemap", F.struct("n", "value")))), lambda x: x["value"])
    own, star = agent.lower(), "*"
    grouped = ruled.groupBy("host").agg(*(values(k, w).alias(f"{k}_{i}") for i, w in enumerate((own, star)) for k in ("disallow", "allow")), delay(own).alias("delay_0"), delay(star).alias("delay_1"), sitemaps.alias("sitemaps"))
    ours = (F.size("disallow_0") > 0) | (F.size("allow_0") > 0) | (F.col("delay_0") > 0)
    return grouped.select("host", *(F.when(ours, F.col(f"{k}_0")).otherwise(F.col(f"{k}_1")).alias(k) for k in ("disallow", "allow", "delay")), "sitemaps")


def url_path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def allowed(url: Column, allow: Column, disallow: Column) -> Column:
    """Any allow prefix beats any disallow prefix; empty rules say nothing."""
    path = url_path(url)
    hit = lambda rules: F.exists(F.coalesce(rules, F.array().cast("array<string>")), lambda r: (r != "") & F.startswith(path, r))
    return hit(allow) | ~hit(disallow)


def page_links(pages: DataFrame, *keep: str) -> DataFrame:
    """``url, target`` and ``keep`` of every link to an http address."""
    found = pages.select("url", *keep, F.explode(links(F.coalesce(F.col("html"), F.lit("")))).alias("ref"))
    return found.select("url", *keep, absolute_url("url", "ref").alias("target")).where("target <> ''")


def frontier_step(fetched: DataFrame, pages: DataFrame | None, seen: DataFrame, hosts: DataFrame | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``url, depth`` of unseen links of the fetched items (``url, depth``), at the least depth each.

    Without ``pages`` the items bring their own ``html``: of several pages of one address, each then
    has its own depth, and only those below ``max_depth`` give links."""
    open_items = fetched.where(F.col("depth") < max_depth)
    if pages is not None:
        open_items = pages.select("url", "html").join(open_items.groupBy("url").agg(F.min("depth").alias("depth")), "url")
    found = page_links(open_items, "depth").select(F.col("target").alias("url"), (F.col("depth") + 1).alias("depth"))
    if hosts is not None:
        found = found.withColumn("host", crawl_host(F.col("url"))).join(hosts, "host", "left_semi").drop("host")
    return found.groupBy("url").agg(F.min("depth").alias("depth")).join(seen.select("url"), "url", "left_anti")


def host_capped(items: DataFrame, per_host: int = MAX_PER_HOST) -> DataFrame:
    order = Window.partitionBy("host").orderBy("depth", "url")
    hosted = items.withColumn("host", crawl_host(F.col("url")))
    return hosted.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_host).drop("_n", "host")


def host_stats(log: DataFrame) -> DataFrame:
    """``host, pages_fetched, blocked_by_robots, last_fetch`` from ``host, status, ts``."""
    return log.groupBy("host").agg(F.count_if(F.col("status") == "fetched").alias("pages_fetched"), F.count_if(F.col("status") == "blocked").alias("blocked_by_robots"), F.max(F.when(F.col("status") == "fetched", F.col("ts"))).alias("last_fetch"))


def with_policies(items: DataFrame, policies: DataFrame | None) -> DataFrame:
    """``items`` (url, ...) with ``host`` and ``permitted``; hosts without a policy permit everything, addresses without a host leave."""
    hosted = items.withColumn("host", crawl_host(F.col("url"))).where("host <> ''")
    if policies is None:
        return hosted.withColumn("permitted", F.lit(True))
    rules = policies.select("host", "allow", "disallow")
    return hosted.join(rules, "host", "left").withColumn("permitted", allowed(F.col("url"), F.col("allow"), F.col("disallow"))).drop("allow", "disallow")


def starting_items(seeds: DataFrame, queue: DataFrame | None = None) -> DataFrame:
    """``url, depth`` of a saved queue and of seeds (``url``, normalized, at depth 0); the least depth of each address."""
    first = seeds.select(normalize_seed(F.col("url")).alias("url"), F.lit(0).alias("depth")).where("url is not null")
    both = first if queue is None else queue.select("url", "depth").unionByName(first)
    return both.groupBy("url").agg(F.min("depth").alias("depth"))


@dataclass
class Crawl:
    """What a crawl leaves: fetched items (``url, depth, host``), blocked ones, all addresses seen, the queue that is left."""

    fetched: DataFrame
    blocked: DataFrame
    seen: DataFrame
    queue: DataFrame
    visited: int

    def stats(self, policies: DataFrame | None = None) -> DataFrame:
        """``host, pages_fetched, blocked_by_robots, crawl_delay_seconds, sitemap_count`` of the hosts that gave a page."""
        count = lambda rows, name: rows.groupBy("host").agg(F.count("*").alias(name))
        rows = count(self.fetched, "pages_fetched").join(count(self.blocked, "blocked_by_robots"), "host", "left").fillna(0, ["blocked_by_robots"])
        if policies is None:
            return rows.withColumns({"crawl_delay_seconds": F.lit(0), "sitemap_count": F.lit(0)})
        known = policies.select("host", F.col("delay").cast("int").alias("crawl_delay_seconds"), F.size("sitemaps").alias("sitemap_count"))
        return rows.join(known, "host", "left").fillna(0, ["crawl_delay_seconds", "sitemap_count"])


def crawl(seeds: DataFrame, pages: DataFrame, folder: str, policies: DataFrame | None = None, sitemaps: DataFrame | None = None, saved: tuple[DataFrame, DataFrame] | None = None, same_domain: bool = True, max_pages: int = MAX_PAGES, max_depth: int = MAX_DEPTH, per_host: int = MAX_PER_HOST) -> Crawl:
    """Breadth first over ``pages`` (url, html) from ``seeds`` and a saved (queue, seen): one round for each depth.

    Of a round's items, by address, at most what is left of ``max_pages`` are visited; items that
    their host's policy blocks or that have no page give nothing; a host gives at most ``per_host``
    pages; links (below ``max_depth``) and the addresses of the host's ``sitemaps`` (url, xml) are
    queued once, with ``same_domain`` those on the seeds' hosts only. Every round's state is written
    under ``folder``, so that no round depends on the ones before it but through files."""
    spark = pages.sparkSession

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    queue = written(starting_items(seeds, saved and saved[0]), "start")
    seen = queue.select("url") if saved is None else written(queue.select("url").unionByName(saved[1].select("url")).distinct(), "seen-before")
    hosts = seeds.select(crawl_host(normalize_seed(F.col("url"))).alias("host")).where("host <> ''").distinct() if same_domain else None
    full = pages.where("html is not null and html <> ''").select("url", "html")
    empty = spark.createDataFrame([], "url string, depth int, host string")
    fetched, blocked, visited, step = empty, empty, 0, 0
    while visited < max_pages:
        depth = queue.agg(F.min("depth")).first()[0]
        if depth is None:
            break
        step += 1
        turn = written(queue.where(F.col("depth") == depth).orderBy("url").limit(max_pages - visited), f"turn-{step}")
        visited += turn.count()
        items = with_policies(turn, policies)
        blocked = blocked.unionByName(written(items.where("not permitted").select("url", "depth", "host"), f"blocked-{step}"))
        order = Window.partitionBy("host").orderBy("url")
        open_items = items.where("permitted").join(full.select("url"), "url", "left_semi").join(fetched.groupBy("host").agg(F.count("*").alias("had")), "host", "left")
        ranked = open_items.withColumn("n", F.row_number().over(order) + F.coalesce("had", F.lit(0)))
        new = written((ranked.where(F.col("n") <= per_host) if per_host > 0 else ranked).select("url", "depth", "host"), f"fetched-{step}")
        fetched = fetched.unionByName(new)
        found = page_links(full.join(new.where(F.col("depth") < max_depth).select("url"), "url", "left_semi")).select(F.col("target").alias("url"))
        if policies is not None and sitemaps is not None:
            listed = policies.join(new.select("host").distinct(), "host", "left_semi").select(F.explode("sitemaps").alias("url"))
            found = found.unionByName(sitemaps.join(listed, "url", "left_semi").select(F.explode(sitemap_urls(F.col("xml"))).alias("url")))
        if hosts is not None:
            found = found.withColumn("host", crawl_host(F.col("url"))).join(hosts, "host", "left_semi").select("url")
        found = written(found.distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(depth + 1)), f"found-{step}")
        left = queue.join(turn, ["url", "depth"], "left_anti").unionByName(found)
        queue, seen = written(left, f"queue-{step}"), written(seen.unionByName(found.select("url")), f"seen-{step}")
    return Crawl(fetched, blocked, seen, queue, visited)
