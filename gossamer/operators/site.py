"""A whole crawl of one site: robots.txt, sitemap seeds, and rounds of fetch, gate, extract and filter."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.functions import directives, urls
from gossamer.operators import crawl, links, robots
from gossamer.operators.lineage import Gathered, cut, ranked, shared_folder
from gossamer.operators.seen import PER_BUCKET, SeenUrls, counted
from gossamer.sources import sitemaps

#: From URLs (url, delay) to responses (url, status, content_type, body); delay tells the seconds between requests.
Fetch = Callable[[DataFrame], DataFrame]


class RobotsError(ValueError):
    """A robots.txt that cannot be read."""


@dataclass
class Hooks:
    """What a crawl takes from pages and how it judges links; each may be replaced."""

    #: The href values of a page (html), as an array.
    collect_links: Callable[[Column], Column] = links.hrefs
    #: The canonical href of a page, or null.
    canonical: Callable[[Column], Column] = directives.canonical_href
    #: index and follow of a page (html, ignore_meta), as a struct.
    robots_rules: Callable[[Column, bool], Column] = lambda html, ignore: directives.effective_robots(directives.meta_robots_content(html), ignore)
    #: The target of a link (site, href), or null.
    resolve: Callable[[Column, Column], Column] = urls.canonical
    #: Whether a link (href) may be a page.
    keep: Callable[[Column], Column] = urls.is_page_link
    #: Whether a target belongs to a site (target, site).
    on_site: Callable[[Column, Column], Column] = urls.same_site
    #: The links (url, site, ..) of a round that are not among the discovered ones (url); without, SeenUrls tells.
    undiscovered: Callable[[DataFrame, DataFrame], DataFrame] | None = None


def from_store(responses: DataFrame) -> Fetch:
    """Responses that are already stored, under any spelling of escapes; URLs that are not there are fetched as nothing."""
    url = F.when(F.col("url").contains("%"), urls.normalized(F.col("url"))).otherwise(F.col("url"))
    kept = responses.select(url.alias("url"), "status", "content_type", "body")
    return lambda wanted: wanted.select("url").join(kept, "url")


def robots_groups(site: DataFrame, fetch: Fetch, abort: bool = False) -> DataFrame:
    """The grouped robots.txt lines of `site` (site); no answer counts as an empty file.  A file above the size limit is
    empty, too, or with `abort` a RobotsError."""
    answers = fetch(site.select(F.concat("site", F.lit("/robots.txt")).alias("url"), F.lit(0.0).alias("delay")))
    answers = answers.select(urls.authority(F.col("url")).alias("site"), "status", "body")
    texts = cut(robots.texts_by_status(site.join(answers, "site", "left").withColumn("status", F.coalesce("status", F.lit(404)))))
    if abort and (bad := robots.errors(texts).limit(1).collect()):
        raise RobotsError(f"{bad[0]['site']}: {bad[0]['error']}")
    return cut(robots.grouped(robots.lines(texts)))


def _seeds_from_sitemaps(site: DataFrame, groups: DataFrame, fetch: Fetch, delay: float, abort: bool) -> DataFrame:
    """(site, href) of all items of the site's sitemaps; a failed response is an empty sitemap."""
    start = robots.sitemap_locations(site, robots.sitemaps(groups)).select("site", F.col("sitemap").alias("loc"))

    def files(wanted: DataFrame) -> DataFrame:
        got = fetch(wanted.select(F.col("loc").alias("url"), F.lit(delay).alias("delay")).distinct()).where(F.col("status").between(200, 299))
        return got.select(F.col("url").alias("loc"), F.coalesce("content_type", F.lit("")).alias("content_type"), "body")

    return sitemaps.expand(start, files, cut=cut, abort=abort).select("site", F.col("loc").alias("href"))


class Expressions:
    """What the hooks say of columns, built once: rounds use the same expressions again."""

    def __init__(self, hooks: Hooks, ignore_meta: bool):
        html, gates = F.col("html"), hooks.robots_rules(F.col("html"), ignore_meta)
        self.keep = hooks.keep(F.col("href"))
        self.target = hooks.resolve(F.col("site"), F.col("href"))
        self.on_site = F.col("target").isNotNull() & hooks.on_site(F.col("target"), F.col("site"))
        self.links = F.posexplode(hooks.collect_links(html)).alias("pos", "href")
        self.page = {"resolved": directives.resolved(F.col("url"), hooks.resolve(F.col("site"), hooks.canonical(html))), "index": gates["index"], "follow": gates["follow"]}


def admitted(hrefs: DataFrame, rules: DataFrame | None, agent: str, said: Expressions) -> DataFrame:
    """(.., href, site) with target: page links that robots.txt admits (tested on the raw href), on the site."""
    kept = hrefs.where(said.keep)
    if rules is not None:
        asked = kept.withColumns({"agent": F.lit(agent), "path": F.col("href")})
        kept = robots.checked(asked, rules).where("allowed").drop("agent", "path", "allowed")
    return kept.withColumn("target", said.target).where(said.on_site)


def crawl_site(
    spark: SparkSession,
    entry: str,
    fetch: Fetch,
    options: crawl.Options | None = None,
    analyze: Callable[[DataFrame], None] | None = None,
    hooks: Hooks | None = None,
    on_round: Callable[[dict], None] | None = None,
    per_bucket: int = PER_BUCKET,
) -> DataFrame:
    """(url) of the visited pages of the site of `entry`, each once.

    The entry is never tested against robots.txt; sitemap items are seeds even where robots.txt is not
    respected.  A page counts as visited under its canonical URL, if it has one and may be indexed; it is
    expanded if it may be followed.  No page is fetched twice; failed ones are not tried again.  `analyze`
    gets each round's pages (url, resolved, body) before the index gate.  Rounds stop once max_pages pages
    were processed; the last round takes those that a queue would: the entry first, then sitemap items by URL, then
    links in the order of their pages and on each page as they stand.  `on_round` gets the counts of each round
    (round, asked, pages, shown, new), which the writes of the round take on their way.
    A delay that robots.txt names for the agent takes the place of the one in `options`, if it is respected.
    """
    options, hooks = options or crawl.Options(), hooks or Hooks()
    agent, said = options.user_agent or "*", Expressions(hooks, options.ignore_meta)
    site = spark.createDataFrame([(entry,)], "entry string").select(urls.authority(F.col("entry")).alias("site"))
    groups = robots_groups(site, fetch, options.abort)
    rules, delay = None, options.crawl_delay
    if options.respect_robots_txt:
        asked = site.withColumn("agent", F.lit(agent))
        rules = cut(robots.rules_for_agent(asked, groups))  # asked once, small enough to be broadcast in every round
        named = robots.delay_for_agent(asked, groups).first()
        delay = float(named["delay"]) if named and named["delay"] is not None else delay
    seeds = admitted(_seeds_from_sitemaps(site, groups, fetch, delay, options.abort), rules, agent, said).select(F.col("target").alias("url"), "site").distinct()
    first = site.select(urls.normalized(F.lit(entry)).alias("url"), "site", crawl.place(F.lit(0)).alias("key"))
    path = shared_folder(spark)
    if counted(seeds, path)["n"]:
        later = ranked(spark.read.schema(seeds.schema).parquet(path), "url").select("url", "site", crawl.place(F.col("rank") + 1).alias("key"))
        first = first.unionByName(later).groupBy("url", "site").agg(F.min("key").alias("key"))
    seen, visited, processed, turn = SeenUrls(spark, per_bucket), Gathered(), 0, 0
    frontier, told = seen.admit(first)
    while (asked := told["n"]) and processed < options.max_pages:
        now = frontier
        if processed + asked > options.max_pages:
            asked = options.max_pages - processed
            now = ranked(frontier, "key", "url").where(F.col("rank") < asked).drop("rank")
        processed += asked
        got = now.join(fetch(now.select("url", "site").withColumn("delay", F.lit(delay))), "url").where(crawl.fetched(options.loader, F.col("status")))
        got = got.withColumn("html", F.col("body")).withColumns(said.page)
        path = shared_folder(spark)
        pages_told = counted(got, path, shown=F.count_if("index"))
        pages = spark.read.schema(got.schema).parquet(path)
        if analyze:
            analyze(pages.select("url", "resolved", "body"))
        if pages_told.get("shown"):
            visited.add(pages.where("index").select(F.col("resolved").alias("url")), pages_told["shown"])
        told = {"n": 0}
        if pages_told["n"]:
            found = crawl.short_keys(pages.where("follow"), turn).select("url", "site", "key", said.links)
            found = admitted(found, rules, agent, said)
            # on a page the first of links that differ in case counts; across pages case matters
            found = found.groupBy("url", "site", F.lower("target").alias("_key")).agg(F.min_by("target", "pos").alias("target"), F.min(F.concat("key", crawl.place(F.col("pos")))).alias("key"))
            found = found.groupBy(F.col("target").alias("url"), "site").agg(F.min("key").alias("key"))
            frontier, told = seen.admit(found) if hooks.undiscovered is None else seen.add(hooks.undiscovered(found, seen.all()))
        if on_round:
            on_round({"round": turn, "asked": asked, "pages": pages_told["n"], "shown": pages_told.get("shown", 0), "new": told["n"]})
        turn += 1
    return visited.all().distinct() if visited.parts else first.select("url").limit(0)
