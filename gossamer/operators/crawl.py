"""The crawl as a closure over stored pages: fetch, gates, expansion, page cap."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.functions import directives
from gossamer.operators.lineage import cut, ranked
from gossamer.operators.seen import PER_BUCKET, SeenUrls


@dataclass
class Options:
    """Settings of a crawl; defaults are those that users of site crawlers know."""

    user_agent: str | None = None
    max_pages: int = 10_000
    crawl_delay: float = 0.0
    respect_meta_robots: bool = True
    respect_robots_txt: bool = True
    #: Strict mode keeps the inverted switch: respecting meta robots means that they are ignored.
    strict: bool = True
    loader: str = "static"
    #: A robots.txt or sitemap that cannot be read ends the crawl; without, such files count as empty.
    abort: bool = True

    @property
    def ignore_meta(self) -> bool:
        return self.respect_meta_robots if self.strict else not self.respect_meta_robots


def fetched(loader: str, status: Column) -> Column:
    """Which responses count as pages: 2xx (static), below 300 (rendered), all (lenient)."""
    if loader == "static":
        return status.between(200, 299)
    if loader == "rendered":
        return status < 300
    return F.lit(True)


def fetch(frontier: DataFrame, pages: DataFrame, loader: str = "static") -> DataFrame:
    """Frontier URLs, each once, joined with the page store; failed responses drop out and are not tried again.

    Pages stored without a URL belong to a frontier row without one.
    """
    asked = frontier.dropDuplicates(["url"]).withColumnRenamed("url", "_asked")
    stored = asked.join(pages, F.col("_asked").eqNullSafe(F.col("url"))).drop("_asked")
    return stored.where(fetched(loader, F.col("status")))


def gates(pages: DataFrame, ignore_meta: bool = True) -> DataFrame:
    """Adds index and follow to `pages` (.., html)."""
    rules = directives.effective_robots(directives.meta_robots_content(F.col("html")), ignore_meta)
    return pages.withColumns({"index": rules["index"], "follow": rules["follow"]})


#: Bytes of a place in the queue, and those of a key beyond which it is replaced by its rank.
PLACE, LONGEST_KEY = 8, 64


def place(number: Column) -> Column:
    """Eight bytes that sort like the number."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 2 * PLACE, "0"))


def short_keys(frontier: DataFrame, rounds: int) -> DataFrame:
    """Keys grow by a place each round; before they get long the rows are ranked and the ranks take their place."""
    if (rounds + 1) % (LONGEST_KEY // PLACE):
        return frontier
    return ranked(frontier, "key", "url").withColumn("key", place(F.col("rank"))).select(*frontier.columns)


def crawl(
    seeds: DataFrame,
    edges: DataFrame,
    nodes: DataFrame | None = None,
    max_pages: int | None = None,
    analyze: Callable[[DataFrame], None] | None = None,
    on_round: Callable[[dict], None] | None = None,
    per_bucket: int = PER_BUCKET,
) -> DataFrame:
    """(url, depth) of every page reachable from `seeds` (url) over `edges` (src, dst), each once.

    `nodes` (url, index, follow), where given, holds the pages that can be fetched and their gates: only
    pages with follow are expanded, only those with index are returned.  Each round joins the frontier with
    the edges and stores what SeenUrls has not met; the write counts its rows, so a round has no job of its own
    for that, and `on_round` gets the counts (depth, n, shown).

    The page cap takes the first pages by depth, then URL; with edges (src, dst, pos) it takes those that a queue
    would, and the result has each page's visit number, from 0: links are queued in the order of the pages they
    stand on, then of pos (seeds by URL).  Rounds end once there are enough.
    """
    queued = "pos" in edges.columns
    step = edges
    if nodes is not None:
        step = step.join(nodes.where("follow").select(F.col("url").alias("src")), "src", "left_semi")
    step = cut(step)  # every round reads the edges; their derivation runs once
    index = None if nodes is None else cut(nodes.where("index").select("url").distinct().withColumn("_shown", F.lit(True)))

    def gated(found: DataFrame) -> DataFrame:
        if index is None:
            return found.withColumn("_shown", F.lit(True))
        return found.join(index, "url", "left").withColumn("_shown", F.coalesce("_shown", F.lit(False)))

    first = seeds.select("url").distinct()
    if queued:
        first = ranked(first, "url").select("url", place(F.col("rank")).alias("key"))
    seen, visited, depth = SeenUrls(edges.sparkSession, per_bucket), 0, 0
    reached = first.withColumn("depth", F.lit(0))
    while True:
        frontier, told = seen.admit(gated(reached), shown=F.count_if("_shown"))
        if not told["n"]:
            break
        visited += told["shown"]
        if on_round:
            on_round({"depth": depth} | told)
        if analyze:
            analyze(frontier.drop("_shown", "key"))
        if max_pages is not None and visited >= max_pages:
            break
        if queued:
            frontier = short_keys(frontier, depth)
        depth += 1
        found = frontier.withColumnRenamed("url", "src").join(step, "src")
        order = [F.min(F.concat("key", place(F.col("pos")))).alias("key")] if queued else []
        reached = found.groupBy(F.col("dst").alias("url")).agg(*order, F.lit(depth).alias("depth"))
    out = (seen.all() if len(seen) else frontier).where("_shown")
    if queued:
        out = ranked(out, "depth", "key", "url", name="visit").select("url", "depth", "visit")
        return out if max_pages is None else out.where(F.col("visit") < max_pages)
    out = out.select("url", "depth")
    return out if max_pages is None else limited(out, max_pages)


def limited(visited: DataFrame, max_pages: int) -> DataFrame:
    """The first pages by depth, then URL: a stable form of a soft page cap."""
    return visited.orderBy("depth", "url").limit(max_pages)


def schedule(pages: DataFrame, delay: float) -> DataFrame:
    """Adds start_s to `pages` (site, page_id, ..): seconds after the start, `delay` apart on each site, by page_id.

    Ranks are row numbers inside ranges of (site, page_id) plus the counts of the ranges before, so that a
    large site is not one task's work.
    """
    ranges = cut(pages.repartitionByRange("site", "page_id").withColumn("_range", F.spark_partition_id()))
    counts = ranges.groupBy("site", "_range").count()
    before = Window.partitionBy("site").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("site", "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("site", "_range").orderBy("page_id"))
    ranked = ranges.withColumn("_own", own).join(offsets, ["site", "_range"])
    return ranked.select(*pages.columns, ((F.col("_offset") + F.col("_own") - 1) * delay).cast("double").alias("start_s"))


def result_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(url, side) of URLs that only one of two results has."""
    only = lambda a, b, side: a.select("url").join(b.select("url"), "url", "left_anti").distinct().withColumn("side", F.lit(side))
    return only(left, right, "left").unionByName(only(right, left, "right"))
