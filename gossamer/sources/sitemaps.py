"""Sitemaps as relations: XML url sets and indexes, text sitemaps, and their expansion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The namespace, the limits of text sitemaps, and the change frequencies that are understood.
NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
MAX_LINES = 50_000
MAX_BYTES = 50 * 1024 * 1024
FREQUENCIES = ("Always", "Daily", "Weekly", "Monthly", "Yearly", "Never")


def kind(xml: Column) -> Column:
    """`urlset`, `sitemapindex`, or null for any other root or namespace."""
    root = F.regexp_extract(xml, r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*)*<([A-Za-z]+)[\s>]", 1)
    space = F.regexp_extract(xml, r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*)*<[A-Za-z]+[^>]*\sxmlns\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.when((space == NAMESPACE) & root.isin("urlset", "sitemapindex"), root)


def _items(xml: Column, tag: str, fields: tuple[str, ...]) -> Column:
    inner = ",".join(f"{f}:string" for f in fields)
    return F.from_xml(xml, f"{tag} array<struct<{inner}>>", {"mode": "PERMISSIVE"})[tag]


def modified_since(lastmod: Column, since: Column | None) -> Column:
    return F.lit(True) if since is None else lastmod.isNull() | (lastmod >= since)


def frequency(text: Column) -> Column:
    """The understood frequency, null for none; `hourly` is not among them."""
    found = F.initcap(F.lower(F.trim(text)))
    return F.when(found.isin(*FREQUENCIES), found)


def urlset(sitemaps: DataFrame, since: Column | None = None) -> DataFrame:
    """(site, loc, lastmod, changefreq, priority, error) of `sitemaps` (site, xml); dates filter before other fields."""
    rows = sitemaps.where(kind(F.col("xml")) == "urlset").select("site", F.explode(_items(F.col("xml"), "url", ("loc", "lastmod", "changefreq", "priority"))).alias("u"))
    return urls_of(rows.select("site", "u.*"), since)


def urls_of(items: DataFrame, since: Column | None = None) -> DataFrame:
    """urlset() of `items` (site, loc, lastmod, changefreq, priority), all texts."""
    rows = items.select("site", F.trim("loc").alias("loc"), F.col("lastmod").alias("_l"), F.try_to_timestamp("lastmod").alias("lastmod"), F.col("changefreq").alias("_c"), F.col("priority").alias("_p"))
    rows = rows.where(modified_since(F.col("lastmod"), since))
    freq, priority = frequency(F.col("_c")), F.expr("try_cast(_p AS decimal(38,18))")
    error = F.when(F.col("_l").isNotNull() & F.col("lastmod").isNull(), "invalid lastmod").when(F.col("_c").isNotNull() & freq.isNull(), "invalid changefreq").when(F.col("_p").isNotNull() & priority.isNull(), "invalid priority")
    return rows.select("site", "loc", "lastmod", freq.alias("changefreq"), priority.alias("priority"), error.alias("error"))


def index(sitemaps: DataFrame, since: Column | None = None) -> DataFrame:
    """(site, loc, lastmod, error) of the entries of sitemap indexes; locations must be absolute."""
    rows = sitemaps.where(kind(F.col("xml")) == "sitemapindex").select("site", F.explode(_items(F.col("xml"), "sitemap", ("loc", "lastmod"))).alias("s"))
    return indexes_of(rows.select("site", "s.*"), since)


def indexes_of(items: DataFrame, since: Column | None = None) -> DataFrame:
    """index() of `items` (site, loc, lastmod), all texts."""
    rows = items.select("site", F.trim("loc").alias("loc"), F.try_to_timestamp("lastmod").alias("lastmod"), F.col("lastmod").alias("_l")).where(modified_since(F.col("lastmod"), since))
    error = F.when(~F.col("loc").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), "invalid location").when(F.col("_l").isNotNull() & F.col("lastmod").isNull(), "invalid lastmod")
    return rows.select("site", "loc", "lastmod", error.alias("error"))


def text(sitemaps: DataFrame, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(site, line_no, loc, error) of `sitemaps` (site, txt); blank lines do not count, limits are errors of the file."""
    split = F.split("txt", "\r\n|\n|\r", -1)
    too_large = (F.octet_length("txt") > max_bytes) | (F.size(F.filter(split, lambda x: F.trim(x) != "")) > max_lines)
    good = sitemaps.where(~too_large).select("site", F.posexplode(split).alias("line_no", "line")).where(F.trim("line") != "")
    loc = F.trim("line")
    rows = good.select("site", "line_no", loc.alias("loc"), F.when(~loc.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "invalid url").alias("error"))
    return rows.unionByName(sitemaps.where(too_large).select("site", F.lit(-1).alias("line_no"), F.lit(None).cast("string").alias("loc"), F.lit("sitemap is too large").alias("error")))


class SitemapError(ValueError):
    """A sitemap that cannot be read."""


def _abort(tables: list[DataFrame]) -> None:
    bad = tables[0]
    for more in tables[1:]:
        bad = bad.unionByName(more)
    if found := bad.limit(1).collect():
        raise SitemapError(f"{found[0]['site']}: {found[0]['error']} ({found[0]['loc']})")


def expand(start: DataFrame, files: DataFrame | Callable[[DataFrame], DataFrame], since: Column | None = None, cut: Callable[[DataFrame], DataFrame] = lambda df: df, abort: bool = False) -> DataFrame:
    """(site, loc) of all items reachable from `start` (site, loc) through `files` (loc, content_type, body).

    `files` is a table, or a function that gives the rows of the locations it is asked for.

    Indexes are followed level by level, however deep; a location is opened once for a site, so cycles end.
    Files are read record by record: of one that is broken or too large the items before that count.
    `cut` bounds the lineage of a level (for example a checkpoint).  With `abort` the first faulty item or
    file ends the expansion with a SitemapError.
    """
    from gossamer.sources.sitemap_records import records

    todo, seen, found = start.select("site", "loc").distinct(), None, None
    while True:
        rows = cut(records(todo.join(files(todo) if callable(files) else files, "loc").select("site", "content_type", "body")))
        good, wrong = rows.where("fault IS NULL"), F.when(F.col("loc").isNull(), "invalid location")
        plain = good.where("kind = 'text'").select("site", "loc", F.when(~F.col("loc").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "invalid url").alias("error"))
        listed, deeper = urls_of(good.where("kind = 'urlset'"), since), indexes_of(good.where("kind = 'sitemapindex'"), since)
        if abort:
            faults = rows.select("site", "loc", F.coalesce("fault", wrong).alias("error"))
            _abort([t.where("error IS NOT NULL").select("site", "loc", "error") for t in (faults, plain, listed, deeper)])
        items = plain.where("error IS NULL").unionByName(listed.where("loc IS NOT NULL").select("site", "loc", F.lit(None).cast("string").alias("error"))).select("site", "loc")
        found = items if found is None else found.unionByName(items)
        seen = todo if seen is None else seen.unionByName(todo)
        todo = cut(deeper.where("error IS NULL").select("site", "loc").distinct().join(seen, ["site", "loc"], "left_anti"))
        if todo.isEmpty():
            return found.distinct()
