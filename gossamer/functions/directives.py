"""Indexing directives: meta robots, canonical links, index and follow gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def meta_robots(content: Column) -> Column:
    """struct(index, follow): null allows both; else tokens, split at comma and blank, are folded from the left."""
    start = F.struct(F.lit(False).alias("index"), F.lit(False).alias("follow"))

    def step(a: Column, t: Column) -> Column:
        index = F.when(t.isin("index", "all"), True).when(t.isin("noindex", "none"), False).otherwise(a["index"])
        follow = F.when(t.isin("follow", "all"), True).when(t.isin("nofollow", "none"), False).otherwise(a["follow"])
        return F.struct(index.alias("index"), follow.alias("follow"))

    both = F.struct(F.lit(True).alias("index"), F.lit(True).alias("follow"))
    return F.when(content.isNull(), both).otherwise(F.aggregate(F.split(F.lower(content), ", ", -1), start, step))


def effective_robots(content: Column, ignore_meta: bool = True) -> Column:
    """By default directives are ignored (strict mode); with `ignore_meta=False` they hold."""
    return meta_robots(F.lit(None).cast("string") if ignore_meta else content)


def _attribute(html: Column, tag: str, name: str, value: str, wanted: str) -> Column:
    element = F.regexp_extract(html, rf"(?is)(<{tag}\s[^>]*\b{name}\s*=\s*[\"']{value}[\"'][^>]*>)", 1)
    found = F.regexp_extract(element, rf"(?is)\b{wanted}\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.when(element.rlike(rf"(?is)\b{wanted}\s*=\s*[\"']"), found)


def canonical_href(html: Column) -> Column:
    """href of the first canonical link, null when there is none."""
    return _attribute(html, "link", "rel", "canonical", "href")


def meta_robots_content(html: Column) -> Column:
    return _attribute(html, "meta", "name", "robots", "content")


def resolved(url: Column, canonical: Column) -> Column:
    return F.coalesce(canonical, url)
