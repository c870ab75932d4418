"""Links of pages: extraction, resolution, filtering, distinct."""

from __future__ import annotations

import json
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gossamer.functions import urls

# One pattern reads a page as a tokenizer does: every match begins where the one before ended (\\G), passes over
# whole tokens, and ends with the next anchor.  All loops are possessive and open constructs end with the text, so
# the work follows the length of the page.
_WS = r"[\t\n\f\r ]"
_VALUE = rf"""(?:{_WS}*+={_WS}*+(?:"[^"]*+"|'[^']*+'|["'](?s:.*+)|[^\t\n\f\r >]*+))"""
_NAME = r"[^\t\n\f\r />][^\t\n\f\r />=]*+"
_GAP = r"[\t\n\f\r /]*+"
_END = r"(?=[\t\n\f\r />])"
_ATTRIBUTES = rf"(?:{_GAP}{_NAME}{_VALUE}?+)*+{_GAP}"
_BEFORE = rf"<a{_END}(?:{_GAP}(?!href[\t\n\f\r />=]){_NAME}{_VALUE}?+)*+{_GAP}"
#: Elements whose content is text up to their own end tag.
RAW = "script|style|textarea|title|xmp|iframe|noembed|noframes"
_TOKENS = "|".join(
    [
        r"[^<]++",
        r"<!--(?:-?>|(?s:.*?)(?:--!?>|\z))",
        rf"<({RAW}){_END}{_ATTRIBUTES}>(?s:.*?)(?:</\1{_END}{_ATTRIBUTES}>|\z)",
        rf"{_BEFORE}>",
        rf"<(?!a{_END})[a-z][^\t\n\f\r />]*+{_ATTRIBUTES}>",
        rf"</[a-z][^\t\n\f\r />]*+{_ATTRIBUTES}>",
        r"<[!?][^>]*+(?:>|\z)",
        r"</>|</[^a-z>][^>]*+(?:>|\z)",
        r"<(?![a-z!?/])|</\z",
    ]
)
#: The next anchor with an href (group 2: from its name to the end of its value); what is never closed ends the page.
ANCHOR = rf"(?i)\G(?:{_TOKENS})*+(?:{_BEFORE}(href{_VALUE}?+){_ATTRIBUTES}>|<(?s:.*+)|\z)"
#: Named references that also count without a semicolon, unless a letter, digit or equals sign follows.
_LEGACY = {n: c for n, c in html5.items() if not n.endswith(";")}
#: Numbers that stand for the characters of another code page.
_NUMBERS = {n: c for n in range(0x80, 0xA0) if (c := bytes([n]).decode("cp1252", "ignore"))}


def _looked_up(table: dict, key: Column) -> Column:
    return F.try_element_at(F.from_json(F.lit(json.dumps(table)), "map<string,string>"), key)


def decoded(text: Column) -> Column:
    """An attribute's text with its character references decoded: all numbers and all named ones of HTML."""

    def char(code: Column) -> Column:
        good = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        own = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(code.between(0x80, 0x9F), F.coalesce(_looked_up(_NUMBERS, code.cast("string")), F.char(code))).when(good, own).otherwise("\ufffd")

    def numbered(number: Column) -> Column:
        digits = F.regexp_extract(number, "^#[xX]?0*([0-9a-fA-F]*)", 1)
        is_hex = F.lower(F.substring(number, 2, 1)) == "x"
        code = lambda d: F.when(is_hex, F.conv(d, 16, 10)).otherwise(F.when(d == "", "0").otherwise(d)).cast("long")
        return urls.bound(urls.bound(F.when(F.length(digits) <= 7, digits).otherwise(F.lit("0")), code), char)

    def piece(x: Column) -> Column:
        """What stood behind an ampersand."""
        rest = lambda n: F.substring(x, n + 1, F.length(x))
        name = F.regexp_extract(x, "^([a-zA-Z][a-zA-Z0-9]*);", 1)
        bare = F.regexp_extract(x, "^([a-zA-Z][a-zA-Z0-9]*)(?![=;a-zA-Z0-9])", 1)
        named = F.when(name == "amp", "&").when(name != "", _looked_up({n[:-1]: c for n, c in html5.items() if n.endswith(";")}, name)).when(bare != "", _looked_up(_LEGACY, bare))
        after = F.when(name != "", rest(F.length(name) + 1)).otherwise(rest(F.length(bare)))
        other = urls.bound(named, lambda c: F.when(c.isNotNull(), F.concat(c, after)).otherwise(F.concat(F.lit("&"), x)))
        return urls.bound(F.regexp_extract(x, r"^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", 0), lambda n: F.when(n != "", F.concat(numbered(n), rest(F.length(n)))).otherwise(other))

    def joined(pieces: Column) -> Column:
        return F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), piece), ""))

    return F.when(text.contains("&"), urls.bound(F.split(text, "&", -1), joined)).otherwise(text)


def hrefs(html: Column) -> Column:
    """The href values of all anchors in page order, without quotes, with references decoded; without a value they are empty."""
    found = F.filter(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)), lambda v: v != "")
    value = lambda v: F.regexp_replace(v, rf"^(?i:href){_WS}*+=?{_WS}*+", "")
    bare = lambda v: F.when(F.substring(v, 1, 1).isin('"', "'"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return F.transform(F.transform(found, value), lambda v: urls.bound(bare(v), decoded))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href) of every anchor of `pages` (page_id, url, html)."""
    return pages.select("page_id", "url", F.posexplode(hrefs(F.col("html"))).alias("pos", "href"))


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[str | None] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.found.append(dict(reversed(attrs)).get("href"))  # the first of equal names counts

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)  # in a page that is all it is, however it goes on


@F.pandas_udf(T.ArrayType(T.StringType()))
def parsed_hrefs(html: pd.Series) -> pd.Series:
    """Like hrefs(), by the standard library's parser, which is more lenient with broken markup: also anchors without href, as null."""

    def one(text: str | None) -> list[str | None] | None:
        if text is None:
            return None
        parser = _Anchors()
        parser.feed(text)
        parser.close()
        return parser.found

    return html.map(one)


def resolve(links: DataFrame) -> DataFrame:
    """Adds site (authority of the page) and target (absolute link)."""
    out = links.withColumn("site", urls.authority(F.col("url")))
    return out.withColumn("target", urls.canonical(F.col("site"), F.col("href")))


def valid(links: DataFrame) -> DataFrame:
    return links.where(urls.is_page_link(F.col("href")))


def on_site(links: DataFrame) -> DataFrame:
    """Links whose target begins with their page's authority; cheap tests on the raw text come first."""
    kept = resolve(valid(links))
    return kept.where(F.col("target").isNotNull() & urls.same_site(F.col("target"), F.col("site")))


def distinct_per_page(links: DataFrame) -> DataFrame:
    """One row per page and target, ignoring case: the first by position.

    min_by keeps one row per key in the map-side aggregate, so hot pages shuffle little.
    """
    return links.groupBy("page_id", "url", "site", F.lower("target").alias("_key")).agg(F.min("pos").alias("pos"), F.min_by("target", "pos").alias("target")).drop("_key")


def undiscovered(links: DataFrame, discovered: DataFrame) -> DataFrame:
    """Links whose target is not in `discovered` (url); case counts."""
    return links.join(discovered.select(F.col("url").alias("target")), "target", "left_anti")


def frontier(pages: DataFrame, discovered: DataFrame) -> DataFrame:
    """The distinct new targets of `pages`."""
    return undiscovered(distinct_per_page(on_site(extract(pages))), discovered)
