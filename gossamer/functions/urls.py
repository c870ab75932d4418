"""URL functions: columns in, columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a link may not begin with, and the extensions that it may have.
SKIPPED_PREFIXES = ("#", "mailto:", "tel:")
PAGE_EXTENSIONS = (".html", ".htm")

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value written and worked out once, however often `f` names it; keeps plans small."""
    return F.element_at(F.transform(F.array(value), f), 1)


def authority(url: Column) -> Column:
    """scheme://host[:port]; empty where the text has no scheme and host."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)


def path(url: Column) -> Column:
    """The path without query and fragment, `/` if empty."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)[?#].*$", "")


def trailing_slash(url: Column) -> Column:
    return F.when(url.endswith("/"), url).otherwise(F.concat(url, F.lit("/")))


def extension(href: Column) -> Column:
    """From the last dot behind the last separator; queries and fragments are not cut off."""
    return F.regexp_extract(href, r"(\.[^./\\]+)$", 1)


def absolute(site: Column, href: Column) -> Column:
    """`href` against the site root (not the page); null for null and for network-path references."""
    return F.when(href.rlike(_SCHEME), href).when(href.startswith("//"), None).when(href.startswith("/"), F.concat(site, href)).otherwise(F.concat(site, F.lit("/"), href))


#: Escapes that stay: of control characters and of ; = ? @ # $ % & + , / and the backslash.
_STAYS = "^(?:[01].|7F|2[3456BCF]|3[BDF]|40|5C)"


def unescaped(part: Column) -> Column:
    """A part of a URL with its percent escapes decoded as UTF-8, but for those that tell something else than the letter.

    Escapes that stay are in upper case; what is no escape stays as it is, and so does a part whose bytes are no UTF-8.
    """
    is_escape = lambda x: x.rlike("^[0-9A-Fa-f]{2}")
    upper = lambda x: F.when(is_escape(x), F.concat(F.upper(F.substring(x, 1, 2)), F.substring(x, F.lit(3), F.length(x)))).otherwise(x)
    sign = lambda x: F.when(is_escape(x) & ~x.rlike(_STAYS), "%").otherwise("%25")

    def joined(pieces: Column) -> Column:
        first, later = F.element_at(pieces, 1), F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), upper)
        kept = F.concat(first, F.array_join(F.transform(later, lambda x: F.concat(F.lit("%"), x)), ""))
        opened = F.concat(first, F.array_join(F.transform(later, lambda x: F.concat(sign(x), x)), ""))
        opened = F.url_decode(F.replace(opened, F.lit("+"), F.lit("%2B")))
        return bound(opened, lambda x: F.when(x.contains("\ufffd"), kept).otherwise(x))

    return F.when(~part.contains("%"), part).otherwise(bound(F.split(part, "%", -1), joined))


def _folded(segments: Column) -> Column:
    """The segments of a path without `.` and `..`."""

    def step(done: Column, s: Column) -> Column:
        return F.when(s == ".", done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))

    none = F.array().cast("array<string>")
    return F.concat(F.aggregate(segments, none, step), F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none))


def normalized(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no dot segments, at least `/` as path, escapes as in unescaped()."""

    def whole(url: Column) -> Column:
        scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
        net = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
        net = F.when(scheme == "http", F.regexp_replace(net, ":80$", "")).when(scheme == "https", F.regexp_replace(net, ":443$", "")).otherwise(net)
        segments = F.split(F.substring(bound(path(url), unescaped), 2, 1 << 30), "/", -1)
        rest = bound(F.regexp_extract(url, r"(?s)^[^?#]*([?#].*)?$", 1), unescaped)
        return F.when(scheme == "", url).otherwise(F.concat(scheme, F.lit("://"), net, F.lit("/"), F.array_join(bound(segments, _folded), "/"), rest))

    return bound(url, whole)


def canonical(site: Column, href: Column) -> Column:
    """absolute() in the one form that all spellings of a URL share."""
    return normalized(absolute(site, href))


def is_page_link(href: Column) -> Column:
    """Not null, no skipped prefix, and either no extension or one of a page."""
    prefix = F.lower(href).rlike("^(" + "|".join(SKIPPED_PREFIXES) + ")")
    found = F.lower(extension(href))
    return href.isNotNull() & ~prefix & ((found == "") | found.isin(*PAGE_EXTENSIONS))


def same_site(url: Column, site: Column) -> Column:
    """A string prefix that ignores case, as site membership is defined here."""
    return F.lower(url).startswith(F.lower(site))
