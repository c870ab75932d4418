"""Paths and rule patterns of robots.txt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_encoded(value: Column) -> Column:
    """Some percent sign does not begin an escaped slash."""
    return value.rlike("%(?!2[fF])")


def normalized_path(value: Column) -> Column:
    """Form-decoded where it is encoded; malformed escapes pass through."""
    return F.when(is_encoded(value), F.url_decode(F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25"))).otherwise(value)


def pattern_regex(pattern: Column) -> Column:
    """A regular expression with the pattern's meaning: `*` skips to the first place that fits, a last `$` ends."""
    exact = pattern.endswith("$")
    body = F.regexp_replace(pattern, r"\$\z", "")
    quoted = F.transform(F.split(body, r"\*", -1), lambda x: F.concat(F.lit("\\Q"), F.replace(normalized_path(x), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    rest = F.transform(F.slice(quoted, F.lit(2), F.size(quoted)), lambda q: F.concat(F.lit("(?>(?s:.*?)"), q, F.lit(")")))
    return F.concat(F.lit("^"), F.element_at(quoted, 1), F.array_join(rest, ""), F.when(exact, "\\z").otherwise(""))


#: Letters of an inner probe, and those of a first piece that make it a probe for a pattern with wildcards.
GRAM, FIRST = 3, 2


def probe(pattern: Column) -> Column:
    """What a path must have for the pattern to match it: `=` and the path, `^` and its beginning, or `*` and letters inside.

    Without a wildcard that is the pattern itself; with one it is the first piece, or, where that is shorter than
    FIRST, the first GRAM letters of the longest later piece.
    """
    body = F.regexp_replace(pattern, r"\$\z", "")
    pieces = F.transform(F.split(body, r"\*", -1), normalized_path)
    first, later = F.element_at(pieces, 1), F.slice(pieces, F.lit(2), F.size(pieces))
    longest = F.element_at(F.array_sort(F.transform(later, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), 1)["x"]
    beginning = F.concat(F.lit("^"), first)
    inside = F.when(F.length(longest) >= GRAM, F.concat(F.lit("*"), F.substring(longest, 1, GRAM))).otherwise(beginning)
    plain = F.when(pattern.endswith("$"), F.concat(F.lit("="), first)).otherwise(beginning)
    return F.when(F.size(pieces) == 1, plain).when(F.length(first) >= FIRST, beginning).otherwise(inside)


def path_probes(path: Column, lengths: Column, inside: Column) -> Column:
    """All probes that a normalized path answers to: beginnings of the given lengths and, where asked, letters inside."""
    n = F.length(path)
    beginnings = F.transform(F.filter(lengths, lambda k: k <= n), lambda k: F.concat(F.lit("^"), F.substring(path, F.lit(1), k)))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - (GRAM - 1), F.lit(1))), lambda i: F.concat(F.lit("*"), F.substring(path, i, F.lit(GRAM))))
    grams = F.when(inside & (n >= GRAM), F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.concat(F.lit("="), path)), beginnings, grams)


def matches(pattern: Column, regex: Column, path: Column) -> Column:
    """An empty pattern matches nothing; `path` must be normalized, `regex` that of the pattern."""
    return (F.length(pattern) > 0) & F.rlike(path, regex)


def product_token_valid(token: Column) -> Column:
    return (token == "*") | token.rlike("^[a-zA-Z_-]+$")


def product_token_equal(a: Column, b: Column) -> Column:
    return F.coalesce(F.lower(a) == F.lower(b), F.lit(False))
