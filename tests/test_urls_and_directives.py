"""URL functions, link filters, directives and log lines on single values."""

import datetime

import pytest
from pyspark.sql import functions as F

from gossamer.functions import directives, logs, patterns, urls


def values(spark, column, *rows):
    frame = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, a string, b string" if isinstance(rows[0], tuple) else "i int, a string")
    return [r.v for r in frame.select("i", column.alias("v")).orderBy("i").collect()]


def test_absolute(spark):
    got = values(spark, urls.absolute(F.col("a"), F.col("b")), ("http://s", "/x"), ("http://s", "x/y"), ("http://s", "https://o/z"), ("http://s", "//o/z"), ("http://s", None), ("http://s", "mailto:x@y"))
    assert got == ["http://s/x", "http://s/x/y", "https://o/z", None, None, "mailto:x@y"]


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://Host.COM:80", "http://host.com/"),
        ("https://h:443/a/../b/./c/..", "https://h/b/"),
        ("https://h:8443/a?B=C#D", "https://h:8443/a?B=C#D"),
        ("http://h/../../x", "http://h/x"),
        ("http://h?q=/../", "http://h/?q=/../"),
        ("/relative", "/relative"),
    ],
)
def test_normalized(spark, url, want):
    assert values(spark, urls.normalized(F.col("a")), url) == [want]


def test_extension_and_page_links(spark):
    hrefs = ["/a.html", "/a.HTM", "/a.pdf", "/a.", "/a.b/c", "/p?v=1.5", "/a.html#x", "#top", "MAILTO:x@y", "tel:1", "/plain", None, "http://host.com"]
    assert values(spark, urls.extension(F.col("a")), *hrefs)[:7] == [".html", ".HTM", ".pdf", "", "", ".5", ".html#x"]
    assert values(spark, urls.is_page_link(F.col("a")), *hrefs) == [True, True, False, True, True, False, False, False, False, False, True, False, False]


def test_site_and_cuts(spark):
    assert values(spark, urls.authority(F.col("a")), "https://h:1/a", "http://h?x", "nothing") == ["https://h:1", "http://h", ""]
    assert values(spark, urls.without_query(F.col("a")), "http://h/a?b#c", "http://h/a#b?c", "x") == ["http://h/a", "http://h/a", "x"]
    assert values(spark, urls.trailing_slash(F.col("a")), "a", "a/") == ["a/", "a/"]
    assert values(spark, urls.same_site(F.col("a"), F.col("b")), ("HTTP://A.com/x", "http://a.COM"), ("http://a.com.evil.org", "http://a.com"), ("https://a.com", "http://a.com")) == [True, True, False]


def test_meta_robots(spark):
    rows = [None, "index, follow", "index,follow", "noindex", "NOFOLLOW", "all, noindex", "", "none, follow", "all"]
    got = [(v["index"], v["follow"]) for v in values(spark, directives.meta_robots(F.col("a")), *rows)]
    assert got == [(True, True), (True, True), (False, False), (False, False), (False, False), (False, True), (False, False), (False, True), (True, True)]
    assert values(spark, directives.effective_robots(F.col("a"))["index"], "noindex") == [True]
    assert values(spark, directives.effective_robots(F.col("a"), ignore_meta=False)["index"], "noindex") == [False]


def test_canonical_and_meta_content(spark):
    html = "<head><LINK href='/c' rel=\"canonical\"><meta content='noindex' name=robots><meta name='robots' content='none'></head>"
    assert values(spark, directives.canonical_href(F.col("a")), html, "<p>") == ["/c", None]
    assert values(spark, directives.meta_robots_content(F.col("a")), html, "<p>") == ["none", None]


def test_product_tokens(spark):
    assert values(spark, patterns.product_token_valid(F.col("a")), "*", "Some_bot-x", "", "a*", "bot/1", "b0t") == [True, True, False, False, False, False]
    assert values(spark, patterns.product_token_equal(F.col("a"), F.col("b")), ("Bot", "bOT"), ("a", "b"), ("a", None), (None, None)) == [True, False, False, False]


def test_log_lines(spark):
    at = datetime.datetime(2024, 1, 2, 3, 4, 5, 678000)
    frame = spark.createDataFrame([(at, "Warning", "it 'is' so", None), (at, "Error", None, "boom"), (at, "Critical", None, None)], "ts timestamp, level string, message string, exception string")
    got = [r[0] for r in frame.select(logs.line(F.col("ts"), F.col("level"), F.col("message"), F.col("exception"))).collect()]
    assert got == ["03:04:05.678 warn: it 'is' so", "03:04:05.678 fail: boom", None]
    text = frame.select(logs.highlighted(F.col("message"), "Blue", "DarkCyan")).first()[0]
    assert text == "\x1b[1m\x1b[34mit \x1b[39m\x1b[22m\x1b[36mis\x1b[39m\x1b[22m\x1b[1m\x1b[34m so\x1b[39m\x1b[22m"
    assert values(spark, logs.stripped(F.col("a")), text) == ["it is so"]
    assert [(s["code"], s["text"]) for s in values(spark, logs.segments(F.col("a")), "a\x1b[31mb\x1b[39m")[0]] == [("", "a"), ("31", "b"), ("39", "")]
    with pytest.raises(Exception, match="unknown log level"):
        values(spark, logs.tag(F.col("a")), "Loud")


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://a/%7eb%20c", "http://a/~b c"),
        ("http://a/caf%C3%A9?x=%c3%a9#%41", "http://a/café?x=é#A"),
        ("http://a/%2e%2E/b/%2e/c", "http://a/b/c"),
        ("http://a/b%2fc%3fd%25e%26%3d%2B+", "http://a/b%2Fc%3Fd%25e%26%3D%2B+"),
        ("http://a/100%/%zz/%u00e9/%4", "http://a/100%/%zz/%u00e9/%4"),
        ("http://a/%ff%41/x?%41", "http://a/%FF%41/x?A"),
        ("http://a/%0a%7f%5c", "http://a/%0A%7F%5C"),
    ],
)
def test_escapes_in_the_one_form_of_a_url(spark, url, want):
    assert values(spark, urls.normalized(F.col("a")), url) == [want]
    assert values(spark, urls.normalized(urls.normalized(F.col("a"))), url) == [want]
