"""Whole crawls of a stored site."""

import pytest
from pyspark.sql import functions as F

from gossamer import cli
from gossamer.operators.crawl import Options
from gossamer.operators.site import Hooks, RobotsError, crawl_site, from_store
from gossamer.sources.sitemaps import SitemapError

N = 106
LINKS = ["/", "/contact", "/book-meeting", *[f"/page-{i}" for i in range(N - 3)]]
ROBOTS = "User-agent: *\nDisallow: /book-meeting\nDisallow: /contact\n\nSitemap: http://site/other.xml"
SITEMAP = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' + "".join(f"<url><loc>{h}</loc></url>" for h in LINKS) + "</urlset>"


def store(spark, html, extra=()):
    pages = [(f"http://site{h}", 200, "text/html", html) for h in LINKS]
    files = [("http://site/robots.txt", 200, "text/plain", ROBOTS), ("http://site/sitemap.xml", 200, "application/xml", SITEMAP), *extra]
    return from_store(spark.createDataFrame([*pages, *files], "url string, status int, content_type string, body string"))


def visited(spark, fetch, **options):
    return {r.url for r in crawl_site(spark, "http://site/", fetch, Options(**options)).collect()}


def test_static_site(spark):
    html = "".join(f'<a href="{h}">x</a>' for h in LINKS) + '<a href="#a">a</a><a href="/f.pdf">f</a><a href="http://other/">o</a>'
    assert visited(spark, store(spark, html), respect_robots_txt=False) == {f"http://site{h}" for h in LINKS}


def test_sitemap_and_robots(spark):
    seen = []
    fetch = store(spark, "<p>no links</p>")
    got = {r.url for r in crawl_site(spark, "http://site/", fetch, Options(), analyze=lambda pages: seen.append(pages.count())).collect()}
    assert got == {f"http://site{h}" for h in LINKS} - {"http://site/contact", "http://site/book-meeting"} and len(got) == 104
    assert sum(seen) == 104
    assert len(visited(spark, fetch, max_pages=10)) == 10


def test_gates_canonical_and_failures(spark):
    page = lambda i, body, status=200: (f"http://s/{i}", status, "text/html", body)
    rows = [
        page("", '<a href="/a">a</a><a href="/A">A</a><a href="/b">b</a><a href="/gone">g</a><a href="/c">c</a>'),
        page("a", '<link rel="canonical" href="/canon"><a href="/">back</a>'),
        page("b", '<meta name="robots" content="noindex, follow"><a href="/d">d</a>'),
        page("c", '<meta name="robots" content="index, nofollow"><a href="/e">e</a>'),
        page("d", ""), page("e", ""), page("gone", "not found", 404),
    ]
    fetch = from_store(spark.createDataFrame(rows, "url string, status int, content_type string, body string"))
    run = lambda **o: {r.url for r in crawl_site(spark, "http://s/", fetch, Options(**o)).collect()}
    assert run() == {"http://s/", "http://s/canon", "http://s/b", "http://s/c", "http://s/d", "http://s/e"}
    assert run(strict=False) == {"http://s/", "http://s/canon", "http://s/c", "http://s/d"}
    assert "http://s/gone" in run(loader="lenient")


def test_no_answer(spark):
    nothing = from_store(spark.createDataFrame([], "url string, status int, content_type string, body string"))
    assert visited(spark, nothing) == set()


def test_arguments():
    args = cli.arguments(["-e", "http://a", "-o", "out", "-m", "5", "-r", "-a", "Bot"])
    made = cli.options(args)
    assert made.max_pages == 5 and made.respect_robots_txt and made.respect_meta_robots and made.user_agent == "Bot"


def test_faulty_files_abort_the_crawl(spark):
    page = ("http://s/", 200, "text/html", "<a href='/a'>a</a>")
    big = ("http://s/robots.txt", 200, "text/plain", "#" * (500 * 1024 + 1))
    fetch = from_store(spark.createDataFrame([page, big], "url string, status int, content_type string, body string"))
    with pytest.raises(RobotsError):
        crawl_site(spark, "http://s/", fetch)
    assert [r.url for r in crawl_site(spark, "http://s/", fetch, Options(abort=False)).collect()] == ["http://s/"]
    lines = ("http://s/sitemap.xml", 200, "text/plain", "not absolute")
    with pytest.raises(SitemapError):
        crawl_site(spark, "http://s/", from_store(spark.createDataFrame([page, lines], "url string, status int, content_type string, body string")))


def test_hooks_and_the_delay_of_robots_txt(spark):
    rows = [("http://s/", 200, "text/html", "go:/x go:/y stop:/z"), ("http://s/x", 200, "text/html", "as:/seen"), ("http://s/y", 200, "text/html", "closed"), ("http://s/robots.txt", 200, "text/plain", "User-agent: *\nCrawl-delay: 3")]
    store, delays = spark.createDataFrame(rows, "url string, status int, content_type string, body string"), []

    def fetch(wanted):
        delays.append({r.delay for r in wanted.collect()})
        return from_store(store)(wanted)

    hooks = Hooks(
        collect_links=lambda html: F.regexp_extract_all(html, F.lit("go:([^ ]+)"), F.lit(1)),
        canonical=lambda html: F.nullif(F.regexp_extract(html, "as:([^ ]+)", 1), F.lit("")),
        robots_rules=lambda html, ignore: F.struct((html != "closed").alias("index"), F.lit(True).alias("follow")),
    )
    assert {r.url for r in crawl_site(spark, "http://s/", fetch, hooks=hooks).collect()} == {"http://s/", "http://s/seen"}
    assert {3.0} in delays and delays[0] == {0.0}
    none = Hooks(keep=lambda href: F.lit(False))
    assert [r.url for r in crawl_site(spark, "http://s/", fetch, hooks=none).collect()] == ["http://s/"]
