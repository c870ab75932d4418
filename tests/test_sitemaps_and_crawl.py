"""Sitemaps, links of pages, the crawl loop, the stream and the registered queries."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gossamer.operators import crawl, links
from gossamer.operators.lineage import cut
from gossamer.sources import pages as sources
from gossamer.sources import sitemaps

HEAD = '<?xml version="1.0"?>\n<!-- c -->\n'
SPACE = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
ITEM = "<url><loc>{0}</loc><lastmod>{1}</lastmod><changefreq>{2}</changefreq><priority>{3}</priority></url>"


def xml(spark, *bodies):
    return spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "site string, xml string")


def test_kind(spark):
    rows = xml(spark, f"{HEAD}<urlset {SPACE}></urlset>", f"<sitemapindex {SPACE}/>", "<urlset></urlset>", "<html xmlns='x'>", "", f"<other {SPACE}>")
    assert [r.k for r in rows.select("site", sitemaps.kind(F.col("xml")).alias("k")).orderBy("site").collect()] == ["urlset", "sitemapindex", None, None, None, None]


def test_urlset(spark):
    body = HEAD + f"<urlset {SPACE}>" + ITEM.format("http://a/1", "2023-06-01", "daily", "0.8") + ITEM.format("/rel", "2023-05-12", "MONTHLY", "0.5") + "<url><loc>http://a/3</loc></url>" + ITEM.format("http://a/4", "not a date", "hourly", "high") + "</urlset>"
    rows = {r.loc: r for r in sitemaps.urlset(xml(spark, body, f"<urlset {SPACE}><url>")).collect() if r.loc}
    assert str(rows["http://a/1"].lastmod) == "2023-06-01 00:00:00" and rows["http://a/1"].changefreq == "Daily" and float(rows["http://a/1"].priority) == 0.8
    assert rows["/rel"].changefreq == "Monthly" and rows["http://a/3"].lastmod is None and rows["http://a/3"].error is None
    assert rows["http://a/4"].error == "invalid lastmod"
    for since, want in (("2023-05-12", {"http://a/1", "/rel", "http://a/3", "http://a/4"}), ("2023-05-13", {"http://a/1", "http://a/3", "http://a/4"}), ("2024-01-01", {"http://a/3", "http://a/4"})):
        assert {r.loc for r in sitemaps.urlset(xml(spark, body), F.lit(since).cast("timestamp")).collect()} == want


def test_text_sitemaps(spark):
    texts = spark.createDataFrame([("ok", "http://a/1\n\n http://a/2 \r\n"), ("bad", "no url"), ("full", "http://a\n" * 50_000), ("over", "http://a\n" * 50_001), ("empty", "")], "site string, txt string")
    rows = sitemaps.text(texts)
    assert [(r.line_no, r.loc) for r in rows.where("site = 'ok'").orderBy("line_no").collect()] == [(0, "http://a/1"), (2, "http://a/2")]
    assert {(r.site, r.error): r.n for r in rows.groupBy("site", "error").agg(F.count("*").alias("n")).collect()} == {("ok", None): 2, ("bad", "invalid url"): 1, ("full", None): 50_000, ("over", "sitemap is too large"): 1}


def test_expansion_follows_cycles_once(spark):
    index = lambda *locs: f"<sitemapindex {SPACE}>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"
    files = spark.createDataFrame(
        [("http://a/i", "text/xml", index("http://a/j", "http://a/t")), ("http://a/j", "text/xml", index("http://a/i", "http://a/u", "relative")), ("http://a/u", "text/xml", f"<urlset {SPACE}><url><loc>http://a/1</loc></url></urlset>"), ("http://a/t", "text/plain", "http://a/2")],
        "loc string, content_type string, body string",
    )
    start = spark.createDataFrame([("s", "http://a/i")], "site string, loc string")
    assert {r.loc for r in sitemaps.expand(start, files, cut=cut).collect()} == {"http://a/1", "http://a/2"}


def site(spark, n=106):
    """Pages that all link to each other, as stored pages."""
    anchors = "".join(f'<a class="x" href="/p{i}">p{i}</a>' for i in range(n))
    html = f'<!-- <a href="/hidden">h</a> --><script>"<a href=\\"/script\\">"</script>{anchors}<a href="#t">t</a><a href="mailto:a@b">m</a><a href="/f.pdf">f</a><a name="n">n</a><a href="http://other/x">o</a>'
    rows = [(i, f"http://site/p{i}", html) for i in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_every_page_is_visited_once(spark):
    pages = site(spark)
    found = links.on_site(links.extract(pages)).select(F.col("url").alias("src"), F.col("target").alias("dst"))
    seeds = spark.createDataFrame([("http://site/p0",)], "url string")
    visited = crawl.crawl(seeds, found)
    assert visited.count() == 106 and visited.select("url").distinct().count() == 106
    assert crawl.result_diff(visited, pages).count() == 0
    assert crawl.crawl(seeds, found, max_pages=10).count() == 10
    two = pages.select("url", (F.col("page_id") % 2 == 0).alias("index"), (F.col("page_id") == 0).alias("follow"))
    assert crawl.crawl(seeds, found, two).count() == 53


def test_links_of_a_page(spark):
    html = "<A HREF = \"/a\">x</a><a data-href=\"/no\">y</a><a\nclass='k' href=\"/b?x=1&amp;y=2\">z</a><abbr href=\"/c\"></abbr><a href=/bare>q</a><a>none</a>"
    page = spark.createDataFrame([(1, "http://h/d/e", html), (2, "http://h", None)], "page_id long, url string, html string")
    assert [r.href for r in links.extract(page).orderBy("pos").collect()] == ["/a", "/b?x=1&y=2", "/bare"]
    assert page.select(links.parsed_hrefs("html")).first()[0] == ["/a", None, "/b?x=1&y=2", "/bare", None]
    same = spark.createDataFrame([(1, "http://h/", "<a href=\"/A\"></a><a href=\"/a\"></a><a href=\"b\"></a>")], "page_id long, url string, html string")
    assert [r.target for r in links.distinct_per_page(links.on_site(links.extract(same))).orderBy("pos").collect()] == ["http://h/A", "http://h/b"]


HOSTILE = [
    "<a href='/x'>", "<a href=/y>", '<a href="/z?a=1&amp;b=2">', "<a title='a > b' href=\"/t\">", '<a data-x=" href=/no " HREF\n=\n"/m">', "<a/href=/s>",
    "<a href='/q\"q'>", '<a href="/e&#233;&#xE9;&eacute;x">', "<a href='/amp&amp;amp;'>", "<a disabled href=/d class=c>", "<a hrefx=/no>", "<abbr href=/no>", "<a href=''>",
    "<script>'<a href=/no>'</script>", "<style>a{}<a href=/no></style>", "<!-- <a href=/no> -->", "<a href=/u?x=a'b>", "<a href = '/sp ace'>",
]


def test_links_of_hostile_markup_equal_the_parser(spark):
    pages = spark.createDataFrame([(i, "http://h/", f"<p>{h}text</a>") for i, h in enumerate(HOSTILE)] + [(99, "http://h/", "".join(HOSTILE)), (100, "http://h/", "<a" + " x=1" * 3000 + " href=/far>")], "page_id long, url string, html string")
    mine, parsed = (dict(pages.select("page_id", c).collect()) for c in (links.hrefs(pages.html), links.parsed_hrefs("html")))
    known = {"/e\u00e9\u00e9&eacute;x": "/e\u00e9\u00e9\u00e9x"}  # other named references stay as they are
    assert {i: [known.get(h, h) for h in hs] for i, hs in mine.items()} == {i: [h for h in hs if h is not None] for i, hs in parsed.items()}


def test_spellings_of_a_url_are_one(spark):
    html = "<a href='/a/./b'>1</a><a href='HTTP://H:80/a/b'>2</a><a href=/a/c/../b>3</a>"
    page = spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string")
    assert [r.target for r in links.distinct_per_page(links.on_site(links.extract(page))).collect()] == ["http://h/a/b"]


def test_rounds_end_with_the_cap_and_deep_graphs_stay_short(spark):
    edges = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(30)], "src string, dst string")
    seeds, rounds = spark.createDataFrame([("p0",)], "url string"), []
    assert crawl.crawl(seeds, edges, max_pages=3, analyze=lambda f: rounds.append(f.count())).count() == 3 and len(rounds) == 3
    assert crawl.crawl(seeds, edges).count() == 31


def test_schedule_of_a_large_site(spark):
    rows = [(i, f"http://s{0 if i % 10 else i}/{i}", f"s{0 if i % 10 else i}") for i in range(3000)]
    got = {r.page_id: r.start_s for r in crawl.schedule(spark.createDataFrame(rows, "page_id long, url string, site string").repartition(5), 0.5).collect()}
    large = [0, *[i for i in range(3000) if i % 10]]
    assert [got[i] for i in large] == [0.5 * k for k in range(len(large))] and all(got[i] == 0 for i in range(0, 3000, 10))


def test_deep_sitemap_indexes_are_followed_and_faults_may_abort(spark):
    space = f'xmlns="{sitemaps.NAMESPACE}"'
    files = [(f"http://s/{i}.xml", "application/xml", f"<sitemapindex {space}><sitemap><loc>http://s/{i + 1}.xml</loc></sitemap></sitemapindex>") for i in range(55)]
    files.append(("http://s/55.xml", "application/xml", f"<urlset {space}><url><loc>/end</loc><changefreq>hourly</changefreq></url></urlset>"))
    start, table = spark.createDataFrame([("http://s", "http://s/0.xml")], "site string, loc string"), cut(spark.createDataFrame(files, "loc string, content_type string, body string"))
    assert [r["loc"] for r in sitemaps.expand(start, table, cut=cut).collect()] == ["/end"]
    with pytest.raises(sitemaps.SitemapError, match="changefreq"):
        sitemaps.expand(spark.createDataFrame([("http://s", "http://s/54.xml")], "site string, loc string"), table, cut=cut, abort=True)


def test_loaders_and_switches(spark):
    pages = spark.createDataFrame([("a", 200), ("b", 204), ("c", 301), ("d", 404), ("e", 100)], "url string, status int")
    got = {k: {r.url for r in crawl.fetch(pages.select("url"), pages, k).collect()} for k in ("static", "rendered", "lenient")}
    assert got == {"static": {"a", "b"}, "rendered": {"a", "b", "e"}, "lenient": {"a", "b", "c", "d", "e"}}
    assert crawl.Options().ignore_meta and not crawl.Options(strict=False).ignore_meta


def test_sinks_and_manifests(spark, tmp_path):
    sources.write_urls(spark.createDataFrame([("http://a",), ("http://b",)], "url string"), str(tmp_path / "out"))
    lines = [line for f in os.listdir(tmp_path / "out") if f.startswith("part") for line in open(tmp_path / "out" / f).read().split()]
    assert sorted(lines) == ["http://a", "http://b"]
    body = json.dumps([{"name": "n", "href": "/h"}, {"name": "m", "href": "/i"}])
    assert [tuple(r) for r in sources.json_links(spark.createDataFrame([(1, body)], "id long, body string")).collect()] == [(1, "n", "/h"), (1, "m", "/i")]


def test_live_fetch_gives_errors_as_rows(spark):
    rows = sources.fetch_live(spark.createDataFrame([("http://127.0.0.1:9/none",), ("not a url",)], "url string"), parallelism=2, timeout=1).collect()
    assert len(rows) == 2 and all(r.error for r in rows)


def test_frontier_stream_passes_urls_once(spark, tmp_path):
    from gossamer.streaming import frontier

    pages = site(spark, 8)
    source, sink = str(tmp_path / "in"), str(tmp_path / "next")
    pages.write.parquet(source)
    stream = spark.readStream.schema(pages.schema).parquet(source)
    query = frontier.feed_back(frontier.discovered_stream(stream), pages, sink, str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert sorted(r.url for r in spark.read.parquet(sink).select("url").collect()) == sorted(r.url for r in pages.select("url").collect())


def test_registered_queries_match_duckdb(spark):
    """A few of the registered queries against their SQL, on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    from gossamer.plans.catalog import ORACLE, QUERIES

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    db = duckdb.connect()
    for t in ("pages", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name in ("links_extract", "links_extract_variants", "links_canonical", "links_frontier", "robots_groups", "robots_allowed", "sitemap_expand", "crawl_bfs", "crawl_schedule", "crawl_site_stored", "url_list", "log_format"):
        frame = QUERIES[name](spark, folder)
        cursor = db.execute(ORACLE[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(frame.columns)
        assert sorted(map(repr, (tuple(r) for r in frame.select(*columns).collect()))) == sorted(map(repr, cursor.fetchall())), name
    assert set(ORACLE) <= set(QUERIES)
