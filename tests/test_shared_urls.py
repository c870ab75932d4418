"""Queries over stored pages of which some share a URL, against their SQL."""

import os

import pytest

from gossamer.operators import robots
from gossamer.plans.catalog import ORACLE, QUERIES

PAGES = "/root/testdata/sf0.001/pages.parquet"
#: Pages with children that share the URL of a page nearer to the start.
DEEP = {20: 1, 23: 2, 33: 10}


def compared(spark, folder, names, shared, own_text=False):
    """Runs queries and their SQL on the smallest pages and some (numbers) that have the URL of another, and its text or their own."""
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isfile(PAGES):
        pytest.skip("no test tables here")
    db, path = duckdb.connect(), f"{folder}/pages.parquet"
    copies = ", ".join(f"({a}, {b})" for a, b in shared.items())
    rest, own = f"SELECT page_id, url, html FROM '{PAGES}' WHERE page_id NOT IN (SELECT a FROM c)", f"SELECT a, u.url, t.html FROM c JOIN '{PAGES}' u ON u.page_id = b JOIN '{PAGES}' t ON t.page_id = {'a' if own_text else 'b'}"
    db.execute(f"COPY (WITH c(a, b) AS (VALUES {copies}) SELECT * FROM ({rest} UNION ALL {own}) ORDER BY page_id) TO '{path}'")
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}'")
    for name in names:
        frame = QUERIES[name](spark, str(folder))
        cursor = db.execute(ORACLE[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(map(repr, (tuple(r) for r in frame.select(*columns).collect()))) == sorted(map(repr, cursor.fetchall())), name


@pytest.mark.parametrize("name", ["crawl_order", "crawl_bfs", "crawl_summary", "crawl_result_diff", "crawl_with_robots"])
def test_crawls_keep_pages_apart(spark, tmp_path, name):
    compared(spark, tmp_path, [name], DEEP)


#: Copies whose lines are those of the page at each place, so that the SQL leaves no tie open: of 19 with the same beginning, of 26 with another.
COPIES = {229: 19, 47: 26}


@pytest.mark.parametrize("name", ["robots_lines", "robots_directives", "robots_groups", "robots_allowed", "robots_crawl_delay"])
def test_robots_texts_of_a_url_share_their_lines(spark, tmp_path, name):
    compared(spark, tmp_path, [name], COPIES)


@pytest.mark.parametrize("name", ["crawl_fetch_lenient", "crawl_fetch_rendered", "crawl_fetch_status"])
def test_fetch_gives_each_stored_page_once(spark, tmp_path, name):
    compared(spark, tmp_path, [name], {24: 0, 6: 1, 7: 1})


def test_rules_hold_for_the_links_of_all_pages_of_a_url(spark, tmp_path):
    """No ties: whichever line of the two pages comes first, the result is the same."""
    compared(spark, tmp_path, ["links_robots_filtered"], {0: 9}, own_text=True)


def stated(spark, *lines):
    """Directive lines of a site, in one partition and in this order."""
    return spark.createDataFrame([("s", 0, 1, *line) for line in lines], "site string, line_no int, block long, directive string, value string, agents array<string>").coalesce(1)


def test_delays_in_the_same_line_do_not_depend_on_order(spark):
    for values in (("9", "5"), ("5", "9")):
        assert [r.delay for r in robots.crawl_delays(stated(spark, *[("crawl-delay", v, ["a"]) for v in values])).collect()] == [5]


def test_hosts_in_the_same_line_do_not_depend_on_order(spark):
    for values in (("b.org", "a.org"), ("a.org", "b.org")):
        assert [r.host for r in robots.hosts(stated(spark, *[("host", v, []) for v in values])).collect()] == ["a.org"]


def test_sitemap_limits_hold_for_all_pages_of_a_url(spark, tmp_path):
    compared(spark, tmp_path, ["sitemap_limits"], {0: 9, 40: 47})
