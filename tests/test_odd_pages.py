"""Queries over pages with missing values and odd numbers, against their SQL."""

import pytest

from gossamer.plans.catalog import ORACLE, QUERIES

LINKS = '<a href="/aa">a</a><a href="/bb">b</a><a href="/cc">c</a>'


def compared(spark, folder, name, *rows):
    """Runs a query and its SQL on pages (page_id, url, html)."""
    duckdb = pytest.importorskip("duckdb")
    db, path = duckdb.connect(), f"{folder}/pages.parquet"
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    db.execute(f"COPY pages TO '{path}'")
    cursor = db.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r)) for r in QUERIES[name](spark, str(folder)).select(*columns).collect()) == want


def test_links_of_pages_without_url_are_not_asked(spark, tmp_path):
    compared(spark, tmp_path, "links_robots_filtered", (0, None, LINKS), (1, None, LINKS), (3, "http://a.example/x", LINKS))


def test_pages_without_url_are_fetched(spark, tmp_path):
    compared(spark, tmp_path, "crawl_fetch_lenient", (0, "http://a.example/x", ""), (6, None, ""), (7, None, ""), (8, "http://a.example/x", ""))


@pytest.mark.parametrize("name", ["crawl_fetch_rendered", "crawl_fetch_lenient"])
def test_status_of_odd_numbers(spark, tmp_path, name):
    compared(spark, tmp_path, name, *[(n, f"http://a.example/{n}", "") for n in (-7, -6, -5, -2, -1, 0, 1, 6, None)])
