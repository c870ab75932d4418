"""Queries that have all rows of their SQL."""

import functools

import test_odd_pages as odd
from gossamer.operators import crawl
from test_shared_urls import DEEP, compared


def test_whole_crawl_has_no_page_cap(spark, tmp_path, monkeypatch):
    """With a default cap below the number of pages that the crawl reaches."""
    monkeypatch.setattr(crawl.Options, "__init__", functools.partialmethod(crawl.Options.__init__, max_pages=20))
    compared(spark, tmp_path, ["crawl_site_stored"], DEEP)


def test_broken_sitemaps_of_pages_that_share_a_url(spark, tmp_path):
    compared(spark, tmp_path, ["sitemap_records_broken"], {0: 9, 40: 47, 41: 47}, own_text=True)


def test_broken_sitemaps_of_odd_pages(spark, tmp_path):
    odd.compared(spark, tmp_path, "sitemap_records_broken", (0, None, odd.LINKS), (1, None, odd.LINKS), (2, "http://a.example/x", None), (3, "http://a.example/x", odd.LINKS), (-1, "http://a.example/y", odd.LINKS), (5, "http://a.example/z", ""))


def test_patterns_of_both_kinds_of_rules_come_twice(spark, tmp_path):
    """Values end at a blank, so that both rules of the page are for /x."""
    odd.compared(spark, tmp_path, "robots_pattern_compile", (7, "http://a.example/x", '<a href="/x y">a</a><a href="/x z">b</a>'))


def test_lines_of_pages_without_url(spark, tmp_path):
    odd.compared(spark, tmp_path, "robots_lines", (0, None, odd.LINKS), (1, None, odd.LINKS), (6, None, None), (3, "http://a.example/x", odd.LINKS), (4, "http://a.example/y", None))


def test_lines_of_large_texts(spark, tmp_path):
    """A text of more than 500 KiB."""
    odd.compared(spark, tmp_path, "robots_lines", (1, "http://a.example/x", "".join(f'<a href="/{n:0>100}">a</a>' for n in range(9000))))


def test_directives_of_pages_without_url(spark, tmp_path):
    odd.compared(spark, tmp_path, "robots_directives", (0, None, odd.LINKS), (1, None, odd.LINKS), (3, "http://a.example/x", odd.LINKS))


def test_pages_without_html_are_asked_for_robots_txt(spark, tmp_path):
    odd.compared(spark, tmp_path, "robots_allowed", (1, "http://a.example/x", None), (3, "http://a.example/y", odd.LINKS))
