"""python -m gossamer.cli -e https://site/ -o folder: crawls a live site and writes its URLs, one a line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from gossamer.operators.crawl import Options
from gossamer.operators.site import crawl_site
from gossamer.sources.pages import fetch_live, write_urls


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="gossamer", description=__doc__)
    p.add_argument("-e", "--entry", required=True, help="URL to start from")
    p.add_argument("-o", "--output", required=True, help="folder for the result")
    p.add_argument("-t", "--threads", type=int, default=8, help="parallel connections")
    p.add_argument("-m", "--max-pages", type=int, default=10_000)
    p.add_argument("-d", "--delay", type=float, default=0.0, help="seconds between requests of a connection")
    p.add_argument("-r", "--respect-robots", action="store_true", help="obey robots.txt and meta robots")
    p.add_argument("-a", "--user-agent")
    p.add_argument("-c", "--cookie")
    return p.parse_args(argv)


def options(args: argparse.Namespace) -> Options:
    """One switch for robots.txt and meta robots alike."""
    return Options(user_agent=args.user_agent, max_pages=args.max_pages, crawl_delay=args.delay, respect_robots_txt=args.respect_robots, respect_meta_robots=args.respect_robots)


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    spark = SparkSession.builder.appName("gossamer").getOrCreate()

    def fetch(wanted):
        return fetch_live(wanted, parallelism=args.threads, user_agent=args.user_agent, cookie=args.cookie)

    write_urls(crawl_site(spark, args.entry, fetch, options(args)), args.output)


if __name__ == "__main__":
    main()
