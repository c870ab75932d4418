"""Where pages come from and where results go."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.functions.urls import authority
from gossamer.sources.live import RESPONSE, fetch_all

def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def fetch_live(urls: DataFrame, parallelism: int = 8, timeout: float = 30.0, user_agent: str | None = None, cookie: str | None = None, delay: float = 0.0, retries: int = 0) -> DataFrame:
    """Responses of live servers for `urls` (url, and delay where rows have their own): RESPONSE rows, errors as a column.

    One connection at a time per partition, `parallelism` partitions.  With a delay all URLs of a site come
    to one partition, and the seconds pass between any two requests to the site.
    """
    headers = {k: v for k, v in (("User-Agent", user_agent), ("Cookie", cookie)) if v}
    wanted = urls.select("url", (F.col("delay") if "delay" in urls.columns else F.lit(delay)).cast("double").alias("delay"))
    site = F.when(F.col("delay") > 0, authority(F.col("url"))).otherwise(F.col("url"))
    wanted = wanted.groupBy("url").agg(F.max("delay").alias("delay")).withColumn("site", site)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for frame in frames:
                yield from zip(frame["url"], frame["site"], frame["delay"], strict=True)

        fetched = fetch_all(rows(), headers, timeout, retries)
        while part := list(itertools.islice(fetched, 64)):
            yield pd.DataFrame(part, columns=["url", "status", "content_type", "body", "error"])

    return wanted.repartition(parallelism, "site").mapInPandas(run, RESPONSE)


def show_lines(lines: DataFrame, column: str = "line", most: int = 1000) -> None:
    """The first log lines on the driver's console."""
    for row in lines.select(column).limit(most).toLocalIterator():
        print(row[0])


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a text written by write_urls()."""
    return spark.read.text(path).select(F.col("value").alias("url"))


def write_urls(visited: DataFrame, path: str) -> None:
    """One URL a line."""
    visited.select(F.col("url").alias("value")).write.mode("overwrite").text(path)


def json_links(manifests: DataFrame) -> DataFrame:
    """(id, name, href) of JSON manifests (id, body): arrays of objects with name and href."""
    links = F.from_json("body", "array<struct<name:string,href:string>>")
    return manifests.select("id", F.explode(links).alias("l")).select("id", "l.name", "l.href")
