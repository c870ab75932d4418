"""Cutting lineage in loops: a table in the folder that all machines share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; without that setting a temporary one, where all tasks run in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "gossamer-rounds")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes `df` to a shared folder and reads it back; survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A part of a Gathered stays apart while it has so many times the rows of the next one.
GROWTH = 4


class Gathered:
    """A table that grows by a part each round; parts are merged like those of a sorted log, so there are few of
    them, and a row is written again a logarithmic number of times."""

    def __init__(self):
        self.parts: list[tuple[DataFrame, int]] = []

    def add(self, part: DataFrame, rows: int) -> None:
        self.parts.append((part, rows))
        while len(self.parts) > 2 and self.parts[-2][1] < GROWTH * self.parts[-1][1]:
            (a, m), (b, n) = self.parts[-2:]
            self.parts[-2:] = [(cut(a.unionByName(b)), m + n)]

    def all(self) -> DataFrame:
        out = self.parts[0][0]
        for part, _ in self.parts[1:]:
            out = out.unionByName(part)
        return out


def ranked(df: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """Adds the row number of each row (from 0) in `order`: its place in a sorted range and the counts of the ranges before.

    No task holds more than a range; what one task sees whole is a count for each range.
    """
    ranges = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    ranges = ranges.withColumn("_range", F.shiftright("_place", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    place = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    return ranges.join(F.broadcast(counts), "_range").select(*df.columns, place.alias(name))
