"""The URLs that a crawl has discovered: stored by hash bucket, with a Bloom filter for each bucket.

A round asks for its candidates only: what no Bloom filter knows is new at once, the rest is compared with the
URLs of the buckets that it falls into, and other buckets are not read.  What a round adds is a part of its own;
parts are merged once an older one is less than GROWTH times as large, so that there are few of them and a URL is
written again a logarithmic number of times.  Up to PER_BUCKET URLs there is one bucket, without filters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gossamer.operators.lineage import shared_folder

PER_BUCKET = 200_000
GROWTH = 4
#: Bits of one block of a filter (the size of Spark's bitmaps), those that a URL sets in it, and bits a URL.
BLOCK_BITS, SET_BITS, BITS_PER_URL = 32_768, 4, 12
#: A filter's own seed, so that its bits do not follow from the bucket.
_SEED = "filter"


def counted(df: DataFrame, path: str, by: str | None = None, **more: Column) -> dict:
    """Writes `df` to `path`, in folders by a column if named; its number of rows (n) and other aggregates, taken while it is written."""
    told = Observation()
    write = df.observe(told, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in more.items()]).write
    (write.partitionBy(by) if by else write).parquet(path)
    return {"n": 0} | told.get


@dataclass
class Part:
    path: str
    rows: int
    told: dict


class SeenUrls:
    """`rows` (url, ..) of all rounds; every call works on the table that a round brings."""

    def __init__(self, spark: SparkSession, per_bucket: int = PER_BUCKET):
        self.spark, self.per_bucket = spark, per_bucket
        self.buckets, self.parts, self.schema = 1, [], None

    def __len__(self) -> int:
        return sum(p.rows for p in self.parts)

    # Places of a URL

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("url"), F.lit(self.buckets)).cast("int")

    def _blocks(self) -> int:
        return max(1, self.per_bucket * BITS_PER_URL // BLOCK_BITS)

    def _block(self) -> Column:
        return F.pmod(F.shiftright(F.xxhash64("url"), 32), F.lit(self._blocks())).cast("int")

    @staticmethod
    def _bits() -> Column:
        own = F.xxhash64(F.lit(_SEED), F.col("url"))
        return F.array(*[F.shiftright(own, 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(SET_BITS)])

    # Tables

    def _write(self, rows: DataFrame, **more: Column) -> Part:
        path = shared_folder(self.spark)
        if self.buckets == 1:
            told = counted(rows, f"{path}/urls", **more)
            return Part(path, told["n"], told)
        dealt = rows.withColumn("_bucket", self.bucket()).repartition("_bucket")
        told = counted(dealt, f"{path}/urls", by="_bucket", **more)
        part = Part(path, told["n"], told)
        marks = self._urls(part).select("_bucket", self._block().alias("block"), F.explode(self._bits()).alias("bit"))
        filters = marks.groupBy("_bucket", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))
        filters.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/filters")
        return part

    def _urls(self, part: Part, buckets: list[int] | None = None) -> DataFrame:
        if self.buckets == 1:
            return self.spark.read.schema(self.schema).parquet(f"{part.path}/urls")
        stored = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])).parquet(f"{part.path}/urls")
        return stored if buckets is None else stored.where(F.col("_bucket").isin(buckets))

    def _filters(self, buckets: list[int]) -> DataFrame:
        read = self.spark.read.schema("block int, bits binary, _bucket int")
        out = None
        for part in self.parts:
            one = read.parquet(f"{part.path}/filters").where(F.col("_bucket").isin(buckets))
            out = one if out is None else out.unionByName(one)
        return out.groupBy("_bucket", "block").agg(F.bitmap_or_agg("bits").alias("bits"))

    def all(self) -> DataFrame:
        """All rows of all rounds."""
        return self._union()

    def _union(self, buckets: list[int] | None = None) -> DataFrame:
        out = None
        for part in self.parts:
            one = self._urls(part, buckets)
            out = one if out is None else out.unionByName(one)
        return out.drop("_bucket")

    # Rounds

    def new(self, found: DataFrame) -> DataFrame:
        """The rows of `found` (url, ..) whose URL no round has added; case counts."""
        if not self.parts:
            return found
        if self.buckets == 1:
            return found.join(self._union().select("url"), "url", "left_anti")
        asked, names = shared_folder(self.spark), found.columns
        keyed = found.withColumns({"_bucket": self.bucket(), "_block": self._block(), "_bits": self._bits()})
        hit = counted(keyed, asked, hit=F.collect_set("_bucket")).get("hit")
        if not hit:
            return found
        keyed = self.spark.read.schema(keyed.schema).parquet(asked)
        filters = self._filters(sorted(hit)).withColumnRenamed("block", "_block")
        octet = lambda bit: F.conv(F.hex(F.substring(F.col("bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        known = F.coalesce(F.forall("_bits", lambda bit: F.getbit(octet(bit), (bit % 8).cast("int")) == 1), F.lit(False))
        tested = keyed.join(filters, ["_bucket", "_block"], "left").select(*names, "_bucket", known.alias("_known"))
        told = counted(tested, flagged := shared_folder(self.spark), hit=F.collect_set(F.when(F.col("_known"), F.col("_bucket"))))
        tested = self.spark.read.schema(tested.schema).parquet(flagged)
        if not told.get("hit"):
            return tested.select(*names)
        stored = self._union(sorted(told["hit"])).select("url")
        doubted = tested.where("_known").join(stored, "url", "left_anti")
        return tested.where("NOT _known").unionByName(doubted).select(*names)

    def add(self, rows: DataFrame, **more: Column) -> tuple[DataFrame, dict]:
        """Stores `rows` (url, .., each URL new and once); the stored table, and its number of rows (n) and other aggregates."""
        self.schema = self.schema or rows.schema
        part = self._write(rows, **more)
        out = self._urls(part).drop("_bucket")
        if part.rows:
            self.parts.append(part)
            self._tidy()
        return out, part.told

    def admit(self, found: DataFrame, **more: Column) -> tuple[DataFrame, dict]:
        """new() and add() in one."""
        return self.add(self.new(found), **more)

    def _tidy(self) -> None:
        if len(self) > self.buckets * self.per_bucket:
            rows, count = self._union(), len(self)
            while count > self.buckets * self.per_bucket // 2:
                self.buckets *= 2
            self.parts = [self._write(rows)]
            return
        while len(self.parts) > 1 and self.parts[-2].rows < GROWTH * self.parts[-1].rows:
            last = self.parts[-2:]
            rows = self._urls(last[0]).unionByName(self._urls(last[1])).drop("_bucket")
            self.parts[-2:] = [self._write(rows)]
