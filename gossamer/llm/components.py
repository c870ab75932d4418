"""Connected components of an edge table, by repeated hooking to the smallest neighbour and short cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import stage

#: Rounds after which the loop is given up as faulty; lengths of paths at least halve in a round.
MOST_ROUNDS = 60
#: Parts into which the children of one parent are dealt.
SALTS = 16


def salted_join(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """`rows` joined with the one row of `table` for their key; the rows of a frequent key are dealt into SALTS parts by `by`."""
    copies = table.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(copies, [key, "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a long, b long), where root is the least node of its component.

    Rows with equal ends or nulls are ignored.  Each round is staged; the driver sees two counts only.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stage(pairs)
    for _ in range(MOST_ROUNDS):
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        hooked = pairs.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = hooked.unionByName(least.select("u", F.col("m").alias("v")))
        # many nodes may share a parent v: its own parent is looked up once, and comes back in SALTS copies
        above = least.select(F.col("u").alias("v"), F.col("m")).join(now.select("v").distinct(), "v")
        above = above.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
        salted = now.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))
        now = stage(salted.join(above, ["v", "salt"], "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        branching = now.groupBy("u").count().where("count > 1").limit(1).count()
        if not branching and not now.select("v").distinct().join(now.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        pairs = now
    raise RuntimeError("components did not settle")
