"""The corpus pipeline: five stages over `documents`, each one operator of gossamer.llm.

Every stage works on all rows that its predecessor kept; between stages the rows are written as Parquet to
the shared folder and read again.  The first four return the columns of `documents` (n_chars is that of the
text as it then is); the last returns each kept document with its token ids and the text decoded from them.

Defined results: null and empty texts, and rows without a doc_id, pass the first two stages as they are; the
third keeps one row of those that are equal in doc_id and text, and every text without words; ties go to the
least doc_id; an empty table has no rows; every further column of `documents`, whatever its name, is kept (but
ids and decoded, which the last stage makes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.llm import bpe, decontaminate, jaccard, lines, toxicity
from gossamer.llm.common import settled, table


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and text of `docs`, all other columns in one, so that no operator's columns meet theirs."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("_rest"))


def _measured(packed: DataFrame, like: DataFrame) -> DataFrame:
    """`packed` rows in the columns of `like`, with n_chars measured anew where there is such a column."""

    def column(c: str):
        if c in ("doc_id", "text"):
            return F.col(c)
        return F.length("text").cast(like.schema[c].dataType).alias(c) if c == "n_chars" else F.col("_rest")[c].alias(c)

    return packed.select(*map(column, like.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores at its threshold or above go."""
    scored = toxicity.score(_packed(docs), toxicity.train(docs, table(spark, sf_dir, "labels")))
    return _measured(scored.where(F.col("score") < toxicity.THRESHOLD), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated line chunks go; a document of which nothing is left goes with them, all other text stays."""
    left = lines.remove(_packed(docs))
    return _measured(left.where((F.col("lines_removed") == 0) | (F.length(F.trim("text")) > 0)), docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least doc_id."""
    return _measured(jaccard.keep_first(_packed(docs)), docs)


def decontaminate_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark items go; a document that is mostly such spans goes as a whole."""
    return _measured(decontaminate.remove_spans(_packed(docs), table(spark, sf_dir, "benchmark")), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every kept document and what they decode to."""
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("benchmark decontamination", decontaminate_texts),
    ("BPE encoding and decoding", tokenize),
]
#: A trained classifier, content-defined chunks and BPE are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = settled(lambda step=step, docs=docs: step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
