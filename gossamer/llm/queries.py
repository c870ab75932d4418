"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gossamer.llm import decontaminate, html_text, jaccard, prefix_trie, vector_codes
from gossamer.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {"op7_decontaminate": decontaminate.ORACLE, "op9_jaccard": jaccard.ORACLE, "op10_html_text": html_text.ORACLE, "op11_vector_codes": vector_codes.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gossamer.llm.bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"))


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gossamer.llm.pii import report

    return report(table(spark, sf_dir, "documents"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gossamer.llm.toxicity import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gossamer.llm.tokenfile import report

    return report(table(spark, sf_dir, "documents"))


@query
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(table(spark, sf_dir, "documents"))


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gossamer.llm.lines import report

    return report(table(spark, sf_dir, "documents"))


@query
def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gossamer.llm.language_model import score

    return score(table(spark, sf_dir, "documents"))


@query
def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gossamer.llm.neighbours import report

    return report(table(spark, sf_dir, "embeddings"))


@query
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gossamer.llm.byte_bpe import report

    return report(table(spark, sf_dir, "documents"))


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(table(spark, sf_dir, "embeddings"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(table(spark, sf_dir, "conversations"))
