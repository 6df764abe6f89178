"""The queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boilerplate, history_dedup, mixing, near_dup, repeated_lines, stuffing, text_quality, tokens
from .common import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "document_responses").select("id", F.col("content").alias("text"))
    return history_dedup.repeated_items(table(spark, sf_dir, "crawl_items"), table(spark, sf_dir, "crawl_runs"), texts)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.excessive_places(table(spark, sf_dir, "indexed_documents"))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.without_excessive(table(spark, sf_dir, "indexed_documents"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "document_responses").select("id", F.col("content").alias("text"))
    return text_quality.not_prose(docs, table(spark, sf_dir, "common_words"))


def p3_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "document_responses").select("id", F.col("content").alias("text"))
    return text_quality.document_kinds(docs, table(spark, sf_dir, "common_words"))


def p3_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "document_responses").select("id", F.col("content").alias("text"))
    return text_quality.statistics(docs, table(spark, sf_dir, "common_words"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "document_responses").select("id", F.concat_ws(" ", "title", "content").alias("text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.similar_pairs(_records(spark, sf_dir))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.similar_groups(_records(spark, sf_dir))


def _pages_and_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf_dir, "fetched_wikipedia_articles").select(F.col("page_id").alias("id"), "html")
    return pages, table(spark, sf_dir, "document_responses").select("id", F.col("content").alias("text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.furniture(*_pages_and_texts(spark, sf_dir))


def p5_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.main_bodies(*_pages_and_texts(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents"))


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_texts(tokens.token_ids(table(spark, sf_dir, "documents")))


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffed_pages(_texts(spark, sf_dir), table(spark, sf_dir, "common_words")).withColumnRenamed("id", "doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.page_scores(_texts(spark, sf_dir), table(spark, sf_dir, "common_words")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_clean, p3_found, p3_kinds, p3_statistics, p4_found, p4_groups, p5_found, p5_bodies, p6_ids, p6_texts, p7_selection, p7_shares, p8_found, p8_scores)}


def oracle_sql() -> dict[str, str]:
    from .oracle import oracle_sql as sql

    return sql()
