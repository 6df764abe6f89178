"""A crawl from links to documents as one staged job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import extract_articles, extract_encyclopedia
from ..functions.urls import article_url, same_origin
from ..operators.crawl import discover
from ..operators.ingest import classified, imported_documents, validated
from ..sources.feeds import embedded_page, first_wins, parse_feeds


@dataclass(frozen=True)
class CrawlResult:
    """categories (for feeds: the feeds that could not be read), items with fetch_status, status and error; documents are the imported ones, counts one row."""

    categories: DataFrame
    items: DataFrame
    documents: DataFrame
    counts: DataFrame


def crawl_encyclopedia(links: DataFrame, pages: DataFrame, documents: DataFrame, root: str, least: int = 100, **limits) -> CrawlResult:
    """Discover pages below ``root``, take their html from ``pages`` (id, html, error), extract, check and classify them.

    ``documents`` (id, url) are those there are already, deleted ones included. A page without html fails with its fetch error, or
    http_404; one that can't be extracted with the extraction's error. Nothing is written: the result is a plan over the inputs, so a
    failed job is run again whole.
    """
    categories, found = discover(links, root, **limits)
    found = found.select("position", "page_id", "title", article_url(F.col("title")).alias("url"))
    had = pages.select(F.col("id").alias("page_id"), "html", F.col("error").alias("fetch_error")).dropDuplicates(["page_id"])
    fetched = found.join(had, "page_id", "left").withColumn("fetch_error", F.when(F.col("html").isNull(), F.coalesce("fetch_error", F.lit("http_404"))))
    texts = extract_encyclopedia(fetched.where("html is not null").select(F.col("page_id").alias("id"), "html"), least).select(F.col("id").alias("page_id"), "content", F.col("error").alias("text_error"))
    rows = fetched.drop("html").join(texts, "page_id", "left").withColumn("fetch_error", F.coalesce("fetch_error", "text_error"))
    good = rows.where("fetch_error is null").withColumn("payload", F.to_json(F.struct("title", "content", "url"))).select("position", "page_id", "payload")
    done = classified(validated(good), documents, ["position"])
    items = rows.select("position", "page_id", "title", "url", "fetch_error").join(done.select("position", "status", F.col("error").alias("ingest_error")), "position", "left")
    items = items.select(
        "position", "page_id", "title", "url", F.when(F.col("fetch_error").isNull(), "fetched").otherwise("failed").alias("fetch_status"), "status", F.coalesce("fetch_error", "ingest_error").alias("error")
    )
    return CrawlResult(categories, items, imported_documents(done, documents, ["position"]), _counted(items))


def _counted(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count("*").alias("discovered"), F.count_if(F.col("fetch_status") == "fetched").alias("fetched"), F.count_if(F.col("status") == "imported").alias("imported"),
        F.count_if(F.col("status") == "skipped").alias("skipped"), (F.count_if(F.col("fetch_status") == "failed") + F.count_if(F.col("status") == "failed")).alias("failed"),
    )


def crawl_feeds(feeds: DataFrame, pages: DataFrame, documents: DataFrame, kind: str = "rss", most: int = 500) -> CrawlResult:
    """Take the items of feeds (feed_id, xml, url), at most ``most`` of each, to documents.

    Items of other origins are left out for rss. An item with content in the feed needs no page; others take theirs from ``pages`` (url, html, error), or
    fail with its error or http_404. Each address counts once in a feed, and is imported once over all of them.
    """
    read = parse_feeds(feeds, kind)
    broken = read.where("error is not null").select("feed_id", "error")
    items = read.where("error is null").join(feeds.select("feed_id", F.col("url").alias("feed_url")), "feed_id")
    if kind == "rss":
        items = items.where(same_origin(F.col("canonical_url"), F.col("feed_url")))
    once = first_wins(items.select("feed_id", "canonical_url", "position", "title", "embedded_content"), "canonical_url", ["position"], ["feed_id"])
    rank = F.row_number().over(Window.partitionBy("feed_id").orderBy("position", "canonical_url"))
    once = once.withColumn("n", rank).where(F.col("n") <= most).drop("n")
    had = pages.select(F.col("url").alias("canonical_url"), "html", F.col("error").alias("fetch_error")).dropDuplicates(["canonical_url"])
    rows = once.join(had, "canonical_url", "left").withColumn("html", F.coalesce(embedded_page(F.col("title"), F.col("canonical_url"), F.col("embedded_content")), F.col("html")))
    rows = rows.withColumn("fetch_error", F.when(F.col("html").isNull(), F.coalesce("fetch_error", F.lit("http_404")))).withColumn("key", F.struct("feed_id", "position"))
    texts = extract_articles(rows.where("html is not null").select(F.to_json("key").alias("id"), "html", F.col("canonical_url").alias("url")), kind)
    texts = texts.select(F.col("id").alias("json_key"), F.col("title").alias("page_title"), F.col("canonical_url").alias("page_url"), "content", F.col("error").alias("text_error"))
    rows = rows.withColumn("json_key", F.to_json("key")).join(texts, "json_key", "left").withColumn("fetch_error", F.coalesce("fetch_error", "text_error"))
    good = rows.where("fetch_error is null").select("feed_id", "position", F.to_json(F.struct(F.col("page_title").alias("title"), "content", F.col("page_url").alias("url"))).alias("payload"))
    order = ["feed_id", "position"]
    done = classified(validated(good), documents, order)
    report = rows.select(*order, "title", F.col("canonical_url").alias("url"), "fetch_error").join(done.select(*order, "status", F.col("error").alias("ingest_error")), order, "left")
    report = report.select(*order, "title", "url", F.when(F.col("fetch_error").isNull(), "fetched").otherwise("failed").alias("fetch_status"), "status", F.coalesce("fetch_error", "ingest_error").alias("error"))
    return CrawlResult(broken, report, imported_documents(done, documents, order), _counted(report))
