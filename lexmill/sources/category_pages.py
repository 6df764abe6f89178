"""Answers of an encyclopedia's category service as links, and a data source that reads them, from files or over HTTP."""

from __future__ import annotations

import email.utils
import itertools
import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from urllib.parse import urlencode, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Error of an answer that isn't of the service's form (fixed value).
INVALID = "wikipedia_invalid_response"
RETRY, MOST_REDIRECTS, PAGE_SIZE = {408, 429, 500, 502, 503, 504}, 5, 50


def _read(answers: DataFrame) -> DataFrame:
    """(parent, number, m, bad) of answers: their members, and what is wrong with them."""
    shape = "struct<query: struct<categorymembers: array<struct<pageid: bigint, ns: bigint, title: string>>>>"
    given = F.col("error") if "error" in answers.columns else F.lit(None).cast("string")
    rows = answers.select("parent", F.col("number").cast("long").alias("number"), given.alias("given"), F.from_json("body", shape)["query"]["categorymembers"].alias("m"))
    holes = F.exists("m", lambda x: x.isNull() | x["ns"].isNull() | (x["ns"].isin(0, 14) & (x["pageid"].isNull() | x["title"].isNull())))
    return rows.withColumn("bad", F.coalesce(F.nullif("given", F.lit("")), F.when(F.col("m").isNull() | holes, F.lit(INVALID))))


def category_links(answers: DataFrame) -> DataFrame:
    """(parent, kind, position, page_id, title) of answers (parent, number, body[, error]): members of namespace 0 are pages, of 14 categories, others are left out.

    ``number`` orders the answers of one category; positions go on over them. Answers that can't be used give no rows here; they are
    the rows of ``category_errors``, which ``discovered`` takes, so that a discovery with holes isn't held for a complete one.
    """
    rows = _read(answers).where("bad is null").select("parent", "number", F.posexplode("m").alias("at", "x")).where("x.ns in (0, 14)")
    return rows.select("parent", F.when(F.col("x.ns") == 0, "page").otherwise("category").alias("kind"), (F.col("number") * 1_000_000 + F.col("at")).alias("position"), F.col("x.pageid").alias("page_id"), F.col("x.title").alias("title"))


def category_errors(answers: DataFrame) -> DataFrame:
    """(parent, number, error) of the answers that could not be had or read, or that lack their members or an id or title of one."""
    return _read(answers).where("bad is not null").select("parent", "number", F.col("bad").alias("error"))


def retry_delay(attempt: int, retry_after: str | None, now: float | None = None, most: float = 60.0) -> float:
    """Seconds to wait: as the server says, in seconds or as a date, else a random time that doubles in range with each attempt."""
    if retry_after:
        try:
            return max(0.0, min(most, float(retry_after)))
        except ValueError:
            at = email.utils.parsedate_to_datetime(retry_after)
            return max(0.0, min(most, at.timestamp() - (time.time() if now is None else now)))
    return random.uniform(0, min(most, 2.0**attempt))


class PoliteClient:
    """GET with a least interval between requests, retries, same-origin redirects only, a content type and a size limit."""

    def __init__(self, interval: float = 1.0, attempts: int = 3, most_bytes: int = 10_000_000, agent: str = "lexmill", opener: Callable | None = None, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.attempts, self.most_bytes, self.agent, self.sleep = interval, attempts, most_bytes, agent, sleep
        self.next = 0.0
        self.open = opener or urllib.request.build_opener(_NoRedirect).open

    def get(self, url: str, kind: str) -> bytes:
        origin = urlsplit(url)[:2]
        redirects = 0
        for attempt in range(self.attempts):
            wait = self.next - time.monotonic()
            if wait > 0:
                self.sleep(wait)
            self.next = time.monotonic() + self.interval
            try:
                with self.open(urllib.request.Request(url, headers={"User-Agent": self.agent}), timeout=30) as answer:
                    if kind not in answer.headers.get("Content-Type", ""):
                        raise ValueError("unexpected_content_type")
                    body = answer.read(self.most_bytes + 1)
                    if len(body) > self.most_bytes:
                        raise ValueError("response_too_large")
                    return body
            except urllib.error.HTTPError as error:
                if error.code in {301, 302, 303, 307, 308}:
                    redirects += 1
                    url = error.headers.get("Location", "")
                    if redirects > MOST_REDIRECTS or urlsplit(url)[:2] != origin:
                        raise ValueError("redirect_refused") from None
                elif error.code not in RETRY or attempt + 1 == self.attempts:
                    raise ValueError(f"http_{error.code}") from None
                else:
                    self.sleep(retry_delay(attempt, error.headers.get("Retry-After")))
            except (TimeoutError, urllib.error.URLError):
                if attempt + 1 == self.attempts:
                    raise ValueError("transport_error") from None
                self.sleep(retry_delay(attempt, None))
        raise ValueError("attempts_exhausted")


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


class _Host(InputPartition):
    """All categories that are asked of one host."""

    def __init__(self, titles: list[str]):
        self.titles = titles


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.endpoint = options["endpoint"]
        self.titles = json.loads(options["categories"])
        self.interval = float(options.get("interval", "1"))

    def partitions(self):
        return [_Host(self.titles)]

    def read(self, partition):
        client = PoliteClient(self.interval)
        for title in partition.titles:
            yield from self._answers(client, title)

    def _answers(self, client: PoliteClient, title: str):
        fixed = {"action": "query", "list": "categorymembers", "cmtitle": title, "cmnamespace": "0|14", "cmlimit": PAGE_SIZE, "cmsort": "sortkey", "format": "json"}
        goes_on: dict | None = {}
        for number in itertools.count():
            try:
                body = client.get(f"{self.endpoint}?{urlencode({**fixed, **goes_on})}", "json").decode("utf-8")
                answer = json.loads(body)
                goes_on = answer.get("continue") if isinstance(answer, dict) else None
                failed = None if isinstance(answer, dict) and isinstance(goes_on, dict | None) else INVALID
            except ValueError as error:
                body, goes_on, failed = None, None, INVALID if isinstance(error, json.JSONDecodeError | UnicodeDecodeError) else str(error)
            yield (title, number, body, failed)
            if failed or not goes_on:
                return


class CategoryPages(DataSource):
    """format("category_pages"): answers (parent, number, body, error) of a category service; options endpoint, categories (JSON list), interval.

    The service is one host, so all categories are asked by one task through one client: the interval between requests holds for the
    host, however many categories there are.
    """

    @classmethod
    def name(cls):
        return "category_pages"

    def schema(self):
        return "parent string, number long, body string, error string"

    def reader(self, schema):
        return _Reader(self.options)


#: Sources that can be named in a crawl (fixed values); ``register`` adds to them.
SOURCES: dict[str, type] = {"wikipedia": CategoryPages}


def register(spark: SparkSession, key: str = "wikipedia", source: type | None = None) -> None:
    """Make a source known to Spark and to ``source``."""
    if source is not None:
        SOURCES[key] = source
    spark.dataSource.register(SOURCES[key])


def source(key: str) -> type:
    if key not in SOURCES:
        raise KeyError("unsupported_crawl_source")
    return SOURCES[key]
