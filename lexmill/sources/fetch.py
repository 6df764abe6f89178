"""Fetching pages in executors: one task for each host, polite to it, obeying its robots file."""

from __future__ import annotations

import urllib.robotparser
from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hosts import host_of
from .category_pages import PoliteClient


class Robots:
    """The rules of each origin, read once: a missing file allows everything, a failing server is a transient error."""

    def __init__(self, client: PoliteClient, agent: str):
        self.client, self.agent, self.rules = client, agent, {}

    def allows(self, url: str) -> bool:
        origin = "://".join(urlsplit(url)[:2])
        if origin not in self.rules:
            rules = urllib.robotparser.RobotFileParser()
            try:
                rules.parse(self.client.get(origin + "/robots.txt", "text/plain").decode("utf-8", "replace").splitlines())
            except ValueError as error:
                if str(error) not in {"http_404", "unexpected_content_type"}:
                    raise
                rules.parse([])
            self.rules[origin] = rules
        return self.rules[origin].can_fetch(self.agent, url)


def fetch_pages(pages: DataFrame, kind: str = "html", interval: float = 1.0, agent: str = "lexmill", client: Callable[[], PoliteClient] | None = None, robots: bool = True) -> DataFrame:
    """(id, url, body, error) of pages (id, url), each once.

    All addresses of a host are in one task, which spaces its requests; hosts run in parallel. A page that can't be had has an error:
    http_…, robots_denied, transport_error, unexpected_content_type, response_too_large, redirect_refused, or not_utf8.
    """

    def run(batches):
        import pyarrow as pa

        agent_client = client() if client else PoliteClient(interval, agent=agent)
        rules = Robots(agent_client, agent)
        for batch in batches:
            for i in range(batch.num_rows):
                url, body, error = batch.column(1)[i].as_py(), None, None
                try:
                    if url is None:
                        raise ValueError("missing_url")
                    if robots and not rules.allows(url):
                        raise ValueError("robots_denied")
                    body = agent_client.get(url, kind).decode("utf-8")
                except UnicodeDecodeError:
                    error = "not_utf8"
                except ValueError as problem:
                    error = str(problem)[:300]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([url], pa.string()), pa.array([body], pa.string()), pa.array([error], pa.string())], ["id", "url", "body", "error"])

    once = pages.select("id", "url").dropDuplicates(["id"]).repartition(F.coalesce(host_of(F.col("url")), F.lit("")))
    return once.mapInArrow(run, f"id {pages.schema['id'].dataType.simpleString()}, url string, body string, error string")
