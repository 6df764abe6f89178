"""One object with the library's capabilities; every method returns DataFrames."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as html_functions
from ..functions.local import local_table
from ..functions.text import Analyzer, analyze
from ..operators import crawl, evaluate, ingest, search
from ..operators.index import Index, clean_corpus, lazy_index, removed, upserted, with_delta, write_delta
from ..schemas import QUERY
from ..scratch import kept_path
from ..sources.corpus import read_corpus
from ..sources.snapshots import SnapshotStore

MOST_RESULTS = 50


class RetrievalSession:
    """Search, explain, evaluate, ingest, extract, plan crawls, publish and sync.

    The session holds one index at a time. ``sync`` swaps in the store's active version; whatever goes wrong, the one at hand stays.
    """

    def __init__(self, spark: SparkSession, index: Index | None = None, store: SnapshotStore | None = None, version: str | None = None, analyze: Analyzer = analyze):
        self.spark, self.index, self.store, self.version, self.analyze = spark, index, store, version, analyze

    @classmethod
    def from_json_corpus(cls, spark: SparkSession, path: str) -> RetrievalSession:
        return cls(spark, lazy_index(read_corpus(spark, path)), version="local-json-v1")

    @classmethod
    def from_documents(cls, spark: SparkSession, docs: DataFrame, analyze: Analyzer = analyze) -> RetrievalSession:
        return cls(spark, lazy_index(docs, analyze), version=uuid.uuid4().hex, analyze=analyze)

    def cached(self) -> RetrievalSession:
        """Keep the index in executor memory (and on disk where it doesn't fit), for many single queries."""
        from pyspark import StorageLevel

        keep = {n: getattr(self.index, n).persist(StorageLevel.MEMORY_AND_DISK) for n in ("docs", "terms", "postings", "term_stats", "scope_stats")}
        self.index = Index(**keep)
        return self

    def batch(self, queries: list[dict]) -> DataFrame:
        """Queries from dicts with the columns of the query shape; a missing qid is the place in the list."""
        names = [f.name for f in QUERY.fields]
        rows = [tuple({"qid": i, "ranking": "bm25", "scope": "all", "phrase": False, **q}.get(n) for n in names) for i, q in enumerate(queries)]
        return local_table(self.spark, rows, QUERY)

    def search(self, queries: DataFrame, limit: int = 10, offset: int = 0, k1: float = search.K1, b: float = search.B) -> DataFrame:
        search.check_batch(queries)
        return search.search(self.index, queries, limit, offset, analyze=self.analyze, k1=k1, b=b)

    def search_page(self, query: str, limit: int = 10, offset: int = 0, **options) -> tuple[DataFrame, DataFrame]:
        """The page of one query, and its total; options: ranking, scope, source, created_from, created_to, phrase."""
        if not 1 <= limit <= MOST_RESULTS or offset < 0:
            raise ValueError(f"limit must be 1 to {MOST_RESULTS} and offset not negative")
        first, last = options.get("created_from"), options.get("created_to")
        if isinstance(first, dt.date) and isinstance(last, dt.date) and first > last:
            raise ValueError("created_from must not be after created_to")
        queries = self.batch([{"query": query, **options}])
        search.check_batch(queries)
        found = search.matches(self.index, queries, self.analyze)
        page = search.enriched(search.ranked(found, limit, offset), self.index.docs)
        return page.orderBy("rank"), found.agg(F.count("*").alias("total_results"))

    def explain(self, query: str, document_id: int) -> DataFrame:
        """Contributions of the terms to a document's BM25 score in scope all; an unknown document raises."""
        if not self.index.docs.where(F.col("id") == document_id).limit(1).count():
            raise KeyError(document_id)
        ids = local_table(self.spark, [(document_id,)], "id long")
        return search.explained(self.index, self.batch([{"query": query}]), ids, self.analyze).orderBy("pos")

    def evaluate(self, queries: DataFrame, judgments: DataFrame, k: int = 3, rankings: tuple[str, ...] = ("bm25", "tfidf")) -> DataFrame:
        """Mean precision, recall and reciprocal rank of each ranking; all queries of all rankings run as one batch."""
        names = F.explode(F.array(*(F.lit(r) for r in rankings)))
        both = queries.select("qid", "query", names.alias("ranking"))
        both = both.select(F.concat_ws("/", "ranking", "qid").alias("key"), *both.columns)
        keyed = both.select(F.xxhash64("key").alias("qid"), F.col("qid").alias("of"), "query", "ranking")
        hits = search.ranked(search.matches(self.index, keyed.select("qid", "query", "ranking"), self.analyze), k)
        judged = keyed.select("qid", "of").join(judgments.select(F.col("qid").alias("of"), "id"), "of").select("qid", "id")
        return evaluate.summary(evaluate.query_metrics(hits, keyed, judged, k))

    def ingest(self, envelopes: DataFrame, documents: DataFrame) -> DataFrame:
        """Each item of the envelopes with its outcome."""
        order = ["job_id", "position"]
        return ingest.classified(ingest.validated(ingest.staged(envelopes)), documents, order)

    def extract(self, pages: DataFrame, kind: str) -> DataFrame:
        """kind: wikipedia (id, html), medium or rss (id, html, url)."""
        return html_functions.extract_encyclopedia(pages) if kind == "wikipedia" else html_functions.extract_articles(pages, kind)

    def crawl_plan(self, links: DataFrame, root: str, **limits) -> tuple[DataFrame, DataFrame]:
        return crawl.discover(links, root, **limits)

    def upsert(self, changed: DataFrame) -> RetrievalSession:
        """A session whose corpus has the changed documents in place of the old."""
        return self._changed(changed, None)

    def remove(self, ids: DataFrame) -> RetrievalSession:
        """A session whose corpus lacks the documents of ``ids`` (id)."""
        return self._changed(None, ids)

    def _changed(self, changed: DataFrame | None, gone: DataFrame | None) -> RetrievalSession:
        """On a written index only what changed is analyzed and written: as a new active version of the store, or, without one, as a scratch table. A lazy
        index stays lazy."""
        if self.index.lazy:
            docs = self.index.docs if changed is None else upserted(self.index.docs, clean_corpus(changed))
            return RetrievalSession.from_documents(self.spark, docs if gone is None else removed(docs, gone), self.analyze)
        version = uuid.uuid4().hex
        if self.store is not None and self.version is not None:
            self.store.publish_delta(version, self.version, changed, gone, self.analyze)
            return RetrievalSession(self.spark, self.store.load(version), self.store, version, self.analyze)
        path = kept_path(self.spark, "delta")
        write_delta(self.index, path, changed, gone, self.analyze)
        return RetrievalSession(self.spark, with_delta(self.index, path), None, version, self.analyze)

    def publish(self, corpus: DataFrame | None = None, version: str | None = None) -> str:
        """Write a new version of the index from ``corpus`` (or the one at hand), make it active, and use it."""
        version = version or uuid.uuid4().hex
        self.store.publish(version, corpus if corpus is not None else self.index.docs, self.analyze)
        self.sync()
        return version

    def sync(self) -> bool:
        """Take over the store's active version if it is another; whether that happened."""
        try:
            version = self.store.active_version()
            if version is None or version == self.version:
                return False
            index = self.store.load(version)
            if index is None:
                return False
        except Exception:
            return False
        self.index, self.version = index, version
        return True
