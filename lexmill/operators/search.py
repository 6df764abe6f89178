"""Ranked retrieval for whole batches of queries: one plan answers all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hosts import from_source, in_dates, normalize_source, utc_date
from ..functions.local import local_table
from ..functions.text import Analyzer, analyze, has_phrase, snippet, strip
from ..schemas import QUERY, RANKINGS, SCOPES
from .index import Index
from .scoring import K1, B, Scorer, bm25_idf, scorer

#: Query terms up to which the query side is broadcast; a larger batch is joined by shuffle. Up to the second number of terms, of up to
#: the third of queries, they are also literals of the scan.
BROADCAST_QUERIES, LITERAL_TERMS, LITERAL_QUERIES = 200_000, 2_000, 1_000
#: Results of a batch up to which their ids are literals of the scan of the documents.
PAGE_ROWS = 5_000
#: Scores are compared at this many digits, so that sums in another order don't change ranks; ties go to the lower id.
DIGITS = 9


def complete_queries(queries: DataFrame) -> DataFrame:
    """A batch with all columns of the query shape: missing ones have their defaults (bm25, all, no filters, no phrase)."""
    defaults = {"ranking": F.lit("bm25"), "scope": F.lit("all"), "phrase": F.lit(False)}
    have = set(queries.columns)
    cols = []
    for f in QUERY.fields:
        given = F.col(f.name) if f.name in have else F.lit(None)
        given = given.cast(f.dataType)
        cols.append((F.coalesce(given, defaults[f.name]) if f.name in defaults else given).alias(f.name))
    return queries.select(cols).withColumn("source", normalize_source(F.col("source")))


def check_batch(queries: DataFrame) -> None:
    """Raise for blank queries, unknown scopes or rankings, and date bounds in the wrong order; looks at one offending row."""
    bad = complete_queries(queries).where(
        F.coalesce(strip(F.col("query")), F.lit("")).eqNullSafe("") | ~F.col("scope").isin(*SCOPES) | ~F.col("ranking").isin(*RANKINGS) | F.coalesce(F.col("created_from") > F.col("created_to"), F.lit(False))
    ).limit(1).collect()
    if bad:
        row = bad[0]
        if not (row["query"] or "").strip():
            raise ValueError("query must not be blank")
        if row["scope"] not in SCOPES:
            raise ValueError(f"scope must be one of: {', '.join(SCOPES)}")
        if row["ranking"] not in RANKINGS:
            raise ValueError(f"unsupported ranking: {row['ranking']}")
        raise ValueError("created_from must not be after created_to")


def query_terms(queries: DataFrame, analyze: Analyzer = analyze) -> DataFrame:
    """(qid, ranking, scope, term, times): the terms of each query; a repeated term counts as often as it stands."""
    q = complete_queries(queries).select("qid", "ranking", "scope", F.explode(analyze(F.col("query"))).alias("term"))
    return q.groupBy("qid", "ranking", "scope", "term").agg(F.count("*").alias("times"))


class _Batch:
    """What must be known of a batch before its plan is made. A batch of few queries comes to the driver once; a large one stays a table.

    terms: (qid, ranking, scope, term, times, place), place numbering the different terms of a query.
    """

    def __init__(self, queries: DataFrame, analyze: Analyzer):
        self.queries = complete_queries(queries)
        spark = queries.sparkSession
        rows = self.queries.withColumn("found", analyze(F.col("query"))).limit(LITERAL_QUERIES + 1).collect()  # at most 1,001
        self.few = len(rows) <= LITERAL_QUERIES
        self.names: list[str] = []
        if self.few:
            counted = []
            for r in rows:
                times: dict[str, int] = {}
                for t in r["found"]:
                    times[t] = times.get(t, 0) + 1
                counted += [(r["qid"], r["ranking"], r["scope"], t, n, k) for k, (t, n) in enumerate(times.items())]
            self.names, self.scopes = sorted({c[3] for c in counted}), sorted({c[2] for c in counted})
            names: dict[int, list] = {}
            for c in counted:
                names.setdefault(c[0], []).append((c[3], c[5]))
            self.places = local_table(spark, [(k, [{"term": t, "place": p} for t, p in sorted(v)]) for k, v in names.items()], "qid long, all array<struct<term: string, place: int>>")
            self.terms = local_table(spark, counted, "qid long, ranking string, scope string, term string, times long, place int")
            self.queries = local_table(spark, [tuple(r[c] for c in self.queries.columns) for r in rows], self.queries.schema)
            self.filtered = any(r["source"] is not None or r["created_from"] is not None or r["created_to"] is not None for r in rows)
            self.phrased = any(r["phrase"] for r in rows)
            self.most = max((c[5] + 1 for c in counted), default=0)
            self.small = F.broadcast
        else:
            place = F.row_number().over(Window.partitionBy("qid").orderBy("term")) - 1
            self.terms = query_terms(self.queries, analyze).withColumn("place", place)
            self.places = self.terms.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term", "place"))).alias("all"))  # the terms of one query
            bounds = F.col("source").isNotNull() | F.col("created_from").isNotNull() | F.col("created_to").isNotNull()
            kinds = self.queries.agg(F.max(bounds).alias("f"), F.max("phrase").alias("p")).first()
            self.filtered, self.phrased = bool(kinds["f"]), bool(kinds["p"])
            sizes = self.terms.agg(F.count("*").alias("n"), F.max("place").alias("most")).first()
            self.most = (sizes["most"] or 0) + 1
            self.small = F.broadcast if sizes["n"] <= BROADCAST_QUERIES else lambda df: df

    def weighed(self, index: Index) -> tuple[DataFrame, DataFrame]:
        """The terms with df, n_docs and avg_dl, and the postings to join them with."""
        if self.few and len(self.names) <= LITERAL_TERMS:
            posts, stats = index.narrowed(self.scopes, self.names)
        else:
            posts, stats = index.postings, index.term_stats
        side = self.small(self.terms).join(stats, ["scope", "term"]).join(F.broadcast(index.scope_stats), "scope")  # a row for each scope
        return self.small(side), posts


def matches(index: Index, queries: DataFrame, analyze: Analyzer = analyze, k1: float = K1, b: float = B, extra: dict[str, Scorer] | None = None) -> DataFrame:
    """(qid, id, score, matched_terms) of every document with at least one term of a query, after filters and phrase."""
    batch = _Batch(queries, analyze)
    return _named(_scored(index, batch, analyze, k1, b, extra), batch)


def _named(hits: DataFrame, batch: _Batch) -> DataFrame:
    """Hits with the terms that their masks stand for."""
    if "mask" not in hits.columns:
        return hits
    with_terms = hits.join(batch.small(batch.places), "qid")
    matched = F.transform(F.filter("all", lambda t: F.getbit(F.col("mask"), t["place"]) == 1), lambda t: t["term"])
    rest = [c for c in hits.columns if c not in ("qid", "id", "score", "mask")]
    return with_terms.select("qid", "id", "score", matched.alias("matched_terms"), *rest)


def _scored(index: Index, batch: _Batch, analyze: Analyzer, k1: float, b: float, extra: dict[str, Scorer] | None) -> DataFrame:
    """(qid, id, score, mask), or matched_terms in place of mask where a query has more than 62 different terms.

    Statistics are those of the whole scope; filters never change them. The terms of the batch, with their statistics, form the
    small side: its size is checked, and it is broadcast to the postings, which are then reduced before any shuffle. Which terms
    matched is summed as bits, so that the aggregate stays one of plain numbers.
    """
    q = batch.queries
    weighed, posts = batch.weighed(index)
    hits = posts.join(weighed, ["scope", "term"])
    weight = scorer(F.col("ranking"), k1, b, extra)(*(F.col(c).cast("double") for c in ("tf", "df", "dl", "n_docs", "avg_dl")))
    which = F.sum(F.expr("shiftleft(1L, place)")).alias("mask") if batch.most <= 62 else F.sort_array(F.collect_set("term")).alias("matched_terms")
    found = hits.groupBy("qid", "id").agg(F.sum(F.col("times") * weight).alias("score"), which)
    columns = found.columns
    if batch.filtered:
        meta = index.docs.select("id", F.col("source_host").alias("host"), utc_date(F.col("created_at")).alias("day"))
        conditions = batch.small(q.where("source is not null or created_from is not null or created_to is not null").select("qid", "source", "created_from", "created_to"))
        found = (
            found.join(conditions, "qid", "left").join(meta, "id", "left")
            .where(from_source(F.col("host"), F.col("source")) & in_dates(F.col("day"), F.col("created_from"), F.col("created_to"))).select(columns)
        )
    if batch.phrased:
        asked = batch.small(q.where("phrase").select("qid", F.col("scope").alias("asked"), analyze(F.col("query")).alias("run")))
        both = index.terms.where("scope in ('title', 'content')").select("id", F.col("scope").alias("field"), "terms")
        exact = (
            found.select("qid", "id").join(asked, "qid").join(both, "id").where((F.col("asked") == "all") | (F.col("asked") == F.col("field")))
            .where(has_phrase(F.col("terms"), F.col("run"))).select("qid", "id").distinct()
        )
        plain = found.join(batch.small(q.where("phrase").select("qid")), "qid", "left_anti")
        found = plain.unionByName(found.join(exact, ["qid", "id"], "left_semi"))
    return found


def ranked(found: DataFrame, limit: int | None = 10, offset: int = 0) -> DataFrame:
    """``found`` with rank from 1: by score, then id, within each query; only ranks after ``offset``, at most ``limit``.

    Window group limits cut each query to its best rows before the shuffle.
    """
    if offset < 0:
        raise ValueError("offset must not be negative")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", DIGITS).desc(), "id"))
    out = found.withColumn("rank", rank.cast("long"))
    if limit is not None:
        out = out.where(F.col("rank") <= offset + max(0, limit))
    return out.where(F.col("rank") > offset)


def totals(found: DataFrame) -> DataFrame:
    """(qid, total_results) before paging."""
    return found.groupBy("qid").agg(F.count("*").alias("total_results"))


def enriched(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with title, url and a snippet around the first matched term; only the page's documents are read in full."""
    page = hits.join(docs.select("id", "title", "content", "url"), "id")
    return page.select("qid", "rank", F.col("id").alias("document_id"), "title", "url", "score", snippet(F.col("title"), F.col("content"), F.col("matched_terms")).alias("snippet"), "matched_terms")


def search(index: Index, queries: DataFrame, limit: int = 10, offset: int = 0, analyze: Analyzer = analyze, k1: float = K1, b: float = B, extra: dict[str, Scorer] | None = None) -> DataFrame:
    """The page of results of each query of the batch, enriched.

    Equal queries of a batch are answered once: popular queries cost their page, not their scoring, again. The page of a
    small batch (up to PAGE_ROWS results) is ranked at once; its ids are then literals of the scan of the documents, which lie by id, so that
    only the row groups that hold them are read. A large batch stays one lazy plan.
    """
    q = complete_queries(queries)
    what = [c for c in q.columns if c != "qid"]
    spark = q.sparkSession
    rows = q.limit(LITERAL_QUERIES + 1).collect()  # at most 1,001
    if len(rows) <= LITERAL_QUERIES:
        same: dict[tuple, int] = {}
        pairs = [(same.setdefault(tuple(r[c] for c in what), len(same)), r["qid"]) for r in rows]
        distinct = local_table(spark, [(n, *key) for key, n in same.items()], q.select("qid", *what).schema)
        names = F.broadcast(local_table(spark, pairs, "same long, qid long"))
    else:
        keyed = q.withColumn("same", F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in what)))
        distinct = keyed.groupBy(F.col("same").alias("qid")).agg(*(F.first(c).alias(c) for c in what))
        names = keyed.select("same", "qid")
    batch = _Batch(distinct, analyze)
    top = _named(ranked(_scored(index, batch, analyze, k1, b, extra), limit, offset), batch)
    docs = index.docs
    if batch.few and max(0, limit) * len(same) <= PAGE_ROWS:
        found = top.collect()
        top = F.broadcast(local_table(spark, found, top.schema))
        docs = docs.where(F.col("id").isin(sorted({r["id"] for r in found})))
    page = enriched(top, docs).withColumnRenamed("qid", "same")
    return page.join(names, "same").select("qid", *[c for c in page.columns if c != "same"])


def explained(index: Index, queries: DataFrame, ids: DataFrame | None = None, analyze: Analyzer = analyze, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, id, pos, term, tf, df, idf, contribution): what each query term, in query order and as often as it stands, adds to a document's
    BM25 score; for the documents ``ids`` (id), or all that match. Terms that don't occur in a document have no row."""
    batch = _Batch(queries, analyze)
    weighed, posts = batch.weighed(index)
    hits = posts.join(weighed.drop("ranking", "times", "place"), ["scope", "term"])
    if ids is not None:
        hits = hits.join(ids.select("id").distinct(), "id", "left_semi")
    places = batch.queries.select("qid", F.posexplode(analyze(F.col("query"))).alias("pos", "term"))
    hits = hits.join(batch.small(places), ["qid", "term"])
    tf, df, dl, n, avg = (F.col(c).cast("double") for c in ("tf", "df", "dl", "n_docs", "avg_dl"))
    idf = bm25_idf(n, df)
    return hits.select("qid", "id", F.col("pos").cast("long").alias("pos"), "term", "tf", "df", idf.alias("idf"), (idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg))).alias("contribution"))
