"""The inverted index as tables: postings with document lengths, term and corpus statistics, in three scopes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hosts import document_host
from ..functions.text import Analyzer, analyze, scoped_terms
from ..schemas import SCOPES


def clean_corpus(docs: DataFrame) -> DataFrame:
    """Documents (id, title, content, url, source_host, created_at) each once; null texts are empty, a missing host comes from the URL.

    Rows without id are dropped; of rows with one id and different contents all stay in no defined order but one. Other
    columns are dropped.
    """
    have = set(docs.columns)
    docs = docs.select("id", *(F.col(c) if c in have else F.lit(None).cast("string" if c != "created_at" else "timestamp").alias(c) for c in ("title", "content", "url", "source_host", "created_at")))
    docs = docs.where(F.col("id").isNotNull()).dropDuplicates(["id"])
    return docs.select("id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "content")), "url", document_host(F.col("source_host"), F.col("url")).alias("source_host"), "created_at")


def document_terms(corpus: DataFrame, analyze: Analyzer = analyze, scopes: tuple[str, ...] = SCOPES) -> DataFrame:
    """(scope, id, terms): the analyzed terms of each document in each scope. Documents without terms stay, with an empty array."""
    parts = corpus.select("id", analyze(F.col("title")).alias("t"), analyze(F.col("content")).alias("c"))
    of = {"all": F.concat("t", "t", "c"), "title": F.col("t"), "content": F.col("c")}
    if len(scopes) == 1:
        return parts.select(F.lit(scopes[0]).alias("scope"), "id", of[scopes[0]].alias("terms"))
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("scope"), of[s].alias("terms")) for s in scopes)))
    return parts.select("id", rows.alias("x")).select("x.scope", "id", "x.terms")


def document_lengths(terms: DataFrame) -> DataFrame:
    """(scope, id, dl): the number of terms."""
    return terms.select("scope", "id", F.size("terms").cast("long").alias("dl"))


def scope_stats(terms: DataFrame) -> DataFrame:
    """(scope, n_docs, avg_dl) over all documents, those without terms included; an empty scope has average 0."""
    return document_lengths(terms).groupBy("scope").agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_dl"))


def postings(terms: DataFrame) -> DataFrame:
    """(scope, term, id, tf, dl): a row for each term of each document of (scope, id, terms[, dl]).

    Counted inside each document's own sorted array, so nothing is shuffled, and a long document costs no more than its sorting:
    a term's frequency is the distance between the places where successive terms begin.
    """
    dl = F.col("dl") if "dl" in terms.columns else F.size("terms").cast("long").alias("dl")
    rows = terms.where(F.size("terms") > 0).select("scope", "id", dl, F.array_sort("terms").alias("s"))
    begins = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    rows = rows.select("scope", "id", "dl", "s", begins.alias("b"))
    counted = F.transform("b", lambda i, k: F.struct(F.get("s", i).alias("term"), (F.coalesce(F.get("b", k + 1), F.size("s")) - i).cast("long").alias("tf")))
    return rows.select("scope", "id", "dl", F.explode(counted).alias("p")).select("scope", "p.term", "id", "p.tf", "dl")


def term_stats(posts: DataFrame) -> DataFrame:
    """(scope, term, df): the number of documents with the term; partial counts are combined before the shuffle."""
    return posts.groupBy("scope", "term").agg(F.count("*").alias("df"))


def vocabulary(stats: DataFrame) -> DataFrame:
    """(scope, n_terms): distinct terms."""
    return stats.groupBy("scope").agg(F.count("*").alias("n_terms"))


@dataclass(frozen=True)
class Index:
    """The tables of an index. ``docs`` has the clean corpus."""

    docs: DataFrame
    terms: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    scope_stats: DataFrame
    lazy: bool = False

    def narrowed(self, scopes: list[str], names: list[str]) -> tuple[DataFrame, DataFrame]:
        """Postings and term statistics of a few terms in some scopes.

        On written tables the conditions reach the scan: partitions by scope, row groups by term. A lazy index throws other
        terms away inside each document, before any row is made of them.
        """
        if not self.lazy:
            wanted = F.col("scope").isin(scopes) & F.col("term").isin(names)
            return self.postings.where(wanted), self.term_stats.where(wanted)
        rows = self.terms.where(F.col("scope").isin(scopes)).select("scope", "id", F.size("terms").cast("long").alias("dl"), F.filter("terms", lambda t: t.isin(names)).alias("terms"))
        few = postings(rows)
        return few, term_stats(few)

    @property
    def status(self) -> DataFrame:
        return self.docs.agg(F.count("*").alias("documents"))


def lazy_index(corpus: DataFrame, analyze: Analyzer = analyze, scopes: tuple[str, ...] = SCOPES) -> Index:
    """An index that is computed with each query that uses it. For more than a few queries write it with ``write_index``."""
    corpus = clean_corpus(corpus)
    terms = document_terms(corpus, analyze, scopes)
    posts = postings(terms)
    return Index(corpus, terms, posts, term_stats(posts), scope_stats(terms), lazy=True)


def write_index(corpus: DataFrame, path: str, analyze: Analyzer = analyze, files: int | None = None) -> None:
    """Write all tables below ``path``, which must not exist.

    Postings lie by scope, range-partitioned and sorted by (term, id): a query reads the few row groups whose term range
    or Bloom filter admits its terms. Documents lie by id, for pages of results. Document terms are written once and everything else is derived from them, so the
    texts are analyzed once.
    """
    spark = corpus.sparkSession
    docs = clean_corpus(corpus)
    by_id = docs.repartitionByRange(files, "id") if files else docs.repartitionByRange("id")
    by_id.sortWithinPartitions("id").write.parquet(f"{path}/docs")
    docs = spark.read.parquet(f"{path}/docs")
    document_terms(docs, analyze).write.partitionBy("scope").parquet(f"{path}/terms")
    terms = spark.read.parquet(f"{path}/terms").select("scope", "id", "terms")
    posts = postings(terms)
    spread = posts.repartitionByRange(files, "scope", "term", "id") if files else posts.repartitionByRange("scope", "term", "id")
    (
        spread.sortWithinPartitions("scope", "term", "id").write.partitionBy("scope")
        .option("parquet.bloom.filter.enabled#term", "true").option("parquet.bloom.filter.expected.ndv#term", "200000").parquet(f"{path}/postings")
    )
    term_stats(spark.read.parquet(f"{path}/postings")).sortWithinPartitions("term").write.partitionBy("scope").parquet(f"{path}/term_stats")
    scope_stats(terms).coalesce(1).write.parquet(f"{path}/scope_stats")


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("docs", "terms", "postings", "term_stats", "scope_stats")))


def write_delta(index: Index, path: str, changed: DataFrame | None = None, gone: DataFrame | None = None, analyze: Analyzer = analyze) -> None:
    """What ``changed`` documents (new, or in place of those of the same id) and ``gone`` ids make of ``index``, below ``path``, which must not exist.

    Only the changed documents are analyzed, and of the index only the terms of the documents that go are read; its tables stay as they
    are. Term statistics are written as changes, corpus statistics anew (a row for each scope). A document both changed and gone is changed.
    """
    spark = index.docs.sparkSession
    docs = clean_corpus(changed) if changed is not None else index.docs.limit(0)
    docs.write.parquet(f"{path}/docs")
    docs = spark.read.schema(docs.schema).parquet(f"{path}/docs")
    document_terms(docs, analyze).write.partitionBy("scope").parquet(f"{path}/terms")
    terms = _scoped(spark, f"{path}/terms", index.terms)
    named = docs.select("id") if gone is None else docs.select("id").union(gone.select(F.col("id").cast(docs.schema["id"].dataType)).where("id is not null"))
    named.distinct().write.parquet(f"{path}/gone")
    old = index.terms.join(spark.read.schema(named.schema).parquet(f"{path}/gone"), "id", "left_semi").select("scope", "id", "terms")
    posts = postings(terms)
    posts.sortWithinPartitions("scope", "term", "id").write.partitionBy("scope").parquet(f"{path}/postings")
    new_df = _scoped(spark, f"{path}/postings", index.postings).select("scope", "term", F.lit(1).alias("df"))
    lost_df = old.select("scope", F.explode(F.array_distinct("terms")).alias("term"), F.lit(-1).alias("df"))
    new_df.union(lost_df).groupBy("scope", "term").agg(F.sum("df").alias("df")).where("df <> 0").write.partitionBy("scope").parquet(f"{path}/term_stats")
    moved = document_lengths(terms).select("scope", F.lit(1).alias("n"), "dl").union(document_lengths(old).select("scope", F.lit(-1), -F.col("dl"))).groupBy("scope").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl"))
    n, dl = F.col("n_docs") + F.coalesce("n", F.lit(0)), F.round(F.col("avg_dl") * F.col("n_docs")) + F.coalesce("dl", F.lit(0))
    stats = index.scope_stats.join(moved, "scope", "full").select("scope", F.coalesce(n, F.col("n")).cast("long").alias("n_docs"), F.coalesce(dl / F.nullif(n, F.lit(0)), F.col("dl") / F.nullif("n", F.lit(0)), F.lit(0.0)).alias("avg_dl"))
    stats.where("n_docs > 0").coalesce(1).write.parquet(f"{path}/scope_stats")


def _scoped(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A table that lies by scope, with the columns and types of another, also where it has no files."""
    return spark.read.schema(like.select(*[c for c in like.columns if c != "scope"], "scope").schema).parquet(path).select(like.columns)


def with_delta(index: Index, path: str) -> Index:
    """``index`` as ``write_delta`` changed it. Conditions on scope and term reach the scans of both; deltas may follow each other, until
    the whole is written anew."""
    spark = index.docs.sparkSession
    gone = spark.read.schema(index.docs.select("id").schema).parquet(f"{path}/gone")
    docs = index.docs.join(gone, "id", "left_anti").unionByName(spark.read.schema(index.docs.schema).parquet(f"{path}/docs"))
    terms, posts = (df.join(gone, "id", "left_anti").select(df.columns).union(_scoped(spark, f"{path}/{t}", df)) for t, df in (("terms", index.terms), ("postings", index.postings)))
    changes = _scoped(spark, f"{path}/term_stats", index.term_stats)
    stats = index.term_stats.union(changes).groupBy("scope", "term").agg(F.sum("df").alias("df")).where("df > 0").select(index.term_stats.columns)
    return Index(docs, terms, posts, stats, spark.read.schema(index.scope_stats.schema).parquet(f"{path}/scope_stats"))


def upserted(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The corpus with ``changed`` documents in place of those of the same id."""
    return docs.join(changed.select("id"), "id", "left_anti").unionByName(changed.select(docs.columns))


def removed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The corpus without the documents of ``ids`` (id)."""
    return docs.join(ids.select("id").distinct(), "id", "left_anti")
