"""Lines that recur in too many documents of one source, and the documents without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written


def source_of(host: Column, url: Column) -> Column:
    """The source: ``source_host``, or the host of ``url`` where that is null or blank; lower case, no outer blanks or closing dots."""

    def clean(c: Column) -> Column:
        return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"\.+$", ""), F.lit(""))

    of_url = F.regexp_extract(url, r"^(?U)\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.coalesce(clean(host), clean(of_url))


def line_key(line: Column) -> Column:
    """64-bit hash of the letters of a line regardless of case; null for a line without a letter."""
    letters = F.regexp_replace(F.lower(F.upper(line)), r"[^\p{L}]+", "")
    return F.when(letters != "", F.xxhash64(letters))


def line_rows(docs: DataFrame) -> DataFrame:
    """(id, src, line_no, line_key) of each line with a letter in a document with a source. ``docs``: id, content, url, source_host."""
    src = source_of(F.col("source_host"), F.col("url"))
    return (
        docs.select("id", F.xxhash64(src).alias("src"), src.alias("s"), F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
        .where(F.col("s").isNotNull() & F.col("id").isNotNull())
        .select("id", "src", F.col("line_no").cast("long").alias("line_no"), line_key(F.col("line")).alias("line_key"))
        .where(F.col("line_key").isNotNull())
    )


def excessive_lines(docs: DataFrame, least_docs: int = 5, least_share: float = 0.1) -> DataFrame:
    """(src, line_key, n_docs, all_docs) of the lines that stand in at least ``least_docs`` documents and in at least
    ``least_share`` of all documents of their source.

    Documents are counted by distinct id, so repeated rows count once; the first step of the distinct count
    is spread over (src, line, id), so a source or line with a third of all rows is pre-aggregated before it
    meets in one task. Null or blank content still counts as a document of its source.
    """
    src = source_of(F.col("source_host"), F.col("url"))
    totals = (
        docs.select("id", src.alias("s")).where("s is not null and id is not null").groupBy(F.xxhash64("s").alias("src")).agg(F.count_distinct("id").alias("all_docs"))
    )
    counts = line_rows(docs).groupBy("src", "line_key").agg(F.count_distinct("id").alias("n_docs")).where(F.col("n_docs") >= least_docs)
    return counts.join(totals, "src").where(F.col("n_docs") >= F.lit(least_share) * F.col("all_docs"))


def excessive_places(docs: DataFrame, least_docs: int = 5, least_share: float = 0.1) -> DataFrame:
    """(id, line_no) of each place where an excessive line stands, once.

    Extra columns of ``docs`` are ignored; null ids, null contents and documents without any source give no rows.
    """
    docs = docs.select("id", "content", "url", "source_host")
    bad = small(written(excessive_lines(docs, least_docs, least_share).select("src", "line_key"), "excessive"))
    return line_rows(docs).join(bad, ["src", "line_key"], "left_semi").select("id", "line_no").distinct()


def without_excessive(docs: DataFrame, least_docs: int = 5, least_share: float = 0.1) -> DataFrame:
    """(id, content) of each document once, the excessive lines taken out; null contents stay null."""
    places = excessive_places(docs, least_docs, least_share).groupBy("id").agg(F.collect_set("line_no").alias("bad"))
    kept = F.array_join(F.filter(F.split("content", "\n"), lambda _, i: ~F.array_contains("bad", i.cast("long"))), "\n")
    return (
        docs.select("id", "content").distinct().join(places, "id", "left")
        .select("id", F.when(F.col("bad").isNull(), F.col("content")).otherwise(kept).alias("content"))
    )
