"""Corpora and judgments from JSON files, document tables, and a synthetic corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import JUDGMENT_FILE


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(position, id, title, content, url) of a JSON file {"documents": [...]}; checked in the executors.

    The first wrong document by position fails the read, with its position and field. Of documents with one id the last wins.
    """
    rows = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    docs = rows.select(F.try_variant_get("v", "$.documents", "array<variant>").alias("d"))
    docs = docs.select(F.when(F.col("d").isNull(), F.raise_error(F.lit("corpus root must contain a 'documents' list"))).otherwise(F.col("d")).alias("d"))
    items = docs.select(F.posexplode("d").alias("position", "item"))

    def field(name: str, kind: str, described: str, required: bool = True) -> Column:
        at = F.variant_get("item", f"$.{name}", "variant")
        shape = F.schema_of_variant(at)
        head = F.concat(F.lit("document at index "), F.col("position").cast("string"))
        there = F.array_contains(F.json_object_keys(F.to_json("item")), name)
        missing = F.raise_error(F.concat(head, F.lit(f" missing required field '{name}'")))
        wrong = F.raise_error(F.concat(head, F.lit(f" field '{name}' must be {described}")))
        fits = shape == ("BIGINT" if kind == "long" else "STRING")
        value = F.when(F.coalesce(fits, F.lit(False)), F.variant_get("item", f"$.{name}", kind))
        if not required:
            return F.when(~F.coalesce(there, F.lit(False)) | F.coalesce(shape == "VOID", F.lit(True)), F.lit(None).cast(kind)).when(~fits, wrong.cast(kind)).otherwise(value)
        return F.when(~F.coalesce(there, F.lit(False)), missing.cast(kind)).when(~F.coalesce(fits, F.lit(False)), wrong.cast(kind)).otherwise(value)

    is_object = F.startswith(F.schema_of_variant("item"), F.lit("OBJECT"))
    not_object = F.raise_error(F.concat(F.lit("document at index "), F.col("position").cast("string"), F.lit(" must be an object")))
    checked = items.select("position", F.when(is_object, F.col("item")).otherwise(not_object.cast("variant")).alias("item"))
    out = checked.select(
        F.col("position").cast("long").alias("position"), field("id", "long", "an integer").alias("id"), field("title", "string", "a string").alias("title"),
        field("content", "string", "a string").alias("content"), field("url", "string", "a string or null", False).alias("url"),
    )
    return out.groupBy("id").agg(F.max_by(F.struct("position", "title", "content", "url"), "position").alias("x")).select("x.position", "id", "x.title", "x.content", "x.url")


def read_judgments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Queries (qid, query) and judgments (qid, id) of a JSON file {"queries": [{"query", "relevant_document_ids"}]}.

    A blank query, or one without a relevant document, fails the read.
    """
    rows = spark.read.json(path, schema=JUDGMENT_FILE, multiLine=True, mode="FAILFAST").select(F.posexplode("queries").alias("qid", "q"))
    blank = (F.trim(F.coalesce("q.query", F.lit(""))) == "") | (F.size(F.coalesce("q.relevant_document_ids", F.array().cast("array<bigint>"))) == 0)
    message = F.concat(F.lit("evaluation query at index "), F.col("qid").cast("string"), F.lit(" must have a query and relevant ids"))
    queries = rows.select(F.col("qid").cast("long").alias("qid"), F.when(blank, F.raise_error(message).cast("string")).otherwise(F.col("q.query")).alias("query"), F.col("q.relevant_document_ids").alias("ids"))
    return queries.select("qid", "query"), queries.select("qid", F.explode("ids").alias("id")).distinct()


def synthetic_corpus(spark: SparkSession, count: int, first: int = 0) -> DataFrame:
    """``count`` documents from one template, made in parallel."""
    n = F.col("id").cast("string")
    return spark.range(first, first + count).select(
        "id", F.concat(F.lit("Distributed systems guide "), n).alias("title"),
        F.concat(F.lit("distributed systems search indexing caching document number "), n, F.lit(" with BM25 ranking and retrieval")).alias("content"),
        F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("source_host"), F.lit(None).cast("timestamp").alias("created_at"),
    )


def active(docs: DataFrame) -> DataFrame:
    """Active documents by id."""
    return docs.where("status = 'active'").orderBy("id")


def active_page(docs: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of the active documents by id; each task keeps only its first offset + limit rows."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be at least 1 and offset not negative")
    return active(docs).offset(offset).limit(limit)


def point(docs: DataFrame, id_: int) -> DataFrame:
    """The active document of an id; the condition reaches the scan."""
    return docs.where((F.col("id") == id_) & (F.col("status") == "active"))


def with_changes(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """A new version of a document table: active rows named by ``changes`` (id, presence flags has_title, has_content, has_url, values) are merged.

    A present value overrides, a present null url clears it, absent fields keep their value.
    """
    new = changes.select("id", *(F.col(c).alias(f"new_{c}") for c in ("title", "content", "url")), "has_title", "has_content", "has_url")
    joined = docs.join(new, "id", "left")
    out = []
    for c in docs.columns:
        if c in ("title", "content", "url"):
            use = F.coalesce(F.col(f"has_{c}"), F.lit(False)) & (F.col("status") == "active")
            out.append(F.when(use, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(out)


def soft_deleted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """A new version in which the active documents of ``ids`` (id) are deleted."""
    gone = ids.select("id").distinct().withColumn("gone", F.lit(True))
    return docs.join(gone, "id", "left").withColumn("status", F.when(F.col("gone") & (F.col("status") == "active"), F.lit("deleted")).otherwise(F.col("status"))).drop("gone")
