"""Bulk ingestion as one set-based job: parse, validate, drop duplicate addresses, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .numbering import numbered

MOST_ITEMS = 500
#: Messages of the checks (fixed values).
REQUIRED, NOT_STRING, BLANK_TEXT, HAS_NUL, NOT_OBJECT, EXTRA = (
    "Field required", "Input should be a valid string", "must be a non-empty string", "must not contain null characters",
    "item: Input should be a valid dictionary or instance of BulkDocumentInput", "Extra inputs are not permitted",
)


def staged(envelopes: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """(job_id, position, payload) of envelopes (job_id, body): the items of {"documents": [...]}, as JSON texts, numbered from 0.

    An envelope with other keys, or without 1 to ``most`` items, fails the job.
    """
    v = F.try_parse_json("body")
    parsed = envelopes.select("job_id", F.try_variant_get(v, "$.documents", "array<variant>").alias("d"), F.json_object_keys("body").alias("keys"))
    ok = F.coalesce((F.size("d") >= 1) & (F.size("d") <= most) & (F.size("keys") == 1), F.lit(False))
    message = F.concat(F.lit("documents must hold 1 to "), F.lit(str(most)), F.lit(" items and nothing else"))
    checked = parsed.select("job_id", F.when(ok, F.col("d")).otherwise(F.raise_error(message).cast("array<variant>")).alias("d"))
    return checked.select("job_id", F.posexplode("d").alias("position", "item")).select("job_id", F.col("position").cast("long").alias("position"), F.to_json("item").alias("payload"))


def _field(name: str) -> tuple[Column, Column, Column]:
    """(present, of string type, value) of a field of the payload."""
    v = F.try_variant_get(F.col("v"), f"$.{name}", "variant")
    kind = F.schema_of_variant(v)
    return F.coalesce(F.array_contains("keys", name), F.lit(False)), F.coalesce(kind == "STRING", F.lit(False)), F.try_variant_get(F.col("v"), f"$.{name}", "string")


def validated(items: DataFrame) -> DataFrame:
    """``items`` (…, payload) with title, content, url and error.

    Texts must be strings, are stripped, and may be neither blank nor hold NUL; url may be missing, null or blank and is then null;
    other fields aren't allowed. error is the first failed check: title, content, url, then other fields; a payload that
    isn't an object (a null payload too) fails as a whole. Columns of ``items`` with the names of results are replaced. All of it stays
    in the JVM.
    """
    items = items.drop("title", "content", "url", "error", "v", "keys")
    rows = items.withColumn("v", F.try_parse_json("payload")).withColumn("keys", F.json_object_keys("payload"))
    checks = F.when(F.col("keys").isNull() | F.col("v").isNull(), NOT_OBJECT)
    values = {}
    nul = F.char(F.lit(0))
    for name in ("title", "content"):
        there, text, value = _field(name)
        values[name] = strip(value)
        checks = (
            checks.when(~there, f"{name}: {REQUIRED}").when(~text, f"{name}: {NOT_STRING}").when(values[name] == "", f"{name}: {BLANK_TEXT}")
            .when(F.contains(values[name], nul), f"{name}: {HAS_NUL}")
        )
    there, text, value = _field("url")
    empty = F.coalesce(F.schema_of_variant(F.try_variant_get(F.col("v"), "$.url", "variant")) == "VOID", F.lit(True))
    values["url"] = F.when(text, F.nullif(strip(value), F.lit("")))
    checks = checks.when(there & ~empty & ~text, f"url: {NOT_STRING}").when(F.contains(values["url"], nul), f"url: {HAS_NUL}")
    others = F.array_except("keys", F.array(*(F.lit(x) for x in ("title", "content", "url"))))
    checks = checks.when(F.size(others) > 0, F.concat(others[0], F.lit(f": {EXTRA}")))
    out = rows.withColumn("error", F.substring(checks, 1, 300))
    good = F.col("error").isNull()
    return out.select(*items.columns, *(F.when(good, values[c]).alias(c) for c in ("title", "content", "url")), "error")


def classified(items: DataFrame, documents: DataFrame, order: list[str], url_col: str = "url") -> DataFrame:
    """``items`` (…, url, error) with status imported, skipped or failed, and the error duplicate_url of skipped ones.

    A valid item with an address that any document (deleted ones too) already has, or that an earlier valid item has, is skipped; null addresses never
    collide. The first item of an address is found by a partial minimum before the shuffle, so one address may hold any share of the rows.
    Of ``documents`` only the addresses are read, and only those that items have go on: where the items are few, these are broadcast by
    their size at run time, and the history isn't shuffled.
    """
    valid = F.col("error").isNull() & F.col(url_col).isNotNull()
    first = items.where(valid).groupBy(url_col).agg(F.min(F.struct(*order)).alias("first"))
    known = documents.select(F.col("url").alias(url_col)).join(first.select(url_col), url_col, "left_semi").distinct().withColumn("known", F.lit(True))
    rows = items.join(first, url_col, "left").join(known, url_col, "left")
    again = F.coalesce(F.col("known") | (F.struct(*order) != F.col("first")), F.lit(False)) & valid
    return rows.select(
        *items.columns[: items.columns.index("error")], F.when(again, "duplicate_url").otherwise(F.col("error")).alias("error"),
        F.when(F.col("error").isNotNull(), "failed").when(again, "skipped").otherwise("imported").alias("status"), *items.columns[items.columns.index("error") + 1 :],
    )


def status_counts(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """received, imported, skipped, failed."""
    return items.groupBy(*(by or [])).agg(
        F.count("*").alias("received"), *(F.count_if(F.col("status") == s).alias(s) for s in ("imported", "skipped", "failed"))
    )


def progress(current: Column, total: Column) -> Column:
    """Percent with two digits; null without a total."""
    return F.round(current / F.nullif(total, F.lit(0)) * 100, 2)


def imported_documents(items: DataFrame, documents: DataFrame, order: list[str]) -> DataFrame:
    """The imported items as documents, with successive ids above those of ``documents`` in the order of items.

    The rows are written once, by ranges of the order, and numbered from what was written; see ``numbered``.
    """
    good = items.where("status = 'imported'").select(*order, "title", "content", "url")
    base = documents.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return numbered(good, order, base + 1, "id").select("id", "title", "content", "url", F.lit("active").alias("status"))
