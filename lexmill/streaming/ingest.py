"""Ingestion from a stream of envelopes: each micro-batch once, the index rebuilt only when something was imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.local import local_table
from ..operators.ingest import classified, imported_documents, staged, validated
from ..scratch import file_system

OUTCOME = ["batch", "job_id", "position", "status", "error"]


class StreamIngest:
    """Micro-batches of envelopes (job_id, body) into a document table and an outcome table below ``path``.

    Both tables are partitioned by batch, and a batch overwrites its own partition: a batch that is run again after a failure
    leaves the same rows. ``published`` is called with the documents after each batch that imported something.
    """

    def __init__(self, spark: SparkSession, path: str, published: Callable[[DataFrame], None] | None = None):
        self.spark, self.path, self.published = spark, path.rstrip("/"), published

    def documents(self, but: int | None = None) -> DataFrame:
        """All documents so far, without those of batch ``but``. Only a folder that isn't there is an empty history; any other error is raised."""
        schema = "id long, title string, content string, url string, status string, batch long"
        fs, where = file_system(self.spark, f"{self.path}/documents")
        if not fs.exists(where):
            return local_table(self.spark, [], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/documents")
        return rows if but is None else rows.where(F.col("batch") != but)

    def outcomes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/outcomes")

    def run_batch(self, envelopes: DataFrame, batch: int) -> None:
        known = self.documents(but=batch)
        order = ["job_id", "position"]
        done = classified(validated(staged(envelopes)), known, order).persist()
        try:
            for table, rows in (("outcomes", done.select(F.lit(batch).alias("batch"), *OUTCOME[1:])), ("documents", imported_documents(done, known, order).withColumn("batch", F.lit(batch)))):
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/{table}")
            if self.published is not None and done.where("status = 'imported'").limit(1).count():
                self.published(self.documents())
        finally:
            done.unpersist()

    def start(self, envelopes: DataFrame, once: bool = True) -> StreamingQuery:
        writer = envelopes.writeStream.foreachBatch(self.run_batch).option("checkpointLocation", f"{self.path}/checkpoint")
        return (writer.trigger(availableNow=True) if once else writer).start()
