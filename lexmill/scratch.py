"""Tables in the folder that all executors share: they cut lineage, and outlive any executor."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Only where neither that setting nor a checkpoint directory is set (tests on one machine), a folder
    of this machine is made and set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexmill-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lexmill-{uuid.uuid4().hex[:12]}-{tag}"


def file_system(spark: SparkSession, path: str) -> tuple:
    """(file system, path) as Hadoop's objects."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if there is none."""
    fs, where = file_system(spark, path)
    if not fs.exists(where):
        return None
    data = fs.open(where)
    try:
        return bytes(data.readAllBytes()).decode()
    finally:
        data.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name first, then rename it over the old one in one step: a crash leaves either the old text or the new one."""
    fs, target = file_system(spark, path)
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    tmp = hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(hadoop, "Options$Rename")
    how = sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    target = fs.makeQualified(target)
    hadoop.FileContext.getFileContext(target.toUri(), sc._jsc.hadoopConfiguration()).rename(fs.makeQualified(tmp), target, how)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder or file below the shared folder, if it is there."""
    fs, where = file_system(spark, path)
    fs.delete(where, True)


def kept_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, which is deleted when the application ends."""
    path = scratch_path(spark, tag)
    fs, where = file_system(spark, path)
    fs.deleteOnExit(where)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder.

    A result that reads it may be used as long as the application runs; the table is deleted when the application ends.
    """
    spark = df.sparkSession
    path = kept_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Inside, each write's shuffle files go when it ends, not when the driver happens to collect its garbage: steps that follow each other need the disk of one."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Scratch:
    """Tables written for the time of one operator; ``discard`` deletes them once its result no longer reads them."""

    def __init__(self):
        self.paths = []

    def __call__(self, df: DataFrame, tag: str) -> DataFrame:
        path = scratch_path(df.sparkSession, tag)
        df.write.parquet(path)
        self.paths.append((df.sparkSession, path))
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def discard(self) -> None:
        for spark, path in self.paths:
            delete(spark, path)
        self.paths.clear()
