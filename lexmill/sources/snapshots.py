"""Versions of an index in a folder: written whole, then made active by one rename."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import Analyzer, analyze
from ..operators.index import Index, read_index, with_delta, write_delta, write_index
from ..scratch import read_text, replace_text

FORMAT = 1


class SnapshotStore:
    """Index versions below ``path`` on any file system Spark can write; the file ACTIVE names the one in use.

    A version is never changed once it is written. The pointer moves last, so a failed write leaves the active version as it was.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, *parts: str):
        return self._hadoop.Path("/".join([self.path, *parts]))

    def _write(self, name: str, text: str) -> None:
        replace_text(self.spark, f"{self.path}/{name}", text)

    def _read(self, *parts: str) -> str | None:
        return read_text(self.spark, "/".join([self.path, *parts]))

    def active_version(self) -> str | None:
        return self._read("ACTIVE")

    def publish(self, version: str, corpus: DataFrame, analyze: Analyzer = analyze, files: int | None = None) -> None:
        """Write a new version and make it active."""
        self._add(version, {}, lambda where: write_index(corpus, where, analyze, files))

    def publish_delta(self, version: str, base: str, changed: DataFrame | None = None, gone: DataFrame | None = None, analyze: Analyzer = analyze) -> None:
        """Write what changed since version ``base`` as a new version, and make it active. ``base`` must stay as long as this version does."""
        index = self.load(base)
        if index is None:
            raise ValueError(f"version {base} doesn't exist")
        self._add(version, {"base": base}, lambda where: write_delta(index, where, changed, gone, analyze))

    def _add(self, version: str, more: dict, write: Callable[[str], None]) -> None:
        where = f"version={version}"
        if self._fs.exists(self._p(where)):
            raise ValueError(f"version {version} exists")
        try:
            write(f"{self.path}/{where}")
            self._write(f"{where}/FORMAT", json.dumps({"format_version": FORMAT, "index_version": version, **more}))
        except Exception:
            self._fs.delete(self._p(where), True)
            raise
        self._write("ACTIVE", version)

    def load(self, version: str) -> Index | None:
        """The tables of a version, None if it isn't there; a version of another format is refused."""
        text = self._read(f"version={version}", "FORMAT")
        if text is None:
            return None
        form = json.loads(text)
        if form.get("format_version") != FORMAT:
            raise ValueError("unsupported snapshot format")
        where = f"{self.path}/version={version}"
        if "base" not in form:
            return read_index(self.spark, where)
        base = self.load(form["base"])
        if base is None:
            raise ValueError(f"version {form['base']} doesn't exist")
        return with_delta(base, where)
