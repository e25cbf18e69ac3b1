"""Intermediate tables: written below the folder that a cluster shares, and deleted with their call or application."""

from __future__ import annotations

import functools
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def local_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="tideline-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own, but only if driver and executors are one process."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return local_folder(spark.sparkContext.applicationId)


_inside: ContextVar[str | None] = ContextVar("tideline_scratch", default=None)


class Scratch:
    """Intermediate tables of one call, in a folder of its own below the shared one.

    As a context it also holds the folders of the calls made within it, and all
    of them go when it is left. A folder outside any context goes when the
    application ends. Nothing is kept on the session, so calls in other threads
    have folders of their own.
    """

    def __init__(self, spark: SparkSession, tag: str) -> None:
        above = _inside.get()
        self.spark, self.tables = spark, []
        self.path = f"{above or shared_folder(spark)}/tideline-{tag}-{uuid.uuid4().hex}"
        where, files = self._files(self.path)
        files.mkdirs(where)
        if not above:
            files.deleteOnExit(where)

    def _files(self, path: str) -> tuple:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        where, files = self._files(path)
        files.delete(where, True)

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        """Write df as Parquet and read it back: lineage ends here and lost executors cost nothing."""
        path = f"{self.path}/{tag}-{len(self.tables)}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((back, path))
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for k, (df, path) in enumerate(self.tables):
            if path and any(df is t for t in tables):
                self._delete(path)
                self.tables[k] = (df, None)

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables but those that later plans read."""
        self.drop(*[df for df, _ in self.tables if not any(df is t for t in tables)])

    def __enter__(self) -> Scratch:
        self._token = _inside.set(self.path)
        return self

    def __exit__(self, *failure) -> None:
        _inside.reset(self._token)
        self._delete(self.path)
