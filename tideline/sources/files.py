"""Files in whatever store Spark reads, through its own file system layer."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyarrow import NativeFile
from pyarrow import fs as stores
from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _store(spark, path)
    return files.exists(where)


def size(spark: SparkSession, path: str) -> int | None:
    """Bytes of a file of the store, or None if it isn't there."""
    where, files = _store(spark, path)
    return files.getFileStatus(where).getLen() if files.exists(where) else None


def put(spark: SparkSession, local: Path, path: str, keep: bool = False) -> None:
    """Move a file of the driver's into the store, or copy it."""
    where, files = _store(spark, path)
    files.copyFromLocalFile(not keep, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{local.resolve()}"), where)


def delete(spark: SparkSession, path: str) -> None:
    where, files = _store(spark, path)
    files.delete(where, True)


def _place(uri: str) -> tuple[stores.FileSystem, str]:
    """A store and a path in it, for tasks: they have no session to ask. A path without a scheme is one of a folder that all share."""
    if "://" in uri:
        return stores.FileSystem.from_uri(uri)
    return stores.LocalFileSystem(), str(Path(uri.removeprefix("file:")).absolute())


def opened(uri: str) -> NativeFile:
    """A file of a store, to be read from any place in it."""
    store, path = _place(uri)
    return store.open_input_file(path)


def created(uri: str) -> NativeFile:
    """A new file of a store, with the folders above it, to be written from the beginning to the end."""
    store, path = _place(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path)


def moved(uri: str, to: str) -> None:
    store, path = _place(uri)
    store.move(path, _place(to)[1])


def text_of(uri: str) -> str | None:
    """The text of a file of a store, or None if it isn't there."""
    try:
        with opened(uri) as f:
            return f.read().decode("utf-8")
    except FileNotFoundError:
        return None


def put_text(uri: str, text: str) -> None:
    """Write a file of a store; it has its name only when it is whole."""
    part = f"{uri}.{uuid.uuid4().hex}.part"
    with created(part) as f:
        f.write(text.encode("utf-8"))
    moved(part, uri)
