"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from tallyveil.session import scratch_path

#: Rows per Arrow batch are Spark's setting; work inside a batch goes in pieces of about so many bytes of text.
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows written once to the shared folder and read again: later steps do not compute them anew."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, rows: int) -> bool:
    """True if the table has at most so many rows; reads no more than one row beyond them."""
    return df.limit(rows + 1).count() <= rows


@contextmanager
def batches_of(spark: SparkSession, size: int):
    """Arrow batches of about so many bytes for the jobs run inside; the session's own size comes back afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def by_bytes(sizes, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows that hold about ``limit`` bytes together; a longer row stands alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def texts_of(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, list]]:
    """(first row, end row, texts) of neighbouring rows of about ``limit`` bytes; what a piece has freed goes back to the system after it."""
    for a, b in by_bytes(pc.fill_null(pc.binary_length(column), 0).to_pylist(), limit):
        yield a, b, column.slice(a, b - a).to_pylist()
        give_back()


def give_back() -> None:
    """Hands memory that this process has freed back to the system, where its C library offers that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(batches: Iterator) -> Iterator:
    """The batches one by one. Workers live on between tasks, so what a batch has freed goes back to the system after it."""
    for batch in batches:
        yield batch
        del batch
        give_back()


def worker_kept(kind: str, key: object, make: Callable[[], object]) -> object:
    """An object that a Python worker makes once and keeps for its later tasks; one of each kind, the last."""
    store = sys.modules.setdefault("tallyveil_worker_store", types.ModuleType("tallyveil_worker_store")).__dict__
    if store.get(kind, (None,))[0] != key:
        store.pop(kind, None)
        store[kind] = (key, make())
    return store[kind][1]


def fresh_name(df: DataFrame, name: str) -> str:
    """The name, with underscores added until the table has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def open_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder named as Spark names it."""
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return pyarrow.fs.LocalFileSystem(), uri
    return pyarrow.fs.FileSystem.from_uri(uri)
