"""Shared folder, materialised tables and Arrow helpers of the operators here."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a longer document is a step of its own.
SLICE_BYTES = 1 << 19


#: Tables that are made while settle() runs, the innermost last.
_made: list[list[str]] = []
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a session without that setting (tests, a single machine) gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, one parent folder for each application."""
    return f"{shared_root(spark)}/foliant/{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}-{name}"


def materialize(df: DataFrame, name: str, *, by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, executors may go.

    by is a column whose values have a folder each.
    """
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    if _made:
        _made[-1].append(path)
    # The shuffle files of this write are of no use after it.
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(_FREE, before) if before is not None else spark.conf.unset(_FREE)
    return spark.read.schema(df.schema).parquet(path)


def settle(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """materialize(make(), name), and then delete the tables that make() has made on its way."""
    _made.append([])
    try:
        out = materialize(make(), name)
    finally:
        paths = _made.pop()
    # The last is out itself.
    for path in paths[:-1]:
        _delete(out.sparkSession, path)
    return out


def discard(*tables: DataFrame, only: str = "") -> None:
    """Delete materialised tables of this application that nothing will read again, or one folder of each."""
    for df in tables:
        mark = f"/foliant/{df.sparkSession.sparkContext.applicationId}/"
        for path in df.inputFiles()[:1]:
            if mark in path:
                base, rest = path.split(mark, 1)
                _delete(df.sparkSession, base + mark + rest.split("/", 1)[0] + (f"/{only}" if only else ""))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all tables that this application has materialised."""
    _delete(spark, f"{shared_root(spark)}/foliant/{spark.sparkContext.applicationId}")


#: Rows of a few small columns that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_ROWS = 500_000


def broadcast_if_few(df: DataFrame) -> DataFrame:
    """A table of few small columns with the hint to broadcast it if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def text_print(text_col: str) -> list[Column]:
    """128 bits by which rows of one id are told apart."""
    return [F.xxhash64(text_col), F.xxhash64(F.lit(1), F.col(text_col))]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets, without a copy; null is empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, kind, n + 1 + column.offset)[column.offset :].astype(np.int64) if offsets and offsets.size else np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    if column.null_count:
        # Spark gives nulls no bytes; other writers may.
        gone = column.is_null().to_numpy(zero_copy_only=False)
        if (np.diff(at)[gone] > 0).any():
            return utf8(column.fill_null(""))
    return raw, at


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of runs of rows with about most bytes."""
    raw, at = utf8(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of [starts[i], starts[i] + lengths[i]), one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def words_le(raw: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit word that starts at each byte of raw, which zeros follow."""
    padded = np.concatenate([raw, np.zeros(64, np.uint8)])
    return np.ndarray((len(raw) + 56,), "<u8", padded, strides=(1,))
