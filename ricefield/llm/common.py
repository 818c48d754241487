"""Helpers shared by the operators: tables, written intermediate results, Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ricefield.session import checkpoint_dir, shuffles_freed, workers_find_package
from ricefield.sinks.store import delete


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the folder that the cluster names in ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: the lineage is cut
    and every later use sees the same rows, also after executors are lost.  The shuffle
    files behind it are given back."""
    path = shared_folder(df.sparkSession, name)
    for folders in _WRITTEN:
        folders.append(path)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_WRITTEN: list[list[str]] = []  # folders written inside each ``only_last_kept``


@contextmanager
def only_last_kept(spark: SparkSession, kept: int = 1) -> Iterator[None]:
    """Of the results ``written`` inside, the last one (the last ``kept``) stays and the folders
    of the others are deleted at the end.  For steps whose later use reads these only."""
    folders: list[str] = []
    _WRITTEN.append(folders)
    try:
        yield
    finally:
        _WRITTEN[:] = [x for x in _WRITTEN if x is not folders]
    for path in folders[:-kept]:
        delete(spark, path)


def sized(batches: Iterator[pa.RecordBatch], column: str, most: int = 24_000_000) -> Iterator[pa.RecordBatch]:
    """Batches split so that ``column`` holds about ``most`` bytes in each (one row at
    least), so memory follows the longest text and not the number of rows."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            # a copy, not a slice: some of Arrow's string functions misread slices
            yield batch if upto - at == batch.num_rows else batch.take(pa.array(np.arange(at, upto)))
            at = upto


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what Arrow's pool and the C heap hold of earlier ones goes back to the
    system, as a task's worker lives on beside those of later stages."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if trim:
            trim(0)


def words_of(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each text (null: none), flat, and the
    offsets of each text's words (one more than texts)."""
    texts = pc.fill_null(texts, "")
    if texts.offset:  # see ``sized``
        texts = texts.take(pa.array(np.arange(len(texts))))
    texts = texts.cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():  # white space at either end gives an empty word
        before = np.concatenate([[0], np.cumsum(full)])
        flat = flat.filter(pa.array(full))
        offsets = before[offsets]
    return flat, offsets


def ragged_take(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[s : s + n]`` for each (s, n), one after another."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    begins = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - begins, lengths) + np.arange(total)]


def same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))
