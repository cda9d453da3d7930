"""What the text operators share: scratch space, column hygiene, Arrow batches, flat gathers.

Scratch space is the folder that the cluster names in ``spark.checkpoint.dir``. Tables and files
written there cut lineage and survive the loss of an executor. What a session wrote stays until ``clear_scratch`` is
called, since results are read from it lazily; the corpus pipeline clears after each stage.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import delete

#: Bytes of text handled at once inside a Python worker.
CHUNK_BYTES = 4 << 20


_scratch_paths: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder of the session; where none is set, one is set on a local master only."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lakeloom-")
        sc.setCheckpointDir(base)
    _scratch_paths.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _scratch_paths[-1]


def scratch_mark() -> int:
    """A mark for ``clear_scratch``: what is written from now on."""
    return len(_scratch_paths)


def clear_scratch(mark: int = 0, keep: Iterable[str] = ()) -> None:
    """Delete the scratch paths of this process since a mark, but for ``keep``. Results that are read from them must be done with."""
    kept = set(keep)
    for path in _scratch_paths[mark:]:
        if path not in kept:
            delete(path)
    _scratch_paths[mark:] = [p for p in _scratch_paths[mark:] if p in kept]


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The same rows, written to scratch space and read again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only(docs: DataFrame, id_col: str, text_col: str, null_text: str | None = "") -> DataFrame:
    """``doc_id`` (long) and ``text`` (string; null becomes ``null_text``), whatever else the input holds."""
    text = F.col(text_col).cast("string")
    if null_text is not None:
        text = F.coalesce(text, F.lit(null_text))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))


def chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the ``text`` column of each holds about ``limit`` bytes (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        text = batch.column(batch.schema.get_field_index("text"))
        sizes = np.nan_to_num(np.asarray(pc.binary_length(text).to_numpy(zero_copy_only=False), dtype=np.float64))
        slot = ((np.cumsum(sizes) - sizes) // limit).astype(np.int64)
        cuts = np.flatnonzero(np.diff(slot)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
            yield batch.slice(a, b - a)


def frugal(run: Callable) -> Callable:
    """The same map over batches; when a task ends, memory that its worker holds unused goes back to the system."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def flat_gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of ``flat[s : s + n]`` for each start and size."""
    total = int(sizes.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_text(id_col: str) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))
