"""Token sequences in Arrow files with fixed-size-list batches.

The ids of all documents, in order of their identifier and each with an end id, form one stream. Every file holds a
range of documents as sequences of equal length: ``ids`` (fixed-size list), ``mask`` (is a token, not padding) and
``last`` (ends a document) as fixed-size lists of booleans, ``docs`` the identifiers of the documents that end in the
sequence. A sequence is found by its number without reading others, and memory-mapped files are read without a copy.

Scale: one range partition per file; readers and the global offsets need only the list of files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, only, scratch, written
from .files import make_folder, place
from .wordbpe import encoder

SEQUENCE = 2048
BATCH = 512


def layout(length: int, id_type: pa.DataType) -> pa.Schema:
    fixed = lambda kind: pa.list_(kind, length)
    return pa.schema([("ids", fixed(id_type)), ("mask", fixed(pa.bool_())), ("last", fixed(pa.bool_())), ("docs", pa.list_(pa.int64()))])


class _Writer:
    def __init__(self, sink, length: int, id_type: pa.DataType, batch: int):
        self.schema = layout(length, id_type)
        self.out = pa.ipc.new_file(sink, self.schema)
        self.length, self.room, self.dtype = length, length * batch, id_type.to_pandas_dtype()
        self.ids, self.ends, self.docs, self.held = [], [], [], 0
        self.tokens = 0

    def add(self, ids: np.ndarray, counts: np.ndarray, docs: list) -> None:
        """Documents, end ids included."""
        self.ends.append(self.held + np.cumsum(counts) - 1)
        self.ids.append(ids)
        self.docs += docs
        self.held += ids.size
        if self.held >= self.room:
            self.flush(False)

    def flush(self, final: bool) -> None:
        ids = np.concatenate([np.zeros(0, np.uint32), *self.ids])
        ends = np.concatenate([np.zeros(0, np.int64), *self.ends])
        full = ids.size if final else ids.size - ids.size % self.room
        for lo in range(0, full, self.room):
            n = min(self.room, full - lo)
            self._batch(ids[lo : lo + n], ends, lo, n)
        cut = int(np.searchsorted(ends, full))
        self.docs, self.ids, self.ends, self.held = self.docs[cut:], [ids[full:]], [ends[cut:] - full], ids.size - full
        self.tokens += full

    def _batch(self, ids: np.ndarray, ends: np.ndarray, lo: int, n: int) -> None:
        rows = -(-n // self.length)
        padded = np.zeros(rows * self.length, self.dtype)
        padded[:n] = ids
        mask = np.arange(rows * self.length) < n
        a, b = np.searchsorted(ends, [lo, lo + n])
        last = np.zeros(rows * self.length, bool)
        last[ends[a:b] - lo] = True
        offsets = np.searchsorted(ends[a:b] - lo, np.arange(rows + 1) * self.length).astype(np.int32)
        fixed = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x), self.length)
        docs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(self.docs[a:b], pa.int64()))
        self.out.write_batch(pa.RecordBatch.from_arrays([fixed(padded), fixed(mask), fixed(last), docs], schema=self.schema))

    def close(self) -> None:
        self.flush(True)
        self.out.close()


def write_sequences(
    docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, length: int = SEQUENCE, batch: int = BATCH, partitions: int | None = None
) -> list[tuple[int, str, int, int]]:
    """Encode with the tokenizers library and write one file per range of identifiers.

    Returns the files in order: (number, path, tokens, documents) -- a listing of files, not of documents. Null texts count as
    empty (their only id is the end id); rows with a null id come first; of repeated ids a hash of the text and the place in the
    input decide the order, by which many rows of one id are spread over files. A lost
    task writes its file again under another name, and only the file of the successful attempt is listed.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "sequences")
    make_folder(folder)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, library=True)
        id_type = pa.uint16() if len(enc.vocab.tokens) <= 1 << 16 else pa.uint32()
        number, out = TaskContext.get().partitionId(), None
        count = 0
        for part in chunks(batches, 8 << 20):
            if out is None:
                system, base = place(folder)
                path = f"{folder}/{number:06d}-{uuid.uuid4().hex}.arrow"
                sink = system.open_output_stream(f"{base}/{path.rpartition('/')[2]}")
                out = _Writer(sink, length, id_type, batch)
            ids, counts = enc.encode(part.column(1).to_pylist())  # of the columns doc_id, text, hash, at
            ids = np.insert(ids, np.cumsum(counts), end_id)
            out.add(ids, counts + 1, part.column(0).to_pylist())
            count += part.num_rows
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([path]), pa.array([out.tokens]), pa.array([count])], names=["number", "path", "n_tokens", "n_docs"])

    keyed = only(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("at"))
    ordered = keyed.repartitionByRange(n, "doc_id", "hash", "at").sortWithinPartitions("doc_id", "hash", "at")
    files = written(ordered.mapInArrow(run, "number long, path string, n_tokens long, n_docs long"), "sequence-files")
    return sorted(tuple(r) for r in files.collect())


def read_documents(spark: SparkSession, files: list[tuple[int, str, int, int]]) -> DataFrame:
    """The documents of the files: ``doc_id, start, n_tokens, ids_crc32`` (of the ids as little-endian 32-bit integers)."""
    at, where = 0, {}
    for i, (_, path, tokens, _) in enumerate(files):
        where[i] = path, at
        at += tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                path, start = where[i]
                yield from _documents(path, start)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(run, schema)


def open_sequences(path: str) -> pa.ipc.RecordBatchFileReader:
    """A file's batches; memory-mapped where the file system is the machine's own."""
    system, at = place(path)
    source = pa.memory_map(at) if system.type_name == "local" else system.open_input_file(at)
    return pa.ipc.open_file(source)


def _documents(path: str, start: int) -> Iterator[pa.RecordBatch]:
    carried, crc = 0, 0
    reader = open_sequences(path)
    for b in range(reader.num_record_batches):
        batch = reader.get_batch(b)
        ids = batch.column(0).flatten().to_numpy()
        mask, last = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2))
        wide = ids[: int(mask.sum())].astype("<u4")
        ends = np.flatnonzero(last) + 1
        lo, sizes, crcs = 0, [], []
        for hi in ends.tolist():
            sizes.append(carried + hi - lo)
            crcs.append(zlib.crc32(wide[lo:hi], crc))
            lo, carried, crc = hi, 0, 0
        carried += wide.size - lo
        crc = zlib.crc32(wide[lo:], crc)
        starts = start + np.cumsum(sizes, dtype=np.int64) - np.array(sizes, np.int64)
        start += int(sum(sizes))
        yield pa.RecordBatch.from_arrays(
            [batch.column(3).flatten(), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
        )
