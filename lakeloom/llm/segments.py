"""Segments of documents in shared storage, and an exchange that tells each segment which of its keys others hold.

Operators that compare all documents with all others read the documents several times. They are written once as
*segments* (files of bounded size that one task reads again by path), so the text itself is never shuffled. For the
question "which of my keys occur elsewhere?" a segment sends its distinct keys, six bytes each, in one block per bucket;
a bucket's task finds the keys that several segments hold and answers each of them. A key that a third of all
documents hold is one entry per segment, so no task grows with such a key. The listing of segments is a table; buckets
grow with the bytes of all segments, so that one bucket's keys fit in a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, frugal, only, scratch, written
from .files import make_folder, place

SEGMENT_BYTES = 16 << 20
KEY_BYTES = 6
#: Bytes of segments for each bucket, at most.
BUCKET_BYTES = 256 << 20
#: Segments of one task of the writer, as a power of two.
PART_BITS = 16
#: Stands for a null id, behind every other.
NO_ID = np.iinfo(np.int64).max


class Segments:
    """The files of a set of documents."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, segment_bytes: int = SEGMENT_BYTES):
        self.spark = docs.sparkSession
        folder = scratch(self.spark, "segments")
        make_folder(folder)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, writer, held, part = TaskContext.get().partitionId(), None, 0, 0
            closed = lambda: pa.RecordBatch.from_arrays([pa.array([task << PART_BITS | part]), pa.array([f"{folder}/{name}"]), pa.array([held])], names=["seg", "path", "n_bytes"])
            for batch in chunks(batches):
                if writer is None:
                    system, base = place(folder)
                    name = f"{task:06d}-{part:04d}-{uuid.uuid4().hex}.arrow"
                    sink = system.open_output_stream(f"{base}/{name}")
                    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.large_binary())])
                    writer = pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                text = batch.column(1).cast(pa.large_binary())
                writer.write_batch(pa.RecordBatch.from_arrays([batch.column(0), text], schema=schema))
                held += text.nbytes
                if held >= segment_bytes:
                    writer.close()
                    sink.close()
                    yield closed()
                    writer, held, part = None, 0, part + 1
            if writer is not None:
                writer.close()
                sink.close()
                yield closed()

        listed = written(only(docs, id_col, text_col).mapInArrow(frugal(run), "seg long, path string, n_bytes long"), "segment-list")
        self.listing = listed.select("seg", "path")
        self.count, n_bytes, parts, tasks = listed.agg(F.count("*"), F.sum("n_bytes"), F.max(F.expr(f"seg & {(1 << PART_BITS) - 1}")) + 1, F.max(F.expr(f"shiftright(seg, {PART_BITS})")) + 1).first()
        #: Partitions with one segment each, if the writer's tasks made about as many each.
        self._room = min((parts or 0) * (tasks or 0), 4 * self.count) or 1
        self._partition = F.expr(f"cast(pmod(shiftright(seg, {PART_BITS}) * {parts or 1} + (seg & {(1 << PART_BITS) - 1}), {self._room}) as int)")
        #: Partitions for what is dealt out by key.
        self.buckets = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-(n_bytes or 0) // BUCKET_BYTES))

    def rows(self) -> DataFrame:
        """``seg, path``, about one a partition."""
        return self.listing.repartitionById(self._room, self._partition)

    def with_blocks(self, blocks: DataFrame) -> DataFrame:
        """``seg, path, block``: each segment's path and the blocks (``seg, block``) meant for it, one after another."""
        return (
            self.listing.select("seg", "path", F.lit(None).cast("binary").alias("block"))
            .unionByName(blocks.select("seg", F.lit(None).cast("string").alias("path"), "block"))
            .repartitionById(self._room, self._partition)
            .sortWithinPartitions("seg")
        )


def read_segment(path: str) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Ids (``NO_ID`` for null) and texts of a segment, a few megabytes at a time."""
    system, at = place(path)
    with system.open_input_stream(at) as f:
        for batch in pa.ipc.open_stream(f):
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            yield ids, batch.column(1).to_pylist()


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, list[bytes]]]:
    """Per segment of the partition, which is sorted by them: number, path, its blocks."""
    now, where, blocks = None, "", []
    for batch in batches:
        for seg, path, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if seg != now:
                if now is not None:
                    yield now, where, blocks
                now, blocks = seg, []
            if path is not None:
                where = path
            if block is not None:
                blocks.append(block)
    if now is not None:
        yield now, where, blocks


def pack_keys(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def unpack_keys(data: bytes | memoryview) -> np.ndarray:
    flat = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    wide = np.zeros((flat.shape[0], 8), np.uint8)
    wide[:, :KEY_BYTES] = flat
    return wide.view("<u8").ravel()


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """The part of a 64-bit hash that is exchanged."""
    return hashes >> np.uint64(64 - 8 * KEY_BYTES)


def shared_keys(segments: Segments, keys: Callable[[str], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``seg, block``: for each segment the keys that other segments hold too, with their summed counts.

    ``keys(path)`` gives a segment's distinct fingerprints (sorted) and their counts in it. A block unpacks with ``unpack_answer``.
    """
    buckets = segments.buckets

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, counts = keys(path)
                to = (found % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                found, counts, to = found[order], np.minimum(counts[order], 255).astype(np.uint8), to[order]
                cuts = np.searchsorted(to, np.arange(buckets + 1))
                for b in range(buckets):
                    lo, hi = cuts[b], cuts[b + 1]
                    if hi > lo:
                        block = pack_keys(found[lo:hi]) + counts[lo:hi].tobytes()
                        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([seg], pa.int64()), pa.array([block], pa.binary())], names=["bucket", "seg", "block"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, counts, owners = [], [], []
        for batch in batches:
            for seg, block in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n = len(block) // (KEY_BYTES + 1)
                found.append(unpack_keys(memoryview(block)[: n * KEY_BYTES]))
                counts.append(np.frombuffer(block, np.uint8, n, n * KEY_BYTES))
                owners.append(np.full(n, seg, np.int64))
        if not found:
            return
        key, count, owner = np.concatenate(found), np.concatenate(counts).astype(np.int64), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        key, count, owner = key[order], count[order], owner[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, key.size])
        total = np.minimum(np.add.reduceat(count, first), 255).astype(np.uint8)
        many = np.repeat(size > 1, size)
        key, owner, total = key[many], owner[many], np.repeat(total, size)[many]
        order = np.argsort(owner, kind="stable")
        key, owner, total = key[order], owner[order], total[order]
        for seg in np.unique(owner):
            lo, hi = np.searchsorted(owner, [seg, seg + 1])
            yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int64()), pa.array([pack_keys(key[lo:hi]) + total[lo:hi].tobytes()], pa.binary())], names=["seg", "block"])

    sent = segments.rows().mapInArrow(frugal(send), "bucket int, seg long, block binary")
    return sent.repartitionById(buckets, F.col("bucket")).mapInArrow(frugal(answer), "seg long, block binary")


def unpack_answer(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their counts over all segments (255 stands for 255 and more)."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
    for block in blocks:
        n = len(block) // (KEY_BYTES + 1)
        keys.append(unpack_keys(memoryview(block)[: n * KEY_BYTES]))
        counts.append(np.frombuffer(block, np.uint8, n, n * KEY_BYTES))
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    return key[order], count[order]
