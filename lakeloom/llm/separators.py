"""Token counts by a scan for separators.

The input is flat files of token ids: little-endian, no index, documents ended by one separator id. Files are cut into
blocks that tasks read on their own. Each block is searched at once for the separator; a prefix scan over the
blocks of a file then numbers the documents and adds to a block's first document what earlier blocks hold of it.

Scale: blocks of one file spread over tasks; the scan moves one row per block and one per document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks, only, scratch, written
from .files import make_folder, place
from .wordbpe import encoder

BLOCK_BYTES = 4 << 20
FILE_BYTES = 64 << 20


def write_flat(docs: DataFrame, vocabulary: str, separator: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Encode all texts and write flat uint16 files, each document followed by the separator.

    Returns (files: path, n_bytes; listing: path, ordinal, doc_id). Strings of special tokens in a text are ordinary
    text, so the separator occurs only as such. Null texts count as empty. The files of a lost task are written
    again under other names; only those of the successful attempt are listed.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "flat-tokens")
    make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, special=False)
        if len(enc.vocab.tokens) > 1 << 16:
            raise ValueError(f"{vocabulary}: ids beyond 16 bits")
        task, part, out, path, held, ordinal = TaskContext.get().partitionId(), 0, None, "", 0, 0
        for batch in chunks(batches, 4 << 20):
            ids, counts = enc.encode(batch.column(1).to_pylist())
            ends = np.cumsum(counts)
            at = 0
            doc_ids = batch.column(0).to_pylist()
            while at < len(doc_ids):
                if out is None:
                    system, base = place(folder)
                    path = f"{folder}/{task:06d}-{part:04d}-{uuid.uuid4().hex}.u16"
                    out, held, ordinal = system.open_output_stream(f"{base}/{path.rpartition('/')[2]}"), 0, 0
                first = int(ends[at] - counts[at])
                room = max(1, int(np.searchsorted(ends[at:] - first + np.arange(1, ends.size - at + 1), (file_bytes - held) // 2, "right")))
                to = min(at + room, len(doc_ids))
                flat = np.insert(ids[first : int(ends[to - 1])], ends[at:to] - first, separator)
                out.write(flat.astype("<u2").tobytes())
                held += 2 * flat.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * (to - at)), pa.array(np.arange(ordinal, ordinal + to - at)), pa.array(doc_ids[at:to], pa.int64()), pa.nulls(to - at, pa.int64())],
                    names=["path", "ordinal", "doc_id", "n_bytes"],
                )
                ordinal += to - at
                at = to
                if held >= file_bytes or at < len(doc_ids):
                    out.close()
                    yield _closed(path, held)
                    out, part = None, part + 1
        if out is not None:
            out.close()
            yield _closed(path, held)

    listed = written(only(docs, id_col, text_col).mapInArrow(run, "path string, ordinal long, doc_id long, n_bytes long"), "flat-listing")
    return listed.where("n_bytes is not null").select("path", "n_bytes"), listed.where("n_bytes is null").select("path", "ordinal", "doc_id")


def _closed(path: str, held: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([held], pa.int64())], names=["path", "ordinal", "doc_id", "n_bytes"])


def count_tokens(spark: SparkSession, files: DataFrame, separator: int, token_bytes: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document of the files (``path, n_bytes``): ``path, ordinal, start, n_tokens, ended``.

    ``start`` is the place of the document's first token in its file; ``n_tokens`` is without the separator.
    Defined cases: consecutive separators are empty documents; tokens after the last separator are a last document with
    ``ended`` false; bytes beyond a whole number of ids are ignored; empty files and no files give no rows.
    """
    whole = block_bytes - block_bytes % token_bytes
    usable = f"(n_bytes - n_bytes % {token_bytes})"
    blocks = files.where(f"{usable} > 0").select("path", F.expr(f"{usable} as n_bytes"), F.explode(F.expr(f"sequence(0L, ({usable} - 1) div {whole}L)")).alias("block"))
    spread = blocks.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, n_bytes, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, at = place(path)
                with system.open_input_file(at) as f:
                    ids = np.frombuffer(f.read_at(min(whole, n_bytes - block * whole), block * whole), f"<u{token_bytes}")
                ends = np.flatnonzero(ids == separator)
                sizes = np.diff(ends, prepend=-1) - 1
                tail = ids.size - (int(ends[-1]) + 1 if ends.size else 0)
                n = ends.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * (n + 1)), pa.array(np.full(n + 1, block)), pa.array(np.arange(-1, n)), pa.array(np.r_[ids.size, sizes]), pa.array(np.r_[n, ends]), pa.array([tail] + [None] * n, pa.int64())],
                    names=["path", "block", "k", "n", "at", "tail"],
                )

    found = written(spread.mapInArrow(scan, "path string, block long, k long, n long, at long, tail long"), "separators")
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("path").orderBy("block")
    scanned = (
        found.where("k = -1")
        .select("path", "block", F.col("n").alias("size"), F.col("at").alias("n_ends"), "tail")
        .withColumn("first_ordinal", F.coalesce(F.sum("n_ends").over(earlier), F.lit(0)))
        .withColumn("first_token", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        .withColumn("tails", F.coalesce(F.sum("tail").over(earlier), F.lit(0)))
        .withColumn("cut", F.coalesce(F.max(F.when(F.col("n_ends") > 0, F.col("tails"))).over(earlier), F.lit(0)))
        .withColumn("carry", F.col("tails") - F.col("cut"))
        .withColumn("last", F.lead("block").over(upto).isNull())
    )
    ended = found.where("k >= 0").join(scanned.select("path", "block", "first_ordinal", "first_token", "carry"), ["path", "block"]).select(
        "path",
        F.expr("first_ordinal + k").alias("ordinal"),
        F.expr("first_token + at - n - if(k = 0, carry, 0)").alias("start"),
        F.expr("n + if(k = 0, carry, 0)").alias("n_tokens"),
        F.lit(True).alias("ended"),
    )
    open_ = scanned.where("last").withColumn("n_tokens", F.expr("tail + if(n_ends = 0, carry, 0)")).where("n_tokens > 0").select(
        "path", F.expr("first_ordinal + n_ends").alias("ordinal"), F.expr("first_token + size - n_tokens").alias("start"), "n_tokens", F.lit(False).alias("ended")
    )
    return ended.unionByName(open_)
