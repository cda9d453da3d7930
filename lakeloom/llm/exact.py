"""Exact deduplication with a log-structured merge index.

A task fills a *memtable* with digests. When it is full, equal texts inside it are told apart by their
bytes and the table is flushed as a *run*: rows sorted by digest, with a filter of eight-byte fingerprints of its
digests. The filters of all runs are probed against each other; digests whose fingerprint one run alone
holds are final as flushed. The others are *hits*: the texts behind them are read again and compared byte
by byte, and *compaction* merges the runs by digest, keeping the extreme identifier and the summed count; a
digest that turns out to hold different texts is regrouped by the texts themselves.

Scale: eight bytes a run and digest are probed, and a text leaves its scan only if its digest is a hit, once per
row. A group of copies that holds a third of all rows is one row per memtable from the flush on, so no task sees the
group, and a row finds its group through the representative of its own memtable, a key with at most
``memtable_rows`` rows. Many rows of one id and text are one row of the second read's question.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, chunks, only, written

RUN_SCHEMA = "rk long, doc_id long, sha binary, digest binary, rep_rk long, rep_id long, n long, print long"
#: Hits up to this many rows are broadcast to the second read (16 MB at most); beyond, that read is shuffled.
BROADCAST_HITS = 200_000


def _flush_runs(keep: str, memtable_rows: int, memtable_bytes: int, digest_bytes: int):
    sign = 1 if keep == "max" else -1

    def flush(rows: list, variants: dict) -> pa.RecordBatch:
        best = {}
        for key, texts in variants.items():
            for v, (_, members) in enumerate(texts):
                top = max(members, key=lambda m: (m[1] is not None, sign * (m[1] or 0), -m[0]))
                best[key, v] = (*top, len(members))
        rows.sort(key=lambda r: (r[3], r[0]))
        out: list[list] = [[] for _ in range(8)]
        for rk, doc_id, sha, key, v in rows:
            rep, rep_id, n = best[key, v]
            mark = int.from_bytes(key[:8].ljust(8, b"\0"), "big", signed=True) if rk == rep else None
            for column, value in zip(out, (rk, doc_id, sha, key, rep, rep_id, n, mark), strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["rk", "doc_id", "sha", "digest", "rep_rk", "rep_id", "n", "print"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rk = TaskContext.get().partitionId() << 33
        rows: list = []
        variants: dict = {}
        held = 0
        for batch in chunks(batches, 1 << 20):
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                sha = hashlib.sha256(text).digest()
                key = sha[:digest_bytes]
                texts = variants.setdefault(key, [])
                for v, (known, members) in enumerate(texts):
                    if known == text:
                        members.append((rk, doc_id))
                        break
                else:
                    v = len(texts)
                    texts.append((text, [(rk, doc_id)]))
                    held += len(text)
                rows.append((rk, doc_id, sha, key, v))
                rk += 1
                if len(rows) >= memtable_rows or held >= memtable_bytes:
                    yield flush(rows, variants)
                    rows, variants, held = [], {}, 0
        if rows:
            yield flush(rows, variants)

    return run


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "max",
    normalize: Callable[[Column], Column] | None = None,
    memtable_rows: int = 4096,
    memtable_bytes: int = 16 << 20,
    digest_bytes: int = 32,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are, after ``normalize`` (a column function; nothing by default).
    Of a group the row with the largest (``keep="max"``) or smallest (``"min"``) id stays.

    Defined cases: a null text counts as empty, and empty texts form a group like any other. A null id
    ranks behind every other id and is kept only where its group has no id. Repeated rows (same id and
    text) count in the group size and exactly one of them is kept. An empty input gives no rows. Columns
    besides id and text are ignored. ``digest_bytes`` shortens the index key (for tests of collisions).
    """
    if keep not in ("max", "min"):
        raise ValueError("keep is 'max' or 'min'")
    base = only(docs, id_col, text_col)
    if normalize is not None:
        base = base.withColumn("text", normalize(F.col("text")))
    runs = written(base.mapInArrow(_flush_runs(keep, memtable_rows, memtable_bytes, digest_bytes), RUN_SCHEMA), "lsm-runs")
    if keep == "max":
        best = F.max(F.struct("doc_id", (-F.col("rk")).alias("nrk")))
    else:
        best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("rk").alias("nrk")))
    sized = [best.alias("best"), F.sum("n").alias("group_size")]
    keep_id, keep_rk = F.col("best.doc_id").alias("keep_id"), F.abs(F.col("best.nrk")).alias("keep_rk")

    # probing the filters: what only one run holds needs no merge
    reps = runs.where("print is not null")
    probed = reps.groupBy("print").count().where("count > 1").select("print")
    hits = written(reps.join(probed, "print").select("rk", "doc_id", "sha", "digest", "n"), "lsm-hits")
    n_hits = hits.count()
    own = runs.select("doc_id", "rk", "sha", "rep_rk", "rep_id", "n")
    if not n_hits:
        return own.select("doc_id", F.col("rep_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rk") == F.col("rep_rk")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))

    # byte verification: the texts behind a hit are read again, once for each (id, digest)
    asked = hits.select("digest", F.col("doc_id").alias("h_id"), F.col("sha").alias("h_sha")).distinct()
    if n_hits <= BROADCAST_HITS:
        asked = F.broadcast(asked)
    read = base.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    texts = read.join(asked, read["doc_id"].eqNullSafe(asked["h_id"]) & (read["sha"] == asked["h_sha"])).select("digest", "h_id", "h_sha", "text")
    mixed = written(texts.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo <> hi").select("digest"), "lsm-mixed")

    # compaction: one group for each digest, or for each text where a digest holds several
    split = None
    if not mixed.isEmpty():
        one = texts.join(mixed, "digest", "left_semi").dropDuplicates(["digest", "h_id", "h_sha"]).withColumnRenamed("digest", "h_digest")
        told = hits.join(one, F.expr("digest = h_digest and doc_id <=> h_id and sha = h_sha")).select("rk", "doc_id", "n", "digest", "text")
        regrouped = told.groupBy("digest", "text").agg(*sized)
        split = told.join(regrouped, ["digest", "text"]).select(F.col("rk").alias("rep_rk"), keep_id, keep_rk, "group_size")
        hits = hits.join(mixed, "digest", "left_anti")
    groups = hits.groupBy("digest").agg(*sized).select("digest", keep_id, keep_rk, "group_size")
    found = hits.select("digest", F.col("rk").alias("rep_rk")).join(groups, "digest").select("rep_rk", "keep_id", "keep_rk", "group_size")
    if split is not None:
        found = found.unionByName(split)
    return own.join(found, "rep_rk", "left").select(
        "doc_id",
        F.when(F.col("keep_rk").isNull(), F.col("rep_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", "n").alias("group_size"),
        (F.col("rk") == F.coalesce("keep_rk", "rep_rk")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
