"""Packing by optimal length buckets.

A histogram over all rows gives, by dynamic programming, the bucket boundaries that minimise padding. Inside
each bucket rows are laid in order of length and cut into batches of at most a budget of padded tokens.

Scale: the histogram has a bin for each length below ``EXACT`` and ``PER_OCTAVE`` bins for each doubling beyond, so one
long text coarsens no other's bin; a bin carries its exact largest length. That is at most ``MAX_BINS`` bins whatever the
input (lengths up to 2^39), so the driver's part is constant. Lengths are counted once and written with a key of the row;
texts are not read again. A row's place in its bucket is (places of shorter bins) + (places of earlier salts of its
bin) + (rank within bin and salt); salts come from the row key and are so many that a length shared by a third of all
rows, or an id that many rows share, is spread like any other.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written
from .wordbpe import count_ids

#: Lengths below this have a bin each; beyond, lengths of a bin differ by less than one part in PER_OCTAVE.
EXACT = 1 << 15
PER_OCTAVE = 1 << 12
MAX_BINS = 1 << 17
BUCKETS = 32
TOKEN_BUDGET = 1 << 18
#: Rows ranked together at most, roughly; with many partitions fewer.
MAX_RANKED = 8192


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The at most ``buckets`` boundaries, from ascending distinct lengths and their counts, with the least padding."""
    lengths, counts = np.asarray(lengths).astype(np.int64).tolist(), np.asarray(counts).astype(np.int64).tolist()
    n = len(lengths)
    if not n:
        return []
    upto = [0, *itertools.accumulate(counts)]
    best = [x * c for x, c in zip(lengths, upto[1:], strict=True)]  # one bucket for the first j + 1 lengths
    choice: list[list[int]] = []
    for _ in range(1, min(buckets, n)):
        # a bucket from i + 1 to j costs best[i] + lengths[j] * (upto[j + 1] - upto[i + 1]): lines in lengths[j] with falling
        # slopes, of which the lower hull is kept, asked at rising lengths
        after, pick = best.copy(), [-1] * n
        hull: list[int] = []
        at = 0
        for j in range(1, n):
            new = j - 1
            while len(hull) - at >= 2:
                one, two = hull[-2], hull[-1]
                if (best[new] - best[one]) * (upto[two + 1] - upto[one + 1]) > (best[two] - best[one]) * (upto[new + 1] - upto[one + 1]):
                    break
                hull.pop()
            hull.append(new)
            x = lengths[j]
            while at + 1 < len(hull) and best[hull[at + 1]] - x * upto[hull[at + 1] + 1] < best[hull[at]] - x * upto[hull[at] + 1]:
                at += 1
            cost = best[hull[at]] + x * (upto[j + 1] - upto[hull[at] + 1])
            if cost < after[j]:
                after[j], pick[j] = cost, hull[at]
        choice.append(pick)
        best = after
    ends, j = [], n - 1
    for pick in reversed(choice):
        if pick[j] < 0:
            continue
        ends.append(j)
        j = pick[j]
    ends.append(j)
    return [lengths[j] for j in reversed(ends)]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: Column | None = None,
    vocabulary: str | None = None,
    buckets: int = BUCKETS,
    token_budget: int = TOKEN_BUDGET,
) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, bucket, bucket_tokens, batch, slot, padding``.

    A row's tokens are the ids that ``vocabulary`` (a file) gives its whole text and an end token, or what the column ``length``
    says; without either, the bytes of its text and an end token. ``bucket_tokens`` is the
    bucket's boundary, ``batch`` numbers the batches of a bucket and ``slot`` the rows of a batch. A batch holds
    ``token_budget // bucket_tokens`` rows, one at least, so a text longer than the budget is a batch of its own.

    Defined cases: a null text counts as empty (length 1), a null or negative length as 0; rows with a null id and
    repeated rows are packed like others; an empty input gives no rows; other columns are ignored.
    """
    if vocabulary is not None and length is None:
        sized = count_ids(docs, vocabulary, id_col, text_col).withColumn("n_tokens", F.col("n_tokens") + 1)
    else:
        size = F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) + 1 if length is None else length
        sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("n_tokens"))
    # written, so that the keys of rows stay what they are
    rows = written(sized.select("doc_id", "n_tokens", F.monotonically_increasing_id().alias("row_key")), "lengths")
    spark = docs.sparkSession
    shift = f"if(n_tokens < {EXACT}, 0, length(bin(n_tokens)) - {PER_OCTAVE.bit_length()})"
    bin_ = F.expr(f"shiftleft(shiftright(n_tokens, {shift}), {shift})")
    histogram = sorted((b, top, n) for b, top, n in rows.groupBy(bin_.alias("bin")).agg(F.max("n_tokens"), F.count("*")).collect())  # MAX_BINS rows at most
    total = sum(n for _, _, n in histogram)
    ranked = max(16, min(MAX_RANKED, total // (8 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    bounds = optimal_boundaries(np.array([top for _, top, _ in histogram]), np.array([n for _, _, n in histogram]), buckets)
    plan, bucket, before = [], 0, 0
    for b, top, n in histogram:
        while top > bounds[bucket]:
            bucket, before = bucket + 1, 0
        plan.append((b, bucket, bounds[bucket], before, -(-n // ranked)))
        before += n
    bins = spark.createDataFrame(plan, "bin long, bucket int, bucket_tokens long, before long, salts long")
    salted = rows.withColumn("bin", bin_).join(F.broadcast(bins), "bin").withColumn("salt", F.expr("pmod(xxhash64(row_key), salts)"))
    offsets = (
        salted.groupBy("bin", "salt").agg(F.count("*").alias("n"))
        .withColumn("earlier", F.coalesce(F.sum("n").over(W.partitionBy("bin").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select("bin", "salt", "earlier")
    )
    rank = F.row_number().over(W.partitionBy("bin", "salt").orderBy("row_key")) - 1
    place = salted.withColumn("rank", rank).join(offsets, ["bin", "salt"]).withColumn("place", F.expr("before + earlier + rank"))
    capacity = F.expr(f"greatest(1L, {token_budget}L div greatest(bucket_tokens, 1L))")
    return place.withColumn("capacity", capacity).select(
        "doc_id",
        "n_tokens",
        "bucket",
        "bucket_tokens",
        F.expr("place div capacity").alias("batch"),
        F.expr("place % capacity").alias("slot"),
        F.expr("bucket_tokens - n_tokens").alias("padding"),
    )
