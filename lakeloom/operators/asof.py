"""As-of and validity-window joins.

The right rows are unioned under the left ones and carried along the time axis by a window that runs forward (or, for
the row after, from the end backward), so the cost is a sort of both sides and one running value, never the pairs. Each right row travels as one struct, so its null columns survive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str | None = None,
    by: list[str] | None = None,
    strategy: str = "backward",
    tolerance: int | None = None,
    strict: bool = False,
    tie: list[str] | None = None,
    suffix: str = "_right",
    keep_key: bool = False,
) -> DataFrame:
    """Each left row with the nearest right row in time.

    ``backward`` takes the last right row at or before the left time, ``forward`` the first at or after, ``nearest`` the
    closer of the two (the earlier one of a tie). ``strict`` leaves out equal times. ``tolerance`` (days for dates, the unit of
    the number otherwise) empties matches that are further away. Of right rows at one time the last by ``tie`` is taken (the
    first when forward). Left rows with a null time, and rows whose keys do not match, keep nulls. Right columns that clash
    get the suffix; the right time is kept as ``right_on`` (or under the suffix) if ``keep_key``.
    """
    if strategy not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown strategy {strategy}")
    by, right_on = list(by or []), right_on or left_on
    taken = set(left.columns)
    payload = [c for c in right.columns if c not in by and (c != right_on or keep_key)]
    if keep_key and right_on not in payload:
        payload.append(right_on)
    name = lambda c: c + suffix if c in taken else c
    ties = list(tie or [])
    row = F.struct(*[F.col(c).alias(c) for c in dict.fromkeys([*payload, right_on])])
    one_type = left.schema[left_on].dataType
    rights = right.where(F.col(right_on).isNotNull()).select(
        *by, F.col(right_on).cast(one_type).alias("_t"), row.alias("_r"), F.struct(*[F.col(c) for c in ties], F.lit(0).alias("_")).alias("_tie"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l")
    )
    lefts = left.select(*by, F.col(left_on).alias("_t"), F.lit(None).cast(rights.schema["_r"].dataType).alias("_r"), F.lit(None).cast(rights.schema["_tie"].dataType).alias("_tie"), F.struct(*left.columns).alias("_l"))
    both = lefts.unionByName(rights)
    is_left = F.col("_l").isNotNull()

    def seen(direction: str) -> Column:
        # at equal times the right rows stand where the left row sees them, or past it when strict
        right_first = (direction == "backward") != strict
        side = F.when(is_left, 1 if right_first else 0).otherwise(0 if right_first else 1)
        if direction == "backward":
            w = W.partitionBy(*by).orderBy(F.col("_t").asc_nulls_last(), side, F.col("_tie").asc_nulls_first())
        else:  # the same order reversed: a running value either way, where a frame that shrinks would be read anew for each row
            w = W.partitionBy(*by).orderBy(F.col("_t").desc_nulls_first(), side.desc(), F.col("_tie").desc_nulls_last())
        return F.last("_r", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))

    if strategy == "nearest":
        both = both.withColumn("_b", seen("backward")).withColumn("_f", seen("forward"))
    else:
        both = both.withColumn("_m", seen(strategy))
    date_like = dict(left.dtypes)[left_on] == "date"
    gap = lambda m: F.abs(F.datediff(F.col("_t"), m[right_on])) if date_like else F.abs(F.col("_t") - m[right_on])
    out = both.where(is_left)
    if strategy == "nearest":
        b, f = F.col("_b"), F.col("_f")
        out = out.withColumn("_m", F.when(b.isNull(), f).when(f.isNull(), b).when(gap(f) < gap(b), f).otherwise(b))
    usable = F.col("_t").isNotNull()
    for k in by:
        usable = usable & F.col(k).isNotNull()
    if tolerance is not None:
        usable = usable & (gap(F.col("_m")) <= tolerance)
    out = out.withColumn("_m", F.when(usable, F.col("_m")))
    return out.select(*[F.col("_l")[c].alias(c) for c in left.columns], *[F.col("_m")[c].alias(name(c)) for c in payload])


def validity_join(left: DataFrame, windows: DataFrame, date: str, by: list[str], valid_from: str = "valid_from", valid_to: str = "valid_to", grace: int = 0) -> DataFrame:
    """Each left row with the window (not overlapping others of its key) that holds its date; nulls outside all windows.

    The last window that starts at or before the date, unless it ended (a null end is open) more than ``grace`` days before.
    """
    extra = [c for c in windows.columns if c not in by]
    names = {c: c if c not in left.columns else f"{c}_right" for c in extra}
    joined = asof_join(left, windows, date, valid_from, by, keep_key=True)
    end = F.col(names[valid_to])
    alive = F.col(names[valid_from]).isNotNull() & (end.isNull() | (F.col(date) <= F.date_add(end, grace)))
    return joined.select(*left.columns, *[F.when(alive, F.col(names[c])).alias(names[c]) for c in extra])
