"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations with map-side combining and two joins; a hub with a third of all edges is
spread by the adaptive skew join. Rounds are written to scratch space, so a lost executor costs one round.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _written(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="lakeloom-")
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/components-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """``node, component`` for every node of an undirected graph; the component is its smallest node.

    Edges with a null end and self-loops are ignored, parallel edges count once. No edges give no rows.
    """
    now = _written(
        edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
        .select(F.least(src, dst).alias("b"), F.greatest(src, dst).alias("a"))
        .where("a <> b")
        .distinct()
    )
    mark = None
    for _ in range(max_rounds):
        # large star: every larger neighbour moves to the smallest of the neighbourhood
        around = _both(now)
        least = around.groupBy("a").agg(F.min("b").alias("lo")).select("a", F.least("a", "lo").alias("m"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every smaller neighbour, and the node, move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        now = _written(
            large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct()
        )
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
