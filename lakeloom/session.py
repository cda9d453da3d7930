"""Session construction for tests, the benchmark and local use."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "lakeloom", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators are written for.

    On a cluster the session comes from the launcher instead; no operator builds one.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LAKELOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", os.environ.get("LAKELOOM_CHECKPOINT_DIR", tempfile.mkdtemp(prefix="lakeloom-ckpt-")))
        .getOrCreate()
    )
