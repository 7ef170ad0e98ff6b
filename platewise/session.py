"""One place for the session settings the library expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "platewise", cores: str | None = None) -> SparkSession:
    """A session with UTC, ANSI and adaptive execution on; on a cluster the master comes from spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if "spark.master" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        builder = builder.master(f"local[{cores or os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", cores or "8").config("spark.driver.memory", "8g")
    return builder.getOrCreate()
