"""Session settings shared by tests, bench and ad-hoc runs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(app: str = "spindrift", cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session; a cluster brings its own settings and never calls this."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
