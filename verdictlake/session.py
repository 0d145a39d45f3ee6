"""Session helper: one place for the settings that results depend on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "verdictlake", cpus: int | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster pass your own session to the operators."""
    # Python workers import this package wherever the driver was started
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([top, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    return (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus or os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
