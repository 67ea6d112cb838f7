"""Session set-up shared by tests, the benchmark and interactive use."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every operator is tested with. Results do not depend on the number of
# shuffle partitions: AQE coalesces small ones and splits skewed join partitions.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Larger generated methods are never compiled by the JVM; run those operators unfused.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Call-site capture costs more than building the expression it describes.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # The last of several equal JSON keys counts, as in most JSON readers.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def get_session(app_name: str = "tidepoint", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with the settings the operators expect."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
