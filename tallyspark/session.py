"""Session defaults, applied only where the submitter set nothing."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Runtime settings; none of them changes results except the time zone, which timestamps are read in.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # let AQE split a hot join partition even where that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "tallyspark", master: str | None = None, **conf) -> SparkSession:
    """A session with ``conf``; defaults fill what neither ``conf`` nor the submitter has set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    spark = builder.getOrCreate()
    given = spark.sparkContext.getConf()
    for key, value in DEFAULTS.items():
        if key not in conf and not given.contains(key):
            spark.conf.set(key, value)
    return spark
