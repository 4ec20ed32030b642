"""Session settings the operators are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime settings only: safe to apply to a session somebody else created.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Batches handed to Python are bounded in bytes too: rows may hold long texts or geometries.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    # Lists of directory names reach the Parquet page index value by value.
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
    # Partitions known at run time to be small are joined by hash, which saves both sorts.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for name, value in RUNTIME.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = 8, app: str = "rowtrail", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores if cores != "*" else 8))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
