"""Continuous status and continuous replay of a change-log stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rowtrail.operators.changes import (
    known_changes,
    net_changes,
    one_table,
    replace_rows,
    status_columns,
    with_current,
)
from rowtrail.plans import cut


def stream_status(log: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the counts of changes per dataset in the Parquet table ``target``.

    The state holds one row per dataset. Each batch writes its own version and then drops nothing:
    :func:`read_status` takes the newest complete one, so a repeated batch changes no result.
    """
    counts = known_changes(log).groupBy("table_name").agg(*status_columns())

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/version={batch_id}")

    return (
        counts.writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_status(spark: SparkSession, target: str) -> DataFrame:
    """Newest version of the status table."""
    versions = spark.read.parquet(target)
    newest = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == newest).drop("version")


def stream_apply(
    log: DataFrame, current, key: str, target: str, checkpoint: str, table: str | None = None
) -> StreamingQuery:
    """Append each batch's net changes with their values to the Parquet table ``target``.

    ``current`` is a function that returns the current rows. A batch overwrites only its own folder,
    so replaying it after a failure leaves the same data. Each batch scans the current rows once and
    writes only what it changed; :func:`read_applied` merges on read and :func:`compact` folds the
    batches into a base. Name the ``table`` where the log holds several.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = current()
        net = net_changes(one_table(batch, table))
        net = cut(net.select(F.col("pk").cast(rows.schema[key].dataType).alias(key), "op", "seq"))
        values = [c for c in rows.columns if c != key]
        new = F.when(F.col("op") != "D", F.struct(*values)).alias("new")
        found = with_current(net, rows, [key]).select(key, "op", "seq", new)
        found.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_applied(base: DataFrame, target: str, key: str) -> DataFrame:
    """``base`` with all applied batches: the last change of a key wins."""
    changes = base.sparkSession.read.parquet(target)
    # The newest change of a key by number first: a hash aggregate that carries no rows.
    newest = changes.groupBy(key).agg(F.max("seq").alias("seq"))
    last = cut(changes.join(newest, [key, "seq"]).select(key, "op", "new").dropDuplicates([key]))
    upserts = last.filter(F.col("op") != "D").select(key, "new.*")
    return replace_rows(base, last, upserts, [key])


def compact(base: DataFrame, target: str, key: str, path: str) -> DataFrame:
    """Write the merged table to ``path`` as the next base."""
    read_applied(base, target, key).write.mode("overwrite").parquet(path)
    return base.sparkSession.read.parquet(path)
