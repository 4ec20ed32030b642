"""Row numbers for tables without a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rowtrail.plans import cut


def assign_rowid(df: DataFrame, order_by: list[str], name: str = "_rowid") -> DataFrame:
    """Adds a key column 1..n in the order of ``order_by``, ties broken by all columns.

    Rows are range-partitioned and sorted, so the table never passes through one task; every
    partition then adds the number of rows in the partitions before it. The sorted rows are written
    once, because range bounds are sampled and a second computation could cut elsewhere. A hash of
    the whole row ends the sort key, so a hot ``order_by`` value is split as well.
    """
    others = [c for c in df.columns if c not in order_by]
    rest = F.xxhash64(*df.columns).alias("_hash")
    rows = df.select("*", rest).repartitionByRange(*order_by, "_hash")
    rows = rows.sortWithinPartitions(*order_by, "_hash", *others).drop("_hash")
    place = F.monotonically_increasing_id()
    rows = cut(
        rows.withColumns(
            {"_part": F.shiftright(place, 33).cast("int"), "_at": place.bitwiseAND((1 << 33) - 1)}
        )
    )
    # One row per partition: its count is bounded by the number of tasks, not by the data.
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = rows.join(F.broadcast(offsets), "_part")
    return numbered.select((F.col("_before") + F.col("_at") + 1).alias(name), *df.columns)
