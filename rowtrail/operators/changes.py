"""Change logs in batch form.

A change log has ``seq`` (append order), ``table_name``, ``pk`` and ``change_type`` (I, U or D).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowtrail.functions.address import row_digest
from rowtrail.operators.diff import aligned, diff_rows, prefix_filter, value_columns
from rowtrail.plans import cut, join_small

OPS = ["D", "I", "U"]


def known_changes(change_log: DataFrame) -> DataFrame:
    return change_log.filter(F.col("change_type").isin(OPS))


def tracked_changes(change_log: DataFrame, table: str) -> DataFrame:
    """One (seq, pk, op) per log row of ``table`` in append order, not netted."""
    rows = known_changes(change_log).filter(F.col("table_name") == table)
    return rows.select("seq", "pk", F.col("change_type").alias("op")).orderBy("seq")


def status_columns() -> list[Column]:
    kinds = (("U", "modified"), ("I", "new"), ("D", "deleted"))
    counts = [F.count_if(F.col("change_type") == code).alias(name) for code, name in kinds]
    return [*counts, F.count(F.lit(1)).alias("total")]


def status(change_log: DataFrame) -> DataFrame:
    """Log rows per dataset by kind, with their total; datasets without changes do not appear."""
    return known_changes(change_log).groupBy("table_name").agg(*status_columns())


def net_changes(change_log: DataFrame) -> DataFrame:
    """Last change per (table_name, pk) by ``seq``, which is unique within the log.

    Both values of the aggregate are numbers, so it hashes and combines before the shuffle, and a hot
    key costs one row per task.
    """
    code = F.array_position(F.array(*map(F.lit, OPS)), F.col("change_type")).cast("int")
    last = known_changes(change_log).withColumns({"_code": code, "seq": F.col("seq").cast("bigint")})
    last = last.groupBy("table_name", "pk").agg(F.max_by("_code", "seq").alias("_code"), F.max("seq").alias("seq"))
    op = F.element_at(F.array(*map(F.lit, OPS)), F.col("_code"))
    return last.select("table_name", "pk", op.alias("op"), "seq")


def one_table(change_log: DataFrame, table: str | None) -> DataFrame:
    """The rows of ``table``; without a name, all rows as those of one table, so a key counts once."""
    if table is not None:
        return change_log.filter(F.col("table_name") == table)
    return change_log.withColumn("table_name", F.lit(""))


def replace_rows(base: DataFrame, net: DataFrame, upserts: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` without the keys of ``net``, plus ``upserts``; keys are not NULL.

    Columns that only one side has are NULL in the other's rows; those of ``base`` come first.
    Retyped ones take the type that holds both.
    A net change set proven small is broadcast, so ``base`` is only scanned. Callers write ``net``
    first, because measuring it reads it once more.
    """
    kept = join_small(base, net.select(*keys), keys, "left_anti")
    return put_together(kept, upserts, keys)


def put_together(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of both; a column that one lacks is NULL there, a retyped one has the type that holds both."""
    order = rows.columns + [c for c in more.columns if c not in rows.columns]
    names = [c for c in order if c not in keys]
    both = aligned(rows, keys, names, more), aligned(more, keys, names, rows)
    return both[0].select(*order).unionByName(both[1].select(*order))


def with_current(net: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """``net`` with the values of ``current``, NULL where it has no such row.

    ``current`` is first restricted to the keys of ``net``; while those are proven small it is only
    scanned.
    """
    found = join_small(current, net.select(*keys), keys, "left_semi")
    return net.join(found, keys, "left")


def apply_net(base: DataFrame, net: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Replay of net changes (key column and ``op``) with values read from ``current``.

    The net changes are used several times, so they are written once.
    """
    net = cut(net)
    upserts = with_current(net.filter(F.col("op") != "D").select(key), current, [key])
    return replace_rows(base, net, upserts, [key])


def apply_changes(
    base: DataFrame, change_log: DataFrame, current: DataFrame, key: str, table: str | None = None
) -> DataFrame:
    """``base`` after replaying the log: I and U upsert the row of ``current``, D removes.

    Removing a missing row does nothing; columns ``current`` lacks become NULL, new ones are added.
    The log's text keys are cast to the type of ``key``. Name the ``table`` where the log holds
    several whose keys overlap; without it all rows belong to one table.
    """
    net = net_changes(one_table(change_log, table))
    net = net.select(F.col("pk").cast(base.schema[key].dataType).alias(key), "op")
    return apply_net(base, net, current, key)


def clear_changes(change_log: DataFrame, table: str) -> DataFrame:
    """The log without one table's rows."""
    return change_log.filter(F.col("table_name") != table)


def split_by_filters(change_log: DataFrame, filters: list[str]) -> tuple[DataFrame, DataFrame]:
    """Log rows of the datasets the prefix filters select, and the rows that stay pending."""
    selected = prefix_filter(F.col("table_name"), filters)
    return change_log.filter(selected), change_log.filter(~selected)


def selective_sync(
    base: DataFrame, change_log: DataFrame, current: DataFrame, key: str, filters: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Replay only selected datasets; returns the new table and the pending log.

    ``base`` and ``current`` hold all datasets, told apart by ``table_name``.
    """
    chosen, pending = split_by_filters(change_log, filters)
    net = net_changes(chosen)
    net = cut(net.select("table_name", F.col("pk").cast(base.schema[key].dataType).alias(key), "op"))
    keys = ["table_name", key]
    upserts = with_current(net.filter(F.col("op") != "D").select(*keys), current, keys)
    return replace_rows(base, net, upserts, keys), pending


def diff_working(base: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Delta of a working copy that has no log."""
    return diff_rows(base, current, keys)


def fingerprint_changes(prev: DataFrame, cur: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and ``op`` of changed rows, found by comparing row digests; no values are shuffled.

    As in a row diff, a column that one side lacks is NULL there.
    """
    names = sorted(value_columns(prev, cur, keys))
    prev, cur = aligned(prev, keys, names, cur), aligned(cur, keys, names, prev)
    a = prev.select(*keys, row_digest(prev, names).alias("digest"))
    b = cur.select(*keys, row_digest(cur, names).alias("digest"))
    return diff_rows(a, b, keys).select(*keys, "op")


def upsert_by_key(df: DataFrame, new: DataFrame, keys: list[str], mode: str = "replace") -> DataFrame:
    """Insert ``new`` rows; an existing key is replaced, or kept with ``mode="ignore"``."""
    if mode == "replace":
        new = cut(new)  # measured, joined and appended
        return replace_rows(df, new, new, keys)
    if mode != "ignore":
        raise ValueError("mode is 'replace' or 'ignore'")
    added = new.join(df.select(*keys), keys, "left_anti")
    return put_together(df, added, keys)
