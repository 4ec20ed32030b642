"""Keyed row diffs and path-level diffs.

A delta has the key columns plus ``op`` (I, U or D), ``old`` and ``new`` structs and
``changed_columns`` (names in schema order, filled for updates).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowtrail.functions.address import any_of
from rowtrail.functions.text import format_value

DATASET_MARKER = "/.table-dataset/"


def value_columns(old: DataFrame, new: DataFrame, keys: list[str]) -> list[str]:
    """Non-key columns in the order of ``new``, then those only ``old`` has."""
    names = [c for c in new.columns if c not in keys]
    return names + [c for c in old.columns if c not in keys and c not in names]


# Decimal digits that hold every value of an integer type.
INTEGER_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
MAX_DIGITS = 38


def _exact(a: T.DataType) -> tuple[int, int] | None:
    """Digits before and after the point of a whole or decimal type."""
    if isinstance(a, T.DecimalType):
        return a.precision - a.scale, a.scale
    return (INTEGER_DIGITS[type(a)], 0) if type(a) in INTEGER_DIGITS else None


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """Type that both versions of a retyped column are compared in; it holds every value of both.

    Whole numbers meet in bigint, decimals and whole numbers in the decimal of all their digits, floats
    and whole numbers of up to 32 bits in double, dates and timestamps in timestamp. Anything else
    meets in text: also numbers that no type holds together, as bigint and double (:func:`number_text`).
    """
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
        return T.LongType()
    if (x := _exact(a)) and (y := _exact(b)):
        whole, scale = max(x[0], y[0]), max(x[1], y[1])
        return T.DecimalType(whole + scale, scale) if whole + scale <= MAX_DIGITS else T.StringType()
    if all(isinstance(t, (T.DoubleType, T.FloatType, T.ByteType, T.ShortType, T.IntegerType)) for t in (a, b)):
        return T.DoubleType()
    if isinstance(a, T.DatetimeType) and isinstance(b, T.DatetimeType):
        return T.TimestampType()
    return T.StringType()


def number_text(value: Column, dtype: T.DataType) -> Column:
    """Numbers of any type as plain text: equal text stands for equal numbers.

    No zeros after the last digit of a fraction. A double is its shortest decimal; one that 38 digits with 18
    of them after the point do not give back keeps its exponent, and so differs from every decimal.
    """
    if isinstance(dtype, T.DecimalType):
        if dtype.scale in (0, MAX_DIGITS):
            return value.cast("string")
        # Small numbers may be spelled with an exponent, except beside a one.
        size, beside = F.abs(value), T.DecimalType(dtype.scale + 1, dtype.scale)
        small = F.concat(F.lit("0"), F.substring((size.cast(beside) + F.lit(1).cast(beside)).cast(beside).cast("string"), 2, MAX_DIGITS + 1))
        shown = F.when(size < 1, small).otherwise(size.cast("string"))
        return F.concat(F.when(value < 0, "-").otherwise(""), F.regexp_replace(shown, r"\.?0+$", ""))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        wide, shortest = value.cast("double"), value.cast("string")
        whole = (wide == F.floor(wide)) & (wide >= F.lit(-(2.0**63))) & (wide < F.lit(2.0**63))
        decimal = shortest.try_cast("decimal(38,18)")
        back = decimal.cast(dtype) == value
        return F.when(whole, wide.try_cast("bigint").cast("string")).when(back, number_text(decimal, T.DecimalType(38, 18))).otherwise(shortest)
    return value.cast("string")


def aligned(df: DataFrame, keys: list[str], names: list[str], *others: DataFrame) -> DataFrame:
    """``keys`` and ``names`` of ``df`` in the types it shares with ``others``; what it lacks is NULL."""
    columns = []
    for c in names:
        types = [x.schema[c].dataType for x in (df, *others) if c in x.columns]
        shared = reduce(common_type, types)
        if c not in df.columns:
            columns.append(F.lit(None).cast(shared).alias(c))
        elif len(set(types)) == 1:
            columns.append(F.col(c))
        elif isinstance(shared, T.StringType) and all(isinstance(t, (T.NumericType, T.NullType)) for t in types):
            columns.append(number_text(F.col(c), types[0]).alias(c))
        else:
            columns.append(F.col(c).cast(shared).alias(c))
    return df.select(*keys, *columns)


def row_struct(df: DataFrame, names: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in names])


def op_of(old: Column, new: Column) -> Column:
    return F.when(old.isNull(), "I").when(new.isNull(), "D").otherwise("U")


def changed_names(old: Column, new: Column, names: list[str]) -> Column:
    """Names whose values differ, NULL-safe, in the given order; empty unless both rows exist."""
    marks = [F.when(~old[c].eqNullSafe(new[c]), c) for c in names]
    both = old.isNotNull() & new.isNotNull()
    return F.when(both, F.array_compact(F.array(*marks))).otherwise(F.array().cast("array<string>"))


def delta_of(joined: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Delta out of rows that hold ``old`` and ``new`` structs side by side."""
    old, new = F.col("old"), F.col("new")
    return joined.filter(~old.eqNullSafe(new)).select(
        *keys,
        op_of(old, new).alias("op"),
        "old",
        "new",
        changed_names(old, new, names).alias("changed_columns"),
    )


def full_join(left: DataFrame, right: DataFrame, keys: list[str], keys_not_null: bool = False) -> DataFrame:
    """Full outer join by NULL-safe keys; each key column comes out once."""
    if keys_not_null:
        return left.join(right, keys, "full")
    others = [c for df in (left, right) for c in df.columns if c not in keys]
    left = left.withColumnsRenamed({k: f"_left_{k}" for k in keys})
    matches = [F.col(f"_left_{k}").eqNullSafe(F.col(k)) for k in keys]
    joined = left.join(right, matches, "full")
    return joined.select(*[F.coalesce(F.col(k), F.col(f"_left_{k}")).alias(k) for k in keys], *others)


def diff_rows(old: DataFrame, new: DataFrame, keys: list[str], keys_not_null: bool = False) -> DataFrame:
    """Delta from ``old`` to ``new``; keys must be unique on each side.

    A column that one side lacks is NULL there, and one whose type changed is compared in the common
    type of :func:`common_type`.
    One exchange per side. Keys compare NULL-safe; ``keys_not_null=True`` uses plain equality,
    which also lets tables bucketed or partitioned by key join without an exchange.
    """
    names = value_columns(old, new, keys)
    old, new = aligned(old, keys, names, new), aligned(new, keys, names, old)
    left = old.select(*keys, row_struct(old, names).alias("old"))
    right = new.select(*keys, row_struct(new, names).alias("new"))
    return delta_of(full_join(left, right, keys, keys_not_null), keys, names)


def filter_delta(delta: DataFrame, op: str) -> DataFrame:
    """Rows of one change kind: ``I``, ``U`` or ``D``."""
    return delta.filter(F.col("op") == op)


def _op_counts(op: Column, insert: str, update: str, delete: str) -> list[Column]:
    return [
        F.count_if(op == code).alias(name) for code, name in (("I", insert), ("U", update), ("D", delete))
    ]


def diff_summary(delta: DataFrame) -> DataFrame:
    """One row with ``inserts``, ``updates`` and ``deletes``; zeros for an empty delta."""
    return delta.agg(*_op_counts(F.col("op"), "inserts", "updates", "deletes"))


def diff_stat_by_dataset(deltas: DataFrame) -> DataFrame:
    """``added``, ``modified`` and ``deleted`` per ``dataset``."""
    return deltas.groupBy("dataset").agg(*_op_counts(F.col("op"), "added", "modified", "deleted"))


def dataset_of_path(path: Column) -> Column:
    """Text before the first dataset marker, or the whole path without one."""
    return F.substring_index(path, DATASET_MARKER, 1)


def path_diff_stat(paths: DataFrame) -> DataFrame:
    """:func:`diff_stat_by_dataset` of path-level changes (``status`` A, M or D, and ``path``)."""
    op = F.translate("status", "AM", "IU")
    return diff_stat_by_dataset(paths.select(dataset_of_path(F.col("path")).alias("dataset"), op.alias("op")))


def tree_diff(tree_a: DataFrame, tree_b: DataFrame) -> DataFrame:
    """``status`` (A, M, D) and ``path`` of two (path, digest) trees; no rename detection."""
    a = tree_a.select("path", F.col("digest").alias("_a"))
    b = tree_b.select("path", F.col("digest").alias("_b"))
    status = F.when(F.col("_a").isNull(), "A").when(F.col("_b").isNull(), "D").otherwise("M")
    joined = a.join(b, "path", "full").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    return joined.select(status.alias("status"), "path")


def row_changes_long(delta: DataFrame, keys: list[str]) -> DataFrame:
    """One row per changed column with rendered ``old`` and ``new`` values.

    An update lists its changed columns, an insert every new value, a delete one row with the key
    alone. ``column`` is NULL for a delete.
    """
    fields = delta.schema["new"].dataType.fields
    entries = []
    for field in fields:
        old, new = F.col("old")[field.name], F.col("new")[field.name]
        listed = (F.col("op") == "I") | ((F.col("op") == "U") & ~old.eqNullSafe(new))
        entry = F.struct(
            F.lit(field.name).alias("column"),
            F.when(F.col("op") == "U", format_value(old, field.dataType)).alias("old"),
            format_value(new, field.dataType).alias("new"),
        )
        entries.append(F.when(listed, entry))
    lines = delta.select(*keys, "op", F.explode_outer(F.array_compact(F.array(*entries))).alias("_line"))
    return lines.select(*keys, "op", "_line.column", "_line.old", "_line.new")


def prefix_filter(dataset: Column, filters: list[str]) -> Column:
    """True for names that start with one of ``filters``; no filters keep everything."""
    return any_of([dataset.startswith(f) for f in filters]) if filters else F.lit(True)


def select_delta(delta: DataFrame, filters: list[str]) -> DataFrame:
    """Changes of datasets whose name starts with one of ``filters``."""
    return delta.filter(prefix_filter(F.col("dataset"), filters))


def feature_at(snapshot: DataFrame, **key) -> DataFrame:
    """The row with this key. The filter reaches the Parquet scan."""
    for name, value in key.items():
        snapshot = snapshot.filter(F.col(name).eqNullSafe(F.lit(value)))
    return snapshot
