"""Text forms of values, as expressions over typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

FLOATS = (T.FloatType, T.DoubleType)
STRINGS = (T.StringType, T.CharType, T.VarcharType)


def float_text(col: Column) -> Column:
    """Shortest decimal text of a double, never with an exponent and without a trailing ``.0``."""
    raw = col.cast("string")
    sign = F.when(raw.startswith("-"), "-").otherwise("")
    body = F.regexp_replace(raw, "^-", "")
    mantissa = F.substring_index(body, "E", 1)
    power = F.substring_index(body, "E", -1).cast("int")
    head = F.substring_index(mantissa, ".", 1)
    tail = F.regexp_replace(F.substring_index(mantissa, ".", -1), "0$", "")
    digits = F.concat(head, tail)
    n_tail = F.length(tail)
    whole = F.concat(head, F.rpad(tail, F.greatest(power, F.lit(0)), "0"))
    split = F.concat(
        F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(400))
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    plain = (
        F.when(power < 0, small).when(n_tail > power, split).otherwise(whole)
    )
    return (
        F.when(F.isnan(col), "NaN")
        .when(raw == "Infinity", "inf")
        .when(raw == "-Infinity", "-inf")
        .when(raw.contains("E"), F.concat(sign, plain))
        .when(raw.endswith(".0"), F.substring(raw, F.lit(1), F.length(raw) - 2))
        .otherwise(raw)
    )


def _bare(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, FLOATS):
        return float_text(col)
    if isinstance(dtype, T.BinaryType):
        return F.concat(F.lit("<"), F.octet_length(col).cast("string"), F.lit(" bytes>"))
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(col)
    return col.cast("string")


def format_value(col: Column, dtype: T.DataType) -> Column:
    """Display form with quoted text: more than 50 bytes are cut to 47 characters and ``...``."""
    if isinstance(dtype, STRINGS):
        cut = F.concat(F.lit('"'), F.substring(col, 1, 47), F.lit('..."'))
        text = F.when(F.octet_length(col) > 50, cut).otherwise(F.concat(F.lit('"'), col, F.lit('"')))
    else:
        text = _bare(col, dtype)
    return F.when(col.isNull(), "NULL").otherwise(text)


def display_value(col: Column, dtype: T.DataType) -> Column:
    """Display form without quotes or truncation."""
    return F.when(col.isNull(), "NULL").otherwise(_bare(col, dtype))


def format_pk(df: DataFrame, keys: list[str]) -> Column:
    """:func:`format_value` of each key, joined by a comma."""
    return F.concat_ws(",", *[format_value(F.col(k), df.schema[k].dataType) for k in keys])


def pk_key(df: DataFrame, keys: list[str]) -> Column:
    """:func:`display_value` of each key, joined by a vertical bar."""
    return F.concat_ws("|", *[display_value(F.col(k), df.schema[k].dataType) for k in keys])


def format_file_size(col: Column) -> Column:
    """Bytes as B, KB or MB with one decimal, GB with two; exact halves round to even."""
    n = col.cast("bigint")

    def scaled(unit: int, factor: int) -> Column:
        shift = unit.bit_length() - 1
        units = F.shiftright(n, shift)
        rest = (n - units * unit) * factor
        part = F.shiftright(rest, shift)
        left = (rest - part * unit) * 2
        part = part + F.when((left > unit) | ((left == unit) & (part % 2 == 1)), 1).otherwise(0)
        total = units * factor + part
        digits = total % factor
        whole = ((total - digits) / factor).cast("bigint").cast("string")
        places = len(str(factor)) - 1
        return F.concat(whole, F.lit("."), F.lpad(digits.cast("string"), places, "0"))

    return (
        F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1 << 20, F.concat(scaled(1 << 10, 10), F.lit(" KB")))
        .when(n < 1 << 30, F.concat(scaled(1 << 20, 10), F.lit(" MB")))
        .otherwise(F.concat(scaled(1 << 30, 100), F.lit(" GB")))
    )


def short_hash(col: Column) -> Column:
    """First seven characters of an id."""
    return F.substring(col, 1, 7)


def table_name(col: Column) -> Column:
    """Table name of a dataset path: slashes become underscores."""
    return F.replace(col, F.lit("/"), F.lit("_"))


def date_text(col: Column) -> Column:
    """``YYYY-MM-DD``."""
    return F.date_format(col, "yyyy-MM-dd")


# Variant type names that hold the values of each strict accessor.
_VARIANT_KINDS = {
    "i64": ("bigint", "^BIGINT$"),
    "str": ("string", "^STRING$"),
    "f64": ("double", "^(DOUBLE|FLOAT|DECIMAL.*)$"),
    "bool": ("boolean", "^BOOLEAN$"),
    "bytes": ("binary", "^BINARY$"),
}


def typed(col: Column, kind: str) -> Column:
    """Value of a VARIANT column when it has exactly this kind, else NULL; never coerces.

    ``kind`` is one of ``i64``, ``str``, ``f64``, ``bool``, ``bytes``.
    """
    target, pattern = _VARIANT_KINDS[kind]
    return F.when(F.schema_of_variant(col).rlike(pattern), F.try_variant_get(col, "$", target))


def is_null_value(col: Column) -> Column:
    """True for an SQL NULL and for a VARIANT null."""
    return col.isNull() | F.is_variant_null(col)
