"""Content digests and key-derived paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed value: the URL-safe base-64 alphabet.
B64_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"

# File extensions stripped from tile names, tried in this order.
POINT_CLOUD_EXTENSIONS = [".copc.laz", ".laz", ".las"]
RASTER_EXTENSIONS = [".tiff", ".tif"]

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _digest_text(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col).cast("string")
    if isinstance(dtype, T.BinaryType):
        return F.lower(F.hex(col))
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(col)
    return col.cast("string")


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 hex over ``columns``: each value as ``length:text``, NULL as ``~``.

    The length keeps ("ab", "c") apart from ("a", "bc"), the marker keeps NULL apart from "".
    """
    parts = []
    for name in columns:
        text = _digest_text(F.col(name), df.schema[name].dataType)
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("~")))
    return F.sha2(F.concat(*parts), 256)


def int_directory(key: Column, levels: int = 4) -> Column:
    """Directory of an integer key: its base-64 digits without the last, the lowest ``levels`` kept.

    Negative keys are read as unsigned 64-bit numbers. 77 gives ``A/A/A/B``.
    """
    key = key.cast("bigint")
    digits = []
    for place in range(levels, 0, -1):
        bits = 6 * place
        if bits >= 64:
            digits.append(F.lit("A"))
            continue
        value = F.shiftrightunsigned(key, bits).bitwiseAND(63)
        digits.append(F.substring(F.lit(B64_ALPHABET), value.cast("int") + 1, F.lit(1)))
    return F.concat_ws("/", *digits)


def int_directory_hex(key: Column, levels: int = 4) -> Column:
    """Hex form of :func:`int_directory`: the ``levels`` hex digits before the last one."""
    padded = F.concat(F.lit("0" * (2 * levels + 2)), F.lower(F.hex(key.cast("bigint"))))
    start = -(levels + 1)
    return F.concat_ws("/", *[F.substring(padded, start + i, 1) for i in range(levels)])


def _hex_width(value: Column, width: int) -> Column:
    return F.substring(F.concat(F.lit("0" * (2 * width)), F.hex(value)), -2 * width, 2 * width)


def _packed_int(value: Column) -> Column:
    v = value.cast("bigint")
    h1, h2, h4, h8 = (_hex_width(v, w) for w in (1, 2, 4, 8))
    return (
        F.when(v.between(0, 127) | v.between(-32, -1), h1)
        .when(v.between(128, 255), F.concat(F.lit("CC"), h1))
        .when(v.between(256, 65535), F.concat(F.lit("CD"), h2))
        .when(v.between(65536, 4294967295), F.concat(F.lit("CE"), h4))
        .when(v > 4294967295, F.concat(F.lit("CF"), h8))
        .when(v.between(-128, -33), F.concat(F.lit("D0"), h1))
        .when(v.between(-32768, -129), F.concat(F.lit("D1"), h2))
        .when(v.between(-2147483648, -32769), F.concat(F.lit("D2"), h4))
        .otherwise(F.concat(F.lit("D3"), h8))
    )


def _packed_text(value: Column) -> Column:
    n = F.octet_length(value).cast("bigint")
    head = (
        F.when(n < 32, _hex_width(n + 160, 1))
        .when(n < 256, F.concat(F.lit("D9"), _hex_width(n, 1)))
        .when(n < 65536, F.concat(F.lit("DA"), _hex_width(n, 2)))
        .otherwise(F.concat(F.lit("DB"), _hex_width(n, 4)))
    )
    return F.concat(head, F.hex(F.encode(value, "UTF-8")))


def _packed(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, INTEGERS):
        text = _packed_int(col)
    elif isinstance(dtype, T.StringType):
        text = _packed_text(col)
    elif isinstance(dtype, T.BooleanType):
        text = F.when(col, "C3").otherwise("C2")
    else:
        raise TypeError(f"a {dtype.simpleString()} column cannot be part of a key path")
    return F.when(col.isNull(), "C0").otherwise(text)


def packed_key(df: DataFrame, keys: list[str]) -> Column:
    """Binary MessagePack array of the key values (integers, text, booleans, NULL)."""
    parts = [_packed(F.col(k), df.schema[k].dataType) for k in keys]
    head = f"9{len(keys):X}" if len(keys) < 16 else f"DC{len(keys):04X}"
    return F.unhex(F.concat(F.lit(head), *parts))


def _urlsafe(data: Column) -> Column:
    # Spark breaks long base-64 text into lines; the breaks have no counterpart and are dropped.
    return F.translate(F.base64(data), "+/\r\n", "-_")


def pk_filename(df: DataFrame, keys: list[str]) -> Column:
    """URL-safe base-64 of :func:`packed_key`. 77 gives ``kU0=``."""
    return _urlsafe(packed_key(df, keys))


def hash_directory(
    df: DataFrame, keys: list[str], levels: int = 4, encoding: str = "base64", branches: int = 64
) -> Column:
    """Directory from the SHA-256 of :func:`packed_key`.

    Hex takes two digits per level (one when ``branches`` is 16); base64 takes one character per
    level and ignores ``branches``.
    """
    sha = F.sha2(packed_key(df, keys), 256)
    if encoding == "hex":
        step = 1 if branches == 16 else 2
        return F.concat_ws("/", *[F.substring(sha, 1 + i * step, step) for i in range(levels)])
    n_bytes = min(-(-6 * levels // 8), 32)
    text = _urlsafe(F.unhex(F.substring(sha, 1, 2 * n_bytes)))
    chars = [F.substring(text, 1 + i, 1) for i in range(levels)]
    return F.concat_ws("/", *[F.when(c == "", "A").otherwise(c) for c in chars])


def feature_directory(
    df: DataFrame,
    keys: list[str],
    scheme: str | None = None,
    levels: int = 4,
    encoding: str = "base64",
    branches: int = 64,
) -> Column:
    """Directory of a row. Without ``scheme``, a single integer key uses ``int``, others ``hash``."""
    if scheme is None:
        single = len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, INTEGERS)
        scheme = "int" if single else "hash"
    if scheme == "hash":
        return hash_directory(df, keys, levels, encoding, branches)
    if encoding == "hex":
        return int_directory_hex(F.col(keys[0]), levels)
    return int_directory(F.col(keys[0]), levels)


def full_feature_path(df: DataFrame, keys: list[str], **layout) -> Column:
    """Directory and file name of a row, joined by a slash."""
    return F.concat_ws("/", feature_directory(df, keys, **layout), pk_filename(df, keys))


def legend_hash(column_ids: Column) -> Column:
    """SHA-256 hex of the MessagePack array of 36-character id strings."""
    n = F.size(column_ids).cast("bigint")
    head = (
        F.when(n < 16, _hex_width(n + 144, 1))
        .when(n < 65536, F.concat(F.lit("DC"), _hex_width(n, 2)))
        .otherwise(F.concat(F.lit("DD"), _hex_width(n, 4)))
    )
    body = F.array_join(F.transform(column_ids, _packed_text), "")
    return F.sha2(F.unhex(F.concat(head, body)), 256)


def tile_name(name: Column, extensions: list[str]) -> Column:
    """File name without the first extension of ``extensions`` that it ends with."""
    cut = None
    for ext in extensions:
        bare = F.substring(name, F.lit(1), F.length(name) - len(ext))
        cut = F.when(name.endswith(ext), bare) if cut is None else cut.when(name.endswith(ext), bare)
    return cut.otherwise(name)


def tile_shard_path(name: Column, extensions: list[str]) -> Column:
    """``shard/name``: the shard is the first two hex digits of the SHA-256 of the bare name."""
    bare = tile_name(name, extensions)
    return F.concat_ws("/", F.substring(F.sha2(bare, 256), 1, 2), bare)


def digest_chunks(digest: Column) -> list[Column]:
    """Four 60-bit integers out of a hex digest, for XOR aggregation."""
    return [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("bigint") for i in range(4)]


def any_of(conditions: list[Column]) -> Column:
    """OR of all conditions."""
    return reduce(lambda a, b: a | b, conditions)
