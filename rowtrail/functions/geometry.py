"""Coordinates in WKT text and GeoPackage geometry headers."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

# What counts as a number: an optional sign, then digits with an optional fraction and exponent,
# or the words for infinity and not-a-number. Narrower than Spark's cast, which takes "1d".
_NUMBER = r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan))"
# First coordinate of a WKT text: from after the first "(" up to the next "," or ")".
_FIRST_COORD = rf"^[^(]*\(\s*({_NUMBER})\s+({_NUMBER})(?:\s[^,)]*)?[,)]"

# Unicode white space.
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")

# Bytes of an envelope of type 0 to 4, after the eight header bytes.
ENVELOPE_BYTES = [0, 32, 48, 48, 64]


def number(text: Column) -> Column:
    """Double of a text that is a plain number, else NULL."""
    return F.regexp_extract(text, f"^({_NUMBER})$", 1).try_cast("double")


def _first_xy(wkt: Column) -> list[Column]:
    """x and y of the first coordinate, both NULL when it does not parse."""
    return [F.regexp_extract(wkt, _FIRST_COORD, i + 1).try_cast("double").alias(n) for i, n in enumerate("xy")]


def first_coord(wkt: Column) -> Column:
    """Struct (x, y) of the first coordinate, or NULL.

    Reads from after the first ``(`` up to the next ``,`` or ``)`` and needs two blank-separated
    numbers, so a polygon's double bracket never parses.
    """
    x, y = _first_xy(wkt)
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x, y))


def parse_bbox(text: Column) -> Column:
    """Array of four doubles, or NULL unless exactly four of the comma-separated parts parse."""
    numbers = F.array_compact(F.transform(F.split(text, ","), lambda p: number(F.btrim(p, F.lit(WHITE_SPACE)))))
    return F.when(F.size(numbers) == 4, numbers)


def in_bbox(x: Column, y: Column, bbox) -> Column:
    """True when the point is inside the box, bounds included, or when it has no coordinates."""
    min_x, min_y, max_x, max_y = bbox
    inside = (x >= min_x) & (x <= max_x) & (y >= min_y) & (y <= max_y)
    # OR form instead of coalesce, so that stored x and y columns push down to Parquet.
    return x.isNull() | y.isNull() | (inside & ~F.isnan(x) & ~F.isnan(y))


def wkt_in_bbox(wkt: Column, bbox) -> Column:
    """:func:`in_bbox` of the first coordinate of a WKT text.

    The coordinate is bound to a lambda variable: a filter would otherwise repeat the text matching
    for every comparison.
    """
    point = F.array(F.struct(*_first_xy(wkt)))
    return F.exists(point, lambda p: in_bbox(p["x"], p["y"], bbox))


def gpkg_header(data: Column) -> Column:
    """Struct (status, envelope_type, wkb) of a GeoPackage geometry blob.

    ``status`` is ``ok``, ``too_short``, ``bad_magic`` or ``bad_envelope``.
    """
    size = F.octet_length(data)
    flags = F.conv(F.hex(F.substring(data, 4, 1)), 16, 10).cast("int")
    kind = F.shiftright(flags, 1).bitwiseAND(7)
    offset = F.get(F.array(*[F.lit(8 + n) for n in ENVELOPE_BYTES]), kind)
    status = (
        F.when(size < 8, "too_short")
        .when(F.hex(F.substring(data, 1, 2)) != "4750", "bad_magic")
        .when(offset.isNull(), "bad_envelope")
        .when(size < offset, "too_short")
        .otherwise("ok")
    )
    wkb = F.when(status == "ok", F.substring(data, offset + 1, size))
    envelope_type = F.when(status.isin("ok", "bad_envelope"), kind)
    fields = F.struct(status.alias("status"), envelope_type.alias("envelope_type"), wkb.alias("wkb"))
    return F.when(data.isNotNull(), fields)


@F.pandas_udf(T.BinaryType())
def pack_envelope(values: pd.Series) -> pd.Series:
    """Little-endian bytes of an array of doubles; one conversion per batch."""
    there = values.notna()
    rows = values[there].tolist()
    data = np.concatenate([*rows, np.zeros(0)]).astype("<f8").tobytes()
    ends = np.cumsum([8 * len(v) for v in rows], dtype=np.int64)
    out = pd.Series([None] * len(values), index=values.index, dtype=object)
    out[there] = [data[e - 8 * len(v):e] for e, v in zip(ends.tolist(), rows)]
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def unpack_envelope(data: pd.Series, little: pd.Series) -> pd.Series:
    """Array of doubles out of bytes in the byte order of each row; one conversion per batch."""
    there = data.notna()
    rows, sizes = data[there].tolist(), data[there].map(len).to_numpy(dtype=np.int64) // 8
    joined = b"".join(rows)
    first = np.repeat(little[there].to_numpy(dtype=bool), sizes)
    values = np.where(first, np.frombuffer(joined, "<f8"), np.frombuffer(joined, ">f8"))
    out = pd.Series([None] * len(data), index=data.index, dtype=object)
    for i, part in zip(np.flatnonzero(there.to_numpy()), np.split(values, np.cumsum(sizes)[:-1]) if rows else []):
        out.iat[i] = part
    return out


def gpkg_wrap(wkb: Column, envelope: list[Column] | None = None, kind: int | None = None) -> Column:
    """GeoPackage geometry blob around WKB: little-endian header, SRS id 0, optional envelope.

    ``envelope`` lists min_x, max_x, min_y, max_y and the z and/or m ranges; ``kind`` tells XYZ (2)
    from XYM (3) when six values are given.
    """
    if envelope is None:
        return F.concat(F.unhex(F.lit("4750000100000000")), wkb)
    kind = kind or {4: 1, 6: 2, 8: 4}[len(envelope)]
    if 8 * len(envelope) != ENVELOPE_BYTES[kind]:
        raise ValueError(f"envelope type {kind} does not take {len(envelope)} values")
    header = F.unhex(F.lit(f"475000{1 | kind << 1:02X}00000000"))
    return F.concat(header, pack_envelope(F.array(*envelope)), wkb)


def read_envelope(data: Column) -> Column:
    """Array of the envelope's doubles, NULL without a valid envelope; flag bit 0 tells the byte order."""
    head = gpkg_header(data)
    length = F.coalesce(F.get(F.array(*map(F.lit, ENVELOPE_BYTES)), head.envelope_type), F.lit(0))
    body = F.when((head.status == "ok") & (length > 0), F.substring(data, F.lit(9), length))
    little = F.conv(F.hex(F.substring(data, 4, 1)), 16, 10).cast("int").bitwiseAND(1) == 1
    return unpack_envelope(body, F.coalesce(little, F.lit(True)))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
