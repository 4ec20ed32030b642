"""Reading folders that hold one small encoded file per row.

Each file holds a MessagePack pair (legend hash, values) and is named after its key, a MessagePack
array in URL-safe base-64.
"""

from __future__ import annotations

import base64
import struct
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowtrail.operators.evolve import Field, decode_features, pk_columns, spark_type

# MessagePack type bytes with a fixed-size number, by struct code.
_NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q",
            0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
# Type bytes with a length, as the kind and the struct code of the length.
_SIZED = {0xD9: ("text", ">B"), 0xDA: ("text", ">H"), 0xDB: ("text", ">I"), 0xC4: ("bytes", ">B"),
          0xC5: ("bytes", ">H"), 0xC6: ("bytes", ">I"), 0xDC: ("list", ">H"), 0xDD: ("list", ">I")}
_CONSTANTS = {0xC0: None, 0xC2: False, 0xC3: True}


def _unpack(data: bytes, at: int = 0):
    """Value at an offset and the offset after it."""
    head = data[at]
    at += 1
    if head < 0x80:
        return head, at
    if head >= 0xE0:
        return head - 256, at
    if head in _CONSTANTS:
        return _CONSTANTS[head], at
    if head in _NUMBERS:
        code = _NUMBERS[head]
        return struct.unpack_from(code, data, at)[0], at + struct.calcsize(code)
    if head in _SIZED:
        kind, code = _SIZED[head]
        size = struct.unpack_from(code, data, at)[0]
        at += struct.calcsize(code)
    elif 0xA0 <= head < 0xC0:
        kind, size = "text", head - 0xA0
    elif 0x90 <= head < 0xA0:
        kind, size = "list", head - 0x90
    else:
        raise ValueError(f"type byte {head:#x}")
    if kind == "list":
        items = []
        for _ in range(size):
            item, at = _unpack(data, at)
            items.append(item)
        return items, at
    raw = data[at:at + size]
    return (raw.decode("utf-8") if kind == "text" else raw), at + size


def _text(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (bytes, list)):
        return bytes(value).hex()
    return repr(value) if isinstance(value, float) else str(value)


DECODED = T.StructType(
    [
        T.StructField("legend_hash", T.StringType()),
        T.StructField("values", T.ArrayType(T.StringType())),
        T.StructField("pk", T.ArrayType(T.StringType())),
    ]
)


@F.pandas_udf(DECODED)
def decode_file(name: pd.Series, content: pd.Series) -> pd.DataFrame:
    """Legend hash, values and key texts; all NULL when the file does not decode, the key alone when its name does not."""
    rows = []
    for file, data in zip(name, content):
        try:
            legend, values = _unpack(data)[0]
        except (ValueError, IndexError, TypeError, struct.error):
            rows.append((None, None, None))
            continue
        try:
            pk = [_text(v) for v in _unpack(base64.urlsafe_b64decode(file))[0]]
        except (ValueError, IndexError, TypeError, struct.error):
            pk = None
        rows.append((legend, [_text(v) for v in values], pk))
    return pd.DataFrame(rows, columns=DECODED.names, dtype=object)


def scan_feature_files(spark: SparkSession, path: str, legends: DataFrame, fields: list[Field]) -> DataFrame:
    """All rows below ``path`` in the current schema; key values are read in key-index order.

    A key of several columns is taken apart by position. Files with an unknown legend are dropped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(decode_file(name, "content").alias("_f")).select("_f.*")
    keys = pk_columns(fields)
    kinds = {f.name: spark_type(f) for f in fields}
    typed = [F.try_element_at("pk", F.lit(i + 1)).try_cast(kinds[k]).alias(k) for i, k in enumerate(keys)]
    encoded = rows.select(*typed, "legend_hash", "values")
    decoded = decode_features(encoded, legends, fields, keys)
    return decoded.select(*[f.name for f in fields])


cloudpickle.register_pickle_by_value(sys.modules[__name__])
