"""dBASE attribute files as a Spark data source: ``spark.read.format("rowtrail_dbf")``."""

from __future__ import annotations

import os
import struct
import sys
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS_PER_BATCH = 20_000

# Names of the one-letter dBASE field types that do not hold text.
TYPE_NAMES = {"N": "Numeric", "F": "Float", "L": "Logical", "D": "Date", "I": "Integer"}
SPARK_TYPES = {"N": T.DoubleType(), "F": T.DoubleType(), "L": T.BooleanType(), "D": T.DateType(),
               "I": T.IntegerType()}


@dataclass
class Layout:
    records: int
    header_size: int
    record_size: int
    fields: list[tuple[str, str, int]]


def read_layout(path: str) -> Layout:
    """Record count, sizes and the (name, type letter, length) of all fields."""
    with open(path, "rb") as f:
        head = f.read(32)
        records, header_size, record_size = struct.unpack_from("<IHH", head, 4)
        fields = []
        while len(entry := f.read(32)) == 32 and entry[0] != 0x0D:
            name = entry[:11].split(b"\0")[0].decode("latin-1")
            fields.append((name, chr(entry[11]), entry[16]))
    return Layout(records, header_size, record_size, fields)


def _value(raw: bytes, kind: str):
    if kind == "I":
        return struct.unpack("<i", raw)[0]
    text = raw.decode("utf-8", "replace").strip(" \0")
    if kind in "NF":
        try:
            return float(text)
        except ValueError:
            return None
    if kind == "L":
        return True if text in tuple("TtYy") else False if text in tuple("FfNn") else None
    if kind == "D":
        try:
            return date(int(text[:4]), int(text[4:6]), int(text[6:8]))
        except ValueError:
            return None
    return text or None if kind == "C" else None


def files_of(path: str) -> list[str]:
    """The file itself, or the dBASE files of a folder by name."""
    if not os.path.isdir(path):
        return [path]
    return [os.path.join(path, n) for n in sorted(os.listdir(path)) if n.lower().endswith(".dbf")]


@dataclass
class RecordRange(InputPartition):
    path: str
    first: int
    last: int
    before: int


class DbfReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, slices: int):
        self.path, self.schema, self.slices = path, schema, slices

    def partitions(self):
        sizes = [(f, read_layout(f).records) for f in files_of(self.path)]
        step = max(1, -(-sum(n for _, n in sizes) // self.slices))
        out, before = [], 0
        for path, n in sizes:
            out += [RecordRange(path, i, min(i + step, n), before) for i in range(0, n, step)]
            before += n
        return out or [RecordRange(sizes[0][0], 0, 0, 0)]

    def read(self, partition: RecordRange):
        from pyspark.sql.pandas.types import to_arrow_schema

        layout = read_layout(partition.path)
        arrow = to_arrow_schema(self.schema)
        fields = {name: SPARK_TYPES.get(kind, T.StringType()) for name, kind, _ in layout.fields}
        wanted = {f.name: f.dataType for f in self.schema if f.name != "fid"}
        if fields != wanted:
            raise ValueError(f"{partition.path} has the fields {fields}, the first file {wanted}")
        with open(partition.path, "rb") as f:
            f.seek(layout.header_size + partition.first * layout.record_size)
            for start in range(partition.first, partition.last, ROWS_PER_BATCH):
                rows = []
                for number in range(start, min(start + ROWS_PER_BATCH, partition.last)):
                    record = f.read(layout.record_size)
                    if record[:1] == b"*":
                        continue
                    values, at = {"fid": partition.before + number + 1}, 1
                    for name, kind, length in layout.fields:
                        values[name] = _value(record[at:at + length], kind)
                        at += length
                    rows.append([values[name] for name in arrow.names])
                columns = list(zip(*rows)) if rows else [[] for _ in arrow]
                arrays = [pa.array(c, type=t.type) for c, t in zip(columns, arrow)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)


class DbfSource(DataSource):
    @classmethod
    def name(cls):
        return "rowtrail_dbf"

    def schema(self):
        schema = T.StructType().add(T.StructField("fid", T.LongType(), True, {"primary_key_index": 0, "size": 64}))
        for name, kind, length in read_layout(files_of(self.options["path"])[0]).fields:
            meta = {"dbf_type": TYPE_NAMES.get(kind, "Character"), "length": length}
            schema.add(T.StructField(name, SPARK_TYPES.get(kind, T.StringType()), True, meta))
        return schema

    def reader(self, schema):
        return DbfReader(self.options["path"], schema, int(self.options.get("slices", "16")))


def read_dbf(spark: SparkSession, path: str, slices: int = 16) -> DataFrame:
    """Attribute rows with ``fid``, the record number from one; deleted records are left out.

    The files of a folder have the same fields, in any order, and count on from file to file; others
    are an error. Fields of types that hold neither text, numbers, dates nor truth values are NULL.
    Records have a fixed width, so each task seeks to its own range.
    """
    spark.dataSource.register(DbfSource)
    return spark.read.format("rowtrail_dbf").options(path=path, slices=slices).load()


cloudpickle.register_pickle_by_value(sys.modules[__name__])
