"""Point-cloud and raster tiles: inventory, headers and dataset schemas."""

from __future__ import annotations

import struct
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowtrail.functions.address import tile_shard_path

# LAS point fields as name, type, bits, unsigned, and the formats that have them.
_ALL = range(0, 11)
_LEGACY = range(0, 6)
_EXTENDED = range(6, 11)
_GPS_TIME = [1, 3, 4, 5, 6, 7, 8, 9, 10]
_COLOUR = [2, 3, 5, 7, 8, 10]
_INFRARED = [8, 10]
LAS_FIELDS = [
    ("X", "integer", 32, False, _ALL),
    ("Y", "integer", 32, False, _ALL),
    ("Z", "integer", 32, False, _ALL),
    ("Intensity", "integer", 16, True, _ALL),
    ("Return Number", "integer", 3, True, _LEGACY),
    ("Return Number", "integer", 4, True, _EXTENDED),
    ("Number of Returns", "integer", 3, True, _LEGACY),
    ("Number of Returns", "integer", 4, True, _EXTENDED),
    ("Synthetic", "integer", 1, False, _EXTENDED),
    ("Key-Point", "integer", 1, False, _EXTENDED),
    ("Withheld", "integer", 1, False, _EXTENDED),
    ("Overlap", "integer", 1, False, _EXTENDED),
    ("Scanner Channel", "integer", 2, True, _EXTENDED),
    ("Scan Direction Flag", "integer", 1, False, _ALL),
    ("Edge of Flight Line", "integer", 1, False, _ALL),
    ("Classification", "integer", 8, True, _ALL),
    ("Scan Angle Rank", "integer", 8, False, _LEGACY),
    ("User Data", "integer", 8, True, _ALL),
    ("Scan Angle", "integer", 16, False, _EXTENDED),
    ("Point Source ID", "integer", 16, True, _ALL),
    ("GPS Time", "float", 64, False, _GPS_TIME),
    ("Red", "integer", 16, True, _COLOUR),
    ("Green", "integer", 16, True, _COLOUR),
    ("Blue", "integer", 16, True, _COLOUR),
    ("Infrared", "integer", 16, True, _INFRARED),
]

# Meaning of a band by photometric interpretation.
RGB_BANDS = ["red", "green", "blue", "alpha"]
RGB, PALETTE = 2, 3


def read_files(spark, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, length, content) of the files below ``path``; unused columns are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(path)
    )
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def tile_inventory(tiles: DataFrame, extensions: list[str]) -> DataFrame:
    """(dataset, path, length): the shard path of every tile out of dataset, name and length."""
    return tiles.select("dataset", tile_shard_path(F.col("name"), extensions).alias("path"), "length")


def count_tiles(tiles: DataFrame) -> DataFrame:
    """Tiles and bytes per dataset."""
    return tiles.groupBy("dataset").agg(F.count(F.lit(1)).alias("tiles"), F.sum("length").alias("bytes"))


def _byte(content: Column, offset: int) -> Column:
    return F.conv(F.hex(F.substring(content, offset + 1, 1)), 16, 10).cast("int")


def las_header(content: Column) -> Column:
    """Struct (compression, las_version, point_format, record_length) of a LAS header, else NULL.

    The top bits of the format byte mark compression.
    """
    marked = _byte(content, 104)
    version = F.concat_ws(".", _byte(content, 24).cast("string"), _byte(content, 25).cast("string"))
    header = F.struct(
        F.when(marked >= 64, "laz").otherwise("las").alias("compression"),
        version.alias("las_version"),
        marked.bitwiseAND(63).alias("point_format"),
        (_byte(content, 105) + 256 * _byte(content, 106)).alias("record_length"),
    )
    is_las = (F.octet_length(content) >= 107) & (F.hex(F.substring(content, 1, 4)) == "4C415346")
    return F.when(is_las, header)


def las_tile_headers(tiles: DataFrame) -> DataFrame:
    """Header of every tile; ``content`` is replaced by the header columns, NULL when it is no LAS."""
    kept = [c for c in tiles.columns if c != "content"]
    return tiles.select(*kept, las_header(F.col("content")).alias("_h")).select(*kept, "_h.*")


def las_schema(headers: DataFrame, keep: list[str]) -> DataFrame:
    """(keep…, position, name, data_type, size, unsigned) of the point fields of every header."""
    entries = []
    for name, kind, bits, unsigned, formats in LAS_FIELDS:
        field = F.struct(
            F.lit(name).alias("name"), F.lit(kind).alias("data_type"),
            F.lit(bits).alias("size"), F.lit(unsigned).alias("unsigned"),
        )
        entries.append(F.when(F.col("point_format").isin(list(formats)), field))
    listed = headers.select(*keep, F.posexplode(F.array_compact(F.array(*entries))).alias("position", "_f"))
    return listed.select(*keep, "position", "_f.*")


def tile_dataset_info(headers: DataFrame) -> DataFrame:
    """Per dataset the header of its first tile by name, its tile count and whether tiles differ."""
    header = F.struct("compression", "las_version", "point_format", "record_length")
    first = F.min_by(header, "name")
    return headers.groupBy("dataset").agg(
        first.alias("_h"), F.count(F.lit(1)).alias("tiles"), (F.min(header) != F.max(header)).alias("mixed")
    ).select("dataset", "_h.*", "tiles", "mixed")


def raster_dataset_info(bands: DataFrame) -> DataFrame:
    """Per dataset the bands of its first tile by name, its tile count and whether tiles differ.

    ``bands`` is the result of :func:`tiff_band_schema` with the columns dataset and name; ``schema``
    lists ``data_type(size)`` with the interpretation in brackets, one text per band.
    """
    kind = F.concat(F.col("data_type"), F.lit("("), F.col("size").cast("string"), F.lit(")"))
    text = F.when(F.col("interpretation").isNull(), kind).otherwise(F.concat(kind, F.lit(" ["), F.col("interpretation"), F.lit("]")))
    # A tile has few bands.
    listed = F.transform(F.array_sort(F.collect_list(F.struct("band", text.alias("text")))), lambda b: b["text"])
    tiles = bands.groupBy("dataset", "name").agg(listed.alias("schema"))
    return tiles.groupBy("dataset").agg(
        F.min_by("schema", "name").alias("schema"), F.count(F.lit(1)).alias("tiles"), (F.min("schema") != F.max("schema")).alias("mixed")
    )


def tiff_band_schema(tags: DataFrame, keep: list[str]) -> DataFrame:
    """(keep…, band, data_type, size, unsigned, interpretation) of every band, numbered from one.

    ``tags`` has samples_per_pixel, bits_per_sample, sample_format and photometric, NULL where a tag
    is missing: one band, 8 bits, unsigned integers.
    """
    bands = F.coalesce("samples_per_pixel", F.lit(1))
    rows = tags.filter(bands > 0).withColumn("_i", F.explode(F.sequence(F.lit(0), bands - 1)))
    spot = F.col("_i") + 1
    size = F.coalesce(F.try_element_at("bits_per_sample", spot), F.lit(8))
    sample = F.coalesce(F.try_element_at("sample_format", spot), F.lit(1))
    kind = F.when(sample == 3, "float").otherwise("integer")
    meaning = F.when(
        F.col("photometric") == RGB, F.try_element_at(F.array(*map(F.lit, RGB_BANDS)), spot)
    ).when(F.col("photometric") == PALETTE, "palette")
    return rows.select(
        *keep,
        spot.alias("band"),
        kind.alias("data_type"),
        size.alias("size"),
        (~sample.isin(2, 3)).alias("unsigned"),
        meaning.alias("interpretation"),
    )


# TIFF tag numbers, and the struct codes of the integer field types.
_BITS, _PHOTOMETRIC, _SAMPLES, _FORMAT = 258, 262, 277, 339
_INTEGER_CODES = {1: "B", 3: "H", 4: "I", 16: "Q"}


def _integer_tags(data: bytes) -> dict[int, list[int]]:
    """Integer tags of the first image directory; classic and big TIFF in both byte orders."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    big = struct.unpack_from(order + "H", data, 2)[0] == 43
    offset = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    count_code, entry_code, entry_size, inline = ("Q", "HHQ", 20, 8) if big else ("H", "HHI", 12, 4)
    count = struct.unpack_from(order + count_code, data, offset)[0]
    offset += struct.calcsize(order + count_code)
    tags = {}
    for start in range(offset, offset + count * entry_size, entry_size):
        tag, kind, n = struct.unpack_from(order + entry_code, data, start)
        if kind not in _INTEGER_CODES:
            continue
        code = f"{order}{n}{_INTEGER_CODES[kind]}"
        at = start + entry_size - inline
        if struct.calcsize(code) > inline:
            at = struct.unpack_from(order + ("Q" if big else "I"), data, at)[0]
        tags[tag] = list(struct.unpack_from(code, data, at))
    return tags


TAGS = T.StructType(
    [
        T.StructField("samples_per_pixel", T.IntegerType()),
        T.StructField("bits_per_sample", T.ArrayType(T.IntegerType())),
        T.StructField("sample_format", T.ArrayType(T.IntegerType())),
        T.StructField("photometric", T.IntegerType()),
    ]
)


@F.pandas_udf(TAGS)
def tiff_tags(content: pd.Series) -> pd.DataFrame:
    """Image tags of TIFF bytes; all NULL when the bytes are no TIFF."""
    rows = []
    for data in content:
        try:
            tags = _integer_tags(data)
        except (KeyError, TypeError, struct.error):
            tags = {}
        first = lambda tag: tags[tag][0] if tags.get(tag) else None
        rows.append((first(_SAMPLES), tags.get(_BITS), tags.get(_FORMAT), first(_PHOTOMETRIC)))
    return pd.DataFrame(rows, columns=TAGS.names, dtype=object)


def tiff_tile_tags(tiles: DataFrame) -> DataFrame:
    """Image tags of every tile in place of its ``content``."""
    kept = [c for c in tiles.columns if c != "content"]
    return tiles.select(*kept, tiff_tags(F.col("content")).alias("_t")).select(*kept, "_t.*")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
