"""CSV and GeoJSON output, and pushing datasets into another table store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowtrail.functions.text import format_value
from rowtrail.operators.evolve import SQL_TYPES, Field

# Spark types behind the target SQL types.
STORE_TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "bigint",
    "DOUBLE PRECISION": "double",
    "DOUBLE": "double",
    "REAL": "float",
    "BOOLEAN": "boolean",
    "BYTEA": "binary",
    "BLOB": "binary",
    "GEOMETRY": "binary",
    "DATE": "date",
    "TIMESTAMPTZ": "timestamp",
    "DATETIME": "timestamp",
    "TEXT": "string",
}


def csv_columns(df: DataFrame, mode: str = "plain") -> DataFrame:
    """Columns as they go into a CSV file.

    ``plain`` keeps values as they are (binary as hex); ``display`` renders them with quotes and
    truncation, which loses text.
    """
    if mode == "display":
        return df.select(*[format_value(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])
    if mode != "plain":
        raise ValueError("mode is 'plain' or 'display'")
    return df.select(*[
        F.hex(f.name).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name) for f in df.schema
    ])


# How CSV files tell NULL from text: NULL is this mark, and text that starts with a backslash has one more.
NULL_MARK = "\\N"
CSV_OPTIONS = {
    "header": "true", "escape": '"', "nullValue": NULL_MARK, "emptyValue": "", "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "lineSep": "\n", "quoteAll": "true",
}


def _texts(df: DataFrame, change) -> DataFrame:
    return df.select(*[
        change(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema
    ])


def export_csv(df: DataFrame, path: str, mode: str = "plain") -> None:
    """Write CSV files with a header; :func:`read_csv` gives the same rows back."""
    rows = csv_columns(df, mode)
    rows = _texts(rows, lambda c: F.when(c.startswith("\\"), F.concat(F.lit("\\"), c)).otherwise(c))
    rows.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows that :func:`export_csv` wrote, in the types of ``schema``."""
    plain = T.StructType([
        T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.BinaryType) else f.dataType) for f in schema
    ])
    rows = spark.read.schema(plain).options(**CSV_OPTIONS).csv(path)
    rows = _texts(rows, lambda c: F.when(c.startswith("\\"), F.substring(c, F.lit(2), F.length(c))).otherwise(c))
    return rows.select(*[
        F.unhex(f.name).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name) for f in schema
    ])


def to_geojson(df: DataFrame, geometry: str | None = None) -> DataFrame:
    """One GeoJSON Feature text per row in ``feature``.

    Binary properties are ``"<blob>"``. The geometry is ``{"type": "Feature", "wkt": …}`` for WKT
    text, else null.
    """
    properties = []
    for f in df.schema:
        if f.name == geometry:
            continue
        col = F.col(f.name)
        properties.append((F.when(col.isNotNull(), "<blob>") if isinstance(f.dataType, T.BinaryType) else col).alias(f.name))
    shape = F.lit(None).cast("struct<type:string,wkt:string>")
    if geometry is not None and isinstance(df.schema[geometry].dataType, T.StringType):
        wkt = F.col(geometry)
        shape = F.when(wkt.isNotNull(), F.struct(F.lit("Feature").alias("type"), wkt.alias("wkt")))
    body = F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties).alias("properties"))
    return df.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("feature"))


def export_geojson(df: DataFrame, path: str, geometry: str | None = None) -> None:
    """Write Features as JSON lines, one file per task."""
    to_geojson(df, geometry).write.mode("overwrite").text(path)


def store_type(field: Field, dialect: str) -> str:
    """SQL type name of a field in ``gpkg`` or ``postgres``."""
    if dialect == "gpkg" and field.data_type == "float" and field.size == 32:
        return "REAL"
    return SQL_TYPES[dialect].get(field.data_type, "TEXT")


def store_columns(df: DataFrame, fields: list[Field], dialect: str) -> DataFrame:
    """Declared columns cast to the types of the target store."""
    columns = []
    for f in fields:
        target, have = STORE_TYPES[store_type(f, dialect)], df.schema[f.name].dataType
        if target == "binary" and not isinstance(have, T.BinaryType):
            value = F.encode(F.col(f.name).cast("string"), "UTF-8")
        elif isinstance(have, T.BinaryType) and target == "string":
            value = F.hex(f.name)
        else:
            value = F.col(f.name).cast(target)
        columns.append(value.alias(f.name))
    return df.select(*columns)


def sync_tables(
    tables: dict[str, tuple[DataFrame, list[Field]]], path: str, dialect: str = "postgres", jdbc: dict | None = None
) -> dict[str, str]:
    """Push datasets into another table store and return where each one went.

    Every dataset is written by parallel tasks to ``path/<table>`` as Parquet, or through JDBC when
    ``jdbc`` options are given and a driver is on the class path. ``/`` in a name becomes ``_``.
    """
    places = {}
    for dataset, (df, fields) in tables.items():
        table = dataset.replace("/", "_")
        rows = store_columns(df, fields, dialect)
        if jdbc:
            rows.write.format("jdbc").options(**jdbc, dbtable=f'"{table}"').mode("append").save()
            places[dataset] = table
        else:
            places[dataset] = f"{path}/{table}"
            rows.write.mode("overwrite").parquet(places[dataset])
    return places
