"""Schemas that evolve by stable column ids, and type mappings.

A schema is a list of :class:`Field`. A column catalogue is a DataFrame with one row per column:
dataset, position, id, name, data_type, primary_key_index, geometry_type, geometry_crs, size,
length, precision, scale, timezone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rowtrail.functions.address import legend_hash
from rowtrail.plans import join_small


@dataclass(frozen=True)
class Field:
    """One column of a dataset; ``id`` stays the same through renames."""

    id: str
    name: str
    data_type: str
    primary_key_index: int | None = None
    geometry_type: str | None = None
    geometry_crs: str | None = None
    size: int | None = None
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    timezone: str | None = None


CATALOGUE = (
    "dataset string, position int, id string, name string, data_type string, primary_key_index int,"
    " geometry_type string, geometry_crs string, size int, length int, precision int, scale int, timezone string"
)

# Type names of the GeoPackage and PostgreSQL dialects. Types not listed are TEXT.
SQL_TYPES = {
    "gpkg": {
        "boolean": "BOOLEAN",
        "blob": "BLOB",
        "date": "DATE",
        "float": "DOUBLE",
        "geometry": "GEOMETRY",
        "integer": "INTEGER",
        "timestamp": "DATETIME",
    },
    "postgres": {
        "integer": "BIGINT",
        "float": "DOUBLE PRECISION",
        "boolean": "BOOLEAN",
        "blob": "BYTEA",
        "date": "DATE",
        "timestamp": "TIMESTAMPTZ",
        "geometry": "GEOMETRY",
    },
}

# PostgreSQL type names by declared type. Names not listed are text.
PG_TYPES = {
    "integer": ["integer", "bigint", "smallint"],
    "float": ["real", "double precision", "numeric"],
    "boolean": ["boolean"],
    "blob": ["bytea"],
    "date": ["date"],
    "timestamp": ["timestamp without time zone", "timestamp with time zone"],
}

# dBASE field types by declared type. Types not listed are text.
DBF_TYPES = {"float": ["Numeric", "Float"], "boolean": ["Logical"], "date": ["Date"], "integer": ["Integer"]}

# Substrings of SQLite type names in the order they are tried. Others are text.
SQLITE_RULES = [
    ("integer", ["INT"]),
    ("float", ["REAL", "FLOAT", "DOUBLE"]),
    ("blob", ["BLOB"]),
    ("boolean", ["BOOL"]),
]

# Primary key names, the best first.
PK_NAMES = ["id", "gid", "fid"]


def schema_frame(spark: SparkSession, dataset: str, fields: list[Field]) -> DataFrame:
    """Column catalogue of one schema."""
    rows = [(dataset, i, *vars(f).values()) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, CATALOGUE)


def pk_columns(fields: list[Field]) -> list[str]:
    """Names of the key columns by key index."""
    keyed = [f for f in fields if f.primary_key_index is not None]
    return [f.name for f in sorted(keyed, key=lambda f: f.primary_key_index)]


def value_columns(fields: list[Field]) -> list[str]:
    """Names of the other columns in schema order."""
    return [f.name for f in fields if f.primary_key_index is None]


def key_layout(catalogue: DataFrame) -> DataFrame:
    """(dataset, pk_columns, value_columns) out of a column catalogue: arrays in their orders.

    A group holds the columns of one dataset, as many as a table can have.
    """
    key, spot = F.col("primary_key_index"), F.col("position")

    def names(when: Column, order: Column) -> Column:
        entries = F.array_sort(F.collect_list(F.when(when, F.struct(order.alias("o"), spot.alias("p"), "name"))))
        return F.transform(entries, lambda e: e["name"])

    return catalogue.groupBy("dataset").agg(
        names(key.isNotNull(), key).alias("pk_columns"), names(key.isNull(), spot).alias("value_columns")
    )


def spark_type(field: Field) -> T.DataType:
    """Spark type of a declared type."""
    if field.data_type == "float":
        return T.FloatType() if field.size == 32 else T.DoubleType()
    if field.data_type == "integer":
        sized = {8: T.ByteType(), 16: T.ShortType(), 32: T.IntegerType()}
        return sized.get(field.size, T.LongType())
    if field.data_type == "numeric":
        return T.DecimalType(field.precision or 38, field.scale or 0)
    if field.data_type == "timestamp":
        return T.TimestampType() if field.timezone else T.TimestampNTZType()
    plain = {"boolean": T.BooleanType(), "blob": T.BinaryType(), "geometry": T.BinaryType(), "date": T.DateType()}
    return plain.get(field.data_type, T.StringType())


def to_spark_schema(fields: list[Field]) -> T.StructType:
    """StructType whose field metadata keeps id, key index, geometry and length."""
    out = T.StructType()
    for f in fields:
        kept = {k: v for k, v in vars(f).items() if v is not None and k != "name"}
        out.add(T.StructField(f.name, spark_type(f), f.primary_key_index is None, kept))
    return out


def fields_of(schema: T.StructType) -> list[Field]:
    """Fields back out of the metadata of :func:`to_spark_schema`."""
    return [Field(name=f.name, **f.metadata) for f in schema.fields]


def project(df: DataFrame, fields: list[Field]) -> DataFrame:
    """Declared columns in schema order."""
    return df.select(*[f.name for f in fields])


def decode_features(encoded: DataFrame, legends: DataFrame, fields: list[Field], keep: list[str]) -> DataFrame:
    """Stored rows as columns of the current schema.

    ``encoded`` has ``legend_hash`` and ``values`` (texts) next to the ``keep`` columns; ``legends``
    maps ``legend_hash`` to ``column_ids``. Values follow the column id: dropped columns vanish, new
    ones are NULL, renamed ones keep their values. Rows with an unknown legend are dropped, surplus
    values ignored, and of an id listed twice the last position that has a value counts.
    """
    stored = [f for f in fields if f.name not in keep]
    ids = F.col("column_ids")

    def positions(f: Field) -> Column:
        return F.array_compact(
            F.transform(ids, lambda i, n: F.when(i == f.id, n + 1))
        )

    slots = []
    for n, f in enumerate(stored):
        at = positions(f)
        slots.append(F.try_element_at(at, F.lit(-1)).alias(f"_last{n}"))
        slots.append(F.when(F.size(at) > 1, at).alias(f"_all{n}"))
    slots = legends.select("legend_hash", *slots)
    # One legend may hold most rows; past the broadcast bound the join is salted.
    rows = join_small(encoded, slots, ["legend_hash"], salts=32, salt_by=keep)
    values = F.col("values")
    columns = []
    for n, f in enumerate(stored):
        last = F.col(f"_last{n}")
        earlier = F.array_max(F.filter(f"_all{n}", lambda p: p <= F.size(values)))
        spot = F.when(last <= F.size(values), last).otherwise(earlier)
        text = F.get(values, spot - 1)
        kind = spark_type(f)
        value = F.unhex(text) if isinstance(kind, T.BinaryType) else text.try_cast(kind)
        columns.append(value.alias(f.name))
    return rows.select(*keep, *columns)


def encode_features(df: DataFrame, fields: list[Field]) -> DataFrame:
    """Rows as key columns, ``legend_hash`` and the texts of the other columns in schema order."""
    stored = [f for f in fields if f.primary_key_index is None]
    texts = []
    for f in stored:
        if f.name not in df.columns:
            texts.append(F.lit(None).cast("string"))
        elif isinstance(df.schema[f.name].dataType, T.BinaryType):
            texts.append(F.hex(F.col(f.name)))
        else:
            texts.append(F.col(f.name).cast("string"))
    ids = F.array(*[F.lit(f.id) for f in stored])
    return df.select(*pk_columns(fields), legend_hash(ids).alias("legend_hash"), F.array(*texts).alias("values"))


def legends_of(spark: SparkSession, layouts: list[list[str]]) -> DataFrame:
    """(legend_hash, column_ids) of the given id lists."""
    df = spark.createDataFrame([(ids,) for ids in layouts], "column_ids array<string>")
    return df.select(legend_hash(F.col("column_ids")).alias("legend_hash"), "column_ids")


def legend_columns(legends: DataFrame, fields: list[Field]) -> DataFrame:
    """Adds ``column_names``: names in legend order, an unknown id shown as itself."""
    name_of = F.create_map(*[F.lit(x) for f in fields for x in (f.id, f.name)])
    names = F.transform("column_ids", lambda i: F.coalesce(F.try_element_at(name_of, i), i))
    return legends.withColumn("column_names", names)


def schema_diff(schema_a: DataFrame, schema_b: DataFrame) -> DataFrame:
    """Columns added, dropped, renamed or retyped between two catalogues, matched by dataset and id.

    A column that was renamed and retyped has both words in ``change``.
    """
    keys = ["dataset", "id"]
    a = schema_a.select(*keys, F.struct("name", "data_type").alias("a"))
    b = schema_b.select(*keys, F.struct("name", "data_type").alias("b"))
    x, y = F.col("a"), F.col("b")
    edits = F.concat_ws(
        ",",
        F.when(x["name"] != y["name"], "renamed"),
        F.when(x["data_type"] != y["data_type"], "retyped"),
    )
    change = F.when(x.isNull(), "added").when(y.isNull(), "dropped").otherwise(edits)
    joined = a.join(b, keys, "full").select(
        *keys,
        change.alias("change"),
        x["name"].alias("old_name"),
        y["name"].alias("new_name"),
        x["data_type"].alias("old_type"),
        y["data_type"].alias("new_type"),
    )
    return joined.filter(F.col("change") != "")


def schema_table(catalogue: DataFrame) -> DataFrame:
    """(dataset, number, name, type, info) of every column, numbered from one."""
    parts = F.array_compact(
        F.array(
            F.when(F.col("primary_key_index").isNotNull(), "PK"),
            F.col("geometry_type"),
            F.col("geometry_crs"),
            F.concat(F.col("size").cast("string"), F.lit("-bit")),
            F.concat(F.lit("max "), F.col("length").cast("string"), F.lit(" chars")),
        )
    )
    return catalogue.select(
        "dataset",
        (F.col("position") + 1).alias("number"),
        "name",
        F.col("data_type").alias("type"),
        F.array_join(parts, ", ").alias("info"),
    )


def _lookup(col: Column, table: dict[str, list[str]], default: str) -> Column:
    out = None
    for kind, names in table.items():
        out = F.when(col.isin(names), kind) if out is None else out.when(col.isin(names), kind)
    return out.otherwise(default)


def map_sqlite_types(columns: DataFrame, geometry_columns: DataFrame | None = None) -> DataFrame:
    """Declared types of SQLite columns (table_name, name, type_name, pk).

    A column registered in ``geometry_columns`` (table_name, name, geometry_type, srs_id) is a
    geometry. Otherwise the first substring rule that matches decides, so POINT is an integer.
    """
    upper = F.upper("type_name")
    kind = None
    for name, words in SQLITE_RULES:
        for word in words:
            kind = F.when(upper.contains(word), name) if kind is None else kind.when(upper.contains(word), name)
    kind = kind.otherwise("text")
    if geometry_columns is None:
        columns = columns.withColumns(
            {"geometry_type": F.lit(None).cast("string"), "srs_id": F.lit(None).cast("bigint")}
        )
    else:
        columns = columns.join(geometry_columns, ["table_name", "name"], "left")
    is_geometry = F.col("geometry_type").isNotNull()
    data_type = F.when(is_geometry, "geometry").otherwise(kind)
    size = (
        F.when(data_type == "integer", 64)
        .when((data_type == "float") & upper.contains("REAL"), 32)
        .when(data_type == "float", 64)
    )
    crs = F.concat(F.lit("EPSG:"), F.coalesce("srs_id", F.lit(4326)).cast("string"))
    return columns.select(
        "table_name",
        "name",
        data_type.alias("data_type"),
        size.alias("size"),
        F.when(F.col("pk") > 0, F.col("pk") - 1).cast("int").alias("primary_key_index"),
        "geometry_type",
        F.when(is_geometry, crs).alias("geometry_crs"),
    )


def map_pg_types(type_name: Column) -> Column:
    """Declared type of a PostgreSQL type name."""
    return _lookup(type_name, PG_TYPES, "text")


def map_dbf_types(type_name: Column) -> Column:
    """Declared type of a dBASE field type name."""
    return _lookup(type_name, DBF_TYPES, "text")


def to_sql_types(data_type: Column, size: Column, dialect: str) -> Column:
    """SQL type name of a declared type in ``gpkg`` or ``postgres``; GeoPackage has 32-bit REAL."""
    out = F.when((data_type == "float") & (size == 32), "REAL") if dialect == "gpkg" else F.when(F.lit(False), "")
    for kind, name in SQL_TYPES[dialect].items():
        out = out.when(data_type == kind, name)
    return out.otherwise("TEXT")


def spark_type_names(catalogue: DataFrame) -> Column:
    """Spark type name of a catalogue row."""
    kind, size = F.col("data_type"), F.col("size")
    precision = F.coalesce("precision", F.lit(38)).cast("string")
    scale = F.coalesce("scale", F.lit(0)).cast("string")
    return (
        F.when((kind == "float") & (size == 32), "float")
        .when(kind == "float", "double")
        .when((kind == "integer") & (size == 8), "tinyint")
        .when((kind == "integer") & (size == 16), "smallint")
        .when((kind == "integer") & (size == 32), "int")
        .when(kind == "integer", "bigint")
        .when(kind == "numeric", F.concat(F.lit("decimal("), precision, F.lit(","), scale, F.lit(")")))
        .when((kind == "timestamp") & F.col("timezone").isNotNull(), "timestamp")
        .when(kind == "timestamp", "timestamp_ntz")
        .when(kind.isin("blob", "geometry"), "binary")
        .when(kind.isin("boolean", "date"), kind)
        .otherwise("string")
    )


def detect_pk(columns: DataFrame) -> DataFrame:
    """(table_name, pk): the best of the known key names a table has, ``_rowid`` without any."""
    rank = F.array_position(F.array(*map(F.lit, PK_NAMES)), F.col("name"))
    best = F.min(F.when(rank > 0, rank)).cast("int")
    name = F.coalesce(F.try_element_at(F.array(*map(F.lit, PK_NAMES)), best), F.lit("_rowid"))
    return columns.groupBy("table_name").agg(name.alias("pk"))


def gpkg_contents(catalogue: DataFrame) -> DataFrame:
    """Contents rows and geometry-column rows of a GeoPackage, as one table.

    One row per dataset with ``column_name`` NULL, and one per geometry column with its SRS id out
    of ``EPSG:n`` (4326 when that does not parse).
    """
    table = F.replace(F.col("dataset"), F.lit("/"), F.lit("_")).alias("table_name")
    contents = catalogue.select("dataset").distinct().select(
        table, F.lit("features").alias("data_type"), F.lit(None).cast("string").alias("column_name"),
        F.lit(None).cast("string").alias("geometry_type_name"), F.lit(None).cast("bigint").alias("srs_id"),
    )
    number = F.regexp_extract("geometry_crs", "^EPSG:([+-]?[0-9]+)$", 1).try_cast("bigint")
    geometry = catalogue.filter(F.col("data_type") == "geometry").select(
        table, F.lit("features").alias("data_type"), F.col("name").alias("column_name"),
        F.coalesce("geometry_type", F.lit("GEOMETRY")).alias("geometry_type_name"),
        F.coalesce(number, F.lit(4326)).alias("srs_id"),
    )
    return contents.unionByName(geometry)
