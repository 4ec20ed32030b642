"""Schema and type-mapping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import given, oracle
from rowtrail.functions.address import legend_hash
from rowtrail.operators import evolve as E


def _id(n: int) -> str:
    return f"{n:08x}-0000-4000-8000-{n * 7919:012x}"


FIELDS = [
    E.Field(_id(1), "c_custkey", "integer", 0, size=64),
    E.Field(_id(2), "c_name", "text", length=250),
    E.Field(_id(3), "c_nationkey", "integer", size=32),
    E.Field(_id(4), "c_acctbal", "float", size=64),
    E.Field(_id(5), "c_mktsegment", "text"),
    E.Field(_id(6), "c_added", "date"),
]
# Layouts of stored rows: the present one, one without the segment, one from before a rename and in
# another order with a column that was dropped since.
LAYOUTS = [[_id(i) for i in (2, 3, 4, 5)], [_id(i) for i in (2, 3, 4)], [_id(i) for i in (5, 9, 4, 2, 3)]]


def legends(spark):
    return E.legends_of(spark, LAYOUTS)


def encoded(spark, sf):
    """Customers stored in all layouts; every fourth one under a legend nobody knows."""
    name, nation, balance, segment = (F.col(c).cast("string") for c in FIELD_NAMES)
    values = (
        F.when(F.col("c_custkey") % 4 == 0, F.array(name, nation, balance, segment))
        .when(F.col("c_custkey") % 4 == 1, F.array(name, nation, balance, F.lit("surplus")))
        .when(F.col("c_custkey") % 4 == 2, F.array(segment, F.lit("gone"), balance, name, F.lit("junk")))
        .otherwise(F.array(name))
    )
    hashes = [legend_hash(F.array(*map(F.lit, ids))) for ids in LAYOUTS]
    which = F.when(F.col("c_custkey") % 4 == 3, F.lit("0" * 64))
    for n, value in enumerate(hashes):
        which = which.when(F.col("c_custkey") % 4 == n, value)
    return given(spark, sf, "customer").select("c_custkey", which.alias("legend_hash"), values.alias("values"))


FIELD_NAMES = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def e1(spark, sf):
    return E.decode_features(encoded(spark, sf), legends(spark), FIELDS, ["c_custkey"])


def e2(spark, sf):
    rows = E.encode_features(given(spark, sf, "customer"), FIELDS)
    return rows.select("c_custkey", "legend_hash", F.array_join("values", "|", "~").alias("stored"))


def e2_round_trip(spark, sf):
    stored = E.encode_features(given(spark, sf, "customer"), FIELDS)
    known = E.legends_of(spark, [[f.id for f in FIELDS[1:]]])
    return E.decode_features(stored, known, FIELDS, ["c_custkey"])


def e3(spark, sf):
    ids = F.transform(
        F.sequence(F.lit(1), F.col("p_size") % 9 + 1),
        lambda i: F.concat(
            F.lpad(F.lower(F.hex(i.cast("bigint"))), 8, "0"), F.lit("-0000-4000-8000-"),
            F.lpad(F.lower(F.hex(i.cast("bigint") * 7919)), 12, "0"),
        ),
    )
    rows = given(spark, sf, "part").select("p_partkey", F.reverse(ids).alias("column_ids"))
    named = E.legend_columns(rows, FIELDS)
    return named.select("p_partkey", F.array_join("column_names", ",").alias("names"))


def e6(spark, sf):
    rows = E.key_layout(given(spark, sf, "catalogue"))
    return rows.select("dataset", *[F.array_join(c, ",").alias(c) for c in ("pk_columns", "value_columns")])


def e10(spark, sf):
    rows = given(spark, sf, "catalogue")
    return rows.select(
        "dataset", "position",
        E.to_sql_types(F.col("data_type"), F.col("size"), "gpkg").alias("gpkg_type"),
        E.to_sql_types(F.col("data_type"), F.col("size"), "postgres").alias("postgres_type"),
        E.spark_type_names(rows).alias("spark_type"),
    )


def _source(s, sf):
    return given(s, sf, "source_columns")


QUERIES = {
    "e1_decode_features": e1,
    "e2_encode_features": e2,
    "e2_encode_decode": e2_round_trip,
    "e3_legend_columns": e3,
    "e4_schema_diff": lambda s, sf: E.schema_diff(given(s, sf, "catalogue"), given(s, sf, "catalogue_later")),
    "e5_schema_table": lambda s, sf: E.schema_table(given(s, sf, "catalogue")),
    "e6_key_layout": e6,
    "e7_map_sqlite_types": lambda s, sf: E.map_sqlite_types(_source(s, sf), given(s, sf, "source_geometry")),
    "e8_map_pg_types": lambda s, sf: _source(s, sf).select(
        "table_name", "name", E.map_pg_types(F.col("type_name")).alias("data_type")
    ),
    "e9_map_dbf_types": lambda s, sf: _source(s, sf).select(
        "table_name", "name", E.map_dbf_types(F.col("dbf_type")).alias("data_type")
    ),
    "e10_type_names": e10,
    "x4_detect_pk": lambda s, sf: E.detect_pk(_source(s, sf)),
    "x9_gpkg_contents": lambda s, sf: E.gpkg_contents(given(s, sf, "catalogue")),
}

_HASH = "sha256(unhex('95' || " + " || ".join(f"'D924' || hex('{f.id}')" for f in FIELDS[1:]) + "))"
_KNOWN = {f.id: f.name for f in FIELDS}
_NAME_OF = " ".join(f"WHEN '{i}' THEN '{n}'" for i, n in _KNOWN.items())
_ID_OF = "lpad(lower(hex({0})), 8, '0') || '-0000-4000-8000-' || lpad(lower(hex({0} * 7919)), 12, '0')".format("i")

ORACLES = {
    "e1_decode_features": oracle(
        "SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 <> 2 THEN c_nationkey END AS c_nationkey, c_acctbal,"
        " CASE WHEN c_custkey % 4 <> 1 THEN c_mktsegment END AS c_mktsegment, NULL::DATE AS c_added"
        " FROM {customer} WHERE c_custkey % 4 <> 3"
    ),
    "e2_encode_features": oracle(
        f"SELECT c_custkey, {_HASH} AS legend_hash, c_name || '|' || c_nationkey || '|' || c_acctbal || '|' ||"
        " c_mktsegment || '|~' AS stored FROM {customer}"
    ),
    "e2_encode_decode": oracle("SELECT *, NULL::DATE AS c_added FROM {customer}"),
    "e3_legend_columns": oracle(
        "SELECT p_partkey, array_to_string(list_reverse(list_transform(range(1, p_size % 9 + 2), lambda i:"
        f" CASE {_ID_OF} {_NAME_OF} ELSE {_ID_OF} END)), ',') AS names FROM {{part}}"
    ),
    "e4_schema_diff": oracle(
        "WITH d AS (SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(a.id, b.id) AS id,"
        " CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'dropped' ELSE concat_ws(',',"
        " CASE WHEN a.name <> b.name THEN 'renamed' END, CASE WHEN a.data_type <> b.data_type THEN 'retyped' END)"
        " END AS change, a.name AS old_name, b.name AS new_name, a.data_type AS old_type, b.data_type AS new_type"
        " FROM {catalogue} a FULL JOIN {catalogue_later} b ON a.dataset = b.dataset AND a.id = b.id)"
        " SELECT * FROM d WHERE change <> ''"
    ),
    "e5_schema_table": oracle(
        "SELECT dataset, position + 1 AS number, name, data_type AS type, concat_ws(', ',"
        " CASE WHEN primary_key_index IS NOT NULL THEN 'PK' END, geometry_type, geometry_crs, size || '-bit',"
        " 'max ' || length || ' chars') AS info FROM {catalogue}"
    ),
    "e6_key_layout": oracle(
        "SELECT dataset, coalesce(string_agg(name, ',' ORDER BY primary_key_index, position) FILTER"
        " (primary_key_index IS NOT NULL), '') AS pk_columns, coalesce(string_agg(name, ',' ORDER BY position)"
        " FILTER (primary_key_index IS NULL), '') AS value_columns FROM {catalogue} GROUP BY 1"
    ),
    "e7_map_sqlite_types": oracle(
        "WITH k AS (SELECT c.*, g.geometry_type, g.srs_id, CASE WHEN g.geometry_type IS NOT NULL THEN 'geometry'"
        " WHEN upper(type_name) LIKE '%INT%' THEN 'integer' WHEN upper(type_name) SIMILAR TO '.*(REAL|FLOAT|DOUBLE).*'"
        " THEN 'float' WHEN upper(type_name) LIKE '%BLOB%' THEN 'blob' WHEN upper(type_name) LIKE '%BOOL%'"
        " THEN 'boolean' ELSE 'text' END AS data_type FROM {source_columns} c LEFT JOIN {source_geometry} g"
        " ON g.table_name = c.table_name AND g.name = c.name) SELECT table_name, name, data_type,"
        " CASE WHEN data_type = 'integer' THEN 64 WHEN data_type = 'float' AND upper(type_name) LIKE '%REAL%' THEN 32"
        " WHEN data_type = 'float' THEN 64 END AS size, CASE WHEN pk > 0 THEN pk - 1 END AS primary_key_index,"
        " geometry_type, CASE WHEN geometry_type IS NOT NULL THEN 'EPSG:' || coalesce(srs_id, 4326) END AS geometry_crs"
        " FROM k"
    ),
    "e8_map_pg_types": oracle(
        "SELECT table_name, name, CASE type_name WHEN 'bigint' THEN 'integer' WHEN 'double precision' THEN 'float'"
        " WHEN 'numeric' THEN 'float' WHEN 'boolean' THEN 'boolean' WHEN 'bytea' THEN 'blob' WHEN 'date' THEN 'date'"
        " WHEN 'timestamp with time zone' THEN 'timestamp' ELSE 'text' END AS data_type FROM {source_columns}"
    ),
    "e9_map_dbf_types": oracle(
        "SELECT table_name, name, CASE dbf_type WHEN 'Numeric' THEN 'float' WHEN 'Float' THEN 'float' WHEN 'Logical'"
        " THEN 'boolean' WHEN 'Date' THEN 'date' WHEN 'Integer' THEN 'integer' ELSE 'text' END AS data_type"
        " FROM {source_columns}"
    ),
    "e10_type_names": oracle(
        "SELECT dataset, position, CASE data_type WHEN 'boolean' THEN 'BOOLEAN' WHEN 'blob' THEN 'BLOB' WHEN 'date'"
        " THEN 'DATE' WHEN 'float' THEN CASE WHEN size = 32 THEN 'REAL' ELSE 'DOUBLE' END WHEN 'geometry' THEN"
        " 'GEOMETRY' WHEN 'integer' THEN 'INTEGER' WHEN 'timestamp' THEN 'DATETIME' ELSE 'TEXT' END AS gpkg_type,"
        " CASE data_type WHEN 'boolean' THEN 'BOOLEAN' WHEN 'blob' THEN 'BYTEA' WHEN 'date' THEN 'DATE' WHEN 'float'"
        " THEN 'DOUBLE PRECISION' WHEN 'geometry' THEN 'GEOMETRY' WHEN 'integer' THEN 'BIGINT' WHEN 'timestamp' THEN"
        " 'TIMESTAMPTZ' ELSE 'TEXT' END AS postgres_type, CASE data_type WHEN 'boolean' THEN 'boolean' WHEN 'blob'"
        " THEN 'binary' WHEN 'geometry' THEN 'binary' WHEN 'date' THEN 'date' WHEN 'float' THEN CASE WHEN size = 32"
        " THEN 'float' ELSE 'double' END WHEN 'integer' THEN CASE size WHEN 8 THEN 'tinyint' WHEN 16 THEN 'smallint'"
        " WHEN 32 THEN 'int' ELSE 'bigint' END WHEN 'numeric' THEN 'decimal(' || coalesce(precision, 38) || ',' ||"
        " coalesce(scale, 0) || ')' WHEN 'timestamp' THEN CASE WHEN timezone IS NULL THEN 'timestamp_ntz' ELSE"
        " 'timestamp' END ELSE 'string' END AS spark_type FROM {catalogue}"
    ),
    "x4_detect_pk": oracle(
        "SELECT table_name, CASE WHEN bool_or(name = 'id') THEN 'id' WHEN bool_or(name = 'gid') THEN 'gid'"
        " WHEN bool_or(name = 'fid') THEN 'fid' ELSE '_rowid' END AS pk FROM {source_columns} GROUP BY 1"
    ),
    "x9_gpkg_contents": oracle(
        "SELECT DISTINCT replace(dataset, '/', '_') AS table_name, 'features' AS data_type, NULL AS column_name,"
        " NULL AS geometry_type_name, NULL::BIGINT AS srs_id FROM {catalogue} UNION ALL"
        " SELECT replace(dataset, '/', '_'), 'features', name, coalesce(geometry_type, 'GEOMETRY'),"
        " CASE WHEN geometry_crs LIKE 'EPSG:%' THEN substr(geometry_crs, 6)::BIGINT ELSE 4326 END FROM {catalogue}"
        " WHERE data_type = 'geometry'"
    ),
}
