"""Source and sink queries: each one writes derived data, reads it back and is compared as a whole."""

from __future__ import annotations

import base64
import os
import struct
import sys
import uuid

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from checks import duck
from checks.inputs import given, oracle
from rowtrail.operators.evolve import Field, legends_of
from rowtrail.operators.rows import assign_rowid
from rowtrail.plans import scratch
from rowtrail.sources import exports
from rowtrail.sources.dbf import read_dbf
from rowtrail.sources.feature_files import scan_feature_files
from rowtrail.sources.geopackage import export_geopackage, read_all, read_geopackage

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate"]


def local_folder(spark, label: str) -> str:
    """A working folder that plain file functions can open."""
    path = scratch(spark, label).removeprefix("file:")
    os.makedirs(path, exist_ok=True)
    return path


def x1(spark, sf):
    path = local_folder(spark, "gpkg")
    rows = given(spark, sf, "customer").withColumn("geom", F.encode("c_name", "UTF-8"))
    export_geopackage(rows, path, "shop/customer", ["c_custkey"], geometry="geom", geometry_type="POINT")
    back = read_geopackage(spark, path, "shop_customer")
    return back.withColumn("geom", F.hex("geom"))


def x8(spark, sf):
    """Two writes into one folder: the second is appended, equal keys within a write collapse."""
    path = local_folder(spark, "gpkg")
    events = given(spark, sf, "events").select("user_id", F.col("user_id").cast("double").alias("twice"))
    export_geopackage(events, path, "users", ["user_id"])
    export_geopackage(events.withColumn("user_id", -F.col("user_id") - 1), path, "users", ["user_id"], mode="append")
    return read_geopackage(spark, path, "users")


def x8_two_tables(spark, sf):
    """Two tables in one folder, and a third that is overwritten beside them."""
    path = local_folder(spark, "gpkg")
    nations = given(spark, sf, "nation").select("n_nationkey", "n_name")
    suppliers = given(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    export_geopackage(nations, path, "shop/nation", ["n_nationkey"])
    export_geopackage(suppliers, path, "shop/supplier", ["s_suppkey"])
    export_geopackage(suppliers.filter("s_suppkey < 0"), path, "shop/none", ["s_suppkey"])
    export_geopackage(nations.filter("n_nationkey % 2 = 0"), path, "shop/nation", ["n_nationkey"])
    tables = read_all(spark, path)
    return (
        tables["shop_nation"].select(F.lit("nation").alias("place"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
        .unionByName(tables["shop_supplier"].select(F.lit("supplier").alias("place"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
        .unionByName(tables["shop_none"].select(F.lit("none").alias("place"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    )


def x8_update_rows(spark, sf):
    """The last event of each user, written in two steps: the later one updates keys of the first."""
    path = local_folder(spark, "gpkg")
    events = given(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    for mode, part in (("overwrite", "event_id % 2 = 0"), ("append", "event_id % 2 = 1 AND user_id % 3 = 0")):
        export_geopackage(events.filter(part).withColumn("number", F.col("event_id")), path, "users", ["user_id"], mode=mode, seq="number")
    return read_geopackage(spark, path, "users")


def _dbf_header(records: int, fields: list[tuple[str, str, int]]) -> bytes:
    head = struct.pack("<BBBBIHH20x", 3, 124, 1, 1, records, 33 + 32 * len(fields), 1 + sum(n for _, _, n in fields))
    for name, kind, size in fields:
        head += struct.pack("<11sc4xBB14x", name.encode(), kind.encode(), size, 0)
    return head + b"\r"


DBF_FIELDS = [("c_custkey", "N", 12), ("c_name", "C", 40), ("c_acctbal", "F", 14), ("active", "L", 1), ("since", "D", 8),
              ("nation", "I", 4)]


def _write_dbf(folder: str):
    """Writes one file per batch of rows."""

    def record(r) -> bytes:
        gone = b"*" if r.c_custkey % 50 == 7 else b" "
        active = b"?" if r.c_custkey % 9 == 0 else b"T" if r.c_custkey % 2 else b"n"
        day = b" " * 8 if r.c_custkey % 10 == 0 else b"202401%02d" % (r.c_custkey % 28 + 1)
        return (gone + b"%12d" % r.c_custkey + r.c_name.encode().ljust(40) + f"{r.c_acctbal:14.2f}".encode()
                + active + day + struct.pack("<i", r.c_nationkey))

    def write(batches):
        for pdf in batches:
            body = b"".join(record(r) for r in pdf.itertuples(index=False))
            with open(os.path.join(folder, f"{uuid.uuid4().hex}.dbf"), "wb") as f:
                f.write(_dbf_header(len(pdf), DBF_FIELDS) + body + b"\x1a")
            yield pd.DataFrame({"n": [len(pdf)]})

    return write


def x2(spark, sf):
    folder = local_folder(spark, "dbf")
    given(spark, sf, "customer").mapInPandas(_write_dbf(folder), "n long").agg(F.sum("n")).collect()
    return read_dbf(spark, folder).drop("fid")


def x3(spark, sf):
    return assign_rowid(given(spark, sf, "lineitem"), LINE)


def x6(spark, sf):
    path = scratch(spark, "csv")
    rows = given(spark, sf, "documents")
    exports.export_csv(rows, path)
    return exports.read_csv(spark, path, rows.schema)


def x7(spark, sf):
    path = scratch(spark, "geojson")
    exports.export_geojson(given(spark, sf, "wkt_points").withColumn("raw", F.encode("dataset", "UTF-8")), path, "wkt")
    shape = ("type string, geometry struct<type:string,wkt:string>,"
             " properties struct<c_custkey:bigint,dataset:string,raw:string>")
    rows = spark.read.text(path).select(F.from_json("value", shape).alias("f"))
    return rows.select("f.type", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.wkt").alias("wkt"),
                       "f.properties.*")


SUPPLIER = [
    Field("00000001-0000-4000-8000-000000000001", "s_suppkey", "integer", 0, size=64),
    Field("00000002-0000-4000-8000-000000000002", "s_name", "text"),
    Field("00000003-0000-4000-8000-000000000003", "s_nationkey", "integer", size=32),
    Field("00000004-0000-4000-8000-000000000004", "s_acctbal", "float", size=64),
    Field("00000005-0000-4000-8000-000000000005", "s_comment", "text"),
]
LAYOUT = [f.id for f in SUPPLIER[1:4]]


def _packed(value) -> bytes:
    if value is None:
        return b"\xc0"
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, int):
        return bytes([value]) if 0 <= value < 128 else b"\xd3" + struct.pack(">q", value)
    if isinstance(value, str):
        data = value.encode()
        return (bytes([0xA0 + len(data)]) if len(data) < 32 else b"\xd9" + bytes([len(data)])) + data
    return bytes([0x90 + len(value)]) + b"".join(map(_packed, value))


def _write_features(folder: str, legend: str):
    def write(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                name = base64.urlsafe_b64encode(_packed([int(r.s_suppkey)])).decode()
                place = os.path.join(folder, str(r.s_suppkey % 7))
                os.makedirs(place, exist_ok=True)
                used = "0" * 64 if r.s_suppkey % 13 == 0 else legend
                values = [r.s_name, int(r.s_nationkey), None if r.s_suppkey % 11 == 0 else float(r.s_acctbal), "surplus"]
                with open(os.path.join(place, name), "wb") as f:
                    f.write(_packed([used, values]))
            yield pd.DataFrame({"n": [len(pdf)]})

    return write


def x11(spark, sf):
    folder = local_folder(spark, "features")
    legends = legends_of(spark, [LAYOUT])
    legend = legends.first()["legend_hash"]
    given(spark, sf, "supplier").mapInPandas(_write_features(folder, legend), "n long").agg(F.sum("n")).collect()
    return scan_feature_files(spark, folder, legends, SUPPLIER)


def x12(spark, sf):
    path = scratch(spark, "parquet")
    rows = given(spark, sf, "theirs").withColumn("part", F.col("o_custkey") % 4)
    rows.write.partitionBy("part").parquet(path)
    return spark.read.parquet(path).drop("part")


ORDER_FIELDS = [
    Field("1", "o_orderkey", "integer", 0, size=64), Field("2", "o_orderstatus", "text"),
    Field("3", "o_totalprice", "numeric", precision=12, scale=2), Field("4", "o_orderdate", "date"),
]
PART_FIELDS = [Field("1", "p_partkey", "integer", 0), Field("2", "p_size", "interval"), Field("3", "p_retailprice", "float", size=32)]


def x13(spark, sf):
    tables = {
        "shop/orders": (given(spark, sf, "orders"), ORDER_FIELDS),
        "shop/part": (given(spark, sf, "part"), PART_FIELDS),
    }
    places = exports.sync_tables(tables, scratch(spark, "store"))
    orders = spark.read.parquet(places["shop/orders"]).selectExpr(
        "'shop_orders' AS table_name", "o_orderkey AS key", "o_totalprice AS text", "cast(o_orderdate AS string) AS day",
        "cast(null AS double) AS number")
    parts = spark.read.parquet(places["shop/part"]).selectExpr(
        "'shop_part' AS table_name", "p_partkey AS key", "p_size AS text", "cast(null AS string) AS day",
        "p_retailprice AS number")
    return orders.unionByName(parts)


QUERIES = {
    "x1_read_geopackage": x1,
    "x2_read_dbf": x2,
    "x3_assign_rowid": x3,
    "x6_export_csv": x6,
    "x6_csv_display": lambda s, sf: exports.csv_columns(given(s, sf, "values_mixed"), "display"),
    "x7_to_geojson": x7,
    "x8_export_geopackage": x8,
    "x8_two_tables": x8_two_tables,
    "x8_update_rows": x8_update_rows,
    "x11_scan_feature_files": x11,
    "x12_parquet": x12,
    "x13_sync_table": x13,
}

ORACLES = {
    "x1_read_geopackage": oracle("SELECT * REPLACE (c_nationkey::BIGINT AS c_nationkey), hex(c_name) AS geom FROM {customer}"),
    "x2_read_dbf": oracle(
        "SELECT c_custkey::DOUBLE AS c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 2 = 1 END"
        " AS active, CASE WHEN c_custkey % 10 <> 0 THEN DATE '2024-01-01' + (c_custkey % 28)::INT END AS since,"
        " c_nationkey AS nation FROM {customer} WHERE c_custkey % 50 <> 7"
    ),
    "x3_assign_rowid": oracle(f"SELECT row_number() OVER (ORDER BY {', '.join(LINE)}) AS _rowid, * FROM {{lineitem}}"),
    "x6_export_csv": oracle("SELECT doc_id, text, lang, source, n_chars FROM {documents}"),
    "x6_csv_display": oracle(
        "SELECT doc_id::VARCHAR AS doc_id, "
        + ", ".join(f"{duck.formatted(c, k)} AS {c}" for c, k in (
            ("text", "text"), ("lang", "text"), ("n_chars", "plain"), ("ratio", "double"), ("even", "plain")))
        + " FROM {values_mixed}"
    ),
    "x7_to_geojson": oracle(
        "SELECT 'Feature' AS type, CASE WHEN wkt IS NOT NULL THEN 'Feature' END AS geometry_type, wkt, c_custkey, dataset,"
        " '<blob>' AS raw FROM {wkt_points}"
    ),
    "x8_two_tables": oracle(
        "SELECT 'nation' AS place, n_nationkey::BIGINT AS id, n_name AS name FROM {nation} WHERE n_nationkey % 2 = 0"
        " UNION ALL SELECT 'supplier', s_suppkey, s_name FROM {supplier}"
    ),
    "x8_update_rows": oracle(
        "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id"
        " ORDER BY event_id % 2 DESC, event_id DESC) AS rank FROM {events} WHERE event_id % 2 = 0 OR user_id % 3 = 0)"
        " WHERE rank = 1"
    ),
    "x8_export_geopackage": oracle(
        "WITH u AS (SELECT DISTINCT user_id FROM {events}) SELECT user_id, user_id::DOUBLE AS twice FROM u"
        " UNION ALL SELECT -user_id - 1, user_id::DOUBLE FROM u"
    ),
    "x11_scan_feature_files": oracle(
        "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 11 <> 0 THEN s_acctbal END AS s_acctbal,"
        " NULL::VARCHAR AS s_comment FROM {supplier} WHERE s_suppkey % 13 <> 0"
    ),
    "x12_parquet": oracle("SELECT * FROM {theirs}"),
    "x13_sync_table": oracle(
        "SELECT 'shop_orders' AS table_name, o_orderkey AS key, o_totalprice::VARCHAR AS text,"
        " strftime(o_orderdate, '%Y-%m-%d') AS day, NULL::DOUBLE AS number FROM {orders} UNION ALL"
        " SELECT 'shop_part', p_partkey, p_size::VARCHAR, NULL, p_retailprice FROM {part}"
    ),
}

cloudpickle.register_pickle_by_value(sys.modules[__name__])
