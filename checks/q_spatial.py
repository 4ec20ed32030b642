"""Geometry and bounding-box queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import given, oracle
from rowtrail.functions import geometry as G
from rowtrail.operators import spatial as S
from rowtrail.operators.evolve import Field, project

BOX = (-60.0, -40.0, 75.5, 30.0)


def points(spark, sf):
    return given(spark, sf, "wkt_points")


def f2(spark, sf):
    rows = points(spark, sf).withColumn("xy", G.first_coord(F.col("wkt")))
    return rows.select("c_custkey", F.col("xy.x").alias("x"), F.col("xy.y").alias("y"))


def f3(spark, sf):
    rows = given(spark, sf, "box_texts").withColumn("b", G.parse_bbox(F.col("box")))
    names = ["min_x", "min_y", "max_x", "max_y"]
    return rows.select("p_partkey", *[F.col("b")[i].alias(n) for i, n in enumerate(names)])


def f5(spark, sf):
    joined = S.bbox_join(f2(spark, sf), "x", "y", given(spark, sf, "boxes"))
    return joined.select("c_custkey", "x", "y", "region")


def _hex32(col, seed: int):
    return F.sha2(F.concat(col.cast("string"), F.lit(f"-{seed}")), 256)


def blobs(spark, sf):
    """Blobs with every envelope type, short ones and wrong magic bytes, one per order."""
    key = F.col("o_orderkey")
    kind = key % 7
    flags = F.lpad(F.lower(F.hex(kind * 2 + 1)), 2, "0")
    body = F.concat(*[_hex32(key, i) for i in range(4)])
    text = F.concat(F.when(key % 19 == 0, "4751").otherwise("4750"), F.lit("00"), flags, F.lit("00000000"), body)
    length = F.when(key % 23 == 0, key % 9).otherwise(8 + key % 121)
    data = F.when(key % 31 != 0, F.unhex(F.substring(text, F.lit(1), (2 * length).cast("int"))))
    return given(spark, sf, "orders").select("o_orderkey", data.alias("blob"))


def f6(spark, sf):
    rows = blobs(spark, sf).withColumn("h", G.gpkg_header(F.col("blob")))
    return rows.select("o_orderkey", "h.status", "h.envelope_type", F.hex("h.wkb").alias("wkb"))


def _wkb():
    return F.unhex(F.sha2(F.col("o_orderkey").cast("string"), 256))


def _envelope():
    """Box of 2 x 1 around a point that follows the key."""
    x = (F.col("o_orderkey") % 360 - 180).cast("double")
    y = (F.col("o_custkey") % 180 - 90).cast("double")
    return [x, x + 2, y, y + 1]


def f7(spark, sf):
    rows = given(spark, sf, "orders")
    return rows.select("o_orderkey", F.hex(G.gpkg_wrap(_wkb())).alias("blob"))


def enveloped(spark, sf):
    rows = given(spark, sf, "orders")
    blob = F.when(F.col("o_orderkey") % 10 == 0, G.gpkg_wrap(_wkb())).otherwise(G.gpkg_wrap(_wkb(), _envelope()))
    return rows.select("o_orderkey", "o_custkey", blob.alias("blob"))


def f7_envelope(spark, sf):
    z = [F.col("o_totalprice"), F.col("o_totalprice") * 2]
    rows = given(spark, sf, "orders").select("o_orderkey", G.gpkg_wrap(_wkb(), _envelope() + z, kind=3).alias("blob"))
    rows = rows.select("o_orderkey", G.gpkg_header(F.col("blob")).alias("h"), G.read_envelope(F.col("blob")).alias("e"))
    return rows.select("o_orderkey", "h.status", "h.envelope_type", F.hex("h.wkb").alias("wkb"),
                       *[F.col("e")[i].alias(f"e{i}") for i in range(6)])


def f8(spark, sf):
    return S.filter_by_envelope(enveloped(spark, sf), "blob", BOX).select("o_orderkey")


FIELDS = [Field("1", "p_partkey", "integer", 0), Field("2", "p_brand", "text"), Field("3", "p_retailprice", "float")]

QUERIES = {
    "f1_bbox_filter": lambda s, sf: S.bbox_filter(points(s, sf), "wkt", BOX),
    "f2_first_coord": f2,
    "f3_parse_bbox": f3,
    "f4_bbox_filter_report": lambda s, sf: S.bbox_filter_report(points(s, sf), "wkt", BOX),
    "f5_bbox_join": f5,
    "f6_gpkg_geometry_headers": f6,
    "f7_gpkg_wrap": f7,
    "f7_gpkg_wrap_envelope": f7_envelope,
    "f8_filter_by_envelope": f8,
    "f9_project": lambda s, sf: project(given(s, sf, "part"), FIELDS),
}

_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_XY = (
    "xy AS (SELECT *, regexp_extract(wkt, '^[^(]*\\(\\s*(\\S+)\\s+([^\\s,)]+)[^,)]*[,)]', 1) AS tx,"
    " regexp_extract(wkt, '^[^(]*\\(\\s*(\\S+)\\s+([^\\s,)]+)[^,)]*[,)]', 2) AS ty FROM {wkt_points}),"
    f" p AS (SELECT *, CASE WHEN regexp_full_match(tx, '{_NUMBER}') AND regexp_full_match(ty, '{_NUMBER}')"
    f" THEN tx::DOUBLE END AS x, CASE WHEN regexp_full_match(tx, '{_NUMBER}') AND regexp_full_match(ty, '{_NUMBER}')"
    " THEN ty::DOUBLE END AS y FROM xy)"
)
_KEPT = f"(x IS NULL OR (x BETWEEN {BOX[0]} AND {BOX[2]} AND y BETWEEN {BOX[1]} AND {BOX[3]}))"


def _blob() -> str:
    body = " || ".join(f"sha256(o_orderkey::VARCHAR || '-{i}')" for i in range(4))
    return (
        "SELECT o_orderkey, CASE WHEN o_orderkey % 31 <> 0 THEN left(CASE WHEN o_orderkey % 19 = 0 THEN '4751' ELSE"
        " '4750' END || '00' || lpad(lower(hex(o_orderkey % 7 * 2 + 1)), 2, '0') || '00000000' || " + body
        + ", 2 * CASE WHEN o_orderkey % 23 = 0 THEN o_orderkey % 9 ELSE 8 + o_orderkey % 121 END) END AS t FROM {orders}"
    )


_KIND = "o_orderkey % 7"
_OFFSET = f"CASE {_KIND} WHEN 0 THEN 8 WHEN 1 THEN 40 WHEN 2 THEN 56 WHEN 3 THEN 56 WHEN 4 THEN 72 END"
_HEAD_STATUS = (
    "CASE WHEN t IS NULL THEN NULL WHEN length(t) < 16 THEN 'too_short' WHEN left(t, 4) <> '4750' THEN 'bad_magic'"
    f" WHEN {_OFFSET} IS NULL THEN 'bad_envelope' WHEN length(t) < 2 * {_OFFSET} THEN 'too_short' ELSE 'ok' END"
)
_WKB = "upper(sha256(o_orderkey::VARCHAR))"
_X, _Y = "(o_orderkey % 360 - 180)::DOUBLE", "(o_custkey % 180 - 90)::DOUBLE"

ORACLES = {
    "f1_bbox_filter": oracle(f"WITH {_XY} SELECT c_custkey, dataset, wkt FROM p WHERE {_KEPT}"),
    "f2_first_coord": oracle(f"WITH {_XY} SELECT c_custkey, x, y FROM p"),
    "f3_parse_bbox": oracle(
        "WITH n AS (SELECT p_partkey, list_transform(list_filter(string_split(box, ','), lambda t:"
        f" regexp_full_match(trim(t), '{_NUMBER}')), lambda t: trim(t)::DOUBLE) AS b FROM {{box_texts}})"
        " SELECT p_partkey, "
        + ", ".join(f"CASE WHEN len(b) = 4 THEN b[{i + 1}] END AS {n}" for i, n in enumerate(["min_x", "min_y", "max_x", "max_y"]))
        + " FROM n"
    ),
    "f4_bbox_filter_report": oracle(
        f"WITH {_XY} SELECT dataset, count(*) FILTER ({_KEPT}) AS kept, count(*) AS total FROM p GROUP BY 1"
    ),
    "f5_bbox_join": oracle(
        f"WITH {_XY} SELECT c_custkey, x, y, region FROM p JOIN {{boxes}} ON x BETWEEN min_x AND max_x AND y BETWEEN"
        " min_y AND max_y UNION ALL SELECT c_custkey, x, y, NULL FROM p WHERE x IS NULL"
    ),
    "f6_gpkg_geometry_headers": oracle(
        f"SELECT o_orderkey, {_HEAD_STATUS} AS status, CASE WHEN {_HEAD_STATUS} IN ('ok', 'bad_envelope') THEN"
        f" ({_KIND})::INT END AS envelope_type, CASE WHEN {_HEAD_STATUS} = 'ok' THEN upper(substr(t, 2 * {_OFFSET} + 1))"
        f" END AS wkb FROM ({_blob()})"
    ),
    "f7_gpkg_wrap": oracle(f"SELECT o_orderkey, '4750000100000000' || {_WKB} AS blob FROM {{orders}}"),
    "f7_gpkg_wrap_envelope": oracle(
        f"SELECT o_orderkey, 'ok' AS status, 3 AS envelope_type, {_WKB} AS wkb, {_X} AS e0, {_X} + 2 AS e1, {_Y} AS e2,"
        f" {_Y} + 1 AS e3, o_totalprice AS e4, o_totalprice * 2 AS e5 FROM {{orders}}"
    ),
    "f8_filter_by_envelope": oracle(
        f"SELECT o_orderkey FROM {{orders}} WHERE o_orderkey % 10 = 0 OR ({_X} <= {BOX[2]} AND {_X} + 2 >= {BOX[0]}"
        f" AND {_Y} <= {BOX[3]} AND {_Y} + 1 >= {BOX[1]})"
    ),
    "f9_project": oracle("SELECT p_partkey, p_brand, p_retailprice FROM {part}"),
}
