"""Value text, paths and geometry headers on known small cases."""

import struct

import pytest
from pyspark.sql import functions as F, types as T

from rowtrail.functions import address as P
from rowtrail.functions import geometry as G
from rowtrail.functions import text as S


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(df)).collect()]


@pytest.mark.parametrize("value, text", [
    (1.0, "1"), (0.0, "0"), (-0.0, "-0"), (2.72, "2.72"), (1e16, "10000000000000000"), (1e-7, "0.0000001"),
    (123456789.125, "123456789.125"), (-1.5e300, "-15" + "0" * 299), (1.25e-10, "0.000000000125"), (1e7, "10000000"),
    (float("nan"), "NaN"), (float("inf"), "inf"), (float("-inf"), "-inf"), (12345678.9, "12345678.9"), (100.0, "100"),
])
def test_float_text(spark, value, text):
    assert column(spark, [value], "double", lambda df: S.float_text(df.v)) == [text]


def test_format_value(spark):
    texts = ["a" * 50, "b" * 51, None, "é" * 26]
    got = column(spark, texts, "string", lambda df: S.format_value(df.v, T.StringType()))
    assert got == ['"' + "a" * 50 + '"', '"' + "b" * 47 + '..."', "NULL", '"' + "é" * 26 + '..."']
    assert column(spark, [True, None], "boolean", lambda df: S.format_value(df.v, T.BooleanType())) == ["true", "NULL"]
    assert column(spark, [b"abc"], "binary", lambda df: S.format_value(df.v, T.BinaryType())) == ["<3 bytes>"]


def test_format_file_size(spark):
    sizes = [0, 1023, 1024, 1280, 1792, 1536, (1 << 20) - 1, 1 << 20, 3 << 19, 1 << 30, 5 << 40]
    want = ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.8 KB", "1.5 KB", "1024.0 KB", "1.0 MB", "1.5 MB", "1.00 GB", "5120.00 GB"]
    assert column(spark, sizes, "long", lambda df: S.format_file_size(df.v)) == want


def test_int_paths(spark):
    got = column(spark, [77, 1234567890, 0, -1], "long", lambda df: P.int_directory(df.v))
    assert got == ["A/A/A/B", "J/l/g/L", "A/A/A/A", "_/_/_/_"]
    assert column(spark, [77], "long", lambda df: P.int_directory_hex(df.v)) == ["0/0/0/4"]
    assert column(spark, [0xABCDEF], "long", lambda df: P.int_directory_hex(df.v)) == ["b/c/d/e"]


def test_pk_filename(spark):
    got = column(spark, [77, 200, -1, 0, 256, -33, 1 << 40], "long", lambda df: P.pk_filename(df, ["v"]))
    packed = [b"\x91\x4d", b"\x91\xcc\xc8", b"\x91\xff", b"\x91\x00", b"\x91\xcd\x01\x00", b"\x91\xd0\xdf",
              b"\x91\xcf" + struct.pack(">Q", 1 << 40)]
    import base64
    assert got == [base64.urlsafe_b64encode(p).decode() for p in packed]
    assert got[0] == "kU0="


def test_long_file_names_have_no_line_breaks(spark):
    assert "\n" not in column(spark, ["x" * 500], "string", lambda df: P.pk_filename(df, ["v"]))[0]


def test_hash_paths(spark):
    hexed = column(spark, [77], "long", lambda df: P.full_feature_path(df, ["v"], scheme="hash", levels=2,
                                                                         encoding="hex", branches=256))[0]
    assert [len(p) for p in hexed.split("/")] == [2, 2, 4]
    texts = column(spark, ["a/b"], "string", lambda df: P.full_feature_path(df, ["v"]))[0]
    assert [len(p) for p in texts.split("/")[:4]] == [1, 1, 1, 1]


def test_row_digest_keeps_columns_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, ""), ("", None)], "x string, y string")
    assert df.select(P.row_digest(df, ["x", "y"])).distinct().count() == 4


def test_tile_shard_path(spark):
    got = column(spark, ["a.copc.laz", "a.laz", "a.las", "a.tif"], "string",
                 lambda df: P.tile_shard_path(df.v, P.POINT_CLOUD_EXTENSIONS))
    assert got == ["ca/a", "ca/a", "ca/a", got[3]] and got[3].endswith("/a.tif")


def test_first_coord(spark):
    texts = ["POINT(1 2)", "POINT( 1.5   -2e1 )", "POINT Z (1 2 3)", "LINESTRING(3 4, 5 6)", "POLYGON((0 0, 1 1))",
             "POINT(1d 2)", "POINT(1)", "POINT(1 2", "junk", None, "POINT(+1 .5)", "POINT(inf 0)"]
    got = column(spark, texts, "string", lambda df: G.first_coord(df.v))
    assert [tuple(g) if g else None for g in got] == [
        (1, 2), (1.5, -20), (1, 2), (3, 4), None, None, None, None, None, None, (1, 0.5), (float("inf"), 0)]


def test_parse_bbox(spark):
    got = column(spark, ["-180,-90,180,90", "0, 0 ,1,1", "1,2,3", "1,2,3,4,5", "1,x,2,3,4", ""], "string",
                 lambda df: G.parse_bbox(df.v))
    assert got == [[-180, -90, 180, 90], [0, 0, 1, 1], None, None, [1, 2, 3, 4], None]


def test_gpkg_header(spark):
    point = bytes.fromhex("0101000000") + struct.pack("<dd", 1.0, 2.0)
    box = b"GP\x00\x03" + bytes(4) + struct.pack("<4d", -180, 180, -90, 90) + b"\x01\x03\x00\x00\x00"
    blobs = [b"GP\x00\x01" + bytes(4) + point, box, b"GP\x00", b"XX\x00\x01" + bytes(4), b"GP\x00\x0b" + bytes(4),
             b"GP\x00\x03" + bytes(10), None]
    got = column(spark, blobs, "binary", lambda df: G.gpkg_header(df.v))
    assert [g and (g.status, g.envelope_type) for g in got] == [
        ("ok", 0), ("ok", 1), ("too_short", None), ("bad_magic", None), ("bad_envelope", 5), ("too_short", None), None]
    assert bytes(got[0].wkb) == point and bytes(got[1].wkb) == b"\x01\x03\x00\x00\x00"
    assert column(spark, blobs, "binary", lambda df: G.read_envelope(df.v))[:3] == [None, [-180, 180, -90, 90], None]


def test_gpkg_wrap_round_trip(spark):
    df = spark.createDataFrame([(b"wkb", 1.0, 2.0)], "w binary, a double, b double")
    blob = G.gpkg_wrap(df.w, [df.a, df.b, df.a, df.b])
    row = df.select(blob.alias("g")).select(G.read_envelope(F.col("g")), G.gpkg_header(F.col("g")).wkb).first()
    assert row[0] == [1, 2, 1, 2] and bytes(row[1]) == b"wkb"
    assert bytes(df.select(G.gpkg_wrap(df.w)).first()[0]) == b"GP\x00\x01\x00\x00\x00\x00wkb"
    with pytest.raises(ValueError):
        G.gpkg_wrap(df.w, [df.a, df.b], kind=1)


def test_typed_access_never_coerces(spark):
    df = spark.sql("SELECT cast(42 AS variant) AS v UNION ALL SELECT cast('42' AS variant)"
                   " UNION ALL SELECT cast(2.72D AS variant) UNION ALL SELECT parse_json('null')")
    rows = df.select(*[S.typed(F.col("v"), k).alias(k) for k in ("i64", "str", "f64", "bool")],
                     S.is_null_value(F.col("v")).alias("n")).collect()
    assert sorted(map(str, rows)) == sorted(map(str, [
        T.Row(i64=42, str=None, f64=None, bool=None, n=False), T.Row(i64=None, str="42", f64=None, bool=None, n=False),
        T.Row(i64=None, str=None, f64=2.72, bool=None, n=False), T.Row(i64=None, str=None, f64=None, bool=None, n=True)]))
