"""Sources, sinks and streams on small files."""

import json
import os
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from rowtrail.operators.changes import apply_changes, status
from rowtrail.operators.evolve import Field, legends_of
from rowtrail.sources import exports
from rowtrail.sources.dbf import read_dbf
from rowtrail.sources.feature_files import scan_feature_files
from rowtrail.sources.geopackage import expire, export_geopackage, list_tables, publish, read_all, read_geopackage, shards, table_schema
from rowtrail.streaming import feed
from rowtrail.operators.tiles import read_files


@pytest.fixture
def harbour(tmp_path):
    """A package of another program: one feature table with odd values, one attribute table, one of tiles."""
    path = str(tmp_path / "harbour.gpkg")
    with sqlite3.connect(path) as db:
        db.executescript("""
            CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT, identifier TEXT);
            CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER);
            CREATE TABLE berths (id INTEGER PRIMARY KEY, label TEXT, boats INTEGER, shape BLOB, depth REAL, mixed INTEGER);
            CREATE TABLE keepers (code TEXT PRIMARY KEY, present BOOLEAN) WITHOUT ROWID;
            INSERT INTO gpkg_contents VALUES ('keepers', 'attributes', 'k'), ('berths', 'features', 'b'), ('chart', 'tiles', 'c');
            INSERT INTO gpkg_geometry_columns VALUES ('berths', 'shape', 'POLYGON', 25832);
            INSERT INTO berths VALUES (4, 'north', 12, NULL, 3.5, 7), (5, 'south', 0, x'4750', 6, 'seven');
            INSERT INTO berths VALUES (40000, NULL, 31, NULL, NULL, 7.5);
            INSERT INTO keepers VALUES ('m', 0), ('o', 1);
        """)
    return path


def test_read_geopackage(spark, harbour):
    assert list_tables(harbour) == ["berths", "keepers"]
    df = read_geopackage(spark, harbour, "berths", slices=4)
    assert df.schema.simpleString() == "struct<id:bigint,label:string,boats:bigint,shape:binary,depth:float,mixed:bigint>"
    assert df.schema["id"].metadata["primary_key_index"] == 0
    assert df.schema["shape"].metadata["geometry_crs"] == "EPSG:25832"
    rows = [tuple(r) for r in df.orderBy("id").collect()]
    assert rows == [(4, "north", 12, None, 3.5, 7), (5, "south", 0, b"GP", 6.0, None), (40000, None, 31, None, None, None)]
    assert [tuple(r) for r in read_all(spark, harbour)["keepers"].orderBy("code").collect()] == [("m", False), ("o", True)]
    with pytest.raises(Exception, match="no table"):
        read_geopackage(spark, harbour, "missing").count()


def test_append_updates_equal_keys(spark, tmp_path):
    path = str(tmp_path / "upsert")
    make = lambda rows: spark.createDataFrame(rows, "id long, name string, seq int")
    export_geopackage(make([(1, "a", 1), (1, "b", 3), (1, "c", 2), (2, "x", 1)]), path, "t", ["id"], seq="seq")
    export_geopackage(make([(2, "y", 1), (3, "z", 1)]), path, "t", ["id"], seq="seq", mode="append")
    assert sorted(map(tuple, read_geopackage(spark, path, "t").collect())) == [(1, "b"), (2, "y"), (3, "z")]
    with sqlite3.connect(shards(path, "t")[0]) as db:
        assert {r[0] for r in db.execute("SELECT srs_id FROM gpkg_spatial_ref_sys")} == {-1, 0, 4326}


def test_export_geopackage(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(50).selectExpr("id % 10 AS id", "'n' AS name", "CAST('x' AS binary) AS geom")
    export_geopackage(df, path, "a/b", ["id"], geometry="geom", geometry_type="POINT", srs=3857)
    assert read_geopackage(spark, path, "a_b").count() == 10
    # A shard of a failed attempt is not in the manifest and is not read.
    stray = os.path.join(path, "part-stray.gpkg")
    with sqlite3.connect(stray) as db:
        db.execute("CREATE TABLE a_b (id INTEGER PRIMARY KEY, name TEXT, geom BLOB)")
        db.execute("INSERT INTO a_b VALUES (99, 'stray', NULL)")
    assert stray not in shards(path, "a_b") and read_geopackage(spark, path, "a_b").count() == 10
    with sqlite3.connect(shards(path, "a_b")[0]) as db:
        assert db.execute("SELECT column_name, geometry_type_name, srs_id FROM gpkg_geometry_columns").fetchall() == [
            ("geom", "POINT", 3857)]
    export_geopackage(df.filter("id < 3"), path, "a/b", ["id"])
    assert read_geopackage(spark, path, "a_b").count() == 3
    assert all(map(os.path.exists, shards(path, "a_b")))
    # Overwritten and stray shards stay until they expire.
    files = len(os.listdir(path))
    assert expire(path) == 0 and expire(path, -1.0) == files - len(shards(path, "a_b")) - 1
    assert read_geopackage(spark, path, "a_b").count() == 3 and not os.path.exists(stray)


def test_tables_of_one_folder_stay_apart(spark, tmp_path):
    path = str(tmp_path / "many")
    make = lambda rows, names: spark.createDataFrame(rows, names)
    export_geopackage(make([(k, f"a{k}") for k in range(40)], "id long, name string"), path, "a", ["id"], buckets=8)
    export_geopackage(make([(k, 0.5 * k, None) for k in range(5)], "n int, x double, note string"), path, "b", [])
    export_geopackage(make([], "id long, flag boolean"), path, "c", ["id"])
    assert list_tables(path) == ["a", "b", "c"]
    before = set(shards(path, "a"))
    export_geopackage(make([(7, "new"), (100, "more")], "id int, name string"), path, "a", ["id"], mode="append")
    after = set(shards(path, "a"))
    assert 1 <= len(after - before) <= 2 and len(before & after) >= 6  # only shards that hold a key are written again
    export_geopackage(make([(9, 1.0, "x")], "n int, x double, note string"), path, "b", [], mode="append")
    tables = read_all(spark, path)
    got = {r["id"]: r["name"] for r in tables["a"].collect()}
    assert got == {k: f"a{k}" for k in range(40)} | {7: "new", 100: "more"}
    assert sorted(r["n"] for r in tables["b"].collect()) == [0, 1, 2, 3, 4, 9]
    assert tables["c"].count() == 0 and tables["c"].columns == ["id", "flag"] and table_schema(path, "a")["id"].metadata["primary_key_index"] == 0
    export_geopackage(make([(1, "only")], "id long, name string"), path, "a", ["id"])
    assert read_geopackage(spark, path, "a").count() == 1 and read_geopackage(spark, path, "b").count() == 6
    with pytest.raises(ValueError, match="has the keys"):
        export_geopackage(make([(1, "only")], "id long, name string"), path, "a", ["name"], mode="append")


def test_manifests_of_writers_at_once_are_merged(tmp_path):
    path, seen = str(tmp_path), []

    def first(tables):
        if not seen:  # another writer publishes between this one's reading and its own publishing
            seen.append(True)
            publish(path, lambda tables: tables | {"theirs": {"shards": []}})
        return tables | {"ours": {"shards": []}}

    publish(path, first)
    assert list_tables(path) == ["ours", "theirs"] and not [n for n in os.listdir(path) if n.startswith("_draft")]


def test_read_dbf_counts_records(spark, tmp_path):
    fields = [("NAME", "C", 5), ("N", "N", 6)]
    head = struct.pack("<BBBBIHH20x", 3, 124, 1, 1, 10, 33 + 64, 12)
    for name, kind, size in fields:
        head += struct.pack("<11sc4xBB14x", name.encode(), kind.encode(), size, 0)
    body = b"".join((b"*" if i == 4 else b" ") + b"n%-4d%6d" % (i, i) for i in range(10))
    path = tmp_path / "x.dbf"
    path.write_bytes(head + b"\r" + body + b"\x1a")
    for slices in (1, 3, 50):
        rows = read_dbf(spark, str(path), slices).orderBy("fid").collect()
        assert [(r.fid, r.NAME, r.N) for r in rows] == [(i + 1, f"n{i}", float(i)) for i in range(10) if i != 4]


    (tmp_path / "y.dbf").write_bytes(path.read_bytes())
    assert [r.fid for r in read_dbf(spark, str(tmp_path), 4).orderBy("fid").collect()] == [
        i for i in range(1, 21) if i not in (5, 15)]


def test_scan_feature_files_with_two_keys(spark, tmp_path):
    import base64
    fields = [Field("0" * 36, "b", "text", 1), Field("1" * 36, "a", "integer", 0), Field("2" * 36, "v", "text")]
    legends = legends_of(spark, [["2" * 36]])
    legend = legends.first().legend_hash.encode()
    name = base64.urlsafe_b64encode(b"\x92\x07\xa1k").decode()
    (tmp_path / name).write_bytes(b"\x92\xd9\x40" + legend + b"\x91\xa5hello")
    (tmp_path / "broken").write_bytes(b"\xc1")
    assert [tuple(r) for r in scan_feature_files(spark, str(tmp_path), legends, fields).collect()] == [("k", 7, "hello")]


def test_csv_and_geojson(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"', b"\x01", "POINT(1 2)"), (2, None, None, None)], "id long, t string, b binary, g string")
    exports.export_csv(df, f"{tmp_path}/csv")
    back = exports.read_csv(spark, f"{tmp_path}/csv", df.schema).orderBy("id").collect()
    assert [tuple(r) for r in back] == [(1, 'say "hi"', b"\x01", "POINT(1 2)"), (2, None, None, None)]
    shown = exports.csv_columns(df, "display").orderBy("id").collect()
    assert tuple(shown[0]) == ("1", '"say "hi""', "<1 bytes>", '"POINT(1 2)"') and shown[1].t == "NULL"
    features = [json.loads(r.feature) for r in exports.to_geojson(df.orderBy("id"), "g").collect()]
    assert features[0] == {"type": "Feature", "geometry": {"type": "Feature", "wkt": "POINT(1 2)"},
                           "properties": {"id": 1, "t": 'say "hi"', "b": "<blob>"}}
    assert features[1] == {"type": "Feature", "geometry": None, "properties": {"id": 2, "t": None, "b": None}}


def test_read_files_does_not_read_unused_content(spark, sf):
    files = read_files(spark, sf, "*.parquet").select("name", "length")
    assert {r.name: r.length for r in files.collect()}["region.parquet"] == os.path.getsize(f"{sf}/region.parquet")
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()


LOG = "seq long, table_name string, pk string, change_type string"


def write_log(spark, folder, part, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{folder}")


def test_stream_over_several_batches_equals_batch(spark, tmp_path):
    log = f"{tmp_path}/log"
    base = spark.createDataFrame([(i, "old", 0.0) for i in range(5)], "id long, a string, b double")
    current = lambda: spark.createDataFrame([(i, f"now{i}") for i in range(1, 8)], "id long, a string")
    parts = [[(1, "t", "1", "U"), (2, "t", "6", "I"), (3, "u", "0", "D")], [(4, "t", "6", "D"), (5, "t", "2", "U")],
             [(6, "t", "0", "I"), (7, "t", "7", "I")]]
    for n, rows in enumerate(parts):
        write_log(spark, log, n, rows)
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(log)
        feed.stream_status(stream, f"{tmp_path}/status", f"{tmp_path}/c1").awaitTermination()
        feed.stream_apply(stream, current, "id", f"{tmp_path}/applied", f"{tmp_path}/c2").awaitTermination()
    everything = spark.read.schema(LOG).parquet(log)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(feed.read_status(spark, f"{tmp_path}/status")) == key(status(everything))
    got = feed.read_applied(base, f"{tmp_path}/applied", "id")
    # Key 0 has no current row: it comes back as a row of NULLs.
    assert key(got) == key(apply_changes(base, everything, current(), "id"))
    folded = feed.compact(base, f"{tmp_path}/applied", "id", f"{tmp_path}/folded")
    assert key(folded) == key(got)


def test_repeated_batch_changes_nothing(spark, tmp_path):
    """A new checkpoint replays the batches under their old numbers."""
    log, base = f"{tmp_path}/log", spark.createDataFrame([(1, "old")], "id long, a string")
    write_log(spark, log, 0, [(1, "t", "1", "U"), (2, "t", "2", "I")])
    current = lambda: spark.createDataFrame([(1, "new"), (2, "two")], "id long, a string")
    counts = []
    for n in range(2):
        stream = spark.readStream.schema(LOG).parquet(log)
        feed.stream_apply(stream, current, "id", f"{tmp_path}/out", f"{tmp_path}/c{n}").awaitTermination()
        counts.append(spark.read.parquet(f"{tmp_path}/out").count())
        assert sorted(map(tuple, feed.read_applied(base, f"{tmp_path}/out", "id").collect())) == [(1, "new"), (2, "two")]
    assert counts == [2, 2]
