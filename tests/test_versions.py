"""Inputs on which versions differ in columns, types, tables and ranges."""

import struct
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from rowtrail.functions import geometry as G
from rowtrail.operators import address as A
from rowtrail.operators import changes as C
from rowtrail.operators import merge as M
from rowtrail.operators.diff import diff_rows, number_text
from rowtrail.sources import exports


def keys_of(delta):
    return sorted((r["id"], r["op"]) for r in delta.collect())


@pytest.fixture
def versions(spark):
    """(old, new) pairs: a column dropped, added, renamed and retyped, and an edit in a column called dir_name."""
    old = spark.range(300).selectExpr("id", "id * 2 AS a", "concat('n', id) AS dir_name")
    return {
        "dropped": (old, old.drop("a")),
        "added": (old, old.withColumn("z", F.when(F.col("id") < 5, 1))),
        "renamed": (old, old.withColumnRenamed("a", "b")),
        "retyped": (old, old.withColumn("a", F.when(F.col("id") == 7, "other").otherwise(F.col("a").cast("string")))),
        "edited": (old, old.withColumn("dir_name", F.when(F.col("id") < 40, "x").otherwise(F.col("dir_name")))),
        "same": (old, old),
    }


def test_every_diff_finds_what_the_row_diff_finds(spark, tmp_path, versions):
    sizes = {"dropped": 300, "added": 5, "renamed": 300, "retyped": 1, "edited": 40, "same": 0}
    for name, (old, new) in versions.items():
        want = keys_of(diff_rows(old, new, ["id"]))
        assert len(want) == sizes[name], name
        assert keys_of(C.fingerprint_changes(old, new, ["id"])) == want, name
        a, b = A.with_address(old, ["id"]), A.with_address(new, ["id"])
        leaves = A.changed_leaves(A.dir_digests(a), A.dir_digests(b))
        assert keys_of(A.diff_rows_pruned(a, b, ["id"], leaves)) == want, name
        for side, df in (("a", old), ("b", new)):
            A.write_snapshot(df, ["id"], f"{tmp_path}/{name}/{side}")
        assert keys_of(A.diff_snapshots(spark, f"{tmp_path}/{name}/a", f"{tmp_path}/{name}/b", ["id"])) == want, name
    assert sorted(A.read_snapshot(spark, f"{tmp_path}/edited/b").columns) == ["a", "dir_name", "id"]


def test_stored_diff_of_shallow_trees_and_long_lists(spark, tmp_path, monkeypatch):
    old = spark.range(500).selectExpr("id", "id AS v")
    new = old.withColumn("v", F.when(F.col("id") % 7 == 0, -1).otherwise(F.col("v")))
    a, b = A.with_address(old, ["id"], levels=2), A.with_address(new, ["id"], levels=2)
    leaves = A.changed_leaves(A.dir_digests(a), A.dir_digests(b))
    want = keys_of(diff_rows(old, new, ["id"]))
    assert keys_of(A.diff_rows_pruned(a, b, ["id"], leaves)) == want
    monkeypatch.setattr(A, "MAX_LISTED_DIRS", 1)
    for side, df in (("a", old), ("b", new)):
        A.write_snapshot(df, ["id"], f"{tmp_path}/{side}", levels=2)
    delta = A.diff_snapshots(spark, f"{tmp_path}/a", f"{tmp_path}/b", ["id"], ["v"])
    assert keys_of(delta) == want and delta.schema["new"].dataType.names == ["v"]


def test_merges_keep_columns_that_one_side_added(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    ours = base.withColumn("w", F.when(F.col("id") == 1, 9))
    theirs = spark.createDataFrame([(1, "a"), (2, "c")], "id long, v string")
    merged = M.merge_rows(base, ours, theirs, ["id"])
    assert sorted((r["id"], r["status"]) for r in merged.collect()) == [(1, "ours"), (2, "theirs")]
    none = M.resolve(M.list_conflicts(merged), ["id"])
    assert sorted(map(tuple, M.finish_merge(base, merged, none, ["id"]).collect())) == [(1, "a", 9), (2, "c", None)]
    columns = M.merge_columns(base, ours.withColumn("v", F.lit("a")), theirs, ["id"])
    assert {r["id"]: r["resolution"] for r in columns.collect()} == {1: "FastForward", 2: "Conflict"}
    assert sorted(r["id"] for r in M.merge_rows(base, ours.drop("v"), theirs, ["id"]).collect()) == [1, 2]


LOG = "seq long, table_name string, pk string, change_type string"


def test_replay_of_logs_with_several_tables_and_large_numbers(spark):
    log = spark.createDataFrame([((1 << 61) + 5, "t", "1", "I"), (7, "t", "1", "D"), (9, "u", "5", "U"), (8, "t", "5", "U"), (10, "w", "5", "D")], LOG)
    net = {(r["table_name"], r["pk"]): (r["op"], r["seq"]) for r in C.net_changes(log).collect()}
    assert net["t", "1"] == ("I", (1 << 61) + 5) and len(net) == 4
    base = spark.createDataFrame([(5, "old")], "id long, v string")
    current = spark.createDataFrame([(1, "one", 1), (5, "five", 2)], "id long, v string, extra int")
    apply = lambda table: sorted(map(tuple, C.apply_changes(base, log, current, "id", table).collect()))
    assert apply("t") == [(1, "one", 1), (5, "five", 2)]
    assert apply("w") == [] and apply(None) == [(1, "one", 1)]


def test_upsert_keeps_new_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 2)], "id long, v string, w int")
    assert sorted(map(tuple, C.upsert_by_key(df, new, ["id"]).collect())) == [(1, "a", None), (2, "c", 1), (3, "d", 2)]
    assert sorted(map(tuple, C.upsert_by_key(df, new, ["id"], "ignore").collect())) == [(1, "a", None), (2, "b", None), (3, "d", 2)]


def test_csv_gives_every_text_back(spark, tmp_path):
    texts = ["  lead", "trail  ", "", None, "a\nb", 'say "x"', "\\N", "\\", "\\\\N", ",", "\t", "a\r\nb", "é"]
    df = spark.createDataFrame([(i, t, None if t is None else t.encode()) for i, t in enumerate(texts)], "id long, t string, b binary")
    exports.export_csv(df, f"{tmp_path}/csv")
    got = exports.read_csv(spark, f"{tmp_path}/csv", df.schema)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_envelopes_of_both_byte_orders_and_boxes_with_tabs(spark):
    blobs = [b"GP\0" + bytes([flags]) + bytes(4) + struct.pack(order + "4d", 1, 2, 3, 4) + b"wkb" for flags, order in ((3, "<"), (2, ">"))]
    df = spark.createDataFrame([(b,) for b in [*blobs, None, b"GP"]], "b binary")
    assert [r[0] for r in df.select(G.read_envelope(F.col("b"))).collect()] == [[1.0, 2.0, 3.0, 4.0]] * 2 + [None] * 2
    box = spark.createDataFrame([("1,\t2,\n3 , 4",)], "t string").select(G.parse_bbox(F.col("t"))).first()[0]
    assert box == [1.0, 2.0, 3.0, 4.0]


def test_keys_of_more_than_fifteen_columns(spark):
    from rowtrail.functions.address import packed_key

    df = spark.range(1).select(*[F.lit(i).cast("long").alias(f"k{i}") for i in range(17)])
    assert bytes(df.select(packed_key(df, df.columns)).first()[0]) == b"\xdc\x00\x11" + bytes(range(17))


def test_numbers_of_other_types_are_compared_exactly(spark):
    def table(values, kind):
        return spark.createDataFrame(list(enumerate(values)), f"id long, v {kind}")

    def changed(a, b):
        return [r["id"] for r in diff_rows(a, b, ["id"]).orderBy("id").collect()]

    big = 1 << 53
    assert changed(table([D("12345678901234567.89"), D("1.50")], "decimal(19,2)"), table([D("12345678901234567.8800"), D("1.5")], "decimal(21,4)")) == [0]
    assert changed(table([big + 1, big, -(1 << 63), 3, 0], "bigint"), table([float(big), float(big), -(2.0**63), 3.5, -0.0], "double")) == [0, 3]
    assert changed(table([7, 1 << 30, -5], "int"), table([7.0, float(1 << 30), -5.5], "double")) == [2]
    assert changed(table([D(5), D(10) ** 37], "decimal(38,0)"), table([D("5.00"), D("1e15")], "decimal(38,20)")) == [1]
    assert changed(table([D("0.10"), D("0.30"), D("100.00"), D("-0.05")], "decimal(9,2)"), table([0.1, 0.1 + 0.2, 100.0, -0.05], "double")) == [1]
    assert changed(table([0.1, 1e300, float("nan"), 1e-7, None], "double"), table([D("0.1"), D(1), D(1), D("0.0000001"), None], "decimal(38,12)")) == [1, 2]
    assert changed(table([1, 2], "tinyint"), table([D(1), D("2.5")], "decimal(5,2)")) == [1]
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        small = table([D("0E-18"), D("-0.000000000000000001"), D("0.5"), D("20")], "decimal(38,18)")
        assert [r["t"] for r in small.select(number_text(F.col("v"), small.schema["v"].dataType).alias("t")).collect()] == ["0", "-0.000000000000000001", "0.5", "20"]
    spark.conf.set("spark.sql.ansi.enabled", "true")
    base = table([D("98765432109876543.21"), D("1.00")], "decimal(19,2)")
    ours = table([D("98765432109876543.21"), D("2.00")], "decimal(19,2)")
    theirs = table([D("98765432109876543.2101"), D("1.0000")], "decimal(21,4)")
    merged = M.merge_rows(base, ours, theirs, ["id"])
    done = M.finish_merge(base, merged, M.resolve(M.list_conflicts(merged), ["id"], "ours"), ["id"])
    assert {r["id"]: r["v"] for r in done.collect()} == {0: D("98765432109876543.2101"), 1: D("2.0000")}
    wide = table([float(1 << 53)], "double"), table([(1 << 53) + 1], "bigint")
    merged = M.merge_rows(wide[1], wide[1], wide[0], ["id"])
    done = M.finish_merge(wide[1], merged, M.resolve(M.list_conflicts(merged), ["id"], "ours"), ["id"])
    assert done.collect()[0]["v"] == str(1 << 53)
