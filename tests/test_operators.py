"""Laws and small golden cases of the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from rowtrail.operators import address as A
from rowtrail.operators import catalog as K
from rowtrail.operators import changes as C
from rowtrail.operators import diff as D
from rowtrail.operators import evolve as E
from rowtrail.operators import merge as M
from rowtrail.operators import spatial as S
from rowtrail.operators import tiles as T
from rowtrail.operators.rows import assign_rowid
from rowtrail.plans import fits, join_small, salted_join

COLS = "id long, a string, b double"


def frame(spark, rows, schema=COLS):
    return spark.createDataFrame(rows, schema)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def versions(spark):
    """Base, ours and theirs with random edits, NULLs and a NULL key."""
    rnd = random.Random(7)
    base = {i: (rnd.choice("xyz"), rnd.choice([None, 1.0, 2.0])) for i in range(300)}
    base[None] = ("null key", 1.0)

    def edit(rows):
        out = {}
        for k, v in rows.items():
            roll = rnd.random()
            if roll < 0.1:
                continue
            out[k] = (rnd.choice("xyz"), rnd.choice([None, 1.0, 2.0])) if roll < 0.4 else v
        out |= {1000 + rnd.randrange(40): (rnd.choice("xyz"), 3.0) for _ in range(30)}
        return out

    sides = [base, edit(base), edit(base)]
    return sides, [frame(spark, [(k, *v) for k, v in s.items()]) for s in sides]


def test_diff_of_equal_tables_is_empty(versions):
    _, (base, _, _) = versions
    assert D.diff_rows(base, base, ["id"]).isEmpty()


def test_diff_summary_of_nothing(versions):
    _, (base, _, _) = versions
    assert D.diff_summary(D.diff_rows(base, base, ["id"])).collect() == [(0, 0, 0)]


def test_diff_by_brute_force(versions):
    (old, new, _), (base, ours, _) = versions
    want = []
    for k in set(old) | set(new):
        if old.get(k) != new.get(k):
            op = "I" if k not in old else "D" if k not in new else "U"
            names = [n for n, x, y in zip("ab", old[k], new[k]) if x != y] if op == "U" else []
            want.append((k, op, old.get(k), new.get(k), names))
    got = [(r.id, r.op, r.old and tuple(r.old), r.new and tuple(r.new), r.changed_columns)
           for r in D.diff_rows(base, ours, ["id"]).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_applying_a_diff_gives_the_new_table(versions):
    _, (base, ours, _) = versions
    base, ours = base.filter("id IS NOT NULL"), ours.filter("id IS NOT NULL")
    delta = D.diff_rows(base, ours, ["id"])
    upserts = delta.filter("op <> 'D'").select("id", "new.*")
    assert rows_of(C.replace_rows(base, delta, upserts, ["id"])) == rows_of(ours)


def test_diff_with_different_columns(spark):
    old = frame(spark, [(1, "a")], "id long, a string")
    new = frame(spark, [(1, "a", 2)], "id long, a string, extra int")
    row = D.diff_rows(old, new, ["id"]).first()
    assert row.op == "U" and row.changed_columns == ["extra"]


def test_long_changes(spark):
    old = frame(spark, [(1, "a", 1.0), (2, "b", 2.0)])
    new = frame(spark, [(1, "a", 1.5), (3, None, 3.0)])
    got = rows_of(D.row_changes_long(D.diff_rows(old, new, ["id"]), ["id"]))
    assert got == sorted([(1, "U", "b", "1", "1.5"), (2, "D", None, None, None), (3, "I", "a", None, "NULL"),
                          (3, "I", "b", None, "3")], key=str)


def test_prefix_filters(spark):
    df = frame(spark, [("park",), ("parks",), ("road",)], "dataset string")
    assert D.select_delta(df, ["park"]).count() == 2
    assert D.select_delta(df, []).count() == 3


def test_strict_merge_small_cases(spark):
    def delta(rows):
        return frame(spark, rows, "id long, op string, old struct<v:string>, new struct<v:string>, n int")

    ours = delta([(1, "U", ("o",), ("x",), 1), (2, "D", ("o",), None, 1), (3, "U", ("o",), ("same",), 1),
                  (4, "I", None, ("a",), 1), (5, "U", ("o",), ("first",), 1), (5, "U", ("o",), ("last",), 2)])
    theirs = delta([(3, "U", ("o",), ("same",), 1), (4, "I", None, ("b",), 1), (6, "U", ("o",), ("t",), 1),
                    (2, "U", ("o",), ("y",), 1)])
    got = {r.id: r for r in M.merge_deltas(ours, theirs, ["id"], seq="n").collect()}
    assert got[1].resolution == "FastForward" and got[1]["values"].v == "x"
    assert got[2].conflict_type == "ModifyDelete" and got[2].ours is None and got[2].theirs.v == "y"
    assert got[3].conflict_type == "BothModified" and got[3].ancestor.v == "o"
    assert got[4].conflict_type == "BothAdded" and got[4].ancestor is None
    assert got[5]["values"].v == "last" and got[6]["values"].v == "t"
    alone = M.merge_deltas(delta([(2, "D", ("o",), None, 1)]), delta([]), ["id"])
    assert alone.isEmpty()


def test_row_merge_by_brute_force(versions):
    (b, o, t), frames = versions
    want = []
    for k in set(b) | set(o) | set(t):
        x, y, z = b.get(k), o.get(k), t.get(k)
        if y == x and z == x:
            continue
        status = "ours" if z == x else "theirs" if y == x else "identical" if y == z else "conflict"
        want.append((k, status, x, y, z, None if status == "conflict" else z if status == "theirs" else y))
    pick = lambda v: v and tuple(v)
    got = [(r.id, r.status, pick(r.base), pick(r.ours), pick(r.theirs), pick(r.merged))
           for r in M.merge_rows(*frames, ["id"]).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_merge_with_an_unchanged_side_gives_the_other(versions):
    _, (base, ours, _) = versions
    base, ours = base.filter("id IS NOT NULL"), ours.filter("id IS NOT NULL")
    merged = M.merge_rows(base, ours, base, ["id"])
    none = M.resolve(M.list_conflicts(merged), ["id"])
    assert rows_of(M.finish_merge(base, merged, none, ["id"])) == rows_of(ours)


def test_column_merge(spark):
    base = frame(spark, [(1, "a", 1.0), (2, "a", 1.0)])
    ours = frame(spark, [(1, "x", 1.0), (2, "x", 1.0)])
    theirs = frame(spark, [(1, "a", 9.0), (2, "y", 1.0)])
    got = {r.id: r for r in M.merge_columns(base, ours, theirs, ["id"]).collect()}
    assert got[1].resolution == "ColumnMerge" and tuple(got[1].merged) == ("x", 9.0)
    assert got[2].resolution == "Conflict" and got[2].merged is None


def test_unfinished_merge_is_refused(spark):
    base, ours, theirs = (frame(spark, [(1, v, 1.0), (2, v, 1.0)]) for v in "abc")
    merged = M.merge_rows(base, ours, theirs, ["id"])
    one = M.resolve(M.list_conflicts(merged), ["id"], "theirs", only={"id": 1})
    with pytest.raises(M.UnresolvedConflicts):
        M.finish_merge(base, merged, one, ["id"])
    with pytest.raises(ValueError, match="no strategy"):
        M.resolve(merged, ["id"], "best")


def test_net_changes_of_a_hot_key(spark):
    log = spark.range(20_000).selectExpr("id AS seq", "'t' AS table_name", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE"
                                         " CAST(id AS string) END AS pk", "CASE WHEN id % 2 = 0 THEN 'I' ELSE 'D' END AS change_type")
    hot = C.net_changes(log).filter("pk = 'hot'").collect()
    assert [(r.op, r.seq) for r in hot] == [("I", 19_998)]


def test_unknown_change_kinds_are_ignored(spark):
    log = frame(spark, [(1, "t", "1", "I"), (2, "t", "1", "?")], "seq long, table_name string, pk string, change_type string")
    assert rows_of(C.net_changes(log)) == [("t", "1", "I", 1)]
    assert rows_of(C.status(log)) == [("t", 0, 1, 0, 1)]


def test_deleting_a_missing_row_does_nothing(spark):
    base = frame(spark, [(1, "a", 1.0)])
    log = frame(spark, [(1, "t", "9", "D"), (2, "t", "2", "I")], "seq long, table_name string, pk string, change_type string")
    current = frame(spark, [(2, "new")], "id long, a string")
    assert rows_of(C.apply_changes(base, log, current, "id")) == [(1, "a", 1.0), (2, "new", None)]


def test_upsert_modes(spark):
    have, new = frame(spark, [(1, "a", 1.0)]), frame(spark, [(1, "b", 2.0), (2, "c", 3.0)])
    assert rows_of(C.upsert_by_key(have, new, ["id"])) == [(1, "b", 2.0), (2, "c", 3.0)]
    assert rows_of(C.upsert_by_key(have, new, ["id"], "ignore")) == [(1, "a", 1.0), (2, "c", 3.0)]
    with pytest.raises(ValueError):
        C.upsert_by_key(have, new, ["id"], "merge")


def test_salted_and_broadcast_joins_agree(spark):
    big = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS k")
    small = spark.range(100).selectExpr("id AS k", "id * 2 AS v")
    assert fits(small) and not fits(small, max_rows=99) and not fits(small, max_bytes=50)
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = rows_of(big.join(small, ["k"], how))
        assert rows_of(salted_join(big, small, ["k"], how, 7, ["id"])) == want
        assert rows_of(join_small(big, small, ["k"], how)) == want
        assert rows_of(join_small(big, small, ["k"], how, salts=4, salt_by=["id"], max_rows=3)) == want


def test_pruned_diff_equals_diff(spark, versions):
    _, (base, ours, _) = versions
    base, ours = base.filter("id IS NOT NULL"), ours.filter("id IS NOT NULL")
    a, b = A.with_address(base, ["id"]), A.with_address(ours, ["id"])
    leaves = A.changed_leaves(A.dir_digests(a), A.dir_digests(b))
    assert rows_of(A.diff_rows_pruned(a, b, ["id"], leaves)) == rows_of(D.diff_rows(base, ours, ["id"]))


@pytest.mark.parametrize("listed, named, column", [(100_000, 1000, "_dir"), (100_000, 2, "_dir_3"), (1, 1000, None)])
def test_stored_diff_reads_changed_directories_only(spark, tmp_path, monkeypatch, listed, named, column):
    monkeypatch.setattr(A, "MAX_LISTED_DIRS", listed)
    monkeypatch.setattr(A, "MAX_SCAN_NAMES", named)
    base = spark.range(20_000).selectExpr("id", "CAST(id % 7 AS string) AS a", "id * 0.5D AS b")
    edited = base.withColumn("a", F.when(F.col("id").between(640, 900), "new").otherwise(F.col("a")))
    for name, df in (("x", base), ("y", edited)):
        A.write_snapshot(df, ["id"], f"{tmp_path}/{name}")
    delta = A.diff_snapshots(spark, f"{tmp_path}/x", f"{tmp_path}/y", ["id"])
    assert delta.count() == 261 and rows_of(delta) == rows_of(D.diff_rows(base, edited, ["id"]))
    plan = delta._jdf.queryExecution().executedPlan().toString()
    assert column is None or plan.count(f"PushedFilters: [In({column}, ") + plan.count(f"EqualTo({column},") >= 2
    assert A.diff_snapshots(spark, f"{tmp_path}/x", f"{tmp_path}/x", ["id"]).isEmpty()


def test_root_digest_follows_content(spark):
    base = spark.range(500).selectExpr("id", "CAST(id AS string) AS a")
    root = lambda df: A.dir_digests(A.with_address(df, ["id"])).filter("level = 0").first()
    assert root(base) == root(base.orderBy(F.desc("id")).repartition(5))
    assert root(base).digest != root(base.filter("id <> 9")).digest
    assert root(base).n == 500


FIELDS = [E.Field(f"{i:08x}-0000-4000-8000-000000000000", n, t, pk) for i, (n, t, pk) in enumerate(
    [("id", "integer", 0), ("name", "text", None), ("n", "integer", None), ("new", "float", None)])]


def test_decode_follows_ids(spark):
    ids = [f.id for f in FIELDS]
    layouts = [[ids[1], ids[2]], [ids[2], "dropped", ids[1]], [ids[1], ids[2], ids[1]]]
    legends = E.legends_of(spark, layouts)
    hashes = {tuple(r.column_ids): r.legend_hash for r in legends.collect()}
    h = [hashes[tuple(x)] for x in layouts]
    stored = frame(spark, [
        (1, h[0], ["a", "1"]), (2, h[1], ["2", "x", "b"]), (3, "unknown", ["c"]), (4, h[0], ["d", "4", "surplus"]),
        (5, h[0], ["short"]), (6, h[2], ["first", "6", "last"]), (7, h[2], ["first", "7"]), (8, h[0], ["e", "no number"]),
    ], "id long, legend_hash string, values array<string>")
    got = rows_of(E.decode_features(stored, legends, FIELDS, ["id"]))
    assert got == [(1, "a", 1, None), (2, "b", 2, None), (4, "d", 4, None), (5, "short", None, None), (6, "last", 6, None),
                   (7, "first", 7, None), (8, "e", None, None)]


def test_schema_metadata_round_trip():
    fields = [E.Field("1", "fid", "integer", 0, size=64), E.Field("2", "geom", "geometry", None, "MULTIPOLYGON", "EPSG:4326"),
              E.Field("3", "name", "text", length=250), E.Field("4", "x", "numeric", precision=10, scale=2)]
    schema = E.to_spark_schema(fields)
    assert E.fields_of(schema) == fields
    assert [f.dataType.simpleString() for f in schema] == ["bigint", "binary", "string", "decimal(10,2)"]
    assert not schema["fid"].nullable
    mixed = [E.Field("1", "b", "text", 1), E.Field("2", "a", "text", 0), E.Field("3", "v", "text")]
    assert E.pk_columns(mixed) == ["a", "b"] and E.value_columns(mixed) == ["v"]


def test_bbox_keeps_what_it_cannot_read(spark):
    rows = [(1, "POINT(0.5 0.5)"), (2, "POINT(1 1)"), (3, "POINT(2 0)"), (4, None), (5, "POLYGON((9 9, 8 8))"), (6, "x")]
    df = frame(spark, rows, "id long, g string")
    assert [r.id for r in S.bbox_filter(df, "g", (0, 0, 1, 1)).orderBy("id").collect()] == [1, 2, 4, 5, 6]
    assert S.bbox_filter(df, "g", None).count() == 6 and S.bbox_filter(df, None, (0, 0, 1, 1)).count() == 6
    blobs = frame(spark, [(1, b"x")], "id long, g binary")
    assert S.bbox_filter(blobs, "g", (0, 0, 1, 1)).count() == 1


def test_bbox_join_by_brute_force(spark):
    rnd = random.Random(3)
    points = [(i, rnd.choice([0.0, 0.25, -1.0, rnd.uniform(-50, 50), 1e18]), rnd.uniform(-50, 50)) for i in range(300)]
    points += [(900, None, 1.0), (901, 1.0, None)]
    boxes = [("big", -1e300, -1e300, 1e300, 1e300), ("all", float("-inf"), float("-inf"), float("inf"), float("inf")),
             ("dot", 0.25, -50.0, 0.25, 50.0), ("wrong", 5.0, 5.0, 4.0, 4.0)]
    for i in range(60):
        x, y, w = rnd.uniform(-50, 50), rnd.uniform(-50, 50), rnd.choice([0, 1e-6, 0.5, 3, 40, 64])
        boxes.append((f"r{i}", x, y, x + w, y + w * rnd.random()))
    want = [(i, r) for i, x, y in points[:300] for r, a, b, c, d in boxes if a <= x <= c and b <= y <= d]
    want += [(900, None), (901, None)]
    df = frame(spark, points, "id long, x double, y double")
    regions = frame(spark, boxes, "region string, min_x double, min_y double, max_x double, max_y double")
    got = S.bbox_join(df, "x", "y", regions)
    assert sorted(map(str, ((r.id, r.region) for r in got.collect()))) == sorted(map(str, want))


def test_rowids_with_a_hot_value(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "id AS v")
    got = assign_rowid(df, ["k"]).collect()
    assert sorted(r["_rowid"] for r in got) == list(range(1, 5001))
    by_id = sorted(got, key=lambda r: r["_rowid"])
    assert [r.k for r in by_id] == sorted(r.k for r in got)
    assert assign_rowid(df.filter("v < 0"), ["k"]).isEmpty()


def test_discovery_skips_hidden_places(spark):
    paths = ["a/.table-dataset/feature/x", "a/b/.file-dataset/files/y", ".x/c/.table-dataset/z", "target/d/.table-dataset/z",
             "e.gpkg/f/.table-dataset/z", "g/.table-dataset", "a/.table-dataset/meta/.file-dataset/q", "h/plain.txt"]
    df = frame(spark, [(p,) for p in paths], "path string")
    assert rows_of(K.discover_datasets(df)) == [("a", "table"), ("a/b", "file")]


def test_file_removal_report(spark):
    have = frame(spark, [("d", "a.txt", 1), ("d", "b.txt", 2)], "dataset string, name string, length long")
    left, report = K.rm_files(have, frame(spark, [("d", "a.txt"), ("d", "c.txt")], "dataset string, name string"))
    assert [r.name for r in left.collect()] == ["b.txt"]
    assert rows_of(report) == [("d", "a.txt", "Removed"), ("d", "c.txt", "Not found")]


def test_tiff_variants(spark):
    import struct
    gray = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", 3) + b"".join(
        struct.pack("<HHIHH", t, 3, 1, v, 0) for t, v in ((258, 8), (262, 1), (277, 1)))
    motorola = struct.pack(">2sHI", b"MM", 42, 8) + struct.pack(">H", 1) + struct.pack(">HHII", 277, 4, 1, 3)
    big = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + struct.pack("<Q", 1) + struct.pack("<HHQQ", 277, 3, 1, 2)
    df = frame(spark, [(1, gray), (2, motorola), (3, big), (4, b"no"), (5, None)], "id long, content binary")
    tags = {r.id: (r.samples_per_pixel, r.bits_per_sample, r.photometric) for r in T.tiff_tile_tags(df).collect()}
    assert tags == {1: (1, [8], 1), 2: (3, None, None), 3: (2, None, None), 4: (None, None, None), 5: (None, None, None)}
    bands = T.tiff_band_schema(T.tiff_tile_tags(df.filter("id = 1")), ["id"]).collect()
    assert [tuple(b) for b in bands] == [(1, 1, "integer", 8, True, None)]
