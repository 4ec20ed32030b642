"""Digest, path and pruned-diff queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import duck
from checks.inputs import ORDER_VALUES, given, oracle
from checks.q_diff import ORACLES as DIFF_ORACLES, evolved, flat
from rowtrail.functions import address as P
from rowtrail.operators import address as A
from rowtrail.plans import cut, scratch

KEY = ["o_orderkey"]
DIGEST_COLUMNS = ["o_orderkey", *sorted(ORDER_VALUES)]


def wide(spark, sf):
    return given(spark, sf, "wide_keys")


def _path(expr):
    return lambda s, sf: wide(s, sf).select("o_orderkey", "k", expr(wide(s, sf)).alias("path"))


def digests(spark, sf, name):
    return A.dir_digests(A.with_address(given(spark, sf, name), KEY))


def h9(spark, sf):
    old, new = (A.with_address(given(spark, sf, n), KEY) for n in ("orders", "ours"))
    leaves = cut(A.changed_leaves(A.dir_digests(old), A.dir_digests(new), levels=4))
    return flat(A.diff_rows_pruned(old, new, KEY, leaves), KEY)


def h9_stored(spark, sf):
    folder = scratch(spark, "snapshots")
    for name in ("orders", "ours"):
        A.write_snapshot(given(spark, sf, name), KEY, f"{folder}/{name}")
    return flat(A.diff_snapshots(spark, f"{folder}/orders", f"{folder}/ours", KEY), KEY)


def h9_evolved(spark, sf):
    folder = scratch(spark, "snapshots")
    A.write_snapshot(given(spark, sf, "orders"), KEY, f"{folder}/old")
    A.write_snapshot(evolved(spark, sf), KEY, f"{folder}/new")
    return flat(A.diff_snapshots(spark, f"{folder}/old", f"{folder}/new", KEY), KEY)


def h10(spark, sf):
    parts = []
    for name in ("orders", "ours", "theirs"):
        rows = given(spark, sf, name)
        parts.append(rows.select(P.row_digest(rows, DIGEST_COLUMNS).alias("digest")))
    return A.blob_dedup(parts[0].union(parts[1]).union(parts[2]))


def _legends(spark, sf):
    """Layouts of one to forty columns, one for every part."""
    ids = F.transform(
        F.sequence(F.lit(0), F.col("p_size") % 40),
        lambda i: F.concat(
            F.lpad(F.lower(F.hex(F.col("p_partkey"))), 8, "0"), F.lit("-0000-4000-8000-"),
            F.lpad(F.lower(F.hex(i.cast("bigint"))), 12, "0"),
        ),
    )
    return given(spark, sf, "part").select("p_partkey", ids.alias("column_ids"))


def h4_text(spark, sf):
    rows = given(spark, sf, "documents")
    return rows.select("doc_id", F.md5(P.pk_filename(rows, ["text", "doc_id"])).alias("name_md5"),
                       P.pk_filename(rows, ["lang", "source", "doc_id"]).alias("name"))


def h12(spark, sf, extensions):
    tiles = given(spark, sf, "tiles")
    return tiles.select("doc_id", P.tile_shard_path(F.col("name"), extensions).alias("path"))


QUERIES = {
    "h1_row_digest": lambda s, sf: given(s, sf, "nulls_a").select(
        "o_orderkey", P.row_digest(given(s, sf, "nulls_a"), ORDER_VALUES).alias("digest")
    ),
    "h2_feature_path": _path(lambda df: P.int_directory(F.col("k"))),
    "h2_feature_path_deep": _path(lambda df: P.int_directory(F.col("k"), 8)),
    "h3_feature_path_hex": _path(lambda df: P.int_directory_hex(F.col("k"))),
    "h4_pk_filename": _path(lambda df: P.pk_filename(df, ["k"])),
    "h4_pk_filename_text": h4_text,
    "h5_hash_path_base64": _path(lambda df: P.hash_directory(df, ["k"])),
    "h5_hash_path_hex_256": _path(lambda df: P.hash_directory(df, ["k"], 2, "hex", 256)),
    "h5_hash_path_hex_16": _path(lambda df: P.hash_directory(df, ["k"], 3, "hex", 16)),
    "h6_full_feature_path": _path(lambda df: P.full_feature_path(df, ["k"])),
    "h7_dir_digests": lambda s, sf: digests(s, sf, "ours"),
    "h8_changed_dirs": lambda s, sf: A.changed_dirs(digests(s, sf, "orders"), digests(s, sf, "ours")),
    "h9_diff_rows_pruned": h9,
    "h9_diff_snapshots": h9_stored,
    "h9_diff_snapshots_evolved": h9_evolved,
    "h10_blob_dedup": h10,
    "h11_legend_hash": lambda s, sf: _legends(s, sf).select("p_partkey", P.legend_hash(F.col("column_ids")).alias("hash")),
    "h12_tile_shard_path_point_cloud": lambda s, sf: h12(s, sf, P.POINT_CLOUD_EXTENSIONS),
    "h12_tile_shard_path_raster": lambda s, sf: h12(s, sf, P.RASTER_EXTENSIONS),
}


def _wide(path: str) -> str:
    return oracle(f"SELECT o_orderkey, k, {path} AS path FROM {{wide_keys}}")


_SHA = f"sha256(unhex('91' || {duck.packed_int('k')}))"


def _cut(text: str, starts: list[int], n: int) -> str:
    return " || '/' || ".join(f"substr({text}, {i}, {n})" for i in starts)


def _dirs(name: str) -> str:
    """Digests of all directories of a table, level by level."""
    dir_ = f"({duck.int_dir('o_orderkey')})"
    chunks = ", ".join(f"('0x' || substr(digest, {1 + 15 * i}, 15))::BIGINT AS x{i}" for i in range(4))
    levels = " UNION ALL ".join(
        f"SELECT {n} AS level, {dir_cut} AS dir, x0, x1, x2, x3 FROM r"
        for n, dir_cut in enumerate(["''", "substr(dir, 1, 1)", "substr(dir, 1, 3)", "substr(dir, 1, 5)", "dir"])
    )
    xors = ", ".join(f"bit_xor(x{i})" for i in range(4))
    return (
        f"SELECT level, dir, count(*) AS n, sha256(concat_ws(':', count(*), {xors})) AS digest FROM"
        f" (WITH d AS (SELECT {dir_} AS dir, {duck.digest(DIGEST_COLUMNS)} AS digest FROM {{{name}}}),"
        f" r AS (SELECT dir, {chunks} FROM d) {levels}) GROUP BY 1, 2"
    )


_BARE = {
    "point_cloud": "CASE WHEN name LIKE '%.copc.laz' THEN left(name, -9) WHEN name LIKE '%.laz' OR name LIKE '%.las'"
                   " THEN left(name, -4) ELSE name END",
    "raster": "CASE WHEN name LIKE '%.tiff' THEN left(name, -5) WHEN name LIKE '%.tif' THEN left(name, -4) ELSE name END",
}


def _tile(kind: str) -> str:
    return oracle(
        f"SELECT doc_id, substr(sha256(b), 1, 2) || '/' || b AS path FROM (SELECT doc_id, {_BARE[kind]} AS b FROM {{tiles}})"
    )


_UUIDS = (
    "list_transform(range(0, p_size % 40 + 1), lambda i: lpad(lower(hex(p_partkey)), 8, '0') || '-0000-4000-8000-'"
    " || lpad(lower(hex(i)), 12, '0'))"
)
_VERSIONS = " UNION ALL ".join(f"SELECT {duck.digest(DIGEST_COLUMNS)} AS digest FROM {{{n}}}" for n in ("orders", "ours", "theirs"))

ORACLES = {
    "h1_row_digest": oracle(f"SELECT o_orderkey, {duck.digest(ORDER_VALUES)} AS digest FROM {{nulls_a}}"),
    "h2_feature_path": _wide(duck.int_dir("k")),
    "h2_feature_path_deep": _wide(duck.int_dir("k", 8)),
    "h3_feature_path_hex": _wide(_cut("right(repeat('0', 10) || lower(hex(k)), 5)", [1, 2, 3, 4], 1)),
    "h4_pk_filename": _wide(duck.filename([duck.packed_int("k")])),
    "h4_pk_filename_text": oracle(
        f"SELECT doc_id, md5({duck.filename([duck.packed_text('text'), duck.packed_int('doc_id')])}) AS name_md5,"
        f" {duck.filename([duck.packed_text('lang'), duck.packed_text('source'), duck.packed_int('doc_id')])} AS name"
        " FROM {documents}"
    ),
    "h5_hash_path_base64": _wide(_cut(duck.urlsafe(f"unhex(substr({_SHA}, 1, 6))"), [1, 2, 3, 4], 1)),
    "h5_hash_path_hex_256": _wide(_cut(_SHA, [1, 3], 2)),
    "h5_hash_path_hex_16": _wide(_cut(_SHA, [1, 2, 3], 1)),
    "h6_full_feature_path": _wide(duck.full_path("k")),
    "h7_dir_digests": oracle(_dirs("ours")),
    "h8_changed_dirs": oracle(
        f"WITH a AS ({_dirs('orders')}), b AS ({_dirs('ours')}) SELECT coalesce(a.level, b.level) AS level,"
        " coalesce(a.dir, b.dir) AS dir, CASE WHEN a.dir IS NULL THEN 'A' WHEN b.dir IS NULL THEN 'D' ELSE 'M' END AS"
        " status FROM a FULL JOIN b ON a.level = b.level AND a.dir = b.dir WHERE a.digest IS DISTINCT FROM b.digest"
    ),
    "h9_diff_rows_pruned": DIFF_ORACLES["d1_diff_rows"],
    "h9_diff_snapshots": DIFF_ORACLES["d1_diff_rows"],
    "h9_diff_snapshots_evolved": DIFF_ORACLES["d1_diff_rows_evolved"],
    "h10_blob_dedup": oracle(
        "SELECT count(*) AS total_rows, count(DISTINCT digest) AS distinct_blobs, count(*) - count(DISTINCT digest)"
        f" AS shared_rows FROM ({_VERSIONS})"
    ),
    "h11_legend_hash": oracle(
        "SELECT p_partkey, sha256(unhex(CASE WHEN len(ids) < 16 THEN hex(144 + len(ids)) ELSE 'DC00' || hex(len(ids)) END"
        " || array_to_string(list_transform(ids, lambda i: 'D924' || hex(i)), ''))) AS hash"
        f" FROM (SELECT p_partkey, {_UUIDS} AS ids FROM {{part}})"
    ),
    "h12_tile_shard_path_point_cloud": _tile("point_cloud"),
    "h12_tile_shard_path_raster": _tile("raster"),
}
