"""Directory digests and the diff that skips unchanged directories."""

from __future__ import annotations

import json
import re
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowtrail.functions.address import digest_chunks, feature_directory, row_digest
from rowtrail.operators.diff import diff_rows
from rowtrail.plans import cut, join_small

CHUNKS = ["x0", "x1", "x2", "x3"]


def with_address(df: DataFrame, keys: list[str], **layout) -> DataFrame:
    """Adds ``dir`` (leaf directory) and ``digest`` (of key and values) to every row.

    A table with columns of these names is refused, as they would be overwritten.
    """
    if clash := {"dir", "digest"} & set(df.columns):
        raise ValueError(f"rename {', '.join(sorted(clash))} first")
    names = keys + sorted(c for c in df.columns if c not in keys)
    return df.withColumns({"dir": feature_directory(df, keys, **layout), "digest": row_digest(df, names)})


def _xors() -> list:
    return [F.bit_xor(x).alias(x) for x in CHUNKS]


def leaf_sums(addressed: DataFrame) -> DataFrame:
    """(dir, n, x0 … x3): rows per leaf directory and the XOR of their digests."""
    rows = addressed.select("dir", *[c.alias(x) for c, x in zip(digest_chunks(F.col("digest")), CHUNKS)])
    return rows.groupBy("dir").agg(F.count(F.lit(1)).alias("n"), *_xors())


def dir_digests(addressed: DataFrame) -> DataFrame:
    """(level, dir, n, digest) of every directory from the leaves up to the root (level 0, '').

    A directory's digest covers the number of rows below it and the XOR of their digests, which
    contain their keys. Both combine before the shuffle and need no list of rows, so neither a hot
    directory nor the root gathers data in one task.
    """
    parts = F.split("dir", "/")
    levels = F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda i: F.struct(i.alias("level"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir")),
    )
    spread = leaf_sums(addressed).withColumn("_level", F.explode(levels)).select("_level.*", "n", *CHUNKS)
    total = spread.groupBy("level", "dir").agg(F.sum("n").alias("n"), *_xors())
    return total.select("level", "dir", "n", F.sha2(F.concat_ws(":", "n", *CHUNKS), 256).alias("digest"))


def changed_dirs(digests_a: DataFrame, digests_b: DataFrame) -> DataFrame:
    """(level, dir, status A/M/D) of directories whose digests differ."""
    a = digests_a.select("level", "dir", F.col("digest").alias("_a"))
    b = digests_b.select("level", "dir", F.col("digest").alias("_b"))
    status = F.when(F.col("_a").isNull(), "A").when(F.col("_b").isNull(), "D").otherwise("M")
    joined = a.join(b, ["level", "dir"], "full").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    return joined.select("level", "dir", status.alias("status"))


def changed_leaves(digests_a: DataFrame, digests_b: DataFrame, levels: int | None = None) -> DataFrame:
    """Leaf directories that differ. Without ``levels`` the deepest level present is looked up."""
    if levels is None:
        levels = digests_a.unionByName(digests_b).agg(F.max("level")).first()[0] or 0
    leaf = F.col("level") == levels
    return changed_dirs(digests_a.filter(leaf), digests_b.filter(leaf)).select("dir")


def diff_rows_pruned(
    old: DataFrame, new: DataFrame, keys: list[str], leaves: DataFrame, keys_not_null: bool = False
) -> DataFrame:
    """:func:`diff_rows` of addressed tables, restricted to rows in changed leaf directories.

    Digests do not cover names, so tables of different columns or types are compared as a whole. The
    leaves are used once per side: hand in a written table.
    """
    types = [{f.name: f.dataType for f in df.schema if f.name not in ("dir", "digest")} for df in (old, new)]
    sides = [old, new]
    if types[0] == types[1]:
        sides = [join_small(df, leaves, ["dir"], "left_semi") for df in sides]
    return diff_rows(*[side.drop("dir", "digest") for side in sides], keys, keys_not_null)


def blob_dedup(digests: DataFrame) -> DataFrame:
    """One row: stored ``total_rows``, ``distinct_blobs`` and the ``shared_rows`` between versions."""
    per_blob = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    total, distinct = F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))
    return per_blob.agg(
        total.alias("total_rows"), distinct.alias("distinct_blobs"), (total - distinct).alias("shared_rows")
    )


# ---------------------------------------------------------------------------------------------
# Stored snapshots. Rows lie in the order of their directories, with small Parquet pages and their
# digests beside them. Directories of all levels lie next to them as a hash tree: the digest of a
# directory sums those of the rows below it, and the root's is in the manifest. A diff compares the
# roots, then goes down the levels, where each level's scan reads only the children of directories
# that differ, and at last reads only the files, and in them the pages, that hold a leaf that differs.
# ---------------------------------------------------------------------------------------------

PAGE_ROWS = 4096
# A level of up to this many directories is compared as a whole, without a shuffle.
SMALL_LEVEL = 5000
# Changed directories up to this many are listed on the driver, and up to this many names go into
# a scan's filter.
MAX_LISTED_DIRS = 100_000
MAX_SCAN_NAMES = 1000
# Up to so many changed rows out of so few files are compared in one task, without a shuffle.
FEW_ROWS, FEW_FILES = 100_000, 16

TREE = ["n", "x0", "x1"]
MANIFEST_COLUMNS = (
    "folder string, keys array<string>, columns array<string>, dir string, levels int, schema string,"
    " counts array<bigint>, n bigint, x0 bigint, x1 bigint"
)


def _ancestor(name: str, depth: int):
    return F.substring_index(name, "/", depth)


def row_hashes(df: DataFrame, columns: list[str]) -> list:
    """Two 64-bit hashes over ``columns``. Hashing skips NULLs, so where they stand is hashed too."""
    plain = [F.to_json(c) if isinstance(df.schema[c].dataType, T.MapType) else F.col(c) for c in columns]
    nulls = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns])
    return [F.xxhash64(F.lit(seed), nulls, *plain) for seed in (1, 2)]


def write_snapshot(df: DataFrame, keys: list[str], path: str, levels: int = 4, **layout) -> None:
    """Store ``df`` under ``path``: ``rows`` ordered by directory, and the tree of directory digests.

    Keys must not be NULL. Directories and digests are stored under names that no column of ``df``
    starts with. Rows and tree go to a new folder, which the manifest, written last, makes the current
    one. The rows are cut into files by directory and key, so a directory too large for one task is
    split. Digests are made in the pass that writes the rows; the tree only reads them back, not the
    values, and sums leaves before it sums the levels above.
    """
    spark, folder, at = df.sparkSession, uuid.uuid4().hex, "_dir"
    while any(c.startswith(at) for c in df.columns):
        at = f"_{at}"
    names = keys + sorted(c for c in df.columns if c not in keys)
    x0, x1 = row_hashes(df, names)
    rows = df.withColumns({at: feature_directory(df, keys, levels=levels, **layout), f"{at}_x0": x0, f"{at}_x1": x1})
    rows = rows.withColumns({f"{at}_{i}": _ancestor(at, i) for i in range(1, levels)})
    ordered = rows.repartitionByRange(at, *keys).sortWithinPartitions(at, *keys)
    pages = {"parquet.page.row.count.limit": str(PAGE_ROWS)}
    ordered.write.options(**pages).parquet(f"{path}/{folder}/rows")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/{folder}/rows")
    sums = [F.sum("n").alias("n"), F.bit_xor("x0").alias("x0"), F.bit_xor("x1").alias("x1")]
    file = F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")
    leaves = stored.select(F.col(at).alias("dir"), file, F.lit(1).cast("long").alias("n"), F.col(f"{at}_x0").alias("x0"), F.col(f"{at}_x1").alias("x1"))
    leaves = cut(leaves.groupBy("dir", "file").agg(*sums))
    first = lambda i: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), i), "/")
    ups = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda i: F.struct(i.alias("level"), first(i).alias("node")))
    tree = leaves.select(F.explode(ups).alias("up"), "file", *TREE).select("up.*", "file", *TREE)
    files = F.collect_set(F.when(F.col("level") == levels, F.col("file"))).alias("files")
    tree = tree.groupBy("level", "node").agg(*sums, files).withColumnRenamed("node", "dir")
    tree = cut(tree.withColumn("parent", first(F.greatest(F.col("level") - 1, F.lit(0)))))
    tree.repartitionByRange("level", "dir").sortWithinPartitions("level", "dir").write.options(**pages).partitionBy("level").parquet(f"{path}/{folder}/tree")
    # One row per level.
    counts = {r["level"]: r for r in tree.groupBy("level").agg(F.count(F.lit(1)).alias("dirs"), *sums).collect()}
    root = counts.get(0)
    totals = [root[c] if root else 0 for c in TREE]
    sizes = [counts[i]["dirs"] if i in counts else 0 for i in range(levels + 1)]
    manifest = spark.createDataFrame([(folder, keys, df.columns, at, levels, rows.schema.json(), sizes, *totals)], MANIFEST_COLUMNS)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def _manifests(spark: SparkSession, *paths: str) -> list:
    """The manifests of some snapshots, in one small job."""
    folders = [f"{path.rstrip('/')}/manifest" for path in dict.fromkeys(paths)]
    if len(folders) == 1:
        return [spark.read.schema(MANIFEST_COLUMNS).json(folders).first()] * len(paths)
    rows = spark.read.schema(MANIFEST_COLUMNS).json(folders).select("*", F.input_file_name().alias("file")).collect()
    bare = lambda path: re.sub("^[a-z][a-z0-9+.-]*:/*", "/", path)
    of = {f: [r for r in rows if bare(unquote(r["file"])).rpartition("/")[0].endswith(bare(f))] for f in folders}
    # A folder that ends like another one is read by itself.
    single = {f: own[0] if len(own) == 1 else spark.read.schema(MANIFEST_COLUMNS).json(f).first() for f, own in of.items()}
    return [single[f"{path.rstrip('/')}/manifest"] for path in paths]


def _stored(spark: SparkSession, path: str, m, files: list[str] | None = None) -> DataFrame:
    """The stored rows of a snapshot, of all files or of some."""
    schema, folder = T.StructType.fromJson(json.loads(m["schema"])), f"{path}/{m['folder']}/rows"
    if files is not None and not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*([folder] if files is None else [f"{folder}/{f}" for f in files]))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a stored snapshot, as they were handed in."""
    m = _manifests(spark, path)[0]
    return _stored(spark, path, m).select(*m["columns"])


def _level(spark: SparkSession, path: str, m, level: int) -> DataFrame:
    schema = "dir string, parent string, " + ", ".join(f"{c} bigint" for c in TREE) + ", files array<string>"
    if not m["counts"][level]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{m['folder']}/tree/level={level}")


def _differing(a: DataFrame, b: DataFrame, small: bool) -> DataFrame:
    """(dir, rows, files_a, files_b) whose digests differ, of two levels. Equal digests cancel out in one sum over both.

    Levels of at most ``SMALL_LEVEL`` directories each are summed by one task, without a shuffle.
    """
    both = a.select("dir", *TREE, "files", F.lit(1).alias("sign")).unionByName(b.select("dir", *TREE, "files", F.lit(-1).alias("sign")))
    files = lambda sign: F.flatten(F.collect_list(F.when(F.col("sign") == sign, F.col("files"))))
    summed = (both.coalesce(1) if small else both).groupBy("dir").agg(
        F.sum(F.col("sign") * F.col("n")).alias("more"), F.bit_xor("x0").alias("x0"), F.bit_xor("x1").alias("x1"), F.sum("n").alias("rows"),
        files(1).alias("files_a"), files(-1).alias("files_b"),
    )
    return summed.filter("more != 0 OR x0 != 0 OR x1 != 0").select("dir", "rows", "files_a", "files_b")


def changed_leaves_stored(spark: SparkSession, path_a: str, path_b: str, manifests=None) -> list[tuple] | DataFrame:
    """(dir, rows, files_a, files_b) of the leaf directories in which two snapshots of one layout differ.

    Goes down from the lowest level that is small as a whole. Below it, a level is read only where its
    parents differ. A list while it stays within ``MAX_LISTED_DIRS``, else a written table.
    """
    a, b = manifests or _manifests(spark, path_a, path_b)
    if all(a[c] == b[c] for c in TREE):
        return []
    levels = a["levels"]
    size = [max(x, y) for x, y in zip(a["counts"], b["counts"], strict=True)]
    level = max(i for i in range(levels + 1) if i == 0 or size[i] <= SMALL_LEVEL)
    found: list[tuple] | DataFrame | None = None
    while True:
        sides = [_level(spark, path, m, level) for path, m in ((path_a, a), (path_b, b))]
        if size[level] <= SMALL_LEVEL:
            found = [tuple(r) for r in _differing(*sides, True).collect()]
        else:
            if isinstance(found, list) and len(found) <= MAX_SCAN_NAMES:  # the first level is read whole
                sides = [side.filter(F.col("parent").isin([f[0] for f in found])) for side in sides]
            elif found is not None:
                parents = found if isinstance(found, DataFrame) else spark.createDataFrame([(f[0],) for f in found], "dir string")
                sides = [join_small(side, parents.select(F.col("dir").alias("parent")), ["parent"], "left_semi") for side in sides]
            differing = cut(_differing(*sides, False))
            listed = differing.limit(MAX_LISTED_DIRS + 1).collect()
            found = [tuple(r) for r in listed] if len(listed) <= MAX_LISTED_DIRS else differing
        if level == levels:
            return found
        level += 1


def _scan_filter(dirs: list[str], levels: int, at: str):
    """Filter on the deepest directory level whose changed names are few enough, and that level."""
    for depth in range(levels, 0, -1):
        names = {"/".join(d.split("/")[:depth]) for d in dirs}
        if len(names) <= MAX_SCAN_NAMES:
            return F.col(at if depth == levels else f"{at}_{depth}").isin(sorted(names)), depth
    return F.lit(True), 0


def diff_snapshots(
    spark: SparkSession, path_a: str, path_b: str, keys: list[str], names: list[str] | None = None
) -> DataFrame:
    """Delta between two stored snapshots, reading what changed; equal to :func:`diff_rows` of them.

    While the changed directories stay within ``MAX_LISTED_DIRS``, the scans are filtered by the
    directories themselves or by the lowest level of directories above them that is short enough, and
    only files that hold one are opened. Beyond that a join restricts both sides to the changed
    directories. Snapshots whose columns, types or layouts differ are compared as a whole, because
    their digests say nothing.
    """
    a, b = _manifests(spark, path_a, path_b)
    keep = [[c for c in m["columns"] if names is None or c in names or c in keys] for m in (a, b)]
    stored = ((path_a, a), (path_b, b))
    types = [{f["name"]: f["type"] for f in json.loads(m["schema"])["fields"] if f["name"] in m["columns"]} for m in (a, b)]
    if types[0] != types[1] or any(a[k] != b[k] for k in ("keys", "dir", "levels")):
        return diff_rows(*[_stored(spark, *x).select(*k) for x, k in zip(stored, keep)], keys, keys_not_null=True)
    at, levels = b["dir"], b["levels"]
    found = changed_leaves_stored(spark, path_a, path_b, (a, b))
    if isinstance(found, DataFrame):
        leaves = found.select(F.col("dir").alias(at))
        sides = [join_small(_stored(spark, *x), leaves, [at], "left_semi") for x in stored]
    else:
        listed = [f[0] for f in found]
        files = [sorted({x for f in found for x in f[k]}) for k in (2, 3)]
        condition, depth = _scan_filter(listed, levels, at)
        sides = [_stored(spark, *x, own).filter(condition) for x, own in zip(stored, files)]
        if depth < levels:
            leaves = F.broadcast(spark.createDataFrame([(d,) for d in listed], f"{at} string"))
            sides = [side.join(leaves, at, "left_semi") for side in sides]
        if sum(f[1] for f in found) <= FEW_ROWS and max(map(len, files)) <= FEW_FILES:
            sides = [side.coalesce(1) for side in sides]
    return diff_rows(*[side.select(*k) for side, k in zip(sides, keep)], keys, keys_not_null=True)
