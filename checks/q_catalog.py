"""Catalogue, file, tile and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from checks import duck
from checks.inputs import given, oracle
from rowtrail.functions import text as S
from rowtrail.functions.address import POINT_CLOUD_EXTENSIONS, row_digest
from rowtrail.operators import catalog as C
from rowtrail.operators import tiles as T


def discovered(spark, sf):
    return C.discover_datasets(given(spark, sf, "paths"))


def l3(spark, sf):
    parts = given(spark, sf, "part")
    dataset = F.concat(F.lit("shop/d"), F.floor(F.col("p_partkey") / 8).cast("string"))
    counts = parts.groupBy(dataset.alias("dataset")).agg(F.sum("p_size").alias("features")).filter("features % 10 <> 0")
    docs = given(spark, sf, "documents")
    name = F.when(F.col("doc_id") % 3 == 0, "metadata.xml").when(F.col("doc_id") % 3 == 1, "license").otherwise("license.xml")
    attached = docs.select(F.concat(F.lit("shop/d"), F.floor(F.col("doc_id") / 2).cast("string")).alias("dataset"),
                           name.alias("name"))
    return C.dataset_info(given(spark, sf, "catalogue"), counts, attached)


def files(spark, sf):
    return given(spark, sf, "files")


def new_files(spark, sf):
    return given(spark, sf, "new_files")


def attached(spark, sf):
    """Accepted uploads; the last of equal names by content stands for the file."""
    rows = C.attachments_set(given(spark, sf, "owners"), given(spark, sf, "uploads"))
    kept = rows.filter("accepted").groupBy("dataset", "kind", "name")
    return kept.agg(F.max("content").alias("content"))


def short(df: DataFrame) -> DataFrame:
    """Content as its MD5, to keep results small."""
    return df.withColumn("content", F.md5("content"))


def tiles(spark, sf):
    return given(spark, sf, "tiles")


def _hex(col, width: int):
    """Little-endian hex of a number below 65536."""
    low = F.lpad(F.hex(F.col(col) % 256 if isinstance(col, str) else col % 256), 2, "0")
    value = F.col(col) if isinstance(col, str) else col
    high = F.lpad(F.hex(F.floor(value / 256)), 2, "0")
    return F.rpad(F.concat(low, high), width * 2, "0")


def las_bytes(spark, sf):
    """LAS headers out of the tile table; every seventeenth file is no LAS."""
    magic = F.when(F.col("doc_id") % 17 == 0, "4C415347").otherwise("4C415346")
    mark = F.col("point_format") + F.when(F.col("compression") == "laz", 128).otherwise(0)
    text = F.concat(
        magic, F.lit("00" * 20), F.lit("01"), F.lpad(F.hex("minor"), 2, "0"), F.lit("00" * 78),
        F.lpad(F.hex(mark), 2, "0"), _hex("record_length", 2), F.lit("00" * 120),
    )
    return tiles(spark, sf).select("dataset", "name", "doc_id", "length", F.unhex(text).alias("content"))


def headers(spark, sf):
    return T.las_tile_headers(las_bytes(spark, sf))


def tags(spark, sf):
    """Image tags out of the part table, some missing."""
    p = F.col("p_partkey")
    n = (p % 4 + 1).cast("int")
    bits = F.element_at(F.array(*map(F.lit, (8, 16, 32))), (p % 3 + 1).cast("int"))
    rows = given(spark, sf, "part").select(
        "p_partkey",
        F.when(p % 7 != 0, n).alias("samples_per_pixel"),
        F.when(p % 5 != 0, F.array_repeat(bits, n)).alias("bits_per_sample"),
        F.when(p % 6 != 0, F.array_repeat((p % 4 + 1).cast("int"), n)).alias("sample_format"),
        F.when(p % 8 != 0, (p % 5).cast("int")).alias("photometric"),
    )
    return rows


def raster_info(spark, sf):
    """Image files of 23 datasets, read from their bytes."""
    name = F.lpad(F.col("p_partkey").cast("string"), 12, "0")
    keyed = T.tiff_tile_tags(tiff_bytes(spark, sf)).withColumns(
        {"dataset": F.concat(F.lit("r"), (F.col("p_partkey") % 23).cast("string")), "name": name}
    )
    out = T.raster_dataset_info(T.tiff_band_schema(keyed, ["dataset", "name"]))
    return out.withColumn("schema", F.array_join("schema", "; "))


def tiff_bytes(spark, sf):
    """TIFF files with those tags; a missing tag carries a private number instead."""
    p = F.col("p_partkey")
    n = p % 4 + 1
    bits = F.element_at(F.array(*map(F.lit, (8, 16, 32))), (p % 3 + 1).cast("int"))
    bit_data = F.repeat(_hex(bits, 2), n.cast("int"))
    form_data = F.repeat(_hex(p % 4 + 1, 2), n.cast("int"))

    def entry(number, missing, count, value):
        tag = F.when(missing, 65000).otherwise(number)
        return F.concat(_hex(tag, 2), F.lit("0300"), _hex(count, 4), value)

    text = F.concat(
        F.lit("49492A00080000000400"),
        entry(258, p % 5 == 0, n, F.when(n <= 2, F.rpad(bit_data, 8, "0")).otherwise(_hex(F.lit(62), 4))),
        entry(262, p % 8 == 0, F.lit(1), _hex(p % 5, 4)),
        entry(277, p % 7 == 0, F.lit(1), _hex(n, 4)),
        entry(339, p % 6 == 0, n, F.when(n <= 2, F.rpad(form_data, 8, "0")).otherwise(_hex(62 + 2 * n, 4))),
        F.lit("00000000"), bit_data, form_data,
    )
    return given(spark, sf, "part").select("p_partkey", F.unhex(text).alias("content"))


def l11_bytes(spark, sf):
    return T.tiff_band_schema(T.tiff_tile_tags(tiff_bytes(spark, sf)), ["p_partkey"])


def s1(spark, sf, fn):
    rows = given(spark, sf, "values_mixed")
    return rows.select("doc_id", *[
        fn(F.col(f.name), f.dataType).alias(f"{f.name}_text") for f in rows.schema if f.name != "doc_id"
    ])


def s2(spark, sf):
    rows = given(spark, sf, "values_mixed")
    return rows.select("doc_id", S.format_pk(rows, ["doc_id", "lang", "even"]).alias("pk"))


def s5(spark, sf):
    e = F.col("event_id")
    kinds = [F.col("user_id"), F.col("event_type"), F.col("value"), e % 2 == 0, F.encode("event_type", "UTF-8")]
    value = F.lit(None).cast("variant")
    for n, kind in enumerate(kinds):
        value = F.when(e % 6 == n, kind.cast("variant")).otherwise(value)
    rows = given(spark, sf, "events").select("event_id", value.alias("v"))
    v = F.col("v")
    return rows.select(
        "event_id", S.typed(v, "i64").alias("i64"), S.typed(v, "str").alias("str"), S.typed(v, "f64").alias("f64"),
        S.typed(v, "bool").alias("bool"), F.hex(S.typed(v, "bytes")).alias("bytes"), S.is_null_value(v).alias("is_null"),
    )


def s4(spark, sf):
    """Sizes from bytes to terabytes, with exact halves among them."""
    rows = given(spark, sf, "files").select(
        "dataset", "name", F.explode(F.array(
            F.col("length"), F.col("length") * 64, F.col("length") * 100_000, F.col("length") * 51_000_000,
        )).alias("bytes"))
    return rows.select("dataset", "name", "bytes", S.format_file_size(F.col("bytes")).alias("size"))


def s678(spark, sf):
    rows = given(spark, sf, "orders")
    return rows.select(
        "o_orderkey", S.short_hash(row_digest(rows, ["o_orderkey", "o_custkey"])).alias("short"),
        S.table_name(F.concat(F.lit("shop/"), "o_orderpriority", F.lit("/x"))).alias("table_name"),
        S.date_text(F.col("o_orderdate")).alias("day"),
    )


QUERIES = {
    "l1_discover_datasets": discovered,
    "l2_list_datasets": lambda s, sf: C.list_datasets(discovered(s, sf)),
    "l2_count_datasets": lambda s, sf: C.count_datasets(discovered(s, sf)),
    "l3_dataset_info": l3,
    "l4_count_files": lambda s, sf: C.count_files(files(s, sf)),
    "l5_file_inventory": lambda s, sf: C.file_inventory(files(s, sf)),
    "l6_add_files": lambda s, sf: C.add_files(files(s, sf), new_files(s, sf)),
    "l6_rm_files": lambda s, sf: C.rm_files(files(s, sf), new_files(s, sf))[0],
    "l6_rm_files_report": lambda s, sf: C.rm_files(files(s, sf), new_files(s, sf))[1],
    "l7_attachments_set": lambda s, sf: short(
        C.attachments_set(given(s, sf, "owners"), given(s, sf, "uploads"))
    ),
    "l7_attachments_show": lambda s, sf: short(C.attachments_show(attached(s, sf))),
    "l7_metadata_show": lambda s, sf: short(C.metadata_show(attached(s, sf))),
    "l8_tile_inventory": lambda s, sf: T.tile_inventory(tiles(s, sf), POINT_CLOUD_EXTENSIONS),
    "l8_count_tiles": lambda s, sf: T.count_tiles(tiles(s, sf)),
    "l9_las_tile_headers": headers,
    "l10_las_schema": lambda s, sf: T.las_schema(tiles(s, sf), ["doc_id"]),
    "l11_tiff_band_schema": lambda s, sf: T.tiff_band_schema(tags(s, sf), ["p_partkey"]),
    "l11_tiff_band_schema_bytes": l11_bytes,
    "l12_raster_info": raster_info,
    "l12_tile_dataset_info": lambda s, sf: T.tile_dataset_info(headers(s, sf)),
    "s1_format_value": lambda s, sf: s1(s, sf, S.format_value),
    "s2_format_pk": s2,
    "s3_display_value": lambda s, sf: s1(s, sf, S.display_value).withColumn("text_text", F.md5("text_text")),
    "s4_format_file_size": s4,
    "s5_typed_access": s5,
    "s6_s7_s8_names_and_dates": s678,
}

_MARKS = "['.table-dataset', '.file-dataset', '.point-cloud-dataset.v1', '.raster-dataset.v1']"
_FOUND = (
    "p AS (SELECT string_split(path, '/') AS p FROM {paths}), f AS (SELECT p[1:len(p) - 1] AS f FROM p),"
    f" m AS (SELECT f, list_filter(range(1, len(f) + 1), lambda i: list_contains({_MARKS}, f[i]))[1] AS spot FROM f),"
    " n AS (SELECT f[1:spot - 1] AS above, f[spot] AS mark FROM m WHERE spot IS NOT NULL),"
    " found AS (SELECT DISTINCT array_to_string(above, '/') AS name, CASE mark WHEN '.table-dataset' THEN 'table'"
    " WHEN '.file-dataset' THEN 'file' WHEN '.raster-dataset.v1' THEN 'raster' ELSE 'point cloud' END AS kind FROM n"
    " WHERE len(list_filter(above, lambda p: starts_with(p, '.') OR p = 'target' OR p LIKE '%.gpkg')) = 0)"
)
_RANK = "list_position(['table', 'file', 'point cloud', 'raster'], kind)"


def _size(n: str) -> str:
    """Half-even rounding on whole numbers."""
    def scaled(unit: int, factor: int, places: int) -> str:
        q, r = f"({n}::HUGEINT * {factor} // {unit})", f"({n}::HUGEINT * {factor} % {unit})"
        t = f"({q} + CASE WHEN {r} * 2 > {unit} OR ({r} * 2 = {unit} AND {q} % 2 = 1) THEN 1 ELSE 0 END)"
        return f"({t} // {factor})::VARCHAR || '.' || lpad(({t} % {factor})::VARCHAR, {places}, '0')"

    return (
        f"CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} < 1048576 THEN {scaled(1 << 10, 10, 1)} || ' KB'"
        f" WHEN {n} < 1073741824 THEN {scaled(1 << 20, 10, 1)} || ' MB' ELSE {scaled(1 << 30, 100, 2)} || ' GB' END"
    )


_XML = "starts_with(ltrim(content, chr(32) || chr(9) || chr(10) || chr(13)), '<')"
_SET = (
    "o AS (SELECT name AS dataset, max(kind) AS kind FROM {owners} WHERE kind IN ('table', 'file') GROUP BY 1),"
    f" a AS (SELECT u.dataset, o.kind, CASE WHEN role = 'metadata' THEN 'metadata.xml' WHEN {_XML} THEN 'license.xml'"
    f" ELSE 'license' END AS name, content, o.kind IS NOT NULL AND (role <> 'metadata' OR o.kind = 'file' OR {_XML})"
    " AS accepted FROM {uploads} u LEFT JOIN o ON o.dataset = u.dataset)"
)
_IS_LAS = "doc_id % 17 <> 0"
_HEADERS = (
    f"h AS (SELECT dataset, name, doc_id, length, CASE WHEN {_IS_LAS} THEN compression END AS compression,"
    f" CASE WHEN {_IS_LAS} THEN '1.' || minor END AS las_version, CASE WHEN {_IS_LAS} THEN point_format END AS"
    f" point_format, CASE WHEN {_IS_LAS} THEN record_length END AS record_length FROM {{tiles}})"
)
_LAS_ROWS = ", ".join(
    f"({i}, '{name}', '{kind}', {bits}, {str(unsigned).lower()}, {list(formats)})"
    for i, (name, kind, bits, unsigned, formats) in enumerate(T.LAS_FIELDS)
)
_BITS = "CASE p_partkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END"
_BANDS = (
    "SELECT p_partkey, (i + 1)::INT AS band, CASE WHEN p_partkey % 6 <> 0 AND p_partkey % 4 = 2 AND i < n THEN 'float'"
    f" ELSE 'integer' END AS data_type, CASE WHEN p_partkey % 5 <> 0 AND i < n THEN {_BITS} ELSE 8 END AS size,"
    " NOT (p_partkey % 6 <> 0 AND p_partkey % 4 IN (1, 2) AND i < n) AS unsigned, CASE WHEN p_partkey % 8 = 0 THEN NULL"
    " WHEN p_partkey % 5 = 2 THEN ['red', 'green', 'blue', 'alpha'][i + 1] WHEN p_partkey % 5 = 3 THEN 'palette' END AS"
    " interpretation FROM (SELECT p_partkey, p_partkey % 4 + 1 AS n, unnest(range(0, CASE WHEN p_partkey % 7 <> 0 THEN"
    " p_partkey % 4 + 1 ELSE 1 END)) AS i FROM {part})"
)
_GEOMETRY = (
    "string_agg(name || ' (' || coalesce(geometry_type, 'GEOMETRY') || ') [' || coalesce(geometry_crs, 'unknown CRS')"
    " || ']', ', ' ORDER BY position) FILTER (data_type = 'geometry')"
)


def _texts(rows: list[tuple[str, str]]) -> str:
    return ", ".join(f"{duck.formatted(c, kind)} AS {c}_text" for c, kind in rows)


_E = "event_id % 6"

ORACLES = {
    "l1_discover_datasets": oracle(f"WITH {_FOUND} SELECT * FROM found"),
    "l2_list_datasets": oracle(
        f"WITH {_FOUND} SELECT name || ' (' || kind || ')' AS label, kind, name FROM found ORDER BY {_RANK}, name"
    ),
    "l2_count_datasets": oracle(
        f"WITH {_FOUND} SELECT kind, count(*) AS datasets FROM found GROUP BY kind UNION ALL"
        " SELECT NULL, count(*) FROM found"
    ),
    "l3_dataset_info": oracle(
        "WITH c AS (SELECT dataset, count(*) AS columns, coalesce(string_agg(name, ', ' ORDER BY primary_key_index,"
        " position) FILTER (primary_key_index IS NOT NULL), '') AS primary_key,"
        f" coalesce({_GEOMETRY}, '') AS geometry FROM {{catalogue}} GROUP BY 1),"
        " n AS (SELECT 'shop/d' || (p_partkey // 8) AS dataset, sum(p_size)::BIGINT AS features FROM {part} GROUP BY 1"
        " HAVING sum(p_size) % 10 <> 0), a AS (SELECT 'shop/d' || (doc_id // 2) AS dataset, bool_or(doc_id % 3 = 0) AS m,"
        " bool_or(doc_id % 3 <> 0) AS l FROM {documents} GROUP BY 1) SELECT c.*, coalesce(features, 0) AS features,"
        " coalesce(m, false) AS has_metadata, coalesce(l, false) AS has_license FROM c LEFT JOIN n USING (dataset)"
        " LEFT JOIN a USING (dataset)"
    ),
    "l4_count_files": oracle("SELECT dataset, count(*) AS files FROM {files} GROUP BY 1"),
    "l5_file_inventory": oracle(f"SELECT dataset, name, {_size('length')} AS size FROM {{files}}"),
    "l6_add_files": oracle(
        "SELECT * FROM {files} WHERE (dataset, name) NOT IN (SELECT (dataset, name) FROM {new_files})"
        " UNION ALL SELECT * FROM {new_files}"
    ),
    "l6_rm_files": oracle("SELECT * FROM {files} WHERE (dataset, name) NOT IN (SELECT (dataset, name) FROM {new_files})"),
    "l6_rm_files_report": oracle(
        "SELECT DISTINCT dataset, name, CASE WHEN (dataset, name) IN (SELECT (dataset, name) FROM {files}) THEN 'Removed'"
        " ELSE 'Not found' END AS outcome FROM {new_files}"
    ),
    "l7_attachments_set": oracle(f"WITH {_SET} SELECT dataset, kind, name, md5(content) AS content, accepted FROM a"),
    "l7_attachments_show": oracle(
        f"WITH {_SET}, k AS (SELECT dataset, kind, name, max(content) AS content FROM a WHERE accepted GROUP BY 1, 2, 3)"
        " SELECT dataset, kind, name, md5(content) AS content FROM (SELECT *, row_number() OVER (PARTITION BY dataset"
        " ORDER BY kind = 'file', name = 'license.xml') AS rn FROM k WHERE name <> 'metadata.xml') WHERE rn = 1"
    ),
    "l7_metadata_show": oracle(
        f"WITH {_SET}, k AS (SELECT dataset, kind, name, max(content) AS content FROM a WHERE accepted GROUP BY 1, 2, 3)"
        " SELECT dataset, kind, md5(content) AS content FROM (SELECT *, row_number() OVER (PARTITION BY dataset"
        " ORDER BY kind = 'file') AS rn FROM k WHERE name = 'metadata.xml') WHERE rn = 1"
    ),
    "l8_tile_inventory": oracle(
        "SELECT dataset, substr(sha256(b), 1, 2) || '/' || b AS path, length FROM (SELECT dataset, length, CASE WHEN name"
        " LIKE '%.copc.laz' THEN left(name, -9) WHEN name LIKE '%.laz' OR name LIKE '%.las' THEN left(name, -4) ELSE name"
        " END AS b FROM {tiles})"
    ),
    "l8_count_tiles": oracle("SELECT dataset, count(*) AS tiles, sum(length)::BIGINT AS bytes FROM {tiles} GROUP BY 1"),
    "l9_las_tile_headers": oracle(f"WITH {_HEADERS} SELECT * FROM h"),
    "l10_las_schema": oracle(
        f"WITH l(i, name, data_type, size, unsigned, formats) AS (VALUES {_LAS_ROWS}) SELECT doc_id,"
        " (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS position, l.name, data_type, size, unsigned"
        " FROM {tiles} JOIN l ON list_contains(formats, point_format)"
    ),
    "l11_tiff_band_schema": oracle(_BANDS),
    "l11_tiff_band_schema_bytes": oracle(_BANDS),
    "l12_raster_info": oracle(
        f"WITH t AS (SELECT p_partkey, string_agg(data_type || '(' || size || ')' || coalesce(' [' || interpretation || ']',"
        f" ''), '; ' ORDER BY band) AS schema FROM ({_BANDS}) GROUP BY 1),"
        " n AS (SELECT concat('r', (p_partkey % 23)::VARCHAR) AS dataset, lpad(p_partkey::VARCHAR, 12, '0') AS name, schema FROM t)"
        " SELECT dataset, arg_min(schema, name) AS schema, count(*) AS tiles, min(schema) <> max(schema) AS mixed FROM n GROUP BY 1"
    ),
    "l12_tile_dataset_info": oracle(
        f"WITH {_HEADERS}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY name) AS rn FROM h)"
        " SELECT dataset, max(compression) FILTER (rn = 1) AS compression, max(las_version) FILTER (rn = 1) AS"
        " las_version, max(point_format) FILTER (rn = 1) AS point_format, max(record_length) FILTER (rn = 1) AS"
        " record_length, count(*) AS tiles, count(DISTINCT (compression, las_version, point_format, record_length)) > 1"
        " AS mixed FROM r GROUP BY 1"
    ),
    "s1_format_value": oracle(
        "SELECT doc_id, "
        + _texts([("text", "text"), ("lang", "text"), ("n_chars", "plain"), ("ratio", "double"), ("even", "plain")])
        + " FROM {values_mixed}"
    ),
    "s2_format_pk": oracle(
        "SELECT doc_id, doc_id || ',' || CASE WHEN lang IS NULL THEN 'NULL' ELSE '\"' || lang || '\"' END || ',' || even"
        " AS pk FROM {values_mixed}"
    ),
    "s3_display_value": oracle(
        "SELECT doc_id, md5(text) AS text_text, "
        + _texts([("lang", "plain"), ("n_chars", "plain"), ("ratio", "double"), ("even", "plain")])
        + " FROM {values_mixed}"
    ),
    "s4_format_file_size": oracle(
        f"SELECT dataset, name, bytes, {_size('bytes')} AS size FROM (SELECT dataset, name, unnest([length, length * 64,"
        " length * 100000, length * 51000000]) AS bytes FROM {files})"
    ),
    "s5_typed_access": oracle(
        f"SELECT event_id, CASE WHEN {_E} = 0 THEN user_id END AS i64, CASE WHEN {_E} = 1 THEN event_type END AS str,"
        f" CASE WHEN {_E} = 2 THEN value END AS f64, CASE WHEN {_E} = 3 THEN event_id % 2 = 0 END AS bool,"
        f" CASE WHEN {_E} = 4 THEN hex(event_type) END AS bytes, {_E} = 5 AS is_null FROM {{events}}"
    ),
    "s6_s7_s8_names_and_dates": oracle(
        f"SELECT o_orderkey, substr({duck.digest(['o_orderkey', 'o_custkey'])}, 1, 7) AS short,"
        " 'shop_' || replace(o_orderpriority, '/', '_') || '_x' AS table_name,"
        " strftime(o_orderdate, '%Y-%m-%d') AS day FROM {orders}"
    ),
}
