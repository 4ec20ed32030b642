"""Input tables of the registered queries, derived from the given tables.

Every input is one SELECT whose text both Spark and DuckDB run; the few with arrays have one text
per engine. ``{name}`` refers to a given table or to another input.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

ORDER_VALUES = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

# Two edited versions of ``orders``. Copies get the key -1 - key, which is free at every scale.
OURS = """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
       o_totalprice, o_orderdate,
       CASE WHEN o_orderkey % 29 = 0 THEN 'same' ELSE o_orderpriority END AS o_orderpriority
FROM {orders} WHERE o_orderkey % 10 <> 0
UNION ALL
SELECT -1 - o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderkey % 13 = 0
"""

THEIRS = """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderkey % 21 = 0 THEN 'Y' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 8 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
       o_orderdate,
       CASE WHEN o_orderkey % 29 = 0 THEN 'same' ELSE o_orderpriority END AS o_orderpriority
FROM {orders} WHERE o_orderkey % 11 <> 0
UNION ALL
SELECT -1 - o_orderkey, o_custkey, CASE WHEN o_orderkey % 26 = 0 THEN 'T' ELSE o_orderstatus END,
       o_totalprice, o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderkey % 26 = 0 OR o_orderkey % 39 = 0
"""


def _nulls(step: int) -> str:
    return f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
       CASE WHEN o_orderkey % {step} = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM {{orders}}
"""


KEYED_LINEITEM = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
       l_returnflag, l_linestatus, l_shipdate
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
                 l_linestatus, l_shipdate) AS rn FROM {lineitem}) t
WHERE rn = 1
"""

CHANGE_LOG = """
SELECT event_id AS seq, concat('t', CAST(user_id % 3 AS STRING)) AS table_name,
       CAST(user_id AS STRING) AS pk,
       CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS change_type
FROM {events}
"""

# Working-copy rows of the keys in the log; the columns they lack read as NULL.
CURRENT = """
SELECT user_id AS c_custkey, concat('user ', CAST(user_id AS STRING)) AS c_name,
       max_by(value, event_id) AS c_acctbal
FROM {events} GROUP BY user_id
"""

# One commit per event. Commit 10 d continues the main line and, unless d is a multiple of seven,
# merges the side branch 10 d - 9 … 10 d - 5; commits 10 d + 6 … 10 d + 9 are a branch never merged.
_COMMIT = """
SELECT concat('c', CAST(event_id AS STRING)) AS commit_id, event_id AS commit_no,
       concat('user', CAST(user_id AS STRING)) AS author, ts,
       concat(event_type, ' ', CAST(event_id AS STRING)) AS subject, props AS body,
       {parents} AS parent_ids
FROM {{events}}
"""
_ID = "concat('c', CAST(event_id - {} AS STRING))"


def _parents(array: str) -> str:
    def ids(*steps: int) -> str:
        return array.format(", ".join(_ID.format(s) for s in steps))

    return (
        "CASE WHEN event_id % 10 = 0 AND event_id % 70 <> 0 THEN " + ids(10, 5)
        + " WHEN event_id % 10 = 0 AND event_id > 0 THEN " + ids(10)
        + " WHEN event_id % 10 = 6 THEN " + ids(6)
        + " WHEN event_id > 0 THEN " + ids(1)
        + " ELSE NULL END"
    )


COMMITS = (_COMMIT.format(parents=_parents("array({})")), _COMMIT.format(parents=_parents("[{}]")))

REFS = """
SELECT concat('topic/', CAST(event_id AS STRING)) AS name, concat('c', CAST(event_id AS STRING)) AS commit_id
FROM {events} WHERE event_id % 10 = 5 OR event_id % 10 = 9
UNION ALL
SELECT 'main', concat('c', CAST(max(event_id) AS STRING)) FROM {events} WHERE event_id % 10 = 0
"""

# Every commit changes one customer; a commit whose number is a customer key also changes that
# customer's orders.
CUSTOMER_DELTAS = """
SELECT concat('c', CAST(event_id AS STRING)) AS commit_id, event_id AS commit_no, 'shop/customer' AS dataset,
       user_id AS c_custkey,
       CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op,
       CASE WHEN event_type <> 'error' THEN concat('user ', CAST(user_id AS STRING)) END AS c_name,
       CASE WHEN event_type <> 'error' THEN CAST(user_id % 25 AS INT) END AS c_nationkey,
       CASE WHEN event_type <> 'error' THEN value END AS c_acctbal,
       CASE WHEN event_type <> 'error' THEN event_type END AS c_mktsegment
FROM {events}
"""

ORDER_DELTAS = """
SELECT concat('c', CAST(o_custkey AS STRING)) AS commit_id, o_custkey AS commit_no, 'shop/orders' AS dataset,
       CASE WHEN o_orderkey % 3 = 2 THEN -1 - o_orderkey ELSE o_orderkey END AS o_orderkey,
       CASE o_orderkey % 3 WHEN 0 THEN 'U' WHEN 1 THEN 'D' ELSE 'I' END AS op,
       CASE WHEN o_orderkey % 3 <> 1 THEN o_custkey END AS o_custkey,
       CASE WHEN o_orderkey % 3 <> 1 THEN 'V' END AS o_orderstatus,
       CASE WHEN o_orderkey % 3 <> 1 THEN o_totalprice * 2 END AS o_totalprice,
       CASE WHEN o_orderkey % 3 <> 1 THEN o_orderdate END AS o_orderdate,
       CASE WHEN o_orderkey % 3 <> 1 THEN o_orderpriority END AS o_orderpriority
FROM {orders}
"""

ALL_DELTAS = """
SELECT commit_id, commit_no, dataset, c_custkey AS pk, op FROM {customer_deltas}
UNION ALL
SELECT commit_id, commit_no, dataset, o_orderkey AS pk, op FROM {order_deltas}
"""

# Points as WKT text. Keys decide which rows are missing, polygons, junk or three-dimensional.
WKT_POINTS = """
SELECT c_custkey, c_mktsegment AS dataset,
       CASE WHEN c_custkey % 20 = 0 THEN NULL
            WHEN c_custkey % 23 = 0 THEN 'POLYGON((0 0, 1 0, 1 1, 0 0))'
            WHEN c_custkey % 31 = 0 THEN 'junk'
            WHEN c_custkey % 37 = 0 THEN concat('POINT Z (', CAST(c_custkey % 361 - 180 AS STRING), ' ',
                                                CAST(c_custkey % 181 - 90 AS STRING), ' 1)')
            WHEN c_custkey % 41 = 0 THEN 'POINT(1d 2)'
            WHEN c_custkey % 43 = 0 THEN 'LINESTRING( 10   20 , 30 40)'
            ELSE concat('POINT(', CAST(c_custkey % 361 - 180 AS STRING), ' ', CAST(c_custkey % 181 - 90 AS STRING), ')')
       END AS wkt
FROM {customer}
"""

# Boxes of different sizes around customers of a second reading of the table, and one per nation.
BOXES = """
SELECT concat('n', CAST(n_nationkey AS STRING)) AS region,
       CAST(n_nationkey * 14 - 180 AS DOUBLE) AS min_x, CAST(n_nationkey * 6 - 90 AS DOUBLE) AS min_y,
       CAST(n_nationkey * 14 - 160 AS DOUBLE) AS max_x, CAST(n_nationkey * 6 - 70 AS DOUBLE) AS max_y
FROM {nation}
UNION ALL
SELECT concat('s', CAST(s_suppkey AS STRING)),
       CAST(s_suppkey % 360 - 180 AS DOUBLE), CAST(s_suppkey * 7 % 180 - 90 AS DOUBLE),
       CAST(s_suppkey % 360 - 180 + s_suppkey % 5 AS DOUBLE), CAST(s_suppkey * 7 % 180 - 90 + s_suppkey % 3 AS DOUBLE)
FROM {supplier}
"""

BOX_TEXTS = """
SELECT p_partkey,
       CASE p_partkey % 6
         WHEN 0 THEN concat(CAST(p_size AS STRING), ',', CAST(p_partkey AS STRING), ', 2.5 ,1e2')
         WHEN 1 THEN concat('1,2,x,', CAST(p_partkey AS STRING), ',5')
         WHEN 2 THEN concat('1,2,', CAST(p_size AS STRING))
         WHEN 3 THEN concat('1,2,3,4,', CAST(p_size AS STRING))
         WHEN 4 THEN concat('-', CAST(p_size AS STRING), '.5,+2,.5,3.')
         ELSE 'POLYGON((0 0, 1 1))' END AS box
FROM {part}
"""

# Column catalogue: eight columns per dataset, every kind of declared type.
_UUID = ("concat(lpad(lower(hex({0})), 8, '0'), '-0000-4000-8000-', lpad(lower(hex({0} * 7919)), 12, '0'))")
COLUMN_IDS = _UUID

CATALOGUE = f"""
SELECT concat('shop/d', CAST(p_partkey // 8 AS STRING)) AS dataset,
       CAST(p_partkey % 8 AS INT) AS position,
       {_UUID.format('p_partkey')} AS id,
       CASE p_partkey % 8 WHEN 0 THEN 'fid' ELSE concat('c', CAST(p_partkey % 8 AS STRING)) END AS name,
       CASE p_partkey % 11 WHEN 0 THEN 'boolean' WHEN 1 THEN 'blob' WHEN 2 THEN 'date' WHEN 3 THEN 'float'
            WHEN 4 THEN 'geometry' WHEN 5 THEN 'integer' WHEN 6 THEN 'interval' WHEN 7 THEN 'numeric'
            WHEN 8 THEN 'text' WHEN 9 THEN 'time' ELSE 'timestamp' END AS data_type,
       CASE WHEN p_partkey % 8 = 0 THEN 1 WHEN p_partkey % 24 = 3 THEN 0 END AS primary_key_index,
       CASE WHEN p_partkey % 11 = 4 AND p_size > 10 THEN 'POINT' END AS geometry_type,
       CASE WHEN p_partkey % 11 = 4 AND p_size > 40 THEN 'local'
            WHEN p_partkey % 11 = 4 AND p_size > 20 THEN concat('EPSG:', CAST(2000 + p_size AS STRING)) END AS geometry_crs,
       CASE WHEN p_partkey % 11 IN (3, 5) THEN CASE p_partkey % 4 WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 32 ELSE 64 END
       END AS size,
       CASE WHEN p_partkey % 11 = 8 THEN p_size END AS length,
       CASE WHEN p_partkey % 11 = 7 AND p_size > 25 THEN 12 END AS precision,
       CASE WHEN p_partkey % 11 = 7 AND p_size > 25 THEN 3 END AS scale,
       CASE WHEN p_partkey % 11 = 10 AND p_size > 25 THEN 'UTC' END AS timezone
FROM {{part}}
"""
CATALOGUE = (CATALOGUE.replace("//", "div"), CATALOGUE)

# A later version: some columns dropped, renamed, retyped or both, and new ones with other ids.
CATALOGUE_LATER = f"""
SELECT dataset, id,
       CASE WHEN position = 2 THEN concat(name, '_renamed') WHEN position = 5 THEN concat('x', name) ELSE name END AS name,
       CASE WHEN position IN (3, 5) THEN 'text' ELSE data_type END AS data_type
FROM {{catalogue}} WHERE position <> 7
UNION ALL
SELECT dataset, concat(id, '+'), 'extra', 'text' FROM {{catalogue}} WHERE position = 0
"""

# Columns as a source database lists them.
SOURCE_COLUMNS = """
SELECT concat('t', CAST(p_partkey // 16 AS STRING)) AS table_name,
       CASE WHEN p_partkey % 48 = 5 THEN 'gid' WHEN p_partkey % 32 = 9 THEN 'fid' WHEN p_partkey % 64 = 40 THEN 'id'
            ELSE concat('c', CAST(p_partkey % 16 AS STRING)) END AS name,
       CASE p_partkey % 17 WHEN 0 THEN 'INTEGER' WHEN 1 THEN 'bigint' WHEN 2 THEN 'POINT' WHEN 3 THEN 'INTERVAL'
            WHEN 4 THEN 'REAL' WHEN 5 THEN 'float' WHEN 6 THEN 'double precision' WHEN 7 THEN 'BLOB'
            WHEN 8 THEN 'BOOLEAN' WHEN 9 THEN 'DATETIME' WHEN 10 THEN 'NUMERIC(10,2)' WHEN 11 THEN 'TEXT'
            WHEN 12 THEN 'date' WHEN 13 THEN 'bytea' WHEN 14 THEN 'timestamp with time zone'
            WHEN 15 THEN 'numeric' ELSE 'boolean' END AS type_name,
       CASE p_partkey % 7 WHEN 0 THEN 'Numeric' WHEN 1 THEN 'Float' WHEN 2 THEN 'Logical' WHEN 3 THEN 'Date'
            WHEN 4 THEN 'Integer' WHEN 5 THEN 'Character' ELSE 'Memo' END AS dbf_type,
       CAST(CASE WHEN p_partkey % 16 < 2 THEN p_partkey % 16 + 1 ELSE 0 END AS INT) AS pk
FROM {part}
"""
SOURCE_COLUMNS = (SOURCE_COLUMNS.replace("//", "div"), SOURCE_COLUMNS)

SOURCE_GEOMETRY = """
SELECT DISTINCT table_name, name, 'POLYGON' AS geometry_type,
       CAST(CASE WHEN pk = 0 THEN 3857 ELSE NULL END AS BIGINT) AS srs_id
FROM {source_columns} WHERE type_name = 'BLOB'
"""

# Documents as files of file datasets, their length in bytes.
FILES = (
    "SELECT source AS dataset, concat('doc_', CAST(doc_id AS STRING), '.txt') AS name,"
    " CAST({} AS BIGINT) AS length FROM {{documents}}"
)
FILES = (FILES.format("octet_length(text)"), FILES.format("strlen(text)"))

# Pages as files added to the same datasets, some under names that are taken.
NEW_FILES = (
    "SELECT concat('src', CAST(page_id % 20 AS STRING)) AS dataset,"
    " concat('doc_', CAST(page_id AS STRING), CASE WHEN page_id % 2 = 0 THEN '.txt' ELSE '.md' END) AS name,"
    " CAST({}(html) AS BIGINT) AS length FROM {{pages}}"
)
NEW_FILES = (NEW_FILES.format("octet_length"), NEW_FILES.format("strlen"))

# Page addresses as paths of a repository with all kinds of datasets, some in hidden places.
PATHS = """
SELECT concat(CASE page_id % 11 WHEN 0 THEN '.hidden/' WHEN 1 THEN 'target/' WHEN 2 THEN 'old.gpkg/' ELSE '' END,
       replace(replace(url, 'https://', ''), 'http://', ''),
       CASE page_id % 6 WHEN 0 THEN '/.table-dataset/feature/A/A/A/B/kU0=' WHEN 1 THEN '/.file-dataset/files/readme.md'
            WHEN 2 THEN '/.point-cloud-dataset.v1/tile/ab/one' WHEN 3 THEN '/.raster-dataset.v1/tile/cd/two'
            WHEN 4 THEN '/.point-cloud-dataset/tile/three' ELSE '/.table-dataset' END) AS path,
       CASE page_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'M' ELSE 'D' END AS status
FROM {pages}
"""

# Pages are XML-like uploads, documents plain ones, some with blanks in front.
UPLOADS = """
SELECT concat('ds', CAST(page_id AS STRING)) AS dataset, CASE WHEN page_id % 2 = 0 THEN 'metadata' ELSE 'license' END AS role,
       CASE WHEN page_id % 3 = 0 THEN concat('  ', html) ELSE html END AS content
FROM {pages}
UNION ALL
SELECT concat('ds', CAST(doc_id AS STRING)), CASE WHEN doc_id % 3 = 0 THEN 'metadata' ELSE 'license' END,
       CASE WHEN doc_id % 5 = 0 THEN concat('   ', text) ELSE text END
FROM {documents}
"""

OWNERS = """
SELECT concat('ds', CAST(doc_id AS STRING)) AS name,
       CASE doc_id % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'file' WHEN 2 THEN 'raster' ELSE 'table' END AS kind
FROM {documents}
UNION ALL
SELECT concat('ds', CAST(doc_id AS STRING)), 'file' FROM {documents} WHERE doc_id % 8 = 3
"""

# Tiles: one per document, named with all the extensions.
TILES = """
SELECT source AS dataset, concat('tile_', CAST(doc_id AS STRING), CASE doc_id % 5 WHEN 0 THEN '.copc.laz' WHEN 1 THEN '.laz'
       WHEN 2 THEN '.las' WHEN 3 THEN '.tif' ELSE '' END) AS name, doc_id,
       CAST(n_chars AS BIGINT) AS length, CAST(doc_id % 11 AS INT) AS point_format,
       CAST(20 + doc_id % 47 + 256 * (doc_id % 2) AS INT) AS record_length,
       CAST(doc_id % 5 AS INT) AS minor, CASE WHEN doc_id % 3 = 0 THEN 'laz' ELSE 'las' END AS compression
FROM {documents}
"""

VALUES_MIXED = """
SELECT doc_id, text, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE lang END AS lang, n_chars,
       CASE WHEN doc_id % 4 = 0 THEN doc_id / 8.0E0 ELSE CAST(doc_id AS DOUBLE) END AS ratio, doc_id % 2 = 0 AS even
FROM {documents}
"""

# Integers at every width of the key encoding, spread over the whole table.
WIDE_KEYS = """
SELECT o_orderkey,
       CASE o_orderkey % 12 WHEN 0 THEN o_orderkey WHEN 1 THEN -1 - o_orderkey WHEN 2 THEN o_orderkey % 128
            WHEN 3 THEN -(o_orderkey % 140) WHEN 4 THEN o_orderkey % 256 WHEN 5 THEN 65000 + o_orderkey
            WHEN 6 THEN 4294967290 + o_orderkey % 12 WHEN 7 THEN -2147483640 - o_orderkey % 16
            WHEN 8 THEN -32760 - o_orderkey % 16 WHEN 9 THEN 1234567890 + o_orderkey
            WHEN 10 THEN o_orderkey * 1000000007 ELSE -(o_orderkey * 1000000007) END AS k
FROM {orders}
"""

INPUTS: dict[str, str | tuple[str, str]] = {
    "ours": OURS,
    "theirs": THEIRS,
    "nulls_a": _nulls(17),
    "nulls_b": _nulls(19),
    "keyed_lineitem": KEYED_LINEITEM,
    "change_log": CHANGE_LOG,
    "current": CURRENT,
    "commits": COMMITS,
    "refs": REFS,
    "customer_deltas": CUSTOMER_DELTAS,
    "order_deltas": ORDER_DELTAS,
    "all_deltas": ALL_DELTAS,
    "wkt_points": WKT_POINTS,
    "boxes": BOXES,
    "box_texts": BOX_TEXTS,
    "catalogue": CATALOGUE,
    "catalogue_later": CATALOGUE_LATER,
    "source_columns": SOURCE_COLUMNS,
    "source_geometry": SOURCE_GEOMETRY,
    "files": FILES,
    "new_files": NEW_FILES,
    "paths": PATHS,
    "uploads": UPLOADS,
    "owners": OWNERS,
    "tiles": TILES,
    "values_mixed": VALUES_MIXED,
    "wide_keys": WIDE_KEYS,
}


def _text(name: str, engine: int) -> str:
    text = INPUTS[name]
    return text if isinstance(text, str) else text[engine]


def _names(text: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", text)


def _order(names: list[str], engine: int, seen: list[str]) -> list[str]:
    for name in names:
        if name in INPUTS and name not in seen:
            _order(_names(_text(name, engine)), engine, seen)
            seen.append(name)
    return seen


def _compose(text: str, engine: int, recursive: bool = False) -> str:
    """Statement with every input it needs as a common table expression; tables stay ``{table}``."""
    needed = _order(_names(text), engine, [])
    parts = [f"{name} AS ({_text(name, engine).strip()})" for name in needed]
    body = text
    lead = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body, re.I)
    if lead:
        recursive = recursive or bool(lead.group(1))
        body = body[lead.end():]
        joined = ", ".join(parts) + (", " if parts else "") + body
    else:
        joined = ", ".join(parts) + " " + body
    if parts or lead:
        joined = f"WITH {'RECURSIVE ' if recursive else ''}{joined}"
    for name in INPUTS:
        joined = joined.replace("{" + name + "}", name)
    return joined


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def given(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table or a derived input as a DataFrame."""
    if name in TABLES:
        return table(spark, sf, name)
    return select(spark, sf, f"SELECT * FROM {{{name}}}")


def select(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """Run a SELECT over given tables and inputs in Spark."""
    text = _compose(text, 0)
    used = {n for n in _names(text) if n in TABLES}
    return spark.sql(text, **{n: table(spark, sf, n) for n in used})


def oracle(text: str) -> str:
    """The same kind of SELECT as DuckDB text."""
    text = _compose(text, 1)
    for name in TABLES:
        text = text.replace("{" + name + "}", name)
    return text
