"""Diff queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from checks import duck
from checks.inputs import ORDER_VALUES, given, oracle
from rowtrail.functions.address import full_feature_path, row_digest
from rowtrail.operators import diff as D

KEY = ["o_orderkey"]


def flat(delta: DataFrame, keys: list[str]) -> DataFrame:
    """Delta without structs and arrays."""
    names = [f.name for f in delta.schema["new"].dataType.fields]
    return delta.select(
        *[c for c in delta.columns if c not in ("old", "new", "changed_columns")],
        *[F.col("old")[n].alias(f"old_{n}") for n in names],
        *[F.col("new")[n].alias(f"new_{n}") for n in names],
        F.array_join("changed_columns", ",").alias("changed_columns"),
    )


def orders_delta(spark, sf) -> DataFrame:
    return D.diff_rows(given(spark, sf, "orders"), given(spark, sf, "ours"), KEY)


def d1(spark, sf):
    return flat(orders_delta(spark, sf), KEY)


def d1_nulls(spark, sf):
    return flat(D.diff_rows(given(spark, sf, "nulls_a"), given(spark, sf, "nulls_b"), KEY), KEY)


def d1_composite(spark, sf):
    keys = ["l_orderkey", "l_linenumber"]
    old = given(spark, sf, "keyed_lineitem")
    edited = old.filter((F.col("l_orderkey") + F.col("l_linenumber")) % 9 != 0).withColumn(
        "l_quantity", F.when(F.col("l_partkey") % 5 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    )
    return flat(D.diff_rows(old, edited, keys), keys)


def evolved(spark, sf) -> DataFrame:
    """A version with a column dropped, one retyped and one added."""
    rows = given(spark, sf, "ours").drop("o_orderstatus")
    note = F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.col("o_orderpriority"), F.lit("!")))
    return rows.withColumns({"o_custkey": F.col("o_custkey").cast("string"), "o_note": note})


def d1_evolved(spark, sf):
    return flat(D.diff_rows(given(spark, sf, "orders"), evolved(spark, sf), KEY), KEY)


def retyped(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two versions whose columns have other types: a wider decimal, bigint and double, int and bigint."""
    big = F.lit(1 << 53) + F.col("o_custkey")
    old = given(spark, sf, "orders").select(
        *KEY, F.col("o_totalprice").cast("decimal(19,2)").alias("price"), big.alias("big"),
        F.col("o_custkey").cast("int").alias("small"), F.col("o_totalprice").cast("decimal(15,2)").alias("fee"))
    new = given(spark, sf, "ours").select(
        *KEY, F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice").cast("decimal(21,4)") + F.lit("0.0001").cast("decimal(5,4)"))
        .otherwise(F.col("o_totalprice").cast("decimal(19,2)")).cast("decimal(21,4)").alias("price"), big.cast("double").alias("big"),
        F.col("o_custkey").alias("small"), F.col("o_totalprice").cast("decimal(15,2)").cast("double").alias("fee"))
    return old, new


def d1_retyped(spark, sf):
    return flat(D.diff_rows(*retyped(spark, sf), KEY), KEY)


def _datasets(spark, sf):
    status = F.coalesce(F.col("old.o_orderpriority"), F.col("new.o_orderpriority"))
    return orders_delta(spark, sf).withColumn("dataset", status)


def trees(spark, sf):
    """Content trees of two versions next to unversioned paths."""
    out = []
    for name in ("orders", "ours"):
        rows = given(spark, sf, name)
        path = F.concat(F.lit("shop/orders/.table-dataset/feature/"), full_feature_path(rows, KEY))
        features = rows.select(path.alias("path"), row_digest(rows, ORDER_VALUES).alias("digest"))
        pages = given(spark, sf, "pages")
        text = "html" if name == "orders" else F.upper("html")
        loose = pages.filter(F.col("page_id") % 4 != (0 if name == "orders" else 1))
        loose = loose.select(F.concat_ws("#", "url", "page_id").alias("path"), F.sha2(text, 256).alias("digest"))
        out.append(features.union(loose))
    return out


def d6(spark, sf):
    return D.tree_diff(*trees(spark, sf))


def d7(spark, sf):
    return D.row_changes_long(orders_delta(spark, sf), KEY)


QUERIES = {
    "d1_diff_rows": d1,
    "d1_diff_rows_nulls": d1_nulls,
    "d1_diff_rows_composite_key": d1_composite,
    "d1_diff_rows_evolved": d1_evolved,
    "d1_diff_rows_retyped": d1_retyped,
    "d2_filter_delta": lambda s, sf: flat(D.filter_delta(orders_delta(s, sf), "U"), KEY),
    "d3_diff_summary": lambda s, sf: D.diff_summary(orders_delta(s, sf)),
    "d4_diff_stat_by_dataset": lambda s, sf: D.diff_stat_by_dataset(_datasets(s, sf)),
    "d5_path_diff_stat": lambda s, sf: D.path_diff_stat(given(s, sf, "paths")),
    "d6_tree_diff": d6,
    "d7_row_changes_long": d7,
    "d8_select_delta": lambda s, sf: flat(D.select_delta(_datasets(s, sf), ["1-", "5-L", "sam"]), KEY),
    "d9_feature_at": lambda s, sf: D.feature_at(given(s, sf, "orders"), o_orderkey=77),
}

_DELTA = duck.delta("{orders}", "{ours}", KEY, ORDER_VALUES)
# Both versions with the columns and types that they are compared in.
_EVOLVED = ["o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_note", "o_orderstatus"]
_OLDER = (
    "(SELECT o_orderkey, o_custkey::VARCHAR AS o_custkey, o_totalprice, o_orderdate, o_orderpriority,"
    " NULL::VARCHAR AS o_note, o_orderstatus FROM {orders})"
)
_NEWER = (
    "(SELECT o_orderkey, o_custkey::VARCHAR AS o_custkey, o_totalprice, o_orderdate, o_orderpriority,"
    " CASE WHEN o_orderkey % 10 = 0 THEN o_orderpriority || '!' END AS o_note, NULL::VARCHAR AS o_orderstatus FROM {ours})"
)
EVOLVED_DELTA = duck.delta(_OLDER, _NEWER, KEY, _EVOLVED)
# Numbers that no type holds together are compared as text.
_FEE = "regexp_replace(o_totalprice::DECIMAL(15,2)::VARCHAR, '[.]?0+$', '')"
RETYPED_OLD = (
    "(SELECT o_orderkey, o_totalprice::DECIMAL(21,4) AS price, (9007199254740992 + o_custkey)::VARCHAR AS big,"
    f" o_custkey::BIGINT AS small, {_FEE} AS fee FROM {{orders}})"
)
RETYPED_NEW = (
    "(SELECT o_orderkey, (o_totalprice::DECIMAL(19,2)::DECIMAL(21,4) + CASE WHEN o_orderkey % 7 = 0 THEN 0.0001 ELSE 0 END)"
    "::DECIMAL(21,4) AS price, ((9007199254740992 + o_custkey)::DOUBLE)::BIGINT::VARCHAR AS big,"
    f" o_custkey::BIGINT AS small, {_FEE} AS fee FROM {{ours}})"
)
RETYPED = ["price", "big", "small", "fee"]
_COUNT = "count(*) FILTER (op = '{}') AS {}"


def _tree(name: str) -> str:
    text, left = ("html", 0) if name == "orders" else ("upper(html)", 1)
    return (
        f"SELECT 'shop/orders/.table-dataset/feature/' || {duck.full_path('o_orderkey')} AS path,"
        f" {duck.digest(ORDER_VALUES)} AS digest FROM {{{name}}}"
        f" UNION ALL SELECT url || '#' || page_id, sha256({text}) FROM {{pages}} WHERE page_id % 4 <> {left}"
    )


_KINDS = {"o_custkey": "plain", "o_orderstatus": "text", "o_totalprice": "double", "o_orderdate": "plain",
          "o_orderpriority": "text"}


def _long() -> str:
    parts = [f"SELECT o_orderkey, op, NULL AS \"column\", NULL AS old, NULL AS new FROM d WHERE op = 'D'"]
    for c, kind in _KINDS.items():
        parts.append(
            f"SELECT o_orderkey, op, '{c}', CASE WHEN op = 'U' THEN {duck.formatted('old_' + c, kind)} END,"
            f" {duck.formatted('new_' + c, kind)} FROM d"
            f" WHERE op = 'I' OR (op = 'U' AND old_{c} IS DISTINCT FROM new_{c})"
        )
    return f"WITH d AS ({_DELTA}) " + " UNION ALL ".join(parts)


_LINE_VALUES = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                "l_linestatus", "l_shipdate"]
_DATASET = "coalesce(old_o_orderpriority, new_o_orderpriority)"

ORACLES = {
    "d1_diff_rows": oracle(_DELTA),
    "d1_diff_rows_nulls": oracle(duck.delta("{nulls_a}", "{nulls_b}", KEY, ORDER_VALUES)),
    "d1_diff_rows_composite_key": oracle(
        "WITH edited AS (SELECT * REPLACE (CASE WHEN l_partkey % 5 = 0 THEN l_quantity + 1 ELSE l_quantity END"
        " AS l_quantity) FROM {keyed_lineitem} WHERE (l_orderkey + l_linenumber) % 9 <> 0) "
        + duck.delta("{keyed_lineitem}", "edited", ["l_orderkey", "l_linenumber"], _LINE_VALUES)
    ),
    "d1_diff_rows_evolved": oracle(EVOLVED_DELTA),
    "d1_diff_rows_retyped": oracle(duck.delta(RETYPED_OLD, RETYPED_NEW, KEY, RETYPED)),
    "d2_filter_delta": oracle(f"SELECT * FROM ({_DELTA}) WHERE op = 'U'"),
    "d3_diff_summary": oracle(
        f"SELECT {_COUNT.format('I', 'inserts')}, {_COUNT.format('U', 'updates')}, {_COUNT.format('D', 'deletes')}"
        f" FROM ({_DELTA})"
    ),
    "d4_diff_stat_by_dataset": oracle(
        f"SELECT {_DATASET} AS dataset, {_COUNT.format('I', 'added')}, {_COUNT.format('U', 'modified')},"
        f" {_COUNT.format('D', 'deleted')} FROM ({_DELTA}) GROUP BY 1"
    ),
    "d5_path_diff_stat": oracle(
        "SELECT split_part(path, '/.table-dataset/', 1) AS dataset, count(*) FILTER (status = 'A') AS added,"
        " count(*) FILTER (status = 'M') AS modified, count(*) FILTER (status = 'D') AS deleted"
        " FROM {paths} GROUP BY 1"
    ),
    "d6_tree_diff": oracle(
        f"WITH a AS ({_tree('orders')}), b AS ({_tree('ours')})"
        " SELECT CASE WHEN a.path IS NULL THEN 'A' WHEN b.path IS NULL THEN 'D' ELSE 'M' END AS status,"
        " coalesce(a.path, b.path) AS path FROM a FULL JOIN b ON a.path = b.path"
        " WHERE a.digest IS DISTINCT FROM b.digest"
    ),
    "d7_row_changes_long": oracle(_long()),
    "d8_select_delta": oracle(
        f"SELECT *, {_DATASET} AS dataset FROM ({_DELTA}) WHERE starts_with({_DATASET}, '1-')"
        f" OR starts_with({_DATASET}, '5-L') OR starts_with({_DATASET}, 'sam')"
    ),
    "d9_feature_at": oracle("SELECT * FROM {orders} WHERE o_orderkey = 77"),
}
