"""Merge and conflict queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from checks import duck
from checks.inputs import ORDER_VALUES, given, oracle
from rowtrail.operators import merge as M
from rowtrail.operators.diff import diff_rows

KEY = ["o_orderkey"]


def spread(df: DataFrame, structs: list[str], keep: list[str]) -> DataFrame:
    """Struct columns as ``<struct>_<field>``."""
    return df.select(*keep, *[F.col(s)[n].alias(f"{s}_{n}") for s in structs for n in ORDER_VALUES])


def sides(spark, sf):
    return [given(spark, sf, n) for n in ("orders", "ours", "theirs")]


def strict(spark, sf) -> DataFrame:
    base, ours, theirs = sides(spark, sf)
    return M.merge_deltas(diff_rows(base, ours, KEY), diff_rows(base, theirs, KEY), KEY)


def rows(spark, sf) -> DataFrame:
    return M.merge_rows(*sides(spark, sf), KEY)


def m1(spark, sf):
    merged = strict(spark, sf).filter(F.col("status") == "resolved")
    return spread(merged, ["values"], ["o_orderkey", "status", "resolution"])


def m2(spark, sf):
    merged = strict(spark, sf)
    return merged.groupBy("status", "conflict_type").agg(F.count(F.lit(1)).alias("n"))


def m3(spark, sf):
    conflicts = strict(spark, sf).filter(F.col("status") == "conflict")
    return spread(conflicts, ["ancestor", "ours", "theirs"], ["o_orderkey", "conflict_type"])


def m4(spark, sf):
    """Deltas whose keys repeat: the log of both sides is one sequence, the last row of a key wins."""
    lines = given(spark, sf, "lineitem")
    order = F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    value = F.struct(F.col("l_extendedprice").alias("price"))
    delta = lines.select("l_orderkey", F.lit("U").alias("op"), value.alias("old"), value.alias("new"), order.alias("seq"),
                         "l_linenumber")
    ours, theirs = delta.filter("l_linenumber <= 4"), delta.filter("l_linenumber >= 4")
    merged = M.merge_deltas(ours, theirs, ["l_orderkey"], seq="seq")
    return merged.select("pk_key", "status", F.coalesce("values", "ours").price.alias("price")).orderBy("pk_key")


def m5(spark, sf):
    return spread(rows(spark, sf), ["merged"], ["o_orderkey", "status", "op"])


def m6(spark, sf):
    return spread(M.merge_columns(*sides(spark, sf), KEY), ["merged"], ["o_orderkey", "resolution"])


def conflicts(spark, sf) -> DataFrame:
    return M.list_conflicts(rows(spark, sf))


def _resolve(strategy):
    def run(spark, sf):
        copy = given(spark, sf, "nulls_a") if strategy == "workingcopy" else None
        return spread(M.resolve(conflicts(spark, sf), KEY, strategy, copy), ["resolved"], ["o_orderkey", "op"])

    return run


REPLACEMENT = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.TimestampNTZType()), T.StructField("o_orderpriority", T.StringType()),
])


def m9(spark, sf):
    orders = given(spark, sf, "orders")
    fixed = orders.withColumn("o_orderstatus", F.lit("R"))
    text = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*fixed.columns).alias("properties")))
    replacements = M.replacements_from_json(fixed.select(text.alias("feature")), "feature", REPLACEMENT)
    return spread(M.resolve_with(conflicts(spark, sf), replacements, KEY), ["resolved"], ["o_orderkey", "op"])


def m10(spark, sf):
    merged = rows(spark, sf)
    resolutions = M.resolve(M.list_conflicts(merged), KEY, "theirs")
    return M.finish_merge(given(spark, sf, "orders"), merged, resolutions, KEY)


def _versions(spark, sf) -> list:
    """Three versions whose amounts and numbers have other types."""
    types = (("orders", "decimal(19,2)", "bigint"), ("ours", "decimal(21,4)", "double"), ("theirs", "decimal(17,3)", "bigint"))
    number = (F.lit(1 << 53) + F.col("o_custkey")).cast("bigint")
    return [
        given(spark, sf, name).select("o_orderkey", F.col("o_totalprice").cast(price).alias("price"), number.cast(kind).alias("number"))
        for name, price, kind in types
    ]


def m5_retyped(spark, sf):
    merged = M.merge_rows(*_versions(spark, sf), KEY)
    return merged.select("o_orderkey", "status", "op", F.col("merged.price").alias("price"), F.col("merged.number").alias("number"))


QUERIES = {
    "m1_merge_deltas": m1,
    "m2_classify_conflict": m2,
    "m3_conflict_payload": m3,
    "m4_pk_key_last_wins": m4,
    "m5_merge_rows": m5,
    "m5_merge_rows_retyped": m5_retyped,
    "m6_merge_columns": m6,
    "m7_list_conflicts": lambda s, sf: spread(conflicts(s, sf), ["base", "ours", "theirs"], ["o_orderkey"]),
    "m7_count_conflicts": lambda s, sf: M.count_conflicts(rows(s, sf)),
    "m8_resolve_ours": _resolve("ours"),
    "m8_resolve_theirs": _resolve("theirs"),
    "m8_resolve_ancestor": _resolve("ancestor"),
    "m8_resolve_delete": _resolve("delete"),
    "m8_resolve_workingcopy": _resolve("workingcopy"),
    "m9_resolve_with": m9,
    "m10_finish_merge": m10,
}


# The three tables side by side: b, o, t with a mark for each side's change.
def _same(x: str, y: str) -> str:
    both = " AND ".join(f"{x}.{n} IS NOT DISTINCT FROM {y}.{n}" for n in ORDER_VALUES)
    return f"(({x}.o_orderkey IS NULL) = ({y}.o_orderkey IS NULL) AND {both})"


def _side(x: str) -> str:
    return ", ".join(f"{x}.{n} AS {x}_{n}" for n in ORDER_VALUES)


def _kind(x: str) -> str:
    return (
        f"CASE WHEN {_same('b', x)} THEN NULL WHEN b.o_orderkey IS NULL THEN 'I'"
        f" WHEN {x}.o_orderkey IS NULL THEN 'D' ELSE 'U' END"
    )


_JOINED = (
    "SELECT k.o_orderkey, b.o_orderkey IS NOT NULL AS b_there, o.o_orderkey IS NOT NULL AS o_there,"
    f" t.o_orderkey IS NOT NULL AS t_there, {_side('b')}, {_side('o')}, {_side('t')},"
    f" {_kind('o')} AS o_op, {_kind('t')} AS t_op, {_same('o', 't')} AS same"
    " FROM (SELECT o_orderkey FROM {orders} UNION SELECT o_orderkey FROM {ours}"
    " UNION SELECT o_orderkey FROM {theirs}) k"
    " LEFT JOIN {orders} b ON b.o_orderkey = k.o_orderkey LEFT JOIN {ours} o ON o.o_orderkey = k.o_orderkey"
    " LEFT JOIN {theirs} t ON t.o_orderkey = k.o_orderkey"
)
_J = f"WITH j AS ({_JOINED})"
_STATUS = (
    "CASE WHEN o_op IS NULL AND t_op IS NULL THEN 'unchanged' WHEN t_op IS NULL THEN 'ours'"
    " WHEN o_op IS NULL THEN 'theirs' WHEN same THEN 'identical' ELSE 'conflict' END"
)
_S = f"{_J}, s AS (SELECT *, {_STATUS} AS status FROM j)"
_TYPE = (
    "CASE WHEN o_op IS NULL OR t_op IS NULL THEN NULL WHEN o_op = 'I' AND t_op = 'I' THEN 'BothAdded'"
    " WHEN (o_op, t_op) IN (('U', 'D'), ('D', 'U')) THEN 'ModifyDelete' ELSE 'BothModified' END"
)
_STRICT = "CASE WHEN o_op IS NOT NULL AND t_op IS NOT NULL THEN 'conflict' ELSE 'resolved' END"
# Rows of the strict merge: a conflict, or one side's insert or update.
_STRICT_ROWS = "(o_op IS NOT NULL AND t_op IS NOT NULL) OR o_op IN ('I', 'U') OR t_op IN ('I', 'U')"


def _pick(when: list[tuple[str, str]], prefix: str) -> str:
    cols = []
    for n in ORDER_VALUES:
        cases = " ".join(f"WHEN {cond} THEN {src}_{n}" for cond, src in when)
        cols.append(f"CASE {cases} END AS {prefix}_{n}")
    return ", ".join(cols)


_MERGED = [("status = 'theirs'", "t"), ("status <> 'conflict'", "o")]
_MERGED_THERE = "CASE WHEN status = 'theirs' THEN t_there WHEN status <> 'conflict' THEN o_there ELSE false END"


def _m6() -> str:
    clash = " OR ".join(
        f"(o_{n} IS DISTINCT FROM b_{n} AND t_{n} IS DISTINCT FROM b_{n} AND o_{n} IS DISTINCT FROM t_{n})"
        for n in ORDER_VALUES
    )
    able = f"(status = 'conflict' AND b_there AND o_there AND t_there AND NOT ({clash}))"
    cols = ", ".join(
        f"CASE WHEN {able} THEN CASE WHEN o_{n} IS NOT DISTINCT FROM b_{n} THEN t_{n} ELSE o_{n} END"
        f" WHEN status = 'theirs' THEN t_{n} WHEN status <> 'conflict' THEN o_{n} END AS merged_{n}"
        for n in ORDER_VALUES
    )
    return (
        f"{_S} SELECT o_orderkey, CASE WHEN status IN ('ours', 'theirs') THEN 'FastForward'"
        f" WHEN status = 'identical' THEN 'IdenticalChanges' WHEN {able} THEN 'ColumnMerge' ELSE 'Conflict' END"
        f" AS resolution, {cols} FROM s WHERE status <> 'unchanged'"
    )


def _resolved(src: str) -> str:
    return oracle(
        f"{_S} SELECT o_orderkey, CASE WHEN {src}_there THEN 'U' ELSE 'D' END AS op, "
        + ", ".join(f"{src}_{n} AS resolved_{n}" for n in ORDER_VALUES)
        + " FROM s WHERE status = 'conflict'"
    )


def _retyped() -> str:
    def version(name: str, price: str, number: str) -> str:
        return (
            f"SELECT o_orderkey, o_totalprice::{price}::DECIMAL(21,4) AS price, ({number})::VARCHAR AS number FROM {{{name}}}"
        )

    exact = "9007199254740992 + o_custkey"
    same = lambda x, y: (
        f"(({x}.o_orderkey IS NULL) = ({y}.o_orderkey IS NULL) AND {x}.price IS NOT DISTINCT FROM {y}.price"
        f" AND {x}.number IS NOT DISTINCT FROM {y}.number)"
    )
    pick = lambda c: f"CASE status WHEN 'theirs' THEN t_{c} WHEN 'conflict' THEN NULL ELSE o_{c} END"
    return (
        f"WITH b AS ({version('orders', 'DECIMAL(19,2)', exact)}),"
        f" o AS ({version('ours', 'DECIMAL(21,4)', f'({exact})::DOUBLE::BIGINT')}),"
        f" t AS ({version('theirs', 'DECIMAL(17,3)', exact)}),"
        " k AS (SELECT o_orderkey FROM b UNION SELECT o_orderkey FROM o UNION SELECT o_orderkey FROM t),"
        f" j AS (SELECT k.o_orderkey, b.o_orderkey AS b_key, o.o_orderkey AS o_key, t.o_orderkey AS t_key, o.price AS o_price,"
        f" t.price AS t_price, o.number AS o_number, t.number AS t_number, CASE WHEN {same('b', 'o')} AND {same('b', 't')} THEN NULL"
        f" WHEN {same('b', 't')} THEN 'ours' WHEN {same('b', 'o')} THEN 'theirs' WHEN {same('o', 't')} THEN 'identical' ELSE 'conflict' END AS status"
        " FROM k LEFT JOIN b ON b.o_orderkey = k.o_orderkey LEFT JOIN o ON o.o_orderkey = k.o_orderkey LEFT JOIN t ON t.o_orderkey = k.o_orderkey)"
        " SELECT o_orderkey, status, CASE WHEN status = 'conflict' THEN NULL WHEN b_key IS NULL THEN 'I'"
        f" WHEN {pick('key')} IS NULL THEN 'D' ELSE 'U' END AS op, {pick('price')} AS price, {pick('number')} AS number"
        " FROM j WHERE status IS NOT NULL"
    )


_TYPES = ["BIGINT", "VARCHAR", "DOUBLE", "TIMESTAMP", "VARCHAR"]
_NULLS = ", ".join(f"NULL::{t} AS resolved_{n}" for n, t in zip(ORDER_VALUES, _TYPES))

ORACLES = {
    "m1_merge_deltas": oracle(
        f"{_J} SELECT o_orderkey, 'resolved' AS status, 'FastForward' AS resolution, "
        + _pick([("o_op IS NOT NULL", "o"), ("true", "t")], "values")
        + f" FROM j WHERE ({_STRICT_ROWS}) AND {_STRICT} = 'resolved'"
    ),
    "m2_classify_conflict": oracle(
        f"{_J} SELECT {_STRICT} AS status, {_TYPE} AS conflict_type, count(*) AS n FROM j WHERE {_STRICT_ROWS}"
        " GROUP BY 1, 2"
    ),
    "m3_conflict_payload": oracle(
        f"{_J} SELECT o_orderkey, {_TYPE} AS conflict_type, "
        + ", ".join(f"{a}_{n} AS {b}_{n}" for a, b in (("b", "ancestor"), ("o", "ours"), ("t", "theirs")) for n in ORDER_VALUES)
        + " FROM j WHERE o_op IS NOT NULL AND t_op IS NOT NULL"
    ),
    "m4_pk_key_last_wins": oracle(
        "WITH r AS (SELECT l_orderkey, l_extendedprice AS price, 'o' AS side, row_number() OVER (PARTITION BY"
        " l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC)"
        " AS rn FROM {lineitem} WHERE l_linenumber <= 4 UNION ALL"
        " SELECT l_orderkey, l_extendedprice, 't', row_number() OVER (PARTITION BY"
        " l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC)"
        " FROM {lineitem} WHERE l_linenumber >= 4),"
        " o AS (SELECT * FROM r WHERE rn = 1 AND side = 'o'), t AS (SELECT * FROM r WHERE rn = 1 AND side = 't')"
        " SELECT coalesce(o.l_orderkey, t.l_orderkey)::VARCHAR AS pk_key, CASE WHEN o.rn IS NULL OR t.rn IS NULL"
        " THEN 'resolved' ELSE 'conflict' END AS status, coalesce(o.price, t.price) AS price"
        " FROM o FULL JOIN t ON o.l_orderkey = t.l_orderkey ORDER BY 1"
    ),
    "m5_merge_rows": oracle(
        f"{_S} SELECT o_orderkey, status, CASE WHEN status = 'conflict' THEN NULL WHEN NOT b_there THEN 'I'"
        f" WHEN NOT {_MERGED_THERE} THEN 'D' ELSE 'U' END AS op, {_pick(_MERGED, 'merged')}"
        " FROM s WHERE status <> 'unchanged'"
    ),
    "m5_merge_rows_retyped": oracle(_retyped()),
    "m6_merge_columns": oracle(_m6()),
    "m7_list_conflicts": oracle(
        f"{_S} SELECT o_orderkey, "
        + ", ".join(f"{a}_{n} AS {b}_{n}" for a, b in (("b", "base"), ("o", "ours"), ("t", "theirs")) for n in ORDER_VALUES)
        + " FROM s WHERE status = 'conflict'"
    ),
    "m7_count_conflicts": oracle(
        f"{_S} SELECT count(*) FILTER (status = 'conflict') AS conflicts,"
        " count(*) FILTER (status = 'conflict') > 0 AS has_conflicts FROM s"
    ),
    "m8_resolve_ours": _resolved("o"),
    "m8_resolve_theirs": _resolved("t"),
    "m8_resolve_ancestor": _resolved("b"),
    "m8_resolve_delete": oracle(f"{_S} SELECT o_orderkey, 'D' AS op, {_NULLS} FROM s WHERE status = 'conflict'"),
    "m8_resolve_workingcopy": oracle(
        f"{_S} SELECT s.o_orderkey, CASE WHEN w.o_orderkey IS NULL THEN 'D' ELSE 'U' END AS op, "
        + ", ".join(f"w.{n} AS resolved_{n}" for n in ORDER_VALUES)
        + " FROM s LEFT JOIN {nulls_a} w ON w.o_orderkey = s.o_orderkey WHERE status = 'conflict'"
    ),
    "m9_resolve_with": oracle(
        f"{_S} SELECT s.o_orderkey, 'U' AS op, "
        + ", ".join((f"'R' AS resolved_{n}" if n == "o_orderstatus" else f"w.{n} AS resolved_{n}") for n in ORDER_VALUES)
        + " FROM s JOIN {orders} w ON w.o_orderkey = s.o_orderkey WHERE status = 'conflict'"
    ),
    "m10_finish_merge": oracle(
        f"{_S} SELECT o_orderkey, "
        + ", ".join(
            f"CASE WHEN status IN ('theirs', 'conflict') THEN t_{n} ELSE o_{n} END AS {n}" for n in ORDER_VALUES
        )
        + " FROM s WHERE CASE WHEN status IN ('theirs', 'conflict') THEN t_there ELSE o_there END"
    ),
}
