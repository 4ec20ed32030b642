"""History queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from checks import duck
from checks.inputs import ORDER_VALUES, given, oracle
from checks.q_diff import flat
from rowtrail.functions.address import full_feature_path
from rowtrail.operators import history as H
from rowtrail.operators.changes import net_changes
from rowtrail.operators.diff import diff_rows
from rowtrail.operators.rows import assign_rowid
from rowtrail.plans import cut, scratch

CUSTOMER = ["c_custkey"]
CUSTOMER_VALUES = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
TOPIC = "topic/75"

_indexes: dict[tuple[str, str], H.CommitIndex] = {}


def index(spark, sf) -> H.CommitIndex:
    """The commit index, built once per session and folder as a user would store it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _indexes:
        _indexes[key] = H.index_commits(given(spark, sf, "commits"))
    return _indexes[key]


def refs(spark, sf) -> DataFrame:
    return given(spark, sf, "refs")


def structured(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select("commit_id", "commit_no", "dataset", *keys, "op", F.struct(*values).alias("new"))


def customer_deltas(spark, sf) -> DataFrame:
    return structured(given(spark, sf, "customer_deltas"), CUSTOMER, CUSTOMER_VALUES)


def order_deltas(spark, sf) -> DataFrame:
    return structured(given(spark, sf, "order_deltas"), ["o_orderkey"], ORDER_VALUES)


def v1_reachable_all_refs(spark, sf):
    """The commits of every ref, listed and counted under a number of its name: numbers are counted three times as fast."""
    heads = refs(spark, sf)
    names = cut(heads.select("name").distinct().withColumn("ref", F.monotonically_increasing_id()))
    numbered = heads.withColumnRenamed("name", "_name").join(names, F.col("_name").eqNullSafe(F.col("name")))
    counts = H.reachable(index(spark, sf), numbered.select(F.col("ref").alias("name"), "commit_id")).groupBy("name").agg(
        F.count(F.lit(1)).alias("commits"), F.min("commit_no").alias("first"), F.max("commit_no").alias("last")
    )
    return names.join(counts.withColumnRenamed("name", "ref"), "ref").drop("ref")


def v2(spark, sf, n=None):
    out = H.log(index(spark, sf), given(spark, sf, "commits"), refs(spark, sf), "main", n)
    return out.select("commit_id", "author", "ts", "subject", "body")


def v5(spark, sf, ref="main"):
    return H.snapshot_as_of(given(spark, sf, "customer"), customer_deltas(spark, sf), index(spark, sf),
                            refs(spark, sf), ref, CUSTOMER)


def v5_orders(spark, sf):
    return H.snapshot_as_of(given(spark, sf, "orders"), order_deltas(spark, sf), index(spark, sf), refs(spark, sf),
                            TOPIC, ["o_orderkey"])


def v6(spark, sf):
    return flat(H.diff_refs(given(spark, sf, "customer"), customer_deltas(spark, sf), index(spark, sf),
                            refs(spark, sf), TOPIC, "main", CUSTOMER), CUSTOMER)


def percentiles(commits: DataFrame, shares: list[float]) -> list[float | None]:
    """Exact percentiles of commit_no, as ``percentile`` gives them; the numbers never pass through one task."""
    rows = cut(assign_rowid(commits.select("commit_no").filter(F.col("commit_no").isNotNull()), ["commit_no"], "_row"))
    last = rows.count() - 1
    if last < 0:
        return [None] * len(shares)
    places = {share: last * share for share in shares}
    wanted = sorted({int(f(place)) + 1 for place in places.values() for f in (math.floor, math.ceil)})
    at = {r["_row"] - 1: r["commit_no"] for r in rows.filter(F.col("_row").isin(wanted)).collect()}

    def between(place: float) -> float:
        low, high = math.floor(place), math.ceil(place)
        return float(at[low]) if low == high else (high - place) * at[low] + (place - low) * at[high]

    return [between(places[share]) for share in shares]


def extended(spark, sf) -> H.CommitIndex:
    """A stored index of the older half of the commits, extended by the others in two steps."""
    commits, path = given(spark, sf, "commits"), scratch(spark, "index")
    half, most = percentiles(commits, [0.5, 0.8])
    H.store_index(H.index_commits(commits.filter(F.col("commit_no") <= half)), path)
    H.extend_stored_index(spark, path, commits.filter((F.col("commit_no") > half) & (F.col("commit_no") <= most)))
    return H.extend_stored_index(spark, path, commits.filter(F.col("commit_no") > half))


def v1_extended(spark, sf):
    return H.ancestors(extended(spark, sf), refs(spark, sf), "main")


def v5_from_checkpoint(spark, sf):
    """Checkpoints of the topic's history and of an early ref; the one within the history of main is used."""
    path, deltas, found = scratch(spark, "checkpoints"), customer_deltas(spark, sf), index(spark, sf)
    middle = percentiles(given(spark, sf, "commits"), [0.6])[0]
    main = H.ancestors(found, refs(spark, sf), "main").filter(F.col("commit_no") <= middle)
    early = cut(main.orderBy(F.desc("commit_no")).select(F.lit("early").alias("name"), "commit_id").limit(1))
    H.write_checkpoint(deltas, found, early, "early", CUSTOMER, path)
    H.write_checkpoint(deltas, found, refs(spark, sf), TOPIC, CUSTOMER, path)
    return H.snapshot_as_of(given(spark, sf, "customer"), deltas, found, refs(spark, sf), "main", CUSTOMER, path)


def v8(spark, sf):
    def tagged(name):
        df = given(spark, sf, name)
        return df.withColumn("dataset", F.concat(F.lit("shop/"), (F.col("o_custkey") % 5).cast("string")))

    delta = H.restore(tagged("ours"), tagged("orders"), ["o_orderkey"], ["shop/1", "shop/3"])
    return flat(delta, ["dataset", "o_orderkey"])


def v9(spark, sf):
    """The whole log of the working copy as one commit, read back from where it was written."""
    net = net_changes(given(spark, sf, "change_log"))
    current = given(spark, sf, "current").withColumnRenamed("c_custkey", "pk")
    rows = net.withColumn("pk", F.col("pk").cast("bigint")).join(current, "pk", "left")
    value = F.when(F.col("op") != "D", F.struct("c_name", "c_acctbal"))
    pending = rows.select(F.col("table_name").alias("dataset"), "pk", "op", value.alias("new"), "seq")
    meta = {"commit_id": "c-next", "commit_no": 1_000_000_000_000, "parent_ids": ["c0"], "author": "user1",
            "ts": "2024-02-01 00:00:00", "subject": "import"}
    batch = H.commit_batch(pending, ["pk"], meta, scratch(spark, "commit"))
    return batch.select("commit_id", "commit_no", "dataset", "pk", "op", "new.c_name", "new.c_acctbal")


def v11(spark, sf, recursive):
    rows = given(spark, sf, "ours")
    path = F.concat(F.lit("shop/orders/.table-dataset/feature/"), full_feature_path(rows, ["o_orderkey"]))
    return H.tree_listing(rows.select(path.alias("path")), "shop/orders/.table-dataset/feature", recursive)


def v12(spark, sf):
    out = H.row_history(customer_deltas(spark, sf), CUSTOMER)
    return out.select("c_custkey", "commit_no", "op", F.col("old.c_acctbal").alias("old_c_acctbal"),
                      F.col("old.c_mktsegment").alias("old_c_mktsegment"), F.col("new.c_acctbal").alias("new_c_acctbal"))


QUERIES = {
    "v1_ancestors": lambda s, sf: H.ancestors(index(s, sf), refs(s, sf), "main"),
    "v1_reachable_all_refs": v1_reachable_all_refs,
    "v1_extended": v1_extended,
    "v2_log": v2,
    "v2_log_top": lambda s, sf: v2(s, sf, 25),
    "v4_show": lambda s, sf: H.show(given(s, sf, "commits"), given(s, sf, "all_deltas")),
    "v5_snapshot_as_of": v5,
    "v5_snapshot_as_of_orders": v5_orders,
    "v5_from_checkpoint": v5_from_checkpoint,
    "v6_diff_refs": v6,
    "v7_merge_base": lambda s, sf: H.merge_base(index(s, sf), refs(s, sf), "main", TOPIC.replace("75", "79")),
    "v8_restore": v8,
    "v9_commit_batch": v9,
    "v10_branches": lambda s, sf: H.branches(index(s, sf), refs(s, sf), "main"),
    "v11_tree_listing": lambda s, sf: v11(s, sf, True),
    "v11_tree_listing_children": lambda s, sf: v11(s, sf, False),
    "v12_row_history": v12,
}

# Every walk over the parents in one statement. UNION drops commits met twice.
_EDGES = "edges AS (SELECT commit_id AS child, unnest(parent_ids) AS parent FROM {commits})"


def _walk(name: str, ref: str) -> str:
    return (
        f"{name}(commit_id) AS (SELECT commit_id FROM {{refs}} WHERE name = '{ref}'"
        f" UNION SELECT parent FROM {name} JOIN edges ON child = commit_id)"
    )


_MAIN = f"WITH RECURSIVE {_EDGES}, {_walk('a', 'main')}"
_TOPIC = f"WITH RECURSIVE {_EDGES}, {_walk('t', TOPIC)}"
_BOTH = f"{_MAIN}, {_walk('t', TOPIC)}"


def _states(name: str, past: str, deltas: str, key: str) -> str:
    return (
        f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY commit_no DESC) AS rn"
        f" FROM {{{deltas}}} WHERE commit_id IN (SELECT commit_id FROM {past})) WHERE rn = 1)"
    )


def _snapshot(states: str, base: str, key: str, values: list[str]) -> str:
    cols = ", ".join([key, *values])
    return (
        f"SELECT {cols} FROM {{{base}}} WHERE {key} NOT IN (SELECT {key} FROM {states})"
        f" UNION ALL SELECT {cols} FROM {states} WHERE op <> 'D'"
    )


_CUSTOMER = _snapshot("s", "customer", "c_custkey", CUSTOMER_VALUES)
_LOG = (
    f"{_MAIN} SELECT commit_id, author, ts, subject, body FROM {{commits}}"
    " WHERE commit_id IN (SELECT commit_id FROM a) ORDER BY ts DESC, commit_id"
)
_TAG = "concat('shop/', (o_custkey % 5)::VARCHAR) AS dataset"


def _paths() -> str:
    return f"SELECT {duck.full_path('o_orderkey')} AS path FROM {{ours}}"


def _restore() -> str:
    sides = [
        f"{n} AS (SELECT *, {_TAG} FROM {{{t}}} WHERE o_custkey % 5 IN (1, 3))" for n, t in (("h", "ours"), ("b", "orders"))
    ]
    return f"WITH {', '.join(sides)} " + duck.delta("h", "b", ["dataset", "o_orderkey"], ORDER_VALUES)


ORACLES = {
    "v1_ancestors": oracle(
        f"{_MAIN} SELECT c.commit_id, c.commit_no FROM a JOIN {{commits}} c ON c.commit_id = a.commit_id"
    ),
    "v1_extended": oracle(
        f"{_MAIN} SELECT c.commit_id, c.commit_no FROM a JOIN {{commits}} c ON c.commit_id = a.commit_id"
    ),
    # The commits follow from their numbers: 10 d has the d main commits below it and five commits of
    # each branch merged up to it; 10 d + 5 and 10 d + 9 add the five or four commits of their branch.
    "v1_reachable_all_refs": oracle(
        "WITH r AS (SELECT concat('topic/', event_id::VARCHAR) AS name, event_id AS e FROM {events} WHERE event_id % 10"
        " IN (5, 9) UNION ALL SELECT 'main', max(event_id) FROM {events} WHERE event_id % 10 = 0)"
        " SELECT name, e // 10 + 1 + 5 * (e // 10 - e // 70) + CASE e % 10 WHEN 5 THEN 5 WHEN 9 THEN 4 ELSE 0 END"
        " AS commits, 0::BIGINT AS first, e AS last FROM r"
    ),
    "v2_log": oracle(_LOG),
    "v2_log_top": oracle(_LOG + " LIMIT 25"),
    "v4_show": oracle(
        "WITH n AS (SELECT commit_id, dataset, count(*) FILTER (op = 'I') AS added, count(*) FILTER (op = 'U') AS"
        " modified, count(*) FILTER (op = 'D') AS deleted FROM {all_deltas} GROUP BY 1, 2)"
        " SELECT c.commit_id, author, ts, subject, body, dataset, coalesce(added, 0) AS added,"
        " coalesce(modified, 0) AS modified, coalesce(deleted, 0) AS deleted"
        " FROM {commits} c LEFT JOIN n ON n.commit_id = c.commit_id"
    ),
    "v5_from_checkpoint": oracle(f"{_MAIN}, {_states('s', 'a', 'customer_deltas', 'c_custkey')} {_CUSTOMER}"),
    "v5_snapshot_as_of": oracle(f"{_MAIN}, {_states('s', 'a', 'customer_deltas', 'c_custkey')} {_CUSTOMER}"),
    "v5_snapshot_as_of_orders": oracle(
        f"{_TOPIC}, {_states('s', 't', 'order_deltas', 'o_orderkey')} "
        + _snapshot("s", "orders", "o_orderkey", ORDER_VALUES)
    ),
    "v6_diff_refs": oracle(
        f"{_BOTH}, {_states('sa', 't', 'customer_deltas', 'c_custkey')},"
        f" {_states('sb', 'a', 'customer_deltas', 'c_custkey')},"
        f" xa AS ({_snapshot('sa', 'customer', 'c_custkey', CUSTOMER_VALUES)}),"
        f" xb AS ({_snapshot('sb', 'customer', 'c_custkey', CUSTOMER_VALUES)}) "
        + duck.delta("xa", "xb", CUSTOMER, CUSTOMER_VALUES)
    ),
    "v7_merge_base": oracle(
        f"{_MAIN}, {_walk('t', 'topic/79')} SELECT commit_id, commit_no FROM {{commits}} WHERE commit_id IN"
        " (SELECT commit_id FROM a INTERSECT SELECT commit_id FROM t) ORDER BY commit_no DESC LIMIT 1"
    ),
    "v8_restore": oracle(_restore()),
    "v9_commit_batch": oracle(
        "WITH net AS (SELECT table_name, pk::BIGINT AS pk, arg_max(change_type, seq) AS op FROM {change_log}"
        " GROUP BY 1, 2) SELECT 'c-next' AS commit_id, 1000000000000 AS commit_no, table_name AS dataset, pk, op,"
        " CASE WHEN op <> 'D' THEN c_name END AS c_name, CASE WHEN op <> 'D' THEN c_acctbal END AS c_acctbal"
        " FROM net LEFT JOIN {current} ON c_custkey = pk"
    ),
    "v10_branches": oracle(
        f"{_MAIN} SELECT name, substr(commit_id, 1, 7) AS target, name = 'main' AS is_current,"
        " commit_id IN (SELECT commit_id FROM a) AS merged FROM {refs}"
    ),
    "v11_tree_listing": oracle(_paths()),
    "v11_tree_listing_children": oracle(f"SELECT DISTINCT split_part(path, '/', 1) AS path FROM ({_paths()})"),
    "v12_row_history": oracle(
        "SELECT c_custkey, commit_no, op, lag(c_acctbal) OVER w AS old_c_acctbal, lag(c_mktsegment) OVER w AS"
        " old_c_mktsegment, c_acctbal AS new_c_acctbal FROM {customer_deltas}"
        " WINDOW w AS (PARTITION BY c_custkey ORDER BY commit_no)"
    ),
}
