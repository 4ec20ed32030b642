"""Change-log queries, batch and streaming."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from checks import duck
from checks.inputs import ORDER_VALUES, given, oracle, table
from checks.q_diff import flat
from rowtrail.operators import changes as C
from rowtrail.plans.lineage import scratch
from rowtrail.streaming import feed

KEY = "c_custkey"
VALUES = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def log(spark, sf) -> DataFrame:
    return given(spark, sf, "change_log")


def c4(spark, sf):
    return C.apply_changes(given(spark, sf, "customer"), log(spark, sf), given(spark, sf, "current"), KEY)


def _mixed_log(spark, sf) -> DataFrame:
    """The log with each key in several tables."""
    return log(spark, sf).withColumn("table_name", F.concat(F.lit("t"), (F.col("seq") % 3).cast("string")))


def c4_one_table(spark, sf):
    return C.apply_changes(given(spark, sf, "customer"), _mixed_log(spark, sf), given(spark, sf, "current"), KEY, "t1")


def _tagged(df: DataFrame, key: str = KEY) -> DataFrame:
    return df.withColumn("table_name", F.concat(F.lit("t"), (F.col(key) % 3).cast("string")))


def _sync(spark, sf):
    base = _tagged(given(spark, sf, "customer"))
    return C.selective_sync(base, log(spark, sf), _tagged(given(spark, sf, "current")), KEY, ["t1", "t2"])


def _stream(spark, sf) -> DataFrame:
    """The event file as a stream of log rows."""
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    kind = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    return events.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("table_name"),
        F.col("user_id").cast("string").alias("pk"),
        kind.alias("change_type"),
    )


def c8(spark, sf):
    folder = scratch(spark, "status")
    feed.stream_status(_stream(spark, sf), f"{folder}/out", f"{folder}/offsets").awaitTermination()
    return feed.read_status(spark, f"{folder}/out")


def c9(spark, sf):
    folder = scratch(spark, "apply")
    current = functools.partial(given, spark, sf, "current")
    feed.stream_apply(_stream(spark, sf), current, KEY, f"{folder}/out", f"{folder}/offsets").awaitTermination()
    return feed.read_applied(given(spark, sf, "customer"), f"{folder}/out", KEY)


def c10(spark, sf):
    return C.fingerprint_changes(given(spark, sf, "orders"), given(spark, sf, "ours"), ["o_orderkey"])


def c7(spark, sf):
    return flat(C.diff_working(given(spark, sf, "nulls_a"), given(spark, sf, "ours"), ["o_orderkey"]), ["o_orderkey"])


QUERIES = {
    "c1_tracked_changes": lambda s, sf: C.tracked_changes(log(s, sf), "t1"),
    "c2_status": lambda s, sf: C.status(log(s, sf)),
    "c3_net_changes": lambda s, sf: C.net_changes(log(s, sf)),
    "c4_apply_changes": c4,
    "c4_apply_changes_one_table": c4_one_table,
    "c5_clear_changes": lambda s, sf: C.clear_changes(log(s, sf), "t1"),
    "c6_selective_sync": lambda s, sf: _sync(s, sf)[0],
    "c6_selective_sync_pending": lambda s, sf: _sync(s, sf)[1],
    "c7_diff_working": c7,
    "c8_stream_status": c8,
    "c9_stream_apply": c9,
    "c10_fingerprint_changes": c10,
    "x10_upsert_replace": lambda s, sf: C.upsert_by_key(given(s, sf, "ours"), given(s, sf, "theirs"), ["o_orderkey"]),
    "x10_upsert_ignore": lambda s, sf: C.upsert_by_key(
        given(s, sf, "ours"), given(s, sf, "theirs"), ["o_orderkey"], "ignore"
    ),
}

_STATUS = (
    "SELECT table_name, count(*) FILTER (change_type = 'U') AS modified, count(*) FILTER (change_type = 'I') AS new,"
    " count(*) FILTER (change_type = 'D') AS deleted, count(*) AS total FROM {change_log} GROUP BY table_name"
)
_NET = "SELECT table_name, pk, arg_max(change_type, seq) AS op, max(seq) AS seq FROM {change_log} GROUP BY table_name, pk"


def _applied(where: str = "true", tagged: bool = False) -> str:
    tag = ", concat('t', (c_custkey % 3)::VARCHAR) AS table_name" if tagged else ""
    return (
        f"WITH net AS ({_NET}) SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment{tag} FROM {{customer}}"
        f" WHERE c_custkey NOT IN (SELECT pk::BIGINT FROM net WHERE {where})"
        f" UNION ALL SELECT c_custkey, c_name, NULL, c_acctbal, NULL{tag} FROM {{current}}"
        f" WHERE c_custkey IN (SELECT pk::BIGINT FROM net WHERE op <> 'D' AND {where})"
    )


_PLAIN = ", ".join(["o_orderkey", *ORDER_VALUES])

ORACLES = {
    "c1_tracked_changes": oracle(
        "SELECT seq, pk, change_type AS op FROM {change_log} WHERE table_name = 't1' ORDER BY seq"
    ),
    "c2_status": oracle(_STATUS),
    "c3_net_changes": oracle(_NET),
    "c4_apply_changes": oracle(_applied()),
    "c4_apply_changes_one_table": oracle(
        _applied().replace("FROM {change_log} GROUP BY", "FROM {change_log} WHERE seq % 3 = 1 GROUP BY")
    ),
    "c5_clear_changes": oracle("SELECT * FROM {change_log} WHERE table_name <> 't1'"),
    "c6_selective_sync": oracle(_applied("table_name IN ('t1', 't2')", True)),
    "c6_selective_sync_pending": oracle("SELECT * FROM {change_log} WHERE table_name NOT IN ('t1', 't2')"),
    "c7_diff_working": oracle(duck.delta("{nulls_a}", "{ours}", ["o_orderkey"], ORDER_VALUES)),
    "c8_stream_status": oracle(_STATUS),
    "c9_stream_apply": oracle(_applied()),
    "c10_fingerprint_changes": oracle(
        f"SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, {duck.op('o_orderkey')} AS op"
        " FROM {orders} a FULL JOIN {ours} b ON a.o_orderkey = b.o_orderkey"
        f" WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR {duck.differs(ORDER_VALUES)}"
    ),
    "x10_upsert_replace": oracle(
        f"SELECT {_PLAIN} FROM {{theirs}} UNION ALL SELECT {_PLAIN} FROM {{ours}} WHERE o_orderkey NOT IN"
        " (SELECT o_orderkey FROM {theirs})"
    ),
    "x10_upsert_ignore": oracle(
        f"SELECT {_PLAIN} FROM {{ours}} UNION ALL SELECT {_PLAIN} FROM {{theirs}} WHERE o_orderkey NOT IN"
        " (SELECT o_orderkey FROM {ours})"
    ),
}
