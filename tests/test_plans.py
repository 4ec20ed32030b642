"""Shapes of physical plans that the operators rely on."""

import re

import pytest
from pyspark.sql import functions as F

from checks.inputs import given
from rowtrail.operators import changes as C
from rowtrail.operators import diff as D
from rowtrail.operators import merge as M
from rowtrail.operators import address as A
from rowtrail.operators.spatial import bbox_filter


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    query = df._jdf.queryExecution()
    df.collect()
    return query.executedPlan().toString()


def exchanges(text):
    return len(re.findall(r"(?<!Reused)Exchange hashpartitioning", text))


def test_diff_has_one_exchange_per_side(spark, sf):
    text = plan(D.diff_rows(given(spark, sf, "orders"), given(spark, sf, "ours"), ["o_orderkey"]))
    assert exchanges(text) == 2 and "CartesianProduct" not in text and "BroadcastNestedLoop" not in text


def test_summary_reads_the_diff_without_more_key_shuffles(spark, sf):
    text = plan(D.diff_summary(D.diff_rows(given(spark, sf, "orders"), given(spark, sf, "ours"), ["o_orderkey"])))
    assert exchanges(text) == 2


def test_merge_exchanges_the_base_once(spark, sf):
    sides = [given(spark, sf, n) for n in ("orders", "nulls_a", "nulls_b")]
    text = final_plan(M.merge_rows(*sides, ["o_orderkey"]))
    assert "ReusedExchange" in text


def test_net_changes_combine_before_the_shuffle(spark, sf):
    text = plan(C.net_changes(given(spark, sf, "change_log")))
    assert exchanges(text) == 1 and "SortAggregate" not in text
    assert text.index("functions=[max_by(") < text.index("Exchange hashpartitioning") < text.index("partial_max_by(")


def test_small_log_leaves_the_base_unshuffled(spark, sf):
    out = C.apply_changes(given(spark, sf, "customer"), given(spark, sf, "change_log"), given(spark, sf, "current"), "c_custkey")
    text = plan(out)
    base = text[:text.index("Union") + 600]
    assert "BroadcastHashJoin" in base and "LeftAnti" in base


def test_point_lookup_is_pushed_down(spark, sf):
    text = plan(D.feature_at(given(spark, sf, "orders").select("o_orderkey", "o_totalprice"), o_orderkey=77))
    assert "PushedFilters: [EqualNullSafe(o_orderkey,77)]" in text or "EqualNullSafe(o_orderkey,77)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_directory_digests_need_no_lists(spark, sf):
    text = plan(A.dir_digests(A.with_address(given(spark, sf, "orders"), ["o_orderkey"])))
    assert "collect_list" not in text and "partial_bit_xor" in text and "SortAggregate" not in text


def test_bbox_filter_matches_text_once_per_coordinate(spark, sf):
    text = plan(bbox_filter(given(spark, sf, "customer").withColumnRenamed("c_name", "g"), "g", (0, 0, 1, 1)))
    condition = next(line for line in text.splitlines() if "Filter exists" in line)
    assert condition.count("regexp_extract") == 2


@pytest.mark.parametrize("small, listed, names", [(5000, 100_000, 1000), (3, 100_000, 1000), (3, 2, 1), (0, 1, 1)])
def test_stored_diffs_go_down_the_tree(spark, tmp_path, monkeypatch, small, listed, names):
    """The same delta whether levels are compared as a whole, by parents, or by joins; few files are opened."""
    for name, value in (("SMALL_LEVEL", small), ("MAX_LISTED_DIRS", listed), ("MAX_SCAN_NAMES", names)):
        monkeypatch.setattr(A, name, value)
    old = spark.range(40_000).selectExpr("id", "id * 2 AS v", "IF(id % 5 = 0, NULL, 'x') AS s", "CAST(NULL AS string) AS t")
    # One run of edits, one value that moves to the column beside it, one row less and one more.
    moved = F.col("id") == 30_001
    new = old.withColumns({
        "v": F.when(F.col("id").between(7000, 7100), F.col("v") + 1).otherwise(F.col("v")),
        "s": F.when(moved, None).otherwise(F.col("s")), "t": F.when(moved, F.col("s")).otherwise(F.col("t")),
    }).filter("id != 12").unionByName(old.limit(1).withColumn("id", F.lit(99_999).cast("long")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    for side, df in (("a", old), ("b", new)):
        A.write_snapshot(df, ["id"], f"{tmp_path}/{side}")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    delta = A.diff_snapshots(spark, f"{tmp_path}/a", f"{tmp_path}/b", ["id"])
    key = lambda df: sorted(map(str, df.collect()))
    assert key(delta) == key(D.diff_rows(old, new, ["id"])) and delta.count() == 104
    if listed > 2:
        assert len(delta.inputFiles()) <= 10 < 16 <= sum(len(A.read_snapshot(spark, f"{tmp_path}/{x}").inputFiles()) for x in "ab")
    same = A.diff_snapshots(spark, f"{tmp_path}/a", f"{tmp_path}/a", ["id"])
    assert not same.inputFiles() and same.count() == 0
    with pytest.MonkeyPatch.context() as patch:  # equal roots end the descent before any level is read
        patch.setattr(A, "_level", None)
        assert A.changed_leaves_stored(spark, f"{tmp_path}/a", f"{tmp_path}/a") == []


def test_a_changed_run_reads_few_rows(spark, tmp_path):
    old = spark.range(300_000).selectExpr("id", "id % 7 AS v")
    new = old.withColumn("v", F.when(F.col("id").between(150_000, 150_050), -1).otherwise(F.col("v")))
    for side, df in (("a", old), ("b", new)):
        A.write_snapshot(df, ["id"], f"{tmp_path}/{side}")
    delta = A.diff_snapshots(spark, f"{tmp_path}/a", f"{tmp_path}/b", ["id"])
    before = _rows_read(spark)
    assert delta.count() == 51
    # Two sides, pages of 4096 rows and the pages beside them.
    assert _rows_read(spark) - before <= 4 * A.PAGE_ROWS
    assert "Exchange" not in delta._jdf.queryExecution().executedPlan().toString()


def _rows_read(spark) -> int:
    """Rows that all scans have handed on so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    gateway = spark.sparkContext._gateway
    none = gateway.new_array(gateway.jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).inputRecords() for k in range(stages.size()))
