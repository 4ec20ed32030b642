"""Benchmark of the headline operators; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of local cores. Every query runs
once to warm up and then three times; the median counts. Results are consumed in full by a no-op
sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from checks import q_changes, q_history, q_merge
from checks.inputs import given
from rowtrail import local_session
from rowtrail.operators import address as A
from rowtrail.operators import changes as C
from rowtrail.operators import history as H
from rowtrail.operators import merge as M
from rowtrail.operators.diff import diff_rows
from rowtrail.plans import cut, scratch

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
KEY = ["o_orderkey"]
LINE = ["l_orderkey", "l_linenumber"]


def edited(lines, per_mille: int):
    """``lines`` with this share of keys changed, in runs of neighbouring keys as edits come."""
    run = F.pmod(F.xxhash64(F.floor(F.col("l_orderkey") / 64)), F.lit(1000)) < per_mille
    return lines.withColumn("l_quantity", F.when(run, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run, repeat: int = 3) -> float:
    run()
    times = []
    for _ in range(repeat):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 4)


def main() -> None:
    spark = local_session(CPUS)
    orders, ours, theirs = (given(spark, SF_DIR, n) for n in ("orders", "ours", "theirs"))
    lines = cut(given(spark, SF_DIR, "keyed_lineitem"))
    changed_lines = cut(lines.withColumn("l_quantity", F.when(F.col("l_partkey") % 50 == 0, 0.0).otherwise(F.col("l_quantity"))))
    index = q_history.index(spark, SF_DIR)
    refs, deltas = cut(q_history.refs(spark, SF_DIR)), q_history.customer_deltas(spark, SF_DIR)
    customer = given(spark, SF_DIR, "customer")

    queries = {
        "d1_diff_rows": lambda: consume(diff_rows(orders, ours, KEY)),
        "d1_diff_rows_lineitem": lambda: consume(diff_rows(lines, changed_lines, LINE)),
        "c10_fingerprint_changes": lambda: consume(C.fingerprint_changes(orders, ours, KEY)),
        "m1_merge_deltas": lambda: consume(q_merge.strict(spark, SF_DIR)),
        "m5_merge_rows": lambda: consume(M.merge_rows(orders, ours, theirs, KEY)),
        "m6_merge_columns": lambda: consume(M.merge_columns(orders, ours, theirs, KEY)),
        "c3_net_changes": lambda: consume(C.net_changes(q_changes.log(spark, SF_DIR))),
        "c4_apply_changes": lambda: consume(q_changes.c4(spark, SF_DIR)),
        "v5_snapshot_as_of": lambda: consume(H.snapshot_as_of(customer, deltas, index, refs, "main", ["c_custkey"])),
        "v12_row_history": lambda: consume(H.row_history(deltas, ["c_custkey"])),
        "h7_dir_digests": lambda: consume(A.dir_digests(A.with_address(orders, KEY))),
    }
    # The claim that can be checked: a diff of stored snapshots costs what changed, not what is there.
    folder = scratch(spark, "bench")
    store = lambda df, name: A.write_snapshot(df, LINE, f"{folder}/{name}", scheme="int")
    store(lines, "base")
    for per_mille in (1, 10, 100):
        name = f"edit{per_mille}"
        store(edited(lines, per_mille), name)
        queries[f"h9_diff_snapshots_{per_mille / 10:g}pct"] = lambda n=name: consume(
            A.diff_snapshots(spark, f"{folder}/base", f"{folder}/{n}", LINE)
        )
        plain, base = A.read_snapshot(spark, f"{folder}/{name}"), A.read_snapshot(spark, f"{folder}/base")
        queries[f"d1_same_data_{per_mille / 10:g}pct"] = lambda a=base, b=plain: consume(diff_rows(a, b, LINE, True))

    only = sys.argv[1:]
    results = {n: timed(q) for n, q in queries.items() if not only or any(n.startswith(o) for o in only)}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(results.values()), 3), "unit": "sec",
                      "queries": results, "sf": SF_DIR.rsplit("sf", 1)[-1], "cpus": CPUS}))


if __name__ == "__main__":
    main()
