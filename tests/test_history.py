"""History operators against walks in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from checks import q_history as Q
from checks.inputs import given
from rowtrail.operators import history as H


def commits_frame(spark, parents):
    rows = [(f"c{i}", i, [f"c{p}" for p in ps], "me", f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", f"s{i}", "")
            for i, ps in parents.items()]
    return spark.createDataFrame(rows, "commit_id string, commit_no long, parent_ids array<string>, author string,"
                                       " ts string, subject string, body string")


def walk(parents, start):
    seen, todo = set(), [start]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += parents[n]
    return seen


def random_dag(seed, n=160):
    rnd = random.Random(seed)
    parents = {0: []}
    for i in range(1, n):
        roll = rnd.random()
        first = i - 1 if roll < 0.6 else rnd.randrange(i)
        others = rnd.sample(range(i), min(i, 1 if roll > 0.7 else 0)) if roll > 0.5 else []
        parents[i] = [first] + [o for o in others if o != first]
        if roll > 0.97:
            parents[i] = []
    return parents


@pytest.mark.parametrize("seed", [1, 2])
def test_reachability_of_random_histories(spark, seed):
    parents = random_dag(seed)
    index = H.index_commits(commits_frame(spark, parents))
    refs = spark.createDataFrame([(f"r{i}", f"c{i}") for i in parents], "name string, commit_id string")
    got = {(r.name, r.commit_no) for r in H.reachable(index, refs).collect()}
    assert got == {(f"r{i}", p) for i in parents for p in walk(parents, i)}
    base = H.merge_base(index, refs, "r150", "r141").first()
    common = walk(parents, 150) & walk(parents, 141)
    assert base.commit_no == (max(common) if common else None)


def test_long_and_criss_cross_histories(spark):
    """A line of 700 commits next to two lines that merge each other again and again."""
    parents = {0: []} | {i: [i - 1] for i in range(1, 700)}
    for i in range(700, 760):
        parents[i] = [i - 2 if i > 701 else 0] + ([i - 1] if i % 6 == 0 else [])
    index = H.index_commits(commits_frame(spark, parents))
    refs = spark.createDataFrame([("long", "c699"), ("x", "c759"), ("y", "c758")], "name string, commit_id string")
    got = {}
    for r in H.reachable(index, refs).collect():
        got.setdefault(r.name, set()).add(r.commit_no)
    assert got == {"long": walk(parents, 699), "x": walk(parents, 759), "y": walk(parents, 758)}


def test_all_registered_refs_by_brute_force(spark, sf):
    parents = {r.commit_no: [int(p[1:]) for p in r.parent_ids or []]
               for r in given(spark, sf, "commits").select("commit_no", "parent_ids").collect()}
    got = {r.name: (r.commits, r.first, r.last) for r in Q.QUERIES["v1_reachable_all_refs"](spark, sf).collect()}
    want = {}
    for r in Q.refs(spark, sf).collect():
        seen = walk(parents, int(r.commit_id[1:]))
        want[r.name] = (len(seen), min(seen), max(seen))
    assert got == want


def test_unknown_ref_has_no_history(spark, sf):
    assert H.ancestors(Q.index(spark, sf), Q.refs(spark, sf), "nowhere").isEmpty()


def test_row_history_across_runs(spark):
    rows = [("hot", n, "U", (n,)) for n in range(0, 3000, 3)] + [("a", 5, "I", (5,)), ("a", 2999, "D", None), (None, 7, "I", (7,))]
    deltas = spark.createDataFrame(rows, "k string, commit_no long, op string, new struct<v:long>")
    got = {(r.k, r.commit_no): r.old and r.old.v for r in H.row_history(deltas, ["k"]).collect()}
    want = {("hot", n): n - 3 if n else None for n in range(0, 3000, 3)}
    assert got == want | {("a", 5): None, ("a", 2999): 5, (None, 7): None}


def test_commit_batch(spark, tmp_path):
    meta = {"commit_id": "c9", "commit_no": 9, "parent_ids": ["c8"], "author": "me", "ts": "2024-01-01", "subject": "s"}
    pending = spark.createDataFrame(
        [("parks", 1, "I", ("a",), 1), ("parks", 1, "U", ("b",), 2), ("roads", 2, "D", None, 3)],
        "dataset string, id long, op string, new struct<v:string>, seq long")
    for _ in range(2):
        batch = H.commit_batch(pending, ["id"], meta, str(tmp_path), ["par"])
        assert [(r.dataset, r.id, r.op, r.new.v) for r in batch.collect()] == [("parks", 1, "U", "b")]
    assert spark.read.parquet(f"{tmp_path}/commits").count() == 1
    with pytest.raises(ValueError, match="nothing to commit"):
        H.commit_batch(pending, ["id"], meta, None, ["sea"])


def test_diff_refs_equals_diff_of_snapshots(spark, sf):
    from rowtrail.operators.diff import diff_rows
    a, b = Q.v5(spark, sf, Q.TOPIC), Q.v5(spark, sf, "main")
    want = diff_rows(a, b, Q.CUSTOMER)
    got = H.diff_refs(given(spark, sf, "customer"), Q.customer_deltas(spark, sf), Q.index(spark, sf), Q.refs(spark, sf),
                      Q.TOPIC, "main", Q.CUSTOMER)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_row_history_of_one_hot_key_with_sparse_numbers(spark):
    """A key of all rows and numbers far apart still spread over several ranges."""
    deltas = spark.range(4000).selectExpr("1L AS k", "id * 1000000007 AS commit_no", "'U' AS op", "named_struct('v', id) AS new")
    rows = H.row_history(deltas, ["k"])
    assert sorted((r.new.v, r.old.v if r.old else None) for r in rows.collect()) == [(i, i - 1 if i else None) for i in range(4000)]


def test_merges_that_list_a_fresh_branch_first(spark, monkeypatch):
    """Three hundred merges with an orphan commit as first parent are searched in a few rounds."""
    parents = {0: []}
    for k in range(1, 301):
        parents[2 * k - 1] = []
        parents[2 * k] = [2 * k - 1, 2 * k - 2]
    index = H.index_commits(commits_frame(spark, parents))
    rounds, cut = [], H.cut
    monkeypatch.setattr(H, "cut", lambda df: rounds.append(1) or cut(df))
    refs = spark.createDataFrame([("main", "c600"), ("half", "c300")], "name string, commit_id string")
    got = {(r.name, r.commit_no) for r in H.reachable(index, refs).collect()}
    assert got == {(name, p) for name, start in (("main", 600), ("half", 300)) for p in walk(parents, start)}
    assert len(rounds) <= 5


@pytest.mark.parametrize("seed, cuts", [(3, [60]), (4, [1, 80, 81]), (5, [120, 150])])
def test_extended_indexes_reach_what_a_rebuilt_one_does(spark, tmp_path, seed, cuts):
    parents = random_dag(seed)
    whole, path = commits_frame(spark, parents), str(tmp_path / "index")
    H.store_index(H.index_commits(whole.filter(F.col("commit_no") < cuts[0])), path)
    before = {r.commit_id: (r.chain, r.pos) for r in H.load_index(spark, path).places.collect()}
    for low, high in zip(cuts, [*cuts[1:], len(parents)], strict=True):
        # Known commits are handed in again, and change nothing.
        index = H.extend_stored_index(spark, path, whole.filter((F.col("commit_no") >= low - 3) & (F.col("commit_no") < high)))
    places = {r.commit_id: (r.chain, r.pos) for r in index.places.collect()}
    assert len(places) == len(parents) == index.places.count() and before.items() <= places.items()
    spot = {v: int(k[1:]) for k, v in places.items()}
    assert len(spot) == len(places)
    for (chain, pos), commit in spot.items():  # a chain follows parent links
        assert pos == 0 or spot[chain, pos - 1] in parents[commit]
    refs = spark.createDataFrame([(f"r{i}", f"c{i}") for i in parents], "name string, commit_id string")
    got = {(r.name, r.commit_no) for r in H.reachable(index, refs).collect()}
    assert got == {(f"r{i}", p) for i in parents for p in walk(parents, i)}


def test_a_line_that_grows_stays_one_chain(spark):
    parents = {0: []} | {i: [i - 1] for i in range(1, 90)}
    whole = commits_frame(spark, parents)
    index = H.index_commits(whole.filter("commit_no < 50"))
    for low in (50, 70):
        index = H.extend_index(index, whole.filter(f"commit_no >= {low} AND commit_no < {low + 20}"))
    assert index.places.select("chain").distinct().count() == 1 and index.crossings.isEmpty()


def test_merge_bases_and_branches_by_labels(spark):
    parents = random_dag(7, 120)
    index = H.index_commits(commits_frame(spark, parents))
    refs = spark.createDataFrame([(f"r{i}", f"c{i}") for i in parents] + [("lost", "none")], "name string, commit_id string")
    for a, b in ((119, 118), (60, 119), (5, 5), (90, 91)):
        common = walk(parents, a) & walk(parents, b)
        got = H.merge_base(index, refs, f"r{a}", f"r{b}")
        assert got.first().commit_no == (max(common) if common else None)
    got = {r.name: r.merged for r in H.branches(index, refs, "r119").collect()}
    assert got == {f"r{i}": i in walk(parents, 119) for i in parents} | {"lost": False}


def test_snapshots_from_checkpoints_read_later_deltas_only(spark, tmp_path):
    rng, parents = random.Random(6), random_dag(6, 100)
    index = H.index_commits(commits_frame(spark, parents))
    refs = spark.createDataFrame([(f"r{i}", f"c{i}") for i in parents], "name string, commit_id string")
    rows = [(f"c{i}", i, "t", k, rng.choice("IUUD"), (i,)) for i in parents for k in rng.sample(range(30), 4)]
    rows = [r if r[4] != "D" else (*r[:5], None) for r in rows]
    stored = f"{tmp_path}/deltas"
    deltas = spark.createDataFrame(rows, "commit_id string, commit_no long, dataset string, id long, op string, new struct<v:long>")
    deltas.repartition("commit_no").write.partitionBy("commit_no").parquet(stored)
    deltas = spark.read.parquet(stored).withColumn("commit_no", F.col("commit_no").cast("long"))
    base = spark.createDataFrame([(k, -1) for k in range(20)], "id long, v long")
    path = f"{tmp_path}/checkpoints"
    for ref in ("r40", "r70", "r85"):
        H.write_checkpoint(deltas, index, refs, ref, ["id"], path)
    for ref in (99, 86, 40, 3):
        plain = H.snapshot_as_of(base, deltas, index, refs, f"r{ref}", ["id"])
        quick = H.snapshot_as_of(base, deltas, index, refs, f"r{ref}", ["id"], path)
        key = lambda df: sorted(map(tuple, df.collect()))
        want = {k: -1 for k in range(20)}
        for _, no, _, k, op, new in sorted(rows, key=lambda r: r[1]):
            if no in walk(parents, ref):
                want.pop(k, None)
                if op != "D":
                    want[k] = new[0]
        assert key(plain) == key(quick) == sorted(want.items())
    # Of the deltas, only commits beyond the checkpoint are listed for the scan.
    states = H.states_as_of(deltas, index, refs, "r40", ["id"], path)
    assert not [f for f in states.inputFiles() if "/deltas/" in f]


def test_no_row_is_sorted_to_find_the_last_one(spark, sf):
    from rowtrail.operators import merge as M

    last = H.last_rows(Q.customer_deltas(spark, sf), ["c_custkey"], "commit_no")
    states = H.states_as_of(Q.customer_deltas(spark, sf), Q.index(spark, sf), Q.refs(spark, sf), "main", ["c_custkey"])
    delta = spark.createDataFrame([(1, "U", ("a",), ("b",), 1), (1, "U", ("a",), ("c",), 2)], "id long, op string, old struct<v:string>, new struct<v:string>, seq long")
    merged = M.merge_deltas(delta, delta.limit(0), ["id"], "seq")
    assert [r["values"]["v"] for r in merged.collect()] == ["c"]
    for df in (last, states, merged):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "functions=[max(" in text and "max_by" not in text


def test_blocks_hold_any_history(spark, monkeypatch):
    """Lines, merges and children that lie in other blocks, equal numbers among them."""
    monkeypatch.setattr(H, "BLOCK", 16)
    monkeypatch.setattr(H, "SPAN", 8)
    monkeypatch.setattr("rowtrail.plans.joins.fits", lambda *_: False)
    parents = random_dag(9, 60)
    commits = commits_frame(spark, parents).withColumn("commit_no", F.floor(F.col("commit_no") / 3))
    index = H.index_commits(commits)
    spot = {(r.chain, r.pos): int(r.commit_id[1:]) for r in index.places.collect()}
    assert sorted(spot.values()) == sorted(parents)
    assert all(pos == 0 or spot[chain, pos - 1] in parents[commit] for (chain, pos), commit in spot.items())
    refs = spark.createDataFrame([(f"r{i}", f"c{i}") for i in parents], "name string, commit_id string")
    got = sorted((r.name, int(r.commit_id[1:])) for r in H.reachable(index, refs).collect())
    assert got == sorted((f"r{i}", p) for i in parents for p in walk(parents, i))
    plan = H.reachable(index, refs)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan  # no row is repeated for chains that might be hot


def test_rows_written_for_an_index_do_not_grow_with_the_longest_line(spark, monkeypatch):
    """One line of 2,000 commits: each is written a few times, not once per doubling step."""
    monkeypatch.setattr(H, "BLOCK", 250, raising=False)
    rows, cut = [], H.cut

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(H, "cut", counted)
    index = H.index_commits(commits_frame(spark, {0: []} | {i: [i - 1] for i in range(1, 2000)}))
    assert index.places.select("chain").distinct().count() == 1 and index.places.agg(F.max("pos")).first()[0] == 1999
    assert sum(rows) < 5 * 2000


def test_percentiles_without_a_task_that_holds_all_numbers(spark):
    for numbers in ([5], [3, 9], [7, 7, 1, 40, None, 12, 12], list(range(0, 999, 7))):
        df = spark.createDataFrame([(n,) for n in numbers], "commit_no long")
        want = df.selectExpr("percentile(commit_no, array(0.5, 0.6, 0.8))").first()[0]
        assert Q.percentiles(df, [0.5, 0.6, 0.8]) == want


def test_only_hot_keys_are_salted(spark, monkeypatch):
    from rowtrail.plans import joins

    big = spark.range(300).selectExpr("CASE WHEN id < 200 THEN 1 WHEN id < 250 THEN NULL ELSE id END AS k", "id")
    small = spark.createDataFrame([(1, "a"), (260, "b"), (None, "c")], "k long, v string")
    key = lambda df: sorted(map(str, df.collect()))
    for limit, salted in ((joins.HOT_ROWS, False), (40, True)):
        monkeypatch.setattr(joins, "HOT_ROWS", limit)
        for how in ("inner", "left", "left_anti", "left_semi"):
            got = joins.salted_join(big, small, ["k"], how, 4, ["id"])
            assert ("_salt" in got._jdf.queryExecution().optimizedPlan().toString()) == salted
            assert key(got) == key(big.join(small, ["k"], how))


@pytest.mark.parametrize("broadcast", [True, False])
def test_a_line_of_many_refs_is_listed_in_blocks(spark, monkeypatch, broadcast):
    """One line of 400 commits with a ref on each: no task lists a large part of the 80,200 rows."""
    monkeypatch.setattr(H, "LISTED", 32, raising=False)
    monkeypatch.setattr(H, "BLOCKS", 50, raising=False)
    if not broadcast:
        monkeypatch.setattr("rowtrail.plans.joins.fits", lambda *_: False)
    parents = {0: []} | {i: [i - 1] for i in range(1, 400)} | {400: [250], 401: [400]}
    index = H.index_commits(commits_frame(spark, parents))
    heads = [(f"r{i}", i) for i in range(400)] + [("side", 401), ("two", 401), ("two", 300), ("r7", 7), (None, 3), (None, 9), ("lost", 999)]
    refs = spark.createDataFrame([(name, f"c{i}") for name, i in heads], "name string, commit_id string")
    rows = H.reachable(index, refs)
    want = {}
    for name, i in heads[:-1]:
        want.setdefault(name, set()).update(walk(parents, i))
    got = rows.collect()
    assert len(got) == sum(map(len, want.values()))
    assert {(r.name, r.commit_id, r.commit_no) for r in got} == {(name, f"c{i}", i) for name, seen in want.items() for i in seen}
    if broadcast:
        tasks = rows.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in tasks) < len(got) / 4
    assert "inline(_places" in rows._jdf.queryExecution().executedPlan().toString()


def test_blocks_too_large_to_broadcast_are_listed_in_tiles(spark, monkeypatch):
    """Two lines with a ref on each commit: tasks stay small without a broadcast, and no row is salted."""
    monkeypatch.setattr("rowtrail.plans.joins.HOT_ROWS", 20)
    parents = {0: []} | {i: [i - 1] for i in range(1, 200)} | {200: []} | {i: [i - 1] for i in range(201, 280)}
    index = H.index_commits(commits_frame(spark, parents))
    monkeypatch.setattr("rowtrail.plans.joins.fits", lambda *_: False)
    heads = [(f"r{i}", i) for i in parents] + [(None, 279), (None, 5), ("r7", 190), ("lost", 999)]
    refs = spark.createDataFrame([(name, f"c{i}") for name, i in heads], "name string, commit_id string")
    want = {(name, f"c{i}", i) for name, head in heads[:-1] for i in walk(parents, head)}
    for listed, blocks in ((32, 20), (2, 800)):
        monkeypatch.setattr(H, "LISTED", listed)
        monkeypatch.setattr(H, "BLOCKS", blocks)
        monkeypatch.setattr(H, "DEALT", 300, raising=False)
        rows = H.reachable(index, refs).withColumn("task", F.spark_partition_id())
        got = rows.collect()
        assert len(got) == len(want) and {(r.name, r.commit_id, r.commit_no) for r in got} == want
        tasks = [r.task for r in got]
        assert max(map(tasks.count, set(tasks))) < len(got) / 3
        assert "_salt" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_few_refs_are_listed_without_a_shuffle_of_all_places(spark):
    index = H.index_commits(commits_frame(spark, {0: []} | {i: [i - 1] for i in range(1, 50)}))
    refs = spark.createDataFrame([(f"r{i}", f"c{i}") for i in range(H.SHARED)], "name string, commit_id string")
    rows = H.reachable(index, refs)
    assert rows.count() == H.SHARED * (H.SHARED + 1) // 2
    assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()


def test_refs_are_counted_whatever_their_names(spark, monkeypatch):
    """Names that come twice, are null, or lie on no known commit."""
    parents = {0: []} | {i: [i - 1] for i in range(1, 30)}
    heads = [("a", "c4"), ("a", "c9"), ("a", "c9"), (None, "c2"), (None, "c1"), ("lost", "none"), *((f"r{i}", f"c{i}") for i in range(30))]
    index, refs = H.index_commits(commits_frame(spark, parents)), spark.createDataFrame(heads, "name string, commit_id string")
    monkeypatch.setattr(Q, "index", lambda *_: index)
    monkeypatch.setattr(Q, "refs", lambda *_: refs)
    got = sorted(((r.name or "", r.commits, r.first, r.last) for r in Q.QUERIES["v1_reachable_all_refs"](spark, "").collect()))
    assert got == sorted([("", 3, 0, 2), ("a", 10, 0, 9), *((f"r{i}", i + 1, 0, i) for i in range(30))])
