"""History over plain tables.

``commits``: commit_id, commit_no (a number that grows from parent to child), parent_ids, author,
ts, subject, body. ``refs``: name, commit_id. ``deltas``: commit_id, commit_no, dataset, the key
columns, op and a ``new`` struct; a commit holds at most one delta row per key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from rowtrail.functions.text import short_hash
from rowtrail.operators.changes import replace_rows
from rowtrail.operators.diff import delta_of, diff_rows, diff_stat_by_dataset, prefix_filter, select_delta
from rowtrail.plans import cut, join_small

# ---------------------------------------------------------------------------------------------
# Reachability. Walking parents level by level costs one job per generation, and Spark's recursive
# CTE does the same (and has no UNION to drop paths met twice). Instead commits are indexed once
# into chains: a chain follows parent links, so what a ref reaches inside a chain is always its
# lower end, and the search moves by whole chains. Of several parents a commit follows the one whose
# line of first parents is longest, so merges that list a fresh branch first stay on the main line.
# A commit's chain continues with the child that has most descendants, so a line of followed parents
# changes chains at most log2(commits) times.
#
# Commits are dealt into blocks of neighbouring numbers. A task goes through a block in the order of
# the numbers; what depends on other blocks (the depth of a parent there, the descendants of a child
# there, the chain a piece goes on with) is settled among the links that leave a block, by steps that
# double their reach. So a commit is shuffled three times however long the history is, and only links
# between blocks take part in about 3 log2(blocks) rounds. In a history whose parents lie anywhere
# most links leave their block, and these rounds hold most commits.
# ---------------------------------------------------------------------------------------------

# Commits of a block; a task holds one block.
BLOCK = 100_000

# Doubling steps taken between two written tables; more of them save jobs and make larger plans.
STEPS = 2

_BITS = 32
_NODE = (1 << _BITS) - 1


def _spot(block: str = "block", node: str = "node") -> Column:
    """One number for a commit's block and its place there."""
    return F.shiftleft(F.col(block).cast("bigint"), _BITS) + F.col(node)


def _sums_to_end(links: DataFrame) -> DataFrame:
    """Links (spot, up, sum, label) followed upwards until no link goes on: sums added, the last label."""

    def double(jump: DataFrame) -> DataFrame:
        target = jump.select(F.col("spot").alias("_key"), F.col("up").alias("_up"), F.col("sum").alias("_sum"), F.col("label").alias("_label"))
        # Links at their end get a key of their own instead of all sharing the end's.
        moved = jump.withColumn("_key", F.when(F.col("ended"), -1 - F.col("spot")).otherwise(F.col("up"))).join(target, "_key", "left")
        return moved.select(
            "spot", F.coalesce("_up", "up").alias("up"), (F.col("sum") + F.coalesce("_sum", F.lit(0))).alias("sum"),
            F.coalesce("_label", "label").alias("label"), F.col("_up").isNull().alias("ended"),
        )

    jump = cut(links.withColumn("ended", F.lit(False)))
    while not jump.filter(~F.col("ended")).isEmpty():
        for _ in range(STEPS):
            jump = double(jump)
        jump = cut(jump)
    return jump.select("spot", "sum", "label")


def _sums_below(links: DataFrame) -> DataFrame:
    """(spot, total) of links (spot, up, total): each one's own total and those of all links below it."""

    def double(jump: DataFrame) -> DataFrame:
        below = jump.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("spot")).agg(F.sum("total").alias("_below"))
        target = jump.select(F.col("spot").alias("_key"), F.col("up").alias("_next"))
        grown = jump.join(below, "spot", "left").withColumn("_key", F.coalesce(F.col("up"), -1 - F.col("spot")))
        total = F.col("total") + F.coalesce("_below", F.lit(0))
        return grown.join(target, "_key", "left").select("spot", F.col("_next").alias("up"), total.alias("total"))

    jump = cut(links)
    while not jump.filter(F.col("up").isNotNull()).isEmpty():
        for _ in range(STEPS):
            jump = double(jump)
        jump = cut(jump)
    return jump.select("spot", "total")


def _number_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the commits of one block, their parents inside and outside of it, and how deep they lie inside.

    A parent counts as inside if it comes before its child. ``root`` is where the line of first parents
    leaves the block, ``leaves`` the parent it goes on with.
    """
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).sort_by([("commit_no", "ascending"), ("commit_id", "ascending")])
    at, root, depth, leaves, inside, outside = {}, [], [], [], [], []
    for node, (commit, parents) in enumerate(zip(rows["commit_id"].to_pylist(), rows["parent_ids"].to_pylist(), strict=True)):
        parents = parents or []
        first = parents[0] if parents else None
        up = at.get(first)
        root.append(node if up is None else root[up])
        depth.append(0 if up is None else depth[up] + 1)
        leaves.append(first if up is None else None)
        inside.append([at[p] for p in parents if p in at])
        outside.append([p for p in parents if p is not None and p not in at])
        at[commit] = node
    made = {"node": range(len(root)), "root": root, "depth": depth, "leaves": leaves, "inside": inside, "outside": outside}
    types = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string())]
    rows = rows.select(["block", "commit_id", "commit_no"])
    for (name, values), kind in zip(made.items(), types, strict=True):
        rows = rows.append_column(name, pa.array(values, kind))
    yield from rows.to_batches(max_chunksize=20_000)


def _followed_inside(block: int, up: list[int | None]) -> list[int | None]:
    """The followed parents that come earlier in the same block, by their place there."""
    return [u & _NODE if u is not None and u >> _BITS == block and u & _NODE < node else None for node, u in enumerate(up)]


def _follow_block(rows: pa.Table, notes: pa.Table) -> pa.Table:
    """The followed parent of each commit, its descendants within the block and where its line leaves it.

    ``notes`` hold the depths of roots (without ``up``) and of parents in other blocks.
    """
    rows = rows.sort_by("node")
    block = rows["block"][0].as_py()
    lift, offers = {}, {}
    for node, depth, up in zip(*(notes[c].to_pylist() for c in ("node", "depth", "up")), strict=True):
        if up is None:
            lift[node] = depth
        else:
            offers.setdefault(node, []).append((depth, up))
    depth = [d + lift.get(r, 0) for d, r in zip(rows["depth"].to_pylist(), rows["root"].to_pylist(), strict=True)]
    up = []
    for node, parents in enumerate(rows["inside"].to_pylist()):
        best = max([(depth[p], (block << _BITS) + p) for p in parents] + offers.get(node, []), default=None)
        up.append(best and best[1])
    near, size, top = _followed_inside(block, up), [1] * len(up), []
    for node, u in enumerate(near):
        top.append(node if u is None else top[u])
    for node in range(len(near) - 1, -1, -1):
        if near[node] is not None:
            size[near[node]] += size[node]
    rows = rows.select(["block", "node", "commit_id", "commit_no", "inside"])
    for name, values, kind in (("up", up, pa.int64()), ("total", size, pa.int64()), ("top", top, pa.int32())):
        rows = rows.append_column(name, pa.array(values, kind))
    return rows


def _chain_block(rows: pa.Table, notes: pa.Table) -> pa.Table:
    """The piece of a chain that each commit of a block lies on, and the parent links to other pieces of the block.

    ``notes`` hold the descendants of children in other blocks; ``next`` is such a child that goes on with the piece.
    """
    rows = rows.sort_by("node")
    block, ids = rows["block"][0].as_py(), rows["commit_id"].to_pylist()
    near = _followed_inside(block, rows["up"].to_pylist())
    size, heir = [1] * len(ids), [(0, -1)] * len(ids)
    for node, child, total in zip(*(notes[c].to_pylist() for c in ("node", "child", "total")), strict=True):
        size[node] += total
        heir[node] = max(heir[node], (total, child))
    far = [h[1] for h in heir]
    for node in range(len(ids) - 1, -1, -1):
        if near[node] is not None:
            size[near[node]] += size[node]
            heir[near[node]] = max(heir[near[node]], (size[node], (block << _BITS) + node))
    piece, pos = [], []
    for node, u in enumerate(near):
        on = u is not None and heir[u][1] == (block << _BITS) + node
        piece.append(piece[u] if on else node)
        pos.append(pos[u] + 1 if on else 0)
    goes_on = [f if f >= 0 and f == h[1] else None for f, h in zip(far, heir, strict=True)]
    across = [
        [{"to_piece": piece[p], "to_chain": ids[piece[p]], "to_pos": pos[p]} for p in parents if piece[p] != piece[node]]
        for node, parents in enumerate(rows["inside"].to_pylist())
    ]
    rows = rows.select(["block", "node", "commit_id", "commit_no"])
    link = pa.list_(pa.struct([("to_piece", pa.int32()), ("to_chain", pa.string()), ("to_pos", pa.int64())]))
    for name, values, kind in (
        ("piece", piece, pa.int32()), ("chain", [ids[p] for p in piece], pa.string()), ("pos", pos, pa.int64()),
        ("next", goes_on, pa.int64()), ("across", across, link),
    ):
        rows = rows.append_column(name, pa.array(values, kind))
    return rows


_NUMBERED = (
    "block int, commit_id string, commit_no bigint, node int, root int, depth bigint, leaves string, inside array<int>,"
    " outside array<string>"
)
_FOLLOWED = "block int, node int, commit_id string, commit_no bigint, inside array<int>, up bigint, total bigint, top int"
_CHAINED = (
    "block int, node int, commit_id string, commit_no bigint, piece int, chain string, pos bigint, next bigint,"
    " across array<struct<to_piece: int, to_chain: string, to_pos: bigint>>"
)


class CommitIndex(NamedTuple):
    """Two tables worth storing next to the commits.

    ``places``: commit_id, commit_no, chain, pos. ``crossings``: parent links that leave a chain, as
    chain and pos of the child and to_chain and to_pos of the parent.
    """

    places: DataFrame
    crossings: DataFrame


def _by_block(rows: DataFrame, notes: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over the commits and the notes of each block, written."""
    return cut(rows.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(run, schema))


def _at(spot: str) -> list[Column]:
    """Block and node of a spot."""
    return [F.shiftright(spot, _BITS).cast("int").alias("block"), F.col(spot).bitwiseAND(F.lit(_NODE)).cast("int").alias("node")]


def index_commits(commits: DataFrame) -> CommitIndex:
    """Chain membership of every commit and the links between chains, both as written tables.

    Build it once per commit table and pass it to the functions below.
    """
    rows = commits.select("commit_id", F.col("commit_no").cast("bigint").alias("commit_no"), "parent_ids").filter(F.col("commit_id").isNotNull())
    dealt = rows.repartitionByRange(rows.count() // BLOCK + 1, "commit_no", "commit_id")
    numbered = cut(dealt.withColumn("block", F.spark_partition_id()).mapInArrow(_number_block, _NUMBERED))

    # Links to parents that no block holds before their child; unknown parents drop out.
    out = cut(numbered.select(_spot().alias("spot"), F.explode("outside").alias("_parent"), "leaves"))
    holders = numbered.select(F.col("commit_id").alias("_parent"), _spot().alias("up"), _spot("block", "root").alias("_root"), F.col("depth").alias("_depth"))
    links = cut(out.join(join_small(holders, out.select("_parent").distinct(), ["_parent"], "left_semi"), "_parent"))
    firsts = links.filter(F.col("_parent") == F.col("leaves")).dropDuplicates(["spot"])
    lifts = _sums_to_end(firsts.select("spot", F.col("_root").alias("up"), (F.col("_depth") + 1).alias("sum"), F.lit("").alias("label")))
    lifts = lifts.select("spot", "sum")
    above = links.join(lifts.select(F.col("spot").alias("_root"), "sum"), "_root", "left")
    offers = above.select(*_at("spot"), (F.col("_depth") + F.coalesce("sum", F.lit(0))).alias("depth"), "up")
    notes = lifts.select(*_at("spot"), F.col("sum").alias("depth"), F.lit(None).cast("bigint").alias("up")).unionByName(offers)
    rows = numbered.select("block", "node", "commit_id", "commit_no", "root", "depth", "inside")
    followed = _by_block(rows, notes, _follow_block, _FOLLOWED)

    # Lines that go on in another block, and the descendants of where they leave.
    same = (F.shiftright("up", _BITS) == F.col("block")) & (F.col("up").bitwiseAND(F.lit(_NODE)) < F.col("node"))
    leaving = cut(followed.filter(F.col("up").isNotNull() & ~same).select(_spot().alias("spot"), "up", "total"))
    holders = followed.select(_spot().alias("up"), _spot("block", "top").alias("_top"))
    found = leaving.join(join_small(holders, leaving.select("up").distinct(), ["up"], "left_semi"), "up")
    totals = _sums_below(found.select("spot", F.col("_top").alias("up"), "total"))
    children = leaving.select("spot", "up").join(totals, "spot").select(*_at("up"), F.col("spot").alias("child"), "total")
    chained = _by_block(followed.select("block", "node", "commit_id", "commit_no", "inside", "up"), children, _chain_block, _CHAINED)

    # Pieces that go on with one in another block.
    going = chained.filter(F.col("next").isNotNull())
    moves = _sums_to_end(going.select(F.col("next").alias("spot"), _spot("block", "piece").alias("up"), (F.col("pos") + 1).alias("sum"), F.col("chain").alias("label")))

    def moved(df: DataFrame, piece: str, chain: str, pos: str) -> DataFrame:
        own = moves.select(F.col("spot").alias("_piece"), F.col("sum").alias("_sum"), F.col("label").alias("_label"))
        joined = join_small(df.withColumn("_piece", _spot("block", piece)), own, ["_piece"], "left").drop("_piece", piece)
        return joined.withColumns({chain: F.coalesce("_label", chain), pos: F.col(pos) + F.coalesce("_sum", F.lit(0))}).drop("_sum", "_label")

    placed = cut(moved(chained.drop("next", "across"), "piece", "chain", "pos"))
    near = chained.filter(F.size("across") > 0).select("block", "piece", "chain", "pos", F.inline("across"))
    near = moved(moved(near, "piece", "chain", "pos"), "to_piece", "to_chain", "to_pos")
    ends = cut(links.select("spot").union(links.select("up")).distinct())
    spots = cut(join_small(placed.select(_spot().alias("spot"), "chain", "pos"), ends, ["spot"], "left_semi"))
    to = spots.select(F.col("spot").alias("up"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"))
    columns = ["chain", "pos", "to_chain", "to_pos"]
    crossings = near.select(*columns).union(links.join(spots, "spot").join(to, "up").select(*columns))
    return CommitIndex(placed.select("commit_id", "commit_no", "chain", "pos"), cut(crossings.filter(F.col("chain") != F.col("to_chain"))))


def new_places(index: CommitIndex, commits: DataFrame) -> CommitIndex:
    """Places and crossings of ``commits`` that ``index`` does not hold yet; what it holds stays as it is.

    Parents are in ``index`` or among ``commits``. The new commits are chained among themselves; a new
    chain goes on with an old one if its lowest commit follows that chain's last, the one with the most
    commits if there are several. Rounds and joins follow the new commits; the old places are only scanned
    for their parents. Chains may come out shorter than by :func:`index_commits`, which costs later
    searches some rounds, never commits.
    """
    held = index.places.select("commit_id")
    fresh = cut(commits.select("commit_id", "commit_no", "parent_ids").join(join_small(held, commits.select("commit_id"), ["commit_id"], "left_semi"), "commit_id", "left_anti"))
    links = fresh.select("commit_id", "commit_no", F.posexplode("parent_ids").alias("_at", "_parent"))
    inner = links.join(fresh.select(F.col("commit_id").alias("_parent")), "_parent", "left_semi")
    among = fresh.select("commit_id", "commit_no").join(
        inner.groupBy("commit_id").agg(F.array_sort(F.collect_list(F.struct("_at", "_parent"))).alias("_inner")), "commit_id", "left"
    )
    parents = F.coalesce(F.transform("_inner", lambda x: x["_parent"]), F.array().cast("array<string>"))
    own = index_commits(among.select("commit_id", "commit_no", parents.alias("parent_ids")))
    # Where the parents lie that are old, and whether a chain ends with them.
    wanted = cut(links.join(inner.select("commit_id", "_at"), ["commit_id", "_at"], "left_anti").select("commit_id", "_parent"))
    found = join_small(index.places.select(F.col("commit_id").alias("_parent"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos")), wanted.select("_parent").distinct(), ["_parent"], "left_semi")
    old = cut(wanted.join(found, "_parent"))
    after = old.select(F.col("to_chain").alias("chain"), (F.col("to_pos") + 1).alias("pos")).distinct()
    taken = join_small(index.places.select("chain", "pos"), after, ["chain", "pos"], "left_semi")
    open_ = old.join(taken.select(F.col("chain").alias("to_chain"), (F.col("pos") - 1).alias("to_pos")), ["to_chain", "to_pos"], "left_anti")
    lowest = own.places.filter("pos = 0").select("commit_id", F.col("chain").alias("_own"))
    sizes = own.places.groupBy("chain").agg(F.count(F.lit(1)).alias("_size")).withColumnRenamed("chain", "_own")
    offers = open_.join(lowest, "commit_id").join(sizes, "_own")
    # A new chain takes one old chain, and an old chain is taken by one new chain.
    choice = offers.groupBy("_own", "_size").agg(F.max(F.struct("to_pos", "to_chain")).alias("_to")).select("_own", "_size", "_to.*")
    winner = choice.groupBy("to_chain").agg(F.max(F.struct("_size", "_own")).alias("_by")).select("to_chain", F.col("_by._own").alias("_own"))
    joined = choice.join(winner, ["to_chain", "_own"]).select(F.col("_own").alias("chain"), "to_chain", "to_pos")
    moved = own.places.join(joined, "chain", "left")
    places = cut(moved.select(
        "commit_id", "commit_no", F.coalesce("to_chain", "chain").alias("chain"),
        (F.col("pos") + F.coalesce(F.col("to_pos") + 1, F.lit(0))).alias("pos"),
    ))
    at = places.select("commit_id", "chain", "pos")
    among = links.join(inner.select("commit_id", "_at"), ["commit_id", "_at"], "left_semi").select("commit_id", "_parent")
    to_new = among.join(at.select(F.col("commit_id").alias("_parent"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos")), "_parent")
    every = to_new.unionByName(old).join(at, "commit_id")
    return CommitIndex(places, cut(every.filter(F.col("chain") != F.col("to_chain")).select("chain", "pos", "to_chain", "to_pos")))


def extend_index(index: CommitIndex, commits: DataFrame) -> CommitIndex:
    """``index`` with the places of new commits beside its own; see :func:`new_places`."""
    more = new_places(index, commits)
    columns = ["chain", "pos", "to_chain", "to_pos"]
    return CommitIndex(
        index.places.select(*more.places.columns).unionByName(more.places), index.crossings.select(*columns).unionByName(more.crossings)
    )


def store_index(index: CommitIndex, path: str, version: int = 0) -> None:
    """Write ``index`` as one version below ``path``; it counts once its mark, written last, is there."""
    index.places.write.mode("overwrite").parquet(f"{path}/places/version={version}")
    index.crossings.write.mode("overwrite").parquet(f"{path}/crossings/version={version}")
    index.places.sparkSession.range(1).select(F.lit(version).alias("number")).coalesce(1).write.mode("overwrite").json(f"{path}/marks/{version}")


def _versions(spark, path: str) -> list[int]:
    marks = spark.read.schema("number int").option("recursiveFileLookup", "true").json(f"{path}/marks")
    return sorted(r["number"] for r in marks.collect())


def load_index(spark, path: str) -> CommitIndex:
    """All marked versions of a stored index; versions are appended and never changed."""
    versions = _versions(spark, path)

    def read(part: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(*[f"{path}/{part}/version={v}" for v in versions])

    return CommitIndex(
        read("places", "commit_id string, commit_no bigint, chain string, pos bigint"),
        read("crossings", "chain string, pos bigint, to_chain string, to_pos bigint"),
    )


def extend_stored_index(spark, path: str, commits: DataFrame) -> CommitIndex:
    """Append the places of new commits to a stored index as its next version; known commits add nothing."""
    index = load_index(spark, path)
    store_index(new_places(index, commits), path, max(_versions(spark, path)) + 1)
    return load_index(spark, path)


# Positions of a chain that are joined under one key, so that a long chain spreads over tasks.
SPAN = 1 << 16


def _on_chains(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """``rows`` (chain, pos, …) with ``tops`` (chain, top, maybe bottom, …) that hold them: bottom < pos <= top."""
    bottom = F.col("bottom") if "bottom" in tops.columns else F.lit(-1).cast("bigint")
    low, high = (F.floor(x / SPAN) for x in (bottom + 1, F.col("top")))
    spans = tops.filter(F.col("top") > bottom).withColumn("_span", F.explode(F.sequence(low, high)))
    met = join_small(rows.withColumn("_span", F.floor(F.col("pos") / SPAN)), spans, ["chain", "_span"])
    return met.filter((F.col("pos") <= F.col("top")) & (F.col("pos") > bottom)).drop("_span")


def reach(index: CommitIndex, refs: DataFrame) -> DataFrame:
    """(name, chain, top): for every ref, the chains it reaches and the highest position there."""
    start = refs.join(index.places, "commit_id").select("name", "chain", F.col("pos").alias("top"))
    fresh = cut(start.withColumn("bottom", F.lit(-1).cast("bigint")))
    found = fresh.groupBy("name", "chain").agg(F.max("top").alias("top"))
    while not fresh.isEmpty():
        # Only the part of a chain that is new in this round is followed further.
        met = _on_chains(index.crossings, fresh).groupBy("name", F.col("to_chain").alias("chain")).agg(F.max("to_pos").alias("top"))
        before = found.withColumnRenamed("top", "bottom")
        better = met.join(before, ["name", "chain"], "left").withColumn("bottom", F.coalesce("bottom", F.lit(-1)))
        fresh = cut(better.filter(F.col("top") > F.col("bottom")))
        # One row per ref and chain, written, so that a round does not read those before it.
        found = cut(found.union(fresh.select("name", "chain", "top")).groupBy("name", "chain").agg(F.max("top").alias("top")))
    return found


# A chain that more refs than this reach is listed in blocks of so many places.
SHARED = 16
LISTED = 1 << 12

# Blocks that a task lists, as long as that does not take more tasks than the second number.
BLOCKS, MAX_TASKS = 4_000, 10_000

# Rows that a task makes when refs are dealt to tiles.
DEALT = 1_000_000


def reachable(index: CommitIndex, refs: DataFrame) -> DataFrame:
    """(name, commit_id, commit_no) of all commits each ref reaches, itself included.

    If most refs lie on one long history, these are refs x commits. Only the rows that come out are so many.
    """
    tops = reach(index, refs)
    many = not tops.groupBy("chain").agg(F.count(F.lit(1)).alias("_refs")).filter(F.col("_refs") > SHARED).isEmpty()
    return (_by_blocks if many else _on_chains)(index.places, tops).select("name", "commit_id", "commit_no")


def _by_blocks(places: DataFrame, tops: DataFrame) -> DataFrame:
    """Rows of ``places`` up to each of ``tops`` (name, chain, top), as :func:`_on_chains` finds them.

    Neighbouring places of a chain are one row, a block. A chain and its refs are cut into tiles of about as many
    places as refs. Blocks travel once per share of the refs and refs once per tile of the chain, so what is shuffled
    falls behind the rows listed as tiles grow; a task opens one block for one ref at a time.
    """
    pairs = tops.agg(F.coalesce(F.sum(F.floor(F.col("top") / LISTED) + 1), F.lit(0))).first()[0]
    tasks = min(pairs // BLOCKS + 1, MAX_TASKS)
    blocks = max(round(math.sqrt(pairs / tasks / LISTED)), 1)
    side = blocks * LISTED
    crowded = cut(tops.groupBy("chain").agg(F.ceil(F.count(F.lit(1)) / side).cast("int").alias("_shares")).filter(F.col("_shares") > 1))

    def shared(df: DataFrame) -> DataFrame:
        return join_small(df, crowded, ["chain"], "left").withColumn("_shares", F.coalesce("_shares", F.lit(1)))

    key = ["chain", "_tile", "_share"]
    refs = shared(tops).withColumn("_share", F.pmod(F.xxhash64("name"), F.col("_shares")).cast("int")).drop("_shares")
    refs = refs.repartition(min(pairs // blocks // DEALT + 1, MAX_TASKS), "chain", "name")
    refs = refs.withColumn("_tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("top") / side))))
    held = places.groupBy("chain", F.floor(F.col("pos") / LISTED).alias("_block")).agg(
        F.collect_list(F.struct("pos", "commit_id", "commit_no")).alias("_places")
    )
    held = shared(held).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    held = held.withColumn("_tile", F.floor(F.col("_block") / blocks))
    met = refs.repartition(tasks, *key).join(held.repartition(tasks, *key), key)
    # The join takes whole blocks, so that the number of its rows is the number of blocks.
    met = met.filter(F.col("_block") * LISTED <= F.col("top"))
    return met.select("name", "top", F.inline("_places")).filter(F.col("pos") <= F.col("top"))


def ancestors(index: CommitIndex, refs: DataFrame, ref: str) -> DataFrame:
    """(commit_id, commit_no) of the history of ``ref``."""
    return reachable(index, refs.filter(F.col("name") == ref)).drop("name")


def log(index: CommitIndex, commits: DataFrame, refs: DataFrame, ref: str, n: int | None = None) -> DataFrame:
    """Commits of the history of ``ref``, newest first, at most ``n``."""
    rows = commits.join(ancestors(index, refs, ref).select("commit_id"), "commit_id", "left_semi")
    rows = rows.orderBy(F.desc("ts"), "commit_id")
    return rows if n is None else rows.limit(n)


def show(commits: DataFrame, deltas: DataFrame, commit_id: str | None = None) -> DataFrame:
    """Commit header and per-dataset change counts; of every commit without ``commit_id``."""
    if commit_id is not None:
        commits, deltas = (df.filter(F.col("commit_id") == commit_id) for df in (commits, deltas))
    kinds = (("I", "added"), ("U", "modified"), ("D", "deleted"))
    counts = [F.count_if(F.col("op") == code).alias(name) for code, name in kinds]
    stats = deltas.groupBy("commit_id", "dataset").agg(*counts)
    head = commits.select("commit_id", "author", "ts", "subject", "body")
    joined = head.join(stats, "commit_id", "left")
    return joined.fillna(0, [name for _, name in kinds])


def last_rows(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """The row with the largest ``number`` of each group; NULLs of ``by`` group together.

    The aggregate holds numbers only, so it hashes and combines before the shuffle; rows join it.
    """
    top = df.groupBy(*by).agg(F.max(number).alias("_top")).withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return df.join(top, [*same, F.col(number) == F.col("_top")]).select(*df.columns).dropDuplicates(by)


def _last_states(deltas: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """Per key, the last (op, new) by commit number, once for each flag. Keys are not NULL."""
    marked = deltas.select(*keys, "commit_no", "op", "new", *[flag.alias(f"_{name}") for name, flag in flags.items()])
    tops = marked.groupBy(*keys).agg(*[F.max(F.when(F.col(f"_{name}"), F.col("commit_no"))).alias(f"_top_{name}") for name in flags])
    # Both sides are dealt by the keys, and so is what comes out.
    rows, out = marked.join(tops, keys), None
    for name in flags:
        own = rows.filter(F.col(f"_{name}") & (F.col("commit_no") == F.col(f"_top_{name}"))).dropDuplicates(keys)
        own = own.select(*keys, F.struct("commit_no", "op", "new").alias(name))
        out = own if out is None else out.join(own, keys, "full")
    return out


def snapshot_as_of(
    base: DataFrame, deltas: DataFrame, index: CommitIndex, refs: DataFrame, ref: str, keys: list[str],
    checkpoints: str | None = None,
) -> DataFrame:
    """``base`` with the changes of the history of ``ref`` applied, deleted rows removed.

    With ``checkpoints``, a folder of :func:`write_checkpoint`, the states of the largest checkpoint
    that lies within the history stand for its commits, and only deltas of later commits are read.
    """
    last = cut(states_as_of(deltas, index, refs, ref, keys, checkpoints))
    upserts = last.filter(F.col("op") != "D").select(*keys, "new.*")
    return replace_rows(base, last, upserts, keys)


def states_as_of(
    deltas: DataFrame, index: CommitIndex, refs: DataFrame, ref: str, keys: list[str], checkpoints: str | None = None
) -> DataFrame:
    """(keys, commit_no, op, new): the last change of every row that the history of ``ref`` touched."""
    tops = reach(index, refs.filter(F.col("name") == ref)).select("chain", "top")
    return _states_at(deltas, index, tops, keys, checkpoints)


def _states_at(deltas: DataFrame, index: CommitIndex, tops: DataFrame, keys: list[str], checkpoints: str | None) -> DataFrame:
    """:func:`states_as_of` for the written tops of a history."""
    chosen = _best_checkpoint(tops, checkpoints) if checkpoints else None
    if chosen is not None:
        done = _checkpoint_tops(tops.sparkSession, checkpoints).filter(F.col("number") == chosen).select("chain", F.col("top").alias("_done"))
        tops = cut(tops.join(done, "chain", "left").select("chain", "top", F.coalesce("_done", F.lit(-1)).alias("bottom")))
    past = cut(_on_chains(index.places, tops).select("commit_id", "commit_no"))
    # Commit numbers reach the scan, where deltas are stored by them.
    low, high = past.agg(F.min("commit_no"), F.max("commit_no")).first()
    rows = deltas.filter(F.col("commit_no").between(low, high)) if low is not None else deltas.limit(0)
    applied = join_small(rows, past.select("commit_id"), ["commit_id"], "left_semi", salts=16, salt_by=keys)
    applied = applied.select(*keys, "commit_no", "op", "new")
    if chosen is not None:
        states = tops.sparkSession.read.parquet(f"{checkpoints}/states/number={chosen}")
        applied = applied.unionByName(states)
    return _last_states(applied, keys, {"state": F.lit(True)}).select(*keys, "state.*")


def write_checkpoint(
    deltas: DataFrame, index: CommitIndex, refs: DataFrame, ref: str, keys: list[str], path: str
) -> int:
    """Store the states that the history of ``ref`` leaves, for later snapshots; returns its number.

    An earlier checkpoint within that history is built upon. Write one every some thousand commits of a
    main line. The tops of the chains, written last, make it count.
    """
    spark = deltas.sparkSession
    taken = [r["number"] for r in _checkpoint_tops(spark, path).select("number").distinct().collect()]
    number = max(taken, default=-1) + 1
    tops = reach(index, refs.filter(F.col("name") == ref)).select("chain", "top")
    _states_at(deltas, index, tops, keys, path if taken else None).write.mode("overwrite").parquet(f"{path}/states/number={number}")
    tops.write.mode("overwrite").parquet(f"{path}/tops/number={number}")
    return number


def _checkpoint_tops(spark, path: str) -> DataFrame:
    """(number, chain, top) of all checkpoints: a row per checkpoint and chain."""
    schema = "chain string, top bigint, number int"
    try:
        return spark.read.schema(schema).parquet(f"{path}/tops")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _best_checkpoint(tops: DataFrame, path: str) -> int | None:
    """The checkpoint with most commits that holds none outside of the history with these tops."""
    stored = _checkpoint_tops(tops.sparkSession, path)
    within = stored.join(tops.withColumnRenamed("top", "_reached"), "chain", "left")
    usable = within.groupBy("number").agg(
        F.bool_and(F.col("top") <= F.coalesce("_reached", F.lit(-1))).alias("usable"), F.sum(F.col("top") + 1).alias("commits")
    )
    best = usable.filter("usable").orderBy(F.desc("commits"), F.desc("number")).select("number").first()
    return best and best["number"]


def diff_refs(
    base: DataFrame, deltas: DataFrame, index: CommitIndex, refs: DataFrame, ref_a: str, ref_b: str, keys: list[str]
) -> DataFrame:
    """Delta from the snapshot at ``ref_a`` to the one at ``ref_b``.

    Only keys that some reachable commit touched can differ, so both snapshots are compared on
    those keys alone: work follows the changes, not the table.
    """
    both = reachable(index, refs.filter(F.col("name").isin(ref_a, ref_b)))
    sides = cut(
        both.groupBy("commit_id").agg(
            F.bool_or(F.col("name") == ref_a).alias("in_a"), F.bool_or(F.col("name") == ref_b).alias("in_b")
        )
    )
    # A commit in both histories still decides the state of a key it touched last on either side.
    touched = join_small(deltas, sides, ["commit_id"], salts=16, salt_by=keys)
    states = _last_states(touched, keys, {"a": F.col("in_a"), "b": F.col("in_b")})
    same = F.col("a.op").eqNullSafe(F.col("b.op")) & F.col("a.new").eqNullSafe(F.col("b.new"))
    states = cut(states.filter(~(same & F.col("a").isNotNull() & F.col("b").isNotNull())))
    names = [f.name for f in deltas.schema["new"].dataType.fields]
    rows = base.select(*keys, F.struct(*names).alias("_base"))
    originals = join_small(rows, states.select(*keys), keys, "left_semi")
    joined = states.join(originals, keys, "left")

    def row(state: str) -> Column:
        s = F.col(state)
        return F.when(s.isNull(), F.col("_base")).when(s["op"] != "D", s["new"])

    return delta_of(joined.select(*keys, row("a").alias("old"), row("b").alias("new")), keys, names)


def merge_base(index: CommitIndex, refs: DataFrame, ref_a: str, ref_b: str) -> DataFrame:
    """The common ancestor of two refs with the highest commit number.

    On a chain, two refs share all commits up to the lower of their tops, so only one commit per chain
    is looked up; histories are never expanded.
    """
    tops = cut(reach(index, refs.filter(F.col("name").isin(ref_a, ref_b))))
    side = lambda ref, name: tops.filter(F.col("name") == ref).select("chain", F.col("top").alias(name))
    shared = side(ref_a, "_a").join(side(ref_b, "_b"), "chain").select("chain", F.least("_a", "_b").alias("pos"))
    found = join_small(index.places, cut(shared), ["chain", "pos"], "left_semi")
    return found.agg(F.max_by("commit_id", "commit_no").alias("commit_id"), F.max("commit_no").alias("commit_no"))


def restore(head: DataFrame, target: DataFrame, keys: list[str], datasets: list[str] | None = None) -> DataFrame:
    """Delta that turns ``head`` into ``target``, for the named datasets or all.

    Both hold all datasets, told apart by ``dataset``.
    """
    if datasets:
        head, target = (df.filter(F.col("dataset").isin(datasets)) for df in (head, target))
    return diff_rows(head, target, ["dataset", *keys])


def commit_batch(
    deltas: DataFrame, keys: list[str], meta: dict, path: str | None = None, filters: list[str] | None = None
) -> DataFrame:
    """Turn pending delta rows (dataset, keys, op, new, seq) into one commit.

    Keeps the last row per key. ``meta`` has commit_id, commit_no, parent_ids, author, ts, subject.
    With ``path`` the batch is appended below ``deltas`` by commit number and the commit row below
    ``commits``; writing the same commit again replaces it. Raises when there is nothing to commit.
    """
    pending = select_delta(deltas, filters or [])
    pending = cut(pending.select("dataset", *keys, "op", "new", "seq"))
    if pending.isEmpty():
        raise ValueError("nothing to commit")
    batch = last_rows(pending, ["dataset", *keys], "seq").select(
        F.lit(meta["commit_id"]).alias("commit_id"),
        F.lit(meta["commit_no"]).cast("bigint").alias("commit_no"),
        "dataset", *keys, "op", "new",
    )
    if path is None:
        return batch
    number = meta["commit_no"]
    spark = deltas.sparkSession
    batch.drop("commit_no").write.mode("overwrite").parquet(f"{path}/deltas/commit_no={number}")
    head = spark.range(1).select(
        *[F.lit(meta[k]).alias(k) for k in ("commit_id", "author", "ts", "subject")],
        F.lit(meta.get("body", "")).alias("body"),
        F.array(*[F.lit(p) for p in meta["parent_ids"]]).cast("array<string>").alias("parent_ids"),
    )
    head.write.mode("overwrite").parquet(f"{path}/commits/commit_no={number}")
    return spark.read.parquet(f"{path}/deltas").filter(F.col("commit_no") == number)


def branches(index: CommitIndex, refs: DataFrame, current: str) -> DataFrame:
    """(name, target, is_current, merged): short target and whether ``current`` contains it.

    A ref's commit is contained if it lies at or below the top that ``current`` reaches on its chain.
    """
    tips = cut(refs.select("commit_id").distinct())
    spots = join_small(index.places.select("commit_id", "chain", "pos"), tips, ["commit_id"], "left_semi")
    tops = reach(index, refs.filter(F.col("name") == current)).select("chain", "top")
    inside = spots.join(tops, "chain").filter(F.col("pos") <= F.col("top")).select("commit_id", F.lit(True).alias("_in"))
    joined = refs.join(inside, "commit_id", "left")
    return joined.select(
        "name",
        short_hash(F.col("commit_id")).alias("target"),
        (F.col("name") == current).alias("is_current"),
        F.coalesce("_in", F.lit(False)).alias("merged"),
    )


def tree_listing(paths: DataFrame, prefix: str = "", recursive: bool = False) -> DataFrame:
    """Paths below ``prefix``: all files relative to it, or the names of its direct children."""
    if prefix:
        paths = paths.filter(F.col("path").startswith(prefix + "/"))
    below = F.substring(F.col("path"), F.lit(len(prefix) + 2 if prefix else 1), F.length("path"))
    if recursive:
        return paths.select(below.alias("path")).distinct()
    return paths.select(F.substring_index(below, "/", 1).alias("path")).distinct()


def row_history(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Successive versions of every row: (keys, commit_no, op, old, new) with the version before.

    Rows are cut into ranges of (keys, commit_no) of about equal size, whatever the numbers are, so a
    window never holds more of one key than a range does; the last version of a key in each range is
    handed to the next.
    """
    ranges = deltas.select(*keys, "commit_no", "op", "new").repartitionByRange(*keys, "commit_no")
    rows = cut(ranges.withColumn("_run", F.spark_partition_id()))
    within = Window.partitionBy(*keys, "_run").orderBy("commit_no")
    rows = rows.withColumns({
        "_prev": F.lag("new").over(within),
        "_first": F.row_number().over(within) == 1,
        "_last": F.lead("commit_no").over(within).isNull(),
    })
    # One row per key and range.
    handed = F.lag(F.struct("new")).over(Window.partitionBy(*keys).orderBy("_run"))
    tails = rows.filter("_last").select(*keys, "_run", handed.alias("_handed"))
    # Key columns compare NULL-safe, as in the diff.
    right = tails.withColumnsRenamed({c: f"_r_{c}" for c in [*keys, "_run"]})
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in [*keys, "_run"]]
    old = F.when(F.col("_first"), F.col("_handed")["new"]).otherwise(F.col("_prev"))
    return rows.join(right, same, "left").select(*keys, "commit_no", "op", old.alias("old"), "new")
