"""Near-duplicate vectors by NN-descent.

Every distinct vector keeps a list of its nearest neighbours found so far. Lists start from windows over
sorted hyperplane codes; then each round joins, at every vector, all pairs of its neighbours and of those
that list it, as neighbours of neighbours are likely neighbours. Only pairs with a new entry are compared,
and only what improves a list leaves a task. A list whose last place still is a link is saturated and
grows. What stays saturated is closed into components; their links are counted in blocks of members,
without listing pairs, after a further descent has looked for neighbours outside of the own component.
An audit compares a sample with all vectors; below its target, the descent goes on from other codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from rowtrail.llm.common import named, written
from rowtrail.llm.near_dups import components

K, K_MOST = 10, 40
TABLES, BITS = 10, 48
WINDOW = 64
LOCAL = 64  # neighbours of one vector compared in one piece
ROUNDS = 8
FEW = 0.05  # share of places that changed in the last round of a descent
BLOCK = 512
SAMPLE, TARGET, AUDITS = 1024, 0.99, 3
FOREIGN = 4  # descents out of closed components, at most; each must have joined some
EMPTY = -2.0  # similarity of an empty place


def pack(df: DataFrame, id_col: str, vector_col: str, kind: str) -> DataFrame:
    """(id, vec): all rows, with usable vectors as bytes in the precision they are stored in, others null."""
    v = named(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = named(id_col).isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)
    rows = df.select(named(id_col).alias("id"), F.when(good, v).alias("v"))
    schema = T.StructType([rows.schema["id"], T.StructField("vec", T.BinaryType())])

    def run(it):
        for batch in it:
            column = batch.column("v")
            raw, width = column.values.to_numpy(zero_copy_only=False).astype(kind).tobytes(), np.dtype(kind).itemsize
            at = (column.offsets.to_numpy() * width).tolist()
            vecs = [raw[lo:hi] if ok else None for lo, hi, ok in zip(at, at[1:], column.is_valid().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(vecs, pa.binary())], ["id", "vec"])

    return rows.mapInArrow(run, schema)


def units(raw: bytes | memoryview, n: int, kind: str) -> np.ndarray:
    """``n`` packed vectors in double precision, at length one."""
    v = np.frombuffer(raw, kind).astype(np.float64).reshape(n, -1)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _vectors(batch: pa.RecordBatch, lo: int, hi: int, kind: str) -> np.ndarray:
    column = batch.column("vec")
    offsets = np.frombuffer(column.buffers()[1], "<i4", column.offset + len(column) + 1)[column.offset :]
    return units(column.buffers()[2][int(offsets[lo]) : int(offsets[hi])].to_pybytes(), hi - lo, kind)


def _runs(it: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """(batch, first, last) of each run of equal keys; rows of one key are sorted together."""
    held = None
    for batch in it:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        bounds = [0, *change.tolist()]
        for lo, hi in zip(bounds, bounds[1:]):  # noqa: B905
            yield batch, lo, hi
        held = batch.slice(bounds[-1])
    if held is not None and held.num_rows:
        yield held, 0, held.num_rows


def _found(parts: list[tuple], size: int = 0) -> Iterator[pa.RecordBatch]:
    """Candidate rows (u, v, sim, k) out of arrays, once they are more than ``size``."""
    if parts and sum(len(p[0]) for p in parts) > size:
        u, v, sim, k = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sim, pa.float64()), pa.array(k, pa.int64())], ["u", "v", "sim", "k"])


CANDIDATES = "u long, v long, sim double, k long"


class Graph:
    """Distinct vectors (node, lead, copies, dim, vec), written, and their neighbour lists (u, v, sim, k, fresh)."""

    def __init__(self, nodes: DataFrame, kind: str, threshold: float):
        self.nodes, self.kind, self.threshold, self.lists, self.n = nodes, kind, threshold, None, nodes.count()

    def info(self, groups: DataFrame | None) -> DataFrame:
        """(node, dim, vec, grp): vectors of one group are not compared; no group is -1."""
        nodes = self.nodes.select("node", "dim", "vec")
        if groups is None:
            return nodes.withColumn("grp", F.lit(-1).cast("long"))
        return nodes.join(groups, "node", "left").withColumn("grp", F.coalesce("grp", F.lit(-1).cast("long")))

    def seeds(self, info: DataFrame, seed: int, k: int = K, grouped: bool = False) -> DataFrame:
        """Candidates from windows over the vectors in the order of their hyperplane codes, of all or of ``grouped`` ones."""
        kind = self.kind

        def code(it):
            planes: dict[int, np.ndarray] = {}
            powers = 1 << np.arange(BITS, dtype=np.int64)[::-1]
            for batch in it:
                for dim in np.unique(batch.column("dim").to_numpy()).tolist():
                    own = batch.filter(pa.array(batch.column("dim").to_numpy() == dim))
                    if dim not in planes:
                        planes[dim] = np.random.default_rng([seed, dim]).standard_normal((TABLES * BITS, dim))
                    signs = _vectors(own, 0, own.num_rows, kind) @ planes[dim].T > 0
                    codes = signs.reshape(-1, TABLES, BITS) @ powers
                    for t in range(TABLES):
                        yield pa.RecordBatch.from_arrays([pa.array([t] * own.num_rows, pa.int64()), pa.array(codes[:, t]), *(own.column(c) for c in ("dim", "node", "vec", "grp"))], ["t", "code", "dim", "node", "vec", "grp"])

        def window(it):
            parts: list[tuple] = []
            for batch, lo, hi in _windows(it):
                node, grp = (batch.column(c).to_numpy()[lo:hi] for c in ("node", "grp"))
                v = _vectors(batch, lo, hi, kind)
                sims = v @ v.T
                sims[(grp[:, None] == grp[None]) & (grp[:, None] >= 0)] = EMPTY
                np.fill_diagonal(sims, EMPTY)
                top = np.argsort(-sims, axis=1)[:, : min(k, hi - lo - 1)]
                sim = np.take_along_axis(sims, top, 1)
                good = ((sim > EMPTY) & ((grp >= 0)[:, None] | (not grouped))).ravel()
                parts.append((np.repeat(node, top.shape[1])[good], node[top].ravel()[good], sim.ravel()[good], np.full(int(good.sum()), k)))
                yield from _found(parts, 50_000)
            yield from _found(parts)

        coded = info.mapInArrow(code, "t long, code long, dim int, node long, vec binary, grp long")
        return coded.repartitionByRange("dim", "t", "code", "node").sortWithinPartitions("dim", "t", "code", "node").mapInArrow(window, CANDIDATES)

    def merge(self, lists: DataFrame | None, found: DataFrame) -> DataFrame:
        """The best places of each list out of what it holds and what was found."""
        rows = found.withColumn("fresh", F.lit(True))
        rows = rows if lists is None else rows.unionByName(lists.withColumn("fresh", F.lit(False)))
        # A pair found again is no fresh one.
        rows = rows.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("k").alias("k"), F.min("fresh").alias("fresh"))
        order = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
        return written(rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= F.greatest(F.col("k"), F.lit(K))).drop("place"), "lists")

    def join_neighbours(self, lists: DataFrame, info: DataFrame) -> DataFrame:
        """Candidates among the neighbours of each vector and those that list it, if one of the two is fresh."""
        kind = self.kind
        ends = lists.groupBy("u").agg(F.min("sim").alias("least"), F.count(F.lit(1)).alias("n"), F.max("k").alias("k"))
        ends = ends.select(F.col("u").alias("m"), F.when(F.col("n") < F.col("k"), EMPTY).otherwise(F.col("least")).alias("least"), "k")
        both = lists.select(F.col("u").alias("w"), F.col("v").alias("m"), "fresh").unionByName(lists.select(F.col("v").alias("w"), F.col("u").alias("m"), "fresh"))
        both = both.groupBy("w", "m").agg(F.max("fresh").alias("fresh"))
        met = both.groupBy("w").agg(F.count(F.lit(1)).alias("met"), F.max("fresh").alias("any")).filter("any AND met > 1").drop("any")
        # A vector that very many list is dealt out in pieces.
        pieces = F.greatest(F.lit(1), F.ceil(F.col("met") / LOCAL))
        own = both.join(met, "w").withColumn("piece", F.pmod(F.xxhash64("m", "w"), pieces)).drop("met")
        own = own.join(ends, "m", "left").withColumns({"least": F.coalesce("least", F.lit(EMPTY)), "k": F.coalesce("k", F.lit(K).cast("long"))})
        own = own.join(info.drop("dim").withColumnRenamed("node", "m"), "m")

        def local(it):
            parts: list[tuple] = []
            for batch, lo, hi in _runs(it, ["w", "piece"]):
                if hi - lo < 2:
                    continue
                m, fresh, least, k, grp = (batch.column(c).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in ("m", "fresh", "least", "k", "grp"))
                fresh = fresh.astype(bool)
                if not fresh.any():
                    continue
                v = _vectors(batch, lo, hi, kind)
                sims = v @ v.T
                good = (fresh[:, None] | fresh[None]) & (sims > least[:, None]) & ((grp[:, None] != grp[None]) | (grp[:, None] < 0))
                np.fill_diagonal(good, False)
                a, b = np.nonzero(good)
                parts.append((m[a], m[b], sims[a, b], k[a]))
                yield from _found(parts, 50_000)
            yield from _found(parts)

        return own.repartition("w", "piece").sortWithinPartitions("w", "piece").mapInArrow(local, CANDIDATES)

    def descend(self, lists: DataFrame, info: DataFrame) -> DataFrame:
        """Rounds of neighbour joins until few places change."""
        for _ in range(ROUNDS):
            changed = lists.agg(F.count_if("fresh").alias("n"), F.count_if(F.col("fresh") & (F.col("sim") >= self.threshold)).alias("links")).first()
            if changed["n"] <= FEW * K * self.n and not changed["links"]:
                break
            lists = self.merge(lists, self.join_neighbours(lists, info))
        return lists

    def saturated(self, lists: DataFrame) -> DataFrame:
        """(node, k) of the lists that hold links only."""
        full = lists.groupBy("u").agg(F.min("sim").alias("least"), F.count(F.lit(1)).alias("n"), F.max("k").alias("k"))
        return full.filter((F.col("n") >= F.greatest(F.col("k"), F.lit(K))) & (F.col("least") >= self.threshold)).select(F.col("u").alias("node"), "k")

    def enlarge(self, lists: DataFrame) -> DataFrame | None:
        """``lists`` with more places where they are saturated and may grow, all of them to be joined again."""
        grown = written(self.saturated(lists).filter(F.col("k") < K_MOST).select(F.col("node").alias("u"), F.lit(True).alias("grows")), "grown")
        if not grown.take(1):
            return None
        k = F.when(F.col("grows"), F.lit(K_MOST).cast("long")).otherwise(F.col("k"))
        return written(lists.join(grown, "u", "left").select("u", "v", "sim", k.alias("k"), F.coalesce("grows", F.col("fresh")).alias("fresh")), "lists")

    def search(self, seed: int, lists: DataFrame | None = None) -> DataFrame:
        info = self.info(None)
        lists = self.descend(self.merge(lists, self.seeds(info, seed)), info)
        while (grown := self.enlarge(lists)) is not None:
            lists = self.descend(grown, info)
        return lists

    def edges(self, lists: DataFrame) -> DataFrame:
        """(a, b) of the links that lists hold, each once."""
        links = lists.filter(F.col("sim") >= self.threshold)
        return links.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()

    def closed(self, lists: DataFrame, roots: DataFrame) -> DataFrame:
        """(node, grp): members of all components with a saturated list; ``grp`` is the component's root."""
        member = self.nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("grp"))
        full = self.saturated(lists).join(member, "node").select("grp").distinct()
        return member.join(full, "grp", "left_semi").select("node", "grp")


def _windows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """Overlapping windows over rows of one dimension and table; codes in order."""
    held = None
    for batch in it:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        key = batch.column("dim").to_numpy().astype(np.int64) * TABLES + batch.column("t").to_numpy()
        bounds = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        held = None
        for lo, hi in zip(bounds, bounds[1:]):  # noqa: B905
            at = lo
            while True:
                if hi == len(key) and hi - at <= WINDOW:  # the rows may go on in the next batch
                    held = batch.slice(at)
                    break
                if hi - at > 1:
                    yield batch, at, min(at + WINDOW, hi)
                if at + WINDOW >= hi:
                    break
                at += WINDOW // 2
    if held is not None and held.num_rows > 1:
        yield held, 0, held.num_rows


def count_links(members: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(node, n): links of every vector of ``members`` (node, grp, copies, vec) within its group.

    A group's members are dealt into blocks, and every pair of blocks is one task's matrix of
    similarities, of which only sums leave it.
    """
    sizes = members.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = members.join(sizes, "grp").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "vec")

    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        own, node, copies, i = (batch.column(c).to_numpy() for c in ("own", "node", "copies", "i"))
        v = _vectors(batch, 0, batch.num_rows, kind)
        left = own == i[0]
        if left.all():
            near = v @ v.T >= threshold
            np.fill_diagonal(near, False)
            return pa.table({"node": node, "n": (near @ copies).astype(np.int64)})
        near = v[left] @ v[~left].T >= threshold
        return pa.table({"node": np.concatenate([node[left], node[~left]]), "n": np.concatenate([near @ copies[~left], copies[left] @ near]).astype(np.int64)})

    return dealt.groupBy("grp", "i", "j").applyInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def audit(nodes: DataFrame, links: DataFrame, kind: str, threshold: float, size: int = SAMPLE) -> float:
    """Mean share of the links found, over at most ``size`` vectors compared with all."""
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(size).select("node", "dim", "vec").collect()
    if not sample:
        return 1.0
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append((r["node"], bytes(r["vec"])))
    asked = {dim: (np.array([i for i, _ in own]), units(b"".join(x for _, x in own), len(own), kind)) for dim, own in by_dim.items()}

    def run(it):
        total: dict[int, np.ndarray] = {}
        for batch in it:
            for dim in set(batch.column("dim").to_pylist()) & set(asked):
                own = batch.filter(pa.array(batch.column("dim").to_numpy() == dim))
                node, copies = own.column("node").to_numpy(), own.column("copies").to_numpy()
                ids, v = asked[dim]
                near = (v @ _vectors(own, 0, own.num_rows, kind).T >= threshold) & (ids[:, None] != node[None])
                total[dim] = total.get(dim, 0) + near @ copies
        for dim, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(asked[dim][0], pa.int64()), pa.array(n, pa.int64())], ["node", "exact"])

    exact = nodes.select("node", "dim", "copies", "vec").mapInArrow(run, "node long, exact long").groupBy("node").agg(F.sum("exact").alias("exact"))
    share = F.least(F.coalesce("n", F.lit(0)), F.col("exact")) / F.col("exact")
    recall = exact.filter("exact > 0").join(links, "node", "left").agg(F.avg(share).alias("recall")).first()["recall"]
    return 1.0 if recall is None else recall


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, seed: int = 11, target: float = TARGET) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``df``.

    Rows are linked where the cosine, in double precision, is ``threshold`` or more; ``component_id`` is
    the smallest id reachable. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, nor do vectors of different dimensions, nor rows with a null id, which are kept.
    Equal vectors are searched once; each row counts as a link of the others. Other columns are ignored.
    ``target`` is the recall below which the search goes on, at most ``AUDITS`` times.
    """
    kind = "<f4" if isinstance(df.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"
    width = 4 if kind == "<f4" else 8
    packed = written(pack(df, id_col, vector_col, kind), "vectors")
    used = packed.filter("vec IS NOT NULL")
    distinct = used.groupBy("vec").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("copies"))
    nodes = written(distinct.select(F.monotonically_increasing_id().alias("node"), "lead", "copies", (F.length("vec") / width).cast("int").alias("dim"), "vec"), "nodes")
    graph, lists, copies = Graph(nodes, kind, threshold), None, nodes.select("node", "copies")
    for k in range(AUDITS):
        lists = graph.search(seed + 1000 * k, lists)
        edges = written(graph.edges(lists), "edges")
        roots = components(edges)
        closed = written(graph.closed(lists, roots), "closed")
        for step in range(FOREIGN):
            if not closed.take(1):
                break
            # Members of closed components look for neighbours elsewhere; what they find joins components.
            info = written(graph.info(closed), "info")
            group = closed.select(F.col("node").alias("u"), F.col("grp").alias("gu")), closed.select(F.col("node").alias("v"), F.col("grp").alias("gv"))
            outside = lists.join(group[0], "u", "left").join(group[1], "v", "left").filter("gu IS NULL OR gv IS NULL OR gu != gv").drop("gu", "gv")
            away = graph.descend(graph.merge(outside, graph.seeds(info, seed + 1000 * k + 7 * (step + 1), grouped=True)), info)
            known = edges.count()
            edges = written(edges.unionByName(graph.edges(away)).distinct(), "edges")
            if edges.count() == known:
                break
            roots = components(edges)
            member = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("grp"))
            inside = closed.select("node").unionByName(graph.saturated(away).select("node"))
            closed = written(member.join(inside.join(member, "node").select("grp").distinct(), "grp", "left_semi").select("node", "grp"), "closed")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        open_ = both.join(closed.select(F.col("node").alias("a")), "a", "left_anti")
        listed = open_.join(copies.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("n"))
        counted = count_links(closed.join(nodes.select("node", "copies", "vec"), "node"), kind, threshold)
        links = written(listed.unionByName(counted), "links")
        if audit(nodes, links, kind, threshold) >= target:
            break
    found = nodes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = found.groupBy("root").agg(F.min("lead").alias("component_id"))
    found = found.join(least, "root").select("vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    linked = used.join(found, "vec").select("id", "n_links", "component_id")
    alone = packed.filter("vec IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", kept)
