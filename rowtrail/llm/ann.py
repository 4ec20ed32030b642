"""Approximate nearest neighbours by collision counting over sorted projections.

Every vector is projected on ``lines`` random directions, and each direction keeps its own sorted
array. A query opens a window around its own projection on every line; the windows widen by virtual
rehashing (the radius grows by a factor, the arrays stay), a vector that falls into at least
``need`` windows collides often enough and is verified by its exact distance, and a query is done
once ``k`` verified vectors lie within the radius that its windows stand for. The index is cut into
blocks of vectors, each with its own arrays, and queries meet every block in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from rowtrail.llm.common import named, written

BLOCK = 8192
QUERIES = 1024


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) with ``v`` in double precision: rows with an id and finite vectors other than zero."""
    v = named(vector_col).cast("array<double>")
    rows = df.select(named(id_col).alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(~bad & F.exists("v", lambda x: x != 0))


def directions(dim: int, lines: int, seed: int) -> np.ndarray:
    """Random unit directions, orthogonal in groups of ``dim``: fixed by the seed."""
    rng, out = np.random.default_rng(seed), []
    while len(out) * dim < lines:
        out.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0].T)
    return np.concatenate(out)[:lines]


class Block:
    """Sorted projections of one block of vectors, and their search.

    The lines' sorted arrays lie behind each other in one array, each shifted beyond the last, so
    that one binary search finds a window's ends on all lines.
    """

    def __init__(self, vectors: np.ndarray, lines: np.ndarray):
        self.vectors, self.lines = vectors, lines
        at = vectors @ lines.T
        order = np.argsort(at, axis=0, kind="stable")
        self.width = 4 * float(np.abs(at).max()) + 1.0
        self.shift = np.arange(len(lines)) * self.width
        self.order = order.T.ravel()
        self.sorted = (np.take_along_axis(at, order, axis=0) + self.shift).T.ravel()
        self.first = np.arange(len(lines)) * len(vectors)

    def search(self, query: np.ndarray, k: int, need: int, start: float, growth: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of the vectors verified for one query."""
        n, last = len(self.vectors), self.first + len(self.vectors)
        # A query beyond all vectors sees its own line only.
        centre = np.clip(query @ self.lines.T, -self.width / 4, self.width / 4)
        hits, seen = np.zeros(n, np.int64), np.zeros(n, bool)
        low = np.searchsorted(self.sorted, centre + self.shift)
        high, radius, found, near, close = low, start, [], [], 0
        while close < k and ((low > self.first).any() or (high < last).any()):
            half = min(radius * reach, self.width / 2)
            lo = np.maximum(np.searchsorted(self.sorted, centre + self.shift - half), self.first)
            hi = np.minimum(np.searchsorted(self.sorted, centre + self.shift + half, side="right"), last)
            begins, sizes = np.concatenate([lo, high]), np.concatenate([low - lo, hi - high])
            total = int(sizes.sum())
            if total:
                ends = np.cumsum(sizes)
                fresh = np.arange(total) + np.repeat(begins - ends + sizes, sizes)
                hits += np.bincount(self.order[fresh], minlength=n)
                new = np.flatnonzero((hits >= need) & ~seen)
                if len(new):
                    seen[new] = True
                    found.append(new)
                    near.append(np.sqrt(((self.vectors[new] - query) ** 2).sum(1)))
            low, high = lo, hi
            close = sum(int((d <= radius).sum()) for d in near)
            radius *= growth
        return (np.concatenate(found), np.concatenate(near)) if found else (np.zeros(0, np.int64), np.zeros(0))


def start_radius(vectors: np.ndarray) -> float:
    """A radius below most neighbours' distances, from a few vectors of the block; only cost depends on it."""
    some = vectors[:: max(1, len(vectors) // 64)][:64]
    d = np.sqrt(np.maximum(((some[:, None] - some[None]) ** 2).sum(2), 0))
    d = d[d > 0]
    return float(d.min()) / 8 if len(d) else 1.0


def nearest(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10,
    lines: int = 64, share: float = 0.7, growth: float = 1.1, reach: float = 0.15, seed: int = 7, block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest vectors found for each id divisible by ``every``.

    ``score`` is the Euclidean distance in double precision; ties go to the smaller id. Vectors that
    are null, zero, or hold null or non-finite components take no part, nor do rows without an id; a
    row never answers a query of its own id. Vectors of other dimensions than a query's are no
    candidates for it. Equal vectors share one place in the index, which lists the k+1 smallest of
    their ids: no other can be among the k nearest. Rows that repeat an id and vector count once.
    ``share`` of the lines is the collision threshold, ``reach`` the half window per unit of radius.
    """
    rows = usable(df, id_col, vector_col)
    # Per distinct vector its smallest ids, kept small on the map side too by the row limit of the window.
    distinct = rows.dropDuplicates(["id", "v"])
    hashed = distinct.withColumn("h", F.xxhash64("v"))
    first = hashed.withColumn("r", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).filter(F.col("r") <= k + 1)
    places = written(first.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("v")), "vectors")
    queries = written(distinct.filter(F.col("id") % every == 0).select("id", "v", F.size("v").alias("dim")), "queries")
    dims = {r["dim"]: r["places"] for r in places.groupBy("dim").agg(F.count(F.lit(1)).alias("places")).collect()}
    asked = {r["dim"]: r["asked"] for r in queries.groupBy("dim").agg(F.count(F.lit(1)).alias("asked")).collect()}
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("id", kind), T.StructField("score", T.DoubleType())])
    out = None
    for dim, n_asked in sorted(asked.items()):
        n_blocks, n_groups = max(1, math.ceil(dims[dim] / block)), max(1, math.ceil(n_asked / QUERIES))
        # Blocks and query groups are dealt by hash; every pair of them is one cogroup of bounded size.
        deal = lambda col, n: F.pmod(F.xxhash64(col), F.lit(n))
        counted = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
        index = places.filter(F.col("dim") == dim).select(
            deal("v", n_blocks).alias("b"), F.explode(counted(n_groups)).alias("g"), "ids", "v"
        )
        ask = queries.filter(F.col("dim") == dim).select(
            F.explode(counted(n_blocks)).alias("b"), deal("id", n_groups).alias("g"), "id", "v"
        )
        found = ask.groupBy("b", "g").cogroup(index.groupBy("b", "g")).applyInArrow(_searcher(dim, k, lines, share, growth, reach, seed, schema), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = df.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = out.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _searcher(dim, k, lines, share, growth, reach, seed, schema):
    def run(ask: pa.Table, index: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = ([], [], [])
        if len(ask) and len(index):
            matrix = lambda t: np.asarray(t.column("v").combine_chunks().values).reshape(-1, dim)
            vectors, ids = matrix(index), index.column("ids").to_pylist()
            own = Block(vectors, directions(dim, lines, seed))
            start, need = start_radius(vectors), max(1, round(share * lines))
            for query_id, query in zip(ask.column("id").to_pylist(), matrix(ask), strict=True):
                at, near = own.search(query, k + 1, need, start, growth, reach)
                if not len(at):
                    continue
                # The k+1 nearest places and all that tie with the last: one of them may be the query's.
                last = np.sort(near)[min(k, len(near) - 1)]
                listed = sorted((d, i) for p, d in zip(at[near <= last].tolist(), near[near <= last].tolist(), strict=True) for i in ids[p] if i != query_id)
                for d, i in listed[:k]:
                    out[0].append(query_id)
                    out[1].append(i)
                    out[2].append(d)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, to_arrow_schema(schema), strict=True)], schema=to_arrow_schema(schema))

    return run
