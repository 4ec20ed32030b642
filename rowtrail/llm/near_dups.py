"""Near-duplicate documents by SuperMinHash.

A document is the set of its five-word shingles. SuperMinHash gives every shingle a random permutation
of the signature's slots, so the ranks that one shingle offers to the slots are correlated: all
differ in their whole part. Signatures have a lower variance than plain MinHash, and a document is
finished once no later rank can lower any slot, after two or three ranks for texts of usual length.

Documents of equal sets form one class. Bands of the signatures put classes into buckets, where each
is first compared with the bucket's smallest one; links are confirmed on the full sets and grouped by
union-find. Members of buckets that still hold different groups are then joined by the rare ends of
their sets, which finds every link between groups, so no link between candidates is lost and no
bucket is expanded into all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from rowtrail.llm.common import batches, mix64, texts, with_fields, written

WORDS = 5
BANDS, ROWS = 44, 5  # at a similarity of 0.75 a pair shares a bucket with probability 1 - 7e-6
SLOTS = BANDS * ROWS
SIZE_STEP = 1.1
PERCENT = 75
SLICE = 1 << 16
CACHE = 200_000
GOLDEN, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
FACTORS = np.array([pow(GOLDEN, k, 1 << 64) | 1 for k in range(1, WORDS + 1)], np.uint64)


class WordHashes(dict):
    """64-bit hashes by word; forgets all when it grows beyond its bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(text: bytes, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole UTF-8 text.

    Words are runs without blanks, A-Z in lower case. With fewer words than a shingle has, the whole
    sequence is one shingle; without words there is none.
    """
    words = text.lower().split()  # bytes: ASCII letters and blanks only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    total = np.full(n, len(h) if len(h) < WORDS else WORDS, np.uint64)
    for k in range(min(WORDS, len(h))):
        total += mix64(h[k : k + n] + np.uint64(k)) * FACTORS[k]
    return np.unique(mix64(total))


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures of non-empty sets, one row each; a slot holds rank << 32 | random.

    A large set is taken in parts, whose minima are its own.
    """
    parts = [-(-len(s) // SLICE) for s in sets]
    if max(parts, default=0) > 1:
        whole = _signatures([s[lo : lo + SLICE] for s in sets for lo in range(0, len(s), SLICE)], slots)
        return np.minimum.reduceat(whole, np.cumsum(parts) - parts)
    return _signatures(sets, slots)


def _signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    out, lo = np.empty((len(sets), slots), np.uint64), 0
    sizes = np.array([len(s) for s in sets])
    while lo < len(sets):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), SLICE)))
        x, doc = np.concatenate(sets[lo:hi]), np.repeat(np.arange(hi - lo), sizes[lo:hi])
        best = np.full((hi - lo) * slots, ~np.uint64(0))
        order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), len(x))
        base = np.arange(len(x)) * slots
        for rank in range(slots):
            # The next slot of each shingle's own permutation, by one step of its shuffle.
            draw = mix64(x + np.uint64((rank + 1) * GOLDEN & MASK))
            at = base + rank + ((draw & np.uint64(0xFFFFFFFF)) % np.uint64(slots - rank)).astype(np.int64)
            slot = order[at]
            order[at] = order[base + rank]
            np.minimum.at(best, doc * slots + slot, np.uint64(rank << 32) | (draw >> np.uint64(32)))
            open_ = (best.reshape(-1, slots).max(1) >> np.uint64(32)) > rank  # a later rank may still be lower
            if not open_.any():
                break
            live = open_[doc]
            x, doc, base = x[live], doc[live], base[live]
        out[lo:hi] = best.reshape(-1, slots)
        lo = hi
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band; the band's number is part of it."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        key = mix64(key * np.uint64(GOLDEN) + mix64(parts[:, :, k]))
    return key.view(np.int64)


def _halves(found: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(found.tobytes())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def sketch(rows: DataFrame) -> DataFrame:
    """(id, n, k1, k2, bands) of (id, text): set size, digest of the set, bucket keys (null if empty)."""
    schema = with_fields(rows, n=T.LongType(), k1=T.LongType(), k2=T.LongType(), bands=T.ArrayType(T.LongType()))

    hashes = WordHashes()  # sent empty, so each task fills its own

    def run(batch: pa.RecordBatch) -> dict:
        raw, n, k1, k2, bands = batch.column("text").cast(pa.binary()), [], [], [], []
        for lo in range(0, len(raw), 64):
            sets = [shingles(t, hashes) for t in raw[lo : lo + 64].to_pylist()]
            full = iter(band_keys(signatures([s for s in sets if len(s)])).tolist())
            for s in sets:
                a, b = _halves(s)
                n.append(len(s))
                k1.append(a)
                k2.append(b)
                bands.append(next(full) if len(s) else None)
        return {"id": batch.column("id"), "n": n, "k1": k1, "k2": k2, "bands": bands}

    return rows.mapInArrow(batches(run, schema), schema)


def full_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, n, set): the shingle sets of the rows named by ``wanted`` (cid, k1, k2)."""
    own = rows.join(wanted.select(F.col("cid").alias("id")).distinct(), "id", "left_semi")
    schema = with_fields(own, k1=T.LongType(), k2=T.LongType(), set=T.ArrayType(T.LongType()))

    hashes = WordHashes()  # sent empty, so each task fills its own

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t.as_py(), hashes) for t in batch.column("text").cast(pa.binary())]
        halves = [_halves(s) for s in sets]
        return {"id": batch.column("id"), "k1": [a for a, _ in halves], "k2": [b for _, b in halves], "set": [s.view(np.int64) for s in sets]}

    sets = own.mapInArrow(batches(run, schema), schema).withColumnRenamed("id", "cid")
    # Repeated rows have one set; rows that repeat an id with other texts have one each.
    return sets.join(wanted, ["cid", "k1", "k2"], "left_semi").dropDuplicates(["cid", "k1", "k2"]).select("cid", F.size("set").alias("n"), "set")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose full sets are similar."""
    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("set").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT
    joined = pairs.join(right, "b").join(left, "a").filter(fits)
    return joined.filter(both * 100 >= (F.col("na") + F.col("nb") - both) * PERCENT).select("a", "b").distinct()


def _local_forest(it):
    """Union-find over the edges of one task, in slices of bounded size: each node with its root."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    def flush():
        rows = [(x, r) for x in parent if (r := root(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], kind), pa.array([r for _, r in rows], kind)], ["a", "b"])

    kind = pa.int64()
    for batch in it:
        kind = batch.schema.field("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:
            yield flush()
    if parent:
        yield flush()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b) that are not their component's smallest node.

    Union-find inside each task leaves a forest; forests are joined by alternating stars, in rounds
    that grow with the logarithm of the longest chain. Every round is a written table.
    """
    kind = edges.schema["a"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    now = written(edges.select("a", "b").mapInArrow(_local_forest, schema), "star")
    while True:
        # Every neighbour above a node is hung on the smallest of all its neighbours and itself.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = written(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), "star")
        # A node's smaller neighbours, and the node, are hung on the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        rest = large.join(low, "a").filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = written(low.withColumnRenamed("low", "b").unionByName(rest).distinct(), "star")
        many = now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
        inner = now.select(F.col("b").alias("a")).join(now.select("a"), "a", "left_semi")
        if not many.unionByName(inner).take(1):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _buckets(members: DataFrame) -> DataFrame:
    """Rows of (key, cid, n) in buckets of two or more, with the bucket's smallest member ``lead``."""
    heads = members.groupBy("key").agg(F.min("cid").alias("lead"), F.max("cid").alias("last")).filter("lead != last")
    return members.join(heads.drop("last"), "key")


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))


def _prefix_pairs(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """All pairs (a, b) of different groups among ``nodes`` (cid, root) that the order of their shingles leaves possible.

    Shingles are ordered from rare to frequent. If the first common one of two sets of n >= m shingles
    has p and q before it, they share at most min(n - p, m - q); a link needs 7 of them for every
    3 (n + m). So only the first seventh of the smaller set is indexed and little more of the larger
    one looks it up, by size class. Passages that many share come last and are hardly ever met.
    """
    own = sets.join(nodes, "cid").withColumn("own", F.xxhash64("set"))
    each = own.select("cid", "root", "n", "own", F.explode("set").alias("g"))
    each = each.join(each.groupBy("g").agg(F.count(F.lit(1)).alias("f")), "g")
    place = F.row_number().over(Window.partitionBy("cid", "own").orderBy("f", "g")) - 1
    early = written(each.withColumn("p", place).filter("4 * p <= n AND f > 1").drop("f", "own"), "prefix")
    step = float(np.log(SIZE_STEP))
    class_of = lambda size: F.floor(F.log(size) / F.lit(step)).cast("int")
    index = early.filter("7 * p <= n").select("g", F.col("cid").alias("b"), F.col("root").alias("rb"), F.col("n").alias("m"), F.col("p").alias("q"), class_of(F.col("n")).alias("class"))
    # One class more at the lower end, against rounding; the exact condition follows.
    ask = early.withColumn("class", F.explode(F.sequence(class_of(F.col("n") * 0.75) - 1, class_of(F.col("n")))))
    ask = ask.filter(7 * (F.col("n") - F.col("p")) >= 3 * (F.col("n") + F.pow(F.lit(SIZE_STEP), F.col("class")) - 1))
    pairs = ask.join(index, ["g", "class"]).filter("m <= n AND cid != b AND root != rb AND 7 * least(n - p, m - q) >= 3 * (n + m)")
    return pairs.select(F.least("cid", "b").alias("a"), F.greatest("cid", "b").alias("b")).distinct()


def _star(buckets: DataFrame) -> DataFrame:
    return buckets.filter("cid != lead").select(F.col("lead").alias("a"), F.col("cid").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``df``.

    Rows are linked where the sets have a Jaccard similarity of 0.75 or more, and ``component_id`` is
    the smallest id reachable. A null or text without words is the empty set, linked with nothing.
    Rows that repeat an id are compared by their own texts. A row with a null id is linked with
    nothing and kept. Other columns are ignored.
    """
    rows = texts(df, id_col, text_col)
    sketched = written(sketch(rows), "sketch")
    used = sketched.filter("n > 0 AND id IS NOT NULL")
    classes = written(used.groupBy("k1", "k2").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("copies")), "classes")
    heads = used.join(classes.drop("copies").withColumnRenamed("cid", "id"), ["id", "k1", "k2"]).dropDuplicates(["id", "k1", "k2"]).withColumnRenamed("id", "cid")
    members = written(_buckets(heads.select(F.explode("bands").alias("key"), "cid", "n")), "buckets")
    wanted = members.select("cid").distinct()
    sets = written(full_sets(rows, heads.select("cid", "k1", "k2").join(wanted, "cid", "left_semi")), "sets")
    asked = written(_star(members), "pairs")
    links = written(confirm(asked, sets), "links")
    roots = components(links)

    # What the first round leaves open: members of buckets that hold several groups.
    rooted = written(_rooted(members, roots), "rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("key")
    nodes = written(rooted.join(mixed, "key", "left_semi").select("cid", "root").distinct(), "open")
    more = written(confirm(written(_prefix_pairs(sets, nodes).join(asked, ["a", "b"], "left_anti"), "pairs"), sets), "links")
    if more.take(1):
        roots = components(links.unionByName(more))

    shared = classes.filter("copies > 1").select("k1", "k2", "cid")
    out = sketched.select("id", "n", "k1", "k2").join(shared, ["k1", "k2"], "left")
    out = out.withColumn("cid", F.when(F.col("id").isNotNull(), F.coalesce("cid", "id")))
    out = out.join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    component = F.coalesce("root", "cid")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
