"""Line deduplication against levelled sorted runs of line hashes.

Documents come in batches of ascending ids. A batch's line hashes are merge-anti-joined with the runs
of earlier batches; what is new becomes a run of level 0, and ``fanout`` runs of one level are
compacted into one of the next. A run is a table of (hash, owner), bucketed and sorted by hash, so
joining it moves only the batch. A line stays where its document owns its hash.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowtrail.llm.common import batches, free_name, named, texts, with_fields, written
from rowtrail.plans import scratch

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
BUCKET_KEYS = 4_000_000
LEAST_BUCKETS = 16
HASH = ["h1", "h2"]


def line_hash(line: str) -> tuple[int, int] | None:
    """128 bits of the line's key, as two signed integers; None if the key is too short to count."""
    key = line.strip(BLANKS)
    if len(key) < MIN_CHARS:
        return None
    h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass").lower())  # bytes: only A-Z change
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def line_hashes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h1, h2): each distinct key of at least ten code points once per document row."""
    rows = texts(df, id_col, text_col)
    schema = with_fields(rows, h1=T.LongType(), h2=T.LongType())

    def explode(batch: pa.RecordBatch) -> dict:
        at, h1, h2 = [], [], []
        for i, text in enumerate(batch.column("text")):
            own = {h for line in text.as_py().split("\n") if (h := line_hash(line))}
            at += [i] * len(own)
            for a, b in own:
                h1.append(a)
                h2.append(b)
        return {"id": batch.column("id").take(pa.array(at, pa.int64())), "h1": h1, "h2": h2}

    return rows.mapInArrow(batches(explode, schema), schema)


class LineRuns:
    """Levelled runs of owned line hashes in the shared folder.

    ``runs`` is the state: (level, table) of every live run, oldest first. Runs never overlap, as each
    holds only hashes that no earlier run has, so compaction is a union and needs no aggregation.
    """

    def __init__(self, spark: SparkSession, buckets: int = 16, fanout: int = 2):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.runs: list[tuple[int, str]] = []

    def _write(self, df: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            df.repartition(self.buckets, *HASH).write.bucketBy(self.buckets, *HASH).sortBy(*HASH)
            .option("path", scratch(self.spark, "line-run")).saveAsTable(name)
        )
        self.runs.append((level, name))

    def _compact(self) -> None:
        level = self.runs[-1][0]
        while len(same := [r for r in self.runs if r[0] == level]) >= self.fanout:
            merged = self.spark.table(same[0][1])
            for _, name in same[1:]:
                merged = merged.unionByName(self.spark.table(name))
            self.runs = [r for r in self.runs if r[0] != level]
            self._write(merged, level + 1)
            for _, name in same:
                self.spark.sql(f"DROP TABLE {name}")
            level += 1

    def add(self, keys: DataFrame) -> DataFrame:
        """Take in a batch of (id, h1, h2); return its rows whose hash another document owns.

        ``keys`` must hold ids above those of earlier batches. It is read once per run and twice
        more, so hand in a written table.
        """
        # Partial sums take hot lines to one row per task before the exchange.
        own = keys.groupBy(*HASH).agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("n"))
        own, foreign = written(own, "line-own"), None
        fresh = own.select(*HASH, "owner")
        for _, name in self.runs:
            run = self.spark.table(name)
            hit = own.select(*HASH).hint("merge").join(run, HASH)
            foreign = hit if foreign is None else foreign.unionByName(hit)
            fresh = fresh.hint("merge").join(run.select(*HASH), HASH, "left_anti")
        # Only hashes with a second holder can drop anything.
        again = own.filter("n > 1").select(*HASH, "owner")
        if foreign is not None:
            foreign = written(foreign, "line-hit")
            again = again.join(foreign.select(*HASH), HASH, "left_anti").unionByName(foreign)
        owners = written(again, "line-owner")
        drops = written(keys.join(owners, HASH).filter(F.col("id") != F.col("owner")).select("id", *HASH), "line-drop")
        self._write(fresh, 0)
        self._compact()
        return drops

    def close(self) -> None:
        """Forget the runs' names; their folders expire with the shared folder."""
        for _, name in self.runs:
            self.spark.sql(f"DROP TABLE {name}")
        self.runs = []


def drop_lines(df: DataFrame, drops: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with ``text_col`` cut by the hashes in ``drops``, plus ``n_lines`` and ``n_dropped``."""
    # At most as many hashes as the document has lines.
    own_text, own_lost, own_id = (free_name(df, x) for x in ("_text", "_lost", "_id"))
    lost = drops.groupBy("id").agg(F.collect_set(F.struct(*HASH)).alias(own_lost)).withColumnRenamed("id", own_id)
    joined = df.withColumn(own_text, F.coalesce(named(text_col), F.lit(""))).join(lost, named(id_col) == F.col(own_id), "left").drop(own_id)
    fields = [T.StructField(text_col, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    rest = [f for f in df.schema if f.name not in {text_col, "n_lines", "n_dropped"}]
    schema = T.StructType(rest + fields)

    def cut(batch: pa.RecordBatch) -> dict:
        out, n, gone = [], [], []
        for text, lost in zip(batch.column(own_text), batch.column(own_lost), strict=True):
            text, lost = text.as_py(), lost.as_py()
            lines, lost = text.split("\n"), {(x["h1"], x["h2"]) for x in lost or ()}
            kept = [x for x in lines if line_hash(x) not in lost] if lost else lines
            out.append("\n".join(kept) if lost else text)
            n.append(len(lines))
            gone.append(len(lines) - len(kept))
        return {f.name: batch.column(f.name) for f in rest} | {text_col: out, "n_lines": n, "n_dropped": gone}

    return joined.mapInArrow(batches(cut, schema), schema)


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_batches: int = 4, buckets: int | None = None, fanout: int = 2
) -> DataFrame:
    """``df`` without lines whose key an earlier document holds, plus ``n_lines`` and ``n_dropped``.

    A key is the line without blanks at its ends, A-Z in lower case; keys under ten code points always
    stay. The first holder is the smallest id. Rows that repeat an id are one document; a row with a
    null id keeps all its lines and owns none. A null text is one empty line and comes back as an
    empty text. Columns called ``n_lines`` or ``n_dropped`` are replaced; others are kept. The batches
    split the ids at their quantiles; their number does not change the result. Without ``buckets`` a
    run has one for every ``BUCKET_KEYS`` keys of the table.
    """
    spark = df.sparkSession
    given = line_hashes(df.filter(named(id_col).isNotNull()), id_col, text_col)
    cuts = df.select(F.percentile_approx(named(id_col), [k / n_batches for k in range(1, n_batches)], 1000)).first()[0] if n_batches > 1 else []
    part = F.lit(0)
    for c in cuts or []:
        part = part + (F.col("id") > F.lit(c)).cast("int")
    keys = written(given.withColumn("batch", part), "line-keys")
    runs, drops = LineRuns(spark, buckets or max(LEAST_BUCKETS, -(-keys.count() // BUCKET_KEYS)), fanout), None
    try:
        for k in range(n_batches):
            lost = runs.add(keys.filter(F.col("batch") == k).drop("batch"))
            drops = lost if drops is None else drops.unionByName(lost)
    finally:
        runs.close()
    return drop_lines(df, drops, id_col, text_col)
