"""Token counts as delta-maintained rollups.

Every batch of inserts, deletes and revised counts is turned into signed differences against the
ledger of current counts, and the differences add up to totals by source, language and tokenizer
version. A batch is written in three steps, ledger rows, differences, commit; only committed batches
are read, and a batch id that is committed already changes nothing, so a batch can be repeated after
any failure.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowtrail.llm import tokenfile
from rowtrail.llm.common import batches, named, with_fields
from rowtrail.plans import scratch

KEY = ["doc_id", "version"]
GROUP = ["source", "lang", "version"]
CHANGES = ["doc_id", "source", "lang", "version", "n_tokens", "op", "seq"]


class TokenRollup:
    """A rollup in the folder ``path``; a new one below the shared folder by default."""

    def __init__(self, spark: SparkSession, path: str | None = None, id_type: str = "long"):
        self.spark, self.id_type = spark, id_type
        self.path = path or scratch(spark, "token-rollup")
        self._ledger = f"doc_id {id_type}, version string, source string, lang string, n_tokens long, live boolean"
        self._totals = "source string, lang string, version string, n_docs long, n_tokens long"
        if path is None or not self._exists():
            spark.createDataFrame([], "number long, batch_id string, base boolean").write.parquet(f"{self.path}/commits/first")

    def _exists(self) -> bool:
        try:
            self.spark.read.option("recursiveFileLookup", "true").schema("number long").parquet(f"{self.path}/commits")
            return True
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error.getCondition()):
                raise
            return False

    def commits(self) -> list:
        """Committed batches in order, one small row each since the last compaction."""
        spark = self.spark.read.option("recursiveFileLookup", "true").schema("number long, batch_id string, base boolean")
        return sorted(spark.parquet(f"{self.path}/commits").collect(), key=lambda r: r["number"])

    def _read(self, part: str, schema: str, numbers: list[int]) -> DataFrame:
        out = self.spark.createDataFrame([], f"{schema}, number long")
        for n in numbers:
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/{part}/{n}").withColumn("number", F.lit(n).cast("long")))
        return out

    def _live(self) -> list[int]:
        """Numbers of the batches to read: the last compaction and what came after it."""
        done = self.commits()
        base = max((r["number"] for r in done if r["base"]), default=-1)
        return [r["number"] for r in done if r["number"] >= base]

    def _current(self, ledger: DataFrame) -> DataFrame:
        """The newest ledger row of each key."""
        newest = ledger.groupBy(*KEY).agg(F.max("number").alias("number"))
        return ledger.join(newest, [*KEY, "number"])

    def _publish(self, number: int, batch_id: str, base: bool, ledger: DataFrame, totals: DataFrame) -> None:
        ledger.write.mode("overwrite").parquet(f"{self.path}/ledger/{number}")  # leftovers of a failed try go
        totals.write.mode("overwrite").parquet(f"{self.path}/totals/{number}")
        self.spark.createDataFrame([(number, batch_id, base)], "number long, batch_id string, base boolean").coalesce(1).write.parquet(f"{self.path}/commits/{number}")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (see ``CHANGES``) once; False if ``batch_id`` was committed before.

        ``op`` is insert, revise or delete. The change with the largest ``seq`` of a document and
        version counts; equal ones are ordered by op, count and group. An insert of what is there
        acts as a revision, a revision of what is missing as an insert, a delete of what is missing
        as nothing. Null sources and languages are groups of their own; a null count is 0; rows
        without a document id or version are ignored. Other columns are ignored.
        """
        done = self.commits()
        if any(r["batch_id"] == batch_id for r in done):
            return False
        number = max((r["number"] for r in done), default=-1) + 1
        rank = F.struct("seq", (F.col("op") == "delete").alias("gone"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "source", "lang")
        last = changes.select(*CHANGES).filter("doc_id IS NOT NULL AND version IS NOT NULL").groupBy(*KEY).agg(F.max(rank).alias("x"))
        new = last.select(
            *KEY, F.col("x.source").alias("source"), F.col("x.lang").alias("lang"), F.col("x.n_tokens").cast("long").alias("n_tokens"), (~F.col("x.gone")).alias("live")
        )
        live = self._live()
        old = self._read("ledger", self._ledger, live)
        old = self._current(old.join(new.select(*KEY), KEY, "left_semi")).filter("live")
        signed = new.filter("live").select(*GROUP, "n_tokens", F.lit(1).alias("sign")).unionByName(old.select(*GROUP, "n_tokens", F.lit(-1).alias("sign")))
        totals = signed.groupBy(*GROUP).agg(F.sum(F.col("sign").cast("long")).alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        ledger = new.select("doc_id", "version", "source", "lang", "n_tokens", "live")
        self._publish(number, batch_id, False, ledger, totals)
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) of all committed batches, without empty groups."""
        rows = self._read("totals", self._totals, self._live())
        return rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs != 0 OR n_tokens != 0")

    def compact(self) -> None:
        """Fold all committed batches into one; what is read afterwards does not change."""
        done, live = self.commits(), self._live()
        number = max((r["number"] for r in done), default=-1) + 1
        ledger = self._current(self._read("ledger", self._ledger, live)).filter("live").drop("number")
        self._publish(number, f"compaction {number}", True, ledger.select("doc_id", "version", "source", "lang", "n_tokens", "live"), self.totals())


def count_tokens(df: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, h1, h2, n_chars, n_words, n_tokens) of every row's whole text.

    ``h1`` and ``h2`` are 128 bits of the text; a null text counts as an empty one.
    """
    text = F.coalesce(named(text_col), F.lit(""))
    rows = df.select(named(id_col).alias("id"), named("source").cast("string").alias("source"), named("lang").cast("string").alias("lang"), text.alias("text"))
    counts = {n: T.LongType() for n in ("h1", "h2", "n_chars", "n_words", "n_tokens")}
    schema = with_fields(rows, source=T.StringType(), lang=T.StringType(), **counts)

    def run(batch: pa.RecordBatch) -> dict:
        ids, out = tokenfile.word_ids(file, "<u2").encode(batch.column("text")), {n: [] for n in counts}
        for text, own in zip(batch.column("text").to_pylist(), ids, strict=True):
            raw = text.encode()
            h = xxhash.xxh3_128_intdigest(raw)
            values = ((h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), len(text), len(raw.split()), len(own) // 2)
            for n, v in zip(counts, values, strict=True):
                out[n].append(v)
        return {c: batch.column(c) for c in ("id", "source", "lang")} | out

    return rows.mapInArrow(batches(run, schema, tokenfile.SLICE), schema).withColumnRenamed("id", "doc_id")


def change_rows(counted: DataFrame, version: str, op: str, seq: int = 0) -> DataFrame:
    """Changes of one kind from (doc_id, source, lang, n_tokens)."""
    return counted.select("doc_id", "source", "lang", F.lit(version).alias("version"), F.col("n_tokens").cast("long"), F.lit(op).alias("op"), F.lit(seq).alias("seq"))
