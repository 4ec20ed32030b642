"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rowtrail.plans import scratch


def named(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col(f"`{name}`")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under these names; a null text is an empty one. Other columns cannot clash."""
    return df.select(named(id_col).alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text"))


def written(df: DataFrame, label: str = "llm") -> DataFrame:
    """``df`` as a table in the session's shared folder, read back: it survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def with_fields(df: DataFrame, **fields: T.DataType) -> T.StructType:
    """The schema of ``df``'s id column followed by more fields."""
    return T.StructType([df.schema["id"], *(T.StructField(n, t) for n, t in fields.items())])


def free_name(df: DataFrame, name: str) -> str:
    """``name`` or, where ``df`` has such a column, a longer one."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Give back what a task has freed: Python workers, and what they hold, outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def sized(it: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``it`` in batches of about ``most`` bytes: small ones are joined, large ones cut."""
    held, size = [], 0
    for batch in it:
        step = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            if held and size + part.nbytes > most:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield pa.concat_batches(held)


def batches(make: Callable[[pa.RecordBatch], dict[str, object]], schema: T.StructType, most: int | None = None):
    """A function for ``mapInArrow`` from one that makes the columns of a batch, of ``most`` bytes if given."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(it, most) if most else it:
            cols = make(batch)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in zip(arrow, cols.values(), strict=True)],
                schema=arrow,
            )
            del batch, cols
        release()

    return run


class Recent:
    """Values by key, made in batches and kept in two generations.

    When the young generation is full it becomes the old one, and what is asked again moves up; so
    frequent keys stay while rare ones go. ``limit`` bounds the entries of a generation.
    """

    def __init__(self, make: Callable[[list], list], limit: int = 200_000):
        self.make, self.limit, self.young, self.old = make, limit, {}, {}

    def learn(self, keys: set) -> Callable:
        """A function that gives the value of each of ``keys``; they are held besides the limit."""
        if len(self.young) >= self.limit:
            self.young, self.old = {}, self.young
        missing = keys.difference(self.young)
        moved = {k: self.old[k] for k in missing if k in self.old}
        self.young.update(moved)
        fresh = list(missing.difference(moved)) if moved else list(missing)
        self.young.update(zip(fresh, self.make(fresh), strict=True))
        return self.young.__getitem__

    def fetch(self, keys: list) -> list:
        """The value of every key."""
        return list(map(self.learn(set(keys)), keys))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))
