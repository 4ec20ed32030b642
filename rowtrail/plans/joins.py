"""Joins whose small side is measured before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowtrail.plans.lineage import cut

MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 64 << 20


def fits(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """True when ``df`` is proven to hold at most ``max_rows`` rows and ``max_bytes`` of values.

    Reads at most ``max_rows + 1`` rows, so a large table costs no more than the bound.
    """
    size = F.octet_length(F.to_json(F.struct("*")))
    seen = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return seen[0] <= max_rows and seen[1] <= max_bytes


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    salts: int = 1,
    salt_by: list[str] | None = None,
    max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Join ``big`` with a side expected to be small.

    Broadcasts ``small`` only when :func:`fits` proves the bound. Beyond it the join shuffles; with
    ``salts > 1`` the keys of ``big`` are counted and hot ones spread.
    """
    if fits(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    if salts > 1:
        return salted_join(big, small, on, how, salts, salt_by or big.columns)
    return big.join(small, on, how)


# A key with more rows than this is spread over several tasks; at most so many keys are, those with most rows.
HOT_ROWS = 100_000
MAX_HOT_KEYS = 10_000


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], how: str, salts: int, salt_by: list[str]
) -> DataFrame:
    """Shuffle join that spreads each hot key of ``big`` over ``salts`` tasks.

    Only rows of ``small`` with a hot key are repeated. The salt is a hash of row values, so a
    recomputed task places its rows exactly as before.
    """
    counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > HOT_ROWS)
    hot = cut(counts.orderBy(F.desc("_rows")).limit(MAX_HOT_KEYS).select(*[F.col(c).alias(f"_hot_{c}") for c in on], F.lit(True).alias("_hot")))
    if hot.isEmpty():
        return big.join(small, on, how)

    def marked(df: DataFrame) -> DataFrame:
        same = [F.col(c).eqNullSafe(F.col(f"_hot_{c}")) for c in on]
        return df.join(F.broadcast(hot), same, "left").drop(*[f"_hot_{c}" for c in on])

    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")).otherwise(0)
    left = marked(big).withColumn("_salt", spread).drop("_hot")
    repeated = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = marked(small).withColumn("_salt", F.explode(repeated)).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")
