"""Bounding-box filters over WKT and GeoPackage geometries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowtrail.functions.geometry import read_envelope, wkt_in_bbox
from rowtrail.plans import join_small

Box = tuple[float, float, float, float]

# Cell sizes of the join grid are powers of two between these exponents.
MIN_LEVEL, MAX_LEVEL = -30, 40


def bbox_filter(df: DataFrame, geometry: str | None, bbox: Box | None) -> DataFrame:
    """Rows whose first WKT coordinate lies in (min_x, min_y, max_x, max_y), bounds included.

    NULL and unparsable geometries, binary geometries, and tables without a geometry are kept, as
    is everything without a box.
    """
    if geometry is None or bbox is None or df.schema[geometry].dataType.typeName() == "binary":
        return df
    return df.filter(wkt_in_bbox(F.col(geometry), bbox))


def bbox_filter_report(df: DataFrame, geometry: str, bbox: Box, dataset: str = "dataset") -> DataFrame:
    """``kept`` and ``total`` rows per dataset."""
    kept = F.count_if(wkt_in_bbox(F.col(geometry), bbox))
    return df.groupBy(dataset).agg(kept.alias("kept"), F.count(F.lit(1)).alias("total"))


def filter_by_envelope(df: DataFrame, column: str, bbox: Box) -> DataFrame:
    """Rows whose GeoPackage envelope touches the box; blobs without an envelope are kept."""
    min_x, min_y, max_x, max_y = bbox
    env = F.col("_env")
    touches = (env[0] <= max_x) & (env[1] >= min_x) & (env[2] <= max_y) & (env[3] >= min_y)
    rows = df.withColumn("_env", read_envelope(F.col(column)))
    return rows.filter(env.isNull() | touches).drop("_env")


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level))


def bbox_join(df: DataFrame, x: str, y: str, regions: DataFrame) -> DataFrame:
    """Rows of ``df`` with every region whose box holds the point (x, y), bounds included.

    ``regions`` has ``region``, min_x, min_y, max_x, max_y. Rows without coordinates pass every
    box; they come out once, with ``region`` NULL. Each box lies on a grid with cells at least as
    wide as the box, so it covers at most four cells, and points meet boxes by cell.
    """
    widest = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    exact = F.when(widest > 0, F.ceil(F.log2(widest))).otherwise(MIN_LEVEL)
    level = F.greatest(F.least(exact, F.lit(MAX_LEVEL + 1)), F.lit(MIN_LEVEL)).cast("int")
    huge = level > MAX_LEVEL
    boxes = regions.filter((F.col("min_x") <= F.col("max_x")) & (F.col("min_y") <= F.col("max_y")))
    boxes = boxes.select("region", "min_x", "min_y", "max_x", "max_y", level.alias("_level"), huge.alias("_huge"))

    def span(low: str, high: str) -> Column:
        # A box too large for the grid sits in the single cell of its own level.
        cells = F.sequence(_cell(F.col(low), F.col("_level")), _cell(F.col(high), F.col("_level")))
        return F.when(F.col("_huge"), F.array(F.lit(0).cast("bigint"))).otherwise(cells)

    boxes = boxes.withColumn("_level", F.when(F.col("_huge"), MAX_LEVEL + 1).otherwise(F.col("_level")))
    boxes = boxes.withColumn("_cx", F.explode(span("min_x", "max_x")))
    boxes = boxes.withColumn("_cy", F.explode(span("min_y", "max_y"))).drop("_huge")
    # At most one number per grid level: bounded by construction.
    levels = sorted(r[0] for r in boxes.select("_level").distinct().collect())

    located = F.col(x).isNotNull() & F.col(y).isNotNull()
    everywhere = df.filter(~located).withColumn("region", F.lit(None).cast(regions.schema["region"].dataType))
    if not levels:
        return everywhere
    points = df.filter(located).withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels])))
    top = F.col("_level") > MAX_LEVEL
    points = points.withColumns(
        {
            "_cx": F.when(top, 0).otherwise(_cell(F.col(x), F.col("_level"))),
            "_cy": F.when(top, 0).otherwise(_cell(F.col(y), F.col("_level"))),
        }
    )
    met = join_small(points, boxes, ["_level", "_cx", "_cy"], salts=32, salt_by=df.columns)
    inside = F.col(x).between(F.col("min_x"), F.col("max_x")) & F.col(y).between(F.col("min_y"), F.col("max_y"))
    return met.filter(inside).select(*df.columns, "region").unionByName(everywhere)
