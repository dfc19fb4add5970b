"""Placing points in intervals: forward and backward as-of lookups, and offsets from preceding totals.

Both lookups sort points and boundaries together and carry the boundary along, so that no pair of a point and a boundary is
made; a key with very many rows is sorted with spill, and needs no memory of its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exclusive_offset(df: DataFrame, by: list[str], order: list[str], size: str, out: str = "offset") -> DataFrame:
    """df with the sum of size over the rows before, 0 for the first."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(size).over(w), F.lit(0)))


def locate(points: DataFrame, bars: DataFrame, by: list[str], x: str, bar_x: str, number: str) -> DataFrame:
    """points with measure (number of the first bar at or right of x) and frac (place between that bar and the one before).

    The first bar's interval begins at 0; frac is kept within 0 and 0.99, and is 0 where the interval has no width. Beyond
    the last bar: its number and 0.99. Without bars, or for a null x, both are null. Of bars at one place the least number counts.
    """
    w = Window.partitionBy(*by).orderBy(bar_x)
    b = bars.where(F.col(bar_x).isNotNull()).groupBy(*by, bar_x).agg(F.min(number).alias("_m"))
    b = b.select(*by, F.col(bar_x).cast("double").alias("_x"), F.struct(F.col(bar_x).cast("double").alias("x"), F.lag(bar_x, 1, 0.0).over(w).cast("double").alias("left"), F.col("_m").alias("m")).alias("_bar"))
    cols = points.columns
    rows = points.withColumns({"_x": F.col(x).cast("double"), "_point": F.lit(True)}).unionByName(b.withColumn("_point", F.lit(False)), allowMissingColumns=True)
    seen = Window.partitionBy(*by).orderBy(F.desc_nulls_last("_x"), "_point").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*by)
    rows = rows.withColumns({"_next": F.last("_bar", ignorenulls=True).over(seen), "_last": F.max("_bar").over(all_)}).where("_point")
    bar, at = F.col("_next"), F.col("_x")
    width = bar["x"] - bar["left"]
    frac = F.when(width <= 0, 0.0).otherwise(F.least(F.greatest((at - bar["left"]) / width, F.lit(0.0)), F.lit(0.99)))
    return rows.select(
        *cols,
        F.when(at.isNull(), None).otherwise(F.coalesce(bar["m"], F.col("_last")["m"])).alias("measure"),
        F.when(at.isNull() | F.col("_last").isNull(), None).when(bar.isNull(), 0.99).otherwise(frac).alias("frac"),
    )


def nearest_below(points: DataFrame, lines: DataFrame, by: list[str], y: str, line_y: str, name: str, least: float | None = None, most: float | None = None) -> DataFrame:
    """points with line (name of the nearest line at or below y, the least name of equals) and gap (line_y - y); rows whose gap lies
    outside least and most, or without a line, are left out if either is given."""
    b = lines.where(F.col(line_y).isNotNull()).groupBy(*by, line_y).agg(F.min(name).alias("_n"))
    b = b.select(*by, F.col(line_y).cast("double").alias("_y"), F.struct(F.col(line_y).cast("double").alias("y"), F.col("_n").alias("n")).alias("_line"))
    rows = points.withColumns({"_y": F.col(y).cast("double"), "_point": F.lit(True)}).unionByName(b.withColumn("_point", F.lit(False)), allowMissingColumns=True)
    seen = Window.partitionBy(*by).orderBy(F.desc_nulls_last("_y"), "_point").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_found", F.last("_line", ignorenulls=True).over(seen)).where("_point")
    line = F.when(F.col("_y").isNotNull(), F.col("_found"))
    out = rows.select(*points.columns, line["n"].alias("line"), (line["y"] - F.col("_y")).alias("gap"))
    return out if least is None and most is None else out.where(F.col("gap").between(-1e308 if least is None else least, 1e308 if most is None else most))


def containing(left: Column, right: Column, x: Column) -> Column:
    """Whether x lies in the interval (left, right]."""
    return (x > left) & (x <= right)
