"""Gaps and islands, and thresholds from gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], order: list[str], position: str, gap: Column | float, out: str = "island") -> DataFrame:
    """df with the number of its island: a new one begins where the position lies more than gap after the row before."""
    w = Window.partitionBy(*by).orderBy(*order)
    fresh = F.when(F.col(position) - F.lag(position).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("_fresh", fresh).withColumn(out, F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_fresh")


def ink_blobs(columns: DataFrame, by: list[str], x: str = "x", blank: int = 10) -> DataFrame:
    """Rows (by, island, x_left, x_right, y_top, y_bottom, ink) of columns with ink: blank empty columns or more part two blobs."""
    inked = columns.where("ink > 0")
    return islands(inked, by, [x], x, float(blank)).groupBy(*by, "island").agg(
        F.min(x).alias("x_left"), F.max(x).alias("x_right"), F.min("y_min").alias("y_top"), F.max("y_max").alias("y_bottom"), F.sum("ink").alias("ink")
    )


def upper_median_gap(df: DataFrame, by: list[str], order: list[str], position: str, factor: float = 1.8, out: str = "threshold") -> DataFrame:
    """Rows (by, out): factor times the upper median of each group's gaps; none for groups of one row.

    The gap of rank n // 2 is picked by its rank, so that no group is gathered.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    gaps = df.withColumn("_gap", F.col(position) - F.lag(position).over(w)).where("_gap is not null")
    ranked = gaps.withColumns({"_r": F.row_number().over(Window.partitionBy(*by).orderBy("_gap")), "_n": F.count("*").over(Window.partitionBy(*by))})
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(*by, (F.col("_gap") * factor).alias(out))


def systems(df: DataFrame, by: list[str], order: list[str], position: str, factor: float = 1.8, keep: int | None = None) -> DataFrame:
    """df with system and place (1, 2, …) in it; gaps over the group's threshold part systems; rows beyond keep are left out."""
    limits = upper_median_gap(df, by, order, position, factor, "_limit")
    placed = islands(df.join(limits, by, "left"), by, order, position, F.coalesce(F.col("_limit"), F.lit(float("inf"))), "system").drop("_limit")
    out = placed.withColumn("place", F.row_number().over(Window.partitionBy(*by, "system").orderBy(*order)))
    return out if keep is None else out.where(F.col("place") <= keep)
