"""Ordered windows: modes by first sight, carried values, runs and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen_mode(df: DataFrame, by: list[str], value: str, order: list[str], out: str = "mode") -> DataFrame:
    """The most frequent value of each group, of equals the one seen first; null values don't count.

    Counts are reduced by value before groups meet, and a group's winner is a plain maximum.
    """
    order_key = F.struct(*[F.col(c) for c in order])
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"), F.min(order_key).alias("_first"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct((-F.col("_n")).alias("n"), F.col("_first").alias("first"))).alias(out))


def carry_forward(df: DataFrame, by: list[str], order: list[str], value: Column, out: str = "active") -> DataFrame:
    """The last value at or before each row that isn't null."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def bracket(df: DataFrame, by: list[str], order: list[str], value: Column, before: str = "before", after: str = "after") -> DataFrame:
    """The nearest values that aren't null strictly before and strictly after each row."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({
        before: F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        after: F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    })


def nearest_value(df: DataFrame, by: list[str], order: list[str], value: Column, default: Column, out: str = "nearest") -> DataFrame:
    """The latest value at or before each row, else the earliest after it, else default."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.coalesce(
        F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)), default,
    ))


def trim_leading(df: DataFrame, by: list[str], order: str, active: Column) -> DataFrame:
    """Drop the rows before each group's first active one, and groups that have none."""
    start = F.min(F.when(active, F.col(order))).over(Window.partitionBy(*by))
    return df.withColumn("_start", start).where(F.col(order) >= F.col("_start")).drop("_start")


def renumber(df: DataFrame, by: list[str], order: list[str], out: str = "number") -> DataFrame:
    """Numbers from 1 in order."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_where(df: DataFrame, by: list[str], order: str, condition: Column, out: str = "start") -> DataFrame:
    """The least order of each group at which the condition holds, null if nowhere."""
    return df.groupBy(*by).agg(F.min(F.when(condition, F.col(order))).alias(out))


def section_letters(groups: DataFrame, first: str, refrain: str, last: str, every: int) -> DataFrame:
    """Rows (…, measure, letter, breaks) of sections: at first, at refrain, then every so many measures to last; no letter after Z.

    A refrain at first gives two letters there. All but the first section begin a new system.
    """
    start = F.coalesce(F.col(refrain), F.col(first))
    more = F.when(start + every <= F.col(last), F.sequence(start + every, F.col(last), F.lit(every))).otherwise(F.array().cast("array<int>"))
    head = F.when(F.col(refrain).isNotNull(), F.array(F.col(first), F.col(refrain))).otherwise(F.array(F.col(first)))
    places = F.concat(head.cast("array<int>"), more.cast("array<int>"))
    out = groups.select("*", F.posexplode(F.slice(places, 1, 26)).alias("_i", "measure"))
    return out.withColumns({"letter": F.char(F.col("_i") + 65), "breaks": F.col("_i") > 0}).drop("_i")


def drop_repeats(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col(value)) | F.col("_before").isNull()).drop("_before")


def rank_parts(df: DataFrame, by: list[str], rules: list[Column]) -> DataFrame:
    """The first row of each group under the rules."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*rules))).where("_rank = 1").drop("_rank")
