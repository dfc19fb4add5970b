"""Rule flags on measures, and reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from scoreframe.operators.windows import first_seen_mode


def suspicious(measures: DataFrame, by: list[str], number: str, notes: str, chords: str, lyrics: str, length: str, least_lyrics: int = 10) -> DataFrame:
    """Rows (by, measure, reason) of measures with chords but no notes, of unusual length, or without lyrics between measures that have some.

    The usual length is the most frequent, first seen of equals; neighbours are those of the numbers before and after.
    """
    usual = first_seen_mode(measures, by, length, [number], "_usual")
    m = measures.join(usual, by, "left").withColumn("_lyrics", F.sum(lyrics).over(Window.partitionBy(*by)))
    # neighbours by number, whatever rows stand between: a range frame over the numbers
    w = Window.partitionBy(*by).orderBy(number)
    before, after = (F.max(F.when(F.col(lyrics) > 0, 1)).over(w.rangeBetween(k, k)) for k in (-1, 1))
    flags = {
        "all_rests_with_chords": (F.col(notes) == 0) & (F.col(chords) > 0),
        "duration_mismatch": (F.abs(F.col(length) - F.col("_usual")) > 0.01) & (F.col(length) > 0),
        "missing_lyrics": (F.col("_lyrics") > least_lyrics) & (F.col(notes) > 0) & (F.col(lyrics) == 0) & (before == 1) & (after == 1),
    }
    marked = m.select(*by, F.col(number).alias("measure"), F.array(*[F.when(cond, F.lit(name)) for name, cond in flags.items()]).alias("_r"))
    return marked.select(*by, "measure", F.explode("_r").alias("reason")).where("reason is not null")


def flag_table(flags: DataFrame, song: str, reason: str, reasons: list[str]) -> DataFrame:
    """A row for each song with a count for each reason and a total, and the row TOTAL of all songs; one pass, no pivot of rows."""
    counts = [F.count_if(F.col(reason) == r).alias(r) for r in reasons]
    grouped = flags.rollup(song).agg(*counts, F.count_if(F.col(reason).isin(*reasons)).alias("total"), F.grouping(song).alias("_all"))
    return grouped.withColumn(song, F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(song).cast("string"))).drop("_all")


def with_status(listing: DataFrame, results: DataFrame, key: str, failed: Column) -> DataFrame:
    """All of listing with status: missing where there is no result, error where it failed, else ok."""
    r = results.withColumn("_failed", failed).withColumn("_there", F.lit(True))
    return listing.join(r, key, "left").withColumn("status", F.when(F.col("_there").isNull(), "missing").when(F.col("_failed"), "error").otherwise("ok")).drop("_failed", "_there")


def profile(df: DataFrame, by: list[str], metrics: dict[str, Column]) -> DataFrame:
    """One wide aggregate."""
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in metrics.items()])
