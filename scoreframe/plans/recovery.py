"""Which recognised chords does the export lack, and where do they belong?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.operators.coverage import drop_bare_roots, greedy_cover, missing_rows
from scoreframe.operators.locate import exclusive_offset, locate


def located_chords(glyphs: DataFrame, bars: DataFrame, sheets: DataFrame) -> DataFrame:
    """glyphs with measure_local, measure_frac and measure_global; sheets are counted by number."""
    found = locate(glyphs.where("value is not null"), bars.select("song", "sheet", "staff", F.col("x").alias("bx"), "measure_local"), ["song", "sheet", "staff"], "x", "bx", "measure_local")
    offsets = exclusive_offset(sheets, ["song"], ["sheet"], "n_measures", "_before").select("song", "sheet", "_before")
    out = found.join(offsets, ["song", "sheet"], "left").withColumn("measure_global", F.col("measure") + F.coalesce("_before", F.lit(0)))
    return out.drop("_before").withColumnsRenamed({"measure": "measure_local", "frac": "measure_frac"})


def combined_chords(detected: DataFrame, row: DataFrame) -> DataFrame:
    """Detected chords, and those of the row recogniser that lie apart from them and each other; bare roots beside fuller ones go."""
    columns = ["song", "sheet", "staff", "value", "x", "measure_global", "measure_frac"]
    numbered = row.where("measure_global is not null").select(*columns, F.monotonically_increasing_id().alias("_id")).withColumn("measure_frac", F.coalesce("measure_frac", F.lit(0.0)))
    kept = greedy_cover(detected.where("measure_frac is not null"), numbered, ["song", "measure_global"], "measure_frac", ["_id"]).select("_id")
    late = numbered.join(kept, "_id", "left_semi").drop("_id").withColumn("source", F.lit("row"))
    both = detected.select(*columns).withColumn("source", F.lit("audi")).unionByName(late)
    return drop_bare_roots(both, ["song", "measure_global"], "value", "x", F.col("source") == "row")


def missing_chords(glyphs: DataFrame, bars: DataFrame, sheets: DataFrame, exported: DataFrame) -> DataFrame:
    """Located chords that exported (song, measure, figure) lacks, by song, measure and place."""
    found = located_chords(glyphs, bars, sheets).withColumn("_at", F.when(F.col("measure_global").isNotNull(), F.concat_ws("\x1f", "song", "measure_global")))
    known = exported.withColumn("_at", F.concat_ws("\x1f", "song", "measure"))
    return missing_rows(found, known, "_at", "value", "figure").drop("_at").orderBy("song", F.coalesce("measure_global", F.lit(0)), "x")
