"""Repairs of measures: merges, fills from rests, spread, verse and range clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOCAL_FLOOR = 52


def merge_measures(elements: DataFrame, measures: DataFrame, spec: DataFrame, by: list[str], measure: str, offset: str, ql: str) -> tuple[DataFrame, DataFrame]:
    """(elements, measures) after merging the groups of spec (by, grp, measure): later measures' elements follow in the group's first
    measure, each shifted by the lengths before; the first takes the whole length, the others go; numbers stay as they are."""
    w = Window.partitionBy(*by, "grp").orderBy(measure)
    placed = measures.join(spec.select(*by, "grp", measure).distinct(), [*by, measure], "left")
    inside = F.col("grp").isNotNull()
    placed = placed.withColumns({
        "_target": F.when(inside, F.first(measure).over(w)).otherwise(F.col(measure)),
        "_shift": F.when(inside, F.coalesce(F.sum(ql).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).otherwise(0.0),
        "_total": F.when(inside, F.sum(ql).over(Window.partitionBy(*by, "grp"))).otherwise(F.col(ql)),
    })
    moved = elements.join(placed.select(*by, measure, "_target", "_shift"), [*by, measure]).withColumns({measure: F.col("_target"), offset: F.col(offset) + F.col("_shift")}).select(*elements.columns)
    kept = placed.where(F.col(measure) == F.col("_target")).withColumn(ql, F.col("_total")).select(*measures.columns)
    return moved, kept


def take_capacity(df: DataFrame, by: list[str], order: list[str], capacity: Column, deficit: Column, out: str = "taken") -> DataFrame:
    """df with how much of each group's deficit its rows cover, in order, each up to its capacity."""
    before = F.coalesce(F.sum(capacity).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn(out, F.least(capacity, F.greatest(deficit - before, F.lit(0))))


def rest_capacity(ql: Column) -> Column:
    """Notes that a rest can become: one at least, and one for each whole quarter of a quarter."""
    return F.greatest(F.lit(1), (ql / 0.25).cast("int"))


def spread(df: DataFrame, items: str, length: Column, out: str = "item", offset: str = "offset") -> DataFrame:
    """A row for each item of an array, evenly over the length; null items leave their place empty."""
    n = F.size(items)
    return df.select("*", F.posexplode(items).alias("_i", out)).withColumn(offset, F.col("_i") * (length / n)).where(F.col(out).isNotNull()).drop("_i")


def swap_lone_verse(df: DataFrame, by: list[str], verse: str, wanted: int = 1, lone: int = 2) -> DataFrame:
    """df with verse lone as wanted, and swapped true, in groups that have no row of verse wanted."""
    none = F.count_if(F.coalesce(F.col(verse), F.lit(1)) == wanted).over(Window.partitionBy(*by)) == 0
    swapped = F.coalesce(none & (F.col(verse) == lone), F.lit(False))
    return df.withColumn("swapped", swapped).withColumn(verse, F.when(F.col("swapped"), F.lit(wanted)).otherwise(F.col(verse)))


def vocal_line(df: DataFrame, kind: str, pitches: str, floor: int = VOCAL_FLOOR) -> DataFrame:
    """Chords become their top note; what lies below the floor becomes a rest; action says what was done (null: nothing)."""
    top = F.array_max(pitches)
    sound = F.col(kind) != "rest"
    low = sound & (top < floor)
    action = F.when(low & (F.col(kind) == "chord"), "chord_to_rest").when(low, "note_to_rest").when(F.col(kind) == "chord", "chord_to_note")
    return df.withColumn("action", action).withColumns({
        pitches: F.when(F.col("action").isNull(), F.col(pitches)).when(F.col("action") == "chord_to_note", F.array(top)).otherwise(F.array().cast("array<int>")),
        kind: F.when(F.col("action").isNull(), F.col(kind)).when(F.col("action") == "chord_to_note", "note").otherwise("rest"),
    })


def strip_unbalanced(text: Column, opening: str, closing: str, remove: list[str]) -> Column:
    """A text without the patterns in remove where opening and closing don't match as often; else as it is."""
    out = text
    for pattern in remove:
        out = F.regexp_replace(out, pattern, "")
    return F.when(F.regexp_count(text, F.lit(opening)) == F.regexp_count(text, F.lit(closing)), text).otherwise(out)


TUPLET_START, TUPLET_STOP = r'<tuplet\b[^>]*type="start"', r'<tuplet\b[^>]*type="stop"'
TUPLET_PARTS = [r"(?s)\s*<tuplet\b[^>]*?(?:/>|>.*?</tuplet>)", r"(?s)\s*<time-modification>.*?</time-modification>"]


def strip_tuplets(measure_xml: Column) -> Column:
    """A measure without tuplets and time modifications where starts and stops differ in number."""
    return strip_unbalanced(measure_xml, TUPLET_START, TUPLET_STOP, TUPLET_PARTS)


def implied_alter(step: Column, alter: Column, explicit: Column, fifths: Column) -> Column:
    """A note's alteration under the active key; an explicit accidental wins, and no key yet changes nothing."""
    from scoreframe.functions.chords import expected_flats, expected_sharps

    key = F.when(F.array_contains(expected_sharps(fifths), step), 1).when(F.array_contains(expected_flats(fifths), step), -1)
    return F.when(explicit | fifths.isNull(), alter).otherwise(F.coalesce(key, alter))
