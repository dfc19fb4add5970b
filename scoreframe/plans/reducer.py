"""From a full score to a lead sheet, all songs in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.functions.chords import kind_suffix
from scoreframe.operators import repair, windows


@dataclass(frozen=True)
class LeadSheet:
    """measures (song, number, source_number, ql, fifths), notes, harmonies, sections (song, measure, letter, breaks), keys (song, section, fifths)."""

    measures: DataFrame
    notes: DataFrame
    harmonies: DataFrame
    sections: DataFrame
    keys: DataFrame


def vocal_part(notes: DataFrame, lyrics: DataFrame, harmonies: DataFrame) -> DataFrame:
    """Rows (song, part): most notes with lyrics, then most chord symbols, then fewest notes, then the highest part; part 0 of songs with neither."""
    n = notes.where("kind <> 'rest'").groupBy("song", "part").agg(F.count("*").alias("n"))
    ly = lyrics.groupBy("song", "part").agg(F.count_distinct("note_seq").alias("lyrics"))
    h = harmonies.groupBy("song", "part").agg(F.count("*").alias("chords"))
    every = notes.select("song", "part").union(harmonies.select("song", "part")).distinct()
    parts = every.join(n, ["song", "part"], "left").join(ly, ["song", "part"], "left").join(h, ["song", "part"], "left").na.fill(0)
    any_ = F.sum(F.col("lyrics") + F.col("chords")).over(Window.partitionBy("song")) > 0
    ranked = windows.rank_parts(parts, ["song"], [F.desc("lyrics"), F.desc("chords"), F.asc("n"), F.desc("part")])
    silent = parts.withColumn("_any", any_).where("not _any and part = 0").select("song", "part")
    return ranked.where("lyrics + chords > 0").select("song", "part").union(silent)


def attach_chords(harmonies: DataFrame, vocal: DataFrame, measures: DataFrame) -> DataFrame:
    """The vocal part's symbols, and of other parts those at places where it has none: the first part's of each place, in measures that it has."""
    mine = harmonies.join(vocal, ["song", "part"], "left_semi")
    other = harmonies.join(vocal, ["song", "part"], "left_anti").join(mine.select("song", "measure", "offset"), ["song", "measure", "offset"], "left_anti")
    first = windows.rank_parts(other, ["song", "measure", "offset"], [F.asc("part"), F.asc("seq")])
    return mine.unionByName(first.join(measures.select("song", F.col("number").alias("measure")), ["song", "measure"], "left_semi"))


def section_keys(measures: DataFrame, refrain: DataFrame) -> DataFrame:
    """Rows (song, section, fifths) of the most frequent key signature before and from the refrain on, the first seen of equals."""
    keyed = measures.join(refrain, "song", "left").withColumn("section", F.when(F.col("refrain").isNull() | (F.col("number") < F.col("refrain")), "verse").otherwise("refrain"))
    each = keyed.select("song", "section", "number", F.posexplode("fifths").alias("i", "f"))
    return windows.first_seen_mode(each, ["song", "section"], "f", ["number", "i"], "fifths")


def reduce_scores(notes: DataFrame, measures: DataFrame, lyrics: DataFrame, harmonies: DataFrame, keep_verse: bool = True, section_bars: int = 8, style: str = "symbolic") -> LeadSheet:
    """Vocal part an octave down with chords made single and low notes made rests, foreign chord symbols attached, the silent intro cut, the verse
    cut if not kept, measures numbered anew, sections lettered, keys by section and displayed suffixes in one style."""
    vocal = vocal_part(notes, lyrics, harmonies)
    bars = measures.join(vocal, ["song", "part"], "left_semi").drop("part")
    chords = attach_chords(harmonies, vocal, bars).drop("part")
    own = notes.join(vocal, ["song", "part"], "left_semi").drop("part")
    lowered = own.withColumn("pitches", F.when(F.col("kind") == "note", F.transform("pitches", lambda p: p - 12)).otherwise(F.col("pitches")))
    if "octave" in own.columns:
        lowered = lowered.withColumn("octave", F.when(F.col("kind") == "note", F.col("octave") - 1).otherwise(F.col("octave")))
    line = repair.vocal_line(lowered, "kind", "pitches")
    sounding = line.where("kind <> 'rest'").select("song", "measure").union(chords.select("song", "measure")).distinct().select("song", F.col("measure").alias("number"), F.lit(True).alias("_on"))
    trimmed = windows.trim_leading(bars.join(sounding, ["song", "number"], "left"), ["song"], "number", F.coalesce("_on", F.lit(False))).drop("_on")
    refrain = windows.first_where(trimmed, ["song"], "number", F.col("left_barline").rlike("double|light-light|heavy-light|repeat"), "refrain")
    if not keep_verse:
        trimmed = trimmed.join(refrain, "song", "left").where("refrain is null or number >= refrain").drop("refrain")
    numbered = windows.renumber(trimmed.withColumnRenamed("number", "source_number"), ["song"], ["source_number"], "number")
    new_number = numbered.select("song", F.col("source_number").alias("measure"), "number")
    moved = lambda df: df.join(new_number, ["song", "measure"]).drop("measure").withColumnRenamed("number", "measure")
    new_refrain = refrain.join(new_number.withColumnRenamed("measure", "refrain"), ["song", "refrain"]).select("song", F.col("number").alias("refrain"))
    groups = numbered.groupBy("song").agg(F.max("number").alias("last")).join(new_refrain, "song", "left").withColumn("first", F.lit(1))
    groups = groups if keep_verse else groups.withColumn("refrain", F.lit(None).cast("int"))
    shown = moved(chords).withColumn("kind_text", F.coalesce(kind_suffix(F.col("kind"), style), "kind_text"))
    return LeadSheet(numbered, moved(line), shown, windows.section_letters(groups, "first", "refrain", "last", section_bars), section_keys(numbered, new_refrain))
