"""Note streams, counts, summaries and gates of whole songs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.operators.locate import exclusive_offset

# Confidences needed by texts of up to two characters and by longer ones; blob bounds; floor; shape of an extracted label; window and step of a sweep.
REFINE, SWEEP, BLOB = (0.8, 0.6), (0.90, 0.82), (0.55, 0.55)
BLOB_WIDTH, BLOB_INK = (12, 200), (0.04, 0.45)
CONFIDENCE_FLOOR = 25
EXTRACTOR_CHORD = r"^[A-G][#b]?(?:maj|min|aug|dim|sus|m|M|\+|\-|[0-9])*$"
PASS_STEP = 60


def ranged(notes: DataFrame, song: str, part: int = 0, low: int = 3, high: int = 6) -> DataFrame:
    """One part's single notes of octaves low to high (4 where none is given), numbered from 0 in order; a note without length has 1."""
    octave = F.coalesce("octave", F.lit(4))
    kept = notes.where((F.col("part") == part) & (F.col("kind") == "note")).withColumn("octave", octave).where(F.col("octave").between(low, high))
    ql = F.when(F.coalesce("ql", F.lit(0.0)) == 0, 1.0).otherwise(F.col("ql"))
    return kept.withColumns({"index": F.row_number().over(Window.partitionBy(song).orderBy("seq")) - 1, "alter": F.coalesce("alter", F.lit(0)), "ql": ql})


def song_counts(measures: DataFrame, notes: DataFrame, lyrics: DataFrame, chords: DataFrame, song: str = "song") -> DataFrame:
    """Rows (song, n_measures, n_notes, n_naked, n_chord, v1_lyrics, v2_lyrics) of songs with measures; naked notes have no first verse, and a verse without number is the first.

    notes and lyrics are of single notes, joined on (song, seq).
    """
    v = F.coalesce(F.when(F.col("verse") != 0, F.col("verse")), F.lit(1))
    each = lyrics.groupBy(song, "seq").agg(F.count_if(v == 1).alias("_v1"), F.count_if(v == 2).alias("_v2"))
    n = notes.where("kind = 'note'").join(each, [song, "seq"], "left").groupBy(song).agg(
        F.count("*").alias("n_notes"), F.count_if(F.coalesce("_v1", F.lit(0)) == 0).alias("n_naked"), F.sum(F.coalesce("_v1", F.lit(0))).alias("v1_lyrics"), F.sum(F.coalesce("_v2", F.lit(0))).alias("v2_lyrics")
    )
    c = chords.groupBy(song).agg(F.count("*").alias("n_chord"))
    m = measures.groupBy(song).agg(F.count("*").alias("n_measures"))
    return m.join(n, song, "left").join(c, song, "left").select(song, *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("n_measures", "n_notes", "n_naked", "n_chord", "v1_lyrics", "v2_lyrics")])


def concat_pages(measures: DataFrame, by: list[str], page: str, part: str, number: str) -> DataFrame:
    """measures with numbers that go on from page to page, by the greatest number of part 0 on each; a measure without number counts as 0."""
    n = F.coalesce(number, F.lit(0))
    sizes = measures.groupBy(*by, page).agg(F.coalesce(F.max(F.when(F.col(part) == 0, n)), F.lit(0)).alias("_size"))
    before = exclusive_offset(sizes, by, [page], "_size", "_before").drop("_size")
    return measures.join(before, [*by, page]).withColumn(number, n + F.col("_before")).drop("_before").select(*measures.columns)


def pitch_name(step: Column, alter: Column, octave: Column) -> Column:
    """As B-4: a minus for each flat, a # for each sharp."""
    a = F.coalesce(alter, F.lit(0)).cast("int")
    return F.concat(step, F.when(a < 0, F.repeat(F.lit("-"), -a)).otherwise(F.repeat(F.lit("#"), a)), F.coalesce(octave.cast("string"), F.lit("")))


def summaries(measures: DataFrame, notes: DataFrame, chords: DataFrame, lyrics: DataFrame, by: tuple[str, str] = ("song", "measure")) -> DataFrame:
    """Rows (by, summary): each measure's chords, notes and lyrics in order of seq as a line of HTML; a measure is the unit of memory."""
    listed = lambda df, text, name, between: df.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", text.alias("t")))), lambda i: i["t"]), between, "").alias(name))
    out = measures.select(*by).join(listed(chords, F.col("figure"), "_c", ", "), list(by), "left").join(listed(notes, pitch_name(F.col("step"), F.col("alter"), F.col("octave")), "_n", " "), list(by), "left")
    out = out.join(listed(lyrics, F.coalesce("text", F.lit("")), "_l", " "), list(by), "left")
    parts = [F.concat(F.lit(f"<b>{head}:</b> "), F.col(c)) for head, c in (("Chords", "_c"), ("Notes", "_n"), ("Lyrics", "_l"))]
    return out.select(*by, F.when(F.coalesce("_c", "_n", "_l").isNull(), "<i>(empty)</i>").otherwise(F.concat_ws("<br>", *parts)).alias("summary"))


def tier(conf: Column, text: Column, needed: tuple[float, float] = REFINE) -> Column:
    """Whether a confidence is enough for the text: the first of needed for texts of up to two characters, else the second."""
    return conf >= F.when(F.length(text) <= 2, needed[0]).otherwise(needed[1])


def above_floor(conf: Column) -> Column:
    return conf >= CONFIDENCE_FLOOR


def extractor_shape(text: Column) -> Column:
    """The narrower chord shape: ASCII accidentals after the root alone, no slash."""
    return F.coalesce(text.rlike(EXTRACTOR_CHORD), F.lit(False))


def unvalued(glyphs: DataFrame) -> DataFrame:
    """Chord glyphs that have no value at all; an empty one is a value."""
    return glyphs.where("value is null")


def blob_ok(width: Column, ink: Column) -> Column:
    return width.between(*BLOB_WIDTH) & ink.between(*BLOB_INK)


def joint_confidence(*axes: Column) -> Column:
    """Product of the greatest share of each axis."""
    out = F.lit(1.0)
    for a in axes:
        out = out * F.array_max(a)
    return out


def sweep_edges(width: Column, step: int = PASS_STEP) -> Column:
    """Left edges of the windows of a pass: every step from 0 below the width; the last are cut short."""
    return F.when(width > 0, F.sequence(F.lit(0), width - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def passes(whole: list[DataFrame], windows: DataFrame, left: str, edge: str) -> DataFrame:
    """The tokens of all passes over a strip: whole ones as they are, those of windows moved by their window's edge."""
    out = windows.withColumn(left, F.col(left) + F.col(edge)).drop(edge)
    for w in whole:
        out = out.unionByName(w)
    return out


def first_samples(items: Column, n: int = 8) -> Column:
    """The first n of an array; null if it is empty."""
    return F.when(F.size(items) > 0, F.slice(items, 1, n))
