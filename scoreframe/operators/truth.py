"""Truth and keys brought to whole songs: every song of a book in one job, with counts of what was done."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.operators import overlay, repair, windows
from scoreframe.sources.tables import written

MIDDLE_C = 60


@dataclass(frozen=True)
class Song:
    """measures (song, measure, ql), chords (song, measure, offset, figure), notes (song, measure, seq, sub, kind, start, ql, pitches),
    lyrics (song, seq, sub, verse, text) and marks (song, measure, text). seq names a note within its song; sub is 0 but for notes made from one rest."""

    measures: DataFrame
    chords: DataFrame
    notes: DataFrame
    lyrics: DataFrame
    marks: DataFrame


def _counted(df: DataFrame, name: str, n: Column | None = None) -> DataFrame:
    return df.groupBy("song").agg((F.count("*") if n is None else F.coalesce(F.sum(n), F.lit(0))).cast("long").alias("n")).select("song", F.lit(name).alias("name"), "n")


def merge(song: Song, spec: DataFrame) -> Song:
    """The song with the measures of each group of spec (song, grp, measure) as one, where the group's least measure is there; a measure in two groups
    belongs to the lesser."""
    sized = spec.dropDuplicates(["song", "grp", "measure"]).withColumns({"_n": F.count("*").over(w := Window.partitionBy("song", "grp")), "_least": F.min("measure").over(w)}).where("_n >= 2")
    there = sized.join(song.measures.select("song", F.col("measure").alias("_least")).distinct(), ["song", "_least"], "left_semi").groupBy("song", "measure").agg(F.min("grp").alias("grp"))
    places = song.measures.select("song", "measure", F.col("measure").alias("_old"), F.lit(0.0).alias("_moved"))
    moved, kept = repair.merge_measures(places, song.measures, there, ["song"], "measure", "_moved", "ql")
    moved = moved.select("song", F.col("_old").alias("measure"), F.col("measure").alias("_to"), "_moved")

    def follow(df: DataFrame, offset: str | None) -> DataFrame:
        new = {"measure": F.coalesce("_to", "measure")} | ({offset: F.col(offset) + F.coalesce("_moved", F.lit(0.0))} if offset else {})
        return df.join(moved, ["song", "measure"], "left").withColumns(new).select(*df.columns)

    return replace(song, measures=kept, chords=follow(song.chords, "offset"), notes=follow(song.notes, "start"), marks=follow(song.marks, None))


def _injected(song: Song, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes after rests became notes where asked (song, measure, n_words, inject_pitch) has more words than the measure has notes; rests used, with taken)."""
    sound = song.notes.where("kind = 'note'")
    ends = sound.groupBy("song", "measure").agg(
        F.count("*").alias("_n"), F.max("start").alias("_at"), F.max_by(F.element_at("pitches", -1), F.struct("start", "seq", "sub")).alias("_last"), F.min_by(F.element_at("pitches", -1), F.struct("start", "seq", "sub")).alias("_first")
    )
    short = asked.join(ends.select("song", "measure", "_n"), ["song", "measure"], "left").withColumn("_short", F.col("n_words") - F.coalesce("_n", F.lit(0))).where("_short > 0")
    rests = song.notes.where("kind = 'rest'").join(short.select("song", "measure", "inject_pitch", "_short"), ["song", "measure"])
    used = repair.take_capacity(rests, ["song", "measure"], ["start", "seq", "sub"], repair.rest_capacity(F.col("ql")), F.col("_short")).where("taken > 0")
    # what a later measure finds before it: a given pitch where its note is the measure's last, else the measure's own last note
    given = used.groupBy("song", "measure").agg(F.max(F.col("start") + (F.col("taken") - 1) * F.col("ql") / F.col("taken")).alias("_in"), F.max("inject_pitch").alias("_given"))
    near = song.measures.select("song", "measure").join(ends, ["song", "measure"], "left").join(given, ["song", "measure"], "left")
    last = F.when(F.col("_given").isNotNull() & (F.col("_at").isNull() | (F.col("_in") > F.col("_at"))), F.col("_given")).otherwise(F.col("_last"))
    w = Window.partitionBy("song").orderBy("measure")
    near = near.select("song", "measure", F.coalesce(
        F.last(last, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("_first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(MIDDLE_C)
    ).alias("_near"))
    each = F.col("ql") / F.col("taken")
    new = used.join(near, ["song", "measure"]).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("taken").cast("int") - 1))).withColumns({
        "kind": F.lit("note"), "start": F.col("start") + F.col("sub") * each, "ql": each, "pitches": F.array(F.coalesce("inject_pitch", "_near").cast("int")),
    })
    kept = song.notes.join(used.select("song", "seq"), ["song", "seq"], "left_anti")
    return kept.unionByName(new.select(*song.notes.columns)), used


def apply_truth(song: Song, truth: DataFrame, merges: DataFrame, keep: Callable[[DataFrame], DataFrame] = written) -> tuple[Song, DataFrame]:
    """(songs after their truth, counts by song).

    First measures are merged by merges (song, grp, measure). Then truth (song, measure, chords, lyrics_v1, inject_pitch; one row a measure; null says
    nothing, an empty list clears) gives measures their chords, evenly spread, and their first verse, a syllable a note; where notes are too few, rests
    become notes of the pitch given or of the nearest note. Notes that several results read go through keep, which writes them once. Marks that are a question mark go, in songs that have a truth. Songs without stay as they are.
    """
    known = truth.select("song").union(merges.select("song")).distinct()
    groups = merges.groupBy("song", "grp").agg(F.count("*").alias("_n")).where("_n >= 2")
    song = merge(song, merges)
    song = replace(song, notes=keep(song.notes))
    t = truth.join(song.measures.select("song", "measure", F.col("ql").alias("_ql")), ["song", "measure"])
    listed = t.where("chords is not null")
    replaced = song.chords.join(listed.select("song", "measure"), ["song", "measure"], "left_semi")
    spread = repair.spread(listed, "chords", F.when(F.col("_ql") == 0, 4.0).otherwise(F.coalesce("_ql", F.lit(4.0))), "figure")
    chords = song.chords.join(listed.select("song", "measure"), ["song", "measure"], "left_anti").unionByName(spread.select(*song.chords.columns))

    sung = t.where("lyrics_v1 is not null")
    notes, used = _injected(song, sung.select("song", "measure", F.size("lyrics_v1").alias("n_words"), "inject_pitch"))
    notes, used = keep(notes), keep(used)
    order = Window.partitionBy("song", "measure").orderBy("start", "seq", "sub")
    placed = notes.where("kind = 'note'").join(sung.select("song", "measure", "lyrics_v1"), ["song", "measure"]).withColumn("_i", F.row_number().over(order) - 1)
    words = placed.select("song", "seq", "sub", F.lit(1).alias("verse"), F.get("lyrics_v1", F.col("_i")).alias("text")).where("text is not null")
    stale = placed.select("song", "seq", "sub", F.lit(1).alias("_v"))
    old = song.lyrics.withColumn("_v", F.coalesce(F.when(F.col("verse") != 0, F.col("verse")), F.lit(1)))
    lyrics = old.join(stale, ["song", "seq", "sub", "_v"], "left_anti").select("song", "seq", "sub", "verse", "text").unionByName(words)

    phantom = song.marks.where(overlay.is_phantom(F.col("text"))).join(known, "song", "left_semi")
    marks = song.marks.join(known.withColumn("_known", F.lit(True)), "song", "left").where(~(F.coalesce("_known", F.lit(False)) & overlay.is_phantom(F.col("text")))).drop("_known")
    counts = {
        "measures_merged": _counted(groups, "measures_merged"), "measures_corrected": _counted(listed, "measures_corrected"), "chords_replaced": _counted(replaced, "chords_replaced"),
        "chords_inserted": _counted(spread, "chords_inserted"), "lyrics_overridden": _counted(sung, "lyrics_overridden"), "notes_injected": _counted(used, "notes_injected", F.col("taken")),
        "phantom_markers_stripped": _counted(phantom, "phantom_markers_stripped"),
    }
    every = known.select("song", F.lit("").alias("name"), F.lit(0).cast("long").alias("n"))
    for c in counts.values():
        every = every.unionByName(c)
    stats = every.groupBy("song").agg(*[F.sum(F.when(F.col("name") == name, F.col("n")).otherwise(0)).alias(name) for name in counts])
    return Song(song.measures, chords, notes, lyrics, marks), stats


def merge_places(measures: DataFrame) -> DataFrame:
    """measures (song, measure, ql, grp; one row a measure, grp null in none) with target, the measure that takes its notes, and shift, how much later they start there."""
    group = Window.partitionBy("song", "grp")
    inside = F.col("grp").isNotNull() & (F.count("*").over(group) >= 2)
    before = F.coalesce(F.sum("ql").over(group.orderBy("measure").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return measures.withColumns({"target": F.when(inside, F.min("measure").over(group)).otherwise(F.col("measure")), "shift": F.when(inside, before).otherwise(0.0)})


def overlay_notes(rows: DataFrame) -> DataFrame:
    """apply_truth's notes with the first verse alone, over one table of what is known of songs: notes (song, measure, seq, sub, kind, start, ql, pitch, text).

    rows of what measure bring song, measure, target, shift (of merge_places), lyrics_v1 and inject_pitch; rows of what note the notes, of one pitch each, with their
    first verse as it is. Every question is a window within a song: rows that lie together by song move no more, and nothing is written.
    """
    note, every = F.col("what") == "note", (Window.unboundedPreceding, Window.unboundedFollowing)
    own = Window.partitionBy("song", "measure")
    rows = rows.withColumns({"_to": F.coalesce(F.max("target").over(own), F.col("measure")), "start": F.col("start") + F.coalesce(F.max("shift").over(own), F.lit(0.0))})
    order = Window.partitionBy("song", "_to").orderBy("start", "seq", "sub")
    whole, sound = order.rowsBetween(*every), note & (F.col("kind") == "note")
    kept = (F.col("what") == "measure") & (F.col("measure") == F.col("_to"))
    at, asked = F.when(sound, F.struct("start", "seq", "sub")), kept & F.col("lyrics_v1").isNotNull()
    rows = rows.withColumns({
        "_short": F.max(F.when(asked, F.size("lyrics_v1"))).over(whole) - F.count_if(sound).over(whole), "_pitch": F.max(F.when(asked, F.col("inject_pitch"))).over(whole),
        "_at": F.max(F.when(sound, F.col("start"))).over(whole), "_last": F.max_by("pitch", at).over(whole), "_first": F.min_by("pitch", at).over(whole),
    })
    rest = note & (F.col("kind") == "rest") & (F.col("_short") > 0)
    rows = repair.take_capacity(rows, ["song", "_to"], ["start", "seq", "sub"], F.when(rest, repair.rest_capacity(F.col("ql"))), F.col("_short"))
    rows = rows.withColumn("taken", F.when(rest & (F.col("taken") > 0), F.col("taken")))
    # what a later measure finds before it: a given pitch where its note is the measure's last, else the measure's own last note
    rows = rows.withColumns({"_in": F.max(F.col("start") + (F.col("taken") - 1) * F.col("ql") / F.col("taken")).over(whole), "_given": F.max(F.when(F.col("taken").isNotNull(), F.col("_pitch"))).over(whole)})
    last = F.when(F.col("_given").isNotNull() & (F.col("_at").isNull() | (F.col("_in") > F.col("_at"))), F.col("_given")).otherwise(F.col("_last"))
    line = Window.partitionBy("song").orderBy("_to")
    # where no measure so far has a note, the next one is the song's first
    rows = rows.withColumn("_near", F.coalesce(
        F.last(F.when(kept, last), ignorenulls=True).over(line.rangeBetween(Window.unboundedPreceding, 0)), F.first(F.when(kept, F.col("_first")), ignorenulls=True).over(line.rangeBetween(*every)), F.lit(MIDDLE_C)
    ))
    made, each = F.col("taken").isNotNull(), F.col("ql") / F.col("taken")
    rows = rows.where(note | asked).select(
        "song", "_to", "what", "seq", "text", "start", "ql", "taken", F.when(made, "note").otherwise(F.col("kind")).alias("kind"), F.when(made, F.coalesce("_pitch", "_near")).otherwise(F.col("pitch")).cast("int").alias("pitch"),
        F.when(asked, F.col("lyrics_v1")).alias("_words"), F.explode(F.when(made, F.sequence(F.lit(0), F.col("taken").cast("int") - 1)).otherwise(F.array(F.col("sub").cast("int")))).alias("sub"),
    ).withColumns({"start": F.when(made, F.col("start") + F.col("sub") * each).otherwise(F.col("start")), "ql": F.when(made, each).otherwise(F.col("ql"))})
    words, rank = F.first("_words", ignorenulls=True).over(whole), F.count_if(sound).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_list": words, "_rank": rank}).where(note)
    text = F.when(sound & F.col("_list").isNotNull(), F.get("_list", F.col("_rank").cast("int") - 1)).otherwise(F.col("text"))
    return rows.select("song", F.col("_to").alias("measure"), "seq", "sub", "kind", "start", "ql", "pitch", text.alias("text"))


def flatten_roots(chords: DataFrame, songs: DataFrame, keys: DataFrame, root: str = "root") -> tuple[DataFrame, DataFrame]:
    """(chords with roots that the song's true key flattens spelled flat, stats by song).

    songs (song, score_fifths) are all songs; keys (song, key_fifths, expected_flat_letters, chromatic_root_notes) the true ones, a row a song. A root with an accidental
    stays, as do letters that the song uses chromatically, and all chords of songs whose key isn't known or differs.
    """
    k = keys.select("song", "key_fifths", "expected_flat_letters", overlay.chromatic_letters(F.coalesce("chromatic_root_notes", F.array().cast("array<string>"))).alias("_chromatic"), F.lit(True).alias("_there"))
    guard = overlay.flatten_guard(F.coalesce("_there", F.lit(False)), F.col("score_fifths"), F.col("key_fifths"))
    judged = songs.join(k, "song", "left").withColumn("_reason", guard)
    letter = F.substring(root, 1, 1)
    accidental = F.when(F.length(root) > 1, F.substring(root, 2, 1))
    action = F.when(F.col("_open"), overlay.flatten_action(letter, accidental, F.coalesce("expected_flat_letters", F.array().cast("array<string>")), F.col("_chromatic")))
    open_songs = judged.where("_reason is null").select("song", "expected_flat_letters", "_chromatic", F.lit(True).alias("_open"))
    marked = chords.join(open_songs, "song", "left").withColumn("action", action)
    out = marked.withColumn(root, F.when(F.col("action") == "flattened", F.concat(letter, F.lit("b"))).otherwise(F.col(root)))
    counts = marked.where("_open").groupBy("song").agg(F.count("*").alias("chords_examined"), F.count_if(F.col("action") == "flattened").alias("chords_flattened"), F.count_if(F.col("action") == "chromatic_skipped").alias("chromatic_skipped"))
    stats = judged.join(counts, "song", "left").select(
        "song", F.coalesce("_there", F.lit(False)).alias("gt_present"), F.col("key_fifths").alias("gt_key_fifths"), F.when(F.col("_there"), F.col("score_fifths")).alias("score_key_fifths"), F.col("_reason").isNull().alias("key_match"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("chords_examined", "chords_flattened", "chromatic_skipped")], F.coalesce("_reason", F.lit("")).alias("reason_skipped"),
    )
    return out.select(*chords.columns, "action"), stats


def sound_in_key(notes: DataFrame, measures: DataFrame, by: list[str]) -> DataFrame:
    """notes (by, measure, kind, step, alter, pitches) with alter and pitches under the key signature last seen, and fixed where that changed them.

    measures (by, measure, fifths: array) may change key in any measure; a measure's last signature counts for all of it. Chords, rests and notes with an
    alteration stay, as do notes before the first signature.
    """
    active = windows.carry_forward(measures.withColumn("_own", F.element_at(F.when(F.size("fifths") > 0, F.col("fifths")), -1)), by, ["measure"], F.col("_own"), "_fifths")
    keyed = notes.join(active.select(*by, "measure", "_fifths"), [*by, "measure"], "left")
    plain = F.coalesce("alter", F.lit(0)) == 0
    want = repair.implied_alter(F.col("step"), F.lit(0), ~plain, F.col("_fifths"))
    keyed = keyed.withColumn("_want", F.when((F.col("kind") == "note") & plain & ~F.coalesce(F.col("has_accidental"), F.lit(False)), want)).withColumn("fixed", F.coalesce(F.col("_want") != 0, F.lit(False)))
    return keyed.withColumns({
        "alter": F.when(F.col("fixed"), F.col("_want")).otherwise(F.col("alter")), "pitches": F.when(F.col("fixed"), F.transform("pitches", lambda p: p + F.col("_want"))).otherwise(F.col("pitches")),
    }).select(*notes.columns, "fixed")


def fill_empty(rows: DataFrame, primary: DataFrame, secondary: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(notes of the primary after filling, marks (by, measure, text)).

    rows (by, action, measure, other) are aligned measures with the decision of align.fill_decision. A filled measure loses its rests, takes the single notes of the
    secondary's measure other an octave lower, and is marked with a question mark. notes have (by, measure, kind, pitches, start).
    """
    filled = rows.where("action = 'filled'").select(*by, "measure", "other").distinct()
    bare = primary.join(filled.select(*by, "measure", F.lit(True).alias("_f")), [*by, "measure"], "left").where(F.col("_f").isNull() | (F.col("kind") != "rest")).drop("_f").withColumn("filled", F.lit(False))
    taken = secondary.where("kind = 'note'").withColumnRenamed("measure", "other").join(filled, [*by, "other"]).withColumns({"pitches": F.transform("pitches", lambda p: p - 12), "filled": F.lit(True)})
    return bare.unionByName(taken.select(*bare.columns)), filled.select(*by, "measure", F.lit("?").alias("text"))
