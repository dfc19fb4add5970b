"""Golden vectors and brute force for operators that SQL doesn't state."""

import random

import pytest
from pyspark.sql import functions as F

from scoreframe.functions import chords, lyrics, text
from scoreframe.operators import align, coverage, flags, labels, overlay, repair, windows
from scoreframe.operators.lyric_repair import Note, Words, repair_lyrics, repair_song


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_chord_keys(spark):
    assert column(spark, ["G 7", " Bbm7 ", "Bbm7", "Cm7(b5)"], chords.normal_key) == ["g7", "bbm7", "b-m7", "cm7b5"]
    assert column(spark, ["F♯m7", "B♭", "C°7", "Cø", "F△7", "C–"], chords.to_ascii) == ["F#m7", "Bb", "Co7", "C0", "Ft7", "C-"]
    assert column(spark, ["Bb6", "Cm7(b5)", "Emm7", "G9+"], chords.figure) == ["B-6", "Cm7b5", "Em7", "G+9"]


@pytest.mark.parametrize("style,labels_", [("symbolic", "C G7 A- D-7 Ft F# C#-7 A+ F#o7 G0"), ("textual", "C G7 Am Dm7 Fmaj7 F# C#m7 Aaug F#dim7 Gm7b5")])
def test_chord_round_trip(spark, style, labels_):
    p = lambda v: chords.parse(v)
    assert column(spark, labels_.split(), lambda v: chords.spell(p(v)["root"], p(v)["quality"], p(v)["extension"], p(v)["alteration"], style)) == labels_.split()


def test_chord_canonical(spark):
    given, want = "Bb Ebdim Gsus4 Gø F△7 C♯m7 CM7 G97 Cb x".split(), ["A#", "D#o", "Gsus", "G0", "Ft", "C#-7", "Ct", "G97", None, None]
    p = lambda v: chords.parse(v)
    assert column(spark, given, lambda v: chords.spell(p(v)["root"], p(v)["quality"], p(v)["extension"], p(v)["alteration"])) == want


def test_chord_tokens(spark):
    good, bad = "C Cm7b5 F# C/G Dm7/F F#9/7 F Fm7 D7".split(), ["2-c;", "tr", "mf", "Fine", "D.C.", "Hello", "8va", "2.", "", None]
    assert column(spark, good + bad, chords.is_chord_token) == [True] * len(good) + [False] * len(bad)
    assert column(spark, ["a", "g7", "dm7", "hello", "bm7"], chords.fix_root_case) == ["a", "G7", "Dm7", "hello", "Bm7"]
    assert column(spark, ["a"], lambda v: chords.fix_root_case(v, True)) == ["A"]
    assert column(spark, ["-1", "3", "-7", "0"], lambda v: chords.expected_flats(v.cast("int"))) == [["B"], [], list("BEADGCF"), []]


def test_words(spark):
    assert column(spark, ["pret-ty pass,Our ro-mance", "done.But", "sa's'", "I’ll", ""], lyrics.tokens) == [["pret", "ty", "pass", "Our", "ro", "mance"], ["done", "But"], ["sas'"], ["I'll"], []]
    assert column(spark, ["Copyright 1935", "‘Lyrics by x", "SUMMER'S HERE", "So if you", "  ", None, "by Chappell & Co"], lyrics.is_lyric_line) == [False, False, False, True, False, False, False]
    assert column(spark, ["Gm", "Eb", "mp", "a tempo", "love", "rit.", "", None, "all"], lyrics.is_lyric_token) == [False, False, False, False, True, False, False, False, True]
    assert column(spark, ["Dont", "im,", "xyz"], lyrics.fix_contraction) == ["Don't", "I'm,", "xyz"]
    assert lyrics.segment("dontknowwhere", frozenset(["dont", "know", "where", "do"])) == ["dont", "know", "where"] and lyrics.segment("short", frozenset()) is None


def test_verse_pairs(spark):
    lines = ["So if you like pa-ja-mas", "So if you like oyst-ers", "Let us call it off", "So if", "So if you go on with it to the very end of it"]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(lines)], "d int, i int, line string")
    assert [r["verse"] for r in lyrics.pair_verses(df, ["d"], "i", "line").orderBy("i").collect()] == [1, 2, 0, 0, 0]
    rng = random.Random(1)
    rows = [(d, i, " ".join(rng.choice(["aa bb cc dd", "aa bb cc", "xx yy zz"]).split())) for d in range(30) for i in range(9)]
    got = {(r["d"], r["i"]): r["verse"] for r in lyrics.pair_verses(spark.createDataFrame(rows, "d int, i int, line string"), ["d"], "i", "line").collect()}
    for d in range(30):
        mine, i = [r[2] for r in rows if r[0] == d], 0
        while i < 9:
            pair = i < 8 and mine[i][:2] == mine[i + 1][:2]
            assert [got[d, k] for k in range(i, i + 1 + pair)] == ([1, 2] if pair else [0])
            i += 1 + pair


DICTIONARY = "we call the whole alpha beta gamma delta start end some thing must be done don't know where".split()


def song(texts, truth, rests=()):
    """Without rests the notes have no measure, and two notes on either side may take syllables."""
    notes = [Note(1 if rests else None, "note", 52, 1.0, {1: t} if t else {}) for i, t in enumerate(texts)] + [Note(m, "rest") for m in rests]
    return repair_song(notes, {1: truth}, Words(DICTIONARY))


def test_pickup_and_brackets():
    s = song([None, "we", "call", "the", "whole"], ["If", "we", "call", "the", "whole"])
    assert s.notes[0].text == {1: "If"} and s.actions["inserted"] == 1
    s = song(["start", None, None, None, None, "end"], ["start", "alpha", "beta", "gamma", "end"])
    assert [n.text.get(1) for n in s.notes] == ["start", "alpha", "beta", "gamma", None, "end"]
    assert song(["start", *[None] * 6, "end"], ["start", "alpha", "beta", "gamma", "delta", "end"]).actions["inserted"] == 0
    assert song(["start", *[None] * 4, "end"], ["start", "alpha", "beta", "gamma", "delta", "end"]).actions["inserted"] == 4


def test_spill_and_phantoms():
    s = song(["dontknowwh", None, None, None], ["dontknowwhere"])
    assert [n.text.get(1) for n in s.notes] == ["don't", "know", "where", None] or s.notes[0].text[1] == "dont"
    s = song(["Some", "thing", "must", "be"], ["Some", "thing", "must", "be", "done"], rests=[2])
    assert s.notes[-1].kind == "note" and s.notes[-1].text == {1: "done"} and s.notes[-1].pitch == 50
    for truth in (["Some", "thing", "must", "be", "xqz"], ["Some", "thing", "must", "be", "xqz", "done"]):
        assert song(["Some", "thing", "must", "be"], truth, rests=[2]).actions["phantoms"] == 0
    assert song(["Some", "thing", "must", "be"], ["Some", "thing", "must", "be", "done"]).actions["phantoms"] == 0
    lone = repair_song([Note(1, "note", 50, 1.0, {2: "the"}), Note(1, "note", 50, 1.0, {2: "end"}), Note(2, "note", 50, 1.0, {1: "we", 2: "be"})], {1: ["the", "end", "we"], 2: ["be"]}, Words(DICTIONARY))
    assert lone.actions["swapped"] == 2 and lone.notes[2].text == {1: "we", 2: "be"}


def test_repair_lyrics_frame(spark):
    notes = spark.createDataFrame([("s", i, None, "note", 52, 1.0) for i in range(5)] + [("t", 0, 1, "rest", None, 1.0)], "song string, seq int, measure int, kind string, pitch int, ql double")
    words = spark.createDataFrame([("s", i + 1, None, t) for i, t in enumerate(["we", "call", "the", "whole"])] + [("s", 0, 1, "mp")], "song string, seq int, verse int, text string")
    truth = spark.createDataFrame([("s", 1, i, t) for i, t in enumerate(["If", "we", "call", "the", "whole"])], "song string, verse int, pos int, token string")
    got = repair_lyrics(notes, words, truth, DICTIONARY).orderBy("song", "seq").collect()
    assert [r["text"] for r in got] == ["If", "we", "call", "the", "whole", None] and got[-1]["kind"] == "rest"


def test_redistribute(spark):
    h = spark.createDataFrame([(1, 0, "bm", 0.0, 4.0), (1, 1, "d6", 0.0, 4.0), (2, 0, "c", 0.0, 4.0), (3, 0, "x", 1.0, 4.0), (3, 1, "y", 1.0, 4.0)], "m int, n int, k string, o double, ql double")
    g = spark.createDataFrame([(1, "bm", 0.0), (1, "d6", 0.5), (2, "c", 0.5), (3, "z", 0.5)], "m int, k string, f double")
    got = {(r["m"], r["k"]): (r["o"], r["moved"]) for r in coverage.redistribute(h, g, ["m"], ["n"], "k", "o", "ql", "f").collect()}
    assert got == {(1, "bm"): (0.0, False), (1, "d6"): (2.0, True), (2, "c"): (0.0, False), (3, "x"): (1.0, False), (3, "y"): (1.0, False)}


def test_insert_specific(spark):
    schema = "m int, n int, k string, o double"
    present = spark.createDataFrame([(1, 0, "c", 0.0), (1, 0, "g7", 2.0)], schema)
    more = spark.createDataFrame([(1, 1, "cmaj7", 0.0), (1, 2, "g", 2.25), (1, 3, "g7", 3.0), (1, 4, "a", 1.0)], schema)
    got = sorted((r["k"], r["o"], r["inserted"]) for r in coverage.insert_specific(present, more, ["m"], ["n"], "k", "o").collect())
    assert got == [("a", 1.0, True), ("cmaj7", 0.0, True), ("g7", 2.0, False)]


def test_small_functions(spark):
    step, octave = text.position_pitch(F.col("p"))
    rows = spark.createDataFrame([(0,), (1,), (-6,), (-40,)], "p int").select(step.alias("s"), octave.alias("o")).collect()
    assert [(r["s"], r["o"]) for r in rows] == [("B", 4), ("C", 5), ("C", 4), ("D", -1)]
    keyed = spark.createDataFrame([("F", 0, False, 1), ("F", 0, True, 1), ("B", 0, False, -1), ("C", 0, False, None)], "s string, a int, e boolean, f int")
    assert [r["x"] for r in keyed.select(repair.implied_alter(F.col("s"), F.col("a"), F.col("e"), F.col("f")).alias("x")).collect()] == [1, 0, -1, 0]
    xml = '<note><tuplet type="start"/><time-modification>3</time-modification></note>'
    assert column(spark, [xml, xml + '<tuplet type="stop"/>'], repair.strip_tuplets) == ["<note></note>", xml + '<tuplet type="stop"/>']


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_partitions_change_nothing(spark, parts):
    df = spark.range(2000).selectExpr("id", "id % 7 as g", "(id * 37) % 101 as v").repartition(parts)
    mode = sorted(windows.first_seen_mode(df, ["g"], "v", ["id"]).collect())
    assert mode == sorted(windows.first_seen_mode(df.coalesce(1), ["g"], "v", ["id"]).collect())
    kept = coverage.proximity_dedup(df.select("g", F.col("v").cast("double").alias("x"), F.repeat(F.lit("t"), (F.col("id") % 3 + 1).cast("int")).alias("t")), ["g"], "x", "t", 2.0)
    assert kept.count() == coverage.proximity_dedup(df.coalesce(1).select("g", F.col("v").cast("double").alias("x"), F.repeat(F.lit("t"), (F.col("id") % 3 + 1).cast("int")).alias("t")), ["g"], "x", "t", 2.0).count()


def test_labels_and_overlay(spark):
    rows = spark.createDataFrame([("a", "C", "0.9"), ("b", None, "bad"), ("c", "", "0.86"), ("d", None, None)], "f string, label string, conf string")
    assert [r["x"] for r in rows.select(labels.accept(F.col("label"), F.lit("G7"), F.col("conf"), 0.85).alias("x")).collect()] == ["C", None, "G7", None]
    have, missing = labels.import_labels(rows, spark.createDataFrame([("b",)], "f string"), "label", "f")
    assert have.count() == 0 and [r["f"] for r in missing.collect()] == ["a"]
    margin = spark.createDataFrame([("s", "A", 100.0, False), ("s", "A", 300.0, False), ("t", "A", 100.0, True)], "song string, v string, x double, ok boolean")
    assert labels.drop_margin_letters(margin, "song", "v", "x", F.col("ok")).count() == 2
    current = spark.createDataFrame([(1, ["x"]), (2, ["y"])], "m int, chords array<string>")
    truth = spark.createDataFrame([(1, []), (3, ["z"])], "m int, chords array<string>")
    assert sorted((r["m"], r["chords"], r["corrected"]) for r in overlay.overlay(current, truth, ["m"], ["chords"]).collect()) == [(1, [], True), (2, ["y"], False)]
    assert flags.flag_table(spark.createDataFrame([("s", "r1"), ("s", "r2"), ("t", "r1")], "song string, reason string"), "song", "reason", ["r1", "r2"]).where("song = 'TOTAL' and total = 3").count() == 1
