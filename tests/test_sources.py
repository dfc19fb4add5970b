"""Files in, files out, and what is built on them."""

import hashlib
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from scoreframe.operators import coverage, heads, locate
from scoreframe.plans import recovery, reducer
from scoreframe.sources import archives, class_files, score_files, sinks
from scoreframe.streaming import extensions

SHEET = """<sheet><staff id="1"><line><point y="100"/><point y="102"/></line><line><point y="140"/></line></staff>
<staff-barline id="b1" staff="1"><bounds x="300" y="1" w="2" h="40"/></staff-barline><staff-barline id="b2" staff="1"><bounds x="600" y="1" w="2" h="40"/></staff-barline>
<measure id="1"><right-barline><staff-barlines>b1 nope</staff-barlines></right-barline><head-chords>hc1</head-chords></measure>
<measure id="2C"><right-barline><staff-barlines>b2</staff-barlines></right-barline></measure>
<chord-name value="Bb7" staff="1"><bounds x="150" y="60" w="9" h="9"/></chord-name><chord-name staff="1"><bounds x="450" y="60" w="9" h="9"/></chord-name><chord-name value="X"/>
<head id="h1" staff="1" pitch="-1" shape="NOTEHEAD_BLACK"><bounds x="310" y="1" w="1" h="1"/></head><head id="h2" staff="1" pitch="0" shape="NOTEHEAD_VOID"><bounds x="450" y="1" w="1" h="1"/></head>
<head-chord id="hc1"/><head-chord id="hc2"/><relation source="hc1" target="h1"><containment/></relation><relation source="h2" target="hc2"><containment/></relation>
<word staff="1"/></sheet>"""

SCORE = """<?xml version="1.0"?><!DOCTYPE score-partwise><score-partwise>
<part id="P1"><measure number="1"><attributes><divisions>2</divisions><key><fifths>-1</fifths></key></attributes><note><rest/><duration>8</duration></note></measure>
<measure number="2"><harmony><root><root-step>B</root-step><root-alter>-1</root-alter></root><kind text="7">dominant-seventh</kind></harmony>
<note><pitch><step>C</step><octave>5</octave></pitch><duration>2</duration><lyric number="1"><text>Oh</text></lyric></note>
<note><pitch><step>C</step><octave>6</octave></pitch><duration>2</duration></note><note><chord/><pitch><step>E</step><octave>6</octave></pitch><duration>2</duration></note>
<note><pitch><step>C</step><octave>3</octave></pitch><duration>4</duration></note></measure></part>
<part id="P2"><measure number="2"><harmony><root><root-step>F</root-step></root><kind>major</kind><offset>2</offset></harmony><note><rest/><duration>8</duration></note></measure></part></score-partwise>"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("scores")
    with zipfile.ZipFile(at / "one.omr", "w") as z:
        for n in (1, 2, 10):
            z.writestr(f"sheet#{n}/sheet#{n}.xml", SHEET)
    (at / "broken.omr").write_bytes(b"PK not a zip")
    with zipfile.ZipFile(at / "one.mxl", "w") as z:
        z.writestr("META-INF/container.xml", "<c/>")
        z.writestr("one.xml", SCORE)
    (at / "bad.py").write_text("import subprocess\nsubprocess.run(['x'])\nsubprocess.run(['x'], timeout=3)\n")
    (at / "strip.tsv").write_text("a\tb\n" + "\t".join(["5", "1", "1", "1", "1", "1", "40", "0", "12", "9", "91.5", "Cm7"]) + "\n" + "\t".join(["x"] * 12) + "\n")
    (at / "01_one.json").write_text(json.dumps({"song": "One", "merge_measures": [[2, 3]], "measures": {"4": {"chords": [], "lyrics_v1": ["a"]}, "5": {"lyrics_v1": ["b"]}, "x": {}}}))
    (at / "bad.json").write_text("{")
    (at / "one.md").write_text("| measure | reason | detail |\n|---|---|---|\n| 7 | missing_lyrics | none |\n")
    return at


def test_sheets_by_range(spark, folder, tmp_path):
    """A partition a sheet; what can't be read gives a row of its own, and the rest of its archive is read."""
    for f in ("one.omr", "broken.omr"):
        (tmp_path / f).write_bytes((folder / f).read_bytes())
    (tmp_path / "sub").mkdir()
    with zipfile.ZipFile(tmp_path / "sub" / "two.omr", "w", zipfile.ZIP_DEFLATED) as z:
        for n, xml in ((3, SHEET), (1, SHEET), (2, "<sheet"), (4, SHEET)):
            z.writestr(f"sheet#{n}/sheet#{n}.xml", xml, zipfile.ZIP_STORED if n == 4 else None)
    raw = bytearray((tmp_path / "sub" / "two.omr").read_bytes())
    raw[raw.rindex(SHEET.encode()[:30]) + 20] ^= 1
    (tmp_path / "sub" / "two.omr").write_bytes(raw)
    (tmp_path / "cut.omr").write_bytes(raw[:200])
    with zipfile.ZipFile(tmp_path / "none.omr", "w") as z:
        z.writestr("x.txt", "")
    s = archives.sheets(spark, str(tmp_path))
    got = sorted((r["song"], r["sheet"] or 0, r["status"].split(":")[0], r["xml"] is not None) for r in s.collect())
    assert got == [
        ("broken", 0, "no ZIP directory", False), ("cut", 0, "no ZIP directory", False), ("none", 0, "no sheets", False), ("one", 1, "ok", True), ("one", 2, "ok", True), ("one", 10, "ok", True),
        ("two", 1, "ok", True), ("two", 2, "ParseError", False), ("two", 3, "ok", True), ("two", 4, "ValueError", False),
    ]
    assert s.rdd.getNumPartitions() == 10
    assert {r["song"]: (r["n_sheets"], r["n_failed"], r["status"]) for r in archives.outcomes(s).collect()} == {"broken": (0, 1, "failed"), "cut": (0, 1, "failed"), "none": (0, 1, "failed"), "one": (3, 0, "ok"), "two": (2, 2, "partial")}
    assert {r["song"]: r["error"] for r in archives.outcomes(s).collect()}["one"] is None
    whole = score_files.files(spark, str(folder), "one.omr")
    for read in (score_files.glyphs, score_files.barlines, score_files.sheet_sizes, score_files.heads):
        assert sorted(map(tuple, read(s.where("song = 'one'")).collect()), key=repr) == sorted(map(tuple, read(whole).collect()), key=repr)
    every = archives.SheetReader(str(tmp_path), "*.omr")
    want = sorted((r[0], r[1] or 0, r[4]) for p in every.partitions() for r in every.read(p))
    assert sorted((r[0], r[1] or 0, r[4]) for p in archives.archives(str(tmp_path), "*.omr") for r in every.read(archives.Member(p))) == want


def test_project(spark, folder):
    p = score_files.files(spark, str(folder), "*.omr")
    assert [r["song"] for r in score_files.unreadable(p).collect()] == ["broken"]
    assert {r["sheet"]: r["n_measures"] for r in score_files.sheet_sizes(p).collect()} == {1: 2, 2: 2, 10: 2}
    assert score_files.glyphs(p).count() == 6 and score_files.vocal_staves(p).count() == 3
    assert sorted((r["x"], r["measure_local"]) for r in score_files.barlines(p).where("sheet = 1").collect()) == [(300.0, 1), (600.0, 2)]
    assert score_files.staff_lines(p).first()["y_top"] == 101.0
    h = {r["id"]: r for r in score_files.heads(p).where("sheet = 1").collect()}
    assert h["h1"]["linked"] and h["h1"]["linked_measure"] == 1 and not h["h2"]["linked"] and h["h2"]["head_chord_id"] == "hc2"


def test_missing_chords_and_heads(spark, folder):
    p = score_files.files(spark, str(folder), "*.omr")
    exported = spark.createDataFrame([("one", 3, "B-7")], "song string, measure int, figure string")
    got = recovery.missing_chords(score_files.glyphs(p), score_files.barlines(p), score_files.sheet_sizes(p), exported)
    assert [(r["sheet"], r["measure_global"], r["value"]) for r in got.collect()] == [(1, 1, "Bb7"), (10, 5, "Bb7")]
    placed = heads.place_heads(score_files.heads(p), score_files.barlines(p).select("song", "sheet", "staff", "x", "measure_local"), score_files.sheet_sizes(p))
    measures = spark.createDataFrame([("one", n, 4.0) for n in range(1, 5)], "song string, number int, ql double")
    notes = spark.createDataFrame([("one", 2, 2.1, 59)], "song string, measure int, offset double, midi int")
    out = {(r["sheet"], r["id"]): r["action"] for r in heads.insert_heads(placed, score_files.vocal_staves(p), measures, notes).collect()}
    assert out[1, "h1"] == "skipped_linked" and out[1, "h2"] == "skipped_duplicate" and out[2, "h2"] == "inserted" and out[10, "h2"] == "skipped_no_measure"


def test_score_and_reducer(spark, folder):
    s = score_files.files(spark, str(folder), "*.mxl")
    t = {n: score_files.score_table(s, n) for n in ("note", "measure", "lyric", "harmony")}
    assert [(r["kind"], r["pitches"], r["offset"], r["ql"]) for r in t["note"].where("part = 0").orderBy("seq").collect()] == [("rest", [], 0.0, 4.0), ("note", [72], 0.0, 1.0), ("chord", [84, 88], 1.0, 1.0), ("note", [48], 2.0, 2.0)]
    sheet = reducer.reduce_scores(t["note"], t["measure"], t["lyric"], t["harmony"])
    assert [(r["number"], r["source_number"]) for r in sheet.measures.collect()] == [(1, 2)]
    assert [(r["kind"], r["pitches"]) for r in sheet.notes.orderBy("seq").collect()] == [("note", [60]), ("note", [88]), ("rest", [])]
    assert sorted((r["measure"], r["offset"], r["root"], r["kind_text"]) for r in sheet.harmonies.collect()) == [(1, 0.0, "Bb", "7"), (1, 2.0, "F", "")]
    assert [(r["measure"], r["letter"]) for r in sheet.sections.collect()] == [(1, "A")]


def test_small_sources(spark, folder):
    assert [(r["left"], r["width"], r["conf"], r["text"]) for r in score_files.ocr_tokens(spark, str(folder / "strip.tsv")).collect()] == [(40, 12, 91.5, "Cm7")]
    m, merges = score_files.song_truth(spark, str(folder / "*.json"))
    assert sorted((r["measure"], r["chords"], r["lyrics_v1"]) for r in m.collect()) == [(4, [], ["a"]), (5, None, ["b"])] and sorted(r["measure"] for r in merges.collect()) == [2, 3]
    songs = spark.createDataFrame([("01 One",), ("02 One",), ("Two",)], "song string")
    assert {r["song"] for r in score_files.by_slug(songs, m).select("song").distinct().collect()} == {"01 One", "02 One"}
    assert [(r["song"], r["measure"], r["reason"]) for r in score_files.review_rows(spark, str(folder / "one.md")).collect()] == [("one", 7, "missing_lyrics")]
    assert [(r["line"], r["call"]) for r in sinks.lint(spark, str(folder)).collect()] == [(2, "subprocess.run")]
    names = spark.createDataFrame([("a_sheet3_art_10_20.png",), ("other.png",)], "f string").select(score_files.crop_position(F.col("f")).alias("p"))
    assert [r["p"] and (r["p"]["sheet"], r["p"]["x"]) for r in names.collect()] == [(3, 10), None]


def test_sinks(spark, tmp_path):
    flags = spark.createDataFrame([("s", 2, "r", None), ("s", 1, "r", "d")], "song string, measure int, reason string, detail string")
    assert sinks.flags_markdown(flags).first()["value"].splitlines()[2] == "| 1 | r | d |"
    asked = io.StringIO()

    def model(images):
        return [(f"C{len(i)}", 0.5) for i in images]

    images = spark.createDataFrame([("a", bytearray(b"xx")), ("b", bytearray(b"xx")), ("c", bytearray(b"y"))], "f string, content binary")
    assert {r["f"]: r["chord"] for r in sinks.recognise(images, model, "content").collect()} == {"a": "C2", "b": "C2", "c": "C1"} and asked.getvalue() == ""
    answers = spark.createDataFrame([("'Cm7(b5)'.",), ("SKIP",), ("Hello",)], "t string").select(sinks.clean_answer(F.col("t")).alias("x"))
    assert [r["x"] for r in answers.collect()] == ["Cm7(b5)", "", ""]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    waits = []
    assert sinks.retried(flaky, sleep=waits.append) == 7 and waits == [1.0, 2.0]
    starter = sinks.truth_starter(spark.createDataFrame([("s", 1, ["C"], ["a"])], "song string, measure int, chords array<string>, lyrics_v1 array<string>"))
    assert json.loads(starter.first()["value"])["measures"]["1"]["chords"] == ["C"]
    sinks.write_new(starter, str(tmp_path / "new"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_new(starter, str(tmp_path / "new"))
    page = sinks.review_page(spark.createDataFrame([("s", 1, bytearray(b"png"), "<b>")], "song string, m int, i binary, t string"), "song", "m", F.col("i"), F.col("t"))
    assert "&lt;b>" in page.first()["value"] and "base64,cG5n" in page.first()["value"]


def test_locate_without_bars(spark):
    points = spark.createDataFrame([("s", 5.0), ("s", None), ("t", 1.0)], "song string, x double")
    bars = spark.createDataFrame([("s", 0.0, 1), ("s", 4.0, 2)], "song string, bx double, n int")
    got = {(r["song"], r["x"]): (r["measure"], r["frac"]) for r in locate.locate(points, bars, ["song"], "x", "bx", "n").collect()}
    assert got == {("s", 5.0): (2, 0.99), ("s", None): (None, None), ("t", 1.0): (None, None)}


def test_streams(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(300).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = extensions.sessions(stream, ["user_id"], "ts", "1 hour", "1 day").writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("closed").where("n > 0").count() > 0


def test_command_line(spark, folder, tmp_path, monkeypatch):
    from scoreframe import cli

    cli.main(["process", str(folder), str(tmp_path / "out"), "--only", "*.mxl"])
    assert spark.read.parquet(str(tmp_path / "out/missing")).count() == 2 and spark.read.parquet(str(tmp_path / "out/notes")).count() == 3
    cli.main(["review", str(folder), str(tmp_path / "r"), "--only", "*.mxl"])
    assert spark.read.text(str(tmp_path / "r/summary")).count() >= 1


def test_figures():
    one = "<harmony><root><root-step>{0}</root-step></root><kind{1}>{2}</kind>{3}</harmony>"
    bass = "<bass><bass-step>B</bass-step><bass-alter>-1</bass-alter></bass>"
    degree = "<degree><degree-value>9</degree-value><degree-alter>-1</degree-alter><degree-type>add</degree-type></degree>"
    body = one.format("C", "", "minor-seventh", bass) + one.format("G", ' text="7"', "dominant", degree) + one.format("F", "", "major", "<bass><bass-step>F</bass-step></bass>")
    rows = score_files.parse_score(f'<s><part><measure number="1">{body}</measure></part></s>'.encode())["harmony"]
    assert [r[4] for r in rows] == ["Cm7/Bb", "G7 add b9", "F"]


def test_musicxml_round_trip(spark):
    """What is written is read back: places, lengths, gaps, overlaps, chords, words, keys and escapes; an empty measure stays."""
    measures = spark.createDataFrame([("s & t", 1, [-1]), ("s & t", 2, []), ("s & t", 3, None), ("u", 7, [0])], "song string, number int, fifths array<int>")
    notes = spark.createDataFrame(
        [("s & t", 1, 0, "rest", [], 0.0, 1.0), ("s & t", 1, 1, "note", [61], 1.0, 1 / 3), ("s & t", 1, 2, "chord", [60, 70], 3.0, 1.0), ("s & t", 2, 3, "note", [59], 0.0, 4.0), ("s & t", 2, 4, "note", [72], 1.0, 2.0), ("s & t", 9, 5, "note", [1], 0.0, 1.0)],
        "song string, measure int, seq int, kind string, pitches array<int>, offset double, ql double",
    )
    chords = spark.createDataFrame([("s & t", 1, 0, 0.5, "Bb", "dominant", "7"), ("s & t", 2, 0, 2.0, "F#", None, None)], "song string, measure int, seq int, offset double, root string, kind string, kind_text string")
    words = spark.createDataFrame([("s & t", 1, 1, "a<b"), ("s & t", 1, 2, "z"), ("s & t", 3, 1, None)], "song string, note_seq int, verse int, text string")
    xml = {r["song"]: r["value"] for r in sinks.musicxml(measures, notes, chords, words).collect()}
    back = score_files.parse_score(xml["s & t"].encode())
    assert [(r[1], r[4], r[5], round(r[10], 6), round(r[11], 6)) for r in back["note"]] == [
        (1, "rest", [], 0.0, 1.0), (1, "note", [61], 1.0, round(1 / 3, 6)), (1, "chord", [60, 70], 3.0, 1.0), (2, "note", [59], 0.0, 4.0), (2, "note", [72], 1.0, 2.0),
    ]
    assert [(r[1], r[3], r[5], r[6], r[7]) for r in back["harmony"]] == [(1, 0.5, "Bb", "dominant", "7"), (2, 2.0, "F#", "major", "")]
    assert [(r[2], r[4], r[5]) for r in back["lyric"]] == [(1, 1, "a<b"), (1, 2, "z")]
    assert [(r[2], r[5]) for r in back["measure"]] == [(1, [-1]), (2, []), (3, [])] and score_files.parse_score(xml["u"].encode())["note"] == []


def test_musicxml_keeps_chords_bars_and_spelling(spark):
    """Basses, degrees, time, bar lines and given names come back; pitches without a name are spelled in the key that holds."""
    measures = spark.createDataFrame([("s", 1, [-4], "3", "4", None), ("s", 2, [], None, None, "repeat"), ("s", 3, [3], "4", "4", "light-heavy")], "song string, number int, fifths array<int>, beats string, beat_type string, left_barline string")
    rows = [(1, 0, "note", [61], "C", 1, 4), (1, 1, "note", [61], None, None, None), (1, 2, "note", [61], "E", 0, 4), (2, 3, "note", [66], None, None, None), (2, 4, "chord", [63, 71], "E", -1, 4), (3, 5, "note", [66], None, None, None), (3, 6, "note", [59], "C", -1, 4)]
    notes = spark.createDataFrame([("s", m, s, k, p, st, a, o, float(s), 1.0) for m, s, k, p, st, a, o in rows], "song string, measure int, seq int, kind string, pitches array<int>, step string, alter int, octave int, offset double, ql double")
    chords = spark.createDataFrame(
        [("s", 1, 0, 0.0, "C", "dominant", "7", "Bb", ["add b9", "alter #5"]), ("s", 1, 1, 1.0, "Bb", "minor", "m", "Bb", []), ("s", 2, 0, 3.0, "F#", "major", "", None, None), ("s", 3, 0, 5.0, "Ab", "major-seventh", "t", "C", ["subtract 3", "add ##11", "odd"])],
        "song string, measure int, seq int, offset double, root string, kind string, kind_text string, bass string, degrees array<string>",
    )
    back = score_files.parse_score(sinks.musicxml(measures, notes, chords).first()["value"].encode())
    named = {n: i for i, n in enumerate(x.split()[0] for x in score_files.HARMONY.split(", ")[1:])}
    assert [(r[named["root"]], r[named["bass"]], r[named["degrees"]]) for r in back["harmony"]] == [("C", "Bb", ["add b9", "alter #5"]), ("Bb", None, []), ("F#", None, []), ("Ab", "C", ["subtract 3", "add ##11"])]
    assert [r[named["figure"]] for r in back["harmony"]] == ["C7/Bb add b9 alter #5", "Bbm", "F#", "Abt/C subtract 3 add ##11"]
    assert [r[6:9] for r in back["note"]] == [("C", 1, 4), ("D", -1, 4), ("D", -1, 4), ("G", -1, 4), ("E", -1, 4), ("F", 1, 4), ("C", -1, 4)] and [r[5] for r in back["note"]][-1] == [59]
    assert [(r[2], r[4], r[5], r[6], r[7]) for r in back["measure"]] == [(1, None, [-4], "3", "4"), (2, "repeat", [], None, None), (3, "light-heavy", [3], "4", "4")]


def test_transposition(spark):
    """Every note up and back, by every interval, is the note itself; sizes and names are right."""
    from scoreframe.functions import pitch

    n = spark.createDataFrame([(s, a, 4, k) for s in "CDEFGAB" for a in range(-2, 3) for k in range(-24, 25)] + [(None, 0, 4, 1), ("H", 0, 4, 1)], "s string, a int, o int, k int")
    n = n.withColumn("t", pitch.transposed(F.col("s"), F.col("a"), F.col("o"), F.col("k"))).withColumn("u", pitch.transposed(F.col("t.step"), F.col("t.alter"), F.col("t.octave"), -F.col("k")))
    n = n.withColumn("d", pitch.midi(F.col("t.step"), F.col("t.alter"), F.col("t.octave")) - pitch.midi(F.col("s"), F.col("a"), F.col("o")))
    rows = n.collect()
    assert all((tuple(r["u"]), r["d"]) == ((r["s"], r["a"], r["o"]), r["k"]) for r in rows if r["s"] not in (None, "H")) and all(r["t"] is None for r in rows if r["s"] in (None, "H"))
    got = {(r["s"], r["a"], r["k"]): tuple(r["t"]) for r in rows if r["t"]}
    assert (got["B", -1, -2], got["E", 0, 3], got["F", 0, -12], got["C", 0, -1], got["G", -1, 2]) == (("A", -1, 4), ("G", 0, 4), ("F", 0, 3), ("B", 0, 3), ("A", -1, 4))


def test_class_files(spark, tmp_path):
    """Files under fixed names; a repeated job changes nothing, one that fails leaves nothing."""
    at = str(tmp_path / "classes")
    rows = spark.createDataFrame([("C/G", "p", "sheet#1", float(i), 2.0, bytearray(b"img%d" % i)) for i in range(40)] + [("D7", "p", "sheet#1", 1.0, 1.0, None), (None, "p", "s", 1.0, 1.0, bytearray(b"x"))], "label string, project string, sheet string, x double, y double, content binary").repartition(5)
    named = rows.withColumn("name", class_files.crop_name(F.col("project"), F.col("sheet"), F.col("x"), F.col("y")))
    class_files.write_classes(named, at)
    found = {p.name: p.read_bytes() for p in (tmp_path / "classes" / "C_slash_G").iterdir()}
    assert sorted(found.values()) == sorted(b"img%d" % i for i in range(40)) and hashlib.sha1(b"p:sheet#1:7,2").hexdigest()[:12] + ".png" in found
    assert sorted(p.name for p in (tmp_path / "classes").iterdir()) == ["C_slash_G"]
    class_files.write_classes(named.withColumn("content", F.lit(b"other")), at)  # places that are taken keep what they have
    assert {p.name: p.read_bytes() for p in (tmp_path / "classes" / "C_slash_G").iterdir()} == found
    bad = rows.limit(3).select(F.lit("new").alias("label"), F.lit("a/b").alias("name"), "content")
    with pytest.raises(Exception, match="no file name"):
        class_files.write_classes(bad, at)
    assert sorted(p.name for p in (tmp_path / "classes").iterdir()) == ["C_slash_G", "D7"]


def test_inspection(spark, folder, tmp_path):
    parts, spanners = score_files.inspection(score_files.files(spark, str(folder), "*.mxl"))
    one, two = parts.orderBy("part").collect()
    assert (one["id"], one["measures"], one["notes"], one["sung"], one["chord_symbols"], one["voices"], one["fifths"], one["repeats"], one["first_chords"]) == ("P1", 2, 4, 1, 1, 0, -1, 0, ["Bb7"])
    assert (two["id"], two["notes"], two["time"], two["first_chords"]) == ("P2", 1, None, ["F"]) and spanners.count() == 0
    note = '<note><pitch><step>C</step><octave>4</octave></pitch><duration>1</duration><voice>{}</voice><notations><slur type="{}"/></notations></note>'
    (tmp_path / "x.musicxml").write_text(
        '<score-partwise><part-list><score-part id="A"><part-name>Voice</part-name><score-instrument id="i"><instrument-name>Alto</instrument-name></score-instrument></score-part></part-list><part id="A"><measure number="1"><attributes><time><beats>3</beats><beat-type>4</beat-type></time></attributes>'
        f'<direction><direction-type><rehearsal>A</rehearsal></direction-type></direction><direction><direction-type><words>slow</words><wedge type="crescendo"/></direction-type></direction>{note.format(1, "start")}{note.format(2, "stop")}<barline><repeat direction="backward"/></barline></measure></part></score-partwise>'
    )
    parts, spanners = score_files.inspection(score_files.files(spark, str(tmp_path), "*.musicxml"))
    r = parts.first()
    assert (r["name"], r["instrument"], r["voices"], r["time"], r["rehearsal_marks"], r["texts"], r["repeats"], r["notes"]) == ("Voice", "Alto", 2, "3/4", 1, 1, 1, 2)
    assert {s["kind"]: s["n"] for s in spanners.collect()} == {"slur": 1, "crescendo": 1}


def test_thinning_stream(spark, tmp_path):
    """Any order of arrival within the watermark gives the batch's rows."""
    rng = random.Random(9)
    start = 1_700_000_000
    rows = [(g, start + round(rng.random() * 400, 3), rng.choice(["A", "Am", "Cmaj7"])) for g in range(3) for _ in range(60)]
    late = [(r[1] + rng.random() * 50, r) for r in rows] + [(start + 10_000 + i, (9, float(start + 10_000 + i), "end")) for i in (0, 1)]
    table = lambda rs: spark.createDataFrame(rs, "g int, t double, token string").select("g", F.timestamp_millis((F.col("t") * 1000).cast("long")).alias("ts"), "token")
    arrived = [r for _, r in sorted(late)]
    for i in range(0, len(arrived), 23):
        table(arrived[i : i + 23]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("g int, ts timestamp, token string").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
        out = extensions.proximity_dedup(stream, ["g"], "ts", "token", 5.0, "60 seconds")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    batch = table([r for r in rows]).select("g", F.unix_micros("ts").cast("double").alias("x"), "token")
    want = sorted((r["g"], int(r["x"]), r["token"]) for r in coverage.proximity_dedup(batch, ["g"], "x", "token", 5e6).collect())
    got = sorted((r["g"], r["at"], r["token"]) for r in spark.read.parquet(str(tmp_path / "out")).where("g <> 9").collect())
    assert got == want and len(want) > 60


def test_cleaned(spark):
    start, mod = '<tuplet type="start"/>', "<time-modification><x/></time-modification>"
    good = f'<measure number="2">{start}{mod}<tuplet type="stop"/></measure>'
    text = f'<s><part>\n<measure number="1"><a/>{start}{mod}</measure>\n{good}</part></s>'
    df = spark.createDataFrame([("one", text), ("none", "<s/>")], "song string, value string")
    got = {r["song"]: (r["value"], r["fixed"]) for r in sinks.cleaned(df).collect()}
    assert got == {"one": (f'<s><part>\n<measure number="1"><a/></measure>\n{good}</part></s>', 1), "none": ("<s/>", 0)}
    assert {r["song"]: r["value"] for r in sinks.cleaned(df, True).collect()}["one"].count("tuplet") == 0
