"""Score files as tables: zipped recognition projects, MusicXML, recogniser tables, truth and label files.

Files come through binaryFile or text, so any store that Spark reads will do. XML is parsed by one function over many files at once,
and a file that can't be read gives a row of its error instead of stopping the rest.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

# Names and attributes of the two formats.
SHEET = re.compile(r"sheet#(\d+)/sheet#\d+\.xml$")
KIND_FIGURES = {
    "major": "", "minor": "m", "augmented": "+", "diminished": "dim", "dominant": "7", "dominant-seventh": "7", "major-seventh": "maj7", "major-minor": "mM7", "minor-major-seventh": "mM7", "minor-seventh": "m7",
    "augmented-seventh": "7+", "half-diminished": "ø7", "half-diminished-seventh": "ø7", "diminished-seventh": "o7", "major-sixth": "6", "minor-sixth": "m6", "major-ninth": "M9", "dominant-ninth": "9", "minor-ninth": "m9",
    "dominant-11th": "11", "major-11th": "M11", "minor-11th": "m11", "dominant-13th": "13", "major-13th": "M13", "minor-13th": "m13", "suspended-second": "sus2", "suspended-fourth": "sus", "power": "power", "pedal": "pedal",
}
STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}

BARLINE = "song string, sheet int, staff int, bar_id string, x double, measure_local int"
GLYPH = "song string, sheet int, staff int, doc_pos int, value string, x double, y double, w double, h double"
HEAD = "song string, sheet int, staff int, id string, pitch_position int, shape string, x double, y double, head_chord_id string, linked boolean, linked_measure int"
STAFF_LINE = "song string, sheet int, staff int, y_top double, y_min double, y_max double"
SHEET_SIZE = "song string, sheet int, n_measures int"
VOCAL_STAFF = "song string, sheet int, staff int"
NOTE = "song string, part int, measure int, voice int, seq int, kind string, pitches array<int>, step string, alter int, octave int, has_accidental boolean, offset double, ql double"
MEASURE = "song string, part int, seq int, number int, ql double, left_barline string, fifths array<int>, beats string, beat_type string"
LYRIC = "song string, part int, measure int, note_seq int, pos int, verse int, text string"
HARMONY = "song string, part int, measure int, seq int, offset double, figure string, root string, kind string, kind_text string, n_degrees int, in_voice boolean, bass string, degrees array<string>"


def song_name(path: Column) -> Column:
    """A file's name without folders and endings."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def _rows(df: DataFrame, schema: str, parse: Callable[[str, bytes], Iterable[tuple]]) -> DataFrame:
    out = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        for b in batches:
            rows = []
            for song, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += list(parse(song, content))
                except (ElementTree.ParseError, zipfile.BadZipFile, ValueError, KeyError):
                    continue  # listed by unreadable()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return df.select("song", "content").mapInArrow(run, out)


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Rows (song, path, content) of the files that match, whatever their folders."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return df.select(song_name(F.col("path")).alias("song"), "path", "content")


def unreadable(df: DataFrame) -> DataFrame:
    """Rows (song, error) of the files that aren't XML or a ZIP with XML."""

    def check(song: str, content: bytes) -> Iterable[tuple]:
        try:
            for _, xml in sheets(content) if content[:2] == b"PK" else [(0, content)]:
                ElementTree.fromstring(xml)
            return []
        except Exception as e:  # every kind of broken file is to be listed
            return [(song, f"{type(e).__name__}: {e}"[:200])]

    return _rows(df, "song string, error string", check)


def sheets(content: bytes) -> list[tuple[int, bytes]]:
    """(number, XML) of a recognition project's sheets, by number; of other ZIPs the first XML outside META-INF, as sheet 0."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        found = sorted((int(m[1]), n) for n in z.namelist() if (m := SHEET.search(n)))
        if found:
            return [(k, z.read(n)) for k, n in found]
        name = next(n for n in z.namelist() if n.endswith(".xml") and not n.startswith("META-INF"))
        return [(0, z.read(name))]


def _number(text: str | None, kind=float):
    try:
        return kind(text)
    except (TypeError, ValueError):
        return None


def _leading(text: str | None) -> int | None:
    """The integer that an id like 10C begins with."""
    m = re.match(r"\d+", text or "")
    return int(m[0]) if m else None


def _bounds(el: ElementTree.Element) -> tuple[float | None, ...]:
    b = el.find("bounds")
    return tuple(_number(b.get(k)) if b is not None else None for k in "xywh")


def _sheet_rows(df: DataFrame, schema: str, parse: Callable[[ElementTree.Element], Iterable[tuple]]) -> DataFrame:
    """Rows of whole projects (song, content), or of single sheets (song, sheet, xml) as archives.sheets reads them."""
    if "xml" in df.columns:
        read = df.where("xml is not null").select(F.to_json(F.struct("song", "sheet")).alias("song"), F.col("xml").alias("content"))
        one = lambda key, xml: ((json.loads(key).get("song"), json.loads(key).get("sheet"), *row) for row in parse(ElementTree.fromstring(xml)))
        return _rows(read, schema, one)
    return _rows(df, schema, lambda song, content: ((song, k, *row) for k, xml in sheets(content) for row in parse(ElementTree.fromstring(xml))))


def glyphs(projects: DataFrame) -> DataFrame:
    """Chord-name glyphs with a staff and bounds, in document order; those without a value are kept for labelling."""

    def parse(root):
        for pos, g in enumerate(root.iter("chord-name")):
            box, staff = _bounds(g), _number(g.get("staff"), int)
            if staff is not None and box[0] is not None:
                yield (staff, pos, g.get("value"), *box)

    return _sheet_rows(projects, GLYPH, parse)


def barlines(projects: DataFrame) -> DataFrame:
    """Right bar lines of measures by staff: the measure's list of ids joined to the bars' places; unknown ids are left out."""

    def parse(root):
        bars = {}
        for b in root.iter("staff-barline"):
            box = _bounds(b)
            staff = _number(b.get("staff"), int)
            if b.get("id") and staff is not None and box[0] is not None:
                bars[b.get("id")] = (staff, box[0])
        for m in root.iter("measure"):
            number = _leading(m.get("id"))
            for ids in m.iterfind("right-barline/staff-barlines"):
                for i in (ids.text or "").split():
                    if number is not None and i in bars:
                        yield (bars[i][0], i, bars[i][1], number)

    return _sheet_rows(projects, BARLINE, parse)


def sheet_sizes(projects: DataFrame) -> DataFrame:
    """The highest measure number of each sheet, whether or not the measure has a usable bar line."""
    return _sheet_rows(projects, SHEET_SIZE, lambda root: [(max((n for m in root.iter("measure") if (n := _leading(m.get("id"))) is not None), default=0),)])


def heads(projects: DataFrame) -> DataFrame:
    """Note heads with the chord that contains them, whichever way the relation points, and whether a measure lists that chord."""

    def parse(root):
        ids = {h.get("id") for h in root.iter("head")}
        chords = {c.get("id") for c in root.iter("head-chord")}
        listed = {i: _leading(m.get("id")) for m in root.iter("measure") if _leading(m.get("id")) is not None for i in (m.findtext("head-chords") or "").split()}
        chord_of = {}
        for r in root.iter("relation"):
            if r.find("containment") is not None:
                a, b = r.get("source"), r.get("target")
                for chord, head in ((a, b), (b, a)):
                    if chord in chords and head in ids:
                        chord_of.setdefault(head, chord)
        for h in root.iter("head"):
            box, staff = _bounds(h), _number(h.get("staff"), int)
            position = _number(h.get("pitch"), int)
            if h.get("id") and h.get("shape") and staff is not None and position is not None and box[0] is not None:
                chord = chord_of.get(h.get("id"))
                yield (staff, h.get("id"), position, h.get("shape"), box[0], box[1], chord, chord in listed, listed.get(chord))

    return _sheet_rows(projects, HEAD, parse)


def staff_lines(projects: DataFrame) -> DataFrame:
    """Top line's mean height and the extent of all lines of each staff."""

    def parse(root):
        for s in root.iter("staff"):
            lines = [[y for p in line.iter("point") if (y := _number(p.get("y"))) is not None] for line in s.iter("line")]
            lines, staff = [x for x in lines if x], _number(s.get("id"), int)
            if lines and staff is not None:
                yield (staff, sum(lines[0]) / len(lines[0]), min(map(min, lines)), max(map(max, lines)))

    return _sheet_rows(projects, STAFF_LINE, parse)


def vocal_staves(projects: DataFrame, sentences: bool = False) -> DataFrame:
    """Staves that have words, and if asked those of lyric sentences."""

    def parse(root):
        found = {_number(w.get("staff"), int) for w in root.iter("word")}
        if sentences:
            found |= {_number(c.get("staff"), int) for c in root.iter("chord-sentence") if c.get("role") == "lyrics"}
        return [(s,) for s in sorted(found - {None})]

    return _sheet_rows(projects, VOCAL_STAFF, parse)


def _text(el: ElementTree.Element, path: str) -> str | None:
    found = el.findtext(path)
    return found.strip() if found is not None else None


def _spelled(step: str | None, alter: float) -> str:
    return (step or "") + ("#" * int(alter) if alter > 0 else "b" * int(-alter))


def _figure(el: ElementTree.Element, root: str, kind: ElementTree.Element | None) -> str:
    """A chord symbol as one text: root, the kind's text or else its usual abbreviation, a bass other than the root, and the degrees."""
    text = kind.get("text") if kind is not None else None
    name = (kind.text or "").strip() if kind is not None else ""
    out = root + (text if text else KIND_FIGURES.get(name, ""))
    bass = _bass(el)
    if bass and bass != root:
        out += "/" + bass
    return " ".join([out, *_degrees(el)])


def _bass(el: ElementTree.Element) -> str:
    return _spelled(_text(el, "bass/bass-step"), _number(_text(el, "bass/bass-alter"), float) or 0)


def _degrees(el: ElementTree.Element) -> list[str]:
    """A chord symbol's degrees, each as its type, alteration and number: add b9."""
    return [f"{_text(d, 'degree-type') or 'add'} {_spelled('', _number(_text(d, 'degree-alter'), float) or 0)}{_text(d, 'degree-value') or ''}" for d in el.iterfind("degree")]


def parse_score(content: bytes) -> dict[str, list[tuple]]:
    """Rows of notes, measures, lyrics and chord symbols of a MusicXML file, by order of its elements; without the song."""
    xml = sheets(content)[0][1] if content[:2] == b"PK" else content
    out: dict[str, list[tuple]] = {"note": [], "measure": [], "lyric": [], "harmony": []}
    for part, p in enumerate(ElementTree.fromstring(xml).iter("part")):
        divisions, note_seq = 1, 0
        for m_seq, m in enumerate(p.iterfind("measure")):
            number = _leading(m.get("number")) or 0
            at = longest = 0.0
            fifths, left, n_harmony, last_start, time = [], None, 0, 0.0, (None, None)
            for el in m:
                if el.tag == "attributes":
                    divisions = _number(_text(el, "divisions"), float) or divisions
                    fifths += [int(k.text) for k in el.iterfind("key/fifths") if _number(k.text, int) is not None]
                    if el.find("time") is not None:
                        time = (_text(el, "time/beats"), _text(el, "time/beat-type"))
                elif el.tag in ("backup", "forward"):
                    at += (_number(_text(el, "duration")) or 0) / divisions * (-1 if el.tag == "backup" else 1)
                elif el.tag == "barline" and el.get("location") == "left":
                    left = _text(el, "bar-style") or ("repeat" if el.find("repeat") is not None else None)
                elif el.tag == "harmony":
                    step, alter, kind = _text(el, "root/root-step"), _number(_text(el, "root/root-alter"), float) or 0, el.find("kind")
                    root = _spelled(step, alter)
                    shown = kind.get("text") if kind is not None else None
                    out["harmony"].append((part, number, n_harmony, at + (_number(_text(el, "offset")) or 0) / divisions, _figure(el, root, kind), root, kind.text if kind is not None else None, shown, len(el.findall("degree")), False, _bass(el) or None, _degrees(el)))
                    n_harmony += 1
                elif el.tag == "note":
                    ql = 0.0 if el.find("grace") is not None else (_number(_text(el, "duration")) or 0) / divisions
                    chord, rest = el.find("chord") is not None, el.find("rest") is not None
                    start = last_start if chord else at
                    step, octave, alter = _text(el, "pitch/step"), _number(_text(el, "pitch/octave"), int), int(_number(_text(el, "pitch/alter"), float) or 0)
                    midi = 12 * (octave + 1) + STEPS[step] + alter if step in STEPS and octave is not None else None
                    if chord and out["note"] and out["note"][-1][4] != "rest":
                        before = list(out["note"][-1])
                        before[4], before[5] = "chord", [*before[5], midi]
                        out["note"][-1] = tuple(before)
                        continue
                    voice = _number(_text(el, "voice"), int) or 1
                    out["note"].append((part, number, voice, note_seq, "rest" if rest else "note", [] if midi is None else [midi], step, alter, octave, el.find("accidental") is not None, start, ql))
                    for pos, ly in enumerate(el.iterfind("lyric")):
                        out["lyric"].append((part, number, note_seq, pos, _number(ly.get("number"), int) or 1, _text(ly, "text") or ""))
                    note_seq += 1
                    last_start, at = start, at + ql
                longest = max(longest, at)
            out["measure"].append((part, m_seq, number, longest, left, fifths, *time))
    return out


PART = "song string, part int, id string, name string, instrument string, measures int, notes int, sung int, chord_symbols int, voices int, time string, fifths int, rehearsal_marks int, texts int, repeats int, first_chords array<string>"
SPANNER = "song string, kind string"
#: Elements that span notes, and the attribute and values by which each is counted once. Fixed values.
SPANNERS = {"slur": ("start",), "wedge": ("crescendo", "diminuendo"), "octave-shift": ("up", "down"), "ending": ("start",), "glissando": ("start",), "slide": ("start",), "wavy-line": ("start",), "bracket": ("start",), "dashes": ("start",), "pedal": ("start",)}


def _part_row(root: ElementTree.Element, part: int, p: ElementTree.Element, samples: int = 8) -> tuple:
    """What a part holds. Notes are those with a pitch, a chord's counted once, and chord symbols; voices are those of measures that have several."""
    listed = next((x for x in root.iterfind("part-list/score-part") if x.get("id") == p.get("id")), None)
    said = lambda at: _text(listed, at) if listed is not None else None
    measures, harmonies = p.findall("measure"), list(p.iter("harmony"))
    heads = [n for n in p.iter("note") if n.find("rest") is None and n.find("chord") is None]
    voices = [len({_text(n, "voice") or "1" for n in m.iterfind("note")}) for m in measures]
    beats, unit, key = next(((t.findtext("beats"), t.findtext("beat-type")) for t in p.iter("time")), (None, None)) + (p.find(".//key/fifths"),)
    figures = [_figure(h, _spelled(_text(h, "root/root-step"), _number(_text(h, "root/root-alter"), float) or 0), h.find("kind")) for h in harmonies[:samples]]
    return (
        part, p.get("id"), said("part-name"), said("score-instrument/instrument-name"), len(measures), len(heads) + len(harmonies), sum(n.find("lyric") is not None for n in heads), len(harmonies),
        sum(v for v in voices if v > 1), f"{beats}/{unit}" if beats and unit else None, _number(key.text, int) if key is not None else None, len(list(p.iter("rehearsal"))), len(list(p.iter("words"))),
        sum(m.find("barline/repeat") is not None for m in measures), figures,
    )


def inspection(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of every part's counts, rows (song, kind, n) of the spanners) of MusicXML files, plain or zipped."""

    def root(content: bytes) -> ElementTree.Element:
        return ElementTree.fromstring(sheets(content)[0][1] if content[:2] == b"PK" else content)

    def kinds(song: str, content: bytes) -> Iterable[tuple]:
        for el in root(content).iter():
            if el.get("type") in SPANNERS.get(el.tag, ()):
                yield song, el.get("type") if el.tag == "wedge" else el.tag

    parts = _rows(scores, PART, lambda song, content: ((song, *_part_row(r, i, p)) for r in [root(content)] for i, p in enumerate(r.iterfind("part"))))
    return parts, _rows(scores, SPANNER, kinds).groupBy("song", "kind").agg(F.count("*").alias("n"))


def score_table(scores: DataFrame, name: str) -> DataFrame:
    """note, measure, lyric or harmony rows of MusicXML files, plain or zipped."""
    schema = {"note": NOTE, "measure": MEASURE, "lyric": LYRIC, "harmony": HARMONY}[name]
    return _rows(scores, schema, lambda song, content: ((song, *row) for row in parse_score(content)[name]))


def ocr_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (strip, left, width, conf, text) of a recogniser's tab-separated tables; lines of fewer than 12 columns or without numbers are left out."""
    line = spark.read.text(folder).select(song_name(F.input_file_name()).alias("strip"), F.split("value", "\t").alias("c")).where("size(c) >= 12")
    out = line.select("strip", F.col("c")[6].try_cast("int").alias("left"), F.col("c")[8].try_cast("int").alias("width"), F.col("c")[10].try_cast("double").alias("conf"), F.col("c")[11].alias("text"))
    return out.where("left is not null and width is not null and conf is not null")


def sweep_windows(width: Column, size: int, step: int) -> Column:
    """Left edges of the windows that slide over a strip."""
    return F.sequence(F.lit(0), F.greatest(width - F.lit(size), F.lit(0)), F.lit(step))


TRUTH = "song string, key_fifths int, time_signature string, comment string, merge_measures array<array<int>>, measures map<string, struct<lyrics_v1: array<string>, chords: array<string>, inject_pitch: string, comment: string>>"


def song_truth(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(measures, merges) of truth files: (slug, measure, chords, lyrics_v1, inject_pitch), where null says nothing and an empty list
    clears; and (slug, grp, measure). Broken files give nothing."""
    raw = spark.read.schema(TRUTH).option("multiLine", "true").option("mode", "PERMISSIVE").json(folder).withColumn("slug", song_name(F.input_file_name()))
    m = raw.where("measures is not null").select("slug", F.explode("measures").alias("k", "v")).select("slug", F.col("k").try_cast("int").alias("measure"), "v.chords", "v.lyrics_v1", "v.inject_pitch").where("measure is not null")
    merges = raw.where("merge_measures is not null").select("slug", F.posexplode("merge_measures").alias("grp", "ms")).select("slug", "grp", F.explode("ms").alias("measure"))
    return m, merges


def by_slug(songs: DataFrame, truth: DataFrame, song: str = "song") -> DataFrame:
    """songs with the truth of their slug, or else of the slug without its number in front."""
    from scoreframe.functions.text import slug

    keyed = songs.withColumn("_slug", slug(F.col(song)))
    exact = truth.withColumnRenamed("slug", "_slug")
    bare = exact.withColumn("_bare", F.regexp_replace("_slug", r"^\d+_", "")).drop("_slug")
    first = keyed.join(exact, "_slug")
    rest = keyed.join(exact.select("_slug").distinct(), "_slug", "left_anti").withColumn("_bare", F.regexp_replace("_slug", r"^\d+_", "")).join(bare, "_bare")
    return first.drop("_slug").unionByName(rest.drop("_slug", "_bare"), allowMissingColumns=True)


def song_keys(spark: SparkSession, path: str) -> DataFrame:
    """Rows (song, key_fifths, expected_flat_letters, chromatic_root_notes) of a songbook's key file."""
    schema = "schema_version int, songs map<string, struct<key_fifths: int, expected_flat_letters: array<string>, chromatic_root_notes: array<string>>>"
    raw = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path).where("songs is not null")
    return raw.select(F.explode("songs").alias("song", "v")).select("song", "v.*")


def labels_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").option("escape", '"').csv(path)


def review_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (song, measure, reason, detail) of review tables in Markdown."""
    row = r"^\|\s*(\d+)\s*\|\s*([^|]*?)\s*\|\s*([^|]*?)\s*\|\s*$"
    line = spark.read.text(folder).where(F.col("value").rlike(row))
    return line.select(song_name(F.input_file_name()).alias("song"), F.regexp_extract("value", row, 1).cast("int").alias("measure"), F.regexp_extract("value", row, 2).alias("reason"), F.regexp_extract("value", row, 3).alias("detail"))


def class_files(spark: SparkSession, folder: str, least: int = 1) -> DataFrame:
    """Rows (path, label) of images in class folders whose label is a chord, of classes with least files or more."""
    from scoreframe.functions.chords import parse
    from scoreframe.functions.text import label_of_filename
    from scoreframe.operators.labels import frequent_classes

    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(folder).select("path")
    named = paths.withColumn("label", label_of_filename(F.element_at(F.split("path", "/"), -2)))
    return frequent_classes(named.where(parse(F.col("label")).isNotNull()), "label", least)


def crop_position(filename: Column) -> Column:
    """struct(src, sheet, x, y) of a crop's file name; null for other names."""
    shape = r"^(.*)_sheet(\d+)(?:_art)?_(\d+)_(\d+)\.png$"
    part = lambda k: F.regexp_extract(filename, shape, k)
    return F.when(filename.rlike(shape), F.struct(part(1).alias("src"), part(2).cast("int").alias("sheet"), part(3).cast("int").alias("x"), part(4).cast("int").alias("y")))
