"""Reports and files: flags, summaries, labelling pages, truth starters, caches, logs and lint findings."""

from __future__ import annotations

import ast
import html
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreframe.functions.pitch import midi, spelled

LABEL_FIELDS = ("filename", "source", "audiveris_guess", "context", "classifier_guess", "classifier_conf", "correct_label")
# Calls that may block, by module.
TIMED_CALLS = {
    "subprocess": {"run", "call", "check_call", "check_output", "communicate", "wait"}, "requests": {"get", "post", "put", "delete", "head", "patch", "request"},
    "httpx": {"get", "post", "put", "delete", "head", "patch", "request"}, "urllib": {"urlopen"}, "socket": {"create_connection"}, "sqlite3": {"connect"},
}


def flags_markdown(flags: DataFrame) -> DataFrame:
    """Rows (song, value): each song's table of flags in order; a song's flags are few."""
    row = F.concat(F.lit("| "), F.col("measure"), F.lit(" | "), F.col("reason"), F.lit(" | "), F.coalesce("detail", F.lit("")), F.lit(" |"))
    lines = flags.groupBy("song").agg(F.array_sort(F.collect_list(F.struct("measure", row.alias("r")))).alias("x"))
    return lines.select("song", F.concat(F.lit("| measure | reason | detail |\n|---|---|---|\n"), F.array_join(F.transform("x", lambda i: i["r"]), "\n"), F.lit("\n")).alias("value"))


def summary_markdown(table: DataFrame, song: str, reasons: list[str]) -> DataFrame:
    """The table of flag counts as lines (at, value): head, songs by name, the totals last."""
    head = "| " + " | ".join([song, *reasons, "total"]) + " |\n|" + "---|" * (len(reasons) + 2)
    body = table.select((F.col(song) == "TOTAL").alias("_t"), F.col(song).alias("_s"), F.concat(F.lit("| "), F.concat_ws(" | ", song, *[F.col(r).cast("string") for r in reasons], F.col("total").cast("string")), F.lit(" |")).alias("value"))
    top = table.sparkSession.createDataFrame([(None, None, head)], "_t boolean, _s string, value string")
    return top.union(body).orderBy(F.asc_nulls_first("_t"), "_s").select("value")


def write_per_song(df: DataFrame, folder: str) -> None:
    """value as text, a folder for each song."""
    df.select("song", "value").write.mode("overwrite").partitionBy("song").option("lineSep", "\n").text(folder)


def write_labels(df: DataFrame, folder: str) -> None:
    """CSV with the fixed order of fields; fields that df lacks are empty."""
    df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in LABEL_FIELDS]).write.mode("overwrite").option("header", "true").option("escape", '"').csv(folder)


def csv_field(text: Column) -> Column:
    """Quoted only where it has a comma or a quote."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.contains(",") | text.contains('"'), quoted).otherwise(text)


def data_url(content: Column, mime: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(content))


def review_page(rows: DataFrame, song: str, order: str, image: Column, summary: Column) -> DataFrame:
    """Rows (song, value): one self-contained page for each song with its crops, summaries and a box for each; text is escaped."""
    safe = F.replace(F.replace(F.replace(summary, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    block = F.format_string('<section><img src="%s" alt=""><p>%s</p><textarea name="m%s"></textarea></section>', data_url(image), safe, F.col(order))
    pages = rows.groupBy(song).agg(F.array_sort(F.collect_list(F.struct(F.col(order), block.alias("b")))).alias("x"))
    head = F.lit("<!doctype html><meta charset=\"utf-8\"><title>Review</title>")
    return pages.select(F.col(song).alias("song"), F.concat(head, F.array_join(F.transform("x", lambda i: i["b"]), "\n")).alias("value"))


def label_page(rows: list[dict]) -> str:
    """The page for labelling one batch of crops (filename, image, guess, conf); its size is that of the batch given."""
    cells = "".join(
        f'<figure data-conf="{float(r.get("conf") or 0):.3f}"><img src="{html.escape(r["image"], True)}" alt=""><input name="{html.escape(r["filename"], True)}" value="{html.escape(r.get("guess") or "", True)}"></figure>'
        for r in rows
    )
    return f'<!doctype html><meta charset="utf-8"><title>Labels</title>{cells}'


DIVISIONS = 10080  # of a quarter: whole numbers for all lengths of 2, 3, 5 and 7 parts


def _escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _element(name: str, text: Column) -> Column:
    """<name>text</name>; nothing for null."""
    return F.coalesce(F.concat(F.lit(f"<{name}>"), text.cast("string"), F.lit(f"</{name}>")), F.lit(""))


def _pitch(name: Column) -> Column:
    alter = F.when(name["alter"] != 0, _element("alter", name["alter"])).otherwise("")
    return F.concat(F.lit("<pitch>"), _element("step", name["step"]), alter, _element("octave", name["octave"]), F.lit("</pitch>"))


def _degree(degree: Column) -> Column:
    """The element of a degree given as type, alteration and number: add b9."""
    part = lambda i: F.regexp_extract(degree, r"^(\w+) ([#b]*)(\d+)$", i)
    alter = F.length(F.regexp_replace(part(2), "b", "")) - F.length(F.regexp_replace(part(2), "#", ""))
    return F.when(part(3) != "", F.concat(F.lit("<degree>"), _element("degree-value", part(3)), _element("degree-alter", alter), _element("degree-type", part(1)), F.lit("</degree>"))).otherwise("")


def _root(name: str, spelled: Column) -> Column:
    """The elements of a spelled root or bass; nothing for null or empty."""
    alter = F.length(F.regexp_replace(spelled, "[^#]", "")) - F.length(F.regexp_replace(F.substring(spelled, 2, 9), "[^b-]", ""))
    body = F.concat(_element(f"{name}-step", F.substring(spelled, 1, 1)), F.when(alter != 0, _element(f"{name}-alter", alter)).otherwise(""))
    return F.when(F.coalesce(F.length(spelled), F.lit(0)) > 0, F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))).otherwise("")


def musicxml(measures: DataFrame, notes: DataFrame, harmonies: DataFrame, lyrics: DataFrame | None = None) -> DataFrame:
    """Rows (song, value): a lead sheet of one part for each song as MusicXML, without new notation: what the tables say, at the places they say.

    measures (song, number, fifths), notes (song, measure, seq, kind, pitches, offset, ql), harmonies (song, measure, seq, offset, root, kind, kind_text), lyrics (song, note_seq, verse, text).
    Where they have them: step, alter and octave of a single note are kept, other pitches take the name nearest to the key that holds; bass (another than the root) and degrees of harmonies, and
    beats, beat_type and left_barline (a style, or repeat) of measures, are written. What lies in measures that the song doesn't have is left out; a song is the unit of memory. Grace notes
    (length 0) are written as such.
    """
    ticks = lambda c: F.round(F.coalesce(c, F.lit(0.0)) * DIVISIONS).cast("long")
    verse = F.concat(F.lit('<lyric number="'), F.coalesce(F.col("verse"), F.lit(1)).cast("string"), F.lit('">'), _element("text", _escaped(F.col("text"))), F.lit("</lyric>"))
    has = lambda df, c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    own = F.struct(has(notes, "step", "string").alias("step"), F.coalesce(has(notes, "alter", "int"), F.lit(0)).cast("int").alias("alter"), has(notes, "octave", "int").cast("int").alias("octave"))
    held = F.last(F.when(F.size("fifths") > 0, F.element_at("fifths", -1)), ignorenulls=True).over(Window.partitionBy("song").orderBy("number").rowsBetween(Window.unboundedPreceding, 0))
    keys = measures.select("song", F.col("number").alias("measure"), held.alias("key"))
    n = notes.select("song", "measure", "seq", "kind", "pitches", "offset", "ql", own.alias("own")).join(keys, ["song", "measure"], "left")
    if lyrics is not None:
        sung = lyrics.where("text is not null").groupBy("song", F.col("note_seq").alias("seq")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("verse", verse.alias("x")))), lambda i: i["x"]), "").alias("words"))
        n = n.join(sung, ["song", "seq"], "left")
    else:
        n = n.withColumn("words", F.lit(None).cast("string"))
    length = F.when(ticks(F.col("ql")) > 0, _element("duration", ticks(F.col("ql")))).otherwise("")
    grace = F.when(ticks(F.col("ql")) > 0, "").otherwise("<grace/>")
    sounding = F.filter("pitches", lambda p: p.isNotNull())
    one = lambda p, i: F.concat(F.lit("<note>"), grace, F.when(i > 0, "<chord/>").otherwise(""), _pitch(F.when(midi(F.col("own.step"), F.col("own.alter"), F.col("own.octave")) == p, F.col("own")).otherwise(spelled(p, F.col("key")))), length, F.when(i == 0, F.coalesce("words", F.lit(""))).otherwise(""), F.lit("</note>"))
    silent = F.concat(F.lit("<note><rest/>"), length, F.lit("</note>"))
    sound = F.when((F.col("kind") == "rest") | (F.coalesce(F.size(sounding), F.lit(0)) < 1), silent).otherwise(F.array_join(F.transform(sounding, one), ""))
    bar = lambda df: df.withColumn("number", F.col("measure"))
    events = bar(n).select("song", "number", ticks(F.col("offset")).alias("at"), F.lit(1).alias("rank"), F.col("seq").cast("long").alias("seq"), ticks(F.col("ql")).alias("long"), sound.alias("xml"))
    kind = F.concat(F.lit('<kind text="'), _escaped(F.coalesce("kind_text", F.lit(""))), F.lit('">'), _escaped(F.coalesce("kind", F.lit("major"))), F.lit("</kind>"))
    bass = has(harmonies, "bass", "string")
    degrees = F.array_join(F.transform(F.coalesce(has(harmonies, "degrees", "array<string>"), F.array().cast("array<string>")), _degree), "")
    chord = F.concat(F.lit("<harmony>"), _root("root", F.col("root")), kind, F.when(bass != F.coalesce("root", F.lit("")), _root("bass", bass)).otherwise(""), degrees, F.lit("</harmony>"))
    events = events.unionByName(bar(harmonies).select("song", "number", ticks(F.col("offset")).alias("at"), F.lit(0).alias("rank"), F.col("seq").cast("long").alias("seq"), F.lit(0).cast("long").alias("long"), chord.alias("xml")))
    order = F.array_sort(F.collect_list(F.struct("at", "rank", "seq", "long", "xml")))
    listed = events.groupBy("song", "number").agg(order.alias("e"))
    # the cursor stands at the end of the event before: step forward or back to each one's place
    end = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("e", i - 1)["at"] + F.get("e", i - 1)["long"])
    step = lambda gap: F.when(gap > 0, F.concat(F.lit("<forward>"), _element("duration", gap), F.lit("</forward>"))).when(gap < 0, F.concat(F.lit("<backup>"), _element("duration", -gap), F.lit("</backup>"))).otherwise("")
    body = F.array_join(F.transform("e", lambda x, i: F.concat(step(x["at"] - end(i)), x["xml"])), "")
    first = F.row_number().over(Window.partitionBy("song").orderBy("number")) == 1
    fifths = F.array_join(F.transform(F.coalesce("fifths", F.array().cast("array<int>")), lambda k: F.concat(F.lit("<key>"), _element("fifths", k), F.lit("</key>"))), "")
    time = F.when(F.col("beats").isNotNull(), F.concat(F.lit("<time>"), _element("beats", F.col("beats")), _element("beat-type", F.col("beat_type")), F.lit("</time>"))).otherwise("")
    attributes = F.concat(F.when(F.col("_first"), F.lit(f"<divisions>{DIVISIONS}</divisions>")).otherwise(""), fifths, time)
    style = F.when(F.col("left_barline") == "repeat", F.lit('<repeat direction="forward"/>')).otherwise(_element("bar-style", _escaped(F.col("left_barline"))))
    left = F.when(F.col("left_barline").isNotNull(), F.concat(F.lit('<barline location="left">'), style, F.lit("</barline>"))).otherwise("")
    full = measures.select("song", "number", "fifths", *(has(measures, c, "string").cast("string").alias(c) for c in ("beats", "beat_type", "left_barline"))).withColumn("_first", first).join(listed.select("song", "number", body.alias("body")), ["song", "number"], "left")
    xml = F.concat(F.lit('<measure number="'), F.col("number").cast("string"), F.lit('">'), F.when(attributes != "", _element("attributes", attributes)).otherwise(""), left, F.coalesce("body", F.lit("")), F.lit("</measure>"))
    songs = full.groupBy("song").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", xml.alias("x")))), lambda i: i["x"]), "\n").alias("body"))
    head = F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<score-partwise version="4.0"><part-list><score-part id="P1"><part-name>Lead</part-name></score-part></part-list><part id="P1">\n')
    return songs.select("song", F.concat(head, "body", F.lit("\n</part></score-partwise>\n")).alias("value"))


def cleaned(scores: DataFrame, aggressive: bool = False) -> DataFrame:
    """Rows (song, value, fixed): the XML text of scores (song, value) without the tuplets of measures that don't balance, and how many measures changed; if aggressive,
    without any tuplet, and fixed is 0."""
    from scoreframe.operators.repair import TUPLET_PARTS, strip_tuplets

    whole = F.col("value")
    if aggressive:
        for pattern in TUPLET_PARTS:
            whole = F.regexp_replace(whole, pattern, "")
        return scores.select("song", whole.alias("value"), F.lit(0).alias("fixed"))
    # texts between the measures' ends, each with at most one measure at its end; what follows the last one is kept as it is
    pieces = F.split("value", "(?<=</measure>)")
    head = lambda p: F.regexp_extract(p, r"(?s)^(.*?)(<measure[^>]*>.*</measure>)$", 1)
    tail = lambda p: F.regexp_extract(p, r"(?s)^(.*?)(<measure[^>]*>.*</measure>)$", 2)
    fixed = lambda p: F.when(p.rlike(r"(?s)<measure[^>]*>.*</measure>$"), F.concat(head(p), strip_tuplets(tail(p)))).otherwise(p)
    out = scores.select("song", pieces.alias("_p")).withColumn("_q", F.transform("_p", fixed))
    changed = F.aggregate(F.zip_with("_p", "_q", lambda a, b: (a != b).cast("int")), F.lit(0), lambda n, x: n + x)
    return out.select("song", F.array_join("_q", "").alias("value"), changed.alias("fixed"))


def truth_starter(measures: DataFrame) -> DataFrame:
    """Rows (song, value): a truth file to edit, from rows (song, measure, chords, lyrics_v1)."""
    entry = F.struct(F.col("measure").cast("string").alias("k"), F.struct("chords", "lyrics_v1").alias("v"))
    grouped = measures.groupBy("song").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("measure", entry.alias("e")))), lambda i: i["e"])).alias("measures"))
    return grouped.select("song", F.to_json(F.struct("song", F.lit(None).cast("int").alias("key_fifths"), "measures"), {"ignoreNullFields": "false"}).alias("value"))


def write_new(df: DataFrame, folder: str) -> None:
    """Refuses to write over what is there."""
    df.write.mode("errorifexists").partitionBy("song").text(folder)


def recognise(images: DataFrame, model: Callable[[list[bytes]], list[tuple[str, float]]], content: str, cache: DataFrame | None = None) -> DataFrame:
    """images with chord and conf. Equal images are recognised once, and those of the cache (id, chord, conf) not at all."""
    from scoreframe.functions.text import content_id

    keyed = images.withColumn("_id", content_id(F.col(content)))
    todo = keyed.groupBy("_id").agg(F.first(content).alias("_c"))
    if cache is not None:
        todo = todo.join(cache.select(F.col("id").alias("_id")), "_id", "left_anti")

    @F.pandas_udf("struct<chord: string, conf: double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            yield pd.DataFrame(model([bytes(x) for x in s]), columns=["chord", "conf"])

    done = todo.withColumn("_r", run("_c")).select("_id", "_r.chord", "_r.conf")
    if cache is not None:
        done = done.unionByName(cache.select(F.col("id").alias("_id"), "chord", "conf"))
    return keyed.join(done, "_id", "left").drop("_id")


def clean_answer(text: Column) -> Column:
    """A model's answer without quotes and marks; empty for SKIP and UNSURE, and for what isn't a chord."""
    s = F.rtrim(F.btrim(F.rtrim(F.trim(text), F.lit(".,;:!")), F.lit("\"'`")), F.lit(".,;:!"))
    return F.when(F.upper(s).isin("SKIP", "UNSURE") | ~s.rlike(r"^[A-G][#b♯♭]?(?:maj|min|aug|dim|sus|add|m|M|b|#|\+|\-|\(|\)|[0-9/])*$"), "").otherwise(s)


def retried(call: Callable, attempts: int = 5, first_wait: float = 1.0, longest_wait: float = 30.0, sleep: Callable[[float], None] | None = None, fatal: Callable[[Exception], bool] = lambda e: False):
    """call(), again after failures, with waits that double; the last failure is raised."""
    import time

    wait = first_wait
    for n in range(attempts):
        try:
            return call()
        except Exception as e:
            if n == attempts - 1 or fatal(e):
                raise
            (sleep or time.sleep)(min(wait, longest_wait))
            wait *= 2


def action_log(rows: DataFrame, folder: str) -> None:
    rows.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(folder)


def unbounded_calls(source: str) -> Iterable[tuple[int, str]]:
    """(line, call) of blocking calls without a timeout in Python source; source that can't be parsed has none."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
            root = node.func.value
            while isinstance(root, ast.Attribute):
                root = root.value
            name = root.id if isinstance(root, ast.Name) else ""
            if node.func.attr in TIMED_CALLS.get(name, ()) and not any(k.arg == "timeout" for k in node.keywords):
                out.append((node.lineno, "urllib.request.urlopen" if name == "urllib" else f"{name}.{node.func.attr}"))
    return sorted(out)


def lint(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (path, line, call) of unbounded calls in all Python files of a folder."""
    from scoreframe.sources.score_files import files

    f = files(spark, folder, "*.py").select("path", F.col("content"))

    @F.pandas_udf("array<struct<line: int, call: string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda c: [{"line": n, "call": k} for n, k in unbounded_calls(bytes(c).decode("utf-8", "replace"))])

    return f.select("path", F.explode(run("content")).alias("f")).select("path", "f.line", "f.call")
