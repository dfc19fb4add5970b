"""Command line: `python -m scoreframe.cli COMMAND …`, for spark-submit too. Each command reads and writes tables or reports."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scoreframe.operators import flags, labels
from scoreframe.plans import recovery, reducer
from scoreframe.sources import archives, score_files, sinks


def _score_tables(spark: SparkSession, folder: str, pattern: str):
    s = score_files.files(spark, folder, pattern)
    return {n: score_files.score_table(s, n) for n in ("note", "measure", "lyric", "harmony")}


def process(spark: SparkSession, a) -> None:
    """Reduce all scores of a folder, and list the chords that the projects show but the lead sheets lack."""
    t = _score_tables(spark, a.input, a.only)
    sheet = reducer.reduce_scores(t["note"], t["measure"], t["lyric"], t["harmony"], style=a.style)
    for name in ("measures", "notes", "harmonies", "sections", "keys"):
        getattr(sheet, name).write.mode("overwrite").parquet(f"{a.output}/{name}")
    words = t["lyric"].join(reducer.vocal_part(t["note"], t["lyric"], t["harmony"]), ["song", "part"], "left_semi")
    written = {name: spark.read.parquet(f"{a.output}/{name}") for name in ("measures", "notes", "harmonies")}
    sinks.write_per_song(sinks.musicxml(written["measures"], written["notes"], written["harmonies"], words), f"{a.output}/lead_sheets")
    projects = score_files.files(spark, a.input, "*.omr")
    exported = written["harmonies"].select("song", "measure", "figure")
    recovery.missing_chords(score_files.glyphs(projects), score_files.barlines(projects), score_files.sheet_sizes(projects), exported).write.mode("overwrite").parquet(f"{a.output}/missing")


def review(spark: SparkSession, a) -> None:
    """Flag suspicious measures of all scores; a table of each song's flags and a summary."""
    t = _score_tables(spark, a.input, a.only)
    vocal = reducer.vocal_part(t["note"], t["lyric"], t["harmony"])
    m = t["measure"].join(vocal, ["song", "part"], "left_semi").select("song", "number", "ql")
    count = lambda df, name: df.groupBy("song", F.col("measure").alias("number")).agg(F.count("*").alias(name))
    notes = t["note"].join(vocal, ["song", "part"], "left_semi").where("kind <> 'rest'")
    m = m.join(count(notes, "notes"), ["song", "number"], "left").join(count(t["harmony"], "chords"), ["song", "number"], "left").join(count(t["lyric"], "lyrics"), ["song", "number"], "left").na.fill(0)
    found = flags.suspicious(m, ["song"], "number", "notes", "chords", "lyrics", "ql").withColumn("detail", F.lit(None).cast("string"))
    sinks.write_per_song(sinks.flags_markdown(found), f"{a.output}/flags")
    reasons = ["all_rests_with_chords", "duration_mismatch", "missing_lyrics"]
    sinks.summary_markdown(flags.flag_table(found, "song", "reason", reasons), "song", reasons).coalesce(1).write.mode("overwrite").text(f"{a.output}/summary")


def inspect(spark: SparkSession, a) -> None:
    """Counts of every part, and of what spans notes."""
    parts, spanners = score_files.inspection(score_files.files(spark, a.input, a.only))
    parts.orderBy("song", "part").show(1000, False)
    spanners.orderBy("song", "kind").show(1000, False)


def status(spark: SparkSession, a) -> None:
    """What of each recognition project can be read, and how many projects there are of each outcome."""
    found = archives.outcomes(archives.sheets(spark, a.input, a.only))
    found.orderBy("song").show(1000, False)
    found.groupBy("status").count().orderBy("status").show()


def starter(spark: SparkSession, a) -> None:
    """A truth file for every score, with its chords and first verse as they stand, to be corrected; refuses to write over one."""
    t = _score_tables(spark, a.input, a.only)
    by = ["song", "measure"]
    listed = lambda df, order, value, name: df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("v")))), lambda i: i["v"]).alias(name))
    chords = listed(t["harmony"], ["part", "seq"], "figure", "chords")
    sung = listed(t["lyric"].where("verse = 1"), ["part", "note_seq", "pos"], "text", "lyrics_v1")
    sinks.write_new(sinks.truth_starter(chords.join(sung, by, "full")), a.output)


def dataset(spark: SparkSession, a) -> None:
    """Label verbs over a CSV: clean (rename by --map), count, accept guesses."""
    rows = score_files.labels_csv(spark, a.input)
    if a.verb == "clean":
        mapping = spark.read.text(a.map, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("old", "new"))
        sinks.write_labels(labels.rename(rows, "correct_label", mapping), a.output)
    elif a.verb == "accept":
        sinks.write_labels(rows.withColumn("correct_label", labels.accept(F.col("correct_label"), F.col("classifier_guess"), F.col("classifier_conf"), a.least)), a.output)
    else:
        labels.class_counts(rows.where(~labels.unlabelled(F.col("correct_label"))), "correct_label").orderBy(F.desc("n"), "correct_label").show(1000, False)


def lint(spark: SparkSession, a) -> None:
    """Blocking calls without a timeout."""
    sinks.lint(spark, a.input).orderBy("path", "line").show(1000, False)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scoreframe", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, run in (("process", process), ("review", review), ("inspect", inspect), ("status", status), ("starter", starter), ("dataset", dataset), ("lint", lint)):
        c = sub.add_parser(name, help=run.__doc__)
        c.set_defaults(run=run)
        if name == "dataset":
            c.add_argument("verb", choices=("clean", "accept", "count"))
            c.add_argument("--map")
            c.add_argument("--least", type=float, default=0.85)
        c.add_argument("input")
        if name in ("process", "review", "dataset", "starter"):
            c.add_argument("output", nargs="?" if name == "dataset" else None)
        if name in ("process", "review", "inspect", "starter"):
            c.add_argument("--only", default="*.{mxl,musicxml}")
        if name == "status":
            c.add_argument("--only", default="*.omr")
        if name == "process":
            c.add_argument("--style", choices=("symbolic", "textual"), default="symbolic")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("scoreframe").getOrCreate()
    a.run(spark, a)


if __name__ == "__main__":
    main()
