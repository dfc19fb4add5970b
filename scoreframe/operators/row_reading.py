"""Reading chord rows: several passes over one strip, in order of precedence, each row with its source.

Tokens of all recognition passes are cleaned and thinned; a recogniser reads each again and may replace it; it then sweeps the stretches that
no token covers, where each acceptance covers its own surroundings; marks that stand where chords stand are read too. A recogniser is a function
from crops (the group's columns, x0, w, and for marks y0, h) to the same rows with chord and conf, so that reading may be a join, an
expression or a model call, and its rows stay distributed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.functions.chords import ROW_CHORD, fix_root_case, is_chord_token
from scoreframe.operators.coverage import near_anti, proximity_dedup
from scoreframe.operators.heads import ink_sweep
from scoreframe.operators.labels import drop_margin_letters, ink_ok
from scoreframe.operators.locate import locate, nearest_below
from scoreframe.operators.streams import BLOB, SWEEP, above_floor, sweep_edges, tier

Reader = Callable[[DataFrame], DataFrame]

# Half a crop's width; a sweep's window, step and reach; the crops (width, height, left and top of the centre) tried on a mark; the band of marks above a line.
HALF_CROP = 40
SWEEP_WIDTH, SWEEP_STEP, SWEEP_REACH = 60, 30, 35.0
MARK_CROPS = ((40, 40, 20, 20), (50, 45, 20, 22), (70, 50, 20, 25), (90, 55, 25, 27))
MARK_BAND = (20.0, 120.0)


def is_row_chord(text: Column) -> Column:
    return F.coalesce(text.rlike(ROW_CHORD), F.lit(False))


def pass_tokens(passes: DataFrame, by: list[str], allow_bare: Column) -> DataFrame:
    """Rows (by, x, token) of recognised words (edge of their window or 0, left, width, conf, text): root letters raised, shaped as chords, at the confidence floor or over it; x is a word's centre."""
    text = fix_root_case(F.trim("text"), allow_bare)
    x = F.coalesce("edge", F.lit(0)) + F.col("left") + F.floor(F.col("width") / 2)
    return passes.select(*by, x.cast("double").alias("x"), text.alias("token"), "conf").where(is_row_chord(F.col("token")) & above_floor(F.col("conf"))).drop("conf")


def refine(tokens: DataFrame, strips: DataFrame, by: list[str], read: Reader) -> DataFrame:
    """Rows (by, x, token, source): what the recogniser reads around a token replaces it if sure enough (source refined); else the token stays (source token)."""
    x0 = F.greatest(F.lit(0.0), F.col("x") - HALF_CROP)
    crops = tokens.join(strips.select(*by, "strip_width"), by).withColumn("x0", x0).withColumn("w", F.least(F.col("strip_width") - F.col("x0"), F.lit(2.0 * HALF_CROP))).drop("strip_width")
    sure = F.coalesce(tier(F.col("conf"), F.col("chord")), F.lit(False))
    return read(crops).select(*by, "x", F.when(sure, F.col("chord")).otherwise(F.col("token")).alias("token"), F.when(sure, "refined").otherwise("token").alias("source"))


def sweep_windows(strips: DataFrame, tokens: DataFrame, by: list[str]) -> DataFrame:
    """Windows (by, x0, w, x) of strips that lie at reach or further from all tokens; the last of a strip are cut short."""
    edges = strips.select(*by, "strip_width", F.explode(sweep_edges(F.col("strip_width").cast("int"), SWEEP_STEP)).alias("x0"))
    w = F.least(F.lit(SWEEP_WIDTH), F.col("strip_width").cast("int") - F.col("x0"))
    return near_anti(edges.select(*by, F.col("x0").cast("double").alias("x0"), w.cast("double").alias("w"), (F.col("x0") + F.floor(w / 2)).cast("double").alias("x")), tokens, by, "x", SWEEP_REACH)


def _sweep_sure(chord: Column, conf: Column) -> Column:
    return is_row_chord(chord) & F.coalesce(tier(conf, chord, SWEEP), F.lit(False))


def sweep(windows: DataFrame, by: list[str], read: Reader) -> DataFrame:
    """Rows (by, x, token, source sweep): windows read as a chord with high confidence, in order of x, that lie at reach or further from the last accepted.

    A window that isn't accepted covers nothing, so which windows the rule skips follows from the distances between those that would be accepted. All
    windows are read; sweep_lazily reads those alone that the rule doesn't skip.
    """
    sure = read(windows).where(_sweep_sure(F.col("chord"), F.col("conf"))).select(*by, "x", "chord")
    return ink_sweep(sure, by, "x", SWEEP_REACH).join(sure, [*by, "x"]).select(*by, "x", F.col("chord").alias("token"), F.lit("sweep").alias("source"))


def sweep_lazily(windows: DataFrame, by: list[str], content: str, model: Callable[[list[bytes]], list[tuple[str, float]]], strips_at_once: int = 64) -> DataFrame:
    """The rows of sweep, with one call for each window that the rule doesn't skip, and none for others.

    A strip's windows are its unit of work. A task takes several strips in step: the next open window of each goes into one call of the model. The
    gates are those of sweep.
    """
    import re

    from scoreframe.operators.streams import SWEEP as needed

    shape = re.compile(ROW_CHORD)
    strips = windows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("x", F.col(content).alias("c")))).alias("_windows"))
    keys = ", ".join(f"{n} {t}" for n, t in strips.dtypes[:-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), strips_at_once):
                part = batch.iloc[start : start + strips_at_once]
                left = [list(w) for w in part["_windows"]]
                out, last = [], [float("-inf")] * len(left)
                while True:
                    turn = []
                    for i, w in enumerate(left):
                        while w and w[0]["x"] - last[i] < SWEEP_REACH:
                            w.pop(0)
                        if w:
                            turn.append((i, w.pop(0)))
                    if not turn:
                        break
                    for (i, w), (chord, conf) in zip(turn, model([bytes(w["c"]) for _, w in turn]), strict=True):
                        if chord and shape.match(chord) and conf >= needed[len(chord) > 2]:
                            last[i] = w["x"]
                            out.append((*part.iloc[i][by], w["x"], chord, "sweep"))
                yield pd.DataFrame(out, columns=[*by, "x", "token", "source"])

    return strips.mapInPandas(run, f"{keys}, x double, token string, source string")


def read_marks(marks: DataFrame, lines: DataFrame, by: list[str], read: Reader) -> DataFrame:
    """Rows (by, id, line, x, token, source mark): marks (by, id, x, y, w, h) in the band above the nearest line (by, line, y) below, whose best reading of several crops is a chord; of equal confidences the first counts."""
    near = nearest_below(marks, lines.withColumnRenamed("line", "_line_id"), by, "y", "y", "_line_id", *MARK_BAND)
    cx, cy = F.col("x") + F.coalesce("w", F.lit(28.0)) / 2, F.col("y") + F.coalesce("h", F.lit(24.0)) / 2
    crop = lambda i, c: F.struct(F.lit(i).alias("crop"), F.lit(float(c[0])).alias("cw"), F.lit(float(c[1])).alias("ch"), F.greatest(F.lit(0.0), F.floor(cx - c[2])).alias("x0"), F.greatest(F.lit(0.0), F.floor(cy - c[3])).alias("y0"))
    crops = near.select(*by, "id", "line", "x", F.explode(F.array(*(crop(i, c) for i, c in enumerate(MARK_CROPS)))).alias("_c")).select(*by, "id", "line", "x", "_c.*").withColumnsRenamed({"cw": "w", "ch": "h"})
    read_ = read(crops).where(is_row_chord(F.col("chord")) & (F.col("conf") > 0))
    best = read_.groupBy(*by, "id", "line", "x").agg(F.max_by(F.struct("chord", "conf"), F.struct("conf", (-F.col("crop")).alias("i"))).alias("_b"))
    return best.where(tier(F.col("_b.conf"), F.col("_b.chord"), BLOB)).select(*by, "id", "line", "x", F.col("_b.chord").alias("token"), F.lit("mark").alias("source"))


def read_rows(
    passes: DataFrame, strips: DataFrame, bars: DataFrame, confirmed: DataFrame, by: list[str], song: str, read: Reader,
    ink: Callable[[DataFrame], DataFrame] | None = None, marks: tuple[DataFrame, DataFrame] | None = None, number: str = "number", bar_x: str = "bx", swept: bool = True,
) -> DataFrame:
    """Rows (by, x, value, source, measure, frac): the chords of all passes over the strips, placed in measures.

    strips (by, strip_width); bars (by, bar_x, number); confirmed (song) lists songs that have a chord read by other means: there single small letters
    may be roots, and single letters in the margin may be chords. Each stage sees what those before left: tokens, their second reading, the sweep of what
    they don't cover, marks. ink adds a share of dark pixels to windows, and only those within bounds are read.
    """
    sure = confirmed.select(song).distinct().withColumn("_sure", F.lit(True))
    words = passes.join(sure, song, "left")
    tokens = proximity_dedup(pass_tokens(words, by, F.coalesce("_sure", F.lit(False))), by, "x", "token")
    found = refine(tokens, strips, by, read)
    if swept:
        open_ = sweep_windows(strips, found, by)
        found = found.unionByName(sweep(ink(open_).where(ink_ok(F.col("ink"))).drop("ink") if ink else open_, by, read))
    if marks:
        found = found.unionByName(read_marks(*marks, by, read).select(*by, "x", "token", "source"))
    placed = locate(found, bars, by, "x", bar_x, number).join(sure, song, "left")
    kept = drop_margin_letters(placed, song, "token", "x", F.coalesce("_sure", F.lit(False))).where(is_chord_token(F.col("token")))
    return kept.select(*by, "x", F.col("token").alias("value"), "source", "measure", "frac")
