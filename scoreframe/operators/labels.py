"""Label sets: renames, counts, filters of the labelling page, imports and guesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rename(df: DataFrame, label: str, mapping: DataFrame) -> DataFrame:
    """df with labels renamed by mapping (old, new): a null new drops the row, a label without entry stays."""
    m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"), F.lit(True).alias("_there"))
    out = df.join(m, F.col(label) == F.col("_old"), "left").where("_there is null or _new is not null")
    return out.withColumn(label, F.coalesce("_new", label)).drop("_old", "_new", "_there")


def class_counts(df: DataFrame, label: str, least: int = 1) -> DataFrame:
    """Rows (label, n) of the classes with least rows or more."""
    return df.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def frequent_classes(df: DataFrame, label: str, least: int) -> DataFrame:
    """The rows of classes with least rows or more."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(label))).where(F.col("_n") >= least).drop("_n")


def _confidence(conf: Column) -> Column:
    return F.coalesce(conf.try_cast("double"), F.lit(0.0))


def low_confidence(conf: Column, below: float = 0.7) -> Column:
    """Whether a confidence, as text, is below; missing counts as 0."""
    return _confidence(conf) < below


def unlabelled(label: Column) -> Column:
    return F.coalesce(label, F.lit("")) == ""


def altered(guess: Column) -> Column:
    """Whether a guess has a sharp, an augmentation or a diminution."""
    return F.coalesce(guess.rlike("[#+]|dim|aug"), F.lit(False))


def accept(label: Column, guess: Column, conf: Column, least: float = 0.0) -> Column:
    """The label, or where it is empty a guess that isn't empty and has the confidence."""
    return F.when(unlabelled(label) & ~unlabelled(guess) & (_confidence(conf) >= least), guess).otherwise(label)


def import_labels(rows: DataFrame, files: DataFrame, label: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(labelled rows whose file is there, labelled rows whose file is missing)."""
    full = rows.where(~unlabelled(F.col(label)))
    have = files.select(F.col(name)).distinct()
    return full.join(have, name, "left_semi"), full.join(have, name, "left_anti")


def best_guess(guesses: DataFrame, by: list[str], conf: str, order: str) -> DataFrame:
    """The row of the highest confidence of each group, the first of equals."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(conf), order)
    return guesses.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def needs_label(value: Column) -> Column:
    """Context of a glyph that has to be labelled: unread, sharp, or null if it needs none."""
    return F.when(F.coalesce(value, F.lit("")) == "", "unread").when(value.contains("#"), "sharp")


def confident(conf: Column, text: Column) -> Column:
    """The two-tier gate: 0.8 for texts of up to two characters, else 0.6."""
    return conf >= F.when(F.length(text) <= 2, 0.8).otherwise(0.6)


def ink_ok(share: Column, least: float = 0.015, most: float = 0.30) -> Column:
    return share.between(least, most)


def drop_margin_letters(df: DataFrame, song: str, value: str, x: str, confirmed: Column, margin: float = 280.0) -> DataFrame:
    """Without single letters A-G left of the margin, in songs that have no confirmed chord."""
    has = F.max(confirmed.cast("int")).over(Window.partitionBy(song))
    lone = (F.coalesce(F.col("_has"), F.lit(0)) == 0) & F.col(value).rlike("^[A-G]$") & (F.col(x) < margin)
    return df.withColumn("_has", has).where(~F.coalesce(lone, F.lit(False))).drop("_has")
