"""Ground truth over measures: overlays, comparison and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlay(current: DataFrame, truth: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """current with the columns of truth where it lists the row and the value isn't null (an empty array is a value); corrected says where."""
    t = truth.select(*by, *[F.col(c).alias(f"_t_{c}") for c in columns], F.lit(True).alias("_listed"))
    out = current.join(t, by, "left")
    return out.select(*[F.coalesce(f"_t_{c}", c).alias(c) if c in columns else F.col(c) for c in current.columns], F.coalesce("_listed", F.lit(False)).alias("corrected"))


def key_of_chord(chord: Column) -> Column:
    """For comparison with truth: no spaces, lower case; a leading flat stays as it is."""
    return F.lower(F.replace(F.trim(chord), F.lit(" "), F.lit("")))


def key_of_lyric(text: Column) -> Column:
    return F.lower(F.trim(text))


def compare(truth: DataFrame, actual: DataFrame, by: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows of truth with, for each name in pairs (truth column, actual column), name_match: equal lists in order, or null where
    truth says nothing; a row that actual doesn't have counts as empty lists."""
    a = actual.select(*by, *[F.col(c).alias(f"_a_{c}") for _, c in pairs.values()])
    out = truth.join(a, by, "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    return out.select(*truth.columns, *[F.when(F.col(t).isNotNull(), F.col(t) == empty(f"_a_{c}")).alias(f"{name}_match") for name, (t, c) in pairs.items()])


def score(compared: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Rows (by, name_ok, name_total, all_match)."""
    every = F.lit(True)
    for n in names:
        every = every & F.coalesce(F.col(f"{n}_match"), F.lit(True))
    return compared.groupBy(*by).agg(
        *[F.count_if(f"{n}_match").alias(f"{n}_ok") for n in names], *[F.count(f"{n}_match").alias(f"{n}_total") for n in names], F.bool_and(every).alias("all_match")
    )


def flatten_guard(has_truth: Column, score_fifths: Column, truth_fifths: Column) -> Column:
    """Why a song's chords stay untouched: no_gt, no_score_key, key_mismatch; null if they may be flattened."""
    return F.when(~has_truth, "no_gt").when(score_fifths.isNull(), "no_score_key").when(~F.coalesce(score_fifths == truth_fifths, F.lit(False)), "key_mismatch")


def chromatic_letters(notes: Column) -> Column:
    """Letters that a song uses chromatically: single letters, and those with a sharp; flats are none."""
    ok = F.filter(notes, lambda n: (F.length(n) == 1) | n.rlike("^[A-G][^b-]"))
    return F.transform(ok, lambda n: F.substring(n, 1, 1))


def flatten_action(letter: Column, accidental: Column, expected: Column, chromatic: Column) -> Column:
    """flattened or chromatic_skipped; null for roots that the key doesn't flatten or that are spelled out."""
    return F.when(F.array_contains(expected, letter), F.when(F.array_contains(chromatic, letter), "chromatic_skipped").when(accidental.isNull(), "flattened"))


def is_phantom(text: Column) -> Column:
    """Whether a mark is a question mark, the sign of a recovered note; a null mark isn't."""
    return F.coalesce(F.trim(text) == "?", F.lit(False))
