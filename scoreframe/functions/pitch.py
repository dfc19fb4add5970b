"""Pitches as letters on the line of fifths, so that flats stay flats when a note moves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters by rising fifths, F first, and by rising pitch with their semitones above C.
FIFTHS, LETTERS, SEMITONES = "FCGDAEB", "CDEFGAB", (0, 2, 4, 5, 7, 9, 11)


def _letter(place: Column) -> Column:
    """The letter at a place of the line of fifths, on which C is 0."""
    return F.substring(F.lit(FIFTHS), (F.pmod(place + 1, F.lit(7)) + 1).cast("int"), F.lit(1))


def _alter(place: Column) -> Column:
    return F.floor((place + 1) / 7).cast("int")


def _semitone(letter: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEMITONES)), F.instr(F.lit(LETTERS), letter))


def _spelled(step: Column, alter: Column, octave: Column) -> Column:
    return F.struct(step.alias("step"), alter.alias("alter"), octave.cast("int").alias("octave"))


def midi(step: Column, alter: Column, octave: Column) -> Column:
    """MIDI number; null unless step is a letter."""
    return F.when(F.instr(F.lit(LETTERS), step) > 0, 12 * (octave + 1) + _semitone(step) + F.coalesce(alter, F.lit(0))).cast("int")


def transposed(step: Column, alter: Column, octave: Column, semitones: Column) -> Column:
    """struct(step, alter, octave) a number of semitones higher, or lower if negative, by the usual interval of that size (a tritone is an augmented fourth).

    An interval is a number of fifths and of letters; both add, so the way back gives the note from before.
    """
    size, sign = F.abs(semitones), F.when(semitones < 0, -1).otherwise(1)
    fifths = F.pmod(7 * size + 5, F.lit(12)) - 5
    letters = ((7 * size - fifths) / 12).cast("int") * sign
    place = F.instr(F.lit(FIFTHS), step) - 2 + 7 * F.coalesce(alter, F.lit(0)) + fifths * sign
    line = 7 * octave + F.instr(F.lit(LETTERS), step) - 1 + letters
    return F.when(F.instr(F.lit(LETTERS), step) > 0, _spelled(_letter(place), _alter(place), F.floor(line / 7)))


def spelled(number: Column, key: Column) -> Column:
    """struct(step, alter, octave) of a MIDI number in a key (its fifths; null counts as none): of its names that nearest to the key's on the line of fifths, five below to six above."""
    lowest = F.coalesce(key, F.lit(0)) - 5
    place = F.pmod(7 * number - lowest, F.lit(12)) + lowest
    natural = number - _alter(place) - _semitone(_letter(place))
    return _spelled(_letter(place), _alter(place), natural / 12 - 1)
