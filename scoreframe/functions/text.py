"""Small scalar functions: names, keys, numbers on the musical grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILE_NAME_PARTS = (("/", "_slash_"), ("#", "sharp"), ("+", "aug"), (" ", ""), (":", ""))
FILE_NAME_PARTS_SYNTHETIC = (*FILE_NAME_PARTS, ("(", "_"), (")", "_"))
LABEL_PARTS = (("_slash_", "/"), ("sharp", "#"), ("aug", "+"))


def _replaced(text: Column, parts) -> Column:
    for a, b in parts:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def safe_filename(text: Column, synthetic: bool = False) -> Column:
    """A label as a file name; not reversible where the label has spaces or colons."""
    return _replaced(text, FILE_NAME_PARTS_SYNTHETIC if synthetic else FILE_NAME_PARTS)


def label_of_filename(text: Column) -> Column:
    return _replaced(text, LABEL_PARTS)


def slug(text: Column) -> Column:
    """Lower-case letters and digits with single underscores between."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def short_id(text: Column) -> Column:
    """First 12 hexadecimal digits of the SHA-1."""
    return F.substring(F.sha1(text.cast("binary")), 1, 12)


def content_id(data: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(data.cast("binary"), 256), 1, 16)


def shorten(text: Column, n: int = 40) -> Column:
    """Cut to n characters with an ellipsis."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def snap(fraction: Column, length: Column, steps: int = 4) -> Column:
    """Nearest 1/steps of a unit to fraction * length; halves go to the even step."""
    return F.bround(fraction * length * steps, 0) / F.lit(float(steps))


def padding(size: Column, share: float, least: int) -> Column:
    return F.greatest(F.lit(least), (size * share).cast("int"))


def naked_percent(naked: Column, notes: Column) -> Column:
    return F.when(notes == 0, 0.0).otherwise(100.0 * naked / notes)


def split_bucket(key: Column, buckets: int = 1000) -> Column:
    """A bucket from the key's SHA-1, the same in every engine; for splits that can be repeated."""
    return F.pmod(F.conv(F.substring(F.sha1(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def position_pitch(position: Column) -> tuple[Column, Column]:
    """(step, octave) of a staff position in the treble clef, 0 being the middle line; negative positions floor."""
    n = position + 34
    return F.element_at(F.array(*map(F.lit, "CDEFGAB")), (F.pmod(n, F.lit(7)) + 1).cast("int")), F.floor(n / 7).cast("int")


def shape_length(shape: Column) -> Column:
    """Quarter lengths of note-head shapes, 1 for others."""
    return F.when(shape == "WHOLE_NOTE", 4.0).when(shape == "NOTEHEAD_VOID", 2.0).when(shape == "BREVE", 8.0).otherwise(1.0)
