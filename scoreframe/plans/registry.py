"""All score queries and their SQL."""

from __future__ import annotations

from scoreframe.plans import alignments, chord_labels, lyric_songs, lyric_text, measures, note_heads, pitches, positions, row_readings, songs

_ALL = alignments.QUERIES | positions.QUERIES | chord_labels.QUERIES | lyric_text.QUERIES | measures.QUERIES | songs.QUERIES | row_readings.QUERIES | pitches.QUERIES | note_heads.QUERIES | lyric_songs.QUERIES


def queries() -> dict:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
