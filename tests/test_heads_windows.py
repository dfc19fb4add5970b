"""Heads against the rules spelled out on plain lists, and how often the tables move."""

import random

from scoreframe.operators import heads
from scoreframe.plans import registry


def test_against_lists(spark):
    random.seed(3)
    some = lambda *xs: random.choice(xs)
    found = [(some("a", "b"), some(1, 2), some(0, 1, 2, None), f"h{k % 390}", some(True, False, False), some(1, 2, 3, None), some(0.0, 0.1, 0.5, None), some(-1, 0), some("NOTEHEAD_BLACK", "OTHER")) for k in range(400)]
    vocal = [("a", 1, 0), ("a", 1, 0), ("a", 2, 1), ("b", 1, 1), ("b", 2, 0), ("b", 1, None)]
    measures = [("a", 1, 4.0), ("a", 2, 0.0), ("b", 1, 3.0), ("b", 3, None)]
    h = spark.createDataFrame(found, "song string, sheet int, staff int, id string, linked boolean, measure_global int, frac double, pitch_position int, shape string")
    midi = {r["pitch_position"]: r["midi"] for r in h.select("pitch_position", heads.midi_of_position(h["pitch_position"], True).alias("midi")).distinct().collect()}
    notes = [(s, m, o, midi[p]) for s in "ab" for m, o, p in ((1, 0.24, 0), (1, 0.25, -1), (2, 1.75, 0), (2, 2.25, -1), (3, 0.1, 0), (None, 0.0, 0))] + [("a", 1, 0.5, None), ("a", 2, None, midi[0])]
    got = heads.insert_heads(
        h, spark.createDataFrame(vocal, "song string, sheet int, staff int"), spark.createDataFrame(measures, "song string, number int, ql double"), spark.createDataFrame(notes, "song string, measure int, offset double, midi int")
    )
    assert got.columns == [*h.columns, "measure", "offset", "midi", "ql", "action"]
    length, want, open_ = {m[:2]: m[2] for m in measures}, [], {}
    for song, sheet, staff, name, linked, m, frac, position, shape in found:
        offset = round((frac or 0.0) * (length.get((song, m)) or 4.0) * 4) / 4
        near = any(n[0] == song and n[1] == m and n[3] == midi[position] and n[2] is not None and abs(n[2] - offset) < 0.25 for n in notes)
        reason = "not_vocal" if (song, sheet, staff) not in vocal or staff is None else "linked" if linked else "no_measure" if (song, m) not in length else "duplicate" if near else None
        row = [song, sheet, name, m, offset, midi[position], "skipped_" + reason if reason else None]
        want.append(row)
        if not reason:
            open_.setdefault((song, m, offset, position), []).append(row)
    for rows in open_.values():
        for k, row in enumerate(sorted(rows, key=lambda r: r[1:3])):
            row[-1] = "skipped_duplicate" if k else "inserted"
    assert sorted(map(repr, want)) == sorted(repr([r[c] for c in ("song", "sheet", "id", "measure", "offset", "midi", "action")]) for r in got.collect())
    assert {r[-1] for r in want} == {"inserted", *("skipped_" + x for x in ("not_vocal", "linked", "no_measure", "duplicate"))}


def test_lines_move_twice_at_most(spark):
    """Once to their order, once to their song: with small tables broadcast, once in all."""
    frame = registry.queries()["head_insertion"](spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("relation [l_orderkey") == 1
    physical = frame._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning(song") == 1
