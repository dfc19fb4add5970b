"""Notes after the overlay by windows against apply_truth's, and how often the tables move."""

import random

import pytest

from scoreframe.operators import truth
from scoreframe.plans import registry


@pytest.mark.parametrize("seed", [1, 2])
def test_against_joins(spark, seed):
    random.seed(seed)
    measures, notes, lyrics, told, merges, seq = [], [], [], [], [], {}
    for song in range(12):
        groups = random.choice([{}, {}, {1: 1, 2: 1}, {2: 1, 3: 1, 4: 1, 5: 2, 6: 2}, {3: 7}])
        merges += [(song, g, m) for m, g in groups.items()]
        for m in range(1, random.randint(6, 9)):
            measures.append((song, m, random.choice([4.0, 3.0, 0.0])))
            if random.random() < 0.7:
                told.append((song, m, random.choice([None, [], ["a"], list("abcdefgh")]), random.choice([None, 67, 71])))
            for k in range(0 if m < random.choice([1, 4]) else random.randint(0, 5)):
                seq[song] = n = seq.get(song, 0) + 1
                kind = random.choice(["note", "rest", "rest"])
                notes.append((song, m, n, 0, kind, float(random.choice([k, 1])), random.choice([0.0, 0.5, 1.0]), [40 + n] if kind == "note" else []))
                if kind == "note" and random.random() < 0.6:
                    lyrics.append((song, n, 0, 1, "w"))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    schema = "song int, measure int, seq int, sub int, kind string, start double, ql double, pitches array<int>"
    t = frame([(s, m, None, w, p) for s, m, w, p in told], "song int, measure int, chords array<string>, lyrics_v1 array<string>, inject_pitch int")
    song = truth.Song(frame(measures, "song int, measure int, ql double"), frame([], "song int, measure int, offset double, figure string"), frame(notes, schema), frame(lyrics, "song int, seq int, sub int, verse int, text string"), frame([], "song int, measure int, text string"))
    got, stats = truth.apply_truth(song, t, frame(merges, "song int, grp int, measure int"))
    want = got.notes.join(got.lyrics.where("verse = 1").select("song", "seq", "sub", "text"), ["song", "seq", "sub"], "left").selectExpr("song", "measure", "seq", "sub", "kind", "start", "ql", "get(pitches, 0) as pitch", "text")
    group, said, word = {(s, m): g for s, g, m in merges}, {r[:2]: r[2:] for r in told}, {r[:2]: r[4] for r in lyrics}
    m = truth.merge_places(frame([(*r, group.get(r[:2]), *said.get(r[:2], (None, None))) for r in measures], "song int, measure int, ql double, grp int, lyrics_v1 array<string>, inject_pitch int"))
    n = frame([("note", *r[:7], r[7][0] if r[7] else None, word.get((r[0], r[2]))) for r in notes], "what string, song int, measure int, seq int, sub int, kind string, start double, ql double, pitch int, text string")
    rows = n.unionByName(m.drop("ql", "grp").selectExpr("'measure' as what", "*"), allowMissingColumns=True)
    out = sorted(map(repr, map(tuple, truth.overlay_notes(rows).collect())))
    assert out == sorted(map(repr, map(tuple, want.collect())))
    assert sum(r["notes_injected"] for r in stats.collect()) > 5 and stats.groupBy().sum("measures_merged").first()[0] >= 1


def test_lines_move_twice_at_most(spark):
    """Once to their order, once to their song, and nothing is written."""
    frame = registry.queries()["truth_notes"](spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("relation [l_orderkey") == 1 and "logicalrdd" not in plan
    assert frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4  # lines to orders, songs of orders twice, songs of all rows
