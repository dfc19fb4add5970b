"""The alignment kernel against a plain table, cell by cell, and SequenceMatcher pair by pair."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scoreframe.operators import align


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def pitch(a, b):
    if a[:2] != b[:2]:
        return 1.0
    return {0: 0.0, 1: 0.3}.get(abs(a[2] - b[2]), 1.0)


def measure(a, b):
    if a[0] == b[0] == 0:
        return 0.0
    near = lambda x, y: abs(x - y) / max(x, y, 1)
    first = max(0.0, 1 - abs(a[2] - b[2]) / 7.0) if min(a[2], b[2]) >= 0 else 0.5
    return 1 - (0.40 * ratio(a[3], b[3]) + 0.25 * (1 - near(a[0], b[0])) + 0.20 * max(0.0, 1 - near(a[1], b[1])) + 0.15 * first)


COSTS = {"tokens": (lambda a, b: 1 - ratio(a.lower(), b.lower()), 0.6, 0.0), "pitches": (pitch, 0.5, 0.0), "measures": (measure, 1.2, 1e-9)}


def plain(left, right, kind):
    cost, gap, eps = COSTS[kind]
    n, m = len(left), len(right)
    sums = [[0.0] * (m + 1) for _ in range(n + 1)]
    for j in range(1, m + 1):
        sums[0][j] = sums[0][j - 1] + gap
    for i in range(1, n + 1):
        sums[i][0] = sums[i - 1][0] + gap
        for j in range(1, m + 1):
            sums[i][j] = min(sums[i - 1][j - 1] + cost(left[i - 1], right[j - 1]), sums[i - 1][j] + gap, sums[i][j - 1] + gap)
    equal = lambda a, b: a == b or abs(a - b) < eps
    out, i, j = [], n, m
    while i or j:
        if i and j and equal(sums[i][j], sums[i - 1][j - 1] + cost(left[i - 1], right[j - 1])):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and equal(sums[i][j], sums[i - 1][j] + gap):
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1], sums[n][m]


ITEMS = {
    "tokens": ["fall", "fal", "Wall", "lov", "love", "lo", "ing", "Ing", "x", ""],
    "pitches": [(s, a, o) for s in "AB" for a in (0, 1) for o in (3, 4, 5, 6)],
    "measures": [(n, d, p, s) for n in range(3) for d in (0, 1.5, 4) for p in (-1, 60, 66) for s in ("q q", "h", "r", "q e")],
}


@settings(max_examples=80, deadline=None)
@given(st.data(), st.sampled_from(sorted(ITEMS)))
def test_align(data, kind):
    left, right = (data.draw(st.lists(st.sampled_from(ITEMS[kind]), max_size=12)) for _ in range(2))
    assert align.align(left, right, kind) == plain(left, right, kind)


@pytest.mark.parametrize("kind", sorted(ITEMS))
def test_long_sequences_in_small_memory(monkeypatch, kind):
    """Blocks of a few rows, kept rows of a few sums and tables of a few pairs give the same alignments."""
    for name, value in (("CELLS", 64), ("KEPT", 40), ("DISTINCT", 16), ("TABLE", 20)):
        monkeypatch.setattr(align, name, value)
    rng = random.Random(3)
    for n, m in ((0, 0), (0, 9), (9, 0), (1, 70), (70, 1), (40, 55), (90, 30), (64, 64), (3, 200)):
        left, right = ([rng.choice(ITEMS[kind]) for _ in range(k)] for k in (n, m))
        assert align.align(left, right, kind) == plain(left, right, kind)


def test_many_sequences_at_once():
    rng = random.Random(4)
    items = ITEMS["tokens"]
    pairs = [tuple(np.array([rng.randrange(len(items)) for _ in range(rng.randrange(25))], np.int64) for _ in range(2)) for _ in range(300)]
    for (a, b), (entries, each, total) in zip(pairs, align.align_many(items, pairs, align.token_costs, 0.6), strict=True):
        want, cost = plain([items[i] for i in a], [items[j] for j in b], "tokens")
        assert [(i if i >= 0 else None, j if j >= 0 else None) for i, j in entries.tolist()] == want and total == cost and sum(each) == pytest.approx(total)


def test_ratios():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdé😀") for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13, 60, 230]))) for _ in range(90)]
    left, right = np.repeat(np.arange(90), 90), np.tile(np.arange(90), 90)
    assert align.ratios(words, left, right).tolist() == [ratio(words[i], words[j]) for i, j in zip(left, right, strict=True)]
    assert align.similarity("tide", "diet") == 0.25 and align.similarity("diet", "tide") == 0.5


def test_memory_grows_with_length_alone():
    import tracemalloc

    rng = np.random.default_rng(6)
    items, peaks = ITEMS["pitches"], []
    for n in (1500, 4500):
        a, b = rng.integers(0, len(items), n), rng.integers(0, len(items), n)
        tracemalloc.start()
        entries, _, _ = next(align.align_many(items, [(a, b)], align.pitch_costs, 0.5))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert sorted(i for i, _ in entries.tolist() if i >= 0) == list(range(n))
    assert peaks[1] < 2 * peaks[0]


def test_columns(spark):
    rows = [(1, ["a", "b"], ["a"]), (2, None, ["a", "b"]), (3, [], None), (4, ["fall", "ing"], ["falling"])]
    out = {r["id"]: r["alignment"] for r in align.align_columns(spark.createDataFrame(rows, "id int, l array<string>, r array<string>"), "l", "r", "tokens").collect()}
    assert [tuple(p)[:2] for p in out[2]["pairs"]] == [(None, 0), (None, 1)] and out[3]["pairs"] == [] and out[3]["cost"] == 0
    assert [tuple(p)[:2] for p in out[4]["pairs"]] == plain(rows[3][1], rows[3][2], "tokens")[0]
