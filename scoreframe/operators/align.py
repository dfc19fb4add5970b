"""Sequence alignment for tokens, pitches and measure fingerprints: costs of distinct pairs, tables swept by diagonals, memory linear in length."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN_GAP, PITCH_GAP, MEASURE_GAP = 0.6, 0.5, 1.2

PAIRS = "array<struct<li: int, ri: int, cost: double>>"

#: Cells of cost tables and sums of kept rows that a worker holds at once, distinct pairs of items compared at once and kept of a long pair of sequences, and the longest strings compared in bulk.
CELLS, KEPT, DISTINCT, TABLE, LONGEST = 1 << 21, 1 << 22, 1 << 20, 1 << 23, 48


# costs of distinct pairs


def ratios(strings: Sequence[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ratcliff-Obershelp ratio of each pair of indices into strings, the same to the bit as SequenceMatcher's; not symmetric.

    Pairs without a common character are 0. The others are compared in bulk: a table of run lengths, one character of the left side at a
    time, gives every pair's longest match at once, and what lies before and after it goes into the next round. Pairs with a long string
    go one by one, as SequenceMatcher drops frequent characters there.
    """
    n = np.array([len(s) for s in strings], np.int64)
    out = np.ones(len(left))
    total = n[left] + n[right]
    bits = np.array([sum({1 << (ord(c) & 63) for c in s}) for s in strings], np.uint64)
    some = (bits[left] & bits[right]) != 0
    out[(total > 0) & ~some] = 0.0
    short = some & (n[left] <= LONGEST) & (n[right] <= LONGEST)
    for k in np.flatnonzero(some & ~short):
        out[k] = SequenceMatcher(None, strings[left[k]], strings[right[k]]).ratio()
    letters: dict[str, int] = {}
    codes = np.zeros((len(strings), int(min(n.max(initial=0), LONGEST)) or 1), np.int32)
    for row, s in zip(codes, strings, strict=True):
        if len(s) <= len(row):
            row[: len(s)] = [letters.setdefault(c, len(letters)) for c in s]
    codes = codes.T.astype(np.uint8 if len(letters) < 254 else np.int32)
    picked = np.flatnonzero(short)
    # pairs of about one size go together
    picked = picked[np.lexsort((n[right[picked]], n[left[picked]]))]
    for start in range(0, len(picked), 1 << 14):
        k = picked[start : start + (1 << 14)]
        out[k] = 2.0 * _matched(codes, left[k], right[k], n[left[k]], n[right[k]]) / total[k]
    return out


def _matched(codes: np.ndarray, left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Matched characters of each pair: the longest match, first on the left and then on the right, and those before and after it.

    codes has a column a string. A match's size, place on the left and place on the right make one number, whose maximum is the match wanted.
    """
    found = np.zeros(len(left), np.int64)
    zero = np.zeros(len(left), np.int64)
    pair, a0, a1, b0, b1 = np.arange(len(left)), zero, n, zero, m
    none = np.iinfo(codes.dtype).max
    while len(pair):
        at = a0 + np.arange(int((a1 - a0).max()))[:, None]
        a = np.where(at < a1, codes[np.minimum(at, len(codes) - 1), left[pair]], none)
        at = b0 + np.arange(int((b1 - b0).max()))[:, None]
        b = np.where(at < b1, codes[np.minimum(at, len(codes) - 1), right[pair]], none - 1)
        run = np.zeros((len(b) + 1, len(pair)), np.int8)
        match = np.zeros(b.shape, np.int32)
        place = np.arange(63, 63 - len(b), -1, dtype=np.int32)[:, None]
        for x, c in enumerate(a):
            run[1:] = (run[:-1] + np.int8(1)) * (b == c)
            np.maximum(match, run[1:] * np.int32(4096) + (place + (63 - x) * 64), out=match)
        match = match.max(0).astype(np.int64)
        size = match >> 12
        i, j = a0 + 64 - (match >> 6 & 63) - size, b0 + 64 - (match & 63) - size
        np.add.at(found, pair, size)
        before, after = (size > 0) & (i > a0) & (j > b0), (size > 0) & (i + size < a1) & (j + size < b1)
        rest = lambda x, y: np.concatenate([x[before], y[after]])  # noqa: B023, E731
        pair, a0, a1, b0, b1 = rest(pair, pair), rest(a0, i + size), rest(i, a1), rest(b0, j + size), rest(j, b1)
    return found


def similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio of two lower-cased strings; not symmetric."""
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def token_costs(items: Sequence[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return 1 - ratios([t.lower() for t in items], left, right)


def pitch_costs(items: Sequence[tuple], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of (step, alter, octave) triples: 0 if equal, 0.3 an octave apart, else 1."""
    names: dict = {}
    name = np.array([names.setdefault(x[:2], len(names)) for x in items], np.int64)
    octave = np.array([x[2] for x in items], np.int64)
    apart = np.abs(octave[left] - octave[right])
    return np.where(name[left] != name[right], 1.0, np.where(apart == 0, 0.0, np.where(apart == 1, 0.3, 1.0)))


def measure_costs(items: Sequence[tuple], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of (notes, duration, first_midi, shape): likeness weighs rhythm 0.40, note count 0.25, duration 0.20 and first pitch 0.15; two empty measures are alike."""
    notes, length, midi = (np.array([x[k] for x in items], float) for k in range(3))
    shapes: dict = {}
    shape = np.array([shapes.setdefault(x[3], len(shapes)) for x in items], np.int64)
    codes, back = np.unique(shape[left] * len(shapes) + shape[right], return_inverse=True)
    rhythm = ratios(list(shapes), codes // max(1, len(shapes)), codes % max(1, len(shapes)))[back]
    near = lambda v: np.abs(v[left] - v[right]) / np.maximum(np.maximum(v[left], v[right]), 1)
    pitch = np.where((midi[left] >= 0) & (midi[right] >= 0), np.maximum(0.0, 1 - np.abs(midi[left] - midi[right]) / 7.0), 0.5)
    alike = 0.40 * rhythm + 0.25 * (1 - near(notes)) + 0.20 * np.maximum(0.0, 1 - near(length)) + 0.15 * pitch
    return 1 - np.where((notes[left] == 0) & (notes[right] == 0), 1.0, alike)


#: kind -> costs of pairs of items, gap, and how near two sums have to be to count as equal in the traceback.
KINDS: dict[str, tuple[Callable, float, float]] = {
    "tokens": (token_costs, TOKEN_GAP, 0.0),
    "pitches": (pitch_costs, PITCH_GAP, 0.0),
    "measures": (measure_costs, MEASURE_GAP, 1e-9),
}


# the table of sums


def _sweep(cost: np.ndarray, top: np.ndarray, gap: float, eps: float, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums under several cost tables (tables, rows, columns) at once, given the sums of the row above (tables, columns + 1).

    The cells of a diagonal depend on the two before it alone. Returns each cell's step (0 a pair, 1 a gap on the right, 2 on the left; the first that
    gives the sum), the sums of the last row, and those at ends, (row, column) of each table.
    """
    b, h, w = cost.shape
    flat, steps, pace = cost.reshape(b, h * w), np.empty((b, h * w), np.uint8), max(1, w - 1)
    side = np.add.accumulate(np.concatenate([top[:, :1], np.full((b, h), gap)], axis=1), axis=1)
    last, found = np.empty((b, w + 1)), np.empty(b)
    at = np.full(b, -1) if ends is None else ends.sum(1)
    older = old = np.empty((b, h + 1))
    for d in range(h + w + 1):
        new = np.empty((b, h + 1))
        if d <= w:
            new[:, 0] = top[:, d]
        if d <= h:
            new[:, d] = side[:, d]
        lo, hi = max(1, d - w), min(h, d - 1)
        if lo <= hi:
            cells = slice((lo - 1) * w + d - lo - 1, (hi - 1) * w + d - hi, pace)
            pair, up, back = older[:, lo - 1 : hi] + flat[:, cells], old[:, lo - 1 : hi] + gap, old[:, lo : hi + 1] + gap
            best = np.minimum(np.minimum(pair, up), back)
            same = (lambda x: x == best) if eps == 0 else (lambda x: np.abs(x - best) < eps)  # noqa: B023
            steps[:, cells] = np.where(same(pair), 0, np.where(same(up), 1, 2))
            new[:, lo : hi + 1] = best
        if d >= h:
            last[:, d - h] = new[:, h]
        hit = np.flatnonzero(at == d)
        if len(hit):
            found[hit] = new[hit, ends[hit, 0]]
        older, old = old, new
    return steps.reshape(b, h, w), last, found


def _walk(steps: np.ndarray, i: int, j: int, row: int) -> tuple[list[tuple[int, int]], int]:
    """From cell (i, j) of a block whose first row is number `row` back to the row above it: entries (left or -1, right or -1), last first, and the column reached."""
    out = []
    while i:
        step = steps[i - 1, j - 1] if j else 1
        i -= step < 2
        j -= step != 1
        out.append((row + i if step < 2 else -1, j if step != 1 else -1))
    return out, j


def _long(costs: Callable[[int, int, int], np.ndarray], n: int, m: int, gap: float, eps: float) -> tuple[list[tuple[int, int]], float]:
    """One alignment in memory linear in n and m: rows are swept in blocks, sums are kept of the rows between parts, and the parts are walked from the last.

    costs(r0, r1, c) gives the costs of some rows with the first c columns. A part of more than a block is cut again, so beyond
    KEPT sums the rows are swept once more.
    """
    rows = lambda c: max(1, CELLS // max(1, c))
    total = 0.0

    def back(r0: int, top: np.ndarray, r1: int, c: int) -> tuple[list[tuple[int, int]], int]:
        nonlocal total
        if not c:
            return [(r, -1) for r in range(r1 - 1, r0 - 1, -1)], 0
        if r1 - r0 <= rows(c):
            steps, last, _ = _sweep(costs(r0, r1, c)[None], top[None, : c + 1], gap, eps)
            if (r1, c) == (n, m):
                total = float(last[0, -1])
            return _walk(steps[0], r1 - r0, c, r0)
        parts = min(-(-(r1 - r0) // rows(c)), max(2, KEPT // (c + 1)))
        cuts = [r0 + (r1 - r0) * k // parts for k in range(parts + 1)]
        kept = [top]
        for start, stop in zip(cuts[:-2], cuts[1:-1], strict=True):
            row = kept[-1]
            for r in range(start, stop, rows(c)):
                row = _sweep(costs(r, min(stop, r + rows(c)), c)[None], row[None, : c + 1], gap, eps)[1][0]
            kept.append(row)
        out: list[tuple[int, int]] = []
        for k in range(parts - 1, -1, -1):
            part, c = back(cuts[k], kept.pop(), cuts[k + 1], c)
            out += part
        return out, c

    out, c = back(0, np.add.accumulate(np.concatenate([[0.0], np.full(m, gap)])), n, m)
    return [*out, *((-1, j) for j in range(c - 1, -1, -1))][::-1], total


def align_many(items: Sequence, pairs: Sequence[tuple[np.ndarray, np.ndarray]], costs: Callable, gap: float, eps: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pair of sequences of indices into items, in order: entries (left index or -1, right index or -1) as an array, the cost of each, and the least sum.

    On ties a pair goes before a gap on the right, and that before one on the left, from the ends. Sequences are taken in runs of
    bounded size, and costs are computed once for each distinct pair of items in a run.
    """
    run: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for a, b in pairs:
        cells, distinct = len(a) * len(b), len(np.unique(a)) * len(np.unique(b))
        if run and size + max(cells, distinct) > CELLS:
            yield from _run(items, run, costs, gap, eps)
            run, size = [], 0
        run.append((a, b))
        size += max(cells, distinct)
    if run:
        yield from _run(items, run, costs, gap, eps)


def _run(items: Sequence, run: list[tuple[np.ndarray, np.ndarray]], costs: Callable, gap: float, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    plain = lambda a, b: (np.array([(i, -1) for i in range(len(a))] + [(-1, j) for j in range(len(b))], np.int64).reshape(-1, 2), np.full(len(a) + len(b), gap), float(np.add.accumulate([0.0, *[gap] * (len(a) + len(b))])[-1]))
    if len(run) == 1 and len(run[0][0]) * len(run[0][1]) > CELLS:
        a, b = run[0]

        (u, x), (v, y) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)

        def compared(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
            most = max(1, DISTINCT // len(columns))
            parts = (rows[k : k + most] for k in range(0, len(rows), most))
            return np.concatenate([costs(items, np.repeat(p, len(columns)), np.tile(columns, len(p))).reshape(len(p), -1) for p in parts])

        table = compared(u, v) if len(u) * len(v) <= TABLE else None

        def block(r0: int, r1: int, c: int) -> np.ndarray:
            if table is not None:
                return table[x[r0:r1, None], y[None, :c]]
            (rows, at), (columns, to) = np.unique(a[r0:r1], return_inverse=True), np.unique(b[:c], return_inverse=True)
            return compared(rows, columns)[at[:, None], to[None]]

        out, total = _long(block, len(a), len(b), gap, eps)
        entries = np.array(out, np.int64)
        paired = (entries >= 0).all(1)
        each = np.full(len(entries), gap)
        each[paired] = costs(items, a[entries[paired, 0]], b[entries[paired, 1]])
        yield entries, each, total
        return
    tables = [(np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)) for a, b in run]
    wanted = [np.add.outer(x[0] * len(items), y[0]).ravel() for x, y in tables]
    codes = np.unique(np.concatenate(wanted)) if wanted else np.empty(0, np.int64)
    values = np.concatenate([costs(items, c // len(items), c % len(items)) for c in np.array_split(codes, max(1, len(codes) // DISTINCT))]) if len(codes) else np.empty(0)
    answers: list = [plain(a, b) if not len(a) or not len(b) else None for a, b in run]
    todo = sorted((k for k, x in enumerate(answers) if x is None), key=lambda k: (len(run[k][0]) + len(run[k][1]), len(run[k][0])))
    while todo:
        # tables of about one size are swept together
        some, h, w = [], 0, 0
        while todo and (not some or (len(some) + 1) * max(h, len(run[todo[-1]][0])) * max(w, len(run[todo[-1]][1])) <= CELLS):
            k = todo.pop()
            some.append(k)
            h, w = max(h, len(run[k][0])), max(w, len(run[k][1]))
        cost = np.zeros((len(some), h, w))
        for table, k in zip(cost, some, strict=True):
            (u, x), (v, y) = tables[k]
            table[: len(x), : len(y)] = values[np.searchsorted(codes, wanted[k])].reshape(len(u), len(v))[x][:, y]
        top = np.broadcast_to(np.add.accumulate(np.concatenate([[0.0], np.full(w, gap)])), (len(some), w + 1))
        ends = np.array([(len(run[k][0]), len(run[k][1])) for k in some])
        steps, _, found = _sweep(cost, top, gap, eps, ends)
        for s, table, k, (n, m), total in zip(steps, cost, some, ends, found, strict=True):
            out, c = _walk(s, n, m, 0)
            entries = np.array([*out, *((-1, j) for j in range(c - 1, -1, -1))][::-1], np.int64)
            answers[k] = entries, np.where((entries >= 0).all(1), table[entries[:, 0], entries[:, 1]], gap), float(total)
    yield from answers


def align(left: Sequence, right: Sequence, kind: str, gap: float | None = None) -> tuple[list[tuple[int | None, int | None]], float]:
    """The alignment of two sequences of hashable items: pairs of indices, None for a gap, and the least cost."""
    costs, usual, eps = KINDS[kind]
    ids: dict = {}
    a, b = (np.array([ids.setdefault(x, len(ids)) for x in side], np.int64) for side in (left, right))
    out, _, total = next(align_many(list(ids), [(a, b)], costs, usual if gap is None else gap, eps))
    return [(i if i >= 0 else None, j if j >= 0 else None) for i, j in out.tolist()], total


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by hash of keys over several tasks a core: alignment costs far more time a byte than the sizes tell by which adaptive plans merge partitions."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def align_columns(df: DataFrame, left: str, right: str, kind: str, gap: float | None = None, out: str = "alignment") -> DataFrame:
    """df with out: struct(pairs array of struct(li, ri, cost), cost) of two array columns of a row; null arrays count as empty.

    A row is one pair of sequences. Its time has the product of their lengths, its memory their sum.
    """
    costs, usual, eps = KINDS[kind]
    used = usual if gap is None else gap

    @F.arrow_udf(f"struct<pairs: {PAIRS}, cost: double>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        ids: dict = {}
        plain = lambda v: tuple(v.values()) if isinstance(v, dict) else v
        index = lambda row: np.array([ids.setdefault(plain(v), len(ids)) for v in row.as_py() or []], np.int64)
        pairs = [(index(x), index(y)) for x, y in zip(a, b, strict=True)]
        done = list(align_many(list(ids), pairs, costs, used, eps))
        entries = np.concatenate([d[0] for d in done] or [np.empty((0, 2), np.int64)])
        sides = [pa.array(entries[:, k].astype(np.int32), mask=entries[:, k] < 0) for k in (0, 1)]
        sides.append(pa.array(np.concatenate([d[1] for d in done] or [np.empty(0)])))
        offsets = np.concatenate([[0], np.cumsum([len(d[0]) for d in done])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(sides, names=["li", "ri", "cost"]))
        return pa.StructArray.from_arrays([lists, pa.array([d[2] for d in done], pa.float64())], names=["pairs", "cost"])

    return df.withColumn(out, run(F.col(left), F.col(right)))


def alignment_rows(df: DataFrame, by: list[str], alignment: str = "alignment") -> DataFrame:
    """Rows (by, at, li, ri, cost) of an alignment's pairs."""
    return df.select(*by, F.posexplode(f"{alignment}.pairs").alias("at", "_p")).select(*by, "at", "_p.li", "_p.ri", "_p.cost")


def alignment_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, pairs, left_gaps, right_gaps): right gaps are entries without a right side."""
    return rows.groupBy(*by).agg(
        F.count_if(F.col("li").isNotNull() & F.col("ri").isNotNull()).alias("pairs"), F.count_if(F.col("li").isNull()).alias("left_gaps"), F.count_if(F.col("ri").isNull()).alias("right_gaps")
    )


def recovery_candidates(rows: DataFrame, by: list[str], measure: Column) -> DataFrame:
    """Right-only entries with the measures of the nearest pairs before and after; measure is that of the left side."""
    paired = F.when(F.col("li").isNotNull() & F.col("ri").isNotNull(), measure)
    w = Window.partitionBy(*by).orderBy("at")
    out = rows.withColumns({
        "prev_measure": F.last(paired, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "next_measure": F.first(paired, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    })
    return out.where(F.col("li").isNull()).select(*by, "ri", "prev_measure", "next_measure")


def neighbour_confidence(rows: DataFrame, by: list[str], score: str, radius: int = 3, out: str = "confidence") -> DataFrame:
    """Mean score of the pairs within radius places, the row itself left out; 0 where there is none. Entries that aren't pairs have null scores."""
    w = Window.partitionBy(*by).orderBy("at")
    parts = [w.rowsBetween(-radius, -1), w.rowsBetween(1, radius)]
    total = sum((F.coalesce(F.sum(score).over(p), F.lit(0.0)) for p in parts), F.lit(0.0))
    n = sum((F.count(score).over(p) for p in parts), F.lit(0))
    return rows.withColumn(out, F.when(n > 0, total / n).otherwise(0.0))


def fill_decision(rows: DataFrame, confidence: str, primary_notes: str, secondary_notes: str, least: float = 0.55) -> DataFrame:
    """df with action of each alignment entry: has_notes, ignored, skipped_low_confidence or filled; null for gaps."""
    action = (
        F.when(F.col("li").isNull() | F.col("ri").isNull(), None)
        .when(F.col(primary_notes) > 0, "has_notes")
        .when(F.col(secondary_notes) == 0, "ignored")
        .when(F.col(confidence) < least, "skipped_low_confidence")
        .otherwise("filled")
    )
    return rows.withColumn("action", action)


def rhythm_code(ql: Column, is_rest: Column) -> Column:
    """A bucket letter for a duration; rests are r; null for a note without length."""
    return F.when(is_rest, "r").when(ql >= 4, "W").when(ql >= 2, "h").when(ql >= 1, "q").when(ql >= 0.5, "e").when(ql > 0, "s")


def fingerprints(notes: DataFrame, by: list[str], order: list[str], ql: str, midi: str, is_rest: Column) -> DataFrame:
    """Rows (by, notes, duration, first_midi, shape) of each measure; rests take part in the shape alone."""
    sound = ~is_rest
    item = F.struct(*[F.col(c) for c in order], rhythm_code(F.col(ql), is_rest).alias("c"))
    shape = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["c"]), " ")
    return notes.groupBy(*by).agg(
        F.count_if(sound).cast("int").alias("notes"), F.bround(F.coalesce(F.sum(F.when(sound, F.col(ql))), F.lit(0.0)), 2).alias("duration"),
        F.coalesce(F.min_by(F.when(sound, F.col(midi)), F.when(sound, F.struct(*order))), F.lit(-1)).cast("int").alias("first_midi"), shape.alias("shape"),
    )
