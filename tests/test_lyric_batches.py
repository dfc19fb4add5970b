"""lyric_repair at size: songs cut by batches, alignments of many songs at once, tables read once."""

import random

import pyarrow as pa

from scoreframe.operators import lyric_repair as R
from scoreframe.plans import lyric_songs, registry

TEXTS, TOKENS = pa.list_(pa.struct([("verse", pa.int32()), ("text", pa.string())])), pa.list_(pa.struct([("verse", pa.int32()), ("pos", pa.int32()), ("token", pa.string())]))
ROWS = pa.schema([("song", pa.string()), ("seq", pa.int32()), ("measure", pa.int32()), ("kind", pa.string()), ("pitch", pa.int32()), ("there", pa.bool_()), ("texts", TEXTS), ("tokens", TOKENS)])


def rows(sizes):
    """Rows of songs; in every third song words and truth come in rows of their own, before the notes."""
    random.seed(7)
    out = []
    for s, size in enumerate(sizes):
        notes, words = [], []
        for i in range(size):
            word, kind = random.choice(lyric_songs.WORDS), random.choice(["note", "note", "rest"])
            texts = [{"verse": v, "text": word[:-1] or "x"} for v in (1, 2) if kind == "note" and random.random() < 0.5]
            tokens = [{"verse": v, "pos": i, "token": word} for v in (1, 2) if random.random() < 0.7]
            own = s % 3 > 0
            notes.append({"song": str(s), "seq": i, "measure": i // 4, "kind": kind, "pitch": 60, "there": True, "texts": texts if own else [], "tokens": tokens if own else []})
            words += [] if own else [{"song": str(s), "seq": i, "there": False, "texts": texts, "tokens": tokens}]
        out += words + notes
    return out


def test_batches(monkeypatch):
    given = rows([1, 30, 0, 17, 90, 2, 2, 40])
    whole = pa.Table.from_pylist(given, ROWS)
    words = R.Words(lyric_songs.WORDS)
    calls = []
    monkeypatch.setattr(R, "align_many", lambda items, pairs, *a, inner=R.align_many: calls.append(len(pairs)) or inner(items, pairs, *a))
    want = pa.Table.from_batches(R.repair_batches(whole.to_batches(), words)).to_pylist()
    assert len(calls) == 1 and calls[0] >= 12  # all verses of all songs in one go
    assert {(r["song"], r["seq"]) for r in want} == {(r["song"], r["seq"]) for r in given} and any(r["phantom"] for r in want)
    for size, most in ((1, 1), (3, 5), (25, 20), (90, 20)):
        monkeypatch.setattr(R, "ROWS", most)
        assert pa.Table.from_batches(R.repair_batches(whole.to_batches(max_chunksize=size), words)).to_pylist() == want


def test_tables_are_read_once(spark):
    plan = registry.queries()["lyric_repair"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linenumber") and plan.lower().count("relation [l_orderkey") == 1 and plan.lower().count("relation [o_orderkey") == 1
