"""Every score query that SQL can express gives SQL's rows."""

import math
import os
from collections import defaultdict

import duckdb
import pytest

from scoreframe.operators import align
from scoreframe.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, db, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = db.execute(registry.oracle_sql()[name])
    cols = [x[0] for x in found.description]
    assert sorted(cols) == names
    theirs = sorted((tuple(plain(r[cols.index(c)]) for c in names) for r in found.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_all_parts_aligned(spark, db):
    """nw_pitch against brute force over every neighbouring pair of parts."""
    notes = defaultdict(list)
    for part, q in db.execute("select l_partkey, cast(l_quantity as int) from lineitem order by l_partkey, l_orderkey, l_linenumber, l_suppkey, l_extendedprice").fetchall():
        notes[part].append((q % 7, 0, q // 7))
    want = sorted((p, j) for p in notes if p + 1 in notes for i, j in align.align(notes[p], notes[p + 1], "pitches")[0] if i is None)
    assert max(want)[0] >= 60 and sorted((r["l_partkey"], r["ri"]) for r in registry.queries()["nw_pitch"](spark, SF).collect()) == want


def test_all_customers_aligned(spark, db, tmp_path):
    """nw_measures aligns customers past the first two hundred, the same as by themselves."""
    f = {r["l_orderkey"]: (r["notes"], r["duration"], r["first_midi"], r["shape"]) for r in registry.queries()["fingerprints"](spark, SF).collect()}
    db.execute(f"copy (select * replace (o_custkey + 190 as o_custkey) from orders) to '{tmp_path}/orders.parquet'")
    os.symlink(f"{SF}/lineitem.parquet", tmp_path / "lineitem.parquet")
    songs = defaultdict(list)
    for c, k in db.execute("select o_custkey + 190, o_orderkey from orders order by 1, 2").fetchall():
        if k in f:
            songs[c].append(f[k])
    want = sorted(((c, *p) for c in songs if c + 1 in songs for p in align.align(songs[c], songs[c + 1], "measures")[0]), key=repr)
    assert max(w[0] for w in want) >= 200
    assert sorted(((r["o_custkey"], r["li"], r["ri"]) for r in registry.queries()["nw_measures"](spark, str(tmp_path)).collect()), key=repr) == want


def test_whole_turns_aligned(spark, tmp_path):
    """Turns that differ after the twelfth token alone, and of unequal lengths, against the alignment of the whole lists."""
    same = "one two three four five six seven eight nine ten eleven twelve"
    texts = [same, same + " wholly other words", same + " thirteen fourteen", "short turn"]
    spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["turn"]: (r["cost"], r["n_entries"]) for r in registry.queries()["nw_tokens"](spark, str(tmp_path)).collect()}
    for i in range(3):
        pairs, cost = align.align(texts[i].split(), texts[i + 1].split(), "tokens")
        assert got[i] == (pytest.approx(cost, abs=1e-6), len(pairs))
    assert got[0] == (pytest.approx(1.8), 15)
