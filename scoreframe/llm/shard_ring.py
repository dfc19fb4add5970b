"""Shards on a consistent-hash ring with virtual nodes and bounded loads.

A shard holds `nodes` points of a ring of POSITIONS places. A key stands at a place given by its hash and belongs to the arc of
the next point clockwise. Keys arrive in a fixed order; one whose shard is full goes on clockwise to the first that has room, so that
the capacities bound every load, and a key moves only when a shard before its own fills up earlier or later.

Keys arrive by (time, arc, hash), where time is a part of the hash. All keys of an arc pass the shards in the same order, so
whom the ring turns away follows from the number of keys in each of the TIMES x arcs cells. These are counted in one shuffle; a shard that
fills up is an event within one cell, found by a running sum over the cells, at most one event a shard. A row's shard follows
from its rank in its cell and the events before, its slot from running sums over the cells. Cells are constant in number.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreframe.llm.common import durable, table

#: Places on the ring and steps of time: three and two hexadecimal digits of a key's hash.
POSITIONS, TIMES = 4096, 256


def points(n_shards: int, nodes: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, clockwise; nodes at one place stand in the order of their hashes."""
    hashed = sorted((md5(f"{s}/{v}".encode()).hexdigest(), s) for s in range(n_shards) for v in range(nodes))
    return [(int(h[:3], 16), s) for h, s in hashed]


def arcs(n_shards: int, nodes: int) -> tuple[list[int], list[list[int]]]:
    """The arc of each place, and each arc's shards in the order in which its keys pass them."""
    at = points(n_shards, nodes)
    of, i = [], 0
    for place in range(POSITIONS):
        while i < len(at) and at[i][0] < place:
            i += 1
        of.append(i % len(at))
    return of, [list(dict.fromkeys(s for _, s in at[i:] + at[:i])) for i in range(len(at))]


def capacities(rows: int, n_shards: int, slack: float) -> list[int]:
    """The most rows of each shard: without slack they add up to all rows and are one apart at most."""
    if slack:
        return [int(-(-rows * (1 + slack) // n_shards))] * n_shards
    return [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]


def _list(values: list[int]) -> Column:
    """A constant array, as one literal that the optimizer folds."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _pick(values: list[int], index: Column) -> Column:
    return F.get(_list(values), index.cast("int")).cast("int")


def _fill(cells: DataFrame, passed: list[list[int]], left: list[int]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """The events (cell, how many of its rows arrived before), in order, and after each number of events every arc's first shard with room.

    Each event takes two jobs over the cells; a single row, then a sum a shard, reach the driver.
    """
    full = {s for s, room in enumerate(left) if not room}
    events, targets = [], []
    at, gone = -1, 0
    while True:
        now = [next((s for s in order if s not in full), 0) for order in passed]
        targets.append(now)
        if len(full) == len(left):
            return events, targets
        n = F.when(F.col("cell") == at, F.col("n") - gone).otherwise(F.col("n"))
        run = cells.where(F.col("cell") >= at).select("cell", _pick(now, F.col("cell") % len(passed)).alias("to"), n.alias("n"))
        run = run.withColumn("upto", F.sum("n").over(Window.partitionBy("to").orderBy("cell")))
        hit = run.where(F.col("upto") >= F.get(_list(left), F.col("to"))).orderBy("cell").first()
        if hit is None:
            return events, targets
        for r in run.where(F.col("cell") < hit["cell"]).groupBy("to").agg(F.sum("n").alias("n")).collect():
            left[r["to"]] -= r["n"]
        gone = (gone if hit["cell"] == at else 0) + left[hit["to"]]
        at = hit["cell"]
        left[hit["to"]] = 0
        full.add(hit["to"])
        events.append((at, gone))


def ring_shards(docs: DataFrame, n_shards: int = 8, nodes: int = 32, slack: float = 0.0) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot, home_shard) for every row of docs; home_shard owns the key's arc.

    The key is doc_id, or for a null one the text's checksum. A null text has no bytes: size 1, checksum 0. Slots number
    a shard's rows by their order of arrival. Repeated rows, and rows of one id, arrive one after the other; equal ones are counted
    before the shuffle, so no task holds them as rows. Other columns are left out; an empty table gives an empty one. With
    slack, a shard holds up to (1 + slack) of its even share.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    of, passed = arcs(n_shards, nodes)
    hashed = rows.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("crc"), F.col("text_crc32"))).cast("binary")))
    digits = lambda start, n: F.conv(F.substring("h", start, n), 16, 10).cast("int")
    cell = digits(4, 2) * len(passed) + _pick(of, digits(1, 3))
    keys = durable(hashed.withColumn("cell", cell).groupBy("cell", "h", "doc_id", "text_crc32", "size").agg(F.count("*").alias("copies")))
    cells = durable(keys.groupBy("cell").agg(F.sum("copies").alias("n")))
    total = cells.agg(F.sum("n")).first()[0] or 0
    events, targets = _fill(cells, passed, capacities(total, n_shards, slack))
    flat = [s for now in targets for s in now]
    to = lambda phase: _pick(flat, phase * len(passed) + F.col("cell") % len(passed))

    # what is left of a cell between two events is a piece: its rows go to one shard, with consecutive slots
    c, phases = F.col("cell"), lambda test: sum((F.when(test(e), 1).otherwise(0) for e in events), F.lit(0))
    first, last = phases(lambda e: (c > e[0]) | ((c == e[0]) & F.lit(e[1] <= 0))), phases(lambda e: c > e[0]) + phases(lambda e: c == e[0])
    ends = _list([e for e, _ in events] or [-1]), _list([g for _, g in events] or [0])
    edge = lambda k, other: F.when(F.get(ends[0], k) == c, F.get(ends[1], k)).otherwise(other)
    pieces = cells.select("cell", "n", F.explode(F.sequence(first, last)).alias("phase"))
    pieces = pieces.select("cell", "phase", to(F.col("phase")).alias("shard"), edge(F.col("phase") - 1, F.lit(0)).cast("long").alias("start"), edge(F.col("phase"), F.col("n")).cast("long").alias("end"))
    w = Window.partitionBy("shard").orderBy("cell", "phase").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("base", F.coalesce(F.sum(F.col("end") - F.col("start")).over(w), F.lit(0)) - F.col("start"))

    w = Window.partitionBy("cell").orderBy("h", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = keys.withColumn("before", F.coalesce(F.sum("copies").over(w), F.lit(0)))
    ranked = ranked.select("doc_id", "size", "text_crc32", "cell", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("copies") - 1)).alias("rank"))
    ranked = ranked.withColumn("phase", phases(lambda e: (c > e[0]) | ((c == e[0]) & (F.col("rank") >= e[1]))))
    out = ranked.join(F.broadcast(pieces.select("cell", "phase", "shard", "base")), ["cell", "phase"])
    home = _pick([order[0] for order in passed], c % len(passed))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank")).alias("slot"), home.alias("home_shard"))


def op13_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7 under the law of equal row counts, which capacities without slack guarantee."""
    out = ring_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


#: One row after the other takes the first shard clockwise that has room.
OP13_SQL = r"""
with recursive crc as (
    select list(list_reduce(list_prepend(b, range(8)), lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by b) as t from (select unnest(range(256)) as b)
), d as (
    select doc_id, octet_length(encode(coalesce(text, ''))) + 1 as size, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: cast('0x' || b as bigint))),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) as text_crc32
    from documents, crc
), node as (
    select s, h, cast('0x' || substr(h, 1, 3) as int) as place, row_number() over (order by h, s) - 1 as arc
    from (select s, md5(s || '/' || v) as h from unnest(range(8)) a(s), unnest(range(32)) b(v))
), passed as (
    select arc, list(s order by away) as shards from (select a.arc, b.s, min((b.arc - a.arc + 256) % 256) as away from node a, node b group by all) group by arc
), keyed as (
    select d.*, h, cast('0x' || substr(h, 1, 3) as int) as place, cast('0x' || substr(h, 4, 2) as int) as time from (select *, md5(coalesce(cast(doc_id as varchar), 'crc' || text_crc32)) as h from d) d
), placed as (
    select k.*, coalesce((select min(arc) from node n where n.place >= k.place), 0) as arc from keyed k
), lined as (
    select p.*, shards, row_number() over (order by time, p.arc, h, doc_id, text_crc32, size) as i from placed p join passed using (arc)
), room as (
    select list_transform(range(8), lambda s: n // 8 + if(s < n % 8, 1, 0)) as cap from (select count(*) as n from documents)
), steps as (
    select cast(0 as bigint) as i, list_transform(range(8), lambda s: cast(0 as bigint)) as load, cast(null as bigint) as shard
    union all
    select i, list_transform(load, lambda v, j: v + if(j = s + 1, 1, 0)), s
    from (select l.i, t.load, list_filter(l.shards, lambda x: t.load[x + 1] < cap[x + 1])[1] as s from steps t join lined l on l.i = t.i + 1, room)
)
select doc_id, cast(size as bigint) as size, text_crc32, 'rows' as law, cast(shard as int) as shard, row_number() over (partition by shard order by i) - 1 as slot,
    cast(null as int) as grown_shard, cast(shards[1] as int) as home_shard
from lined join steps using (i)
"""
