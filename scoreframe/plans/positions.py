"""Queries on positions and order: location, offsets, islands, windows, deduplication. Users stand for staves, purchases for bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreframe.functions.text import snap
from scoreframe.operators import coverage, islands, locate, windows
from scoreframe.sources.tables import read


def _bars_and_points(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    w = Window.partitionBy("user_id").orderBy("value", "event_id")
    bars = e.where("event_type = 'purchase'").select("user_id", F.col("value").alias("bx"), F.row_number().over(w).alias("number"))
    return bars, e.where("event_type <> 'purchase'")


def locate_glyphs(spark: SparkSession, sf: str) -> DataFrame:
    bars, points = _bars_and_points(spark, sf)
    out = locate.locate(points, bars, ["user_id"], "value", "bx", "number")
    return out.select("event_id", "user_id", F.col("measure").cast("long").alias("measure"), F.round("frac", 6).alias("frac"))


LOCATED = """
b0 as (select user_id, value as bx, row_number() over (partition by user_id order by value, event_id) as n from events where event_type = 'purchase'),
b1 as (select user_id, bx, min(n) as m from b0 group by all),
b as (select *, lag(bx, 1, 0.0) over (partition by user_id order by bx) as l from b1),
top as (select user_id, max_by(m, bx) as lm from b group by all),
p as (select * from events where event_type <> 'purchase'),
located as (
    select p.event_id, p.user_id, p.event_type, p.value, cast(coalesce(b.m, top.lm) as bigint) as measure,
        case when top.lm is null then null when b.bx is null then 0.99 when b.bx - b.l <= 0 then 0.0 else least(greatest((p.value - b.l) / (b.bx - b.l), 0.0), 0.99) end as frac
    from p asof left join b on p.user_id = b.user_id and p.value <= b.bx left join top on p.user_id = top.user_id
)
"""


def global_offset(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").alias("n"))
    o = read(spark, sf, "orders").join(lines, "o_orderkey")
    out = locate.exclusive_offset(o, ["o_custkey"], ["o_orderkey"], "n")
    return out.select("o_custkey", "o_orderkey", F.col("n").cast("long").alias("n"), F.col("offset").cast("long").alias("offset"))


def first_seen_mode(spark: SparkSession, sf: str) -> DataFrame:
    return windows.first_seen_mode(read(spark, sf, "events"), ["user_id"], "event_type", ["event_id"])


def proximity_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.proximity_dedup(read(spark, sf, "events"), ["user_id"], "value", "event_type", 5.0)


def coverage_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Located glyphs that the export (those with an even id) lacks in their measure, in report order."""
    bars, points = _bars_and_points(spark, sf)
    found = locate.locate(points, bars, ["user_id"], "value", "bx", "number").withColumn("spot", F.concat_ws(":", "user_id", "measure"))
    known = found.where("event_id % 2 = 0")
    out = coverage.missing_rows(found, known, "spot", "event_type")
    return out.select("event_id", "user_id", F.col("measure").cast("long").alias("measure"), "event_type").orderBy(F.coalesce("measure", F.lit(0)), "event_id")


def greedy_near_dup(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    return coverage.greedy_cover(e.where("event_type = 'purchase'"), e.where("event_type <> 'purchase'"), ["user_id"], "value", ["event_id"], 0.5)


def near_anti(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return coverage.near_anti(e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'"), ["user_id"], "value", 0.5)


def ink_islands(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("user_id", F.floor("value").cast("int").alias("x"), F.lit(1).alias("ink"), F.col("value").alias("y_min"), F.col("value").alias("y_max"))
    out = islands.ink_blobs(e.groupBy("user_id", "x").agg(F.sum("ink").alias("ink"), F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max")), ["user_id"])
    return out.select("user_id", "island", "x_left", "x_right", F.col("ink").cast("long").alias("ink"))


def upper_median_groups(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey")
    out = islands.systems(o, ["o_custkey"], ["o_orderkey"], "o_orderkey", 1.8, keep=2)
    return out.select("o_custkey", "o_orderkey", F.col("system").cast("long").alias("system"), F.col("place").cast("long").alias("place"))


def nearest_below(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    lines = e.where("event_type = 'signup'").select("user_id", "value", "event_id")
    out = locate.nearest_below(e.where("event_type = 'click'"), lines, ["user_id"], "value", "value", "event_id", 2.0, 20.0)
    return out.select("event_id", "user_id", F.col("line").alias("line_id"), F.round("gap", 6).alias("gap"))


def active_attribute(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    out = windows.carry_forward(e, ["user_id"], ["event_id"], F.when(F.col("event_type") == "signup", F.col("value")))
    return out.select("event_id", "user_id", "active")


def bracket_fill(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    marked = F.when(F.col("event_type") == "error", F.col("event_id"))
    out = windows.bracket(e, ["user_id"], ["event_id"], marked)
    out = windows.nearest_value(out, ["user_id"], ["event_id"], marked, F.lit(-1).cast("long"))
    return out.select("event_id", F.coalesce("before", F.lit(-1)).alias("before_id"), F.coalesce("after", F.lit(1000000000)).cast("long").alias("after_id"), "nearest")


def leading_trim_renumber(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    kept = windows.renumber(windows.trim_leading(o, ["o_custkey"], "o_orderkey", F.col("o_orderstatus") == "F"), ["o_custkey"], ["o_orderkey"])
    return kept.select("o_custkey", "o_orderkey", F.col("number").cast("long").alias("number"))


def section_letters(spark: SparkSession, sf: str) -> DataFrame:
    o = windows.renumber(read(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"])
    starts = windows.first_where(o, ["o_custkey"], "number", F.col("o_orderstatus") == "P", "refrain")
    groups = o.groupBy("o_custkey").agg(F.max("number").alias("last")).join(starts, "o_custkey").withColumn("first", F.lit(1))
    out = windows.section_letters(groups, "first", "refrain", "last", 4)
    return out.select("o_custkey", F.col("measure").cast("long").alias("measure"), "letter", "breaks")


def drop_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return windows.drop_repeats(read(spark, sf, "events").select("event_id", "user_id", "event_type"), ["user_id"], ["event_id"], "event_type")


def part_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """For each order the supplier with the most lines, then the most quantity, then the highest key."""
    parts = read(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity"))
    return windows.rank_parts(parts, ["l_orderkey"], [F.desc("n_lines"), F.desc("quantity"), F.desc("l_suppkey")])


def snap_grid(spark: SparkSession, sf: str) -> DataFrame:
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return read(spark, sf, "lineitem").select(*key, snap(F.col("l_discount"), F.col("l_quantity")).alias("snapped"))


def redistribute(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order that share a discount go to the free quarter beats that other lines' taxes show."""
    line = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("flag"), F.col("l_tax").alias("t"), F.floor(F.col("l_discount") * 40).cast("double").alias("at"))
    glyphs = line.select("l_orderkey", "flag", (F.col("t") * 10).alias("frac"))
    return coverage.redistribute(line.withColumn("ql", F.lit(4.0)), glyphs, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "flag", "at", "ql", "frac")


QUERIES = {
    "locate_glyphs": (locate_glyphs, f"with {LOCATED} select event_id, user_id, measure, round(frac, 6) as frac from located"),
    "global_offset": (global_offset, """
        with l as (select l_orderkey, max(l_linenumber) as n from lineitem group by all)
        select o_custkey, o_orderkey, cast(n as bigint) as n,
            cast(coalesce(sum(n) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset"
        from orders join l on o_orderkey = l_orderkey"""),
    "first_seen_mode": (first_seen_mode, """
        select user_id, arg_min(event_type, struct_pack(n := -n, f := f)) as mode
        from (select user_id, event_type, count(*) as n, min(event_id) as f from events group by all) group by user_id"""),
    "proximity_dedup": (proximity_dedup, """
        with g as (select user_id, list_reduce(list([struct_pack(x := value, token := event_type)] order by value, event_type), lambda acc, y:
            case when y[1].x - acc[-1].x >= 5 then list_concat(acc, y) when length(y[1].token) > length(acc[-1].token) then list_concat(acc[1:-2], y) else acc end) as kept
            from events group by user_id)
        select user_id, k.x as x, k.token as token from (select user_id, unnest(kept) as k from g)"""),
    "coverage_diff": (coverage_diff, f"""
        with {LOCATED} select event_id, user_id, measure, event_type from located l
        where not exists (select 1 from located k where k.event_id % 2 = 0 and k.user_id = l.user_id and k.measure is not distinct from l.measure and k.event_type = l.event_type)"""),
    "greedy_near_dup": (greedy_near_dup, """
        with r as (select user_id, [struct_pack(late := case when event_type = 'purchase' then 0 else 1 end, id := event_id, p := value)] as i from events),
        g as (select user_id, list_reduce(list(i order by i[1].late, i[1].id), lambda acc, y:
            case when y[1].late = 0 or len(list_filter(acc, lambda a: abs(a.p - y[1].p) < 0.5)) = 0 then list_concat(acc, y) else acc end) as kept from r group by user_id)
        select user_id, k.id as event_id, k.p as value from (select user_id, unnest(kept) as k from g) where k.late = 1"""),
    "near_anti": (near_anti, """
        select event_id, user_id, event_type, value from events e where event_type <> 'purchase'
        and not exists (select 1 from events k where k.event_type = 'purchase' and k.user_id = e.user_id and abs(k.value - e.value) < 0.5)"""),
    "ink_islands": (ink_islands, """
        with c as (select user_id, cast(floor(value) as int) as x, count(*) as ink from events group by all),
        f as (select *, case when x - lag(x) over (partition by user_id order by x) <= 10 then 0 else 1 end as fresh from c),
        i as (select *, cast(sum(fresh) over (partition by user_id order by x) as int) as island from f)
        select user_id, island, min(x) as x_left, max(x) as x_right, cast(sum(ink) as bigint) as ink from i group by all"""),
    "upper_median_groups": (upper_median_groups, """
        with g as (select o_custkey, o_orderkey, o_orderkey - lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as gap from orders),
        m as (select o_custkey, 1.8 * list_sort(list(gap))[count(*) // 2 + 1] as threshold from g where gap is not null group by o_custkey),
        s as (select o_custkey, o_orderkey, sum(case when gap <= threshold then 0 else 1 end) over (partition by o_custkey order by o_orderkey) as system from g left join m using (o_custkey)),
        p as (select o_custkey, o_orderkey, cast(system as bigint) as system, row_number() over (partition by o_custkey, system order by o_orderkey) as place from s)
        select * from p where place <= 2"""),
    "nearest_below": (nearest_below, """
        with b as (select user_id, value, min(event_id) as id from events where event_type = 'signup' group by all)
        select event_id, e.user_id, b.id as line_id, round(b.value - e.value, 6) as gap
        from (select * from events where event_type = 'click') e asof join b on e.user_id = b.user_id and e.value <= b.value where b.value - e.value between 2 and 20"""),
    "active_attribute": (active_attribute, """
        select event_id, user_id, last_value(case when event_type = 'signup' then value end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as active from events"""),
    "bracket_fill": (bracket_fill, """
        with e as (select *, case when event_type = 'error' then event_id end as m from events)
        select event_id, coalesce(last_value(m ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), -1) as before_id,
            coalesce(first_value(m ignore nulls) over (partition by user_id order by event_id rows between 1 following and unbounded following), 1000000000) as after_id,
            coalesce(last_value(m ignore nulls) over (partition by user_id order by event_id rows unbounded preceding),
                first_value(m ignore nulls) over (partition by user_id order by event_id rows between 1 following and unbounded following), -1) as nearest from e"""),
    "leading_trim_renumber": (leading_trim_renumber, """
        with s as (select *, min(case when o_orderstatus = 'F' then o_orderkey end) over (partition by o_custkey) as start from orders)
        select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as number from s where o_orderkey >= start"""),
    "section_letters": (section_letters, """
        with n as (select *, row_number() over (partition by o_custkey order by o_orderkey) as number from orders),
        g as (select o_custkey, max(number) as top, min(case when o_orderstatus = 'P' then number end) as refrain from n group by all),
        s as (select o_custkey, list_concat(case when refrain is null then [1] else [1, refrain] end, range(coalesce(refrain, 1) + 4, top + 1, 4))[1:26] as places from g)
        select o_custkey, places[i] as measure, chr(cast(64 + i as int)) as letter, i > 1 as breaks from s, lateral (select unnest(range(1, len(places) + 1)) as i)"""),
    "drop_repeats": (drop_repeats, """
        with l as (select *, lag(event_type) over (partition by user_id order by event_id) as before from events)
        select event_id, user_id, event_type from l where before is distinct from event_type or before is null"""),
    "part_ranking": (part_ranking, """
        with p as (select l_orderkey, l_suppkey, count(*) as n_lines, sum(l_quantity) as quantity from lineitem group by all)
        select * from p qualify row_number() over (partition by l_orderkey order by n_lines desc, quantity desc, l_suppkey desc) = 1"""),
    "snap_grid": (snap_grid, "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round_even(l_discount * l_quantity * 4, 0) / 4.0 as snapped from lineitem"),
    "redistribute": (redistribute, """
        with recursive n as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag as flag, l_tax, cast(floor(l_discount * 40) as double) as pos from lineitem),
        place as (select l_orderkey, flag, list_sort(list_distinct(list(round_even(l_tax * 10 * 4.0::double * 4, 0) / 4.0::double))) as p from n group by all),
        taken as (select l_orderkey, list_distinct(list(pos)) as t from n group by all),
        s as (select *, count(*) over w > 1 as same, min(row(l_linenumber, l_partkey, l_suppkey)) over w as lead from n window w as (partition by l_orderkey, pos)),
        i as (select s.*, p, row_number() over (partition by l_orderkey order by lead, l_linenumber, l_partkey, l_suppkey) as rn from s join place using (l_orderkey, flag) where same),
        fold as (
            select l_orderkey, cast(0 as bigint) as rn, t, cast(null as integer) as l_linenumber, cast(null as bigint) as l_partkey, cast(null as bigint) as l_suppkey, '' as flag, cast(null as double) as pos, cast(null as double) as best from taken
            union all
            select l_orderkey, rn, case when best is null then t else list_append(list_filter(t, lambda x: x <> pos), best) end, l_linenumber, l_partkey, l_suppkey, flag, pos, best
            from (select i.l_orderkey, i.rn, f.t, i.l_linenumber, i.l_partkey, i.l_suppkey, i.flag, i.pos,
                list_filter(list_sort(list_transform(list_filter(i.p, lambda q: q <> i.pos and not list_contains(f.t, q)), lambda q: [abs(q - i.pos), q])), lambda q: true)[1][2] as best
                from fold f join i on i.l_orderkey = f.l_orderkey and i.rn = f.rn + 1)
        )
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, flag, coalesce(best, pos) as "at", best is not null as moved from fold where rn > 0
        union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, flag, pos as "at", false from s where not same"""),
}
