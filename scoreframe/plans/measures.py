"""Queries on measures: flags, reports, fingerprints, alignment, truth and repairs. Customers stand for songs, orders for measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreframe.functions.text import naked_percent
from scoreframe.operators import align, flags, labels, overlay, repair
from scoreframe.sources.tables import read

REASONS = ("view", "signup", "click", "error", "purchase")


def _measures(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") != "A").alias("notes"), F.count_if(F.col("l_linestatus") == "O").alias("chords"), F.count_if(F.col("l_quantity") > 25).alias("lyrics")
    )
    o = read(spark, sf, "orders").withColumn("number", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    ql = F.floor(F.col("o_totalprice") / 100000).cast("double")
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_custkey", "number", "o_orderkey", ql.alias("ql"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("notes", "chords", "lyrics")])


MEASURES = """
l as (select l_orderkey, count(*) filter (l_returnflag <> 'A') as notes, count(*) filter (l_linestatus = 'O') as chords, count(*) filter (l_quantity > 25) as lyrics from lineitem group by all),
m as (select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as number, o_orderkey, floor(o_totalprice / 100000) as ql, coalesce(notes, 0) as notes, coalesce(chords, 0) as chords, coalesce(lyrics, 0) as lyrics
    from orders left join l on o_orderkey = l_orderkey)"""


def suspicious(spark: SparkSession, sf: str) -> DataFrame:
    out = flags.suspicious(_measures(spark, sf), ["o_custkey"], "number", "notes", "chords", "lyrics", "ql")
    return out.select("o_custkey", F.col("measure").cast("long").alias("measure"), "reason")


def flag_pivot_totals(spark: SparkSession, sf: str) -> DataFrame:
    return flags.flag_table(read(spark, sf, "events").select("user_id", "event_type"), "user_id", "event_type", list(REASONS))


def survey(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as songs with their status by label, by share of lines that end without a mark."""
    d = read(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    d = d.select("doc_id", F.size("lines").alias("notes"), F.size(F.filter("lines", lambda x: ~x.endswith("."))).alias("naked"))
    out = flags.with_status(d, read(spark, sf, "labels").dropDuplicates(["doc_id"]), "doc_id", F.col("quality") == 0)
    return out.select("doc_id", F.col("notes").cast("long").alias("notes"), F.col("naked").cast("long").alias("naked"), F.round(naked_percent(F.col("naked"), F.col("notes")), 6).alias("percent"), "status").orderBy(F.desc_nulls_last("naked"), "doc_id")


def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "lineitem").withColumns({"ql": F.col("l_tax") * 50, "midi": F.col("l_quantity").cast("int") + 40})
    out = align.fingerprints(n, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "ql", "midi", F.col("l_returnflag") == "R")
    return out.select("l_orderkey", F.col("notes").cast("long").alias("notes"), "duration", F.col("first_midi").cast("long").alias("first_midi"), "shape")


FINGERPRINTS = """
n as (select *, l_tax * 50 as ql, cast(l_quantity as int) + 40 as midi, l_returnflag = 'R' as rest from lineitem),
f as (select l_orderkey, count(*) filter (not rest) as notes, round_even(coalesce(sum(ql) filter (not rest), 0), 2) as duration,
    coalesce(arg_min(midi, row(l_linenumber, l_partkey, l_suppkey, l_extendedprice)) filter (not rest), -1) as first_midi,
    coalesce(string_agg(case when rest then 'r' when ql >= 4 then 'W' when ql >= 2 then 'h' when ql >= 1 then 'q' when ql >= 0.5 then 'e' when ql > 0 then 's' end, ' ' order by l_linenumber, l_partkey, l_suppkey, l_extendedprice), '') as shape
    from n group by l_orderkey)"""


def truth_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders against a truth derived from their status: true priorities of finished orders, all statuses."""
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.array("o_orderpriority").alias("chords"), F.array("o_orderstatus", F.lit("x")).alias("lyrics"))
    fixed = F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit("1-urgent"))).otherwise(F.transform("chords", overlay.key_of_chord))
    truth = o.where("o_orderkey % 3 <> 0").select("o_custkey", F.col("o_orderkey"), F.when(F.col("o_orderkey") % 7 != 0, fixed).alias("t_chords"), F.transform("lyrics", overlay.key_of_lyric).alias("t_lyrics"))
    actual = o.where("o_orderkey % 11 <> 0").select("o_custkey", "o_orderkey", F.transform("chords", overlay.key_of_chord).alias("chords"), F.transform("lyrics", overlay.key_of_lyric).alias("lyrics"))
    compared = overlay.compare(truth, actual, ["o_custkey", "o_orderkey"], {"chord": ("t_chords", "chords"), "lyric": ("t_lyrics", "lyrics")})
    return overlay.score(compared, ["o_custkey"], ["chord", "lyric"])


def truth_overlay(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    truth = o.where("o_orderkey % 4 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 8 == 0, "X").alias("o_orderstatus"), F.lit("0").alias("o_orderpriority"))
    return overlay.overlay(o, truth, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


def measure_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Second and third measures of every song are one; their notes follow each other."""
    m = _measures(spark, sf)
    bars = m.select("o_custkey", "number", "ql")
    notes = m.select("o_custkey", "number", "o_orderkey", F.lit(0.5).alias("offset"))
    spec = bars.where("number in (2, 3)").select("o_custkey", F.lit(1).alias("grp"), "number")
    moved, kept = repair.merge_measures(notes, bars, spec, ["o_custkey"], "number", "offset", "ql")
    return moved.join(kept, ["o_custkey", "number"]).select("o_custkey", F.col("number").cast("long").alias("number"), "o_orderkey", "offset", "ql")


def rest_injection(spark: SparkSession, sf: str) -> DataFrame:
    key = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    n = read(spark, sf, "lineitem").withColumn("cap", repair.rest_capacity(F.col("l_tax") * 25))
    out = repair.take_capacity(n, ["l_orderkey"], key, F.col("cap"), F.lit(10))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("taken").cast("long").alias("taken"))


def even_spread(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select("o_orderkey", F.array(F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("b")), F.substring("o_orderpriority", 1, 1)).alias("items"))
    return repair.spread(o, "items", F.lit(4.0)).select("o_orderkey", "item", F.round("offset", 6).alias("offset"))


def lone_verse_swap(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "conversations").withColumn("verse", F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3))
    c = c.withColumn("pair", F.floor(F.col("turn") / 2) * 0 + F.floor((F.col("turn") + F.col("conv_id") % 2) / 2))
    out = repair.swap_lone_verse(c, ["conv_id", "pair"], "verse")
    return out.select("conv_id", "turn", F.col("verse").cast("long").alias("verse"), "swapped")


def vocal_floor(spark: SparkSession, sf: str) -> DataFrame:
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    n = read(spark, sf, "lineitem").withColumn("midi", F.col("l_quantity").cast("int") + 30)
    n = n.select(*key, F.when(F.col("l_returnflag") == "R", "chord").when(F.col("l_returnflag") == "A", "note").otherwise("rest").alias("kind"), F.when(F.col("l_returnflag") == "R", F.array("midi", F.col("midi") - 7)).when(F.col("l_returnflag") == "A", F.array("midi")).otherwise(F.array().cast("array<int>")).alias("pitches"))
    out = repair.vocal_line(n, "kind", "pitches")
    return out.select(*key, "kind", F.array_max("pitches").cast("long").alias("top"), "action")


def tuplet_strip(spark: SparkSession, sf: str) -> DataFrame:
    """Pages in which paragraphs don't open as often as they close lose all of those tags."""
    p = read(spark, sf, "pages").select("page_id", repair.strip_unbalanced(F.col("html"), "<p>", "</p>", ["</?p>"]).alias("x"), "html")
    return p.select("page_id", F.md5(F.col("x").cast("binary")).alias("digest"), (F.length("html") - F.length("x")).cast("long").alias("removed"))


def label_verbs(spark: SparkSession, sf: str) -> DataFrame:
    """Sources are classes: two are renamed, one is deleted; classes of few documents go, and the rest is counted."""
    d = read(spark, sf, "documents").select("doc_id", F.col("source").alias("label"))
    mapping = spark.createDataFrame([("src1", "src2"), ("src3", None)], "old string, new string")
    return labels.class_counts(labels.rename(d, "label", mapping), "label", 10).orderBy(F.desc("n"), "label")


def label_filters(spark: SparkSession, sf: str) -> DataFrame:
    x = read(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("correct_label"), F.when(F.col("event_id") % 4 != 0, (F.col("value") / 500).cast("string")).otherwise("").alias("conf"), F.concat("event_type", F.when(F.col("event_id") % 5 == 0, "#").otherwise("")).alias("guess"))
    return x.select("event_id", labels.low_confidence(F.col("conf")).alias("low"), labels.unlabelled(F.col("correct_label")).alias("blank"), labels.altered(F.col("guess")).alias("altered"), labels.accept(F.col("correct_label"), F.col("guess"), F.col("conf"), 0.85).alias("accepted"))


def inspect_profile(spark: SparkSession, sf: str) -> DataFrame:
    return flags.profile(read(spark, sf, "lineitem"), ["l_suppkey"], {
        "n": F.count("*"), "n_rests": F.count_if(F.col("l_returnflag") == "R"), "low": F.min("l_quantity"), "high": F.max("l_quantity"), "orders": F.count_distinct("l_orderkey"), "kinds": F.count_distinct("l_returnflag"),
    })


QUERIES = {
    "suspicious": (suspicious, f"""
        with {MEASURES},
        c as (select o_custkey, ql, count(*) as n, min(number) as first from m group by all),
        u as (select o_custkey, arg_min(ql, struct_pack(n := -n, f := first)) as usual from c group by all),
        x as (select m.*, usual, sum(lyrics) over (partition by m.o_custkey) as total from m join u using (o_custkey)),
        y as (select x.*, b.lyrics as lb, a.lyrics as la from x left join m b on b.o_custkey = x.o_custkey and b.number = x.number - 1 left join m a on a.o_custkey = x.o_custkey and a.number = x.number + 1)
        select o_custkey, number as measure, 'all_rests_with_chords' as reason from y where notes = 0 and chords > 0
        union all select o_custkey, number, 'duration_mismatch' from y where abs(ql - usual) > 0.01 and ql > 0
        union all select o_custkey, number, 'missing_lyrics' from y where total > 10 and notes > 0 and lyrics = 0 and lb > 0 and la > 0"""),
    "flag_pivot_totals": (flag_pivot_totals, f"""
        select case when grouping(user_id) = 1 then 'TOTAL' else cast(user_id as varchar) end as user_id, {', '.join(f"count(*) filter (event_type = '{r}') as {r}" for r in REASONS)}, count(*) as total from events group by rollup (user_id)"""),
    "survey": (survey, """
        with d as (select doc_id, len(string_split(text, chr(10))) as notes, len(list_filter(string_split(text, chr(10)), lambda x: not suffix(x, '.'))) as naked from documents)
        select d.doc_id, notes, naked, round(case when notes = 0 then 0.0 else 100.0 * naked / notes end, 6) as percent, case when l.doc_id is null then 'missing' when quality = 0 then 'error' else 'ok' end as status
        from d left join labels l using (doc_id)"""),
    "fingerprints": (fingerprints, f"with {FINGERPRINTS} select * from f"),
    "truth_compare": (truth_compare, """
        with t as (select o_custkey, o_orderkey, case when o_orderkey % 7 <> 0 then case when o_orderkey % 5 = 0 then ['1-urgent'] else [lower(replace(trim(o_orderpriority), ' ', ''))] end end as tc, [lower(o_orderstatus), 'x'] as tl from orders where o_orderkey % 3 <> 0),
        a as (select o_orderkey, [lower(replace(trim(o_orderpriority), ' ', ''))] as c, [lower(o_orderstatus), 'x'] as l from orders where o_orderkey % 11 <> 0),
        j as (select o_custkey, tc, case when tc is not null then tc = coalesce(c, []) end as chord_match, tl = coalesce(l, []) as lyric_match from t left join a using (o_orderkey))
        select o_custkey, count(*) filter (chord_match) as chord_ok, count(*) filter (lyric_match) as lyric_ok, count(chord_match) as chord_total, count(lyric_match) as lyric_total, bool_and(coalesce(chord_match, true) and lyric_match) as all_match from j group by all"""),
    "truth_overlay": (truth_overlay, """
        select o_orderkey, case when o_orderkey % 8 = 0 then 'X' else o_orderstatus end as o_orderstatus, case when o_orderkey % 4 = 0 then '0' else o_orderpriority end as o_orderpriority, o_orderkey % 4 = 0 as corrected from orders"""),
    "measure_merge": (measure_merge, f"""
        with {MEASURES}, t as (select o_custkey, sum(ql) as total, min(ql) filter (number = 2) as shift from m where number in (2, 3) group by all)
        select m.o_custkey, case when number = 3 then 2 else number end as number, o_orderkey, case when number = 3 then 0.5 + shift else 0.5 end as "offset", case when number in (2, 3) then total else ql end as ql from m left join t using (o_custkey)"""),
    "rest_injection": (rest_injection, """
        with c as (select *, greatest(1, cast(trunc(l_tax * 25 / 0.25) as int)) as cap from lineitem)
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, cast(least(cap, greatest(10 - coalesce(sum(cap) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice rows between unbounded preceding and 1 preceding), 0), 0)) as bigint) as taken from c"""),
    "even_spread": (even_spread, """
        with i as (select o_orderkey, unnest([o_orderstatus, case when o_orderkey % 2 = 0 then 'b' end, left(o_orderpriority, 1)]) as item, unnest([0, 1, 2]) as i from orders)
        select o_orderkey, item, round(i * (4.0::double / 3), 6) as "offset" from i where item is not null"""),
    "lone_verse_swap": (lone_verse_swap, """
        with c as (select *, case role when 'user' then 1 when 'assistant' then 2 else 3 end as v, (turn + conv_id % 2) // 2 as pair from conversations),
        s as (select *, count(*) filter (v = 1) over (partition by conv_id, pair) = 0 and v = 2 as swapped from c)
        select conv_id, turn, cast(case when swapped then 1 else v end as bigint) as verse, swapped from s"""),
    "vocal_floor": (vocal_floor, """
        with n as (select *, cast(l_quantity as int) + 30 as midi, case l_returnflag when 'R' then 'chord' when 'A' then 'note' else 'rest' end as k from lineitem)
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, case when k = 'rest' or midi < 52 then 'rest' else 'note' end as kind, cast(case when k <> 'rest' and midi >= 52 then midi end as bigint) as top,
            case when k = 'chord' and midi < 52 then 'chord_to_rest' when k = 'note' and midi < 52 then 'note_to_rest' when k = 'chord' then 'chord_to_note' end as action from n"""),
    "tuplet_strip": (tuplet_strip, """
        with x as (select page_id, html, case when len(string_split(html, '<p>')) = len(string_split(html, '</p>')) then html else regexp_replace(html, '</?p>', '', 'g') end as x from pages)
        select page_id, md5(x) as digest, length(html) - length(x) as removed from x"""),
    "label_verbs": (label_verbs, """
        with r as (select case source when 'src1' then 'src2' else source end as label from documents where source <> 'src3') select label, count(*) as n from r group by label having count(*) >= 10"""),
    "label_filters": (label_filters, """
        with x as (select event_id, case when event_id % 3 <> 0 then event_type end as label, case when event_id % 4 <> 0 then value / 500 end as conf, event_type || case when event_id % 5 = 0 then '#' else '' end as guess from events)
        select event_id, coalesce(conf, 0) < 0.7 as low, label is null as blank, regexp_matches(guess, '[#+]|dim|aug') as altered, case when label is null and coalesce(conf, 0) >= 0.85 then guess else label end as accepted from x"""),
    "inspect_profile": (inspect_profile, """
        select l_suppkey, count(*) as n, count(*) filter (l_returnflag = 'R') as n_rests, min(l_quantity) as low, max(l_quantity) as high, count(distinct l_orderkey) as orders, count(distinct l_returnflag) as kinds from lineitem group by all"""),
}
