"""Queries that align sequences: turns of conversations as lyrics, parts as pitch streams, customers as songs whose measures are orders.

The SQL fills each table of sums row by row and walks it back, cell by cell; likenesses of distinct strings come from longest matches, and those before and
after them. Both are recursive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.functions import lyrics
from scoreframe.operators import align, truth
from scoreframe.plans.lyric_text import TOKENS
from scoreframe.plans.measures import FINGERPRINTS, fingerprints
from scoreframe.sources.tables import read

LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _beside(df: DataFrame, key: str, left: str, right: str, kind: str) -> DataFrame:
    """df's sequences aligned with those of the next key, called right."""
    after = df.select((F.col(key) - 1).alias(key), *(F.col(c).alias(right + c) for c in df.columns if c != key))
    return align.align_columns(align.dealt(df, key).join(align.dealt(after, key), key), left, right + left, kind)


def nw_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn and the next, aligned."""
    c = read(spark, sf, "conversations").select("conv_id", "turn", lyrics.tokens(F.col("text")).alias("t"))
    left, right = (align.dealt(x, "conv_id", "turn") for x in (c, c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))))
    out = align.align_columns(left.join(right, ["conv_id", "turn"]), "t", "u", "tokens")
    return out.select("conv_id", "turn", F.round("alignment.cost", 6).alias("cost"), F.size("alignment.pairs").cast("long").alias("n_entries"))


def nw_pitch(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' quantity streams of neighbouring parts aligned; entries of the right alone with their bracket."""
    q = F.col("l_quantity").cast("int")
    note = F.struct((q % 7).alias("step"), F.lit(0).alias("alter"), F.floor(q / 7).cast("int").alias("octave"))
    n = read(spark, sf, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", note.alias("n")))).alias("x"))
    n = n.select("l_partkey", F.transform("x", lambda i: i["n"]).alias("notes"), F.transform("x", lambda i: i["l_orderkey"]).alias("measures"))
    rows = _beside(n, "l_partkey", "notes", "next_", "pitches").select("l_partkey", "measures", F.posexplode("alignment.pairs").alias("at", "p")).select("l_partkey", "measures", "at", "p.li", "p.ri")
    out = align.recovery_candidates(rows, ["l_partkey"], F.when(F.col("li").isNotNull(), F.get("measures", F.col("li"))))
    return out.select("l_partkey", F.col("ri").cast("long").alias("ri"), "prev_measure", "next_measure")


def _measures_aligned(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of each customer's orders aligned with those of the next by fingerprint, with what filling from the second would do."""
    f = fingerprints(spark, sf).select("l_orderkey", F.struct("notes", "duration", "first_midi", "shape").alias("f"))
    o = read(spark, sf, "orders").join(f, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "f"))).alias("x"))
    o = o.select("o_custkey", F.transform("x", lambda i: i["f"]).alias("f"), F.transform("x", lambda i: i["o_orderkey"]).alias("keys"))
    rows = _beside(o, "o_custkey", "f", "next_", "measures").select("o_custkey", "f", "keys", "next_f", "next_keys", F.posexplode("alignment.pairs").alias("at", "p"))
    at = lambda c, i: F.when(F.col(i).isNotNull(), F.get(c, F.col(i)))
    rows = rows.select("o_custkey", "at", "p.li", "p.ri", "p.cost", "f", "keys", "next_f", "next_keys")
    paired = F.col("li").isNotNull() & F.col("ri").isNotNull()
    rows = rows.select("o_custkey", "at", "li", "ri", F.when(paired, 1 - F.col("cost")).alias("s"), at("f", "li")["notes"].alias("notes"), at("next_f", "ri")["notes"].alias("n2"), at("keys", "li").alias("measure"), at("next_keys", "ri").alias("other"))
    return align.fill_decision(align.neighbour_confidence(rows, ["o_custkey"], "s"), "confidence", "notes", "n2")


def nw_measures(spark: SparkSession, sf: str) -> DataFrame:
    out = _measures_aligned(spark, sf)
    return out.select("o_custkey", *(F.col(c).cast("long").alias(c) for c in ("at", "li", "ri")), F.round("confidence", 6).alias("confidence"), "action")


def alignment_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's pairs and gaps on either side."""
    return align.alignment_counts(_measures_aligned(spark, sf), ["o_custkey"])


def secondary_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Measures of rests alone take the notes of the measure that they are aligned with in the next song, where their neighbours agree."""
    rows = _measures_aligned(spark, sf).withColumnRenamed("o_custkey", "song")
    kind = F.when(F.col("l_returnflag") != "R", "note").otherwise("rest")
    own = read(spark, sf, "lineitem").join(read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("song")), F.col("l_orderkey") == F.col("o_orderkey"))
    own = own.select("song", F.col("l_orderkey").alias("measure"), kind.alias("kind"), F.col("l_linenumber").cast("double").alias("start"), F.array(F.col("l_quantity").cast("int") + 40).alias("pitches"), *LINE)
    filled, _ = truth.fill_empty(rows, own, own.withColumn("song", F.col("song") - 1), ["song"])
    return filled.where("filled").select("song", "measure", *LINE, F.col("pitches")[0].cast("long").alias("midi"))


def table_sql(gap: float, eps: float = 0) -> str:
    """CTEs sums and walk, of pair (id, n, m) and costs (id, i, c: the costs of left item i with each right item): entries of walk have back > 0, counted from the end."""
    same = lambda x: f"abs({x} - h.r[w.j + 1]) < {eps}" if eps else f"{x} = h.r[w.j + 1]"
    g = f"{gap}::double"
    return f"""
sums as (
    select id, 0 as i, list_reduce(list_transform(range(0, m + 1), lambda j: [0.0::double]), lambda r, e: list_append(r, r[len(r)] + {g})) as r from pair
    union all
    select s.id, s.i + 1, list_reduce(list_prepend([s.r[1] + {g}], list_transform(range(1, len(s.r)), lambda j: [least(s.r[j] + c.c[j], s.r[j + 1] + {g})])), lambda r, e: list_append(r, least(e[1], r[len(r)] + {g})))
    from sums s join costs c on c.id = s.id and c.i = s.i + 1
), walk as (
    select id, 0 as back, n as i, m as j, cast(null as bigint) as li, cast(null as bigint) as ri, cast(null as double) as cost from pair
    union all
    select id, back + 1, i - cast(step < 2 as int), j - cast(step <> 1 as int), case when step < 2 then i - 1 end, case when step <> 1 then j - 1 end, case when step = 0 then c end
    from (
        select w.id, w.back, w.i, w.j, c.c[w.j] as c, case when w.i > 0 and w.j > 0 and {same("(u.r[w.j] + c.c[w.j])")} then 0 when w.i > 0 and {same(f"(u.r[w.j + 1] + {g})")} then 1 else 2 end as step
        from walk w join sums h on h.id = w.id and h.i = w.i left join sums u on u.id = w.id and u.i = w.i - 1 left join costs c on c.id = w.id and c.i = w.i
        where w.i > 0 or w.j > 0
    )
)"""


#: CTE ratio (x, y, r) of the pairs of strings (a, b) in needed, of up to 63 characters.
RATIO = """
cand as (select n, list([s, k] order by k desc, s) as c from (select unnest(range(1, 64)) as n), lateral (select unnest(range(1, n + 1)) as s), lateral (select unnest(range(1, n - s + 2)) as k) group by n),
seg as (
    select a as x, b as y, a, b, cast(0 as bigint) as k from needed
    union all
    select x, y, a, b, k from (
        select x, y, unnest([substr(a, 1, s - 1), substr(a, s + k)]) as a, unnest([substr(b, 1, strpos(b, substr(a, s, k)) - 1), substr(b, strpos(b, substr(a, s, k)) + k)]) as b, unnest([k, 0]) as k
        from (select x, y, a, b, f[1] as s, f[2] as k from (select x, y, a, b, list_filter(c, lambda p: strpos(b, substr(a, p[1], p[2])) > 0)[1] as f from seg join cand on n = length(a) where b <> '') where f is not null)
    )
), ratio as (select x, y, case when x = '' and y = '' then 1.0::double else 2 * sum(k) / cast(length(x) + length(y) as double) end as r from seg group by x, y)"""

MEASURES_ALIGNED = f"""
{FINGERPRINTS}, o as (select o_custkey as id, row_number() over (partition by o_custkey order by o_orderkey) as i, o_orderkey, f.* from orders join f on l_orderkey = o_orderkey),
size as (select id, count(*) as n from o group by id), pair as (select a.id, a.n, b.n as m from size a join size b on b.id = a.id + 1),
needed as (select distinct x.shape as a, y.shape as b from o x join o y on y.id = x.id + 1), {RATIO},
costs as (
    select x.id, x.i, list(1 - case when x.notes = 0 and y.notes = 0 then 1.0::double else 0.40::double * r + 0.25::double * (1 - abs(x.notes - y.notes) / greatest(x.notes, y.notes, 1)::double)
        + 0.20::double * greatest(0.0::double, 1 - abs(x.duration - y.duration) / greatest(x.duration, y.duration, 1)::double)
        + 0.15::double * case when x.first_midi >= 0 and y.first_midi >= 0 then greatest(0.0::double, 1 - abs(x.first_midi - y.first_midi) / 7.0::double) else 0.5::double end end order by y.i) as c
    from o x join o y on y.id = x.id + 1 join ratio on ratio.x = x.shape and ratio.y = y.shape group by x.id, x.i
), {table_sql(1.2, 1e-9)},
e as (select id, max(back) over (partition by id) - back as place, li, ri, 1 - cost as s from walk where back > 0),
sc as (select e.*, x.notes, y.notes as n2, x.o_orderkey as measure, y.o_orderkey as other, sum(s) over past as s1, sum(s) over next as s2, count(s) over past + count(s) over next as k
    from e left join o x on x.id = e.id and x.i = li + 1 left join o y on y.id = e.id + 1 and y.i = ri + 1
    window past as (partition by e.id order by place rows between 3 preceding and 1 preceding), next as (partition by e.id order by place rows between 1 following and 3 following)),
decided as (select *, case when k > 0 then (coalesce(s1, 0) + coalesce(s2, 0)) / k else 0.0 end as confidence from sc),
acted as (select *, case when li is null or ri is null then null when notes > 0 then 'has_notes' when n2 = 0 then 'ignored' when confidence < 0.55 then 'skipped_low_confidence' else 'filled' end as action from decided)"""

QUERIES = {
    "nw_tokens": (nw_tokens, f"""
        with recursive t as (select conv_id, turn, list_transform({TOKENS.format('text')}, lambda w: lower(w)) as t from conversations),
        pair as (select row_number() over () as id, a.conv_id, a.turn, a.t as a, b.t as b, len(a.t) as n, len(b.t) as m from t a join t b on b.conv_id = a.conv_id and b.turn = a.turn + 1),
        l as (select id, unnest(a) as x, unnest(range(1, n + 1)) as i from pair), r as (select id, unnest(b) as y, unnest(range(1, m + 1)) as j from pair),
        needed as (select distinct x as a, y as b from l join r using (id)), {RATIO},
        costs as (select id, i, list(1 - r order by j) as c from l join r using (id) join ratio using (x, y) group by id, i), {table_sql(0.6)},
        count as (select id, max(back) as n_entries from walk group by id)
        select conv_id, turn, round(h.r[m + 1], 6) as cost, cast(n_entries as bigint) as n_entries from pair p join sums h on h.id = p.id and h.i = n join count c on c.id = p.id"""),
    "nw_pitch": (nw_pitch, f"""
        with recursive q as (select l_partkey as id, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice) as i, l_orderkey, cast(l_quantity as int) as q from lineitem),
        size as (select id, count(*) as n from q group by id), pair as (select a.id, a.n, b.n as m from size a join size b on b.id = a.id + 1),
        costs as (select a.id, a.i, list(case when a.q % 7 <> b.q % 7 then 1.0::double when a.q = b.q then 0.0 when abs(a.q // 7 - b.q // 7) = 1 then 0.3 else 1.0 end order by b.i) as c
            from q a join q b on b.id = a.id + 1 group by a.id, a.i), {table_sql(0.5)},
        e as (select w.id, back, li, ri, case when li is not null and ri is not null then l_orderkey end as measure from walk w left join q on q.id = w.id and q.i = li + 1 where back > 0),
        f as (select *, last_value(measure ignore nulls) over (partition by id order by back desc rows between unbounded preceding and 1 preceding) as prev_measure,
            first_value(measure ignore nulls) over (partition by id order by back desc rows between 1 following and unbounded following) as next_measure from e)
        select id as l_partkey, ri, prev_measure, next_measure from f where li is null"""),
    "nw_measures": (nw_measures, f"""
        with recursive {MEASURES_ALIGNED} select id as o_custkey, cast(place as bigint) as at, li, ri, round(confidence, 6) as confidence, action from acted"""),
    "alignment_stats": (alignment_stats, f"""
        with recursive {MEASURES_ALIGNED}
        select id as o_custkey, count(*) filter (li is not null and ri is not null) as pairs, count(*) filter (li is null) as left_gaps, count(*) filter (ri is null) as right_gaps from acted group by id"""),
    "secondary_fill": (secondary_fill, f"""
        with recursive {MEASURES_ALIGNED}
        select id as song, measure, l_linenumber, l_partkey, l_suppkey, l_extendedprice, cast(cast(l_quantity as int) + 28 as bigint) as midi from acted join lineitem on l_orderkey = other
        where action = 'filled' and l_returnflag <> 'R'"""),
}
