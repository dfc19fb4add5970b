"""Note heads that lines stand for, put into the measures of their customers' songs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreframe.operators import heads
from scoreframe.operators.align import dealt
from scoreframe.sources.tables import read

SHAPES = ("WHOLE_NOTE", "NOTEHEAD_VOID", "NOTEHEAD_BLACK", "BREVE", "OTHER")


def head_insertion(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of flag N are notes that are there, others heads: some on staves without words, some linked, some without a measure."""
    numbered = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("song"), "o_orderkey", numbered.alias("number"), F.floor(F.col("o_totalprice") / 100000).cast("double").alias("length"))
    q, head = F.col("l_quantity").cast("int"), F.col("l_returnflag") != "N"
    # what a line brings moves as small numbers
    line = read(spark, sf, "lineitem").where("l_returnflag is not null").select(
        "l_orderkey", q.alias("q"), "l_linenumber", head.alias("head"),
        F.when(head, F.col("l_partkey")).alias("l_partkey"), F.when(head, F.col("l_suppkey")).alias("l_suppkey"), F.when(head, F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.when(head & (F.col("l_tax") > 0), F.col("l_discount") * 9).alias("frac"),
    )
    lines = line.join(o.select("song", "o_orderkey", "number"), F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey")
    measures = o.where("o_orderkey % 5 <> 0").select("song", "number", "length", F.lit(None).cast("boolean").alias("head"))
    songs = dealt(lines.unionByName(measures, allowMissingColumns=True), "song")
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (F.col("l_suppkey") % len(SHAPES) + 1).cast("int"))
    rows = songs.select(
        "song", "number", "length", F.when(F.col("head"), "head").when(~F.col("head"), "note").otherwise("measure").alias("what"), (F.col("l_linenumber") / 4.0).alias("at"), (F.col("q") % 30 + 45).cast("long").alias("pitch"),
        *[F.when(F.col("head"), c).alias(name) for name, c in {
            "sheet": F.col("number"), "staff": F.col("l_linenumber") % 4, "sung": F.col("l_linenumber") % 4 != 3, "id": F.concat_ws(":", "l_partkey", "l_suppkey", "l_linenumber", "cents"), "linked": F.col("l_partkey") % 3 == 0,
            "measure_global": F.when(F.col("l_suppkey") % 9 != 0, F.col("number")), "frac": F.col("frac"), "pitch_position": F.col("q") % 15 - 7, "shape": shape,
        }.items()],
    )
    return heads.insert_rows(rows).select("song", "sheet", "id", "offset", F.col("midi").cast("long").alias("midi"), "ql", "action")


QUERIES = {
    "head_insertion": (head_insertion, f"""
        with o as (select *, row_number() over (partition by o_custkey order by o_orderkey) as number from orders),
        l as (select l.*, o_custkey as song, number, cast(l_quantity as int) as q from lineitem l join o on l_orderkey = o_orderkey),
        m as (select o_custkey as song, number, case when floor(o_totalprice / 100000) = 0 then 4.0 else floor(o_totalprice / 100000) end as length from o where o_orderkey % 5 <> 0),
        h as (select l.song, l.number as sheet, l_linenumber % 4 as staff, l_partkey || ':' || l_suppkey || ':' || l_linenumber || ':' || cast(round(l_extendedprice * 100) as bigint) as id, l_partkey % 3 = 0 as linked,
            m.number as measure, round_even(case when l_tax > 0 then l_discount * 9 else 0.0 end * coalesce(m.length, 4.0::double) * 4, 0) / 4 as "offset", q % 15 - 7 + 34 as n,
            [4.0::double, 2.0, 1.0, 8.0, 1.0][l_suppkey % 5 + 1] as ql
            from l left join m on m.song = l.song and m.number = l.number and l_suppkey % 9 <> 0 where l_returnflag <> 'N'),
        p as (select *, 12 * (n // 7 + 1) + [0, 2, 4, 5, 7, 9, 11][n % 7 + 1] - 12 as midi from h),
        t as (select song, number, l_linenumber / 4.0 as at_, q % 30 + 45 as midi from l where l_returnflag = 'N'),
        r as (select *, case when staff = 3 then 'skipped_not_vocal' when linked then 'skipped_linked' when measure is null then 'skipped_no_measure'
            when exists (select 1 from t where t.song = p.song and t.number = p.measure and t.midi = p.midi and abs(t.at_ - p."offset") < 0.25) then 'skipped_duplicate' end as reason from p)
        select song, sheet, id, "offset", cast(midi as bigint) as midi, ql, coalesce(reason, case when row_number() over (partition by song, measure, "offset", midi, reason is null order by sheet, id) = 1 then 'inserted' else 'skipped_duplicate' end) as action from r"""),
}
