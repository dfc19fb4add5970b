"""Queries on pitches: lines as notes, moved and spelled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.functions import pitch
from scoreframe.sources.tables import read

LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def transposition(spark: SparkSession, sf: str) -> DataFrame:
    """Each line's note, from double flats to double sharps, moved by up to a major seventh either way."""
    q = F.col("l_quantity").cast("int")
    n = read(spark, sf, "lineitem").select(*LINE, F.substring(F.lit("CDEFGAB"), q % 7 + 1, F.lit(1)).alias("step"), (F.col("l_partkey") % 5 - 2).cast("int").alias("alter"), F.floor(q / 7).cast("int").alias("octave"), (F.col("l_suppkey") % 23 - 11).cast("int").alias("move"))
    n = n.withColumn("to", pitch.transposed(F.col("step"), F.col("alter"), F.col("octave"), F.col("move")))
    cast = lambda c: F.col(c).cast("long")
    return n.select(*LINE, F.col("to.step").alias("step"), cast("to.alter").alias("alter"), cast("to.octave").alias("octave"), pitch.midi(F.col("to.step"), F.col("to.alter"), F.col("to.octave")).cast("long").alias("midi"))


def key_spelling(spark: SparkSession, sf: str) -> DataFrame:
    """Each line's number of semitones spelled in the key that its order gives."""
    n = read(spark, sf, "lineitem").select(*LINE, pitch.spelled(F.col("l_quantity").cast("int") + 40, F.when(F.col("l_orderkey") % 16 < 15, (F.col("l_orderkey") % 16 - 7).cast("int"))).alias("p"))
    return n.select(*LINE, "p.step", F.col("p.alter").cast("long").alias("alter"), F.col("p.octave").cast("long").alias("octave"))


#: By letters and semitones: an interval's letter, then whatever alteration makes its size.
QUERIES = {
    "transposition": (transposition, """
        with n as (select *, cast(l_quantity as int) % 7 as i, cast(l_partkey % 5 - 2 as int) as alter, cast(l_quantity as int) // 7 as octave, cast(l_suppkey % 23 - 11 as int) as move from lineitem),
        m as (select *, 12 * (octave + 1) + [0, 2, 4, 5, 7, 9, 11][i + 1] + alter + move as midi, 7 * octave + i + sign(move) * [0, 1, 1, 2, 2, 3, 3, 4, 5, 5, 6, 6][abs(move) + 1] as line from n),
        t as (select *, cast(floor(line / 7) as bigint) as o, cast(line - 7 * floor(line / 7) as bigint) as j from m)
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, substr('CDEFGAB', j + 1, 1) as step, cast(midi - 12 * (o + 1) - [0, 2, 4, 5, 7, 9, 11][j + 1] as bigint) as alter, o as octave, cast(midi as bigint) as midi from t"""),
    "key_spelling": (key_spelling, """
        with n as (select *, cast(l_quantity as int) + 40 as midi, case when l_orderkey % 16 < 15 then l_orderkey % 16 - 7 else 0 end as key from lineitem),
        name as (select j, a, ([0, 2, 4, -1, 1, 3, 5][j + 1] + 7 * a) as place, [0, 2, 4, 5, 7, 9, 11][j + 1] + a as semitone from unnest(range(0, 7)) t(j), unnest(range(-3, 4)) u(a))
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, substr('CDEFGAB', j + 1, 1) as step, cast(a as bigint) as alter, cast((midi - semitone) // 12 - 1 as bigint) as octave
        from n join name on (midi - semitone) % 12 = 0 and place between key - 5 and key + 6"""),
}
