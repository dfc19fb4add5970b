"""Chord rows read from events: a user is a strip, views and clicks are words, purchases bars, errors marks, signups lines; readings are digests of where a crop lies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.functions.chords import NON_CHORDS, ROW_CHORD, SLASH_CHORD
from scoreframe.operators import row_reading
from scoreframe.sources.tables import read

STRIP = 2500
WORDS = ("g7", "a", "Am7", "C/G", "tr", "D7", "Bb", "mf", "F#m", "x", "E", "Cmaj7", "dm", "A")
READINGS = ("A", "G7", "Am7", "SKIP", "F#dim", "Bb", "Dm7/F", "Cmaj7", "", "E+")


def _digest(key: Column) -> tuple[Column, Column]:
    """A reading and its confidence for a crop's key."""
    h = F.md5(key.cast("binary"))
    number = lambda i: F.conv(F.substring(h, i, 4), 16, 10).cast("int")
    return F.element_at(F.array(*map(F.lit, READINGS)), number(1) % len(READINGS) + 1), number(5) / 65535.0


def _read(crops: DataFrame) -> DataFrame:
    key = F.concat_ws(":", F.col("user_id").cast("string"), F.col("x").cast("int").cast("string"), F.col("crop").cast("string") if "crop" in crops.columns else F.lit("0"))
    chord, conf = _digest(key)
    return crops.withColumns({"chord": chord, "conf": conf})


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", "user_id", "event_type", "value", (F.col("event_id") * 7919 % 2440).cast("int").alias("left"))


def _tables(spark: SparkSession, sf: str) -> dict:
    e = _events(spark, sf)
    words = e.where("event_type in ('view', 'click')")
    window = F.col("event_id") % 3 == 2
    edge = F.when(window, F.floor(F.col("left") / 60) * 60).otherwise(0)
    text = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("event_id") % len(WORDS) + 1).cast("int"))
    passes = words.select("user_id", edge.cast("int").alias("edge"), (F.col("left") - edge).cast("int").alias("left"), (F.col("event_id") % 40).cast("int").alias("width"), (F.col("event_id") * 37 % 100).cast("double").alias("conf"), text.alias("text"))
    bars = e.where("event_type = 'purchase'").select("user_id", F.col("left").cast("double").alias("bx"), (F.floor(F.col("left") / 100) + 1).cast("int").alias("number"))
    marks = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("id"), F.col("left").cast("double").alias("x"), F.col("value").alias("y"), F.lit(None).cast("double").alias("w"), F.lit(None).cast("double").alias("h"))
    lines = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("line"), "value").withColumnRenamed("value", "y")
    return {"passes": passes, "strips": e.select("user_id", F.lit(STRIP).alias("strip_width")).distinct(), "bars": bars, "confirmed": e.where("event_type = 'purchase' and event_id % 5 = 0").select("user_id"), "marks": (marks, lines), "events": e}


def _ink(e: DataFrame) -> row_reading.Reader:
    """A window's ink: a hundredth for each event whose place lies in it."""

    def add(windows: DataFrame) -> DataFrame:
        at = e.select("user_id", F.explode(F.array(F.floor(F.col("left") / 30), F.floor(F.col("left") / 30) - 1)).alias("_k"), F.col("left").alias("_l"))
        w = windows.withColumn("_k", F.floor(F.col("x0") / 30))
        n = w.join(at, ["user_id", "_k"]).where("_l >= x0 and _l < x0 + w").groupBy("user_id", "x0").agg((F.count("*") / 100.0).alias("ink"))
        return windows.join(n, ["user_id", "x0"], "left").withColumn("ink", F.coalesce("ink", F.lit(0.0)))

    return add


def row_reading_query(spark: SparkSession, sf: str) -> DataFrame:
    t = _tables(spark, sf)
    out = row_reading.read_rows(t["passes"], t["strips"], t["bars"], t["confirmed"], ["user_id"], "user_id", _read, _ink(t["events"]), t["marks"])
    return out.select("user_id", "x", "value", "source", F.col("measure").cast("long").alias("measure"), F.round("frac", 6).alias("frac"))


def sweep_query(spark: SparkSession, sf: str) -> DataFrame:
    """What a sweep finds between the words of each strip as they stand, without a gate on ink."""
    t = _tables(spark, sf)
    words = row_reading.pass_tokens(t["passes"], ["user_id"], F.lit(True))
    return row_reading.sweep(row_reading.sweep_windows(t["strips"], words, ["user_id"]), ["user_id"], _read).select("user_id", "x", "token")


def mark_reading(spark: SparkSession, sf: str) -> DataFrame:
    t = _tables(spark, sf)
    return row_reading.read_marks(*t["marks"], ["user_id"], _read).select("user_id", F.col("id").alias("event_id"), F.col("line").alias("line_id"), "token")


def _sql_list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _read_sql(key: str) -> str:
    return f"""{_sql_list(READINGS)}[cast('0x' || substr(md5({key}), 1, 4) as int) % {len(READINGS)} + 1] as chord, cast('0x' || substr(md5({key}), 5, 4) as int) / 65535.0::double as conf"""


EVENTS = f"""
e as (select event_id, user_id, event_type, value, cast(event_id * 7919 % 2440 as int) as l from events),
sure as (select distinct user_id from e where event_type = 'purchase' and event_id % 5 = 0),
w as (select e.user_id, cast(l + (event_id % 40) // 2 as double) as x, event_id * 37 % 100 as conf, {_sql_list(WORDS)}[event_id % {len(WORDS)} + 1] as text, sure.user_id is not null as sure
    from e left join sure using (user_id) where event_type in ('view', 'click'))"""


def _words(bare: str) -> str:
    return f"""
f as (select user_id, x, conf, case when regexp_matches(text, '^[a-g]') and (length(text) > 1 or {bare}) and regexp_matches(upper(left(text, 1)) || substr(text, 2), '{ROW_CHORD}') then upper(left(text, 1)) || substr(text, 2) else text end as token from w),
tok as (select user_id, x, token, row_number() over (partition by user_id order by x, token) as i from f where conf >= 25 and regexp_matches(token, '{ROW_CHORD}'))"""


def _sweep(taken: str, gate: str) -> str:
    return f"""
win as (select user_id, x0, least(60, {STRIP} - x0) as w, cast(x0 + least(60, {STRIP} - x0) // 2 as double) as x from (select distinct user_id from e), lateral (select unnest(range(0, {STRIP}, 30)) as x0)),
open as (select * from win where not exists (select 1 from {taken} t where t.user_id = win.user_id and abs(t.x - win.x) < 35){gate}),
look as (select *, {_read_sql("user_id || ':' || cast(x as int) || ':0'")} from open),
cand as (select user_id, x, chord, row_number() over (partition by user_id order by x) as i from look where regexp_matches(chord, '{ROW_CHORD}') and conf >= case when length(chord) <= 2 then 0.90 else 0.82 end),
fold as (
    select user_id, i, x, chord, true as taken, x as last from cand where i = 1
    union all
    select c.user_id, c.i, c.x, c.chord, c.x - f.last >= 35, case when c.x - f.last >= 35 then c.x else f.last end from fold f join cand c on c.user_id = f.user_id and c.i = f.i + 1
)"""


MARKS = f"""
near as (select m.event_id, m.user_id, cast(m.l as double) as x, arg_min(s.event_id, row(s.value, s.event_id)) as line_id, min(s.value) - any_value(m.value) as gap
    from e m join e s on s.user_id = m.user_id and s.event_type = 'signup' and s.value >= m.value where m.event_type = 'error' group by all),
crop as (select *, {_read_sql("user_id || ':' || cast(x as int) || ':' || crop")} from near, lateral (select unnest(range(4)) as crop) where gap between 20 and 120),
mark as (select event_id, user_id, x, line_id, arg_max(chord, row(conf, -crop)) as token, max(conf) as conf from crop where conf > 0 and regexp_matches(chord, '{ROW_CHORD}') group by all having max(conf) >= 0.55)"""

QUERIES = {
    "row_reading": (row_reading_query, f"""
        with recursive {EVENTS}, {_words('sure')},
        thin as (
            select user_id, i, x, token, 0 as g from tok where i = 1
            union all
            select t.user_id, t.i, case when t.x - d.x < 25 and length(t.token) <= length(d.token) then d.x else t.x end, case when t.x - d.x < 25 and length(t.token) <= length(d.token) then d.token else t.token end,
                case when t.x - d.x < 25 then d.g else d.g + 1 end
            from thin d join tok t on t.user_id = d.user_id and t.i = d.i + 1
        ),
        kept as (select user_id, arg_max(x, i) as x, arg_max(token, i) as token from thin group by user_id, g),
        again as (select *, {_read_sql("user_id || ':' || cast(x as int) || ':0'")} from kept),
        fine as (select user_id, x, case when conf >= case when length(chord) <= 2 then 0.8 else 0.6 end then chord else token end as token,
            case when conf >= case when length(chord) <= 2 then 0.8 else 0.6 end then 'refined' else 'token' end as source from again),
        {_sweep('fine', " and (select count(*) from e where e.user_id = win.user_id and e.l >= win.x0 and e.l < win.x0 + win.w) / 100.0::double between 0.015 and 0.30")}, {MARKS},
        found as (select * from fine union all select user_id, x, chord, 'sweep' from fold where taken union all select user_id, x, token, 'mark' from mark),
        bar as (select user_id, l as bx, min(l // 100 + 1) as m from e where event_type = 'purchase' group by all), b as (select *, lag(bx, 1, 0.0) over (partition by user_id order by bx) as lx from bar),
        top as (select user_id, max_by(m, bx) as lm from bar group by all),
        placed as (select f.*, cast(coalesce(b.m, top.lm) as bigint) as measure, round(case when top.lm is null then null when b.bx is null then 0.99 when b.bx - b.lx <= 0 then 0.0 else least(greatest((f.x - b.lx) / (b.bx - b.lx), 0.0), 0.99) end, 6) as frac
            from found f asof left join b on f.user_id = b.user_id and f.x <= b.bx left join top on top.user_id = f.user_id)
        select user_id, x, token as value, source, measure, frac from placed
        where not (user_id not in (select user_id from sure) and regexp_matches(token, '^[A-G]$') and x < 280) and token <> '' and token not in ({', '.join(f"'{w}'" for w in NON_CHORDS)})
            and (regexp_matches(token, '{ROW_CHORD}') or regexp_matches(token, '{SLASH_CHORD}'))"""),
    "ink_sweep": (sweep_query, f"""
        with recursive {EVENTS}, {_words('true')}, {_sweep('tok', '')} select user_id, x, chord as token from fold where taken"""),
    "mark_reading": (mark_reading, f"with {EVENTS}, {MARKS} select user_id, event_id, line_id, token from mark"),
}
