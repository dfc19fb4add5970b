"""Queries on chord labels: vocabulary, grammar, spellings, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.functions import chords, text
from scoreframe.operators import coverage, overlay
from scoreframe.sources.tables import read

VOCABULARY = """
vocabulary as (
    select distinct r || a || q || e as label from unnest(['C', 'D', 'E', 'F', 'G', 'A', 'B']) t1(r), unnest(['', '#', 'b']) t2(a), unnest(['', 'm', 'dim', '+']) t3(q),
        unnest(['', '6', '7', '9', '11', '13', 'maj7', '97', '65', 'sus4']) t4(e)
    where not (q = '+' and e in ('maj7', '11', '13')) and not (q = 'dim' and e in ('9', '11', '13', 'maj7'))
    union
    select r || a || s from unnest(['C', 'D', 'E', 'F', 'G', 'A', 'B']) t1(r), unnest(['', '#', 'b']) t2(a), unnest(['7(b5)', '7(b9)', '7(6)', '9(6)', '7sus4']) t3(s)
)"""

BODIES = ("", "m", "-", "mi", "min", "maj7", "t7", "M7", "t", "M", "m7", "-7", "m7b5", "-7b5", "0", "h", "dim", "o", "dim7", "o7", "aug", "+", "sus", "sus4", "m6", "-6", "6", "7", "Δ", "ø", "°7", "maj", "m9", "6/9")
ENDS = ("", "", "9", "11", "13", "(b5)", "(#9)", "(6)", "97", "+", "x")


def _list_sql(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick_sql(values, digits: str) -> str:
    return f"{_list_sql(values)}[{digits} % {len(values)} + 1]"


#: Parts with a label each, put together by their keys.
LABELS = f"""
labels as (select p_partkey, {_pick_sql(chords.VOCABULARY_ROOTS, 'p_partkey')} || {_pick_sql(chords.VOCABULARY_MARKS, 'p_partkey // 7')} || {_pick_sql(BODIES, 'p_partkey // 3')} || {_pick_sql(ENDS, 'p_partkey // 5')} as label from part)"""


def _map_sql(values: dict[str, str]) -> str:
    return "map {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


PARSED = f"""
s0 as (select p_partkey, label, translate(label, '{chords.GLYPHS}', '{chords.ASCII}') as s from labels),
s1 as (select *, regexp_extract(s, '^([A-G][#b]?)', 1) as spelled from s0),
s2 as (select *, coalesce({_map_sql(chords.FLAT_TO_SHARP)}[spelled], spelled) as root, substr(s, length(spelled) + 1) as tail from s1),
s3 as (select *, regexp_extract(tail, '{chords.BRACKET}', 1) as bracket, regexp_replace(tail, '{chords.BRACKET}', '') as rest from s2),
s4 as (select *, suffix(rest, '{chords.STACK}') as stacked, regexp_extract(rest, '{chords.WHOLE_PATTERN}', 1) as whole, regexp_extract(rest, '{chords.OPEN_PATTERN}', 1) as opened from s3),
s5 as (select *, case when stacked then '7' else coalesce({_map_sql(chords.WHOLE)}[whole], {_map_sql(chords.OPEN)}[opened], 'major') end as quality,
    case when stacked then left(rest, length(rest) - 2) when whole = '' then substr(rest, length(opened) + 1) end as after from s4),
parsed as (select p_partkey, label, root, quality, case when after in ('9', '11', '13') then after when stacked then '9_over_7' else 'none' end as extension,
    case when list_contains({_list_sql(chords.ALTERATIONS)}, bracket) then bracket else 'none' end as alteration from s5 where list_contains({_list_sql(chords.ROOTS)}, root))"""


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.floor(k / n) % len(values) + 1).cast("int"))
    return read(spark, sf, "part").select("p_partkey", F.concat(pick(chords.VOCABULARY_ROOTS, 1), pick(chords.VOCABULARY_MARKS, 7), pick(BODIES, 3), pick(ENDS, 5)).alias("label"))


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """How many parts bear each label of the vocabulary."""
    n = _labels(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    return chords.vocabulary(spark).join(n, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    p = _labels(spark, sf).select("p_partkey", "label", chords.parse(F.col("label")).alias("p")).where("p is not null")
    return p.select("p_partkey", "label", "p.root", "p.quality", "p.extension", "p.alteration")


def parse_chord(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf)


def format_chord(spark: SparkSession, sf: str) -> DataFrame:
    f = [F.col(c) for c in ("root", "quality", "extension", "alteration")]
    return _parsed(spark, sf).select("p_partkey", chords.spell(*f).alias("symbolic"), chords.spell(*f, style="textual").alias("textual"))


def normalisers(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("label")
    return _labels(spark, sf).select(
        "p_partkey", chords.normal_key(F.concat(F.lit(" "), v)).alias("spaced_key"), chords.normal_key(v).alias("plain_key"), chords.figure(v).alias("figure"),
        text.safe_filename(v).alias("file_name"), text.safe_filename(v, True).alias("synthetic_name"), text.label_of_filename(text.safe_filename(v)).alias("back"),
        text.short_id(v).alias("short_id"), chords.is_chord_token(v).alias("is_token"), chords.fix_root_case(F.lower(v)).alias("cased"),
    )


def part_names(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    brand = F.concat_ws(" ", "p_brand", "p_name", "p_type")
    return p.select("p_partkey", text.slug(brand).alias("slug"), text.content_id(brand).alias("content_id"), text.shorten(brand, 20).alias("short"), text.padding(F.col("p_size"), 0.3, 10).cast("long").alias("pad"))


def key_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Customers are songs: nations give the true key, segments the score's; parts' sizes choose the chord."""
    c = read(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") % 15 - 7).cast("int").alias("score_fifths"), F.length("c_mktsegment").alias("n"))
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") % 15 - 7).cast("int").alias("truth_fifths"), F.lit(True).alias("there")).where("c_nationkey % 4 <> 0")
    song = read(spark, sf, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(n) if n.count() <= 1000 else n, "c_nationkey", "left")
    j = c.join(song, "c_custkey")
    letter, accidental = F.substring(F.lit("ABCDEFG"), (F.col("c_custkey") % 7 + 1).cast("int"), F.lit(1)), F.when(F.col("c_custkey") % 3 == 0, "#")
    guard = overlay.flatten_guard(F.coalesce("there", F.lit(False)), F.when(F.col("n") != 9, F.col("score_fifths")), F.col("truth_fifths"))
    action = overlay.flatten_action(letter, accidental, chords.expected_flats(F.col("score_fifths")), overlay.chromatic_letters(F.array(F.lit("A"), F.lit("Bb"), F.lit("E#"))))
    return j.select("c_custkey", guard.alias("reason"), F.when(guard.isNull(), action).alias("action"))


def degree_form_drop(spark: SparkSession, sf: str) -> DataFrame:
    """Forty parts in a row are a measure of four beats."""
    p = _parsed(spark, sf).withColumns({"letter": F.substring("root", 1, 1), "measure": F.floor(F.col("p_partkey") / 40), "beat": F.col("p_partkey") % 4, "n_degrees": F.when(F.col("alteration") != "none", 1).otherwise(0)})
    out = coverage.drop_degree_forms(p, ["measure"], "beat", "letter", "n_degrees")
    return out.select("p_partkey", "letter", F.col("n_degrees").cast("long").alias("n_degrees"))


def bare_root_drop(spark: SparkSession, sf: str) -> DataFrame:
    """Sixty parts in a row are a measure, and their keys places in it; those of even places were read from the row."""
    v = _labels(spark, sf).select("p_partkey", "label", F.floor(F.col("p_partkey") / 60).alias("measure"), (F.col("p_partkey") * 13 % 701).cast("double").alias("x"))
    return coverage.drop_bare_roots(v, ["measure"], "label", "x", F.col("x") % 2 == 0, 200.0).select("p_partkey", "label", "measure", "x")


def specificity_insert(spark: SparkSession, sf: str) -> DataFrame:
    """Orders are measures; lines with a number of three's multiple are there before, and the others' longer or shorter labels come in."""
    line = read(spark, sf, "lineitem")
    key = F.substring(F.concat("l_returnflag", "l_linestatus", F.lit("7")), F.lit(1), (F.col("l_partkey") % 3 + 1).cast("int"))
    line = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", key.alias("k"), F.round(F.col("l_tax") * 20, 3).alias("o"))
    there = F.col("l_linenumber") % 3 == 0
    return coverage.insert_specific(line.where(there), line.where(~there), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "k", "o")


QUERIES = {
    "chord_vocabulary": (vocabulary, f"with {VOCABULARY}, {LABELS} select label, count(p_partkey) as n from vocabulary left join labels using (label) group by label"),
    "parse_chord": (parse_chord, f"with {LABELS}, {PARSED} select * from parsed"),
    "format_chord": (format_chord, f"""
        with {LABELS}, {PARSED},
        f as (select *, {_map_sql(chords.SUFFIXES["symbolic"])}[quality] as sy, {_map_sql(chords.SUFFIXES["textual"])}[quality] as tx, case when alteration = 'none' then '' else '(' || alteration || ')' end as alt from parsed)
        select p_partkey, case when extension = '9_over_7' then root || case when quality = '7' then '' else sy end || '97' when extension = 'none' then root || sy else root || sy || extension end || alt as symbolic,
            case when extension = '9_over_7' then root || case when quality = '7' then '' else tx end || '97' when extension = 'none' then root || tx else root || tx || extension end || alt as textual from f"""),
    "normalisers": (normalisers, f"""
        with {LABELS},
        k as (select p_partkey, label, regexp_replace(lower(label), '[()]', '', 'g') as low, lower(label) as lower_label,
            replace(replace(replace(replace(replace(label, '/', '_slash_'), '#', 'sharp'), '+', 'aug'), ' ', ''), ':', '') as file_name from labels),
        c as (select *, upper(left(lower_label, 1)) || substr(lower_label, 2) as candidate from k)
        select p_partkey, regexp_replace(' ' || low, '\\s+', '', 'g') as spaced_key, regexp_replace(regexp_replace(low, '^([a-g])b', '\\1-'), '\\s+', '', 'g') as plain_key,
            regexp_replace(regexp_replace(regexp_replace(regexp_replace(label, '^([A-G])b', '\\1-'), '\\(([#b]?\\d{{1,2}}|add\\d{{1,2}})\\)', '\\1', 'g'), 'mm+', 'm', 'g'), '^([A-G][#b\\-]?)(\\d+)\\+$', '\\1+\\2') as figure,
            file_name, replace(replace(file_name, '(', '_'), ')', '_') as synthetic_name, replace(replace(replace(file_name, '_slash_', '/'), 'sharp', '#'), 'aug', '+') as back,
            left(sha1(label), 12) as short_id,
            regexp_matches(label, '^[A-G][#b♯♭]?(?:maj|min|aug|dim|sus|m|M|b|#|\\+|\\-|[0-9/\\+])*$') or regexp_matches(label, '^[A-G][#b♯♭]?(?:maj|min|aug|dim|sus|m|M|b|#|\\+|\\-|[0-9])*/[A-G][#b♯♭]?$') as is_token,
            case when length(label) > 1 and regexp_matches(candidate, '^[A-G][#b♯♭]?(?:maj|min|aug|dim|sus|m|M|b|#|\\+|\\-|[0-9/\\+])*$') then candidate else lower_label end as cased
        from c"""),
    "part_names": (part_names, """
        with b as (select p_partkey, p_size, p_brand || ' ' || p_name || ' ' || p_type as brand from part)
        select p_partkey, trim(regexp_replace(lower(brand), '[^a-z0-9]+', '_', 'g'), '_') as slug, left(sha256(brand), 16) as content_id,
            case when length(brand) > 20 then left(brand, 19) || '…' else brand end as short, cast(greatest(10, trunc(p_size * 0.3)) as bigint) as pad from b"""),
    "key_flatten": (key_flatten, """
        with j as (select c_custkey, cast(c_nationkey % 15 - 7 as int) as score_fifths, length(c_mktsegment) as n, n_nationkey is not null as there, cast(n_nationkey % 15 - 7 as int) as truth_fifths,
            substr('ABCDEFG', cast(c_custkey % 7 + 1 as int), 1) as letter, case when c_custkey % 3 = 0 then '#' end as accidental
            from customer left join (select * from nation where n_nationkey % 4 <> 0) on c_nationkey = n_nationkey),
        g as (select *, case when not there then 'no_gt' when n = 9 then 'no_score_key' when score_fifths is distinct from truth_fifths then 'key_mismatch' end as reason from j)
        select c_custkey, reason, case when reason is null and list_contains(['B', 'E', 'A', 'D', 'G', 'C', 'F'][1:greatest(-score_fifths, 0)], letter)
            then case when letter in ('A', 'E') then 'chromatic_skipped' when accidental is null then 'flattened' end end as action from g"""),
    "degree_form_drop": (degree_form_drop, f"""
        with {LABELS}, {PARSED},
        d as (select p_partkey, left(root, 1) as letter, p_partkey // 40 as measure, p_partkey % 4 as beat, cast(alteration <> 'none' as bigint) as n_degrees from parsed)
        select p_partkey, letter, n_degrees from d where n_degrees = 0 or not exists (select 1 from d e where e.measure = d.measure and e.letter = d.letter and e.beat = d.beat and e.n_degrees = 0)"""),
    "bare_root_drop": (bare_root_drop, f"""
        with {LABELS}, w as (select p_partkey, label, p_partkey // 60 as measure, cast(p_partkey * 13 % 701 as double) as x from labels)
        select * from w where not (x % 2 = 0 and regexp_matches(label, '^[A-G][b#]?$') and exists (
            select 1 from w o where o.x % 2 = 0 and o.measure = w.measure and o.label <> w.label and starts_with(o.label, w.label) and abs(o.x - w.x) <= 200))"""),
    "specificity_insert": (specificity_insert, """
        with r as (select l_orderkey, l_linenumber % 3 <> 0 as late, l_linenumber, l_partkey, l_suppkey, l_extendedprice, left(l_returnflag || l_linestatus || '7', cast(l_partkey % 3 + 1 as int)) as k, round(l_tax * 20, 3) as o from lineitem),
        n as (select l_orderkey, late, row_number() over (partition by l_orderkey order by late, case when late then l_linenumber else 0 end, case when late then l_partkey else 0 end, case when late then l_suppkey else 0 end, case when late then l_extendedprice else 0 end, k, o) as n,
            [struct_pack(late := late, k := k, o := o)] as i from r),
        g as (select l_orderkey, list_reduce(list(i order by n), lambda acc, y:
            case when not y[1].late then list_concat(acc, y)
            when len(list_filter(acc, lambda e: e.k = y[1].k or (abs(e.o - y[1].o) < 0.5 and contains(e.k, y[1].k) and length(y[1].k) < length(e.k)))) > 0 then acc
            else list_concat(list_filter(acc, lambda e: not (abs(e.o - y[1].o) < 0.5 and contains(y[1].k, e.k) and length(e.k) < length(y[1].k))), y) end) as kept from n group by all)
        select l_orderkey, e.k as k, e.o as o, e.late as inserted from (select l_orderkey, unnest(kept) as e from g)"""),
}
