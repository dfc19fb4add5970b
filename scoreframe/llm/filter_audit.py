"""How filters interact: every order of them, from the joint failures of their subsets.

For each subset T of the filters, J(T) counts the rows that fail all of T: the sum of the product of their failure flags. One aggregation
gives all 2^n of them, for all rows, good ones and toxic ones. Everything else is arithmetic on these few numbers:

- survivors of the filters P: K(P) = sum over T within P of (-1)^|T| J(T), by Moebius inversion;
- removed by f after P: K(P) - K(P with f); redundant: J(f) less that;
- failing f alone: the sum over T holding f of (-1)^(|T|-1) J(T);
- f's removals summed over all n! orders: n! times its Shapley value, that is the sum over T holding f of the Harsanyi
  dividend (-1)^(|T|-1) J(T), shared evenly among T's members: n!/|T| of each.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreframe.llm.common import table

FILTERS = "ABCDE"


def text_failures(text: Column) -> list[Column]:
    """Failure of A to D; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    return [
        F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text), text.rlike("[#$%&*|]"),
    ]


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts n by (part, fails, good, toxic): fails has bit i set where filter i of FILTERS fails.

    Texts are read once and leave their scan as digests. Rows are counted by id and digest first, so copies and repeated rows
    meet as counts; a digest's smallest id is then that of at most a few rows of each part. Rows without an id have no label, and no
    text of a smaller id.
    """
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_failures(F.col("text")))), F.lit(0))
    rows = docs.select(
        F.col("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), bits.alias("bits"), F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("digest")
    )
    rows = rows.groupBy("doc_id", "part", "bits", "digest").agg(F.count("*").alias("n"))
    mark = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marks = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(mark("quality"), mark("toxic"))
    known = rows.where("doc_id is not null").join(marks, "doc_id", "left").select("doc_id", "part", "bits", "digest", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("quality", "toxic")))
    nameless = rows.where("doc_id is null").select("doc_id", "part", "bits", "digest", "n", F.lit(False).alias("quality"), F.lit(False).alias("toxic"))
    cells = known.unionByName(nameless).groupBy("digest", "part", "bits", "quality", "toxic")
    cells = cells.agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("free"), F.min_by("n", "doc_id").alias("n_least"))
    # of a text, the rows of its smallest id and those without one are no copies
    least = F.min("least").over(Window.partitionBy("digest"))
    cells = cells.withColumn("first", F.col("free") + F.when(F.col("least") == least, F.col("n_least")).otherwise(0))
    both = F.explode(F.array(*(F.struct(b.alias("fails"), n.alias("n")) for b, n in ((F.col("bits"), F.col("first")), (F.col("bits") + 16, F.col("n") - F.col("first"))))))
    cells = cells.select("part", F.col("quality").alias("good"), "toxic", both.alias("c"))
    return cells.groupBy("part", F.col("c.fails").alias("fails"), "good", "toxic").agg(F.sum("c.n").alias("n"))


def audit(failed: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part and order.

    failed has counts n by (part, fails, good, toxic), fails a bit a filter. An empty table gives no rows.
    """
    k = len(filters)
    every, sign = f"sequence(0, {(1 << k) - 1})", "if(bit_count(t) % 2 = 1, -1, 1)"
    # J(T): a row's product of flags over T is 1 where it fails all of T
    joint = failed.select("part", "good", "toxic", "n", F.explode(F.expr(f"filter({every}, t -> (fails & t) = t)")).alias("t")).groupBy("part", "t")
    joint = joint.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n"))).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n"))).alias("toxic"))
    games = joint.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("t", F.struct("n", "good", "toxic")))).alias("m"))
    games = games.select("part", *(F.expr(f"transform({every}, t -> coalesce(m[t].{c}, 0L))").alias(c) for c in ("n", "good", "toxic")))
    survive = lambda j: F.expr(f"transform({every}, p -> aggregate({every}, 0L, (a, t) -> a + if((p & t) = t, {sign} * {j}[t], 0)))").alias(f"k_{j}")
    of = lambda weight: F.expr(f"transform(sequence(0, {k - 1}), f -> aggregate({every}, 0L, (a, t) -> a + if(shiftright(t, f) & 1 = 1, -{sign} * {weight} * n[t], 0)))")
    games = games.select("part", "n", survive("n"), survive("good"), survive("toxic"), of("1").alias("alone"), of(f"cast({factorial(k)} / bit_count(t) as int)").alias("shapley"))
    steps = [f"{''.join(filters[g] for g in p)}:{i + 1}:{f}:{sum(1 << g for g in p[:i])}" for p in permutations(range(k)) for i, f in enumerate(p)]
    rows = games.withColumn("s", F.explode(F.split(F.lit(",".join(steps)), ","))).withColumn("s", F.split("s", ":"))
    rows = rows.withColumns({"f": F.col("s")[2].cast("int"), "before": F.col("s")[3].cast("int")}).withColumn("bit", F.expr("shiftleft(1, f)"))
    lost = lambda c: F.expr(f"{c}[before] - {c}[before + bit]")
    return rows.select(
        "part", F.col("s")[0].alias("filter_order"), F.col("s")[1].cast("int").alias("step"), F.expr("k_n[before + bit]").alias("kept"), lost("k_n").alias("removed"),
        (F.expr("n[bit]") - lost("k_n")).alias("redundant"), F.expr("alone[f]").alias("unique_fails"), lost("k_good").alias("good_lost"), lost("k_toxic").alias("toxic_lost"), F.expr("shapley[f]").alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all documents, by language, in all 120 orders."""
    return audit(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


#: Every order applied to every row, one filter after the other.
OP12_SQL = r"""
with base as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
        min(doc_id) over (partition by coalesce(text, '')) as least
    from documents
), marks as (
    select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id
), flags as (
    select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
        100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] as fails
    from base left join marks using (doc_id)
), f as (select unnest(range(1, 6)) as i), orders as (
    select [a.i, b.i, c.i, d.i, e.i] as p from f a, f b, f c, f d, f e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps as (select p, unnest(range(1, 6)) as step from orders), hit as (
    select part, list_aggregate(list_transform(p, lambda i: 'ABCDE'[i]), 'string_agg', '') as filter_order, step,
        fails[p[step]] as bad, len(list_filter(p[:step - 1], lambda i: fails[i])) > 0 as gone, len(list_filter(fails, lambda x: x)) = 1 as single, good, toxic
    from flags, steps
), done as (
    select part, filter_order, step, filter_order[step] as letter, count(*) filter (not gone and not bad) as kept, count(*) filter (bad and not gone) as removed,
        count(*) filter (bad and gone) as redundant, count(*) filter (bad and single) as unique_fails, count(*) filter (bad and not gone and good = 1) as good_lost,
        count(*) filter (bad and not gone and toxic = 1) as toxic_lost
    from hit group by part, filter_order, step
)
select part, filter_order, cast(step as int) as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, letter) as bigint) as shapley
from done
"""
