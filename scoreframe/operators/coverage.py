"""Coverage diffs and greedy removal of near-duplicates.

The greedy rules read their group from the left, so each is a fold over an ordered array. The arrays are cut first where the
rule can't reach across (islands), so that what a task holds at once follows the density of a stretch, not a group's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.functions.chords import normal_key
from scoreframe.operators.islands import islands


def missing_rows(found: DataFrame, known: DataFrame, measure: str, value: str, known_value: str | None = None) -> DataFrame:
    """Rows of found whose measure has no row in known with the same normalised value; rows without a measure are missing too."""
    have = known.select(F.col(measure).alias("_m"), normal_key(F.col(known_value or value)).alias("_k")).where("_m is not null").distinct()
    return found.join(have, (F.col(measure) == F.col("_m")) & (normal_key(F.col(value)) == F.col("_k")), "left_anti")


def proximity_dedup(df: DataFrame, by: list[str], x: str, token: str, radius: float = 25.0) -> DataFrame:
    """Rows (by, x, token): in order of x, then token, one that lies nearer than radius to the last kept replaces it if longer, else goes."""
    w_islands = islands(df.select(*by, F.col(x).cast("double").alias("x"), F.col(token).alias("token")), by, ["x", "token"], "x", float(radius), "_island")
    item = F.struct("x", "token")
    kept = F.array().cast("array<struct<x:double,token:string>>")

    def step(acc, i):
        last = F.element_at(acc, -1)
        near = (F.size(acc) > 0) & (i["x"] - last["x"] < radius)
        longer = F.length(i["token"]) > F.length(last["token"])
        return F.when(~near, F.concat(acc, F.array(i))).when(longer, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(i))).otherwise(acc)

    folded = w_islands.groupBy(*by, "_island").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return folded.select(*by, F.explode(F.aggregate("_items", kept, step)).alias("_i")).select(*by, "_i.x", "_i.token")


def greedy_cover(base: DataFrame, more: DataFrame, by: list[str], position: str, order: list[str], radius: float = 0.15) -> DataFrame:
    """Rows of more, in order, that lie at radius or further from every row of base and from every one kept before, of the same group."""
    rows = base.select(*by, F.col(position).cast("double").alias("_p"), F.lit(True).alias("_base")).unionByName(
        more.withColumns({"_p": F.col(position).cast("double"), "_base": F.lit(False)}), allowMissingColumns=True
    )
    parted = islands(rows.where("_p is not null"), by, ["_p", "_base", *order], "_p", float(radius), "_island")
    item = F.struct(F.when(F.col("_base"), 0).otherwise(1).alias("late"), *[F.col(c) for c in order], F.col("_p"))
    keep = F.array().cast("array<double>")

    def step(acc, i):
        near = F.exists(acc["all"], lambda p: F.abs(p - i["_p"]) < radius)
        taken = (i["late"] == 0) | ~near
        return F.struct(
            F.when(taken, F.concat(acc["all"], F.array(i["_p"]))).otherwise(acc["all"]).alias("all"),
            F.when((i["late"] == 1) & ~near, F.concat(acc["kept"], F.array(i))).otherwise(acc["kept"]).alias("kept"),
        )

    items = parted.groupBy(*by, "_island").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    empty = F.struct(keep.alias("all"), F.filter("_items", lambda _: F.lit(False)).alias("kept"))
    folded = items.select(*by, F.explode(F.aggregate("_items", empty, step, lambda acc: acc["kept"])).alias("_i"))
    return folded.select(*by, *[F.col(f"_i.{c}").alias(c) for c in order], F.col("_i._p").alias(position))


def near_anti(df: DataFrame, known: DataFrame, by: list[str], position: str, radius: float = 0.15) -> DataFrame:
    """Rows of df that lie at radius or further from every row of known (the rule without greed).

    Positions are dealt into cells as wide as the radius, and each known row stands in its own and both neighbouring cells, so
    the join is by equal keys.
    """
    cell = F.floor(F.col(position) / radius).cast("long")
    there = known.where(F.col(position).isNotNull()).select(*[F.col(c).alias(f"_{c}") for c in by], F.col(position).alias("_kp"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_kc"))
    same = [F.col(c) == F.col(f"_{c}") for c in by] + [F.col("_c") == F.col("_kc"), F.abs(F.col(position) - F.col("_kp")) < radius]
    return df.withColumn("_c", cell).join(there, same, "left_anti").drop("_c")


def drop_bare_roots(df: DataFrame, by: list[str], value: str, x: str, source: Column, radius: float = 200.0) -> DataFrame:
    """Without those rows of the source whose value is a bare root and that have, in their group and within radius, another of the
    source which begins with it."""
    numbered = df.withColumn("_id", F.monotonically_increasing_id())
    cell = F.floor(F.col(x) / radius).cast("long")
    bare = numbered.where(source & F.col(value).rlike("^[A-G][b#]?$")).withColumn("_c", F.explode(F.array(cell - 1, cell, cell + 1)))
    other = numbered.where(source & ~F.col(value).rlike("^[A-G]$")).select(
        *[F.col(c).alias(f"_{c}") for c in by], F.col(value).alias("_v"), F.col(x).alias("_x"), cell.alias("_oc"), F.substring(value, 1, 1).alias("_root")
    )
    same = [F.col(c) == F.col(f"_{c}") for c in by] + [
        F.col("_c") == F.col("_oc"), F.substring(value, 1, 1) == F.col("_root"), F.col("_v") != F.col(value), F.col("_v").startswith(F.col(value)), F.abs(F.col(x) - F.col("_x")) <= radius,
    ]
    hit = bare.join(other, same, "left_semi").select("_id").distinct()
    return numbered.join(hit, "_id", "left_anti").drop("_id")


def drop_degree_forms(df: DataFrame, by: list[str], offset: str, letter: str, n_degrees: str) -> DataFrame:
    """Without rows that have degrees where one without stands at the same offset on the same root letter."""
    clean = F.max((F.col(n_degrees) == 0).cast("int")).over(Window.partitionBy(*by, offset, letter))
    return df.withColumn("_clean", clean).where((F.col(n_degrees) == 0) | (F.col("_clean") == 0) | F.col(letter).isNull()).drop("_clean")


def insert_specific(present: DataFrame, more: DataFrame, by: list[str], order: list[str], key: str, offset: str, reach: float = 0.5) -> DataFrame:
    """Rows (by, key, offset, inserted) after inserting more, in order, into present.

    A key that stands anywhere in the group is skipped, as is one that is a part of a longer key nearer than reach; shorter keys
    nearer than reach that are a part of it are taken out. Later rows see what earlier ones did. A group is one measure.
    """
    field = lambda df, late, n: df.select(*by, F.struct(F.lit(late).alias("late"), n.alias("n"), F.col(key).alias("k"), F.col(offset).cast("double").alias("o")).alias("_i"))
    numbered = more.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    rows = field(present, 0, F.lit(0)).unionByName(field(numbered, 1, F.col("_n")))
    items = rows.groupBy(*by).agg(F.array_sort(F.collect_list("_i")).alias("_items"))

    def step(acc, i):
        near = lambda e: F.abs(e["o"] - i["o"]) < reach
        skip = F.exists(acc, lambda e: e["k"] == i["k"]) | F.exists(acc, lambda e: near(e) & F.contains(e["k"], i["k"]) & (F.length(i["k"]) < F.length(e["k"])))
        rest = F.filter(acc, lambda e: ~(near(e) & F.contains(i["k"], e["k"]) & (F.length(e["k"]) < F.length(i["k"]))))
        return F.when(i["late"] == 0, F.concat(acc, F.array(i))).when(skip, acc).otherwise(F.concat(rest, F.array(i)))

    folded = F.aggregate("_items", F.filter("_items", lambda _: F.lit(False)), step)
    return items.select(*by, F.explode(folded).alias("_i")).select(*by, F.col("_i.k").alias(key), F.col("_i.o").alias(offset), (F.col("_i.late") == 1).alias("inserted"))


def redistribute(harmonies: DataFrame, glyphs: DataFrame, by: list[str], order: list[str], key: str, offset: str, length: str, frac: str) -> DataFrame:
    """Rows (by, order, key, offset, moved): rows of a group that share an offset go, in order, to the nearest free place that a glyph
    of the same key shows (frac * length on quarter beats; the earlier of two equally near); others stay.

    Places are quarter beats of a measure, so each row looks at as many as its measure has at most, whatever the number of glyphs. Only rows that share an
    offset and have a place to go enter the fold, which keeps the taken places and what moved; the others stay as rows.
    """
    place = (F.bround(F.col(frac) * F.col("_len") * 4, 0) / 4.0).alias("p")
    lengths = harmonies.groupBy(*by).agg(F.max(length).alias("_len"))
    places = glyphs.where(F.col(frac).isNotNull()).join(lengths, by).groupBy(*by, key).agg(F.array_sort(F.collect_set(place)).alias("_places"))
    w = Window.partitionBy(*by, offset)
    rows = harmonies.select(*by, *order, key, F.col(offset).cast("double").alias(offset)).withColumns({"_same": F.count("*").over(w), "_lead": F.min(F.struct(*order)).over(w)})
    rows = rows.join(places, [*by, key], "left").withColumn("_may", (F.col("_same") > 1) & F.col("_places").isNotNull())
    item = F.struct("_lead", *order, F.col(key).alias("k"), F.col(offset).alias("o"), F.col("_places").alias("p"))
    items = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col("_may"), item))).alias("_items"), F.collect_set(offset).alias("_taken")).where(F.size("_items") > 0)

    def step(acc, i):
        free = F.filter(i["p"], lambda q: (q != i["o"]) & ~F.array_contains(acc["taken"], q))
        best = F.aggregate(free, F.lit(None).cast("double"), lambda b, q: F.when(b.isNull() | (F.abs(q - i["o"]) < F.abs(b - i["o"])), q).otherwise(b))
        taken = F.when(best.isNotNull(), F.array_append(F.array_remove(acc["taken"], i["o"]), best)).otherwise(acc["taken"])
        done = F.struct(*[i[c].alias(c) for c in order], i["k"].alias("k"), F.coalesce(best, i["o"]).alias("o"), best.isNotNull().alias("m"))
        return F.struct(taken.alias("taken"), F.concat(acc["done"], F.array(done)).alias("done"))

    types = dict(rows.dtypes)
    start = F.struct(F.col("_taken").alias("taken"), F.array().cast(f"array<struct<{', '.join(f'{c}: {types[c]}' for c in order)}, k: {types[key]}, o: double, m: boolean>>").alias("done"))
    folded = items.select(*by, F.explode(F.aggregate("_items", start, step, lambda acc: acc["done"])).alias("_i"))
    moved = folded.select(*by, *[F.col(f"_i.{c}") for c in order], F.col("_i.k").alias(key), F.col("_i.o").alias(offset), F.col("_i.m").alias("moved"))
    return moved.unionByName(rows.where(~F.col("_may")).select(*by, *order, key, offset, F.lit(False).alias("moved")))
