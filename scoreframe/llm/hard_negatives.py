"""Hard negatives by product quantisation with residual norms: bounded lookup-table scores choose, exact integer scores decide.

Vectors are of integers. A codebook of CENTROIDS centroids for each two components, fitted on a bounded sample, codes every row; the row
keeps its codes, its exact vector and the norm of what the codes miss. An anchor has a table of its products with all
centroids; the sum of a row's entries lies within anchor norm x residual norm of the exact score. So a row enters the exact rerank unless that bound
proves that it is outside a list: below the list's last exact score so far, or outside its window.

The rows are searched in groups, each against all anchors, which lie in files of bounded size in the shared folder; a group gives
each anchor's best in it, and ranks over these merge the groups. The first pass finds the positives, the second the negatives of the windows that they span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreframe.llm.common import durable, pack, small_batches, table, unpack

#: Largest magnitude of a component; beyond it, components saturate, so that 64 bits hold every score of up to 2,000 components.
LIMIT = 1 << 26

CENTROIDS = 256

#: Rows of a worker's group, rows and anchors scored at once, and bytes of anchors in a file.
GROUP, ROWS, ANCHORS, FILE_BYTES = 1 << 17, 1 << 14, 64, 1 << 20


def integers(vector: Column, scale: int = 256) -> Column:
    """Each component as floor(scale * x), x as double; null if the vector or a component is null, or one isn't finite."""
    x = vector.cast("array<double>")
    good = vector.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(good, F.transform(x, lambda v: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(v * scale))).cast("int")))


def fit(sample: np.ndarray, rounds: int = 8) -> np.ndarray:
    """A codebook for each pair of columns, float32 of (pairs, CENTROIDS, 2), by k-means from evenly spaced rows of the sorted sample; empty samples give zeros."""
    books = np.zeros((sample.shape[1] // 2, CENTROIDS, 2), np.float32)
    for m in range(len(books)) if len(sample) else ():
        x = sample[:, 2 * m : 2 * m + 2].astype(np.float32)
        order = np.lexsort((x[:, 1], x[:, 0]))
        c = x[order[np.linspace(0, len(x) - 1, CENTROIDS).astype(int)]].copy()
        for _ in range(rounds):
            near = nearest(x, c)
            n = np.bincount(near, minlength=CENTROIDS)
            for d in (0, 1):
                total = np.bincount(near, weights=x[:, d], minlength=CENTROIDS)
                c[n > 0, d] = total[n > 0] / n[n > 0]
        books[m] = c
    return books


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each row of x a near centroid of c: the nearest up to rounding, which costs tightness alone."""
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), 8192):
        out[i : i + 8192] = np.argmin((c * c).sum(1)[None] - 2 * x[i : i + 8192] @ c.T, axis=1)
    return out


def index(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """Rows (vec_id, label, is_anchor, codes, exact, residual): a byte a pair of components, the vector as 32-bit integers, and the norm of what the codes miss."""
    small_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, v = np.zeros((batch.num_rows, 2 * len(books)), np.int32), batch.column(3)
            x[np.arange(x.shape[1])[None] < v.value_lengths().to_numpy()[:, None]] = v.flatten().to_numpy()
            codes = np.zeros((len(x), len(books)), np.uint8)
            missed = np.zeros(len(x))
            for m, c in enumerate(books):
                pair = x[:, 2 * m : 2 * m + 2]
                codes[:, m] = nearest(pair.astype(np.float32), c)
                missed += ((pair - c[codes[:, m]].astype(float)) ** 2).sum(1)
            raw = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], raw(codes), raw(x), pa.array(np.sqrt(missed))], names=[*batch.schema.names[:3], "codes", "exact", "residual"])

    return vectors.select("vec_id", "label", "is_anchor", "v").mapInArrow(run, "vec_id long, label int, is_anchor boolean, codes binary, exact binary, residual double")


class Rows:
    """A group of index rows as arrays."""

    def __init__(self, batches: list[pa.RecordBatch], pairs: int):
        column = lambda i: pa.chunked_array([b.column(i) for b in batches])
        self.id, self.label = column(0).to_numpy(), column(1).to_numpy()
        self.codes = np.frombuffer(b"".join(column(2).to_pylist()), np.uint8).reshape(-1, pairs)
        self.exact = np.frombuffer(b"".join(column(3).to_pylist()), np.int32).reshape(-1, 2 * pairs)
        self.residual = column(4).to_numpy()

    def blocks(self) -> Iterator[slice]:
        return (slice(i, i + ROWS) for i in range(0, len(self.id), ROWS))


class Tables:
    """Lookup tables of a block of anchors, and what bounds the error of their scores."""

    def __init__(self, exact: np.ndarray, books: np.ndarray):
        pairs = exact.reshape(len(exact), -1, 2).astype(np.float32)
        self.table = np.einsum("mcd,amd->mca", books, pairs, optimize=True).astype(np.float32)
        self.norm = np.sqrt((exact.astype(float) ** 2).sum(1))
        # what rounding can add to a sum of products in single precision, with room to spare
        reach = np.linalg.norm(pairs.astype(float), axis=2) @ np.linalg.norm(books.astype(float), axis=2).max(1)
        self.rounding = 16 * len(books) * 2.0**-24 * reach + 1

    def bounds(self, rows: Rows, at: slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each anchor, what the exact scores of a block's rows are at least and at most."""
        score = np.zeros((len(rows.id[at]), len(self.norm)), np.float32)
        for lut, codes in zip(self.table, rows.codes[at].T, strict=True):
            score += lut[codes]
        for s, norm, rounding in zip(np.ascontiguousarray(score.T), self.norm, self.rounding, strict=True):
            slack = rows.residual[at] * norm + rounding
            yield s - slack, s + slack


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by the smaller id."""
    return np.lexsort((ids, -score))[:k]


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[-k] if len(values) >= k else -np.inf


def _search(indexed: DataFrame, files: list[str], books: np.ndarray, schema: str, each) -> DataFrame:
    """each(rows, anchors, tables) gives result columns, for every group of index rows and block of anchors; anchors are rows of a packed file."""
    small_batches(indexed.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= GROUP:
                yield Rows(held, len(books))
                held, n = [], 0
        if n:
            yield Rows(held, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches):
            for name in files:
                anchors = unpack(name)
                for i in range(0, len(anchors), ANCHORS):
                    block = anchors[i : i + ANCHORS]
                    exact = np.stack([np.frombuffer(a[2], np.int32) for a in block]).astype(np.int64)
                    found = [np.concatenate(c) for c in zip(*each(rows, block, exact, Tables(exact, books)), strict=True)]
                    if found and len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=names)

    return indexed.select("vec_id", "label", "codes", "exact", "residual").mapInArrow(run, schema)


def _positives(k: int):
    """The first k other rows of each anchor's label in a group."""

    def each(rows: Rows, block: list[tuple], exact: np.ndarray, tables: Tables) -> Iterator[tuple]:
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(block)
        for at in rows.blocks():
            ids, label = rows.id[at], rows.label[at]
            for j, ((anchor, own, *_), (least, most)) in enumerate(zip(block, tables.bounds(rows, at), strict=True)):
                same = np.flatnonzero((label == own) & (ids != anchor))
                ok = same[most[same] >= max(_kth(least[same], k), _kth(kept[j][0], k))]
                found, n = np.concatenate([kept[j][0], rows.exact[at][ok] @ exact[j]]), np.concatenate([kept[j][1], ids[ok]])
                top = best(found, n, k)
                kept[j] = found[top], n[top]
        for (anchor, *_), (found, n) in zip(block, kept, strict=True):
            yield np.full(len(n), anchor), n, found

    return each


def _negatives(k: int, low: int, high: int):
    """The first k rows of other labels in each window of each anchor in a group; an anchor's row ends with its positives' scores."""

    def each(rows: Rows, block: list[tuple], exact: np.ndarray, tables: Tables) -> Iterator[tuple]:
        spans = [[(-(-low * p // 100), high * p // 100) for p in positives] for *_, positives in block]
        kept = [[(np.empty(0, np.int64), np.empty(0, np.int64))] * len(s) for s in spans]
        for at in rows.blocks():
            ids, label = rows.id[at], rows.label[at]
            for j, ((_, own, *_), (least, most)) in enumerate(zip(block, tables.bounds(rows, at), strict=True)):
                # rows that can lie in some window, then for each window those that can be among its first k
                floors = [max(lo, _kth(have, k)) for (lo, _), (have, _) in zip(spans[j], kept[j], strict=True)]
                pool = np.flatnonzero((label != own) & (least <= max((hi for _, hi in spans[j]), default=-np.inf)) & (most >= min(floors, default=np.inf)))
                least, most, wanted = least[pool], most[pool], np.zeros(len(pool), bool)
                for (lo, hi), floor in zip(spans[j], floors, strict=True):
                    inside = least[(least >= lo) & (most <= hi)]
                    wanted |= (least <= hi) & (most >= max(floor, _kth(inside, k)))
                pool = pool[wanted]
                exactly = rows.exact[at][pool] @ exact[j]
                for w, (lo, hi) in enumerate(spans[j]):
                    ok = (exactly >= lo) & (exactly <= hi)
                    have, n = np.concatenate([kept[j][w][0], exactly[ok]]), np.concatenate([kept[j][w][1], ids[pool[ok]]])
                    top = best(have, n, k)
                    kept[j][w] = have[top], n[top]
        for (anchor, *_), lists in zip(block, kept, strict=True):
            for w, (have, n) in enumerate(lists):
                yield np.full(len(n), anchor), np.full(len(n), w, np.int32), n, have

    return each


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, sample: int = 8192) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors has vec_id, label and an integer array v; anchors says which rows are anchors. Of an anchor's first `positives` other rows of its
    label, each gives a window: scores of low to high percent of its own. The first `negatives` rows of other labels in it are returned. Higher
    scores come first, ties by vec_id. Rows with a null id, label or vector take no part; a repeated id counts once, with its least
    label and vector; shorter vectors count as ended by zeros. Empty tables, anchors without positives and windows without rows give
    no rows. The codebook is fitted on `sample` rows at most, the first by a hash of their ids; all rows are indexed and searched.
    """
    spark = vectors.sparkSession
    rows = vectors.where("vec_id is not null and label is not null and v is not null").select("vec_id", F.col("label").cast("int").alias("label"), "v", anchors.alias("is_anchor"))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"), F.max("is_anchor").alias("is_anchor"))
    one = durable(one.select("vec_id", "r.label", "r.v", "is_anchor"))
    n, width = one.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(1, width or 0)
    width += width % 2
    picked = one.orderBy(F.xxhash64("vec_id")).limit(sample).select("v").collect()
    books = fit(np.array([[*r["v"], *[0] * (width - len(r["v"]))] for r in picked], np.float32).reshape(-1, width))
    parts = max(spark.sparkContext.defaultParallelism, -(-n // GROUP))
    indexed = durable(index(one.repartition(parts, "vec_id"), books))
    own = indexed.where("is_anchor").select("vec_id", "label", "exact")
    schema = "anchor_id long, positive_id long, positive_score long"
    found = _search(indexed, pack(own, "exact", "anchors", FILE_BYTES), books, schema, _positives(positives))
    w = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = durable(found.withColumn("place", F.row_number().over(w) - 1).where(F.col("place") < positives))
    spans = found.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"]).alias("scores"))
    own = own.join(spans.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    schema = "anchor_id long, place int, negative_id long, negative_score long"
    near = _search(indexed, pack(own, "exact", "windows", FILE_BYTES), books, schema, _negatives(negatives, low, high))
    w = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    near = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    return near.join(found, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row of embeddings whose vec_id is divisible by 100; where it is divisible by 7, the label moves on by one."""
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(e.select("vec_id", label.alias("label"), integers(F.col("embedding")).alias("v")), F.col("vec_id") % 100 == 0)


OP11_SQL = r"""
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
    from embeddings
    where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)
), s as (
    select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) as bigint) as score
    from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), p as (
    select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, id) as int) as rank, id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, id) <= 10
"""
