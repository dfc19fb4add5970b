"""MinHash near-duplicates: banded candidates, sequential Bayesian verification, exact confirmation, components.

1. Every text becomes a set of shingle hashes, a signature and band keys; the shingles are read once and the rest is
   written to the shared folder.
2. Texts of equal sets are collapsed by a hash of the set; the smallest id stands for its copies, however many there are.
3. Texts that share a band key meet through the smallest id of their bucket (bucket size - 1 links), and the components
   of these links are the candidate groups.
4. Within a group, blocks of texts are compared in pairs of blocks. A pair's signatures are compared batch by batch, and it
   is dropped once the posterior probability of a similarity of THRESHOLD or more falls below MISS; the rest is confirmed
   on full sets. Pairs that are linked already need no confirmation: only links that join anything leave a block.
5. Components of the confirmed links give each document its class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.llm.common import components, durable, map_rows, small_batches, table
from scoreframe.llm.shingles import mix, shingle_set

#: Links: PERCENT * union <= 100 * intersection.
PERCENT = 85

#: Signature hashes at most, and the chance with which a pair just at the threshold may share no band.
HASHES, UNSEEN = 400, 5e-6

#: Hashes compared at a time, and the posterior probability below which a pair is dropped.
BATCH, MISS = 40, 1e-6

#: Sets that go to every task at most, two hashes and an id each.
HOT_SETS = 20_000

#: Texts and bytes that one block has at most, but for a single longer text.
BLOCK_TEXTS, BLOCK_BYTES = 512, 8 << 20

_A = (mix(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(HASHES + 1, 2 * HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


@dataclass(frozen=True)
class Banding:
    """Bands of rows hashes each, and bounds[b]: the least number of equal one-byte hashes, of the first (b + 1) * BATCH,
    with which a pair stays."""

    percent: int
    bands: int
    rows: int
    bounds: tuple[int, ...]


@lru_cache(maxsize=8)
def banding(percent: int) -> Banding:
    """The most selective bands within HASHES that overlook a pair at the threshold with a chance of UNSEEN; 85: 39 x 8, 80: 52 x 7.

    Bounds: the prior of the similarity s is uniform, and one-byte hashes agree with probability s + (1 - s) / 256.
    """
    least = percent / 100
    bands = lambda r: math.ceil(math.log(UNSEEN) / math.log1p(-(least**r))) if least < 1 else 1
    rows = next(r for r in range(12, 0, -1) if r * bands(r) <= HASHES)
    s = (np.arange(2000) + 0.5) / 2000
    p, high, bounds = s + (1 - s) / 256, s >= least, []
    for n in range(BATCH, rows * bands(rows) + 1, BATCH):
        m = np.arange(n + 1)[:, None]
        log_l = m * np.log(p) + (n - m) * np.log1p(-p)
        w = np.exp(log_l - log_l.max(axis=1, keepdims=True))
        bounds.append(int(np.argmax(w[:, high].sum(axis=1) / w.sum(axis=1) >= MISS)))
    return Banding(percent, bands(rows), rows, tuple(bounds))


def minima(shingles: np.ndarray, n: int = HASHES) -> np.ndarray:
    """The least of each of n hash functions over a set of shingle hashes; in pieces, so that long texts fit."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        h = _A[:n, None] * x[None, i : i + 256]
        h += _B[:n, None]
        np.minimum(out, h.min(axis=1), out=out)
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band, its number included."""
    acc = np.arange(1, bands + 1, dtype=np.uint64)
    for column in signature.reshape(bands, -1).T.astype(np.uint64):
        acc = mix(acc ^ column)
    return acc.view(np.int64)


DIGEST = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"


def digest(raw: bytes | None, plan: Banding) -> tuple[int, int | None, int | None, list[int]]:
    """n_shingles, a 128-bit hash of the set (null if empty), band keys."""
    s = shingle_set(raw)
    if not len(s):
        return 0, None, None, []
    with np.errstate(over="ignore"):
        h1, h2 = (int(mix(s ^ np.uint64(k)).sum(dtype=np.uint64).astype(np.int64)) for k in (0x243F6A8885A308D3, 0x13198A2E03707344))
    return len(s), h1, h2, band_keys(minima(s, plan.bands * plan.rows), plan.bands).tolist()


def candidate_groups(digests: DataFrame) -> DataFrame:
    """Rows (node, component) of those representatives that share a band key with another, directly or through others."""
    reps = digests.where("h1 is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    keys = reps.select("doc_id", F.explode("bands").alias("key"))
    # a bucket's smallest member by partial minima; buckets of one are dropped before anything is joined
    least = keys.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    return components(keys.join(least, "key").where("least < doc_id").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct())


class Block:
    """Texts of one block: ids, shingle sets and signatures of one byte a hash."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        self.signs: list[np.ndarray] = []

    def add(self, doc_id: int, raw: bytes) -> None:
        s = shingle_set(raw)
        self.ids.append(doc_id)
        self.sets.append(s)
        self.signs.append(one_byte(minima(s)))


def one_byte(signature: np.ndarray) -> np.ndarray:
    """A byte of each mixed minimum: the minima of long texts are all near 0, so none of their own bytes tells them apart."""
    return mix(signature.astype(np.uint64)).astype(np.uint8)


def _root(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on full sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def verify(left: Block, right: Block | None, plan: Banding) -> Iterator[tuple[int, int]]:
    """Confirmed links within left, or if right is given between left and right, that join what wasn't joined in here."""
    other = right or left
    signs, sizes = np.array(other.signs), np.array([len(s) for s in other.sets])
    parent: dict[int, int] = {}
    for i, mine in enumerate(left.signs):
        js = np.arange(i + 1 if right is None else 0, len(other.ids))
        n = len(left.sets[i])
        js = js[(100 * sizes[js] >= plan.percent * n) & (100 * n >= plan.percent * sizes[js])]
        equal = np.zeros(len(js), np.int32)
        for b, bound in enumerate(plan.bounds):
            if not len(js):
                break
            part = slice(b * BATCH, (b + 1) * BATCH)
            equal += (signs[js, part] == mine[part]).sum(axis=1, dtype=np.int32)
            stay = equal >= bound
            js, equal = js[stay], equal[stay]
        for j in js[np.argsort(-equal, kind="stable")].tolist():
            x, y = _root(parent, left.ids[i]), _root(parent, other.ids[j])
            if x != y and linked(left.sets[i], other.sets[j], plan.percent):
                parent[max(x, y)] = min(x, y)
                yield left.ids[i], other.ids[j]


def confirmed_links(docs: DataFrame, groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows (a, b): links within the candidate groups that hold on full sets and span their components.

    A group larger than a block is split by the hash of its ids into blocks, and every pair of its blocks is one piece of work,
    so that no task holds more than two blocks. Texts are read again for the members of groups alone; a repeated id has all of its texts.
    """
    plan = banding(percent)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").cast("binary").alias("raw"))
    members = groups.join(texts, "node").where(F.length("raw") > 0).groupBy("component", "node", F.md5("raw").alias("text")).agg(F.first("raw").alias("raw")).drop("text")
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.length("raw")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    placed = members.join(sizes.select("component", blocks.alias("blocks")), "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    work = placed.withColumn("with", F.explode(every)).select(
        "component", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"), F.col("block"), "node", "raw"
    )
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left, right = None, Block(), Block()

        def close() -> pa.RecordBatch | None:
            links = [] if at is None else list(verify(left, None if at[1] == at[2] else right, plan))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"]) if links else None

        for batch in batches:
            for component, p, q, block, node, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (component, p, q):
                    if (done := close()) is not None:
                        yield done
                    at, left, right = (component, p, q), Block(), Block()
                (left if block == p else right).add(node, raw)
        if (done := close()) is not None:
            yield done

    dealt = work.repartition("component", "p", "q").sortWithinPartitions("component", "p", "q", "node")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of docs (doc_id, text).

    Words are lower-cased (A-Z) runs without ASCII white space; a set has the distinct runs of five words, or of fewer words
    the whole sequence. Null and empty texts have no set, and are their own component. Rows with a null doc_id are linked with
    nothing, have a null component_id and are kept. doc_id is the key: rows that repeat it have one class. Other columns are
    left out; an empty table gives an empty one.
    """
    plan = banding(percent)
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw"))
    digests = durable(map_rows(raw, ["doc_id", "raw"], DIGEST, lambda: lambda doc_id, raw: [(doc_id, *digest(raw, plan))]))
    known = digests.where("doc_id is not null and h1 is not null").select("doc_id", "h1", "h2", "bands")
    links = confirmed_links(docs, candidate_groups(known), percent)
    ids = known.select("doc_id", "h1", "h2")
    firsts = durable(ids.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")))
    # an id with several texts joins what these are linked with
    several = ids.groupBy("doc_id").agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("h1", "h2"))).where("min_h1 < max_h1 or min_h2 < max_h2")
    theirs = ids.join(several.select("doc_id"), "doc_id", "left_semi").join(firsts, ["h1", "h2"]).select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    classes = components(links.unionByName(theirs)).withColumnRenamed("node", "first")
    # copies meet at their set's smallest id, then all that is linked at the component's. Sets of very many rows go to every
    # task: each has more than one row in HOT_SETS, so there are no more of them than that; the other sets meet their rows in a shuffle
    entries = durable(firsts.join(classes, "first", "left").select("h1", "h2", "rows", F.coalesce("component", "first").alias("component")))
    hot = F.broadcast(entries.where(F.col("rows") > max(64, digests.count() // HOT_SETS)).select("h1", "h2", "component"))
    rows = digests.select("doc_id", "n_shingles", "h1", "h2")
    met = rows.join(hot, ["h1", "h2"]).unionByName(rows.join(hot, ["h1", "h2"], "left_anti").join(entries.drop("rows"), ["h1", "h2"], "left"))
    return met.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


#: Ids to drop that go to every task, at most (8 bytes each); more are met by a shuffle.
DROPPED_IDS = 1_000_000


def keep_one(docs: DataFrame, percent: int) -> DataFrame:
    """The rows of docs, with all of their columns, but for those that near_duplicates() doesn't keep.

    Null and empty texts and null ids stay; rows that repeat an id stay or go together; an empty table stays empty.
    """
    dropped = durable(near_duplicates(docs, percent).where(~F.col("kept")).select("doc_id").distinct())
    return docs.join(F.broadcast(dropped) if dropped.count() <= DROPPED_IDS else dropped, "doc_id", "left_anti")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents through near_duplicates() at PERCENT."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
with recursive word_lists as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
    from documents
), shingles as (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [len(w) || ':' || array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
    from word_lists
), sizes as (select doc_id, count(*) as n from shingles group by doc_id
), links as (
    select x.doc_id as a, y.doc_id as b
    from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id join sizes p on p.doc_id = x.doc_id join sizes q on q.doc_id = y.doc_id
    group by x.doc_id, y.doc_id
    having 100 * count(*) >= 85 * (any_value(p.n) + any_value(q.n) - count(*))
), reached as (
    select doc_id as a, doc_id as b from documents
    union
    select r.a, l.b from reached r join links l on l.a = r.b
), classes as (select a as doc_id, min(b) as component_id from reached group by a)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join classes c on c.doc_id = d.doc_id left join sizes s on s.doc_id = d.doc_id
"""
