"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

Documents are partitioned by the power of two above their number of shingles. A partition's sketch has one bin for each
shingle that its largest document can have, and keeps the least hash of each bin (one-permutation MinHash), so that a
document's load per bin is at most one however long it is, and a shared shingle stays its bin's least hash with a chance
of 1 - 1/e or more. A test item of q shingles shares t * q of them with a document that contains it, and each of those
that is also the least of its bin in the item's own sketch of the same partition gives a collision. The least hashes of
the union's bins are a random choice of its shingles, so all s shared ones are lost with a chance of LOSS^s at most.

Items for which this is over MISS aren't left to the sketch. Of q shingles at most q - s can be missing, so any q - s + 1
of them have a shared one: these, the item's rarest in the block, are looked up among all of the document's shingles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.llm.common import map_rows, pack, small_batches, table, unpack
from scoreframe.llm.shingles import WIDTH, all_shingles, words_of

THRESHOLD = 0.8

#: Bytes of items searched at once; larger benchmarks go over the documents in several such blocks. Bounds what a worker holds.
BLOCK_BYTES = 4 << 20

#: The chance to miss a contained item at most, and to lose a shared shingle: the union of a document and an item that it
#: contains by 0.8 or more has a load per bin of 1.25 at most.
MISS, LOSS = 1e-9, 1 - (1 - math.exp(-1.25)) / 1.25

#: Partitions: documents of up to 2^4, 2^5, ... 2^40 shingles.
LEAST_BITS, MOST_BITS = 4, 40


def partition_bits(n: int) -> int:
    """The partition of a document of n distinct shingles: bins as a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, int(n - 1).bit_length())) if n else LEAST_BITS


def bin_minima(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    """The least hash of each bin that isn't empty; a hash's bin is its leading bits."""
    if not len(sorted_hashes):
        return sorted_hashes
    bins = sorted_hashes >> np.uint64(64 - bits)
    return sorted_hashes[np.concatenate([[True], bins[1:] != bins[:-1]])]


def exact(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """Shingles as words, for the verification."""
    if len(words) < WIDTH:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(WIDTH)), strict=False))


def least_shared(n: int, threshold: float) -> int:
    """The shingles that a text has to share with an item of n."""
    return max(1, math.ceil(threshold * n))


def in_order(hashes: list[np.ndarray], owners: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """All hashes in order, and the owner of each."""
    values = np.concatenate([*hashes, np.empty(0, np.uint64)])
    owner = np.repeat(np.array(owners, np.int64), [len(h) for h in hashes])
    order = np.argsort(values, kind="stable")
    return values[order], owner[order]


def met(mine: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> set[int]:
    """Owners in the table of any of the hashes."""
    values, owners = table
    if not len(values):
        return set()
    lo, hi = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
    return {int(owners[i]) for k in np.flatnonzero(hi > lo) for i in range(lo[k], hi[k])}


class ItemIndex:
    """Sketches of the longer test items for each partition, made when a partition is first met; a table of the shorter ones."""

    def __init__(self, items: list[tuple[int, bytes]], threshold: float):
        self.threshold = threshold
        self.items = [(i, raw) for i, raw in items if words_of(raw)]
        self.hashes = [np.unique(all_shingles(words_of(raw))) for _, raw in self.items]
        shared = [least_shared(len(h), threshold) for h in self.hashes]
        # below 0.8 the load of the union isn't bounded as LOSS has it
        short = [i for i, s in enumerate(shared) if threshold < THRESHOLD or LOSS**s > MISS]
        self.long = sorted(set(range(len(shared))) - set(short))
        values, counts = np.unique(np.concatenate([*self.hashes, np.empty(0, np.uint64)]), return_counts=True)
        rarest = lambda h, n: h[np.argsort(counts[np.searchsorted(values, h)], kind="stable")[:n]]
        self.short = in_order([rarest(self.hashes[i], len(self.hashes[i]) - shared[i] + 1) for i in short], short)
        self.sketches: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sketch(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The longer items' bin minima in order, and the item of each."""
        if bits not in self.sketches:
            self.sketches[bits] = in_order([bin_minima(self.hashes[i], bits) for i in self.long], self.long)
        return self.sketches[bits]

    def contained(self, raw: bytes | None) -> list[tuple[int, int, int, float]]:
        """(item_id, item shingles, shared, containment) of the items that a text contains."""
        words = words_of(raw)
        mine = np.unique(all_shingles(words))
        bits = partition_bits(len(mine))
        candidates = sorted(met(mine, self.short) | met(bin_minima(mine, bits), self.sketch(bits)))
        if not candidates:
            return []
        shingles, out = exact(words), []
        for c in candidates:
            item_id, item = self.items[c][0], exact(words_of(self.items[c][1]))
            shared = len(item & shingles)
            if shared >= self.threshold * len(item):
                out.append((item_id, len(item), shared, shared / len(item)))
        return out


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """The stated query set as files of blocks in the shared folder; repeated ids keep their least text, null ids and texts are left out."""
    rows = benchmark.where("item_id is not null and text is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").cast("binary").alias("raw"))
    return pack(rows, "raw", "benchmark", block_bytes)


def index_of(block: str, threshold: float) -> ItemIndex:
    """A task's index of a block."""
    return ItemIndex(sorted(unpack(block)), threshold)


def search(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (doc_id, item_id, item_shingles, shared, containment) for each item of which a whole text has the share threshold.

    Distinct runs of five lower-cased words are compared; an item or text of one to four words is one shingle. Null and
    empty texts, and items without words, match nothing; a document with a null id is reported under null; repeated rows
    are reported each; an empty table on either side gives an empty one. Each task searches its own documents: nothing of
    them is shuffled.
    """
    raw = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("raw"))
    schema = "doc_id long, item_id long, item_shingles long, shared long, containment double"
    out = docs.sparkSession.createDataFrame([], schema)
    for n, block in enumerate(item_blocks(benchmark, block_bytes)):

        def make(block=block):
            index = index_of(block, threshold)
            return lambda doc_id, raw: [(doc_id, *hit) for hit in index.contained(raw)]

        found = map_rows(raw, ["doc_id", "raw"], schema, make)
        out = out.unionByName(found) if n else found
    return out


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all of their columns, that contain no test item; null and empty texts stay, and without items all rows."""
    small_batches(docs.sparkSession)
    schema, out = docs.schema, docs
    for block in item_blocks(benchmark):

        def run(batches, block=block):
            index = index_of(block, threshold)
            for b in batches:
                texts = b.column(b.schema.get_field_index("text")).to_pylist()
                yield b.filter(pa.array([t is None or not index.contained(t.encode()) for t in texts], pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents through search(), for all items of benchmark."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
with word_lists as (
    select 'd' as side, doc_id as id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
    from documents
    union all
    select 'b', item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')
    from benchmark
), shingles as (
    select distinct side, id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
    from word_lists
), sizes as (select id, count(*) as n from shingles where side = 'b' group by id)
select d.id as doc_id, b.id as item_id, any_value(z.n) as item_shingles, count(*) as shared, count(*) / any_value(z.n) as containment
from shingles b join shingles d on b.s = d.s and b.side = 'b' and d.side = 'd' join sizes z on z.id = b.id
group by d.id, b.id
having count(*) >= 0.8 * any_value(z.n)
"""
