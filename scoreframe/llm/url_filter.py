"""URL rules, and an exact blocklist as a cascade of Bloom filters over all keys of the corpus."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.llm.common import durable, make_dir, move_shared, open_shared, resident, shared_path, small_batches, table
from scoreframe.llm.shingles import mix

#: (verdict, host, path): a rule fits its host and all subdomains where the URL's path starts with its own; the longest wins.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Keys for which one task builds the filters.
SHARD_KEYS = 1_000_000

#: Bytes of filters that a worker keeps at hand; other shards are read again.
CACHED_BYTES = 256 << 20


def host(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty for null or without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """From the host's end to the next ? or #."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    _, h, p = rule
    return ((host == h) | host.endswith("." + h)) & path.startswith(p)


def by_rule(host: Column, path: Column, value: int | None = None, rules=RULES) -> Column:
    """The longest fitting rule, or its verdict if value is 0; null if none fits."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2])):
        out = F.when(_fits(host, path, rule), F.lit(rule[1] + rule[2] if value is None else rule[value])).otherwise(out)
    return out


def _bits(h1: np.ndarray, h2: np.ndarray, level: int, i: int, m: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return (mix(h1 ^ salt) + np.uint64(i) * (mix(h2 ^ salt) | np.uint64(1))) % np.uint64(m)


def _has(filter_: tuple[int, int, np.ndarray], level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    m, k, bits = filter_
    out = np.ones(len(h1), bool)
    for i in range(k):
        at = _bits(h1, h2, level, i, m)
        out &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def build(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """Levels (bits, hashes, bytes): level 0 holds the listed keys, each later one the keys that the one before takes in
    wrongly, until none is left. Every key given here is then answered exactly; no listed and unlisted one may be the same."""
    levels: list[tuple[int, int, np.ndarray]] = []
    inside, outside = (h1[listed], h2[listed]), (h1[~listed], h2[~listed])
    while len(inside[0]):
        p = min(0.5, len(inside[0]) / (math.sqrt(2) * max(1, len(outside[0])))) if not levels else 0.5
        k = max(1, round(-math.log2(p)))
        m = max(64, math.ceil(len(inside[0]) * k * math.log2(math.e)))
        bits = np.zeros((m + 7) // 8, np.uint8)
        for i in range(k):
            at = _bits(*inside, len(levels), i, m)
            np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        levels.append((m, k, bits))
        wrong = _has(levels[-1], len(levels) - 1, *outside)
        inside, outside = (outside[0][wrong], outside[1][wrong]), inside
    return levels


def member(levels: list[tuple[int, int, np.ndarray]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which keys are listed: the parity of the first level that does not have a key."""
    out, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
    for level, f in enumerate(levels):
        open_ = open_[_has(f, level, h1[open_], h2[open_])]
        out[open_] = level % 2 == 0
    return out


@dataclass(frozen=True)
class Cascade:
    """A file of levels for each hash shard in a folder that all workers reach, and the keys that are told by name.

    Two keys of which one is listed may have the same 128 bits: such keys are answered by name. None are expected below
    some 10^18 keys, so the list needs no other bound.
    """

    folder: str
    shards: int
    listed_by_name: frozenset[str] = frozenset()


def hashes(key: Column) -> list[Column]:
    """Two 64-bit hashes, seeded before the key is read, so that they are of different functions."""
    return [F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)]


def shard(h1: str, n: int) -> Column:
    return F.pmod(F.col(h1), F.lit(n)).cast("int")


def _store(url: str, levels: list[tuple[int, int, np.ndarray]]) -> None:
    """Write a shard's levels beside the place and move them there, so that no reader sees a part, whichever attempt is last."""
    with open_shared(beside := f"{url}.{uuid.uuid4().hex}", "wb") as f:
        f.write(np.array([len(levels), *(x for m, k, _ in levels for x in (m, k))], "<i8").tobytes())
        for _, _, bits in levels:
            f.write(bits.tobytes())
    move_shared(beside, url)


def _load(url: str) -> list[tuple[int, int, np.ndarray]]:
    with open_shared(url, "rb") as f:
        raw = np.frombuffer(f.read(), np.uint8)
    n = int(raw[:8].view("<i8")[0])
    head, at, levels = raw[8 : 8 + 16 * n].view("<i8").tolist(), 8 + 16 * n, []
    for m, k in zip(head[::2], head[1::2], strict=True):
        size = (m + 7) // 8
        levels.append((m, k, raw[at : at + size]))
        at += size
    return levels


class Shards(dict):
    """Levels by shard as files are asked for; those asked for last are kept, up to CACHED_BYTES."""

    def __init__(self, folder: str):
        self.folder, self.held = folder, 0

    def __missing__(self, n: int):
        levels = _load(f"{self.folder}/{n}")
        size = sum(len(x[2]) for x in levels)
        while self and self.held + size > CACHED_BYTES:
            self.held -= sum(len(x[2]) for x in self.pop(next(iter(self))))
        self.held += size
        self[n] = levels
        return levels


def build_cascade(keys: DataFrame, listed: Column, key: str = "key", shard_keys: int = SHARD_KEYS) -> Cascade:
    """The cascade of all distinct keys, of which listed says whether they are on the list (null: not; of several answers yes counts).

    Shards are by hash of distinct keys, so they are even whatever the keys' numbers of rows. A null key is no key. An
    empty table gives one shard without levels.
    """
    spark = keys.sparkSession
    small_batches(spark)
    named = keys.select(F.col(key).alias("key"), listed.alias("listed")).where("key is not null").groupBy("key").agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed"))
    h1, h2 = hashes(F.col("key"))
    universe = durable(named.select(h1.alias("h1"), h2.alias("h2"), "listed"))
    shards, folder = max(1, -(-universe.count() // shard_keys)), shared_path(spark, "cascade")
    make_dir(folder)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        mixed = pdf.groupby(["h1", "h2"])["listed"].transform("nunique") > 1 if pdf.duplicated(["h1", "h2"]).any() else np.zeros(len(pdf), bool)
        h1, h2 = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
        _store(f"{folder}/{int(pdf['shard'].iloc[0])}", build(h1, h2, pdf["listed"].to_numpy(bool) & ~np.asarray(mixed)))
        return pdf.loc[np.asarray(mixed), ["h1", "h2"]].drop_duplicates()

    _store(f"{folder}/0", [])  # of an empty universe
    unclear = durable(universe.withColumn("shard", shard("h1", shards)).groupBy("shard").applyInPandas(one, "h1 long, h2 long"))
    if unclear.isEmpty():
        return Cascade(folder, shards)
    by_name = named.where("listed").withColumns({"h1": h1, "h2": h2}).join(unclear, ["h1", "h2"], "left_semi")
    return Cascade(folder, shards, frozenset(r["key"] for r in by_name.select("key").collect()))


def with_membership(df: DataFrame, cascade: Cascade, key: str = "key", into: str = "listed") -> DataFrame:
    """df with a column that says exactly, for keys of the universe from which the cascade was built, whether they are listed.

    It is false for null keys. A column of that name is replaced; all others stay as they are, whatever their names. No row
    moves: each worker reads the shards that its rows ask for.
    """
    small_batches(df.sparkSession)
    df = df.drop(into)
    own = [n for i in range(2) if (n := f"_hash{i + 1}" + "_" * max([0, *map(len, df.columns)]))]
    rows = df.withColumns(dict(zip(own, hashes(F.col(key)), strict=True)))
    out = df.withColumn(into, F.lit(True)).schema

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = resident(("cascade", cascade.folder), lambda: Shards(cascade.folder))
        for b in batches:
            h1, h2 = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in own)
            which, listed = np.mod(h1.view(np.int64), cascade.shards), np.zeros(b.num_rows, bool)
            order = np.argsort(which, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(which[order])) + 1) if len(order) else []:
                listed[at] = member(levels[int(which[at[0]])], h1[at], h2[at])
            names = b.column(b.schema.get_field_index(key))
            if cascade.listed_by_name:
                listed |= np.array([v in cascade.listed_by_name for v in names.to_pylist()], bool)
            listed &= ~np.asarray(names.is_null())
            kept = [n for n in b.schema.names if n not in own]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in kept), pa.array(listed)], names=[*kept, into])

    return rows.mapInArrow(probe, out)


def feed(key: Column) -> Column:
    """The stated list that stands in for a blocklist feed: keys whose MD5 begins with 0."""
    return F.md5(key.cast("binary")).startswith("0")


def judge_urls(pages: DataFrame, listed=feed, rules=RULES) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, listed): the longest fitting rule's verdict, else block for listed keys (host and path).

    A null URL, or one without ://, has an empty host and path, fits no rule and is judged as the empty key. A null
    page_id is kept; repeated rows stay repeated; other columns are left out; an empty table gives an empty one.
    """
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("key", F.concat("host", "path"))
    out = with_membership(urls, build_cascade(urls, listed(F.col("key"))))
    h, p = F.col("host"), F.col("path")
    return out.select(
        "page_id", "host", "path", by_rule(h, p, rules=rules).alias("rule"),
        F.coalesce(by_rule(h, p, 0, rules), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed",
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages through judge_urls()."""
    return judge_urls(table(spark, sf_dir, "pages"))


OP4_SQL = r"""
with u as (
    select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
    from pages
), r as (
    select *, case
        when (host = 'example.org' or suffix(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
        when (host = 'example.org' or suffix(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
        when (host = 'com' or suffix(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
        when (host = 'com' or suffix(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
        when (host = 'org' or suffix(host, '.org')) and starts_with(path, '/') then 'org/' end as rule,
        starts_with(md5(host || path), '0') as listed
    from u
)
select page_id, host, path, rule, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
    when listed then 'block' else 'allow' end as verdict, listed
from r
"""
