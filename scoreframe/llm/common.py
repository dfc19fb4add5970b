"""Plumbing that the text operators share: Arrow row maps, shared storage, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows handed to a Python worker at once; a batch of long texts stays this small too.
BATCH_BYTES = 8 << 20

BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds in rows and bytes, so that long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset, in local mode (as in tests), one of our own."""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    at = spark.conf.get("spark.checkpoint.dir", "") or (current.get() if current.isDefined() else "")
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="scoreframe-shared-")
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder: later stages read files, and a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def local_form(url: str) -> str:
    """The mounted path of a file: URL."""
    return url[len("file://"):] if url.startswith("file://") else url[len("file:"):] if url.startswith("file:") else url


def open_shared(url: str, mode: str) -> BinaryIO:
    """A file of the shared folder: local mounts directly, other stores through Arrow's file systems."""
    if "://" not in url or url.startswith("file:"):
        return open(local_form(url), mode)
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(url)
    return fs.open_input_file(at) if mode == "rb" else fs.open_output_stream(at)


def move_shared(old: str, new: str) -> None:
    """Give a file of the shared folder another name, in place of what has it."""
    if "://" not in old or old.startswith("file:"):
        import os

        os.replace(local_form(old), local_form(new))
    else:
        from pyarrow.fs import FileSystem

        fs, at = FileSystem.from_uri(old)
        fs.move(at, FileSystem.from_uri(new)[1])


def make_dir(url: str) -> None:
    if "://" not in url or url.startswith("file:"):
        import os

        os.makedirs(local_form(url), exist_ok=True)
    else:
        from pyarrow.fs import FileSystem

        fs, at = FileSystem.from_uri(url)
        fs.create_dir(at, recursive=True)


def pack(df: DataFrame, column: str, kind: str, most_bytes: int) -> list[str]:
    """Write the rows of df into Arrow files of about most_bytes of a text or binary column in the shared folder; their names.

    The rows go from tasks to files, and only the names reach the driver. Names are unique, so a repeated task leaves an unnamed
    file at most. An empty df gives no file.
    """
    spark = df.sparkSession
    small_batches(spark)
    folder = shared_path(spark, kind)
    make_dir(folder)
    df = durable(df)
    parts = -(-(df.agg(F.sum(F.length(column))).first()[0] or 0) // most_bytes) or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal size
            name = f"{folder}/{uuid.uuid4().hex}.arrow"
            with open_shared(name, "wb") as f, pa.ipc.new_stream(f, held[0].schema) as w:
                for b in held:
                    w.write_batch(b)
            held.clear()
            size = 0
            return pa.RecordBatch.from_pydict({"name": [name]})

        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index(column))
            start = 0
            for i, v in enumerate(lengths):
                size += len(v.as_py() or b"")
                if size >= most_bytes:
                    held.append(batch.slice(start, i + 1 - start))
                    start = i + 1
                    yield close()
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield close()

    return sorted(r["name"] for r in durable(df.repartition(parts).mapInArrow(run, "name string")).collect())


def unpack(name: str) -> list[tuple]:
    """The rows of one of pack()'s files."""
    with open_shared(name, "rb") as f, pa.ipc.open_stream(f) as r:
        return [tuple(row.values()) for b in r for row in b.to_pylist()]


_RESIDENT: dict = {}


def resident(key, make: Callable):
    """A worker process keeps one large object (a codec, a machine, a cache of hashes) from task to task: the one asked for last.

    Worker processes outlive an operator, and in a pipeline each stage would leave its own behind otherwise.
    """
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def map_rows(
    df: DataFrame,
    columns: list[str],
    schema: str,
    make: Callable[[], Callable[..., Iterable[tuple]]],
) -> DataFrame:
    """Each row's columns go to the function that make() returns on the worker; its tuples are the result's rows.

    make() runs once per task, so tables that it builds are built once. Columns keep Arrow's types;
    cast text to binary beforehand to get bytes.
    """
    small_batches(df.sparkSession)
    out = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, work = to_arrow_schema(out), make()
        for batch in batches:
            rows = [row for values in zip(*(c.to_pylist() for c in batch.columns), strict=True) for row in work(*values)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(run, out)


def tally(df: DataFrame, columns: list[str], schema: str, make: Callable[[], tuple[Callable[..., None], Callable[[], Iterable[tuple]]]]) -> DataFrame:
    """Each task's rows go to the first function that make() returns; the second gives the task's result rows at its end."""
    small_batches(df.sparkSession)
    out = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        add, finish = make()
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                add(*values)
        if rows := list(finish()):
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(run, out)


#: Rows of a lookup table, of two or three numbers each, that go to every task at most.
BROADCAST_ROWS = 200_000


def lookup(df: DataFrame, key: list[str], entries: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with the columns of entries (unique by key) that belong to each row's key, null where there are none; both are read more than once.

    A table of up to `rows` entries goes to every task. Of a larger one, the entries of hot keys do, of which there are
    at most that many, as each has more than its share of df; all other rows meet their entries in a shuffle, in which no key has
    more than that share.
    """
    if entries.limit(rows + 1).count() <= rows:
        return df.join(F.broadcast(entries), key, "left")
    hot = df.groupBy(*key).count().where(F.col("count") > max(64, df.count() // max(1, rows))).drop("count")
    hot = durable(entries.join(hot, key, "left_semi"))
    rest = df.join(F.broadcast(hot.select(*key)), key, "left_anti").join(entries, key, "left")
    return df.join(F.broadcast(hot), key).unionByName(rest)


def components(edges: DataFrame, low: str = "a", high: str = "b") -> DataFrame:
    """Rows (node, component): every node of edges with the smallest node that it reaches.

    Labels spread by hooking each label onto the smallest neighbouring one and jumping pointers; the number of
    rounds grows with the logarithm of a component's diameter. A node with many edges is reduced by
    partial minima before the shuffle. Each round is written to the shared folder, so lineage stays short.
    """
    spark = edges.sparkSession
    e = durable(
        edges.select(F.least(low, high).alias("a"), F.greatest(low, high).alias("b")).where("a < b").distinct()
    )
    # every node points at a smaller or equal node; start from the smallest neighbour
    ends = e.select(F.col("a").alias("node"), F.col("a").alias("to")).union(e.select(F.col("b").alias("node"), F.col("a").alias("to")))
    label = durable(ends.groupBy("node").agg(F.min("to").alias("to")))
    while True:
        # jump: node -> label of its label
        up = label.select(F.col("node").alias("to"), F.col("to").alias("up"))
        jumped = label.join(up, "to", "left").select("node", F.coalesce("up", "to").alias("to"))
        # hook: both ends of an edge see the smaller label, and so do their old labels
        la, lb = jumped.select(F.col("node").alias("a"), F.col("to").alias("ta")), jumped.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        seen = e.join(la, "a").join(lb, "b").where("ta <> tb").select(F.least("ta", "tb").alias("least"), "a", "b", "ta", "tb")
        told = seen.select(F.explode(F.array("a", "b", "ta", "tb")).alias("node"), F.col("least").alias("to"))
        fresh = durable(jumped.union(told).groupBy("node").agg(F.min("to").alias("to")))
        changed = fresh.join(label.withColumnRenamed("to", "was"), "node").where("to <> was").limit(1).count()
        label = fresh
        if not changed:
            break
    return label.select("node", F.col("to").alias("component"))
