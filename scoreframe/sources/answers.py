"""A keyed store of answers in a shared folder, and chains of recognisers that answer each different image once.

The store is a folder of batches and a log. A batch is written by a Spark job and becomes part of the store when the log's next entry, which
names it, is made; of two writers only one can make an entry, and the other takes out what the first has brought and tries the
next. Readers see whole entries alone, so lost tasks, repeated ones and broken writers leave nothing but a batch without a name.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.functions.text import content_id
from scoreframe.sources.sinks import retried


class AnswerStore:
    """Rows of a schema, one a key, in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str]):
        self.spark, self.folder, self.schema, self.key = spark, folder.rstrip("/"), schema, key

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def entries(self) -> list[tuple[int, str, str]]:
        """(number, verb, batch) of the log: add, or all, which stands for everything before."""
        fs, log = self._fs(), self._path("log")
        if not fs.exists(log) or not fs.listStatus(log):
            return []
        lines = self.spark.read.schema("value string").text(f"{self.folder}/log").select("value").collect()
        found = sorted((int(n), verb, batch) for n, verb, batch in (r["value"].split(" ") for r in lines))
        start = max((i for i, e in enumerate(found) if e[1] == "all"), default=0)
        return found[start:]

    def _rows(self, batches: list[str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/data/{b}" for b in batches))

    def read(self) -> DataFrame:
        return self._rows([b for _, _, b in self.entries()])

    def _enter(self, number: int, verb: str, batch: str) -> bool:
        """Make the log's entry of that number; False if another writer has."""
        fs, name = self._fs(), f"{number:012d}"
        fs.mkdirs(self._path("log"))
        fs.mkdirs(self._path("tmp"))
        tmp = self._path(f"tmp/{uuid.uuid4().hex}")
        out = fs.create(tmp)
        out.write(bytearray(f"{number} {verb} {batch}\n".encode()))
        out.close()
        if fs.getUri().getScheme() == "file":
            # a link fails where its name is taken, which a local rename doesn't
            local = lambda p: p.toUri().getPath()
            try:
                os.link(local(tmp), local(self._path(f"log/{name}")))
                return True
            except FileExistsError:
                return False
            finally:
                fs.delete(tmp, False)
        if fs.exists(self._path(f"log/{name}")) or not fs.rename(tmp, self._path(f"log/{name}")):
            fs.delete(tmp, False)
            return False
        return True

    def _write(self, rows: DataFrame) -> str:
        batch = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/data/{batch}")
        return batch

    def add(self, fresh: DataFrame) -> int:
        """Put in the rows whose key the store lacks, of equal keys the least row; the number of the entry. Rows with a null in their key are left out."""
        columns = [c.split()[0] for c in self.schema.split(", ")]
        rest = [c for c in columns if c not in self.key]
        least = fresh.dropna(subset=self.key).groupBy(*self.key).agg(F.min(F.struct(*rest)).alias("_r")).select(*self.key, *(f"_r.{c}" for c in rest)).select(*columns)
        seen = self.entries()
        batch = self._write(least.join(self._rows([b for _, _, b in seen]), self.key, "left_anti"))
        number = seen[-1][0] if seen else 0
        while not self._enter(number + 1, "add", batch):
            later = [e for e in self.entries() if e[0] > number]
            batch = self._write(self._rows([batch]).join(self._rows([b for _, _, b in later]), self.key, "left_anti"))
            number = later[-1][0]
        return number + 1

    def compact(self) -> int:
        """One batch in place of all so far; batches stay on disk for readers that still use them."""
        while True:
            seen = self.entries()
            if len(seen) < 2:
                return seen[-1][0] if seen else 0
            batch = self._write(self._rows([b for _, _, b in seen]))
            if self._enter(seen[-1][0] + 1, "all", batch):
                return seen[-1][0] + 1


Model = Callable[[list[bytes]], list[tuple[str, float] | None]]


@dataclass(frozen=True)
class Stage:
    """A recogniser, and which of its answers are accepted; None for an image is a failure, which isn't kept."""

    name: str
    model: Model
    accept: Callable[[Column, Column], Column] = lambda chord, conf: F.col("chord") != ""


def patient(call: Callable[[bytes], tuple[str, float]], attempts: int = 5, sleep: Callable[[float], None] | None = None, fatal: Callable[[Exception], bool] = lambda e: False) -> Model:
    """A model from a call for one image that may fail: tried again with growing waits, and given up as None."""

    def run(images: list[bytes]) -> list[tuple[str, float] | None]:
        out: list[tuple[str, float] | None] = []
        for image in images:
            try:
                out.append(retried(lambda image=image: call(image), attempts, sleep=sleep, fatal=fatal))
            except Exception:
                out.append(None)
        return out

    return run


ANSWERS = "stage string, id string, chord string, conf double"


def answer_store(spark: SparkSession, folder: str) -> AnswerStore:
    return AnswerStore(spark, folder, ANSWERS, ["stage", "id"])


def _asked(todo: DataFrame, stage: Stage) -> DataFrame:
    model, name = stage.model, stage.name

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = model([bytes(c) for c in batch["_c"]])
            rows = [(name, i, a[0], float(a[1])) for i, a in zip(batch["_id"], got, strict=True) if a is not None]
            yield pd.DataFrame(rows, columns=["stage", "id", "chord", "conf"])

    return todo.mapInPandas(run, ANSWERS)


def recognise_in_stages(images: DataFrame, stages: list[Stage], content: str, store: AnswerStore) -> DataFrame:
    """images with chord, conf and stage: of the first stage that gives an accepted answer, else null.

    A stage is asked only about images that no stage before has settled, once for equal ones, and not about those that the store has an answer
    of it for. Its answers go into the store before the next stage begins, so that a later failure costs none of them; a
    task that is run again asks again. Null images stay open.
    """
    keyed = images.withColumn("_id", content_id(F.col(content)))
    # images of one id are equal, so that any of them will do
    left = keyed.where("_id is not null").groupBy("_id").agg(F.first(content).alias("_c"))
    settled: DataFrame | None = None
    for stage in stages:
        known = store.read().where(F.col("stage") == stage.name)
        store.add(_asked(left.join(known.select(F.col("id").alias("_id")), "_id", "left_anti"), stage))
        known = store.read().where((F.col("stage") == stage.name) & stage.accept(F.col("chord"), F.col("conf")))
        known = known.select(F.col("id").alias("_id"), "chord", "conf", "stage")
        known = known if settled is None else known.join(settled.select("_id"), "_id", "left_anti")
        settled = known if settled is None else settled.unionByName(known)
        left = left.join(known.select("_id"), "_id", "left_anti")
    if settled is None:
        return images.withColumns({"chord": F.lit(None).cast("string"), "conf": F.lit(None).cast("double"), "stage": F.lit(None).cast("string")})
    return keyed.join(settled, "_id", "left").drop("_id")
