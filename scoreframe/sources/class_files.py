"""Binary files by class: a data-source writer of rows (label, name, content) as <label>/<name>.

    class_files.register(spark)
    rows.write.format("class_files").mode("append").save(folder)

Tasks write into a folder of the job. When all have succeeded, the commit moves the files to their places, which depend on the rows alone, so that a
repeated job changes nothing; a file that is there stays. An abort, and a commit's end, remove the job's folder. Attempts of one task write under names of
their own, and only those of the attempts that count are moved.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from scoreframe.functions.text import safe_filename
from scoreframe.sources.archives import _store

SCHEMA = "label string, name string, content binary"


@dataclass
class Written(WriterCommitMessage):
    """One attempt's folder."""

    folder: str
    files: int


class ClassWriter(DataSourceWriter):
    def __init__(self, folder: str, columns: list[str]):
        self.folder, self.columns, self.job = folder.rstrip("/"), columns, f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        fs, root = _store(self.folder)
        at, made, n = f"{root}/{self.job}/{uuid.uuid4().hex}", set(), 0
        for row in iterator:
            label, name, content = (row[c] for c in self.columns)
            if label is None or name is None or content is None:
                continue
            if "/" in label + name or not label.strip(".") or not name.strip("."):
                raise ValueError(f"no file name: {label}, {name}")
            if label not in made:
                fs.create_dir(f"{at}/{label}", recursive=True)
                made.add(label)
            with fs.open_output_stream(f"{at}/{label}/{name}") as f:
                f.write(bytes(content))
            n += 1
        return Written(at, n)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileSelector, FileType

        fs, root = _store(self.folder)
        # a folder an attempt: what is moved at a time is one attempt's list
        for m in (m for m in messages if m is not None and m.files):
            files = [f.path for f in fs.get_file_info(FileSelector(m.folder, recursive=True)) if f.is_file]
            places = {f: f"{root}/{f[len(m.folder) + 1 :]}" for f in files}
            for label in {p.rpartition("/")[0] for p in places.values()}:
                fs.create_dir(label, recursive=True)
            there = {i.path for i in fs.get_file_info(list(places.values())) if i.type != FileType.NotFound}
            with ThreadPoolExecutor(16) as pool:
                list(pool.map(lambda f: None if places[f] in there else fs.move(f, places[f]), files))  # noqa: B023
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow.fs import FileType

        fs, root = _store(self.folder)
        if fs.get_file_info(f"{root}/{self.job}").type != FileType.NotFound:
            fs.delete_dir(f"{root}/{self.job}")


class ClassFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "class_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("files are added; there is nothing that overwrite would replace")
        return ClassWriter(self.options["path"], ["label", "name", "content"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ClassFiles)


def crop_name(project: Column, sheet: Column, x: Column, y: Column) -> Column:
    """A crop's file name: twelve digits of a digest of where it was cut."""
    place = F.concat(project, F.lit(":"), sheet, F.lit(":"), x.cast("int").cast("string"), F.lit(","), y.cast("int").cast("string"))
    return F.concat(F.substring(F.sha1(place.cast("binary")), 1, 12), F.lit(".png"))


def write_classes(rows: DataFrame, folder: str, label: str = "label", name: str = "name", content: str = "content") -> None:
    """Rows as files by class, under names that file systems take."""
    register(rows.sparkSession)
    out = rows.select(safe_filename(F.col(label)).alias("label"), F.col(name).alias("name"), F.col(content).alias("content"))
    out.write.format("class_files").mode("append").save(folder)
