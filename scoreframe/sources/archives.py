"""Recognition projects as a data source: a row a sheet, read by its range out of its archive, and a row of what went wrong for what can't be read.

    archives.register(spark)
    sheets = spark.read.format("score_sheets").option("pattern", "*.omr").load(folder)

Planning reads the directories at the archives' ends, in parallel; each sheet is then a partition of its own, which reads that member and nothing
else. With more than PLANNED archives, an archive is a partition and reads its own directory, with the same rows.
"""

from __future__ import annotations

import fnmatch
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import urlparse
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scoreframe.sources.score_files import SHEET

SCHEMA = "song string, sheet int, path string, xml binary, status string"

PLANNED = 4096


def _store(url: str):
    """(file system, path within it) of a URL or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(url) if urlparse(url).scheme else (fs.LocalFileSystem(), url)


def archives(folder: str, pattern: str) -> list[str]:
    """Paths of the files under folder whose names match, by name."""
    from pyarrow import fs

    store, at = _store(folder)
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(f.path for f in found if f.is_file and fnmatch.fnmatch(f.base_name, pattern))


@dataclass
class Member(InputPartition):
    """A sheet's place in its archive; without a sheet, an archive that is still to be looked into, or an error."""

    path: str
    sheet: int | None = None
    start: int = 0
    size: int = 0
    method: int = 0
    crc: int = 0
    error: str | None = None


def directory(folder: str, path: str) -> list[Member]:
    """The sheets of an archive by number; one row of the error if it has no readable directory or no sheets."""
    try:
        with _store(folder)[0].open_input_file(path) as f, zipfile.ZipFile(f) as z:
            found = [(int(m[1]), i) for i in z.infolist() if (m := SHEET.search(i.filename))]
        if not found:
            return [Member(path, error="no sheets")]
        return [Member(path, n, i.header_offset, i.compress_size, i.compress_type, i.CRC) for n, i in sorted(found, key=lambda x: x[0])]
    except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter where a file is too short to seek in
        return [Member(path, error="no ZIP directory")]
    except Exception as e:  # whatever else is wrong with a file is its row
        return [Member(path, error=f"{type(e).__name__}: {e}"[:200])]


def member_bytes(f, m: Member) -> bytes:
    """One member's content, from its local header on; ValueError if it isn't what the directory says."""
    f.seek(m.start)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError("no member where the directory says")
    f.seek(m.start + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
    raw = f.read(m.size)
    if len(raw) < m.size:
        raise ValueError("the archive ends within a member")
    if m.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"compression {m.method}")
    out = zlib.decompress(raw, -15) if m.method else raw
    if zlib.crc32(out) != m.crc:
        raise ValueError("checksum")
    return out


class SheetReader(DataSourceReader):
    def __init__(self, folder: str, pattern: str):
        self.folder, self.pattern = folder, pattern

    def partitions(self) -> list[InputPartition]:
        paths = archives(self.folder, self.pattern)
        if len(paths) > PLANNED:
            return [Member(p) for p in paths]
        with ThreadPoolExecutor(32) as pool:
            return [m for found in pool.map(lambda p: directory(self.folder, p), paths) for m in found]

    def read(self, partition: Member) -> Iterator[tuple]:
        undecided = partition.sheet is None and partition.error is None
        for m in directory(self.folder, partition.path) if undecided else [partition]:
            song = m.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            if m.error:
                yield song, None, m.path, None, m.error
                continue
            try:
                with _store(self.folder)[0].open_input_file(m.path) as f:
                    xml = member_bytes(f, m)
                ElementTree.fromstring(xml)
                yield song, m.sheet, m.path, xml, "ok"
            except Exception as e:
                yield song, m.sheet, m.path, None, f"{type(e).__name__}: {e}"[:200]


class SheetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "score_sheets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SheetReader(self.options["path"], self.options.get("pattern", "*.omr"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SheetSource)


def sheets(spark: SparkSession, folder: str, pattern: str = "*.omr") -> DataFrame:
    """Rows (song, sheet, path, xml, status) of all sheets, and one for what can't be read."""
    register(spark)
    return spark.read.format("score_sheets").option("pattern", pattern).load(folder)


def outcomes(sheets: DataFrame) -> DataFrame:
    """Rows (song, n_sheets, n_failed, status, error): status is ok, partial or failed; of several errors that of the first sheet counts."""
    bad = F.col("status") != "ok"
    out = sheets.groupBy("song").agg(F.count_if(~bad).alias("n_sheets"), F.count_if(bad).alias("n_failed"), F.min_by("status", F.when(bad, F.coalesce("sheet", F.lit(-1)))).alias("error"))
    status = F.when(F.col("n_failed") == 0, "ok").when(F.col("n_sheets") > 0, "partial").otherwise("failed")
    return out.select("song", "n_sheets", "n_failed", status.alias("status"), F.when(F.col("n_failed") > 0, F.col("error")).alias("error"))
