"""WARC records in ZIP packages: written one package at a time, read back by ranges through the central directory."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.llm.common import BROADCAST_ROWS, durable, lookup, make_dir, map_rows, open_shared, shared_path, small_batches, table

#: The members that are written; any in ARCHIVES and INDEXES are read.
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVES, INDEXES = re.compile(r"archive/[^/]+\.warc(\.gz)?"), re.compile(r"indexes/[^/]+\.cdxj?(\.gz)?")

#: Bytes read at once where an archive has no index.
CHUNK = 1 << 20

#: A package is closed at about this many bytes.
PACKAGE_BYTES = 32 << 20

DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF


def zip_package(members: list[tuple[str, bytes]], zip64: bool = False) -> Iterator[bytes]:
    """The bytes of a ZIP of stored members; ZIP64 fields where sizes, offsets or counts need them, or everywhere."""
    at, directory = 0, b""
    for name, data in members:
        raw, crc, n = name.encode(), zlib.crc32(data), len(data)
        big = zip64 or n >= _FULL32 or at >= _FULL32
        extra = struct.pack("<HHQQ", 1, 16, n, n) if big else b""
        size = _FULL32 if big else n
        yield struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra
        yield data
        wide = struct.pack("<HHQQQ", 1, 24, n, n, at) if big else b""
        directory += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(wide), 0, 0, 0, 0, _FULL32 if big else at) + raw + wide
        at += 30 + len(raw) + len(extra) + n
    yield directory
    many = zip64 or len(members) >= _FULL16 or at >= _FULL32 or len(directory) >= _FULL32
    if many:
        yield struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, len(members), len(members), len(directory), at)
        yield struct.pack("<IIQI", 0x07064B50, 0, at + len(directory), 1)
    count = _FULL16 if many else len(members)
    yield struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, count, count, _FULL32 if many else len(directory), _FULL32 if many else at, 0)


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header_at: int


class ZipReader:
    """Reads a ZIP's directory and ranges of its stored members; nothing is extracted."""

    def __init__(self, f: BinaryIO):
        self.f = f
        f.seek(0, 2)
        self.length = f.tell()
        self.members = {m.name: m for m in self._directory()}
        self._starts: dict[str, int] = {}

    def _at(self, offset: int, n: int) -> bytes:
        self.f.seek(offset)
        data = self.f.read(n)
        if len(data) != n:
            raise ValueError(f"the package ends before byte {offset + n}")
        return data

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.length - 22 - _FULL16)
        tail = self._at(tail_at, self.length - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and end + 22 + (struct.unpack_from("<H", tail, end + 20)[0] if end + 22 <= len(tail) else 1 << 20) != len(tail):
            end = tail.rfind(b"PK\x05\x06", 0, end)  # the signature may stand in the comment
        if end < 0:
            raise ValueError("no end of central directory")
        count, size, at = struct.unpack_from("<HII", tail, end + 10)
        locator = tail_at + end - 20
        if (_FULL16 == count or _FULL32 in (size, at)) and locator >= 0 and (z := self._at(locator, 20))[:4] == b"PK\x06\x07":
            wide = self._at(struct.unpack_from("<Q", z, 8)[0], 56)
            if wide[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, size, at = struct.unpack_from("<QQQ", wide, 32)
        directory, p = self._at(at, size), 0
        for _ in range(count):
            if directory[p : p + 4] != b"PK\x01\x02":
                raise ValueError("a broken central directory")
            method, = struct.unpack_from("<H", directory, p + 10)
            packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, p + 20)
            header_at, = struct.unpack_from("<I", directory, p + 42)
            name = directory[p + 46 : p + 46 + n_name].decode("utf-8" if struct.unpack_from("<H", directory, p + 8)[0] & 0x800 else "cp437")
            e, extra_end = p + 46 + n_name, p + 46 + n_name + n_extra
            while e + 4 <= extra_end:
                tag, n = struct.unpack_from("<HH", directory, e)
                if tag == 1:  # only the fields that are full in the directory stand here, in this order
                    q = e + 4
                    if plain == _FULL32:
                        plain, q = struct.unpack_from("<Q", directory, q)[0], q + 8
                    if packed == _FULL32:
                        packed, q = struct.unpack_from("<Q", directory, q)[0], q + 8
                    if header_at == _FULL32:
                        header_at = struct.unpack_from("<Q", directory, q)[0]
                e += 4 + n
            yield Member(name, method, packed, header_at)
            p = extra_end + n_comment

    def range(self, name: str, offset: int, n: int) -> bytes:
        """n bytes of a stored member from offset."""
        m = self.members[name]
        if m.method != 0:
            raise ValueError(f"{name} is not stored")
        if offset < 0 or offset + n > m.size:
            raise ValueError(f"{name} has {m.size} bytes")
        if name not in self._starts:  # names and extra fields of the local header may differ from the directory's
            head = self._at(m.header_at, 30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError(f"no local header of {name}")
            self._starts[name] = m.header_at + 30 + sum(struct.unpack_from("<HH", head, 26))
        return self._at(self._starts[name] + offset, n)

    def whole(self, name: str) -> bytes:
        return self.range(name, 0, self.members[name].size)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or where refers_to is given a revisit of that page's response: the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([] if refers_to is None else [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
    block = rest[: int(h["content-length"])]
    if len(block) < int(h["content-length"]):
        raise ValueError(f"the record {h.get('warc-record-id')} is cut short")
    payload, length = block, len(block)
    if h.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = next((int(x.split(b":", 1)[1]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), len(payload))
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:x-page:(-?\d+)>", x or "")) else None
    kind, sha = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and sha and h.get("warc-truncated") is None and digest(payload) != sha:
        raise ValueError(f"the payload of {h['warc-record-id']} differs from its digest")
    return {
        "page_id": number(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": kind, "refers_to": number(h.get("warc-refers-to")) if kind == "revisit" else None,
        "payload_digest": sha or digest(payload), "payload_bytes": length, "payload": None if kind == "revisit" else payload,
    }


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """Write pages (page_id, url, html, refers_to) into ZIP packages in a shared folder; rows (package, records, bytes).

    Each task fills its own packages, under names that no other attempt uses; the rows that come back name the packages
    that count, and a lost attempt leaves an unnamed file at most. The rows are written to the shared folder at once.
    """
    small_batches(pages.sparkSession)
    make_dir(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        index: list[str] = []
        at = 0

        def close() -> pa.RecordBatch:
            nonlocal parts, index, at
            name = f"{folder}/pages-{uuid.uuid4().hex}.wacz"
            with open_shared(name, "wb") as f:
                for piece in zip_package([(WARC_MEMBER, b"".join(parts)), (INDEX_MEMBER, "".join(index).encode())], zip64):
                    f.write(piece)
            row = {"package": [name], "records": [len(index)], "bytes": [at]}
            parts, index, at = [], [], 0
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                gz = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = gz.compress(record(page_id, url, html or b"", refers_to)) + gz.flush()
                index.append(f"{'' if page_id is None else page_id} 20240101000000 {json.dumps({'offset': str(at), 'length': str(len(member)), 'filename': WARC_MEMBER.rpartition('/')[2]})}\n")
                parts.append(member)
                at += len(member)
                if at >= package_bytes:
                    yield close()
        if index:
            yield close()

    rows = pages.select(F.col("page_id").cast("long"), "url", F.col("html").cast("binary").alias("html"), F.col("refers_to").cast("long"))
    return durable(rows.mapInArrow(run, "package string, records long, bytes long"))


def plain(chunks: Iterable[bytes], gz: bool) -> Iterator[bytes]:
    """The chunks, or what they hold in all gzip members one after the other; ValueError where the last member is cut."""
    if not gz:
        yield from chunks
        return
    member = None
    for chunk in chunks:
        while chunk:
            member = member or zlib.decompressobj(31)
            try:
                out = member.decompress(chunk)
            except zlib.error as e:
                raise ValueError(f"broken gzip: {e}") from None
            if out:
                yield out
            chunk = member.unused_data
            if member.eof:
                member = None
    if member is not None:
        raise ValueError("the data end within a gzip member")


def ranges(z: ZipReader, name: str, start: int, stop: int) -> Iterator[bytes]:
    return (z.range(name, at, min(CHUNK, stop - at)) for at in range(start, stop, CHUNK))


def lines_of(z: ZipReader, name: str) -> Iterator[str]:
    """An index line by line, a chunk in memory at a time, through all of its gzip members."""
    held = b""
    for data in plain(ranges(z, name, 0, z.members[name].size), name.endswith(".gz")):
        *lines, held = (held + data).split(b"\n")
        yield from (x.decode("utf-8", "replace") for x in lines)
    yield held.decode("utf-8", "replace")


def index_places(lines: Iterable[str], archives: list[str]) -> Iterator[tuple[str, int, int]]:
    """(archive, offset, length) of each line of an index, in JSON (CDXJ) or in columns named by letters (CDX).

    A line without a file name belongs to the only archive; lines of other files, without a length, or that can't be read are passed over: what they
    would have named is found in the gap that they leave.
    """
    columns: list[str] = "N b a m s k r M S V g".split()
    by_name = {a.rpartition("/")[2]: a for a in archives}
    for line in lines:
        if line.lstrip().startswith("CDX "):
            columns = line.split()[1:]
            continue
        if line.startswith("!") or not line.strip():
            continue
        if "{" in line:
            try:
                place = json.loads(line[line.index("{") :])
            except ValueError:
                continue
            name, offset, length = (place.get(k) for k in ("filename", "offset", "length"))
        else:
            row = dict(zip(columns, line.split(), strict=False))
            name, offset, length = (row.get(k) for k in "gVS")
        archive = by_name.get(str(name).rpartition("/")[2]) if name else archives[0] if len(archives) == 1 else None
        if archive and str(offset or "").isdigit() and str(length or "").isdigit():
            yield archive, int(offset), int(length)


def split_records(data: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a stream, by their lengths; ValueError where it ends within one or holds anything else."""
    held = bytearray()

    def fill(done: Callable[[], bool]) -> bool:
        while not done():
            more = next(data, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        while fill(lambda: len(held) >= 2) and held[:2] == b"\r\n":
            del held[:2]
        if not held.strip(b"\r\n"):
            return
        if not fill(lambda: b"\r\n\r\n" in held):
            raise ValueError("the data end within a record's head")
        end = held.index(b"\r\n\r\n") + 4
        found = re.search(rb"(?im)^content-length: *(\d+)", held[:end])
        if not held.startswith(b"WARC/") or not found:
            raise ValueError("no WARC record where one is expected")
        whole = end + int(found[1])
        if not fill(lambda whole=whole: len(held) >= whole):
            raise ValueError("the data end within a record")
        yield bytes(held[:whole])
        del held[:whole]


def archive_records(z: ZipReader, name: str, places: dict[int, int]) -> Iterator[dict]:
    """Every record of an archive once: those that an index names by offset and length, and those in the gaps between by reading on. What can't be read gives a row with archive, offset and problem."""
    gz, size, at = name.endswith(".gz"), z.members[name].size, 0

    def gap(start: int, stop: int) -> Iterator[dict]:
        try:
            yield from map(parse, split_records(plain(ranges(z, name, start, stop), gz)))
        except (ValueError, KeyError) as e:
            yield {"archive": name, "offset": start, "problem": str(e)}

    for offset, length in sorted(places.items()):
        if offset > at:
            yield from gap(at, min(offset, size))
        try:
            found = parse(b"".join(plain([z.range(name, offset, length)], gz)))
        except (ValueError, KeyError) as e:
            found = {"archive": name, "offset": offset, "problem": str(e)}
        yield found
        at = max(at, offset + length)
    if at < size:
        yield from gap(at, size)


def read_package(url: str) -> Iterator[dict]:
    """The records of a package, each once, however many indexes name it and whether or not one does; and problems, as archive_records gives them."""
    with open_shared(url, "rb") as f:
        z = ZipReader(f)
        archives = sorted(n for n in z.members if ARCHIVES.fullmatch(n))
        places: dict[str, dict[int, int]] = {a: {} for a in archives}
        for index in sorted(n for n in z.members if INDEXES.fullmatch(n)):
            try:
                for archive, offset, length in index_places(lines_of(z, index), archives):
                    places[archive].setdefault(offset, length)
            except ValueError as e:
                yield {"archive": index, "offset": 0, "problem": str(e)}
        for archive in archives:
            yield from archive_records(z, archive, places[archive])


FIELDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"


def read_packages(packages: DataFrame, payloads: bool = False, strict: bool = True) -> DataFrame:
    """A row for each record of the packages named in the column package; with its payload if asked (null for revisits).

    A record that is cut or broken, or an index that can't be read, stops the job; unless strict, it is left out, and problems() lists it. A package
    that is no ZIP stops it in either case.
    """
    names = [x.split()[0] for x in FIELDS.split(", ")] + ["payload"] * payloads

    def rows(url: str) -> Iterator[list]:
        for r in read_package(url):
            if "problem" not in r:
                yield [r[n] for n in names]
            elif strict:
                raise ValueError(f"{url}, {r['archive']} at {r['offset']}: {r['problem']}")

    return map_rows(packages, ["package"], FIELDS + ", payload binary" * payloads, lambda: rows)


def problems(packages: DataFrame) -> DataFrame:
    """Rows (package, archive, at, problem) of what can't be read; a package that is no ZIP has a null archive."""

    def rows(url: str) -> Iterator[tuple]:
        try:
            yield from ((url, r["archive"], r["offset"], r["problem"]) for r in read_package(url) if "problem" in r)
        except (ValueError, OSError) as e:
            yield url, None, None, str(e)

    return map_rows(packages, ["package"], "package string, archive string, at long, problem string", lambda: rows)


def first_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Rows (h, first): the SHA-1 of each payload of least_bytes or more that several page_ids have, and the least of these."""
    ids = pages.where("page_id is not null").where(F.col("n") >= least_bytes).select("h", "page_id")
    return ids.groupBy("h").agg(F.min("page_id").alias("first"), F.max("page_id").alias("most")).where("most > first").drop("most")


def archive(pages: DataFrame, least_bytes: int = 0, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write every row of pages (page_id, url, html) as a WARC record, and return the packages.

    The payload is html in UTF-8, empty for null. Of equal payloads of least_bytes or more, the smallest page_id's is a
    response and the others revisit it. Rows that repeat a responding page_id and payload are responses too; a null
    page_id is always one. A page_id with several payloads has each judged by itself. Other columns are left out; an
    empty table gives no package. Payloads of which there are very many are no hot key: see lookup().
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("h"), F.length(html).alias("n"))
    firsts = durable(first_pages(rows, least_bytes))
    refers_to = F.when((F.col("page_id") > F.col("first")) & (F.col("n") >= least_bytes), F.col("first"))
    return write_packages(lookup(rows, ["h"], firsts, broadcast_rows).withColumn("refers_to", refers_to), shared_path(pages.sparkSession, "warc"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written by archive() and read back by read_packages()."""
    return read_packages(archive(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB's sha1 is hexadecimal; base32 is made of its bits, five at a time.
OP3_SQL = """
with p as (
    select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h, min(page_id) over (partition by coalesce(html, '')) as first_id
    from pages
)
select page_id, payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(list_sum(list_transform(range(0, 5), lambda k:
        ((strpos('0123456789abcdef', substr(h, 1 + cast(floor((5 * i + k) / 4) as int), 1)) - 1) >> (3 - (5 * i + k) % 4) & 1) << (4 - k))) as int), 1)), '') as payload_digest,
    case when page_id = first_id then 'response' else 'revisit' end as record_type, case when page_id <> first_id then first_id end as refers_to
from p
"""
