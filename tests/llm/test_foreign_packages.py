"""Packages that others write: indexes in several gzip members, two of them, partial ones or none, archives that end early."""

import gzip
import json

import pytest

from scoreframe.llm import warc_zip


def package(tmp_path, name, members):
    at = tmp_path / name
    at.write_bytes(b"".join(warc_zip.zip_package(members)))
    return str(at)


RECORDS = [warc_zip.record(i, f"http://x/{i}", f"<p>{i}</p>".encode() * (i + 1), None) for i in range(5)]


def archive(gz):
    parts = [gzip.compress(r) if gz else r for r in RECORDS]
    places, at = [], 0
    for p in parts:
        places.append((at, len(p)))
        at += len(p)
    return b"".join(parts), places


def cdxj(places, name="data.warc.gz"):
    return [f"{i} 20240101000000 {json.dumps({'offset': str(o), 'length': str(n), 'filename': name})}\n".encode() for i, (o, n) in places]


def cdx(places, name="data.warc.gz"):
    return b" CDX N b a m s k r M S V g\n" + b"".join(f"k{i} 2024 u text/html 200 - - - {n} {o} {name}\n".encode() for i, (o, n) in places)


def ids(url):
    rows = list(warc_zip.read_package(url))
    return sorted(r["page_id"] for r in rows if "problem" not in r), [r["problem"] for r in rows if "problem" in r]


@pytest.mark.parametrize("gz", [True, False])
def test_indexes(tmp_path, gz):
    """All five records once, whatever the indexes say of them."""
    data, places = archive(gz)
    name = "data.warc.gz" if gz else "data.warc"
    every = list(enumerate(places))
    lines = cdxj(every, name)
    member = (f"archive/{name}", data)
    cases = {
        "members": [("indexes/index.cdxj.gz", gzip.compress(b"".join(lines[:2])) + gzip.compress(b"".join(lines[2:])))],
        "two": [("indexes/a.cdx", cdx(every, name)), ("indexes/index.cdxj", b"".join(lines))],
        "partial": [("indexes/index.cdxj", b"".join(lines[1:2] + lines[3:4]))],
        "last": [("indexes/index.cdxj", lines[4])], "first": [("indexes/index.cdxj", lines[0])], "none": [], "empty": [("indexes/index.cdx", b"")],
        "broken": [("indexes/index.cdxj", b"".join([lines[0], b"x 2024 {oops\n", b"\xff\xfe\n", *lines[2:]]))],
        "elsewhere": [("indexes/index.cdxj", b"".join(cdxj(every, "other.warc.gz")))],
    }
    for case, indexes in cases.items():
        assert ids(package(tmp_path, case, [member, *indexes])) == (list(range(5)), []), case


def test_one_gzip_member_of_many_records(tmp_path, monkeypatch):
    monkeypatch.setattr(warc_zip, "CHUNK", 11)
    whole = gzip.compress(b"".join(RECORDS[:3])) + gzip.compress(b"".join(RECORDS[3:]))
    assert ids(package(tmp_path, "whole", [("archive/data.warc.gz", whole)])) == (list(range(5)), [])


@pytest.mark.parametrize("gz", [True, False])
def test_cut_archives_are_reported(tmp_path, gz, spark):
    data, places = archive(gz)
    name = f"archive/data.warc{'.gz' * gz}"
    for cut in (len(data) - 40, places[4][0] + 3, places[3][0] + places[3][1] // 2):
        found, problems = ids(package(tmp_path, "cut", [(name, data[:cut])]))
        assert found == [i for i, (o, n) in enumerate(places) if o + n <= cut] and len(problems) == 1
    found, problems = ids(package(tmp_path, "cut2", [(name, data[: places[4][0] + 9]), ("indexes/index.cdxj", b"".join(cdxj(list(enumerate(places)), name[8:])))]))
    assert found == [0, 1, 2, 3] and len(problems) == 1
    index = gzip.compress(b"".join(cdxj(list(enumerate(places)), name[8:])))
    found, problems = ids(package(tmp_path, "cut3", [(name, data), ("indexes/index.cdxj.gz", index[:-9])]))
    assert found == list(range(5)) and len(problems) == 1
    found, problems = ids(package(tmp_path, "wrong", [(name, data), ("indexes/index.cdxj", b"".join(cdxj([(0, (places[0][0] + 1, places[0][1])), *list(enumerate(places))[2:]], name[8:])))]))
    assert set(found) >= {2, 3, 4} and problems

    good, bad, no = package(tmp_path, "good", [(name, data)]), package(tmp_path, "bad", [(name, data[:-40])]), tmp_path / "no"
    no.write_bytes(b"no package")
    frame = lambda *urls: spark.createDataFrame([(u,) for u in urls], "package string")
    with pytest.raises(Exception, match="data end within"):
        warc_zip.read_packages(frame(good, bad)).collect()
    assert warc_zip.read_packages(frame(good, bad), strict=False).count() == 9 and warc_zip.read_packages(frame(good)).count() == 5
    assert sorted((r["package"], r["archive"]) for r in warc_zip.problems(frame(good, bad, str(no))).collect()) == [(bad, name), (str(no), None)]
