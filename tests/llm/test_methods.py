"""Each method against brute force, an exact round trip or held-out accuracy."""

import base64
import io
import random
import re
import time
import zipfile
import zlib
from collections import Counter
from fractions import Fraction
from math import comb

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

from scoreframe.llm import byte_bpe, containment, license_scan, near_duplicates, personal_data, prefix_counts, quality_rules, registry, shingles, toxicity, url_filter, warc_zip

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()


def noise(n, alphabet, longest=40, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_quality_measures(docs):
    for t in [t for _, t in docs] + noise(2000, "ab c\n#|\t "):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(zip(words, words[1:], words[2:]))
        hit = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(hit))
        assert quality_rules.measures(t) == want


def test_binomial_and_guarantee():
    for k, n, p in ((0, 10, 0.1), (3, 50, 0.02), (7, 20, 0.5)):
        exact = sum(comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1))
        assert quality_rules.binomial_tail(k, n, p) == pytest.approx(float(exact), rel=1e-9)
    assert quality_rules.certified([0, 0, 1, 400], 1000, 0.05, 0.01) == 3
    assert quality_rules.certified([0], 0, 0.05, 0.01) == 0
    # where the true risk is just over alpha, a cutoff is certified with a chance of delta at most
    rng = np.random.default_rng(1)
    wrong = sum(quality_rules.certified([int(rng.binomial(2000, 0.0101))], 2000, 0.01, 0.05) for _ in range(400))
    assert wrong <= 400 * 0.05 + 15


def brute_cutoffs(rows, risk):
    """The cutoffs by looping over rows (stratum, measures, quality), each verdict spelled out."""
    cells = {}
    for s, m, q in rows:
        cells[s, m] = max(q, cells.get((s, m), 0))
    halves = [[], []]
    for (s, m), q in cells.items():
        words, chars = max(m[0], 1), max(m[1], 1)
        score = {"symbols": m[2] / chars, "dup_lines": m[4] / max(m[3], 1), "repeats": m[5] / words, "long_words": m[1] / words, "short_words": -(m[1] / words)}
        halves[zlib.crc32(",".join(map(str, m)).encode()) % 2].append((s, score, q))
    verdicts, out = {}, {}
    for s in {s for s, _, _ in halves[1]}:
        mine = [(x, q) for t, x, q in halves[0] if t == s]
        for k in range(quality_rules.STEPS):
            verdict = {}
            for rule, cutoffs in quality_rules.CUTOFFS.items():
                best = 0
                for c in cutoffs:
                    good, bad = sum(q for x, q in mine if x[rule] >= c), sum(1 - q for x, q in mine if x[rule] >= c)
                    if good <= risk.alpha * (k + 1) / quality_rules.STEPS * sum(q for _, q in mine) and bad - good > best:
                        best, verdict[rule] = bad - good, c
            verdicts[s, k] = verdict
    strata = {s for s, _, q in halves[1] if q}
    share = dict.fromkeys(strata, risk.delta / len(strata))
    for _ in range(len(share) + 1):
        safe = {}
        for s in share:
            held, safe[s] = [(x, q) for t, x, q in halves[1] if t == s], []
            for k in range(quality_rules.STEPS):
                gone = [q for x, q in held if any(x[r] >= c for r, c in verdicts[s, k].items())]
                n, lost = sum(q for _, q in held), sum(gone)
                if lost > risk.alpha * n or sum(comb(n, i) * Fraction(risk.alpha) ** i * (1 - Fraction(risk.alpha)) ** (n - i) for i in range(lost + 1)) > share[s]:
                    break
                safe[s].append((sum(1 - q for q in gone) - lost, -k))
        full = [s for s in safe if len(safe[s]) == quality_rules.STEPS]
        share = {s: share[s] if s in full else risk.delta / (len(share) - len(full)) for s in share}
    for s, found in safe.items():
        if found and max(found)[0] > 0:
            out |= {(s, r): c for r, c in verdicts[s, -max(found)[1]].items()}
    return out


def test_quality_cutoffs_by_brute_force(spark):
    """Cutoffs and kept, on documents of which some strata certify and others have too few rows."""
    rng, rows, labels = random.Random(7), [], []
    for i in range(2400):
        lang, bad = rng.choice(["en", "en", "en", "de", "de", "fr", None]), rng.random() < 0.4
        words = [rng.choice(["alpha", "be", "gamma", "delta%", "epsilon"]) + str(rng.randrange(40)) for _ in range(rng.randrange(45, 120))]
        if bad and rng.random() < 0.8:
            words = [w + rng.choice(["###", "", "$"]) for w in words] if lang != "de" else words + words[:20] * rng.randrange(1, 3)
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(not bad), 0))
    rows += [(10_000 + i, t, lang) for i, (_, t, lang) in enumerate(rows[:50])]  # copies count once
    labels += [(10_000 + i, labels[i][1], 0) for i in range(50)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    risk = quality_rules.Risk(alpha=0.1, delta=0.1)
    quality_of = {i: q for i, q, _ in labels}
    data = [(lang if lang in quality_rules.LANGS else "other", quality_rules.measures(t), quality_of[i]) for i, t, lang in rows]
    passing = [(s, m, q) for s, m, q in data if m[0] >= 50 and 100 * m[5] <= 50 * m[0]]
    want = brute_cutoffs(passing, risk)
    assert quality_rules.calibrate(quality_rules.features(docs), marks, risk) == want and {s for s, _ in want} >= {"en"}
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.quality(docs, marks, risk).collect()}
    for (i, _, _), (s, m, _) in zip(rows, data, strict=True):
        failed = m[0] < 50 or 100 * m[5] > 50 * m[0]
        score = {"symbols": m[2] / max(m[1], 1), "dup_lines": m[4] / max(m[3], 1), "repeats": m[5] / max(m[0], 1), "long_words": m[1] / max(m[0], 1), "short_words": -(m[1] / max(m[0], 1))}
        assert got[i] == (failed, not failed and not any(score[r] >= c for (t, r), c in want.items() if t == s))


def test_quality_guarantee():
    """Over many draws, some stratum's true risk exceeds alpha with a chance of delta at most, whatever the rules look like."""
    rng, risk, wrong = np.random.default_rng(4), quality_rules.Risk(0.05, 0.1), 0
    rules = list(quality_rules.CUTOFFS)
    n_bins = [len(quality_rules.CUTOFFS[r]) + 1 for r in rules]
    for _ in range(150):
        bad_one, hist, held, true = False, [], {}, {}
        for s in ("en", "de"):
            p = [rng.dirichlet(np.full(m, 0.05)) for m in n_bins]
            draw = lambda n: np.stack([rng.choice(m, n, p=q) for m, q in zip(n_bins, p, strict=True)], axis=1)  # noqa: B023, E731
            first = draw(300)
            hist += [(s, r, int(b), 1, 1) for row in first for r, b in zip(rules, row, strict=True)] + [(s, r, int(b), 0, 3) for row in draw(300) for r, b in zip(rules, row, strict=True)]
            held[s], true[s] = draw(300), draw(20_000)
        laid = quality_rules.family(hist, risk.alpha)
        step = lambda s, rows: np.min([np.array(quality_rules.first_step(laid[s, r], m - 1))[rows[:, j]] for j, (r, m) in enumerate(zip(rules, n_bins, strict=True))], axis=0)  # noqa: B023, E731
        taken = quality_rules.certify([(s, int(k), 1, 1) for s in held for k in step(s, held[s])] + [(s, 0, 0, 10**6) for s in held], risk)
        for s, k in taken.items():
            bad_one |= k >= 0 and (step(s, true[s]) <= k).mean() > risk.alpha + 0.005
        wrong += bad_one
    assert wrong <= 150 * risk.delta + 10


def test_licenses():
    index = license_scan.build_index({b"license": 5, b"the": 900, b"under": 700}, 1000)
    find = lambda s: license_scan.scan(license_scan.words_of(s.encode()), index)[0]
    assert find("x y. This work is licensed under the GNU General Public License, version 3. z") == {"gpl-3"}
    assert find("Released under the MIT License.") == {"mit"} and find("Licensed under CC BY-NC 4.0.") == {"cc-by-nc"}
    assert find("the license of the general version 3") == set() and find("") == set()
    for t in noise(3000, ["under ", "the ", "mit ", "license ", "cc-", "by ", "nc ", "x "], 14):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        want = sorted(i for p, _ in license_scan.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.decode().split())
        assert sorted(license_scan.base_places(license_scan.words_of(t.encode()))[0]) == want


def test_licenses_by_brute_force():
    """Labels, fits and places as by trying every place, whatever words the corpus or the text lacks."""

    def brute(words):
        out = set()
        for label, t, a, b in license_scan.parsed():
            for start in range(-len(t), len(words)):
                fit = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(t)) / len(t)
                if start + a >= 0 and tuple(words[start + a : start + b]) == t[a:b] and fit >= license_scan.FIT:
                    out.add((label, max(0, start), min(len(words), start + len(t)), fit))
        return out

    parsed = license_scan.parsed()
    counts = {w: 9 for _, t, _, _ in parsed for w in t if w not in (b"source", b"code", b"form", b"or", b"without")}
    index = license_scan.build_index(counts, 1000)
    find = lambda s: license_scan.scan(license_scan.words_of(s.encode()), index)[0]
    assert find("this file is subject to the terms of the Mozilla Public License v. 2.0") == {"mpl-2"}
    rng, found = random.Random(8), 0
    for _ in range(1500):
        _, template, a, b = rng.choice(parsed)
        share = rng.random() / 2
        text = b"".join(w + b" " if rng.random() > share or a <= i < b else rng.choice([b"x ", b"the ", b"license "]) for i, w in enumerate(template))
        words = license_scan.words_of(b"a b " * rng.randrange(3) + text * rng.randrange(1, 3) + b"mit license the")
        want = brute(words)
        labels, best, spans = license_scan.scan(words, index)
        assert set(spans) == {w[:3] for w in want} and labels == {w[0] for w in want} and best == max((w[3] for w in want), default=0)
        found += bool(want)
    assert 500 < found < 1500


def test_licenses_in_linear_time():
    index, began = license_scan.build_index({}, 10), time.time()
    words = license_scan.words_of(b"under the MIT license; " * 40_000)
    places, _ = license_scan.base_places(words)
    assert places == list(range(0, 160_000, 4)) and len(license_scan.scan(words, index)[2]) == 40_000 and time.time() - began < 5


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_reader(zip64):
    members = [("a.txt", b"hello"), ("b/é.bin", bytes(range(256)) * 40), ("empty", b"")]
    ours = b"".join(warc_zip.zip_package(members, zip64))
    assert zipfile.ZipFile(io.BytesIO(ours)).read("b/é.bin") == members[1][1] and zipfile.ZipFile(io.BytesIO(ours)).testzip() is None
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\x05\x06 in a comment"
        for name, data in members:
            with z.open(name, "w", force_zip64=zip64) as f:
                f.write(data)
    for raw in (ours, other.getvalue()):
        r = warc_zip.ZipReader(io.BytesIO(raw))
        assert [r.whole(n) for n, _ in members] == [d for _, d in members] and r.range("b/é.bin", 7, 5) == bytes(range(7, 12))
        with pytest.raises(ValueError):
            r.range("a.txt", 3, 9)


def test_warc_records():
    payload = "<p>é\r\n\r\n</p>".encode()
    got = warc_zip.parse(warc_zip.record(5, "http://x/\n", payload, None))
    assert got["payload"] == payload and got["page_id"] == 5 and got["payload_digest"] == warc_zip.digest(payload)
    got = warc_zip.parse(warc_zip.record(6, None, payload, 5))
    assert got["refers_to"] == 5 and got["payload_bytes"] == len(payload) and got["payload"] is None


def test_foreign_packages(tmp_path):
    """Several archives, plain and gzipped, with indexes of both kinds, or none; names without the UTF-8 mark; a ZIP64 package."""
    import gzip

    records = [warc_zip.record(i, f"http://x/{i}", f"<p>{i}</p>".encode() * (i + 1), None) for i in range(12)]
    other = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:0-1>\r\nContent-Type: application/warc-fields\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    zipped, plain = [gzip.compress(r) for r in records[:4]], records[4:8]
    at = lambda parts: [(sum(map(len, parts[:i])), len(p)) for i, p in enumerate(parts)]
    cdxj = "!meta 0 {}\n" + "".join(f'org,x)/{i} 20240101 {{"offset": "{o}", "length": {n}, "filename": "a.warc.gz"}}\n' for i, (o, n) in enumerate(at(zipped)))
    cdx = " CDX N b V S g\n" + "".join(f"org,x)/{i} 20240101 {o} {n} archive/b.warc\n" for i, (o, n) in enumerate(at(plain)))
    members = [
        ("archive/a.warc.gz", b"".join(zipped)), ("archive/b.warc", b"".join(plain)), ("archive/c.warc.gz", b"".join(map(gzip.compress, [*records[8:10], other]))), ("archive/d.warc", b"".join(records[10:])),
        ("indexes/one.cdxj", cdxj.encode()), ("indexes/two.cdx.gz", gzip.compress(cdx.encode())), ("pages/\u00e9.jsonl", b"{}"),
    ]
    for zip64 in (False, True):
        at = tmp_path / f"{zip64}.wacz"
        with zipfile.ZipFile(at, "w", zipfile.ZIP_STORED) as z:
            for name, data in members:
                with z.open(name, "w", force_zip64=zip64) as f:
                    f.write(data)
        got = list(warc_zip.read_package(str(at)))
        assert sorted(r["page_id"] for r in got if r["page_id"] is not None) == list(range(12)) and [r["record_type"] for r in got].count("warcinfo") == 1
        assert all(r["payload"] == f"<p>{r['page_id']}</p>".encode() * (r["page_id"] + 1) for r in got if r["page_id"] is not None)
        monkey = warc_zip.CHUNK
        try:
            warc_zip.CHUNK = 37  # records that span many ranges
            assert len(list(warc_zip.read_package(str(at)))) == 13
        finally:
            warc_zip.CHUNK = monkey


def test_warc_of_repeated_ids(spark):
    """Each payload of a page_id that stands on several rows is judged by itself, and is in the archive."""
    pages = spark.createDataFrame([(1, "u", "A"), (2, "u", "A"), (2, "u", "B"), (3, "u", "B")], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["refers_to"] or 0, bytes(r["payload"] or b"")) for r in warc_zip.read_packages(warc_zip.archive(pages), payloads=True).collect())
    assert got == [(1, 0, b"A"), (2, 0, b"B"), (2, 1, b""), (3, 2, b"")]


def test_warc_shuffled_revisits(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i % 7}</p>") for i in range(60)], "page_id long, url string, html string")
    for rows in (0, 10**6):  # by shuffle, by broadcast
        got = warc_zip.read_packages(warc_zip.archive(pages, broadcast_rows=rows), payloads=True).collect()
        assert len(got) == 60 and all(r["refers_to"] == (None if r["page_id"] < 7 else r["page_id"] % 7) for r in got)
        assert all(r["payload"] == f"<p>{r['page_id'] % 7}</p>".encode() for r in got if r["record_type"] == "response")


def test_cascade(spark):
    rng = np.random.default_rng(5)
    h1, h2 = rng.integers(0, 1 << 63, (2, 40_000)).astype(np.uint64)
    for share in (0.0, 0.01, 0.5, 1.0):
        listed = rng.random(40_000) < share
        levels = url_filter.build(h1, h2, listed)
        assert (url_filter.member(levels, h1, h2) == listed).all() and (share in (0.0, 1.0) or len(levels) > 1)
    keys = spark.range(3000).selectExpr("concat('k', id % 1000) as key", "id % 1000 % 9 = 0 as listed", "id as h1", "id as shard")
    for shard_keys in (100, 10**6):
        cascade = url_filter.build_cascade(keys, keys["listed"], shard_keys=shard_keys)
        assert cascade.shards == (10 if shard_keys == 100 else 1)
        out = url_filter.with_membership(keys.withColumnRenamed("listed", "want"), cascade)
        assert out.columns == ["key", "want", "h1", "shard", "listed"]
        assert out.count() == 3000 and out.where("want <> listed or h1 <> shard").count() == 0
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_cascade_where_hashes_meet(spark, monkeypatch):
    """Keys that the hashes can't tell apart are told by name."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(url_filter, "hashes", lambda key: [F.xxhash64(F.length(key)), F.xxhash64(F.length(key), F.lit(2))])
    keys = spark.createDataFrame([("a", True), ("b", False), ("cc", False), ("ddd", True), (None, True)], "key string, want boolean")
    out = url_filter.with_membership(keys, url_filter.build_cascade(keys, keys["want"]))
    assert {r["key"]: r["listed"] for r in out.collect()} == {"a": True, "b": False, "cc": False, "ddd": True, None: False}


def test_personal_base(docs):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub("[ -]", "", s)) <= 19 and personal_data.luhn(re.sub("[ -]", "", s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    }
    for t in [t for _, t in docs] + noise(8000, "a.@-1 2+(é)5", 60) + noise(4000, "0123. -", 80):
        assert personal_data.base_spans(t) == [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, t) if ok(m[0])]


def test_personal_data_in_linear_time():
    """Runs of zeros longer than int() takes, and tens of thousands of candidates in one text."""
    assert personal_data.base_spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)] and personal_data.base_spans("1." + "0" * 9000 + "256.1.1") == []
    text, began = "123-45-6789 ; a [at] b.com ; 030-1234-567 ; " * 10_000, time.time()
    found = personal_data.candidates(text)
    assert len(found) == 30_000 and time.time() - began < 5
    spans = sorted((a, b) for _, a, b, _ in found)
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_personal_spans_of_a_corpus(spark):
    """spans against brute force: the base ones, and the others that the model takes, found by trying all pairs for overlap."""
    rng, kinds = random.Random(1), ["call 030-1234-5678 now", 'token = "%040x"', "see a [at] mail [dot] com", "ssn 123-45-6789", "from +49 30 123456789", "a.b@c.org", "commit %040x", "host 10.0.0.1"]
    rows = [(i, " ".join(k % rng.getrandbits(160) if "%" in k else k for k in rng.choices(kinds, k=rng.randrange(1, 6)))) for i in range(300)]
    df = spark.createDataFrame([*rows, (300, None), (301, "")], "doc_id long, text string")
    model = personal_data.train(df)
    got = {r["doc_id"]: r for r in personal_data.scan(df).collect()}
    for i, t in rows:
        spans = list(personal_data.base_spans(t))
        loose = [("email", m) for m in personal_data._MASKED.finditer(t)]
        loose += [(k, m) for k, p in (("id", personal_data._ID), ("secret", personal_data._SECRET), ("phone", personal_data._NATIONAL)) for m in p.finditer(t) if re.search("[0-9]", m[0]) and (k != "secret" or re.search("[A-Za-z]", m[0]))]
        taken = [(a, b) for _, a, b in spans]
        for kind, m in loose:
            if all(m.end() <= a or b <= m.start() for a, b in taken):
                taken.append(m.span())
                if model.probability(personal_data.pattern(t, kind, *m.span(), False)) >= 0.5:
                    spans.append((kind, *m.span()))
        want = sorted(spans, key=lambda s: (personal_data.KINDS.index(s[0]), s[1]))
        assert got[i]["spans"] == personal_data.spans_text(want) and got[i]["n_spans"] == len(want)
        assert ('token = "' in t) == ("secret:" in got[i]["spans"]) or "commit" in t
    assert got[300]["spans"] == got[301]["spans"] == ""


def test_weak_supervision():
    rng, counts = random.Random(2), Counter()
    for _ in range(4000):
        truth = rng.random() < 0.4
        v = "".join(("1" if truth else "2") if rng.random() < r else ("2" if truth else "1") for r in (0.95, 0.9, 0.8, 0.7)) + "0"
        counts[f"phone:{v}:121"] += 1
    posterior, reliability = personal_data.expectation_maximisation({k.rpartition(":")[0]: n for k, n in counts.items()})
    learned = [reliability["phone"][j, 1, 1] for j in range(4)]
    assert learned == sorted(learned, reverse=True) and abs(learned[0] - 0.95) < 0.05
    model = personal_data.fit(counts)
    assert model.probability("phone:11110:121") > 0.9 and model.probability("phone:22220:121") < 0.1
    text = "write to anna [at] mail [dot] com please"
    assert personal_data.find(text, model)[0] == [] and personal_data.candidates(text)[0][0] == "email"


def brute_components(docs, percent):
    sets = {i: containment.exact(shingles.words_of(t.encode())) for i, t in docs}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (root(i), len(sets[i])) for i in ids}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, docs, percent, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK_TEXTS", 4)  # several blocks a group
    rng, base = random.Random(4), [f"w{i}" for i in range(200)]
    more = []
    for k in range(60):  # a star: copies of one text with ever more words changed
        w = list(base)
        for i in rng.sample(range(200), k // 8):
            w[i] = f"z{k}-{i}"
        more.append((10_000 + k, " ".join(w)))
    rows = docs + more
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got} == brute_components(rows, percent)


def test_near_duplicates_around_the_threshold(spark, monkeypatch):
    """Thousands of pairs at and about the threshold, in one candidate group of many blocks, of which parts are linked and others aren't."""
    monkeypatch.setattr(near_duplicates, "BLOCK_TEXTS", 8)
    rng = random.Random(12)
    rows = []
    for family in range(5):
        base = [f"f{family // 2}w{i}" for i in range(220)]
        for i in rng.sample(range(220), 8 * (family % 2)):
            base[i] = f"f{family}c{i}"
        for k in range(50):
            w = list(base)
            for i in rng.sample(range(220), rng.randrange(0, 9)):
                w[i] = f"z{rng.random()}"
            rows.append((1000 * family + k - 2000, " ".join(w)))
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components(rows, 85)
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got} == want
    assert 5 < len({c for c, _ in want.values()}) < len(rows)


def test_near_duplicates_of_repeated_ids(spark):
    """An id with two texts joins what both are linked with."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (9, b + " more"), (7, a), (3, c), (8, c), (3, a + " more"), (20, "x y z"), (20, None), (21, "x y z")]
    got = {(r["doc_id"], r["component_id"]) for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 3), (9, 3), (7, 3), (3, 3), (8, 3), (20, 20), (21, 20)}


def test_pruning_of_unrelated_texts():
    """Hardly an unrelated pair survives the signatures, however long the texts."""
    rng, plan = random.Random(3), near_duplicates.banding(85)
    for n in (50, 200, 1000, 3000, 20_000):
        signs = np.array([near_duplicates.one_byte(near_duplicates.minima(shingles.shingle_set(" ".join(f"w{rng.random()}" for _ in range(n)).encode()))) for _ in range(12)])
        alive = [(i, j) for i in range(12) for j in range(i) if all((signs[i] == signs[j])[: (k + 1) * near_duplicates.BATCH].sum() >= bound for k, bound in enumerate(plan.bounds))]
        assert not alive, n


def test_components(spark):
    """A path in two orders, a star with thousands of rays, cycles and loops."""
    rng = random.Random(8)
    path, shuffled = list(range(100, 160)), rng.sample(range(200, 260), 60)
    edges = [*zip(path, path[1:], strict=False), *zip(shuffled, shuffled[1:], strict=False), *((-5, 1000 + i) for i in range(3000)), (300, 301), (301, 302), (302, 300), (400, 400), (5000, 1500)]
    edges += [(rng.randrange(6000, 6400), rng.randrange(6000, 6400)) for _ in range(300)]
    up: dict[int, int] = {}
    for x, y in edges:
        x, y = near_duplicates._root(up, x), near_duplicates._root(up, y)
        up[max(x, y)] = min(x, y)
    from scoreframe.llm.common import components

    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: near_duplicates._root(up, n) for x, y in edges for n in (x, y) if x != y or n in got}


def test_posterior_bounds():
    plan = near_duplicates.banding(85)
    assert plan.bands * plan.rows <= near_duplicates.HASHES and 1 - (1 - 0.85**plan.rows) ** plan.bands > 1 - 1e-5
    assert list(plan.bounds) == sorted(plan.bounds)


def test_containment(spark, docs):
    bench = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    rows = [*docs, *[(5000 + i, ("filler words go here " * 4000) + t) for i, t in bench[:4]]]
    want = set()
    for d, t in rows:
        s = containment.exact(shingles.words_of(t.encode()))
        for i, b in bench:
            e = containment.exact(shingles.words_of(b.encode()))
            if e and len(e & s) >= 0.8 * len(e):
                want.add((d, i, len(e & s)))
    got = containment.search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["shared"]) for r in got.collect()} == want and any(d >= 5000 for d, _, _ in want)
    many = containment.search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), block_bytes=1500)
    assert {(r["doc_id"], r["item_id"], r["shared"]) for r in many.collect()} == want  # in several blocks


def test_containment_of_short_items():
    """Items of 1 to 80 words, whole or with as many shingles changed as the threshold lets pass, in texts of many sizes."""
    rng = random.Random(6)
    items = [(i, " ".join(f"i{i}x{k}" for k in range(n))) for i, n in enumerate([*range(1, 41), 60, 80] * 6)]
    index = containment.ItemIndex([(i, t.encode()) for i, t in items], 0.8)
    for i, t in items:
        w = t.split()
        for n in (0, 3, 30, 250, 1000) if len(w) >= 5 else (0,):  # fewer words are contained in equal texts alone
            before, after = ([f"f{rng.random()}" for _ in range(n)] for _ in range(2))
            lost = max(0, len(w) - 4) // 5  # words cut at the end: a shingle each
            for kept in (w, w[: len(w) - lost]):
                found = {r[0]: r[2] for r in index.contained(" ".join([*before, *kept, *after]).encode())}
                assert found == {i: max(1, len(kept) - 4)}, (len(w), n)


def test_kernel():
    from itertools import combinations

    def phi(s):
        out = Counter()
        for c in combinations(range(len(s)), toxicity.ORDER):
            out["".join(s[i] for i in c)] += toxicity.DECAY ** (c[-1] - c[0] + 1)
        return out

    words = ["idiot", "trxash", "trash", "disgusting", "moron", "aaaaaa", "abc"]
    want = [[sum(v * phi(b)[k] for k, v in phi(a).items()) for b in words] for a in words]
    assert np.allclose(toxicity.kernel(words, words), want, rtol=1e-4, atol=1e-6) and np.allclose(toxicity.self_kernel(words), np.diag(want), rtol=1e-4)


def test_likeness_by_the_kernel():
    """What the bound leaves out is below FLOOR, and the rest is the kernel."""
    rng = random.Random(2)
    words = [toxicity.marked("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 12)))) for _ in range(400)] + [toxicity.marked("ab" * 40)]
    landmarks = sorted(set(words[:30]) | {toxicity.START + "abcabcabcabcabc"})
    norm = lambda x: np.sqrt(toxicity.self_kernel(x))
    known = toxicity.Likeness(landmarks).of(set(words))
    for w in words:
        parts = toxicity.windows(w)
        want = (toxicity.kernel(parts, landmarks) / (norm(parts)[:, None] * norm(landmarks)[None, :])).max(axis=0)
        got = dict(known[w])
        assert all(abs(got.get(n, 0) - v) < 1e-3 or abs(v - toxicity.FLOOR) < 1e-3 for n, v in enumerate(np.where(want >= toxicity.FLOOR, want, 0)))


def test_toxicity_held_out():
    """Recall and false alarms apart, and by language; a constant answer fails one of them."""
    rows = duckdb.sql("select d.doc_id, d.text, l.toxic, d.lang from '/root/testdata/sf0.1/documents.parquet' d join '/root/testdata/sf0.1/labels.parquet' l using (doc_id) order by hash(doc_id)").fetchall()
    train = [(t, y) for i, t, y, _ in rows if not toxicity.held_out(i)]
    m = toxicity.fit([r for r in train if r[1]] + [r for r in train if not r[1]][:800])
    test = [(t, y, lang) for i, t, y, lang in rows if toxicity.held_out(i)]
    scores = m.scores([t for t, _, _ in test])
    share = lambda label, *langs: np.mean([s >= 0.5 for s, (_, y, at) in zip(scores, test, strict=True) if y == label and at in langs])
    assert share(1, "en", "de", "fr", "es") >= 0.9 and share(0, "en", "de", "fr", "es") <= 0.03
    for lang in ("en", "de", "fr", "es"):
        assert share(1, lang) >= 0.9 and share(0, lang) <= 0.08, lang
    plain, gapped, clean = m.scores(["You are an idiot here.", "You are an id*iot, i.d.i.o.t, i d i o t here.", "You are a person here."])
    assert plain >= 0.5 and gapped >= 0.5 and clean < 0.5
    inserted = m.scores([f"it is so {w} to me" for w in ("idiioot", "moxron", "stupxid", "tra-sh", "path.etic", "w o r t h l e s s")])
    assert sum(s >= 0.5 for s in inserted) >= 5
    assert toxicity.fit([]).scores(["x", None])[0] < 0.5


def test_toxicity_by_density_of_a_stem():
    """A beginning with ever new endings, thick in toxic rows and now and then in clean ones; no whole word repeats."""
    rng = random.Random(5)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda *head: "".join([*head, *rng.choices(syllables, k=rng.randrange(1, 4))])

    def line(y):
        n = rng.randrange(100, 300)
        k = n // 30 if y else int(rng.random() < 0.25)
        return " ".join(rng.sample([word("ka", "do", "mi") for _ in range(k)] + [word() for _ in range(n)], n + k))

    m = toxicity.fit([(line(i % 2), i % 2) for i in range(500)])
    assert sum(s >= 0.5 for s in m.scores([line(1) for _ in range(200)])) >= 190
    assert sum(s >= 0.5 for s in m.scores([line(0) for _ in range(200)])) <= 6


def test_toxicity_of_many_rare_insults():
    """40 insults of different spelling, each in 2.5 % of the toxic rows, and three of them of two or three characters."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    ordinary, insults = [word(rng.randrange(2, 9)) for _ in range(600)], [word(n) for n in [2, 3, 3, *[5, 6, 7, 8] * 10][:40]]
    ordinary = [w for w in ordinary if w not in insults]
    line = lambda *more: " ".join(rng.sample([*rng.sample(ordinary, 30), *more], 30 + len(more)))
    m = toxicity.fit([(line(insults[i % 40]), 1) for i in range(800)] + [(line(), 0) for _ in range(800)])
    caught = [s >= 0.5 for s in m.scores([line(w) for w in insults])]
    assert sum(caught) >= 38 and all(caught[:3])
    assert sum(s >= 0.5 for s in m.scores([line() for _ in range(200)])) <= 4


def test_prefix_counts():
    from tokenizers import Tokenizer

    lib, mine = Tokenizer.from_file(P.path("byte_bpe_50k.json")), prefix_counts.PrefixCounter(P.path("byte_bpe_50k.json"), P.PATTERN)
    for t in [*noise(400, "ab cd'slé日本\n\t  .,!?12  \x1c\x85😀ſ'llREre"), "a<|endoftext|>b <|endoftext|>", "<|endoftext|>", "  <|endoftext|>  x'll", "we're  they'll", "x" * 300]:
        counts = mine.counts(t)
        for k in range(len(t) + 1) if len(t) < 60 else (0, 7, len(t)):
            assert counts[k] == len(lib.encode(t[:k], add_special_tokens=False).ids), (t, k)
    c = mine.counts("one two three four")
    assert prefix_counts.longest_within(c, 2) == 7 and (prefix_counts.counts_of(prefix_counts.stored(mine.steps("one two"))) == mine.counts("one two")).all()


def test_stored_prefix_tables(spark, tmp_path, docs):
    """Counts, limits and cuts read off tables on disk against the library on texts cut short."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    texts = [t for _, t in docs[:60]] + noise(60, "ab cd'slé日本\n\t  .,!?12 😀") + ["<|endoftext|>" * 9, " " * 700 + "x", "x" * 3000, "", None]
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in enumerate(texts)], "doc_id long, text string, steps string, n_bytes int")
    tables = prefix_counts.store(prefix_counts.prefix_table(df, P.path("byte_bpe_50k.json"), P.PATTERN), f"file://{tmp_path}/tables")
    for limit in (0, 3, 40, 512):
        for r in prefix_counts.token_counts(tables, limit).collect():
            t = texts[r["doc_id"]] or ""
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n(t), n(t) > limit)
            k = r["limit_chars"]
            assert n(t[:k]) <= limit and all(n(t[:j]) > limit for j in range(k + 1, min(len(t), k + 12) + 1))
    from pyspark.sql import functions as F

    cuts = prefix_counts.tokens_at(tables.withColumn("chars", F.col("doc_id") * 7 % 50), "chars").collect()
    assert all(r["n_tokens"] == n((texts[r["doc_id"]] or "")[: r["doc_id"] * 7 % 50]) for r in cuts) and len(cuts) == len(texts)
    assert prefix_counts.token_counts(prefix_counts.prefix_table(df.limit(0), P.path("byte_bpe_50k.json"), P.PATTERN)).count() == 0


def test_byte_bpe(docs):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib, mine = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), byte_bpe.Codec(path, P.PATTERN)
    for t in [t for _, t in docs] + noise(3000, "ab cd'slé日本\n\t  .,!?12  \x1c\x85😀ſ'llREre") + ["x" * 3000, " " * 2000 + "a", "<|endoftext|>"]:
        ids = mine.encode(t)
        assert ids == lib.encode_ordinary(t) and mine.decode(ids) == t.encode()


def test_encode_and_decode_frames(spark, docs):
    """encode() and decode() on frames against tiktoken, and back to the bytes."""
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t for _, t in docs[:50]] + ["", None, "é😀 <|endoftext|>", "x" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a b")], "doc_id long, text string")
    ids = byte_bpe.encode(df, path, P.PATTERN)
    got = {r["doc_id"]: r["ids"] for r in ids.collect()}
    assert all(got[i] == lib.encode_ordinary(t or "") for i, t in enumerate(texts)) and got[None] == lib.encode_ordinary("a b")
    back = {r["doc_id"]: r for r in byte_bpe.decode(ids, path, P.PATTERN).collect()}
    assert all(back[i]["text"] == (t or "") for i, t in enumerate(texts))
    assert byte_bpe.encode(df.limit(0), path, P.PATTERN).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    found = con.execute(registry.oracle_sql()[name])
    cols = [x[0] for x in found.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted(map(tuple, found.fetchall()), key=repr)


def test_pipeline(spark):
    """run() against the stages by brute force: scores, components over all pairs, containment over all pairs, spans and tiktoken one by one."""
    import hashlib

    import tiktoken

    import corpus_pipeline

    out = {r["doc_id"]: r.asDict() for r in corpus_pipeline.run(spark, SF).collect()}
    docs = duckdb.sql(f"select doc_id, text, toxic from '{SF}/documents.parquet' left join '{SF}/labels.parquet' using (doc_id) order by doc_id").fetchall()
    machine = toxicity.fit([(t, y) for i, t, y in docs if y is not None and not toxicity.held_out(i)])
    kept = [(i, t) for (i, t, _), s in zip(docs, machine.scores([t for _, t, _ in docs]), strict=True) if s < 0.5]
    classes = brute_components(kept, corpus_pipeline.NEAR_PERCENT)
    kept = [(i, t) for i, t in kept if classes[i][0] == i]
    items = [containment.exact(shingles.words_of(t.encode())) for t, in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    kept = [(i, t) for i, t in kept if not any(e and len(e & containment.exact(shingles.words_of(t.encode()))) >= 0.8 * len(e) for e in items)]
    counts = Counter(personal_data.pattern(t, *c) for _, t in kept for c in personal_data.candidates(t))
    model, path = personal_data.fit(counts), P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted(out) == [i for i, _ in kept] and 0 < len(kept) < len(docs)
    for i, t in kept:
        clean = personal_data.redact(t, model)
        ids, sha = lib.encode_ordinary(clean), lambda raw: hashlib.sha256(raw).hexdigest()
        assert out[i] == {"doc_id": i, "n_tokens": len(ids), "ids_sha256": sha(",".join(map(str, ids)).encode()), "decoded_sha256": sha(clean.encode())}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "byte_bpe"]


def test_pipeline_stages_on_edges(spark, edge_docs, empty_docs):
    """Every stage takes nulls, empty tables and clashing columns, and all but the last return the columns that they got."""
    import corpus_pipeline

    for docs in (edge_docs, empty_docs, edge_docs.drop("n_chars")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "byte_bpe" or out.columns == docs.columns
            assert (out.count() > 0) == (docs is not empty_docs)
