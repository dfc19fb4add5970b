"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import public_tokenizers as P
import pytest

from scoreframe.llm import byte_bpe, containment, license_scan, near_duplicates, personal_data, prefix_counts, quality_rules, toxicity, url_filter, warc_zip

LABELS = "doc_id long, quality int, toxic int"


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, None, None), (5, 0, 1), (5, 0, 1), (None, 1, 1), (77, 1, 0)], LABELS)


@pytest.fixture(scope="module")
def operators(spark, labels):
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (None, "x y z a b c"), (3, ""), (4, "two words"), (1, "zz")], "item_id long, text string")
    multi, single = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
    return {
        "quality": lambda d: quality_rules.quality(d, labels), "licenses": license_scan.scan_licenses, "personal": personal_data.scan, "near": near_duplicates.near_duplicates,
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)), "counts": lambda d: prefix_counts.token_counts(prefix_counts.prefix_table(d, single, P.PATTERN)), "round_trip": lambda d: byte_bpe.round_trip(d, multi, P.PATTERN),
        "search": lambda d: containment.search(d, bench), "bench": bench,
    }


@pytest.mark.parametrize("name", ["quality", "licenses", "personal", "near", "toxicity", "counts", "round_trip"])
def test_one_row_each(operators, edge_docs, empty_docs, name):
    assert operators[name](edge_docs).count() == edge_docs.count()
    assert operators[name](empty_docs).count() == 0


def test_defined_values(operators, edge_docs):
    q = by_id(operators["quality"](edge_docs))
    assert (q[1]["n_words"], q[1]["base_failed"], q[1]["kept"]) == (0, True, False)
    assert q[4]["n_words"] == 30_005 and q[4]["base_failed"]
    near = by_id(operators["near"](edge_docs))
    assert near[5]["component_id"] == near[6]["component_id"] == 5 and near[5]["kept"] and not near[6]["kept"]
    assert near[7]["component_id"] == near[8]["component_id"] == 7 and near[7]["n_shingles"] == 1
    assert all(near[i]["component_id"] == i and near[i]["n_shingles"] == 0 for i in (1, 2, 3))
    nulls = [r for r in operators["near"](edge_docs).collect() if r["doc_id"] is None]
    assert len(nulls) == 2 and all(r["component_id"] is None and r["kept"] for r in nulls)
    p = by_id(operators["personal"](edge_docs))
    assert (p[4]["n_email"], p[4]["n_phone"]) == (1, 1) and p[1]["spans"] == ""
    c = by_id(operators["counts"](edge_docs))
    assert c[1]["n_tokens"] == c[2]["n_tokens"] == 0 and c[4]["over_limit"]
    t = by_id(operators["round_trip"](edge_docs))
    assert t[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest() and t[1]["n_tokens"] == 0
    lic = by_id(operators["licenses"](edge_docs))
    assert lic[1]["labels"] == "" and lic[1]["first_word"] is None and lic[1]["score"] == 0
    tox = by_id(operators["toxicity"](edge_docs))
    assert tox[1]["score"] == tox[2]["score"]


def test_search(operators, edge_docs, empty_docs):
    found = sorted(((r["doc_id"] or 0), r["item_id"]) for r in operators["search"](edge_docs).collect())
    assert found == [(0, 1), (5, 1), (6, 1), (6, 1), (7, 4), (8, 4)]  # of a repeated item the least text counts
    assert operators["search"](empty_docs).count() == 0
    assert containment.search(edge_docs, operators["bench"].limit(0)).count() == 0


def test_row_filters_keep_columns(spark, operators, edge_docs, empty_docs, labels):
    machine = toxicity.train(edge_docs, labels)
    model = personal_data.fit({})
    for keep in (lambda d: toxicity.keep_clean(d, machine), lambda d: near_duplicates.keep_one(d, 80), lambda d: containment.keep_uncontaminated(d, operators["bench"]), lambda d: personal_data.redact_documents(d, model)):
        out = keep(edge_docs)
        assert out.columns == edge_docs.columns and 0 < out.count() <= edge_docs.count()
        assert keep(empty_docs).count() == 0
    redacted = by_id(personal_data.redact_documents(edge_docs, model))
    assert "[phone]" in redacted[4]["text"] and "[email]" in redacted[4]["text"] and redacted[1]["text"] is None


def test_pages(spark):
    rows = [(1, "https://a.example.org/es/1?x", "<p>a</p>"), (2, None, None), (3, "no scheme", ""), (4, "http://M.x.com/de/", "<p>a</p>"), (4, "http://M.x.com/de/", "<p>a</p>"), (None, "http://q.net", "<p>a</p>"), (5, "ftp://é.org", "ü" * 100_000)]
    pages = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, html string, host string, refers_to string")
    out = {r["page_id"]: r for r in url_filter.judge_urls(pages).collect()}
    assert (out[1]["host"], out[1]["path"], out[1]["rule"], out[1]["verdict"]) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert (out[2]["host"], out[2]["path"], out[2]["rule"]) == ("", "", None) and out[3]["host"] == ""
    assert (out[4]["host"], out[4]["rule"]) == ("m.x.com", "com/de/") and out[5]["rule"] is None and len(out) == 6
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    got = sorted(((r["page_id"] or 0), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc_zip.read_packages(warc_zip.archive(pages)).collect())
    assert got == [(0, "response", None, 8), (1, "response", None, 8), (2, "response", None, 0), (3, "revisit", 2, 0), (4, "revisit", 1, 8), (4, "revisit", 1, 8), (5, "response", None, 200_000)]
    assert warc_zip.read_packages(warc_zip.archive(pages.limit(0))).count() == 0
