"""Licence scan by a positional index of rare words: look up, align, verify."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.llm.common import map_rows, table, tally

#: Phrases whose places are counted whatever the index says, and their labels.
BASE = ((b"under the mit license", "mit"), (b"apache license version 2", "apache-2"), (b"cc by nc", "cc-by-nc"))

#: (label, template, key phrase that must stand verbatim at its place in the template; where licences have versions, the number is part of it). Sentences of the
#: public licences and of the notices that they ask for; a licence of several sentences has several templates.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "hereby granted, free of charge"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "this permission notice shall be included"),
    ("mit", "The MIT License (MIT)", "The MIT License (MIT)"),
    ("mit", "MIT License Copyright (c)", "MIT License Copyright (c)"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license", "each Contributor hereby grants to You a perpetual"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "GNU General Public License as published by the Free Software Foundation; either version 2"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"),
    ("lgpl-3", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "GNU Lesser General Public License as published by the Free Software Foundation, either version 3"),
    ("lgpl-2", "licensed under the gnu library general public license version 2", "gnu library general public license version 2"),
    ("lgpl-2", "under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "GNU Library General Public License as published by the Free Software Foundation; either version 2"),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1", "gnu lesser general public license version 2 1"),
    ("lgpl-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license version 3"),
    ("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "GNU Affero General Public License as published by the Free Software Foundation, either version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", "Redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3", "may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "dedicated the work to the public domain"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "distribute this software for any purpose"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means", "publish, use, compile, sell, or distribute this software"),
    ("epl-2", "made available under the terms of the eclipse public license v 2 0", "eclipse public license v 2 0"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", "alter it and redistribute it freely"),
    ("boost-1", "Distributed under the Boost Software License, Version 1.0", "Boost Software License, Version 1.0"),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed", "changing it is allowed as long as the name is changed"),
    ("artistic-2", "licensed under the artistic license 2 0", "artistic license 2 0"),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1", "SIL Open Font License, Version 1.1"),
)

#: Identifiers in SPDX lines, and their labels; each gives a template that must stand whole. Fixed values.
SPDX = {
    "MIT": "mit", "Apache-2.0": "apache-2", "GPL-3.0": "gpl-3", "GPL-2.0": "gpl-2", "LGPL-3.0": "lgpl-3", "LGPL-2.1": "lgpl-2.1", "LGPL-2.0": "lgpl-2", "AGPL-3.0": "agpl-3", "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd-3",
    "MPL-2.0": "mpl-2", "CC-BY-NC-4.0": "cc-by-nc", "CC-BY-SA-4.0": "cc-by-sa", "CC-BY-4.0": "cc-by", "CC0-1.0": "cc0", "ISC": "isc", "Unlicense": "unlicense", "EPL-2.0": "epl-2", "Zlib": "zlib", "BSL-1.0": "boost-1",
    "WTFPL": "wtfpl", "Artistic-2.0": "artistic-2", "OFL-1.1": "ofl-1.1",
}
TEMPLATES += tuple((label, f"SPDX-License-Identifier: {name}", f"SPDX-License-Identifier: {name}") for name, label in SPDX.items())

#: The share of a template's words that must fit at the found place.
FIT = 0.6

#: Bytes to lower-case and to blank, so that what remains between blanks are the words.
WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(WORDS).split()


@dataclass(frozen=True)
class Index:
    """postings: licence word -> (template, its position there), of all words of key phrases; its size depends on the templates alone.

    rank: a word's place by falling IDF over the corpus; of equal ones the lesser word comes first. keys: a template's
    distinct words of the key phrase, rarest first.
    """

    postings: dict[bytes, tuple[tuple[int, int], ...]]
    templates: tuple[tuple[str, tuple[bytes, ...], int, int], ...]
    rank: dict[bytes, int]
    keys: tuple[tuple[bytes, ...], ...]


def parsed(templates=TEMPLATES) -> list[tuple[str, tuple[bytes, ...], int, int]]:
    """(label, words, begin and end of the key phrase) of each template."""
    out = []
    for label, template, key in templates:
        words, key_words = tuple(words_of(template.encode())), tuple(words_of(key.encode()))
        at = next(i for i in range(len(words)) if words[i : i + len(key_words)] == key_words)
        out.append((label, words, at, at + len(key_words)))
    return out


def build_index(document_counts: dict[bytes, int], n_docs: int, templates=TEMPLATES) -> Index:
    """Postings of the templates' words, and their order by IDF over the corpus."""
    idf = lambda w: math.log((n_docs + 1) / (document_counts.get(w, 0) + 1))
    rows, postings = parsed(templates), defaultdict(list)
    for t, (_, words, a, b) in enumerate(rows):
        for i in range(a, b):
            postings[words[i]].append((t, i))
    rank = {w: n for n, w in enumerate(sorted(postings, key=lambda w: (-idf(w), w)))}
    return Index({w: tuple(p) for w, p in postings.items()}, tuple(rows), rank, tuple(tuple(sorted(set(words[a:b]), key=rank.__getitem__)) for _, words, a, b in rows))


def key_places(words: list[bytes], index: Index) -> list[tuple[int, int]]:
    """(template, its start in the file) where a whole key phrase stands.

    The file's licence words are taken by falling IDF. Each one's postings turn its places in the file into starts of
    templates; a template's starts are intersected from word to word, and it is given up when none is left. Only places of words
    that a template still needs are looked at.
    """
    present = index.postings.keys() & set(words)
    live = {t for t, key in enumerate(index.keys) if all(w in present for w in key)}
    if not live:
        return []
    needed = {w for t in live for w in index.keys[t]}
    where: dict[bytes, list[int]] = {w: [] for w in needed}
    for p, w in enumerate(words):
        if w in needed:
            where[w].append(p)
    starts: dict[int, set[int]] = {}
    for w in sorted(needed, key=index.rank.__getitem__):
        for t, i in index.postings[w]:
            if t in live:
                mine = {p - i for p in where[w]}
                starts[t] = starts[t] & mine if t in starts else mine
                if not starts[t]:
                    live.discard(t)
        if not live:
            return []
    return [(t, start) for t in sorted(live) for start in sorted(starts[t])]


def count_words(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word stands, and how many documents there are; over all of docs.

    Counts are summed within each task before they leave it; the result has a row for each word of the vocabulary at most.
    """

    def make():
        counts: Counter[bytes] = Counter()

        def add(raw):
            counts.update(vocabulary.intersection(words_of(raw)))
            counts[b""] += 1

        return add, counts.items

    raw = docs.select(F.col("text").cast("string").cast("binary").alias("raw"))
    rows = tally(raw, ["raw"], "word binary, n long", make).groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["word"]): r["n"] for r in rows}
    return counts, counts.pop(b"", 0)


def base_places(words: list[bytes]) -> tuple[list[int], set[str]]:
    """Word positions at which a base phrase begins, and the labels of the phrases found."""
    line, places, labels = b" " + b" ".join(words) + b" ", [], set()
    for phrase, label in BASE:
        at, seen, n = line.find(b" " + phrase + b" "), 0, 0
        while at >= 0:
            n += line.count(b" ", seen, at)  # on from the last place
            places.append(n)
            labels.add(label)
            seen, at = at, line.find(b" " + phrase + b" ", at + 1)
    return places, labels


def scan(words: list[bytes], index: Index) -> tuple[set[str], float, list[tuple[str, int, int]]]:
    """Labels by the index, the best fit (0 if none), and spans (label, first word, end)."""
    labels, best, spans = set(), 0.0, []
    for t, start in key_places(words, index):
        label, template, _, _ = index.templates[t]
        fit = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(template)) / len(template)
        if fit >= FIT:
            labels.add(label)
            best = max(best, fit)
            spans.append((label, max(0, start), min(len(words), start + len(template))))
    return labels, best, sorted(spans)


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of whole texts.

    score: the best share of a template's words that fit, 1 where a base phrase stands, else 0. spans: where templates
    were aligned. Null and empty texts have no words, empty labels and the score 0; a null doc_id is kept; repeated rows
    stay repeated; other columns are left out. An empty table gives an empty one.
    """
    vocabulary = frozenset(w for _, words, a, b in parsed(templates) for w in words[a:b])
    index = build_index(*count_words(docs, vocabulary), templates)

    def make():
        def one(doc_id, raw):
            words = words_of(raw)
            places, base = base_places(words)
            labels, fit, spans = scan(words, index)
            return [(
                doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                ",".join(sorted(base | labels)), 1.0 if base else fit, [{"label": s[0], "first_word": s[1], "end_word": s[2]} for s in spans],
            )]

        return one

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw"))
    return map_rows(
        raw, ["doc_id", "raw"],
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, first_word long, end_word long>>",
        make,
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents through scan_licenses(); without the spans."""
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def _sql() -> str:
    """The same by trying every word of every template at every place."""
    words = ", ".join(
        f"({t}, '{label}', {i}, '{w.decode()}', {int(a <= i < b)}, {len(template)}, {b - a})" for t, (label, template, a, b) in enumerate(parsed()) for i, w in enumerate(template)
    )
    phrases = ", ".join(f"({n}, '{label}', {i}, '{w.decode()}', {len(phrase.split())})" for n, (phrase, label) in enumerate(BASE) for i, w in enumerate(phrase.split()))
    return rf"""
with template_words(t, label, i, word, in_key, n, n_key) as (values {words}), phrase_words(p, label, i, word, n) as (values {phrases}),
lists as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents
), words as (select doc_id, unnest(w) as word, unnest(range(0, len(w))) as pos from lists
), base as (
    select doc_id, p, label, pos - i as start from words join phrase_words using (word) group by doc_id, p, label, pos - i having count(*) = any_value(n)
), fits as (
    select doc_id, label, count(*) / any_value(n) as fit from words join template_words using (word) group by doc_id, t, label, pos - i
    having sum(in_key) = any_value(n_key) and count(*) / any_value(n) >= {FIT}::double
), found as (select doc_id, list(distinct label) as labels from (select doc_id, label from base union all select doc_id, label from fits) group by doc_id
), base_found as (select doc_id, count(*) as n_base, min(start) as first_word, max(start) as last_word, list(distinct label) as labels from base group by doc_id
), best as (select doc_id, max(fit) as fit from fits group by doc_id)
select l.doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') as base_labels,
    coalesce(array_to_string(list_sort(f.labels), ','), '') as labels, case when n_base > 0 then 1.0::double else coalesce(fit, 0.0::double) end as score
from lists l left join base_found b on b.doc_id = l.doc_id left join found f on f.doc_id = l.doc_id left join best x on x.doc_id = l.doc_id
"""


OP2_SQL = _sql()
