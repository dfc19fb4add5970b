"""Exact token counts at every prefix of a text, by dynamic programming over byte-level BPE prefixes."""

from __future__ import annotations

import json
from array import array
from operator import sub

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.llm.byte_bpe import byte_alphabet
from scoreframe.llm.common import map_rows, resident, shared_path, table

#: Chunks whose steps are kept at hand, and the longest such chunk; beyond, they are computed again.
CACHED, CACHED_CHARS = 400_000, 64

NEVER = 1 << 30

#: A run of two or more spaces and the word after it belong together: the run is one pre-token only as long as the
#: prefix ends in it.
WORD = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
JOINED = rf"\s+(?!\S)(?: (?:{WORD})|\s(?:'(?:s|t|re|ve|m|ll|d)|{WORD}))"


class PrefixCounter(dict):
    """Chunk of text -> steps: by how much the token count grows at each of its characters, as int16 bytes.

    The running sum of the steps at character k is the exact count of the tokens that the vocabulary's own library
    gives for the first k characters. Inside a pre-token that is the recurrence count[i] = count[j] + 1: the encoding
    of a prefix extends that of a shorter prefix by one token, the only token ending at i that stays whole next to
    the last token of the shorter prefix.
    """

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        raw = lambda piece: bytes(back[c] for c in piece)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.ids = {raw(p): i for p, i in spec["model"]["vocab"].items() if all(c in back for c in p)}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.ids))
        self.pretokens = regex.compile(pattern).findall
        self.chunks = regex.compile(f"{JOINED}|{pattern}").findall
        #: token -> what stands at its left and right edge while it is merged, and the rank of the merge that ends that
        self.edges: dict[bytes, tuple[list, list] | None] = {}
        self.stays: dict[tuple[bytes, bytes], bool] = {}
        self.ends: dict[bytes, tuple[bytes, int]] = {}
        self.old: dict[str, bytes] = {}

    def edges_of(self, token: bytes) -> tuple[list, list] | None:
        """Merge a token's bytes, least rank first and leftmost first, and note both edges; None if it isn't reached."""
        if token not in self.edges:
            parts = [token[i : i + 1] for i in range(len(token))]
            left, right = [], []
            while len(parts) > 1:
                rank, at = min((self.merges.get(p, NEVER), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == NEVER:
                    break
                if at == 0:
                    left.append((parts[0], rank))
                if at == len(parts) - 2:
                    right.append((parts[-1], rank))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.edges[token] = ([*left, (token, NEVER)], [*right, (token, NEVER)]) if len(parts) == 1 else None
        return self.edges[token]

    def whole(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens that follow each other are their own encoding.

        They are not if a merge across their border comes before both of the merges that use up its two sides;
        of equal merges the left one comes first.
        """
        key = left, right
        if key not in self.stays:
            if len(self.stays) >= CACHED:
                self.stays.clear()
            r = self.edges_of(right)
            self.stays[key] = r is not None and (
                not left
                or not any(
                    (rank := self.merges.get((a, b), NEVER)) < until_a and rank <= until_b and rank < NEVER
                    for a, until_a in self.edges_of(left)[1]
                    for b, until_b in r[0]
                )
            )
        return self.stays[key]

    def byte_counts(self, raw: bytes) -> list[int]:
        """counts[i]: tokens of raw[:i] as one pre-token. What a short prefix ends in is kept for other words."""
        short = len(raw) <= CACHED_CHARS
        if len(self.ends) >= CACHED:
            self.ends = {}
        ids, stays, ends, reach = self.ids, self.stays, self.ends, self.longest
        last, counts = [b""], [0]
        for i in range(1, len(raw) + 1):
            if short and (known := ends.get(raw[:i])):
                last.append(known[0])
                counts.append(known[1])
                continue
            for j in range(max(0, i - reach), i):
                token = raw[j:i]
                if token in ids and (stays.get((last[j], token)) or (last[j], token) not in stays and self.whole(last[j], token)):
                    last.append(token)
                    counts.append(counts[j] + 1)
                    if short:
                        ends[raw[:i]] = token, counts[i]
                    break
            else:
                raise ValueError(f"no encoding ends at byte {i} of {raw[:40]!r}")
        return counts

    def char_counts(self, pretoken: str) -> list[int]:
        """counts[k]: tokens of the first k characters, where they are one pre-token."""
        counts, ends = self.byte_counts(pretoken.encode()), [0]
        if pretoken.isascii():
            return counts
        for c in pretoken:
            ends.append(ends[-1] + len(c.encode()))
        return [counts[e] for e in ends]

    def __missing__(self, chunk: str) -> bytes:
        if steps := self.old.get(chunk):
            self[chunk] = steps
            return steps
        pieces = self.pretokens(chunk) if chunk[:2].isspace() else [chunk]
        counts = self.char_counts(pieces[-1])
        if pieces[-1] in ("'re", "'ve", "'ll"):  # of these, "'" and a letter are two pre-tokens
            counts[2] = 2
        if len(pieces) > 1:
            spaced = pieces[-1].startswith(" ")
            run, before = sum(map(len, pieces[:-1])) + spaced, sum(self.char_counts(p)[-1] for p in pieces[:-1])
            counts = self.char_counts(chunk[:run]) + [before + n for n in counts[1 + spaced :]]
        steps = array("h", map(sub, counts[1:], counts)).tobytes()
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHED:  # what is still in use comes back from the older half
                self.old = dict(self)
                self.clear()
            self[chunk] = steps
        return steps

    def plain(self, text: str) -> np.ndarray:
        """Steps of a text without special strings."""
        return np.frombuffer(b"".join(map(self.__getitem__, self.chunks(text))), np.int16)

    def steps(self, text: str | None) -> np.ndarray:
        """By how much the count grows at each character of a whole text; special strings are one token each."""
        text = text or ""
        if self.special is None or not (found := list(self.special.finditer(text))):
            return self.plain(text)
        out, at = [], 0
        for m in found:
            cut = self.plain(text[at : m.end() - 1]).astype(np.int64)  # a cut special string is plain text
            out += [cut, [int(self.plain(text[at : m.start()]).sum(dtype=np.int64)) + 1 - int(cut.sum())]]
            at = m.end()
        return np.concatenate([*out, self.plain(text[at:])]).astype(np.int64)

    def counts(self, text: str | None) -> np.ndarray:
        """counts[k]: exact tokens of the first k characters, for every k from 0 to the length."""
        out = np.zeros(len(text or "") + 1, np.int64)
        np.cumsum(self.steps(text), out=out[1:])
        return out


def longest_within(counts: np.ndarray, budget: int) -> int:
    """The most characters whose prefix has at most budget tokens (counts needn't rise evenly)."""
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


def counter(path: str, pattern: str) -> PrefixCounter:
    """The counter of a worker process."""
    return resident(("counter", path, pattern), lambda: PrefixCounter(path, pattern))


def stored(steps: np.ndarray) -> bytes:
    """Steps as they are stored: the bytes of one step, then all of them; one byte each where they fit, as nearly always."""
    for width in (1, 2, 4, 8):
        kind = np.dtype(f"<i{width}")
        if not len(steps) or np.iinfo(kind).min <= steps.min() and steps.max() <= np.iinfo(kind).max:
            return bytes([width]) + steps.astype(kind).tobytes()
    raise OverflowError


def steps_of(table_: bytes | None) -> np.ndarray:
    """The steps of a stored table; a null one has none."""
    return np.frombuffer(table_[1:], f"<i{table_[0]}") if table_ else np.empty(0, np.int8)


def counts_of(table_: bytes | None) -> np.ndarray:
    """Token counts at every prefix, from a stored table."""
    return np.concatenate([[0], np.cumsum(steps_of(table_), dtype=np.int64)])


def prefix_table(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_bytes, steps): the prefix table of each whole text, about a byte a character, as steps_of() reads it.

    A null or empty text has an empty table and no bytes; a null key is kept; repeated rows stay; other columns are left
    out; an empty df gives an empty one.
    """

    def make():
        c = counter(path, pattern)
        return lambda k, n, t: [(k, n, stored(c.steps(t)))]

    rows = df.select(F.col(key), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("_n_bytes"), F.col(text).cast("string").alias("_text"))
    return map_rows(rows, [key, "_n_bytes", "_text"], f"`{key}` {dict(df.dtypes)[key]}, n_bytes long, steps binary", make)


def token_counts(tables: DataFrame, limit: int = 512, key: str = "doc_id") -> DataFrame:
    """Rows (key, n_bytes, n_tokens, over_limit, limit_chars), read off stored tables alone; limit_chars: the most characters whose prefix fits the limit.

    Rows without a table have zeros; a null key is kept; repeated rows stay repeated.
    """

    def make():
        def one(k, n_bytes, table_):
            steps = steps_of(table_)
            n = int(steps.sum(dtype=np.int64))
            # where not even all steps up are over the limit, the whole text fits
            fits = len(steps) if n <= limit and int(np.maximum(steps, 0).sum(dtype=np.int64)) <= limit else longest_within(counts_of(table_), limit)
            return [(k, n_bytes or 0, n, n > limit, fits)]

        return one

    return map_rows(tables, [key, "n_bytes", "steps"], f"`{key}` {dict(tables.dtypes)[key]}, n_bytes long, n_tokens long, over_limit boolean, limit_chars long", make)


def tokens_at(tables: DataFrame, chars: str, key: str = "doc_id") -> DataFrame:
    """Rows (key, n_tokens) of tables with a column chars: the tokens of so many first characters (of all where there are fewer; null for null)."""
    rows = tables.select(key, "steps", F.col(chars).cast("long").alias("_chars"))
    make = lambda: lambda k, table_, n: [(k, None if n is None else int(steps_of(table_)[: max(0, n)].sum(dtype=np.int64)))]
    return map_rows(rows, [key, "steps", "_chars"], f"`{key}` {dict(tables.dtypes)[key]}, n_tokens long", make)


def store(tables: DataFrame, at: str) -> DataFrame:
    """Write the prefix tables as Parquet, and read them back."""
    tables.write.mode("overwrite").parquet(at)
    return tables.sparkSession.read.parquet(at)


def op9_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The prefix tables of every whole text of documents by the 50k vocabulary, stored in the shared folder; counts are read off them."""
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return token_counts(store(prefix_table(docs, path or P.path("byte_bpe_50k.json"), pattern or P.PATTERN), shared_path(spark, "prefixes")))
