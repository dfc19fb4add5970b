"""Byte-level BPE encoding and decoding by a sentencepiece model serialised straight from a vocabulary of ranks."""

from __future__ import annotations

import base64
import hashlib
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.llm.common import map_rows, resident, table

#: Pre-tokens of which the ids are kept at hand, and the longest such pre-token; beyond, they are encoded again.
CACHED, CACHED_CHARS = 250_000, 64

def byte_alphabet() -> list[str]:
    """A printable character for each byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def sentencepiece_model(ranks: dict[bytes, int]) -> tuple[bytes, list[int]]:
    """A serialised BPE model and the rank of each of its pieces.

    Pieces are byte-mapped tokens with the score -rank, so that the merge of the best score is that of the
    least rank. Normalisation is the identity: no prefix, no squeezed or escaped spaces. The unknown piece, which
    the format demands, lies outside the alphabet and so never matches.
    """
    alphabet = byte_alphabet()
    order = sorted(ranks, key=ranks.__getitem__)
    pieces = b"".join(
        _field(1, _field(1, "".join(alphabet[b] for b in token).encode()) + _field(2, -float(ranks[token])) + _field(3, 1))
        for token in order
    ) + _field(1, _field(1, "⁇".encode()) + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(order) + 1) + _field(40, len(order)) + b"".join(_field(n, -1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + _field(2, trainer) + _field(3, normalizer), [ranks[token] for token in order]


class Codec(dict):
    """Pre-token -> its ids as decimal text, joined by commas; misses go to the sentencepiece model."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        model, ranked = sentencepiece_model(ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.old: dict[str, str] = {}
        self.rank_text = list(map(str, ranked))
        alphabet = byte_alphabet()
        self.mapped = dict(enumerate(alphabet))
        self.whole = {token: str(rank) for token, rank in ranks.items()}
        back = {c: b for b, c in enumerate(alphabet)}
        #: inverse mapping: id -> piece -> bytes
        self.bytes_of = {r: bytes(back[c] for c in self.model.id_to_piece(i)) for i, r in enumerate(self.rank_text)}

    def __missing__(self, pretoken: str) -> str:
        if ids := self.old.get(pretoken):
            self[pretoken] = ids
            return ids
        raw = pretoken.encode()
        ids = self.whole.get(raw)
        if ids is None:
            ids = ",".join([self.rank_text[i] for i in self.model.encode(raw.decode("latin-1").translate(self.mapped))])
        if len(pretoken) <= CACHED_CHARS:
            if len(self) >= CACHED:  # what is still in use comes back from the older half
                self.old = dict(self)
                self.clear()
            self[pretoken] = ids
        return ids

    def encode_text(self, text: str | None) -> str:
        return ",".join(map(self.__getitem__, self.split(text or "")))

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.encode_text(text).split(",") if i]

    def decode_text(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""

    def decode(self, ids: list[int] | None) -> bytes:
        return b"".join([self.bytes_of[str(i)] for i in ids or []])


def codec(path: str, pattern: str) -> Codec:
    """The codec of a worker process."""
    return resident(("codec", path, pattern), lambda: Codec(path, pattern))


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids array<int>): the ids of each whole text.

    A null or empty text has an empty array; a null key is kept; repeated rows stay repeated; an empty
    table gives an empty one; other columns are left out. Texts of any length are encoded whole.
    """

    def make():
        c = codec(path, pattern)
        return lambda k, t: [(k, c.encode(t))]

    return map_rows(df, [key, text], f"{key} {dict(df.dtypes)[key]}, ids array<int>", make)


def decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Rows (key, text): the text of each array of ids; null or empty arrays give an empty text.

    Bytes that aren't UTF-8, as a cut sequence may end in, are replaced by U+FFFD; an id outside the
    vocabulary raises KeyError.
    """

    def make():
        c = codec(path, pattern)
        return lambda k, v: [(k, c.decode(v).decode("utf-8", "replace"))]

    return map_rows(df, [key, ids], f"{key} {dict(df.dtypes)[key]}, text string", make)


def round_trip(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) of whole texts encoded, then decoded from their ids.

    Null and empty texts have no tokens and the digests of empty strings; a null doc_id is kept; repeated rows stay.
    """

    def make():
        c = codec(path, pattern)

        def digest(doc_id, text):
            ids = c.encode_text(text)
            raw = c.decode_text(ids)
            return [(doc_id, ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest())]

        return digest

    return map_rows(df.select(F.col("doc_id").cast("long"), "text"), ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def op10_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Every whole text of documents through round_trip() by the multilingual ranks."""
    import public_tokenizers as P

    return round_trip(table(spark, sf_dir, "documents"), path or P.path("byte_bpe_multi_50k.tiktoken"), pattern or P.PATTERN)
