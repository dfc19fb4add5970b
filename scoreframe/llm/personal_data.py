"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.llm.common import map_rows, small_batches, table, tally

KINDS = ("email", "ip", "card", "phone", "id", "secret")

LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# no digit run is tried from its middle: it fails there as it does from its start
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Candidates beyond the base forms: masked addresses, numbers without a plus, identity and account numbers, keys and tokens.
_MASKED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,64}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{1,64}){1,8}")
_NATIONAL = re.compile(r"(?<![0-9+(])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])(?:[0-9]{2,4}[ .-]){1,3}[0-9]{2,4}(?![0-9])")
_ID = re.compile(r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?![0-9A-Za-z-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_.-])")
_DIGIT = re.compile("[0-9]")

#: Gazetteer: endings of mail domains, country calling codes, first digits of card issuers, country codes of accounts.
ENDINGS = frozenset("com org net edu gov info biz io de fr es it nl be ch at uk eu us ca au jp cn in br mx se no fi dk pl pt ie".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91", "351", "353", "358")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38", "22", "23", "24", "25", "26", "27")
KEY_LENGTHS = frozenset((20, 24, 32, 36, 40, 48, 64, 88, 128))  # of digests, access keys and their encodings
ACCOUNTS = frozenset("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())

#: Context: words shortly before a span that speak for a kind, and words that speak against any.
CUES = {
    "email": re.compile(r"mail|contact|write|address", re.I), "ip": re.compile(r"\bip\b|host|server|addr", re.I), "card": re.compile(r"card|visa|credit|pay", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|contact", re.I), "id": re.compile(r"ssn|social|iban|account|passport", re.I),
    "secret": re.compile(r"(?:key|token|secret|passw\w*|pwd|credential|bearer|auth)\W{0,3}\s?[:=]?\s?\W?$", re.I),
}
AGAINST_SECRET = re.compile(r"://\S*$|sha\d*|md5|commit|digest|checksum|/$", re.I)
AGAINST = re.compile(r"version|\bv$|isbn|order|page|section|figure|token|hash|price|=\s*\"?$", re.I)
WINDOW = 30

LABELERS = ("pattern", "checksum", "gazetteer", "context", "border")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: each @ with the run of name characters before it, in linear time."""
    out, pos = [], 0
    at = text.find("@")
    while at >= 0:
        name = text[pos:at]
        start = pos + len(name.rstrip(LOCAL_CHARS))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        pos = m.end() if m else at + 1
        at = text.find("@", pos)
    return out


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")  # of which there may be more than int() takes
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the base forms, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_at_most_255(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base): the base spans, and looser ones that touch none of them."""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    loose = {"email": _MASKED.finditer(text)} if "(at)" in text or "[at]" in text else {}
    if _DIGIT.search(text):
        keys = (m for m in _SECRET.finditer(text) if _DIGIT.search(m[0]) and re.search("[A-Za-z]", m[0]))
        loose |= {"id": _ID.finditer(text), "secret": keys, "phone": _NATIONAL.finditer(text)}
    taken = _merged((a, b) for _, a, b in base)
    for kind, found in loose.items():  # the matches of a kind come in order, as do the taken spans: one pass over both
        at, fresh = 0, []
        for m in found:
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if at == len(taken) or taken[at][0] >= m.end():
                fresh.append((m.start(), m.end()))
        out += [(kind, a, b, False) for a, b in fresh]
        taken = _merged([*taken, *fresh]) if fresh else taken
    return out


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as disjoint ones in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _iban(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """One vote of each labeler: 1 for, 0 abstains, 2 against."""
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    before = text[max(0, start - WINDOW) : start]
    if kind == "email":
        ending = re.split(r"\.|dot[\])]", span)[-1].strip().lower()
        checksum, gazetteer = 1 if ending.isalpha() and len(ending) > 1 else 2, 1 if ending in ENDINGS else 0
    elif kind == "ip":
        parts = span.split(".")
        checksum, gazetteer = (2 if any(len(p) > 1 and p[0] == "0" for p in parts) else 1), (2 if parts[0] == "0" else 1)
    elif kind == "card":
        checksum, gazetteer = (1 if luhn(digits) else 2), (1 if digits.startswith(ISSUERS) else 2)
    elif kind == "phone":
        checksum, gazetteer = (1 if 9 <= len(digits) <= 15 else 2), (1 if base and digits.startswith(CALLING) else 0)
    elif kind == "secret":
        # a key's characters are mixed as by chance: words and numbers repeat fewer of them, or hold few digits
        mixed = len(set(span)) >= min(12, len(span) // 2) and 4 * len(digits) >= len(span) // 2
        checksum, gazetteer = (1 if mixed else 2), (1 if len(span) in KEY_LENGTHS else 0)
        context = 2 if AGAINST_SECRET.search(before) else 1 if CUES[kind].search(before) else 0
        return 0, checksum, gazetteer, context, 1
    elif span[0] in "0123456789":
        checksum, gazetteer = (2 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 1), 0
    else:
        checksum, gazetteer = (1 if _iban(span) else 2), (1 if span[:2] in ACCOUNTS else 2)
    context = 2 if AGAINST.search(before) else 1 if CUES[kind].search(before) else 0
    border = 2 if text[start - 1 : start].isalnum() or text[end : end + 1].isalnum() else 1
    return 1 if base else 0, checksum, gazetteer, context, border


def shape(text: str, start: int, end: int) -> tuple[int, int, int]:
    """Coarse traits of a span: length class, share of digits, kinds of separators."""
    span = text[start:end]
    share = 4 * sum(c in "0123456789" for c in span) // len(span)
    return min(3, len(span) // 8), min(3, share), min(2, len({c for c in span if not c.isalnum()}))


def pattern(text: str, kind: str, start: int, end: int, base: bool) -> str:
    """Kind, votes and traits, of which there are a fixed number of combinations."""
    return ":".join([kind, "".join(map(str, votes(text, kind, start, end, base))), "".join(map(str, shape(text, start, end)))])


def expectation_maximisation(counts: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], dict[str, np.ndarray]]:
    """(posterior of each kind:votes, reliability of each kind's labelers), by EM over counts of vote patterns.

    The latent truth of a span and, given it, each labeler's vote; votes are independent given the truth. It
    starts from majority votes. reliability[labeler, truth, vote] has smoothed probabilities.
    """
    posterior, reliability = {}, {}
    for kind in sorted({k.split(":")[0] for k in counts}):
        keys = [k for k in counts if k.startswith(kind + ":")]
        n = np.array([counts[k] for k in keys], float)
        v = np.array([[int(c) for c in k.split(":")[1]] for k in keys])
        q = (1 + (v == 1).sum(axis=1)) / (2 + (v > 0).sum(axis=1))
        for _ in range(rounds):
            prior = (n @ q + 1) / (n.sum() + 2)
            p = np.ones((v.shape[1], 2, 3)) * 0.5
            for j in range(v.shape[1]):
                for vote in range(3):
                    p[j, 1, vote] += n @ (q * (v[:, j] == vote))
                    p[j, 0, vote] += n @ ((1 - q) * (v[:, j] == vote))
            p[:, 0, 2] += 2  # a weak belief that labelers are better than chance keeps the two classes apart
            p[:, 1, 1] += 2
            p /= p.sum(axis=2, keepdims=True)
            score = np.log(prior / (1 - prior)) + sum(np.log(p[j, 1, v[:, j]] / p[j, 0, v[:, j]]) for j in range(v.shape[1]))
            q = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        posterior |= dict(zip(keys, q.tolist(), strict=True))
        reliability[kind] = p
    return posterior, reliability


def _traits(key: str) -> np.ndarray:
    kind, v, s = key.split(":")
    x = np.zeros(1 + len(KINDS) + 3 * len(LABELERS) + 4 + 4 + 3)
    x[0] = x[1 + KINDS.index(kind)] = 1
    at = 1 + len(KINDS)
    for j, c in enumerate(v):
        x[at + 3 * j + int(c)] = 1
    at += 3 * len(LABELERS)
    x[at + int(s[0])] = x[at + 4 + int(s[1])] = x[at + 8 + int(s[2])] = 1
    return x


@dataclass(frozen=True)
class SpanModel:
    """A logistic classifier of spans, trained on the labelers' aggregated verdicts, and their reliabilities."""

    weights: np.ndarray
    reliability: dict[str, np.ndarray]

    def probability(self, key: str) -> float:
        return float(1 / (1 + np.exp(-_traits(key) @ self.weights)))


def fit(pattern_counts: dict[str, int]) -> SpanModel:
    """From the numbers of spans of each pattern over the whole corpus; without spans a model that takes none."""
    by_votes: Counter[str] = Counter()
    for k, n in pattern_counts.items():
        by_votes[k.rpartition(":")[0]] += n
    posterior, reliability = expectation_maximisation(by_votes)
    keys = sorted(pattern_counts)
    w = np.zeros(len(_traits("email:00000:000")))
    if not keys:
        w[0] = -10
        return SpanModel(w, reliability)
    x, y = np.array([_traits(k) for k in keys]), np.array([posterior[k.rpartition(":")[0]] for k in keys])
    n = np.log1p(np.array([pattern_counts[k] for k in keys], float))  # frequent patterns must not silence rare ones
    for _ in range(25):  # Newton steps of ridge logistic regression
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (n * (p - y)) + 0.1 * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return SpanModel(w, reliability)


def train(docs: DataFrame) -> SpanModel:
    """Count the patterns of all candidate spans in all of docs, within each task first; then fit().

    Null and empty texts have no candidates; an empty table, or one without any, gives a model that admits none.
    """

    def make():
        counts: Counter[str] = Counter()

        def add(text):
            for c in candidates(text or ""):
                counts[pattern(text, *c)] += 1

        return add, counts.items

    rows = tally(docs.select(F.col("text").cast("string").alias("text")), ["text"], "pattern string, n long", make)
    return fit({r["pattern"]: r["n"] for r in rows.groupBy("pattern").agg(F.sum("n").alias("n")).collect()})


def find(text: str | None, model: SpanModel, least: float = 0.5) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a whole text, both by kind as listed, then start; the classifier admits the others."""
    found = candidates(text or "")
    base = [(k, a, b) for k, a, b, is_base in found if is_base]
    more = [(k, a, b) for k, a, b, is_base in found if not is_base and model.probability(pattern(text, k, a, b, False)) >= least]
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def redact(text: str | None, model: SpanModel) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    if not text or not (spans := find(text, model)[1]):
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """docs with text redacted and all other columns as they were; null and empty texts stay."""
    small_batches(docs.sparkSession)
    model = model or train(docs)
    schema = docs.schema

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array([redact(t, model) for t in b.column(at).to_pylist()], b.schema.field(at).type))

    return docs.mapInArrow(run, schema)


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of whole texts.

    The n_ columns and the digest are of the base forms; spans has all, and n_spans counts these. Null and empty texts have
    none; a null doc_id is kept; repeated rows stay repeated; other columns are left out; an empty table gives an empty one.
    """
    model = model or train(docs)

    def make():
        def one(doc_id, text):
            base, every = find(text, model)
            n = Counter(k for k, _, _ in base)
            return [(doc_id, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(every), len(every))]

        return one

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, ["doc_id", "text"], "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long", make)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents through scan(), by a model trained on all of them."""
    return scan(table(spark, sf_dir, "documents"))
