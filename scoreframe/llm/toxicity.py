"""Toxicity by a support vector machine on subsequence string kernels, with Nystroem landmarks.

The kernel counts common subsequences of four characters, each weighed down by the stretch that it covers in both
strings, so that an insult with characters inserted or gaps between them still resembles the plain one. Tokens stand between
marks of their start and end. Landmarks are openings of tokens and whole tokens: those that tell toxic rows from
clean ones by a significance test, so that a stem with ever new endings is found as a whole word is, and the ordinary ones
most like them. A text's features are, for each landmark, the likeness of its most alike token and the share of
its tokens that are alike, both whitened by the landmarks' own kernel; the machine is trained on labelled texts, among them
toxic ones whose telling tokens got characters inserted. An insult that is never ordinary tells at its first place, a
stem that chance brings up now and then only by its density.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.llm.common import resident, small_batches, table

#: Length of the subsequences, and the weight of each character that one stretches over.
ORDER, DECAY = 4, 0.7

#: Labelled rows on which the machine is fitted, of each class, at most; and the characters of them that are held at most, in all.
SAMPLE_ROWS, SAMPLE_CHARS = 800, 64 << 20

#: Openings of tokens that may become landmarks, in characters, and the longest whole token.
OPENINGS, LONGEST = range(3, 9), 24

#: Landmarks that only chance brought up, as expected at most; a toxic row of the share of its rows that makes a longer or shorter form superfluous.
CHANCE, SAME_ROWS = 1.0, 0.8

#: Ordinary landmarks for each telling one.
ORDINARY = 1.0

#: A likeness below counts as none. The share of alike tokens that counts in full, and tokens that stand for the rest of a short text.
FLOOR, DENSE, FEW = 0.3, 0.01, 100

#: What a labelled row outside the margin costs against the length of the weights.
COST = 10.0

#: Power of the likeness (which is a kernel again) in that share, so that many faint ones don't add up to a clear one.
POWER = 3

#: Marks of a token's start and end.
START, END = "\x02", "\x03"

#: Characters of a token compared at once; longer tokens go through overlapping windows of this size, all of them.
SPAN = 32

#: Tokens whose likenesses are kept at hand.
CACHED = 400_000

_SPELLED = re.compile(r"(?<!\S)\S(?:[^\S\n]\S){2,}(?!\S)")
_MARKS = dict.fromkeys(map(ord, ".,;:!?\"'()[]{}|<>*#$%&=-_/\\+~^`@"))
_BLANKS = dict.fromkeys(map(ord, " \t\r\f\v\u00a0"))


def held_out(doc_id: int | None) -> bool:
    """Whether a row takes no part in training: crc32 of its id as text is divisible by 5. A null id counts as empty text."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def tokens(text: str) -> list[str]:
    """Lower-cased tokens without their marks; single characters with spaces between become one token too."""
    text = text.lower()
    out = text.translate(_MARKS).split()
    if _SPELLED.search(text):
        out += [m[0].translate(_MARKS | _BLANKS) for m in _SPELLED.finditer(text)]
    return out


def bag(text: str) -> set[str]:
    """The distinct tokens between their marks."""
    return {marked(t) for t in tokens(text)}


def marked(token: str) -> str:
    """A token between marks, of which it has more if it would otherwise be too short for a subsequence."""
    return (START + token + END).rjust(ORDER, START)


def windows(token: str) -> list[str]:
    """The token itself, or all of its overlapping windows if it is long."""
    return [token] if len(token) <= SPAN else [token[i : i + SPAN] for i in range(0, len(token) - SPAN // 2, SPAN // 2)]


def _codes(strings: list[str], width: int, pad: int) -> np.ndarray:
    """The strings' characters, a row each."""
    out = np.full((len(strings), width), pad, np.int32)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.int32)
    out[np.repeat(np.arange(len(strings)), lengths), np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = codes
    return out


def _subsequences(same, rows: int, columns: int, shape: tuple[int, ...]) -> np.ndarray:
    """The kernel by recursion over the characters of both strings; same(i, j): where their characters i and j are equal.

    at[k][j]: weight of the common subsequences of k characters found in the first i characters of the one and j of the
    other, stretched to the ends of both.
    """
    lam = np.float32(DECAY)
    at = [[np.full(shape, k == 0, np.float32) for _ in range(columns + 1)] for k in range(ORDER)]
    total = np.zeros(shape, np.float32)
    for i in range(rows):
        hits = [same(i, j) for j in range(columns)]
        for j, hit in enumerate(hits):
            total += hit * at[ORDER - 1][j]
        for k in range(ORDER - 1, 0, -1):
            run = np.zeros(shape, np.float32)
            older, mine = at[k - 1], at[k]
            for j, hit in enumerate(hits):
                run = lam * run + hit * older[j]
                if j + 1 < columns:
                    mine[j + 1] = lam * mine[j + 1] + lam * lam * run
    return total * lam * lam


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """Subsequence kernel of every left string with every right one."""
    s, t = _codes(left, max(map(len, left), default=0), -1), _codes(right, max(map(len, right), default=0), -2)
    return _subsequences(lambda i, j: (s[:, i, None] == t[None, :, j]).astype(np.float32), s.shape[1], t.shape[1], (len(left), len(right)))


def self_kernel(strings: list[str]) -> np.ndarray:
    """The kernel of each string with itself."""
    s = _codes(strings, max(map(len, strings), default=0), -1)
    return _subsequences(lambda i, j: ((s[:, i] == s[:, j]) & (s[:, i] >= 0)).astype(np.float32), s.shape[1], s.shape[1], (len(strings),))


def _paired(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The kernel of each row of codes with that of the other side at its place."""
    return _subsequences(lambda i, j: (s[:, i] == t[:, j]).astype(np.float32), s.shape[1], t.shape[1], (len(s),))


def _mass(landmark: str) -> np.ndarray:
    """For each set of its positions, as bits: the length of the landmark's image, of 1, that lies in subsequences of these positions' characters."""
    weights: Counter[str] = Counter()
    masks: dict[str, int] = {}
    for at in combinations(range(len(landmark)), ORDER):
        u = "".join(landmark[i] for i in at)
        weights[u] += DECAY ** (at[-1] - at[0] + 1)
        masks[u] = sum(1 << i for i, c in enumerate(landmark) if c in u)
    out = np.zeros(1 << len(landmark))
    every = np.arange(len(out))
    for u, w in weights.items():
        out[(every & masks[u]) == masks[u]] += w * w
    return np.sqrt(out / out[-1]).astype(np.float32)


class Likeness:
    """Which landmarks a token is alike, and how much: the kernel divided by both lengths in its space, from FLOOR on.

    A token without some of a landmark's characters has only the rest of the landmark's subsequences, and by Cauchy and
    Schwarz is alike at most as much as the length of that part; pairs that stay below FLOOR by this need no kernel. For that, a
    landmark has at most BITS characters; of a longer one the rest counts as always present, so that the bound holds.
    """

    BITS, LETTERS = 12, 4096

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.norms = np.sqrt(self_kernel(landmarks)) if landmarks else np.empty(0, np.float32)
        self.table = _codes(landmarks, max(map(len, landmarks), default=0), -2)
        letters = [np.array([ord(c) % self.LETTERS for c in m], np.int64) for m in landmarks]
        used = np.unique(np.concatenate([*letters, np.zeros(1, np.int64)]))
        self.column = np.full(self.LETTERS, len(used), np.int64)
        self.column[used] = np.arange(len(used))
        self.places = [self.column[c] for c in letters]
        self.masses = [_mass(m) if len(m) <= self.BITS else None for m in landmarks]
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "older": {}}

    def _part(self, strings: list[str]) -> list[list[tuple[int, float]]]:
        codes, owner, which = _codes(strings, max(map(len, strings), default=0), -1), [], []
        present = np.zeros((len(strings), int(self.column.max()) + 1), bool)
        row, at = np.nonzero(codes >= 0)
        present[row, self.column[codes[row, at] % self.LETTERS]] = True
        for n, (place, mass) in enumerate(zip(self.places, self.masses, strict=True)):
            if mass is None:
                near = np.arange(len(strings))
            else:
                near = np.flatnonzero(mass[present[:, place] @ (1 << np.arange(len(place)))] >= FLOOR)
            owner.append(near)
            which.append(np.full(len(near), n))
        owner, which = np.concatenate([*owner, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*which, np.empty(0, np.int64)]).astype(np.int64)
        out: list[list[tuple[int, float]]] = [[] for _ in strings]
        if not len(owner):
            return out
        needed = np.unique(owner)
        norms = np.zeros(len(strings), np.float32)
        norms[needed] = np.sqrt(np.maximum(self_kernel([strings[i] for i in needed]), 1e-12))
        alike = np.concatenate([_paired(codes[owner[i : i + 16384]], self.table[which[i : i + 16384]]) for i in range(0, len(owner), 16384)]) / (norms[owner] * self.norms[which])
        for k in np.flatnonzero(alike >= FLOOR):
            out[owner[k]].append((int(which[k]), float(alike[k])))
        return out

    def of(self, wanted: set[str]) -> dict[str, tuple]:
        """Pairs (landmark, likeness) of each token, kept for the next texts; what is still in use comes back from the older half."""
        new = []
        for t in wanted:
            if t not in self.known:
                if t in self.older:
                    self.known[t] = self.older[t]
                else:
                    new.append(t)
        if new:
            parts = sorted(((w, t) for t in new for w in windows(t)), key=lambda x: (len(x[0]), x))
            found: dict[str, dict[int, float]] = {t: {} for t in new}
            for at in range(0, len(parts), 2048):
                group = parts[at : at + 2048]
                for (_, t), near in zip(group, self._part([w for w, _ in group]), strict=True):
                    for n, v in near:
                        found[t][n] = max(v, found[t].get(n, 0.0))
            if len(self.known) + len(new) > CACHED:
                keep = {t: self.known[t] for t in wanted if t in self.known}
                self.older, self.known = self.known, keep
            for t, near in found.items():
                self.known[t] = tuple(near.items())
        return self.known

    def pooled(self, bags: list[set[str]]) -> np.ndarray:
        """For each bag of tokens and each landmark the greatest likeness, and, of 1, the share of alike tokens by DENSE."""
        n = len(self.landmarks)
        out = np.zeros((len(bags), 2 * n), np.float32)
        known = self.of(set().union(*bags)) if bags and n else {}
        for row, words in zip(out, bags, strict=True):
            if not n:
                break
            for t in words:
                for k, v in known[t]:
                    if v > row[k]:
                        row[k] = v
                    row[n + k] += v**POWER
            row[n:] = np.minimum(1, row[n:] / (DENSE * (len(words) + FEW)))
        return out


@dataclass
class Machine:
    """f(text) = weights . whitened pooled likenesses + bias; score = logistic(slope * f + offset)."""

    likeness: Likeness
    whiten: tuple[np.ndarray, ...] = ()
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = -1.0
    slope: float = 4.0
    offset: float = 0.0

    @property
    def landmarks(self) -> list[str]:
        return self.likeness.landmarks

    def features(self, bags: list[set[str]]) -> np.ndarray:
        pooled, n = self.likeness.pooled(bags), len(self.landmarks)
        return np.concatenate([pooled[:, :n] @ self.whiten[0], pooled[:, n:] @ self.whiten[1]], axis=1)

    def scores(self, texts: list[str | None]) -> list[float]:
        if not len(self.weights):
            f = np.full(len(texts), self.bias)
        else:
            f = self.features([bag(t or "") for t in texts]) @ self.weights + self.bias
        return (1 / (1 + np.exp(-np.clip(self.slope * f.astype(float) + self.offset, -30, 30)))).tolist()


def _log_chance(k: np.ndarray, having: np.ndarray, toxic: int, rows: int) -> np.ndarray:
    """Logarithm of the chance, from above, that of the rows that have a form k or more are toxic, if it had nothing to do with that; for k over its expectation."""
    table_ = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, rows + 1)))])
    log = lambda n, r: table_[n] - table_[r] - table_[n - r]
    first = log(np.full_like(k, toxic), k) + log(np.full_like(k, rows - toxic), having - k) - log(np.full_like(k, rows), having)
    # the terms fall by this factor and more from one to the next
    ratio = (toxic - k) * (having - k) / ((k + 1.0) * np.maximum(1, rows - toxic - having + k + 1))
    return first - np.log(np.maximum(1e-9, 1 - np.minimum(ratio, 0.999)))


def forms(token: str) -> list[str]:
    """The forms of a marked token that may become landmarks: its openings and itself."""
    return [token[: 1 + n] for n in OPENINGS if len(token) > n + 2] + ([token] if len(token) <= LONGEST else [])


def telling_forms(bags: list[tuple[set[str], int]]) -> list[str]:
    """Forms that more toxic rows have, or have in two tokens or more, than chance would give, most telling first.

    One-sided hypergeometric tests with Bonferroni over all that could pass. A form is left out if one that contains it,
    or that it contains, tells more and has nearly all of its toxic rows.
    """
    n_toxic, rows = sum(y for _, y in bags), len(bags)
    held: list[dict[str, list[int]]] = [{}, {}]
    seen = [Counter(), Counter()]
    for i, (words, y) in enumerate(bags):
        counts = Counter(f for t in words for f in forms(t))
        for f, n in counts.items():
            for least in (0, 1) if n > 1 else (0,):
                seen[least][f] += 1
                if y:
                    held[least].setdefault(f, []).append(i)
    tests = [(f, least) for least in (0, 1) for f, at in held[least].items() if len(at) >= 3]
    if not tests or n_toxic == rows:
        return []
    k, having = (np.array(x, np.int64) for x in ([len(held[m][f]) for f, m in tests], [seen[m][f] for f, m in tests]))
    over = k / having > 2 * n_toxic / rows * (1 / (1 + n_toxic / rows))
    log_p = np.where(over, _log_chance(k, having, n_toxic, rows), 0)
    best: dict[str, tuple[float, int]] = {}
    for n in np.flatnonzero(log_p + math.log(len(tests)) <= math.log(CHANCE)):
        f = tests[n][0]
        best[f] = min(best.get(f, (0.0, 0)), (float(log_p[n]), n))
    chosen: list[tuple[str, set[int]]] = []
    for f in sorted(best, key=lambda f: (round(best[f][0], 6), -len(f), f)):
        mine = set(held[0][f])
        if not any((f in g or g in f) and len(mine & theirs) >= SAME_ROWS * len(mine) for g, theirs in chosen):
            chosen.append((f, mine))
    return [f for f, _ in chosen]


def _loosened(token: str, rng: np.random.Generator) -> str:
    """A marked token with a character inserted or doubled, or two inserted."""
    word, letters = token.strip(START + END), "abcdefghijklmnopqrstuvwxyz"
    i, a = int(rng.integers(1, max(2, len(word)))), letters[int(rng.integers(26))]
    return marked(word[:i] + (a, 2 * a, word[i - 1 : i])[int(rng.integers(3))] + word[i:])


def _svm(x: np.ndarray, y: np.ndarray, n: np.ndarray, c: float = COST) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine with instance weights n, by Newton steps."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(float)
    w = np.zeros(x1.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    loss = lambda w: w @ ridge @ w + c * n @ np.maximum(0, 1 - y * (x1 @ w)) ** 2
    for _ in range(100):
        on = y * (x1 @ w) < 1
        a = x1[on] * n[on][:, None]
        step = np.linalg.solve(ridge + c * a.T @ x1[on], c * a.T @ y[on]) - w
        now, size = loss(w), 1.0
        while loss(w + size * step) > now - 1e-9 and size > 1e-4:
            size /= 2
        if size <= 1e-4:
            break
        w = w + size * step
    return w[:-1].astype(np.float32), float(w[-1])


def _logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a score that is 0.5 where most toxic rows less clean ones lie above, halfway to the next
    margin below, and 0.9 or more for the upper half of the toxic ones."""
    order = np.argsort(-f, kind="stable")
    gain = np.cumsum(np.where(y[order] > 0, 1 / max(1, (y > 0).sum()), -1 / max(1, (y <= 0).sum())))
    gain[:-1][f[order][1:] == f[order][:-1]] = -np.inf  # equal margins can't be told apart
    k = int(gain.argmax())
    cut = float(f[order[k : k + 2]].mean())
    upper = float(np.median(f[y > 0])) if (y > 0).any() else cut + 1
    slope = 2.2 / max(0.1, upper - cut)
    return slope, -slope * cut


def _ordinary(bags: list[tuple[set[str], int]], telling: list[str], n: int) -> list[str]:
    """Up to n forms of clean rows, the most like a telling one that aren't much like each other; no more, or whitening would blow up noise."""
    seen = Counter(f for words, y in bags if not y for t in words for f in forms(t))
    near = Likeness(telling)
    known = near.of({f for f, k in seen.items() if k >= 2 and f not in telling})
    ranked = sorted((f for f in known if known[f]), key=lambda f: (-max(v for _, v in known[f]), f))
    out: list[str] = []
    for f in ranked[: 50 * n]:
        if len(out) >= n:
            break
        if not any(v >= 0.7 for _, v in known[f]) and not (out and (kernel([f], out)[0] / np.sqrt(self_kernel([f])[0] * self_kernel(out))).max() >= 0.5):
            out.append(f)
    return out


def _whitening(alike: np.ndarray) -> np.ndarray:
    """The inverse square root of the landmarks' kernel, without blowing up what they have in common."""
    values, vectors = np.linalg.eigh(alike)
    return (vectors / np.sqrt(np.maximum(values, 0.1)) @ vectors.T).astype(np.float32)


def fit(rows: list[tuple[str, int]], seed: int = 7) -> Machine:
    """From (text, label) rows; rows that repeat count once, null texts as empty ones, and the order doesn't matter.

    Without toxic or without clean rows, or without a telling form, a machine that finds nothing toxic.
    """
    rng = np.random.default_rng(seed)
    bags = [(bag(t), y) for t, y in sorted({(t or "", y) for t, y in rows})]
    telling = telling_forms(bags)
    if not telling:
        return Machine(Likeness([]))
    landmarks = telling + _ordinary(bags, telling, math.ceil(ORDINARY * len(telling)))
    norms = np.sqrt(self_kernel(landmarks))
    alike = (kernel(landmarks, landmarks) / (norms[:, None] * norms[None, :])).astype(float)
    m = Machine(Likeness(landmarks), (_whitening(alike), _whitening(alike**POWER)))
    own = m.likeness.of({t for words, y in bags if y for t in words})
    loose = [{_loosened(t, rng) if any(k < len(telling) and v >= 0.5 for k, v in own[t]) else t for t in sorted(words)} for words, y in bags if y]
    parents = [i for i, (_, y) in enumerate(bags) if y]
    x = m.features([words for words, _ in bags] + loose)
    y = np.array([1.0 if y else -1.0 for _, y in bags] + [1.0] * len(loose))
    fold = np.array([zlib.crc32(str(i).encode()) % 2 for i in [*range(len(bags)), *parents]])
    toxic = y > 0
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum()) * len(bags)
    plain, margins = np.arange(len(bags)), np.zeros(len(y))
    for part in (0, 1):  # slope and offset come from margins of rows on which the weights weren't trained
        on = fold != part
        if not (toxic & on).any() or not (~toxic & on).any():
            on = np.ones(len(y), bool)
        w, b = _svm(x[on], y[on], weight[on])
        margins[fold == part] = x[fold == part] @ w + b
    m.weights, m.bias = _svm(x, y, weight)
    m.slope, m.offset = _logistic(margins[plain], y[plain])
    m.likeness.known, m.likeness.older = {}, {}
    return m


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_ROWS) -> list[tuple[str, int]]:
    """Up to per_class labelled rows of each class that aren't held out, those whose ids have the least hashes, and
    of them no more than SAMPLE_CHARS characters hold.

    Repeated labels count once, by their largest value; null labels, and other values than 0 and 1, are left out, as are
    null texts; of a repeated doc_id the least text counts; an empty table gives no row. The ids are bounded by the
    parameter, so they go to every task, and only the chosen texts come back.
    """
    spark = docs.sparkSession
    marks = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    )
    chosen = [r for y in (0, 1) for r in marks.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    if not chosen:
        return []
    ids = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen], "doc_id long, toxic int").coalesce(1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    out, held = [], 0
    for r in found.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        held += len(r["text"])
        if held > SAMPLE_CHARS:
            break
        out.append((r["text"], r["toxic"]))
    return out


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_ROWS) -> Machine:
    """fit() on labelled_sample(); of empty tables, or without rows of both classes, a machine that finds nothing toxic."""
    return fit(labelled_sample(docs, labels, per_class))


def _shared(blob: bytes) -> Machine:
    """The machine of a worker process, so that margins stay known from task to task."""
    return resident(("machine", blob), lambda: pickle.loads(blob))


def _pickled(m: Machine) -> bytes:
    return pickle.dumps(m)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) of whole texts; predicted is 1 for scores of 0.5 or more.

    Null and empty texts have the score of a text without tokens; a null doc_id is kept; repeated rows stay repeated; other
    columns are left out and never looked at.
    """
    small_batches(docs.sparkSession)
    blob = _pickled(machine)
    out = docs.sparkSession.createDataFrame([], "doc_id long, held_out boolean, score double, predicted int").schema

    def run(batches):
        m = _shared(blob)
        for b in batches:
            ids, s = b.column(0).to_pylist(), m.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([held_out(i) for i in ids]), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=out.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, out)


def keep_clean(docs: DataFrame, machine: Machine, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all of their columns, whose score stays below least; null and empty texts score as empty ones,
    repeated rows share their verdict, and an empty table stays empty."""
    small_batches(docs.sparkSession)
    blob = _pickled(machine)

    def run(batches):
        m = _shared(blob)
        for b in batches:
            yield b.filter(pa.array([s < least for s in m.scores(b.column(b.schema.get_field_index("text")).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents through score(), by a machine trained on the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
