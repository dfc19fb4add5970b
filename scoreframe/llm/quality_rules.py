"""Quality rules whose cutoffs are chosen on labelled documents, with a guaranteed bound on false rejections.

In each stratum the rules' cutoffs form one nested family of combined verdicts, from lenient to strict, laid out on one half
of the labelled rows. On the other half, the holdout, the verdicts are tested from the most lenient on: an exact binomial test says
whether at most a share alpha of good documents goes. Testing stops at the first failure, so that a stratum's sequence needs
no correction; over the strata delta is split, and the share of a stratum whose whole family is certified passes to the others.
Risk is that of documents that pass the base rules. Rows of equal measures, as exact copies, count once.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, lgamma, log, log1p

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.llm.common import durable, map_rows, table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

#: Strata: one per language named here, and one for the rest; this bounds what the driver gets.
LANGS = ("en", "de", "fr", "es")

#: Rule -> its score (higher is worse) and the cutoffs tried, most lenient first.
GRID = tuple(round(1 - i / 64, 6) for i in range(1, 64))
CUTOFFS = {
    "symbols": GRID,
    "dup_lines": GRID,
    "repeats": GRID,
    "long_words": tuple(float(x) for x in np.arange(32, 6, -0.25)),
    "short_words": tuple(float(x) for x in np.arange(-1, -6, -0.125)),
}

#: Steps of a stratum's family of verdicts.
STEPS = 64

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

FEATURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class Risk:
    """With confidence 1 - delta over all strata, each one loses at most alpha of the good documents that pass the base rules."""

    alpha: float = 0.05
    delta: float = 0.05


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
    v = len(ids)
    if v < 2_000_000:
        keys = (w[:-2] * v + w[1:-1]) * v + w[2:]
    else:  # too many for one number: number the pairs first
        pairs = np.unique(w[:-1] * v + w[1:], return_inverse=True)[1]
        keys = pairs[:-1] * v + w[2:]
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    again = np.isin(keys, twice)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def measures(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, lines with a word, n_dup_lines, n_repeat_words of a whole text; null counts as empty."""
    text = text or ""
    words = text.encode().split()
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            dups += line in seen
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        lines,
        dups,
        repeated_words(words),
    )


def features(docs: DataFrame) -> DataFrame:
    """The measures of every row of docs (doc_id, text, lang); null texts count as empty, repeated rows stay repeated."""
    return map_rows(
        docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text"),
        ["doc_id", "lang", "text"],
        FEATURES,
        lambda: lambda doc_id, lang, text: [(doc_id, lang, *measures(text))],
    )


def scores() -> dict[str, Column]:
    """Each rule's score, from the measures."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "long_words": F.col("word_chars") / words,
        "short_words": -(F.col("word_chars") / words),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def stratum() -> Column:
    return F.when(F.col("lang").isin(*LANGS), F.col("lang")).otherwise(F.lit("other"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), by summing exact terms."""
    if k >= n:
        return 1.0
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return min(1.0, exp(top + log(sum(exp(t - top) for t in terms))))


def certified(good: list[int], n: int, alpha: float, delta: float) -> int:
    """How many of the cutoffs, tested from the most lenient, are safe.

    good[i]: good documents that cutoff i rejects, of n. The test of "more than alpha of the good ones go" is the exact
    binomial one (that of the Clopper-Pearson bound); as it stops at the first failure, the sequence needs no correction.
    """
    for i, k in enumerate(good):
        if n == 0 or k > alpha * n or binomial_tail(k, n, alpha) > delta:
            return i
    return len(good)


def family(hist: list[tuple[str, str, int, int, int]], alpha: float) -> dict[tuple[str, str], list[int]]:
    """(stratum, rule) -> the index of the rule's cutoff at each step, -1 where it has none yet.

    hist has rows (stratum, rule, bin, quality, count) of the first half; bin i: rejected by cutoffs i and later. At step k a
    rule has, of the cutoffs with which it alone rejects at most alpha * (k + 1) / STEPS of the good rows, the one that rejects
    most bad rows less good ones, the most lenient of equals, if any does more good than harm. Later steps are never more lenient.
    """
    counts = {(s, rule): np.zeros((2, len(cutoffs) + 1), np.int64) for s in (*LANGS, "other") for rule, cutoffs in CUTOFFS.items()}
    for s, rule, i, quality, count in hist:
        counts[s, rule][quality, i] += count
    out = {}
    for key, c in counts.items():
        bad, good = c[:, :-1].cumsum(axis=1)
        n, steps = int(c[1].sum()), []
        for k in range(STEPS):
            gain = (bad - good)[good <= alpha * (k + 1) / STEPS * n]
            steps.append(int(gain.argmax()) if len(gain) and gain.max() > 0 else -1)
        out[key] = steps
    return out


def first_step(steps: list[int], n_cutoffs: int) -> list[int]:
    """For each bin of a rule's score the first step at which the rule rejects it, STEPS for none."""
    return [next((k for k, cut in enumerate(steps) if cut >= i), STEPS) for i in range(n_cutoffs + 1)]


def certify(hist: list[tuple[str, int, int, int]], risk: Risk) -> dict[str, int]:
    """Stratum -> the step to take, -1 for none, from rows (stratum, step, quality, count) of the holdout.

    Of the certified steps it is the one that rejects most bad rows less good ones, the most lenient of equals. Each stratum with
    good rows has its part of delta; that of one whose whole family is certified is dealt to the others, which are tested again.
    """
    counts: dict[str, np.ndarray] = {}
    for s, step, quality, count in hist:
        counts.setdefault(s, np.zeros((2, STEPS + 1), np.int64))[quality, step] += count
    n = {s: int(c[1].sum()) for s, c in counts.items()}
    share = {s: risk.delta / max(1, sum(m > 0 for m in n.values())) for s in counts if n[s]}
    done: set[str] = set()
    while True:
        safe = {s: certified(counts[s][1, :-1].cumsum().tolist(), n[s], risk.alpha, share[s]) for s in share}
        fresh = {s for s in safe if safe[s] == STEPS} - done
        done |= fresh
        rest = [s for s in share if s not in done]
        if not fresh or not rest:
            break
        freed = sum(share[s] for s in fresh)
        for s in rest:
            share[s] += freed / len(rest)
    out = {}
    for s, k in safe.items():
        bad, good = counts[s][:, :-1].cumsum(axis=1)
        gain = (bad - good)[:k]
        out[s] = int(gain.argmax()) if k and gain.max() > 0 else -1
    return out


def calibrate(measured: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> dict[tuple[str, str], float]:
    """(stratum, rule) -> cutoff, from the labelled documents among measured that pass the base rules.

    All labelled rows count, those of equal stratum and measures as one, which is good if any is. They meet as histograms
    whose size does not depend on the corpus. Labels other than 0 and 1 are left out, of repeated labels the largest counts,
    and rows with a null doc_id have none. Without labels there are no cutoffs.
    """
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    rows = measured.where(~base_failed()).withColumn("stratum", stratum()).join(marks, "doc_id")
    rows = durable(rows.groupBy("stratum", *MEASURES).agg(F.max("quality").alias("quality")).withColumn("half", F.crc32(F.concat_ws(",", *MEASURES)) % 2))
    bins = F.array(*[F.struct(F.lit(rule).alias("rule"), _bin(score, rule).cast("int").alias("bin")) for rule, score in scores().items()])
    first = rows.where("half = 0").select("stratum", "quality", F.explode(bins).alias("b")).groupBy("stratum", "b.rule", "b.bin", "quality").count().collect()
    laid = family([(r["stratum"], r["rule"], r["bin"], r["quality"], r["count"]) for r in first], risk.alpha)
    step = F.lit(STEPS)
    for s in (*LANGS, "other"):
        used = {rule: first_step(laid[s, rule], len(cutoffs)) for rule, cutoffs in CUTOFFS.items() if max(laid[s, rule]) >= 0}
        if used:
            at = [F.element_at(F.array(*map(F.lit, steps)), _bin(scores()[rule], rule).cast("int") + 1) for rule, steps in used.items()]
            step = F.when(F.col("stratum") == s, F.least(*at, F.lit(STEPS))).otherwise(step)
    held = rows.where("half = 1").withColumn("step", step).groupBy("stratum", "step", "quality").count().collect()
    taken = certify([(r["stratum"], r["step"], r["quality"], r["count"]) for r in held], risk)
    return {(s, rule): CUTOFFS[rule][laid[s, rule][k]] for s, k in taken.items() if k >= 0 for rule in CUTOFFS if laid[s, rule][k] >= 0}


def _bin(score: Column, rule: str) -> Column:
    """Index of the first cutoff that rejects: those above the score are passed over."""
    return F.aggregate(F.array(*[F.lit(c) for c in CUTOFFS[rule]]), F.lit(0), lambda n, c: n + F.when(c > score, 1).otherwise(0))


def judge(measured: DataFrame, cutoffs: dict[tuple[str, str], float]) -> DataFrame:
    """measured with base_failed, rejected_by (the first rule whose cutoff the score reaches, else null) and kept."""
    by = F.lit(None).cast("string")
    for (s, rule), cut in reversed(list(cutoffs.items())):
        by = F.when((stratum() == s) & (scores()[rule] >= F.lit(cut)), F.lit(rule)).otherwise(by)
    out = measured.withColumn("base_failed", base_failed()).withColumn("rejected_by", by)
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def quality(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """Every row of docs with its measures and verdict.

    A null or empty text has no words and fails the base rules; a null language belongs to the stratum of the rest; an
    empty table gives an empty one; repeated rows stay repeated; without labels, or with too few to certify a cutoff, only the base rules reject. Other
    columns are left out. The texts are read once: their measures are written to the shared folder, then used twice.
    """
    measured = durable(features(docs))
    return judge(measured, calibrate(measured, labels, risk))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through quality(), with cutoffs certified on all of the labels."""
    out = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
