"""Lyric text: tokens, line and token filters, word tests, contractions and merged words."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
WORD = r"[A-Za-z][A-Za-z'’]*"
EDGES = ".,;:!?\"'’()[]-_"
CREDITS = ("copyright", "lyrics by", "music by")
PUBLISHERS = ("publishing", "publication", "chappell & co", "harms inc", "renewed,", "co., inc")
TITLE = r"^[A-Z'\s]+$"
ONE_LETTER_WORDS = ("a", "i", "o")
NON_LYRICS = (
    "copyright", "publish", "publishing", "publication", "renewed", "assigned", "chappell", "gershwin", "co.,", "inc.", "&",
    "a tempo", "animato", "animate", "rit.", "ritard.", "rall.", "accel.", "molto", "poco", "rit", "rall", "ad", "lib.",
    "leggiero", "tempo", "espressivo", "dolce", "marc.", "marcato", "mp", "mf", "pp", "ff", "fff", "ppp", "fp", "sf", "sfz",
    "fine", "coda", "segno", "dal", "andante", "allegro", "allargando", "presto", "vivace", "moderato", "lento", "adagio", "largo",
)
MARKING_PARTS = ("tempo", "animato", "ritard")
CHORD_SHAPE = r"^[A-G][b#]?(?:m|maj|aug|dim|sus|add|m7|maj7|m6|dim7|m11|m9|m13)?(?:\d+)?(?:[+\-])?(?:/[A-G][b#]?)?$"
CONTRACTIONS = {
    "dont": "don't", "wont": "won't", "cant": "can't", "lll": "I'll", "ill": "I'll", "im": "I'm", "youre": "you're", "theyre": "they're",
    "isnt": "isn't", "wasnt": "wasn't", "lets": "Let's",
}
LIGATURES = {"’": "'", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
LONGEST_PIECE, SHORTEST_PIECE, SHORTEST_MERGED = 15, 2, 6


def tokens(line: Column) -> Column:
    """Words of a line, in order: letters and apostrophes; hyphens and underscores part them; two apostrophes or more become one at the end."""
    s = F.translate(F.replace(F.replace(line, F.lit("’"), F.lit("'")), F.lit(" - "), F.lit(" ")), "_", " ")
    collapse = lambda t: F.when(F.length(t) - F.length(F.replace(t, F.lit("'"))) > 1, F.concat(F.replace(t, F.lit("'")), F.lit("'"))).otherwise(t)
    return F.transform(F.regexp_extract_all(s, F.lit(f"({WORD})"), 1), collapse)


def is_lyric_line(line: Column) -> Column:
    """Whether a line may be lyrics: not blank, no credit, no publisher, not all capitals. Null is none."""
    low = F.ltrim(F.lower(line), F.lit("‘'\"`"))
    credit = F.lit(False)
    for x in CREDITS:
        credit = credit | low.startswith(x)
    for x in PUBLISHERS:
        credit = credit | low.contains(x)
    return F.coalesce(line.rlike(r"\S") & ~credit & ~line.rlike(TITLE), F.lit(False))


def bare(token: Column) -> Column:
    """A token without white space and then marks at its edges."""
    return F.btrim(F.btrim(token, F.lit(" \t\r\n\f\v")), F.lit(EDGES))


def is_lyric_token(token: Column) -> Column:
    """Whether a token may be sung: not a tempo, dynamic or publisher's word, not shaped like a chord. Null is none."""
    low = F.lower(bare(token))
    marking = low.isin(*NON_LYRICS)
    for x in MARKING_PARTS:
        marking = marking | low.contains(x)
    return F.coalesce((low != "") & ~marking & ~bare(token).rlike(CHORD_SHAPE), F.lit(False))


def canonical_case(text: Column) -> Column:
    """All lower, all upper, or a capital and then lower; marks don't count."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    return letters.rlike(r"^(\p{Ll}*|\p{Lu}*|\p{Lu}\p{Ll}*)$")


def is_real_word(token: Column, in_dictionary: Column) -> Column:
    """One letter: a, i or o; two: always; more: in the dictionary (a condition on the bare, lower-cased word) and of canonical case."""
    raw = F.btrim(F.replace(token, F.lit("’"), F.lit("'")), F.lit(".,;:!?\"'()[]-_"))
    n = F.length(raw)
    return F.coalesce(F.when(n == 0, False).when(n == 1, F.lower(raw).isin(*ONE_LETTER_WORDS)).when(n == 2, True).otherwise(in_dictionary & canonical_case(raw)), F.lit(False))


def bare_word(token: Column) -> Column:
    """What of a token is looked up in the dictionary."""
    return F.lower(F.btrim(F.replace(token, F.lit("’"), F.lit("'")), F.lit(".,;:!?\"'()[]-_")))


def fix_contraction(token: Column) -> Column:
    """A known contraction at the token's start with its apostrophe, capital kept; other tokens as they are."""
    core, rest = F.regexp_extract(token, "^([A-Za-z']+)", 1), F.regexp_replace(token, "^[A-Za-z']+", "")
    fixed = F.create_map(*[F.lit(x) for kv in CONTRACTIONS.items() for x in kv])[F.lower(core)]
    cased = F.when(core.rlike("^[A-Z]"), F.concat(F.upper(F.substring(fixed, 1, 1)), F.substring(fixed, F.lit(2), F.length(fixed)))).otherwise(fixed)
    return F.when(fixed.isNotNull(), F.concat(cased, rest)).otherwise(token)


def open_ligatures(token: Column) -> Column:
    """Typeset ligatures and curly apostrophes as plain characters."""
    for a, b in LIGATURES.items():
        token = F.replace(token, F.lit(a), F.lit(b))
    return token


def fewest_pieces(length: int, pieces: list[tuple[int, int]]) -> list[int] | None:
    """Where the pieces of the shortest chain from 0 to length begin, of pieces (end, start); of chains of one length that whose last piece begins first, and so on back; None if there is none."""
    best: list[tuple[int, int] | None] = [None] * (length + 1)
    best[0] = (0, 0)
    for end, start in sorted(pieces):
        before = best[start]
        if before is not None and (best[end] is None or before[0] + 1 < best[end][0]):
            best[end] = (before[0] + 1, start)
    if best[length] is None:
        return None
    out, at = [], length
    while at:
        at = best[at][1]
        out.append(at)
    return out[::-1]


def segment(core: str, words: frozenset[str]) -> list[str] | None:
    """The fewest dictionary words that make up core; None if there is no way or core is one itself. For one token and a dictionary at hand; split_merged is for tables."""
    if len(core) < SHORTEST_MERGED or core in words:
        return None
    spans = [(end, start) for end in range(1, len(core) + 1) for start in range(max(0, end - LONGEST_PIECE), end - SHORTEST_PIECE + 1) if core[start:end] in words]
    starts = fewest_pieces(len(core), spans)
    return [core[a:b] for a, b in zip(starts, [*starts[1:], len(core)], strict=True)] if starts and len(starts) > 1 else None


#: A token's marks, its core of letters and apostrophes, and the marks after; what follows is dropped.
MERGED = r"^([^A-Za-z']*)([A-Za-z'][A-Za-z']*)([^A-Za-z']*)"


def merged_splits(tokens: DataFrame, token: str, words: DataFrame) -> DataFrame:
    """Rows (token, split) of those distinct tokens that are merged words: with spaces between the fewest words of the dictionary that make them up.

    Every stretch of a token that can be a word meets the dictionary in a join, so neither has a bound on its size; what matches, a few stretches
    a letter, gives the best split.
    """
    core = F.lower(F.regexp_extract(token, MERGED, 2))
    word = words.where(F.col(words.columns[0]).isNotNull()).select(F.col(words.columns[0]).alias("_w")).distinct()
    cores = tokens.select(core.alias("_core")).where(F.length("_core") >= SHORTEST_MERGED).distinct().join(word, F.col("_core") == F.col("_w"), "left_anti")
    starts = F.explode(F.sequence(F.lit(0), F.length("_core") - SHORTEST_PIECE))
    sizes = F.explode(F.sequence(F.lit(SHORTEST_PIECE), F.least(F.lit(LONGEST_PIECE), F.length("_core") - F.col("_s"))))
    pieces = cores.withColumn("_s", starts).withColumn("_n", sizes).select("_core", "_s", "_n", F.substring("_core", F.col("_s") + 1, F.col("_n")).alias("_w"))
    found = pieces.join(word, "_w").groupBy("_core").agg(F.collect_list(F.struct((F.col("_s") + F.col("_n")).alias("end"), F.col("_s").alias("start"))).alias("_found"))

    @F.arrow_udf("array<int>")
    def chain(length: pa.Array, found: pa.Array) -> pa.Array:
        rows = zip(length.to_pylist(), found.to_pylist(), strict=True)
        return pa.array([fewest_pieces(n, [(p["end"], p["start"]) for p in f]) for n, f in rows], pa.list_(pa.int32()))

    chained = found.withColumn("_starts", chain(F.length("_core"), F.col("_found"))).where(F.size("_starts") > 1).select("_core", "_starts")
    known = tokens.select(F.col(token).alias("token")).distinct().withColumn("_core", F.lower(F.regexp_extract("token", MERGED, 2)))
    raw = F.regexp_extract("token", MERGED, 2)
    head = F.when(raw.rlike("^[A-Z]"), F.concat(F.upper(F.substring("_core", 1, 1)), F.substring("_core", F.lit(2), F.length("_core")))).otherwise(F.col("_core"))
    ends = F.concat(F.slice("_starts", F.lit(2), F.size("_starts") - 1), F.array(F.length("_core")))
    parts = F.zip_with("_starts", ends, lambda a, b: F.substring(F.col("_head"), a + 1, b - a))
    out = known.join(chained, "_core").withColumn("_head", head)
    return out.select("token", F.concat(F.regexp_extract("token", MERGED, 1), F.array_join(parts, " "), F.regexp_extract("token", MERGED, 3)).alias("split"))


def split_merged(df: DataFrame, token: str, words: DataFrame, out: str = "split") -> DataFrame:
    """df with the column out: tokens of merged words with spaces between, others as they are, null for null. words has one column of lower-cased words."""
    splits = merged_splits(df, token, words).withColumnsRenamed({"token": "_merged", "split": "_parted"})
    return df.join(splits, F.col(token) == F.col("_merged"), "left").withColumn(out, F.coalesce("_parted", token)).drop("_merged", "_parted")


def polish(df: DataFrame, token: str, words: DataFrame, out: str = "polished") -> DataFrame:
    """Ligatures opened, contractions fixed, merged words split, and contractions fixed in the pieces."""
    fixed = df.withColumn("_fixed", fix_contraction(open_ligatures(F.col(token))))
    parted = split_merged(fixed, "_fixed", words, "_split")
    pieces = F.filter(F.split("_split", r"\s+"), lambda p: p != "")
    return parted.withColumn(out, F.array_join(F.transform(pieces, fix_contraction), " ")).drop("_fixed", "_split")


def opening(line: Column, letters: int = 2) -> Column:
    """First letters of each token that has as many, lower-cased."""
    return F.transform(F.filter(tokens(line), lambda t: F.length(t) >= letters), lambda t: F.lower(F.substring(t, 1, letters)))


def shared_openings(a: Column, b: Column, n: int = 5) -> Column:
    """Share of the first n openings that two lines have in common, counted with repeats; 0 if either has fewer than two."""
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    count = lambda items, t: F.size(F.filter(items, lambda u: u == t))
    common = F.aggregate(F.array_distinct(x), F.lit(0), lambda total, t: total + F.least(count(x, t), count(y, t)))
    few = (F.size(x) < 2) | (F.size(y) < 2)
    return F.when(few, 0.0).otherwise(common / F.greatest(F.size(x), F.size(y)))


def pair_verses(lines: DataFrame, by: list[str], order: str, line: str) -> DataFrame:
    """lines with verse: 1 and 2 for two consecutive lines that open alike and are of like length, 0 for lines of both verses.

    A line pairs with the next from the top, and a paired line is used up: in a run of lines each of which could pair with the next,
    every other one does. So runs are islands, and no line waits for another.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order)
    sig = lines.withColumn("_sig", opening(F.col(line))).withColumn("_next", F.lead("_sig").over(w))
    ratio = F.try_divide(F.size("_sig"), F.size("_next"))
    can = F.coalesce((F.size("_sig") > 0) & (F.size("_next") > 0) & (shared_openings(F.col("_sig"), F.col("_next")) >= 0.6) & ratio.between(0.5, 2.0), F.lit(False))
    runs = sig.withColumn("_can", can).withColumn("_run", F.count_if(~F.col("_can")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    placed = runs.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_run").orderBy(order)))
    first = F.col("_can") & (F.col("_n") % 2 == 1)
    before = F.lag(first).over(w)
    return placed.withColumn("verse", F.when(first, 1).when(before, 2).otherwise(0)).drop("_sig", "_next", "_can", "_run", "_n")


def prose_lines(lines: DataFrame, by: list[str], order: str, line: str, dictionary: DataFrame) -> DataFrame:
    """Lines with two or more dictionary words of four letters, letters for 40 % of their characters, and not long and mostly capital;
    of equal kept lines in a row the first. dictionary has one column and is joined by word."""
    from pyspark.sql import Window

    words = lines.select(*by, order, F.explode(tokens(F.col(line))).alias("_w")).where("length(_w) >= 4").select(*by, order, F.lower("_w").alias("_w"))
    known = words.join(dictionary.select(F.col(dictionary.columns[0]).alias("_w")).distinct(), "_w", "left_semi").groupBy(*by, order).agg(F.count("*").alias("_n")).where("_n >= 2")
    c = F.col(line)
    letters, upper, lower = (F.regexp_count(c, F.lit(p)) for p in (r"\p{L}", r"\p{Lu}", r"\p{Ll}"))
    good = lines.where((letters >= 0.4 * F.length(c)) & ~((upper > lower) & (F.length(c) > 40))).join(known.drop("_n"), [*by, order], "left_semi")
    before = F.lag(line).over(Window.partitionBy(*by).orderBy(order))
    return good.withColumn("_before", before).where("_before is null or not _before <=> " + f"`{line}`").drop("_before")
