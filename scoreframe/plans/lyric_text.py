"""Queries on lyric text: documents and conversations stand for recognised and true lyrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.functions import lyrics
from scoreframe.functions.text import split_bucket
from scoreframe.sources.tables import read, written

#: Documents of which a word has to stand in this many, to be in the dictionary.
DICTIONARY_DOCS = 40


def tokenise(spark: SparkSession, sf: str) -> DataFrame:
    t = read(spark, sf, "documents").select("doc_id", lyrics.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join(F.slice("t", 1, 5), " ").alias("opening"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def line_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).where(lyrics.is_lyric_line(F.col("line"))).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


def _dictionary(spark: SparkSession, sf: str) -> DataFrame:
    words = read(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.transform(lyrics.tokens(F.col("text")), F.lower))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= DICTIONARY_DOCS).select("word")


def prose_lines(spark: SparkSession, sf: str) -> DataFrame:
    out = lyrics.prose_lines(_lines(spark, sf), ["doc_id"], "line_no", "line", _dictionary(spark, sf))
    return out.select("doc_id", F.col("line_no").cast("long").alias("line_no"))


def token_filter(spark: SparkSession, sf: str) -> DataFrame:
    t = read(spark, sf, "conversations").select(F.explode(F.split("text", r"[ \n]+")).alias("token")).distinct()
    known = _dictionary(spark, sf).withColumn("known", F.lit(True))
    out = t.withColumn("word", lyrics.bare_word(F.col("token"))).join(known, "word", "left")
    return out.select("token", lyrics.is_lyric_token(F.col("token")).alias("is_lyric"), lyrics.is_real_word(F.col("token"), F.coalesce("known", F.lit(False))).alias("is_word"), lyrics.fix_contraction(F.col("token")).alias("fixed"))


def contractions(spark: SparkSession, sf: str) -> DataFrame:
    """Known contractions put together from supplier numbers, with and without capitals and marks after."""
    words = list(lyrics.CONTRACTIONS)
    s = read(spark, sf, "supplier").select("s_suppkey", F.element_at(F.array(*map(F.lit, [*words, "other"])), (F.col("s_suppkey") % (len(words) + 1) + 1).cast("int")).alias("w"))
    token = F.concat(F.when(F.col("s_suppkey") % 2 == 0, F.initcap("w")).otherwise(F.col("w")), F.when(F.col("s_suppkey") % 3 == 0, ",").otherwise(""))
    return s.select("s_suppkey", token.alias("token"), lyrics.fix_contraction(token).alias("fixed"))


def merged_words(spark: SparkSession, sf: str) -> DataFrame:
    """The different tokens of all documents that polishing changes, with the number of their places: merged words of the corpus dictionary, and contractions."""
    t = read(spark, sf, "documents").select(F.explode(lyrics.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    # both are read several times, and are far smaller than the texts
    out = lyrics.polish(written(t), "token", written(_dictionary(spark, sf)))
    return out.where("polished <> token").select("token", "n", "polished")


def verse_pairing(spark: SparkSession, sf: str) -> DataFrame:
    out = lyrics.pair_verses(_lines(spark, sf), ["doc_id"], "line_no", "line")
    return out.where("verse > 0").select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("verse").cast("long").alias("verse"))


def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", split_bucket(F.col("doc_id")).cast("long").alias("bucket"))
    return d.withColumn("part", F.when(F.col("bucket") < 100, "val").otherwise("train"))


TOKENS = "list_transform(regexp_extract_all(translate(replace(replace({0}, '’', ''''), ' - ', ' '), '_', ' '), '[A-Za-z][A-Za-z''’]*'), lambda t: case when length(t) - length(replace(t, '''', '')) > 1 then replace(t, '''', '') || '''' else t end)"
LINES = "lines as (select doc_id, cast(i - 1 as bigint) as line_no, string_split(text, chr(10))[i] as line from documents, lateral (select unnest(range(1, len(string_split(text, chr(10))) + 1)) as i))"
DICTIONARY = f"dictionary as (select word from (select doc_id, unnest(list_distinct(list_transform({TOKENS.format('text')}, lambda t: lower(t)))) as word from documents) group by word having count(*) >= {DICTIONARY_DOCS})"
_LIGATURES = "token"
for _a, _b in lyrics.LIGATURES.items():
    _LIGATURES = f"replace({_LIGATURES}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"
EDGES = ".,;:!?\"''’()[]-_"

QUERIES = {
    "tokenise": (tokenise, f"with t as (select doc_id, {TOKENS.format('text')} as t from documents) select doc_id, len(t) as n_tokens, array_to_string(t[1:5], ' ') as opening, md5(array_to_string(t, ' ')) as digest from t"),
    "line_filter": (line_filter, f"""
        with {LINES} select doc_id, line_no from lines where regexp_matches(line, '\\S') and not regexp_matches(ltrim(lower(line), '‘''"`'), '^(copyright|lyrics by|music by)')
        and not regexp_matches(lower(line), 'publishing|publication|chappell & co|harms inc|renewed,|co\\., inc') and not regexp_matches(line, '^[A-Z''\\s]+$')"""),
    "prose_lines": (prose_lines, f"""
        with {LINES}, {DICTIONARY},
        w as (select doc_id, line_no, lower(unnest(list_filter({TOKENS.format('line')}, lambda t: length(t) >= 4))) as word from lines),
        k as (select doc_id, line_no from w where word in (select word from dictionary) group by all having count(*) >= 2),
        c as (select l.*, length(regexp_replace(line, '\\P{{L}}', '', 'g')) as letters, length(regexp_replace(line, '\\P{{Lu}}', '', 'g')) as up, length(regexp_replace(line, '\\P{{Ll}}', '', 'g')) as low from lines l join k using (doc_id, line_no)),
        g as (select *, lag(line) over (partition by doc_id order by line_no) as before from c where letters >= 0.4 * length(line) and not (up > low and length(line) > 40))
        select doc_id, line_no from g where before is null or before <> line"""),
    "token_filter": (token_filter, f"""
        with t as (select distinct unnest(regexp_split_to_array(text, '[ \\n]+')) as token from conversations), {DICTIONARY},
        b as (select token, trim(token, '{EDGES}') as bare from t),
        d as (select b.*, dictionary.word is not null as known from b left join dictionary on lower(bare) = word),
        m as (select *, regexp_replace(bare, '\\P{{L}}', '', 'g') as letters, regexp_extract(token, '^([A-Za-z'']+)', 1) as core from d),
        f as (select *, map {{{', '.join("'" + k + "': '" + v.replace("'", "''") + "'" for k, v in lyrics.CONTRACTIONS.items())}}}[lower(core)] as fix from m)
        select token, bare <> '' and lower(bare) not in ({', '.join("'" + w + "'" for w in lyrics.NON_LYRICS)}) and not regexp_matches(lower(bare), 'tempo|animato|ritard')
            and not regexp_matches(bare, '^[A-G][b#]?(m|maj|aug|dim|sus|add|m7|maj7|m6|dim7|m11|m9|m13)?(\\d+)?([+\\-])?(/[A-G][b#]?)?$') as is_lyric,
            case length(bare) when 0 then false when 1 then lower(bare) in ('a', 'i', 'o') when 2 then true else known and regexp_matches(letters, '^(\\p{{Ll}}*|\\p{{Lu}}*|\\p{{Lu}}\\p{{Ll}}*)$') end as is_word,
            case when fix is null then token when regexp_matches(core, '^[A-Z]') then upper(left(fix, 1)) || substr(fix, 2) || substr(token, length(core) + 1) else fix || substr(token, length(core) + 1) end as fixed from f"""),
    "contractions": (contractions, f"""
        with w as (select s_suppkey, [{', '.join("'" + k + "'" for k in [*lyrics.CONTRACTIONS, 'other'])}][cast(s_suppkey % {len(lyrics.CONTRACTIONS) + 1} + 1 as int)] as w,
            [{', '.join("'" + v.replace("'", "''") + "'" for v in [*lyrics.CONTRACTIONS.values(), 'other'])}][cast(s_suppkey % {len(lyrics.CONTRACTIONS) + 1} + 1 as int)] as f,
            case when s_suppkey % 3 = 0 then ',' else '' end as mark from supplier)
        select s_suppkey, case when s_suppkey % 2 = 0 then upper(left(w, 1)) || substr(w, 2) else w end || mark as token,
            case when s_suppkey % 2 = 0 then upper(left(f, 1)) || substr(f, 2) else f end || mark as fixed from w"""),
    "merged_words": (merged_words, f"""
        with recursive {DICTIONARY}, t as (select token, count(*) as n from (select unnest({TOKENS.format('text')}) as token from documents) group by token),
        fix as (select unnest([{', '.join("'" + k + "'" for k in lyrics.CONTRACTIONS)}]) as a, unnest([{', '.join("'" + v.replace("'", "''") + "'" for v in lyrics.CONTRACTIONS.values())}]) as b),
        o as (select token, n, {_LIGATURES} as o from t), c as (select o.*, regexp_extract(o, '^([A-Za-z'']+)', 1) as word from o),
        f as (select token, n, case when b is null then o when regexp_matches(word, '^[A-Z]') then upper(left(b, 1)) || substr(b, 2) || substr(o, length(word) + 1) else b || substr(o, length(word) + 1) end as fixed from c left join fix on a = lower(word)),
        g as (select *, regexp_extract(fixed, '^([^A-Za-z'']*)([A-Za-z''][A-Za-z'']*)([^A-Za-z'']*)', 2) as core from f),
        core as (select distinct lower(core) as core, length(core) as len from g where length(core) >= 6 and lower(core) not in (select word from dictionary)),
        piece as (select core, s + k as e, s from core, lateral (select unnest(range(0, len - 1)) as s), lateral (select unnest(range(2, least(15, len - s) + 1)) as k) where substr(core, s + 1, k) in (select word from dictionary)),
        chain as (
            select core, 0 as e, [[0, 0]] as best from core
            union all
            select core, e, list_append(best, found) from (
                select c.core, c.e + 1 as e, c.best, list_min(list_transform(list_filter(p.starts, lambda s: c.best[s + 1] is not null), lambda s: [c.best[s + 1][1] + 1, s])) as found
                from chain c left join (select core, e, list(s) as starts from piece group by core, e) p on p.core = c.core and p.e = c.e + 1 where c.e < length(c.core)
            )
        ),
        back as (
            select core, e as pos, best, [] :: integer[] as starts from chain where e = length(core) and best[e + 1] is not null and best[e + 1][1] > 1
            union all
            select core, best[pos + 1][2], best, list_prepend(cast(best[pos + 1][2] as integer), starts) from back where pos > 0
        ),
        split as (select core, starts, list_append(starts[2:], length(core)) as ends from back where pos = 0),
        h as (select g.*, starts, ends, case when regexp_matches(g.core, '^[A-Z]') then upper(left(split.core, 1)) || substr(split.core, 2) else split.core end as head from g left join split on split.core = lower(g.core)),
        parts as (select token, n, fixed, case when starts is null then [fixed] else list_transform(range(1, len(starts) + 1), lambda i: substr(head, starts[i] + 1, ends[i] - starts[i])) end as parts from h),
        each as (select token, n, unnest(parts) as part, unnest(range(1, len(parts) + 1)) as i from parts),
        w as (select *, regexp_extract(part, '^([A-Za-z'']+)', 1) as word from each),
        again as (select token, n, i, case when b is null then part when regexp_matches(word, '^[A-Z]') then upper(left(b, 1)) || substr(b, 2) || substr(part, length(word) + 1) else b || substr(part, length(word) + 1) end as part from w left join fix on a = lower(word)),
        p as (select token, any_value(n) as n, string_agg(part, ' ' order by i) as polished from again group by token)
        select * from p where polished <> token"""),
    "verse_pairing": (verse_pairing, f"""
        with {LINES}, s as (select doc_id, line_no, list_transform(list_filter({TOKENS.format('line')}, lambda t: length(t) >= 2), lambda t: lower(left(t, 2))) as sig from lines),
        n as (select *, lead(sig) over (partition by doc_id order by line_no) as nxt from s),
        h as (select *, sig[1:5] as x, nxt[1:5] as y from n),
        c as (select *, coalesce(len(x) >= 2 and len(y) >= 2 and len(sig) / len(nxt) between 0.5 and 2.0
            and list_sum(list_transform(list_distinct(x), lambda t: least(len(list_filter(x, lambda u: u = t)), len(list_filter(y, lambda u: u = t))))) / greatest(len(x), len(y)) >= 0.6, false) as can from h),
        r as (select *, coalesce(sum(case when can then 0 else 1 end) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as run from c),
        p as (select *, can and row_number() over (partition by doc_id, run order by line_no) % 2 = 1 as head from r),
        v as (select doc_id, line_no, case when head then 1 when lag(head) over (partition by doc_id order by line_no) then 2 else 0 end as verse from p)
        select doc_id, line_no, cast(verse as bigint) as verse from v where verse > 0"""),
    "hash_split": (hash_split, """
        with h as (select doc_id, left(sha1(cast(doc_id as varchar)), 8) as h from documents)
        select doc_id, cast(list_sum(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', substr(h, i, 1)) - 1) * (16 ** (8 - i)))) as bigint) % 1000 as bucket,
            case when cast(list_sum(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', substr(h, i, 1)) - 1) * (16 ** (8 - i)))) as bigint) % 1000 < 100 then 'val' else 'train' end as part from h"""),
}
