"""Problem 3: texts cut off by field limits or in transfer, in SQL expressions only.

1. A record's own lines are its lines without blank ones and without the lines its source repeats (problem 5).
2. Lines of tags, credits, links and contacts are told from prose by how they open: an opening (first
   two tokens, digit runs alike) is not prose if its lines hardly ever end a sentence.
3. Tokens are words, numbers and single signs; names become A, numbers 0. Word trigrams are
   counted by the texts that hold them, and apart from them the final trigrams of the records' last prose lines, after known signs of omission are
   taken off the end. Texts that agree to the letter count once, for openings too, so copies decide nothing.
4. Each final trigram is joined to the counts. A record is cut if its ending is frequent
   inside texts but almost never terminal: if the share of its occurrences that end a text is below TERMINAL. That share is drawn towards that of its
   last two tokens, and theirs towards that of the trigram with w for each word, as if PRIOR more occurrences had it; what stands
   inside texts fewer than LEAST times (a word cut in the middle) says nothing, so the more general share decides.

Defined results: null and blank texts, and texts with nothing but repeated or non-prose lines, are no
cases; a null source has no repeated lines and reports under a null source; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.llm.lines import own_lines
from newsloom.session import broadcast_if_small, stage, table

LEAST = 8  # occurrences inside texts from which a pattern is frequent
PRIOR = 200  # occurrences that the next more general pattern counts for
TAIL = 9  # chunks between blanks at a text's end that are looked at first; the whole line if they hold no three tokens
LEAST_LINES = 4  # lines from which an opening tells prose from the rest
TERMINAL = 0.1  # share of occurrences that end a text below which an ending is almost never terminal
OPENING_ENDED = 0.2
SMALL = 200_000
FEW_OPENINGS = 2_000  # as a literal; more are joined
# Signs of omission and debris that feeds leave at a cut.
# Possessive, from the start of each run and at most 40 signs, so that no text makes it slow.
OMISSION = r"(?:(?<!\s)\s*+(?:(?<!\.)\.{3,}+|\x{2026}++|\[(?:\x{2026}|\.{3})\]|\((?:\x{2026}|\.{3}|more)\)|(?<!>)>++|\x{BB}++|\x{FFFD}++|&[#a-zA-Z0-9]{0,8};?|<[a-zA-Z/]{0,8}|(?i:read more|continue(?: reading)?))){1,40}+\s*$"
# letters as plain ranges: class unions such as [^\s\p{L}] cost several times as much per character
LETTER = r"A-Za-z\x{C0}-\x{1FFF}\x{2C00}-\x{FFEF}"
TOKEN = rf"(?:[{LETTER}]++|[^ \n{LETTER}])"
ENDED = r"[.!?\x{964}\x{3002}][\x{22}\x{27}\x{201D}\x{2019}\x{BB})\]]*\s*$"


def opening(line: Column) -> Column:
    """First two tokens of a line: the first in lower case, the second with digit runs and capitalised words alike."""
    token = r"(\p{Nd}+|\p{L}[\p{L}\p{M}'-]*|[^\s])"
    first, second = (F.regexp_extract(line, rf"^\s*{token}\s*{token}?", i) for i in (1, 2))
    return F.concat_ws(" ", F.regexp_replace(F.lower(first), r"\p{Nd}+", "0"), F.regexp_replace(F.regexp_replace(second, r"\p{Nd}+", "0"), r"^\p{Lu}.*", "A"))


def plain(text: Column) -> Column:
    """Text with one blank between words, names as A, numbers as 0 and two marks at the start of each line."""
    x = F.regexp_replace(text, r"\p{Nd}+(?:[.,]\p{Nd}+)*", "0")
    x = F.regexp_replace(x, r"\p{Lu}[\p{L}\p{M}]*", "A")
    return F.regexp_replace(F.regexp_replace(x, r"[^\S\n]{2,}|[^\S\n ]", " "), r"(?m)^ ?", "^^ ")


def _counts(text: DataFrame) -> DataFrame:
    """key, n: texts that hold each trigram (g...), line openings (o...), and of these the lines that end a sentence (e...); one pass over the texts."""
    grams = F.array_distinct(F.regexp_extract_all(plain(F.col("text")), F.lit(f"(?=({TOKEN} ?{TOKEN} ?{TOKEN})){TOKEN}"), F.lit(1)))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    heads = F.transform(lines, lambda x: F.concat(F.when(x.rlike(ENDED), "e").otherwise("o"), opening(x)))
    return text.select(F.explode(F.concat(F.transform(grams, lambda g: F.concat(F.lit("g"), g)), heads)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def judged(df: DataFrame, doc: str, source: str, text: str) -> DataFrame:
    """doc, source, cut (boolean), omission (a sign of omission stands at the end); one row for each record."""
    x = df.select(doc, source, text)
    counts = stage(_counts(_once(x, doc, text).select(F.col(text).alias("text"))), "p3-counts").withColumns({"kind": F.substring("key", 1, 1), "key": F.expr("substring(key, 2)")})
    heads = counts.where("kind in ('o', 'e')").groupBy(F.col("key").alias("open")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("kind") == "e", F.col("n")).otherwise(0)).alias("ended"))
    other = heads.where((F.col("n") >= LEAST_LINES) & (F.col("ended") < OPENING_ENDED * F.col("n"))).select("open")
    x = _prose(own_lines(x, doc, source, text, "own").select(doc, source, "own", F.xxhash64(text).alias("_form")), other)
    # what follows the last blanks decides; the start of a line with fewer words is kept with it
    bind = lambda value, body: F.transform(F.array(value), body)[0]

    def ending(tail: Column) -> Column:
        cut = lambda t: F.struct((F.length(t) < F.length(tail)).alias("omission"), F.regexp_extract(plain(t), f"({TOKEN} ?{TOKEN} ?{TOKEN}) ?$", 1).alias("final"))
        return bind(F.regexp_replace(tail, OMISSION, ""), cut)

    line = F.rtrim(F.try_element_at("prose", F.lit(-1)))
    tail = F.substring_index(line, " ", -TAIL)
    whole = lambda e: F.when((e["final"] == "") & (F.length(tail) < F.length(line)), ending(line)).otherwise(e)
    x = x.select(doc, source, "_form", bind(bind(tail, ending), whole).alias("_e"))
    x = x.select(doc, source, "_form", F.coalesce("_e.omission", F.lit(False)).alias("omission"), F.col("_e.final").alias("final"))
    ends = stage(x, "p3-ends")
    finals = ends.where("final != ''").select("final", "_form").distinct().groupBy("final").agg(F.count(F.lit(1)).alias("terminal"))
    told = _told(finals, counts.where("kind = 'g'").select(F.col("key").alias("gram"), F.col("n").alias("seen")))
    return ends.join(broadcast_if_small(stage(told, "p3-told"), SMALL), "final", "left").select(doc, source, F.coalesce("cut", F.lit(False)).alias("cut"), "omission")


def _once(x: DataFrame, doc: str, text: str) -> DataFrame:
    """x with one row for each text."""
    x = x.where(F.col(text).isNotNull())
    forms = x.select(F.xxhash64(text).alias("_form"), doc).groupBy("_form").agg(F.min(doc).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    forms = broadcast_if_small(stage(forms, "p3-forms"), SMALL)
    once = x.withColumn("_form", F.xxhash64(text)).join(forms, "_form", "left")
    one = once.where(F.col("_n").isNull())
    # of texts delivered more than once, those of the first id; these few are made distinct
    more = once.where(F.col("_n").isNotNull() & F.col(doc).eqNullSafe(F.col("_first"))).dropDuplicates(["_form"])
    return one.unionAll(more)


def _told(finals: DataFrame, seen: DataFrame) -> DataFrame:
    """final, cut: the verdict on each distinct final trigram, so that a hot ending joins as one row."""
    parts = lambda x, c: x.withColumns({"pair": F.regexp_extract(c, f"({TOKEN} ?{TOKEN}) ?$", 1), "kind": _kind(F.col(c))})
    finals, seen = parts(finals, "final"), parts(seen, "gram")
    pairs = finals.groupBy("pair").agg(F.sum("terminal").alias("pair_terminal")).join(seen.groupBy("pair").agg(F.sum("seen").alias("pair_seen")), "pair", "left")
    kinds = finals.groupBy("kind").agg(F.sum("terminal").alias("kind_terminal")).join(seen.groupBy("kind").agg(F.sum("seen").alias("kind_seen")), "kind", "left")
    told = finals.join(seen.select(F.col("gram").alias("final"), "seen"), "final", "left").join(pairs, "pair", "left").join(kinds, "kind", "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    share = lambda c, general: F.when(count(f"{c}seen") - F.col(f"{c}terminal") >= LEAST, (F.col(f"{c}terminal") + PRIOR * general) / (F.col(f"{c}seen") + PRIOR)).otherwise(general)
    kind = F.col("kind_terminal") / F.greatest(count("kind_seen"), F.col("kind_terminal"))
    return told.select("final", (share("", share("pair_", kind)) < TERMINAL).alias("cut"))


def _kind(gram: Column) -> Column:
    """A trigram with each word as w."""
    return F.regexp_replace(gram, rf"[{LETTER}]++", "w")


def _prose(x: DataFrame, other: DataFrame) -> DataFrame:
    """x with prose, its own lines whose opening is not among the other ones."""
    few = [r.open for r in other.limit(FEW_OPENINGS + 1).collect()]
    if len(few) <= FEW_OPENINGS:
        known = F.array(*map(F.lit, few)).cast("array<string>")
        return x.withColumn("prose", F.filter("own", lambda s: ~F.array_contains(known, opening(s)))).drop("own")
    # more openings: lines are joined, and put together again by what they were
    x = x.withColumn("_own", F.xxhash64("own"))
    lines = x.select("_own", F.posexplode("own").alias("_i", "_line")).distinct().withColumn("open", opening(F.col("_line")))
    kept = lines.join(other, "open", "left_anti").groupBy("_own").agg(F.array_sort(F.collect_list(F.struct("_i", "_line"))).alias("_kept"))
    return x.join(kept, "_own", "left").withColumn("prose", F.when(F.col("own").isNotNull(), F.coalesce(F.col("_kept._line"), F.array().cast("array<string>")))).drop("own", "_own", "_kept")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return judged(table(spark, d, "article_feed"), "feed_pos", "source", "summary").where("cut").select("feed_pos")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source delivers truncated summaries, among its rows with a summary."""
    x = table(spark, d, "article_feed")
    j = judged(x, "feed_pos", "source", "summary")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("cut").alias("n_cut"), F.count_if(F.col("cut") & F.col("omission")).alias("n_with_sign"), (F.count_if("cut") / F.count(F.lit(1))).alias("rate"))


QUERIES = {"p3_found": p3_found, "p3_rates": p3_rates}
SQL: dict[str, str] = {}
