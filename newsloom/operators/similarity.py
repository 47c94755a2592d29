"""Similarity joins on token sets, blocked so that no pair of a cross product is formed.

A set of n tokens overlaps (Jaccard) another by t only if they share o = ceil(t n) tokens. In order of frequency, rarest
first, two sets that share at least two tokens share two of their first n - max(o, 2) + 2; so each set is joined on
hashes of every two of these (and, where o is 1, on each of its tokens, for partners that share only one). Within a block a pair is
dropped if its sizes or 64-bit parity signatures rule the overlap out (sets that overlap by t differ in at most (1 - t) / (1 + t) of their tokens); candidates are
verified on the whole sets. Frequencies are counted over both sides; columns that must be equal are part of the
join key. Empty sets match nothing; repeated ids are rows of their own and give repeated pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.functions.text import jaccard, token_set

# The token patterns that define the overlaps.
WORDS4 = "[a-z]{4,}"
WORDS3 = "[a-z]{3,}"
EXTENDED = "[a-z][a-z0-9&.-]{2,}"


def with_tokens(df: DataFrame, text: str, pattern: str = WORDS4, out: str = "tokens") -> DataFrame:
    return df.withColumn(out, token_set(F.col(text), pattern))


def _blocks(df: DataFrame, key: str, df_of: DataFrame, t: float, on: list[str]) -> DataFrame:
    """key, block, n, sig: what a partner must share one of, number of tokens and parity signature."""
    x = df.select(key, *on, F.explode("tokens").alias("token"), F.size("tokens").alias("n")).join(df_of, "token")
    ordered = x.groupBy(key, "n", *on).agg(F.sort_array(F.collect_list(F.struct("df", "token")))["token"].alias("o"))
    least = F.ceil(F.lit(t) * F.col("n") - 1e-9).cast("int")
    lead = F.slice("o", F.lit(1), F.col("n") - F.greatest(least, F.lit(2)) + 2)
    same = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in on]
    twos = F.transform(F.array(lead), lambda w: F.flatten(F.transform(w, lambda a, i: F.transform(F.slice(w, i + 2, F.size(w)), lambda b: F.xxhash64(F.lit(2), a, b, *same)))))[0]
    ones = F.when(least <= 1, F.transform("o", lambda a: F.xxhash64(F.lit(1), a, *same))).otherwise(F.array().cast("array<bigint>"))
    sig = F.aggregate("o", F.lit(0).cast("bigint"), lambda acc, w: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))))
    return ordered.select(key, "n", sig.alias("sig"), F.explode(F.concat(twos, ones)).alias("block"))


def _may(a: str, b: str, t: float) -> str:
    """SQL condition that two blocks' sizes and signatures allow an overlap of t."""
    return f"least({a}.n, {b}.n) >= {t} * greatest({a}.n, {b}.n) - 1e-9 and {1 + t} * bit_count({a}.sig ^ {b}.sig) <= {1 - t} * ({a}.n + {b}.n) + 1e-9"


def _frequencies(*sides: DataFrame) -> DataFrame:
    words = sides[0].select(F.explode("tokens").alias("token"))
    for s in sides[1:]:
        words = words.unionAll(s.select(F.explode("tokens").alias("token")))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def similarity_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, t: float, on: list[str] | None = None) -> DataFrame:
    """left_id, right_id, overlap of all pairs (equal in the columns on, if given) with overlap >= t. Both sides: id, tokens, on."""
    on = on or []
    l, r = left.withColumnsRenamed({left_id: "_l", "tokens": "tokens"}), right.withColumnsRenamed({right_id: "_r", "tokens": "tokens"})
    df_of = _frequencies(l, r)
    cand = _blocks(l, "_l", df_of, t, on).alias("x").join(_blocks(r, "_r", df_of, t, on).alias("y"), F.expr(f"x.block = y.block and {_may('x', 'y', t)}")).select("_l", "_r").distinct()
    ls, rs = l.select("_l", F.col("tokens").alias("_tl"), *[F.col(c).alias(f"_l_{c}") for c in on]), r.select("_r", F.col("tokens").alias("_tr"), *[F.col(c).alias(f"_r_{c}") for c in on])
    x = cand.join(ls, "_l").join(rs, "_r")
    for c in on:
        x = x.where(F.col(f"_l_{c}") == F.col(f"_r_{c}"))
    return x.withColumn("overlap", jaccard(F.col("_tl"), F.col("_tr"))).where(F.col("overlap") >= t - 1e-12).select(F.col("_l").alias(left_id), F.col("_r").alias(right_id), "overlap")


def self_join(df: DataFrame, row_id: str, t: float, on: list[str] | None = None) -> DataFrame:
    """id_a < id_b, overlap of all pairs within df (id, tokens, on)."""
    on = on or []
    x = df.where(F.size("tokens") > 0)
    blocks = _blocks(x, row_id, _frequencies(x), t, on)
    blocks = blocks.withColumnRenamed(row_id, "_id")
    cand = blocks.alias("x").join(blocks.alias("y"), F.expr(f"x.block = y.block and x._id < y._id and {_may('x', 'y', t)}")).select(F.col("x._id").alias("id_a"), F.col("y._id").alias("id_b")).distinct()
    side = lambda k: x.select(F.col(row_id).alias(f"id_{k}"), F.col("tokens").alias(f"_t{k}"), *[F.col(c).alias(f"_{k}_{c}") for c in on])
    both = cand.join(side("a"), "id_a").join(side("b"), "id_b")
    for c in on:
        both = both.where(F.col(f"_a_{c}") == F.col(f"_b_{c}"))
    return both.withColumn("overlap", jaccard(F.col("_ta"), F.col("_tb"))).where(F.col("overlap") >= t - 1e-12).select("id_a", "id_b", "overlap")


def document_frequency(df: DataFrame, text: str, pattern: str = WORDS4) -> DataFrame:
    return with_tokens(df, text, pattern).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def trend_terms(stories: DataFrame, history: DataFrame, row_id: str, text: str, history_text: str) -> DataFrame:
    """row_id, repeated, strong, novel: words of a story that occur in at least two, at least three, no history texts."""
    words = with_tokens(stories, text).select(row_id, F.explode_outer("tokens").alias("token"))
    x = words.join(document_frequency(history, history_text), "token", "left")
    has = F.col("token").isNotNull()
    return x.groupBy(row_id).agg(F.count_if(F.col("df") >= 2).alias("repeated"), F.count_if(F.col("df") >= 3).alias("strong"), F.count_if(has & F.col("df").isNull()).alias("novel"))
