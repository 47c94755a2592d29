"""Problem 5: lines repeated across one site's documents.

Lines are the same if they agree apart from letter case, spacing and the length and value of digit runs.
Each line's documents are a bitmap over the document numbers, compressed by keeping only its non-zero
64-bit words, one row (source, line, word number, bits). Variant spellings of a line share a key, so their
bitmaps unite by bit_or, before and after the shuffle; the exact cardinality is the sum of bit_count over the words. A
hot source or line is spread over its words. Deleting is a lookup of a document's bit in the bitmaps of
the lines that pass the threshold; other lines, blank ones included, stay as they are.

Defined results: null text and null source give nothing; empty and blank lines are never cases; a line that
stands twice in one document counts once towards the threshold and both occurrences are cases; a document
number delivered in several rows is one document; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.session import stage, table

MIN_ROWS = 6
BROADCAST_KEYS = 200_000


def line_key(line: Column) -> Column:
    """64-bit key of what must agree; null for a line without any visible sign."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(line), r"[\s\p{Z}]+", ""), r"\p{Nd}+", "0")
    return F.when(bare != "", F.xxhash64(bare))


def keyed_lines(text: Column) -> Column:
    """array<struct<line_no, key>> of a text's lines, blank lines left out."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line_no"), line_key(x).alias("key")))
    return F.filter(lines, lambda x: x["key"].isNotNull())


def _lines(df: DataFrame, doc: str, source: str, text: str) -> DataFrame:
    """source, doc, form (hash of the whole text), line_no, key of each line that is not blank; written once, so that texts are normalised once."""
    x = df.where(F.col(source).isNotNull() & F.col(doc).isNotNull()).select(F.col(source).alias("source"), F.col(doc).cast("bigint").alias("doc"), F.xxhash64(text).alias("form"), F.explode(keyed_lines(F.col(text))).alias("line"))
    return stage(x.select("source", "doc", "form", "line.line_no", "line.key"), "p5-lines")


def line_bitmaps(lines: DataFrame, min_docs: int = MIN_ROWS) -> DataFrame:
    """source, key, word, bits of every line found in at least min_docs documents of its source."""
    words = _words(lines)
    return words.join(_passing(words, min_docs).select("source", "key"), ["source", "key"], "left_semi")


def _words(lines: DataFrame) -> DataFrame:
    return lines.groupBy("source", "key", F.shiftright("doc", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(doc & 63 as int))")).alias("bits"))


def _passing(words: DataFrame, min_docs: int) -> DataFrame:
    return words.groupBy("source", "key").agg(F.sum(F.bit_count("bits")).alias("docs")).where(F.col("docs") >= min_docs)


def _hits(lines: DataFrame, min_docs: int) -> DataFrame:
    """The lines whose document's bit is set in the bitmap of a repeated line."""
    maps = line_bitmaps(lines, min_docs)
    return lines.withColumn("word", F.shiftright("doc", 6)).join(maps, ["source", "key", "word"]).where(F.expr("(bits & shiftleft(1L, cast(doc & 63 as int))) != 0"))


def repeated_lines(df: DataFrame, doc: str, source: str, text: str, min_docs: int = MIN_ROWS) -> DataFrame:
    """doc, line_no of every occurrence of a repeated line."""
    return _hits(_lines(df, doc, source, text), min_docs).select(F.col("doc").alias(doc), F.col("line_no").cast("bigint").alias("line_no"))


def without_repeated(df: DataFrame, doc: str, source: str, text: str, out: str, min_docs: int = MIN_ROWS) -> DataFrame:
    """df plus out: the lines of text that are not repeated in their source, blank ones kept (array<string>; null text gives null)."""
    gone = _hits(_lines(df, doc, source, text), min_docs).groupBy(F.col("source").alias("_s"), F.col("doc").alias("_d"), F.col("form").alias("_f")).agg(F.collect_set("line_no").alias("_gone"))  # at most a text's lines
    x = df.withColumns({"_doc": F.col(doc).cast("bigint"), "_form": F.xxhash64(text)})
    x = x.join(gone, (F.col(source) == F.col("_s")) & (F.col("_doc") == F.col("_d")) & (F.col("_form") == F.col("_f")), "left")
    return x.withColumn(out, F.filter(F.split(text, "\n"), lambda s, i: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<int>")), i))).drop("_doc", "_form", "_s", "_d", "_f", "_gone")


def own_lines(df: DataFrame, doc: str, source: str, text: str, out: str, min_docs: int = MIN_ROWS) -> DataFrame:
    """df plus out: the lines of text that are neither blank nor repeated in their source (array<string>; null text gives null)."""
    keys = stage(_passing(_words(_lines(df, doc, source, text)), min_docs).select("source", "key"), "p5-keys")
    if keys.limit(BROADCAST_KEYS + 1).count() > BROADCAST_KEYS:  # at most about 2 MB are broadcast
        return without_repeated(df, doc, source, text, out, min_docs).withColumn(out, F.filter(out, lambda s: line_key(s).isNotNull()))
    known = keys.groupBy("source").agg(F.collect_list("key").alias("_rl_keys")).withColumnRenamed("source", "_rl_source")
    x = df.join(F.broadcast(known), df[source] == known["_rl_source"], "left").drop("_rl_source")
    none = F.coalesce("_rl_keys", F.array().cast("array<bigint>"))
    keyed = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), line_key(x).alias("key")))
    own = F.filter(keyed, lambda x: x["key"].isNotNull() & ~F.array_contains(none, x["key"]))["line"]
    return x.withColumn(out, own).drop("_rl_keys")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines(table(spark, d, "article_feed").select("feed_pos", "source", "summary"), "feed_pos", "source", "summary")


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every summary without its source's repeated lines."""
    x = without_repeated(table(spark, d, "article_feed").select("feed_pos", "source", "summary"), "feed_pos", "source", "summary", "own")
    return x.select("feed_pos", F.array_join("own", "\n").alias("summary"))


QUERIES = {"p5_found": p5_found, "p5_clean": p5_clean}
_LINES = r"""SELECT feed_pos, source, i - 1 AS line_no, l AS line,
    regexp_replace(regexp_replace(lower(l), '[\s\p{Z}]+', '', 'g'), '\p{Nd}+', '0', 'g') AS key
  FROM (SELECT feed_pos, source, unnest(string_split(summary, chr(10))) AS l, generate_subscripts(string_split(summary, chr(10)), 1) AS i
        FROM article_feed WHERE summary IS NOT NULL) t"""
_HOT = f"SELECT source, key FROM ({_LINES}) k WHERE key <> '' AND source IS NOT NULL GROUP BY source, key HAVING count(DISTINCT feed_pos) >= 6"
SQL = {
    "p5_found": f"SELECT k.feed_pos, CAST(k.line_no AS BIGINT) AS line_no FROM ({_LINES}) k JOIN ({_HOT}) h ON k.source = h.source AND k.key = h.key",
    "p5_clean": f"""SELECT a.feed_pos, CASE WHEN a.summary IS NULL THEN NULL ELSE coalesce(o.summary, '') END AS summary FROM article_feed a LEFT JOIN (
  SELECT k.feed_pos, string_agg(k.line, chr(10) ORDER BY k.line_no) AS summary FROM ({_LINES}) k LEFT JOIN ({_HOT}) h ON k.source = h.source AND k.key = h.key
  WHERE h.key IS NULL GROUP BY k.feed_pos) o ON o.feed_pos = a.feed_pos""",
}
