"""Problem 9: mix sources to target shares of tokens.

Sizes are tokens of a public tokenizer. The mix's total is given, or all tokens of its sources counted once. Each
source is allotted its share of the total, but no more than max_repeats times what it holds; what a short source
leaves is shared out among the others in proportion to their targets. A source's allotment is a number of
certain whole copies of each of its documents and a rest. The rest is a fixed-size sample with unequal probabilities, proportional to
size: Pareto order sampling ranks the documents by u / (1 - u) over p / (1 - p), u uniform from a hash of
the document, p its inclusion probability, and takes the first until the rest is filled. Ranking works on
histograms of the rank variable per mix and source; only the bin in which the rest fills up is sorted.

Defined results: documents with null text, null source or no token are left out, as are sources the mix does not
list; a listed source without documents gets nothing and reports 0; an id that occurs twice is one document, the
larger text counting; a target of 0 takes nothing; the reached share differs from the allotted one by less than one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from newsloom.session import stage, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that tokenizer cuts a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BINS = 4096
SEED = 9


def token_counts(docs: DataFrame, doc_id: str, text: str, source: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, n_tokens of each document with a text."""

    with open(tokenizer, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file of about a megabyte; executors need no copy of it

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, held.value.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.iloc[:, 0], "source": pdf.iloc[:, 1], "n_tokens": [len(encode(t)) for t in pdf.iloc[:, 2]]})

    x = docs.where(F.col(text).isNotNull() & F.col(source).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint"), source, text)
    return x.mapInPandas(run, "doc_id bigint, source string, n_tokens bigint").where("n_tokens > 0")


def allot(targets: list[tuple[str, float, int]], held: dict[str, int], total: int | None = None) -> dict[str, float]:
    """Tokens of each source (source, target share, most repeats) that a mix takes, given what each holds."""
    total = sum(held.get(s, 0) for s, _, _ in targets) if total is None else total
    most = {s: held.get(s, 0) * max(0, r) for s, _, r in targets}
    share = {s: max(0.0, t) for s, t, _ in targets}
    out, rest, open_ = dict.fromkeys(share, 0.0), float(total), {s for s in share if share[s] > 0 and most[s] > 0}
    while open_ and rest > 1e-9:
        unit = rest / sum(share[s] for s in open_)
        full = {s for s in open_ if share[s] * unit >= most[s]}
        if not full:
            for s in open_:
                out[s] = share[s] * unit
            break
        for s in full:
            out[s] = float(most[s])
            rest -= most[s]
        open_ -= full
    return out


def mixed(docs: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str = TOKENIZER, seed: int = SEED) -> DataFrame:
    """mix_name, doc_id, source, n_tokens, copies of each document used. docs: doc_id, text, source; targets: mix_name, source, target_share, max_repeats (a small table, read whole)."""
    spark = docs.sparkSession
    wanted = [r for r in targets.collect() if None not in (r.mix_name, r.source, r.target_share)]
    counts = token_counts(docs.where(F.col("source").isin(sorted({r.source for r in wanted}) or [""])), "doc_id", "text", "source", tokenizer)
    sizes = stage(counts.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("m")).select("doc_id", "m.source", "m.n_tokens"), "p9-sizes")
    # sizes by sixteenths of powers of two: at most 64 * 16 bins a source, whatever the number of documents
    bins = sizes.groupBy("source", F.floor(F.log2("n_tokens") * 16).alias("bin")).agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")).collect()
    held: dict[str, int] = {}
    for b in bins:
        held[b.source] = held.get(b.source, 0) + b.tokens
    rows = []
    for mix in sorted({r.mix_name for r in wanted}):
        mine = [(r.source, float(r.target_share), int(r.max_repeats if r.max_repeats is not None else 1)) for r in wanted if r.mix_name == mix]
        for s, tokens in allot(mine, held, total).items():
            if tokens > 0:
                whole = int(tokens // held[s] + 1e-9)
                rest = max(0.0, tokens - whole * held[s])
                rows.append((mix, s, whole, rest, _scale([(b.docs, b.tokens) for b in bins if b.source == s], rest)))
    if not rows:
        return spark.createDataFrame([], "mix_name string, doc_id bigint, source string, n_tokens bigint, copies int")
    plan = spark.createDataFrame(rows, "mix_name string, source string, whole int, rest double, scale double")  # as many rows as targets
    x = sizes.join(F.broadcast(plan), "source")
    u = (F.pmod(F.xxhash64("doc_id", "mix_name", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    p = F.least(F.lit(1.0), F.col("scale") * F.col("n_tokens"))
    # rank / (1 + rank) keeps the order and lies between 0 and 1
    odds = u * (1 - p)
    x = x.withColumn("rank", F.when(p >= 1, u * 1e-6).otherwise(odds / (odds + (1 - u) * p))).withColumn("bin", F.floor(F.col("rank") * BINS))
    hist = x.where("rest > 0").groupBy("mix_name", "source", "bin", "rest").agg(F.sum("n_tokens").alias("n"))
    upto = hist.withColumn("upto", F.sum("n").over(W.partitionBy("mix_name", "source").orderBy("bin")))
    edge = upto.where("upto > rest").groupBy("mix_name", "source").agg(F.min_by(F.struct("bin", (F.col("rest") - F.col("upto") + F.col("n")).alias("room")), "bin").alias("e")).select("mix_name", "source", F.col("e.bin").alias("edge"), F.col("e.room").alias("room"))
    x = x.join(edge, ["mix_name", "source"], "left")
    border = x.where("bin = edge").withColumn("sum", F.sum("n_tokens").over(W.partitionBy("mix_name", "source").orderBy("rank", "doc_id").rowsBetween(W.unboundedPreceding, 0))).withColumn("more", (F.col("sum") <= F.col("room")).cast("int"))
    others = x.where("edge is null or bin != edge").withColumn("more", F.when(F.col("rest") > 0, (F.col("edge").isNull() | (F.col("bin") < F.col("edge"))).cast("int")).otherwise(0))
    cols = ["mix_name", "doc_id", "source", "n_tokens", (F.col("whole") + F.col("more")).cast("int").alias("copies")]
    return border.select(cols).unionAll(others.select(cols)).where("copies > 0")


def _scale(bins: list[tuple[int, int]], rest: float) -> float:
    """c with sum of min(1, c n) n = rest over documents of sizes n, by bisection over the size bins."""
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(1.0, mid * t / d) * t for d, t in bins) < rest else (lo, mid)
    return hi


def reached(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Every target with the share reached."""
    got = mix.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("most_copies"))
    x = targets.join(got, ["mix_name", "source"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_tokens", "n_docs", "most_copies")})
    whole = F.sum("n_tokens").over(W.partitionBy("mix_name"))
    return x.withColumn("share", F.when(whole > 0, F.col("n_tokens") / whole).otherwise(0.0)).select("mix_name", "source", "target_share", "max_repeats", "share", "n_tokens", "n_docs", "most_copies")


def _mix(spark: SparkSession, d: str) -> DataFrame:
    return mixed(table(spark, d, "documents").select("doc_id", "text", "source"), table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each mix with their copies, and beside them the share of all tokens their source reached."""
    mix = stage(_mix(spark, d), "p9-mix")
    shares = reached(mix, table(spark, d, "mix_targets")).select("mix_name", "source", "target_share", "share")
    return mix.join(F.broadcast(shares), ["mix_name", "source"])  # as many rows as targets


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return reached(_mix(spark, d), table(spark, d, "mix_targets"))


def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Each mix and its uses that break a rule: documents used too often, twice in the list, or of sources the mix does not list; sources beyond their share by more than a document."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    mix = stage(_mix(spark, d), "p9-mix").join(F.broadcast(targets.select("mix_name", "source", "max_repeats", "target_share", F.lit(True).alias("listed"))), ["mix_name", "source"], "left")  # as many rows as targets
    real = mix.join(docs.select("doc_id", F.col("source").alias("held")).distinct(), "doc_id", "left")
    per = real.groupBy("mix_name", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("copies") > F.col("max_repeats")).alias("over"), F.max(F.col("listed").isNull() | ~F.col("source").eqNullSafe(F.col("held"))).alias("strange"))
    bad = per.groupBy("mix_name").agg(F.count_if("over").alias("over_repeated"), F.count_if(F.col("n") > 1).alias("listed_twice"), F.count_if("strange").alias("unlisted"))
    # a source may be short where it holds too little, but then every document is used as often as allowed
    sums = mix.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("n_tokens").alias("longest"), F.min(F.col("copies") >= F.col("max_repeats")).alias("full"), F.max("target_share").alias("target"))
    unit = sums.where("not full").groupBy("mix_name").agg((F.sum("tokens") / F.sum("target")).alias("unit"), F.max("longest").alias("most"), F.count(F.lit(1)).alias("open"))
    off = sums.where("not full").join(F.broadcast(unit), "mix_name").groupBy("mix_name").agg(F.count_if(F.abs(F.col("tokens") - F.col("unit") * F.col("target")) > F.col("most") * F.col("open")).alias("off_share"))
    out = targets.select("mix_name").distinct().join(bad, "mix_name", "left").join(off, "mix_name", "left")
    return out.select("mix_name", *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("over_repeated", "listed_twice", "unlisted", "off_share")])


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares, "p9_invariants": p9_invariants}
SQL = {"p9_invariants": "SELECT DISTINCT mix_name, 0 AS over_repeated, 0 AS listed_twice, 0 AS unlisted, 0 AS off_share FROM mix_targets"}
