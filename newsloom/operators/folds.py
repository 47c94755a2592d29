"""Order-dependent choices, made in rounds over whole tables instead of one row after another."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from newsloom.session import stage


def first_wins(ids: DataFrame, pairs: DataFrame, row_id: str, keys: DataFrame | None = None) -> DataFrame:
    """row_id, kept: scanning ids upwards, a row is kept if no kept row before it is its partner (pairs id_a < id_b) or has the same key (keys: row_id, key).

    In each round a row is dropped once a partner before it is kept, and kept once all partners before it
    are dropped; rows of one key are partners of each other without being paired: only its first open row may be kept. The rounds needed are the
    longest chain of undecided partners. A pair that repeats, or whose ends are not among the ids, changes nothing; null ids and keys are left out.
    """
    ids = ids.select(F.col(row_id).alias("id")).where("id is not null").distinct()
    pairs = pairs.select("id_a", "id_b").where("id_a < id_b").distinct()
    pairs = stage(pairs.join(ids.select(F.col("id").alias("id_a")), "id_a", "left_semi").join(ids.select(F.col("id").alias("id_b")), "id_b", "left_semi"), "fold-pairs")
    if keys is None:
        group = ids.select("id", F.lit(None).cast("string").alias("key")).limit(0)
    else:
        k = keys.select(F.col(row_id).alias("id"), F.col("key").cast("string").alias("key")).where("id is not null and key is not null").distinct().join(ids, "id", "left_semi")
        many = k.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
        group = stage(k.join(many, "key", "left_semi").select("id", "key"), "fold-keys")
    dropped, open_ = None, pairs
    while open_.limit(1).count() or group.limit(1).count():
        first = group.groupBy("key").agg(F.min("id").alias("first"))
        members = group.join(first, "key")
        # ids without an undecided partner before them are kept in this round
        blocked = open_.select(F.col("id_b").alias("id")).unionAll(members.where("id > first").select("id")).distinct()
        keep = stage(open_.select(F.col("id_a").alias("id")).unionAll(group.select("id")).distinct().join(blocked, "id", "left_anti"), "fold-keep")
        gone = open_.join(keep.select(F.col("id").alias("id_a")), "id_a", "left_semi").select(F.col("id_b").alias("id"))
        gone = stage(gone.unionAll(members.join(keep.select(F.col("id").alias("first")), "first", "left_semi").where("id > first").select("id")).distinct(), "fold-gone")
        dropped = gone if dropped is None else dropped.unionAll(gone)
        decided = keep.unionAll(gone)
        left = open_.join(gone.select(F.col("id").alias("id_b")), "id_b", "left_anti").join(decided.select(F.col("id").alias("id_a")), "id_a", "left_anti")
        open_ = stage(left, "fold-open")
        group = stage(group.join(decided, "id", "left_anti"), "fold-keys")
    if dropped is None:
        return ids.select(F.col("id").alias(row_id), F.lit(True).alias("kept"))
    return ids.join(dropped.distinct().withColumn("_gone", F.lit(True)), "id", "left").select(F.col("id").alias(row_id), F.col("_gone").isNull().alias("kept"))


BOUNDED = 5_000  # candidates of a story that are scanned in one call


def _scanned(c: DataFrame, story: str, publisher: str, tokens: str, most: int, copy: float) -> DataFrame:
    """The accepted candidates of each story, its candidates (all of a story's in one call) looked at in their order."""
    out = [x for x in c.columns if x != "_o"]

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, seen = [], []
        for k, (p, t) in enumerate(zip(pdf[publisher], pdf[tokens])):
            t = set(t) if t is not None else set()
            if all(p != q and (len(t & u) / max(1, len(t | u))) < copy for q, u in seen):
                seen.append((p, t))
                taken.append(k)
                if len(taken) == most:
                    break
        return pdf.iloc[taken][out].assign(accepted=np.arange(1, len(taken) + 1, dtype=np.int32))

    ordered = c.withColumn("_k", F.row_number().over(W.partitionBy(story).orderBy("_o"))).drop("_o")
    schema = T.StructType([f for f in c.schema if f.name != "_o"] + [T.StructField("accepted", T.IntegerType())])
    return ordered.groupBy(story).applyInPandas(lambda pdf: scan(pdf.sort_values("_k")), schema)


def corroborated(cand: DataFrame, story: str, publisher: str, tokens: str, order: list[Column], most: int = 8, copy: float = 0.78) -> DataFrame:
    """The candidates accepted for each story, best first: one for each publisher, none that copies an accepted one's text (overlap >= copy).

    Stories of at most BOUNDED candidates each are scanned one after another. Otherwise each of the at most `most` rounds takes the best candidate of every story by an aggregate among those whose publisher and text are not taken yet, so a
    story with very many candidates is never gathered in one task. order: columns whose smallest struct is the best; they must be unique.
    """
    from newsloom.functions.text import jaccard

    c = stage(cand.where(F.col(publisher).isNotNull()).withColumn("_o", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])), "fold-cand")
    largest = c.groupBy(story).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= BOUNDED:  # every story's candidates fit in one call
        return _scanned(c, story, publisher, tokens, most, copy)
    fields = [F.col(x) for x in c.columns if x != story]
    taken = None  # (story, accepted so far as an array): one small row a story, written once a round; the candidates are written once
    for k in range(most):
        open_ = c
        if taken is not None:
            free = F.forall("_taken", lambda t: (t[publisher] != F.col(publisher)) & (jaccard(F.col(tokens), t[tokens]) < copy))
            open_ = c.join(taken, story).where(free).drop("_taken")
        best = stage(open_.groupBy(story).agg(F.min_by(F.struct(*fields), "_o").alias("b")).select(story, F.array(F.struct(F.lit(k + 1).alias("accepted"), "b.*")).alias("_new")), "fold-best")
        if not best.limit(1).count():
            break
        if taken is None:
            taken = best.withColumnRenamed("_new", "_taken")
        else:
            taken = stage(taken.join(best, story, "left").select(story, F.concat("_taken", F.coalesce("_new", F.slice("_taken", 1, 0))).alias("_taken")), "fold-taken")
    if taken is None:
        return c.withColumn("accepted", F.lit(0)).drop("_o")
    out = taken.select(story, F.explode("_taken").alias("t")).select(story, "t.*")
    return out.select(*[x for x in c.columns if x != "_o"], "accepted")


RUN: int | None = None  # rows of a run beyond which a caller wants it refused; none is by default


class Clusters:
    """The clusters of one run so far: their leaders, sizes and, of each token, the clusters that hold it."""

    def __init__(self) -> None:
        self.leaders: list[int] = []
        self.sizes = np.zeros(1024, dtype=np.int64)
        self.held: dict[str, tuple[np.ndarray, int]] = {}

    def add(self, row: int, tokens: list[str] | None, least: float) -> int:
        """The leader of the row, which is put into its cluster."""
        tokens = set(tokens) if tokens is not None else set()
        found = [x[:n] for x, n in (self.held[w] for w in tokens if w in self.held)]
        c, has = len(self.leaders), ()
        if found:
            shared = np.bincount(np.concatenate(found))
            overlap = shared / (len(tokens) + self.sizes[: len(shared)] - shared)
            best = int(np.argmax(overlap))  # the oldest of equals
            if overlap[best] >= least:
                c, has = best, shared
        if c == len(self.leaders):
            self.leaders.append(row)
            if c == len(self.sizes):
                self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        new = tokens if not len(has) else [w for w in tokens if w not in self.held or not self._holds(w, c)]
        for w in new:
            x, n = self.held.get(w, (np.empty(2, dtype=np.int64), 0))
            if n == len(x):
                x = np.concatenate([x, np.empty_like(x)])
            at = int(np.searchsorted(x[:n], c))
            x[at + 1 : n + 1] = x[at:n].copy()
            x[at] = c
            self.held[w] = x, n + 1
            self.sizes[c] += 1
        return self.leaders[c]

    def _holds(self, word: str, c: int) -> bool:
        x, n = self.held[word]
        at = int(np.searchsorted(x[:n], c))
        return at < n and x[at] == c


def leader_clusters(rows: DataFrame, run: str, row_id: str, tokens: str, least: float = 0.28) -> DataFrame:
    """run, row_id, leader: within each run, its rows taken upwards, a row joins the cluster whose united tokens overlap its own most (at least `least`; ties: the older cluster) or leads a new one.

    Each row depends on all before it, so a run's rows pass through one task in their order; Spark sorts them and the task holds only the clusters, not the
    rows, so a run may have any number of them. Rows without tokens lead clusters of their own; null ids are left out.
    """
    x = rows.where(F.col(row_id).isNotNull()).select(run, F.col(row_id).cast("bigint").alias(row_id), tokens)
    if RUN is not None and (largest := x.groupBy(run).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > RUN:
        raise ValueError(f"a run of {largest} rows; at most {RUN} are clustered")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, clusters = object(), Clusters()
        for pdf in batches:
            out = []
            for r, i, t in zip(pdf["_run"], pdf[row_id], pdf[tokens]):
                if r != now:
                    now, clusters = r, Clusters()
                out.append(clusters.add(i, t, least))
            yield pd.DataFrame({run: pdf[run], row_id: pdf[row_id], "leader": out})

    # a run is told by its text: two nulls, or two NaN, are one
    x = x.withColumn("_run", F.coalesce(F.concat(F.lit("="), F.col(run).cast("string")), F.lit(""))).repartition("_run").sortWithinPartitions("_run", row_id)
    return x.mapInPandas(scan, T.StructType([x.schema[run], x.schema[row_id], T.StructField("leader", T.LongType())]))
