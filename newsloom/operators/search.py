"""Searches: a stated set of queries held against every row by shared tokens, in one pass over the rows.

Queries are read in chunks of at most CHUNK sets and broadcast as an inverted index; each chunk is one scan. Rows
are worked off one by one: the sets that share tokens with a row are counted by one pass over the lists of its tokens, so no
pair without a shared token is formed. At most FLUSH pairs are held at once: they are passed on, or only each query's best so far are
kept, which further pairs must reach; of these a task passes on `most` a query. Nothing else is shuffled.

Defined results: empty or null token sets match nothing; repeated ids are rows of their own; no queries or no rows give no result.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from newsloom.session import ship

CHUNK = 20_000
FLUSH = 200_000


class Sets:
    """Token sets by number, and of each token the sets that hold it."""

    def __init__(self, rows: list[tuple[int, list[str], str]]):
        self.ids = np.array([r[0] for r in rows], dtype=np.int64)
        self.marks = [r[2] for r in rows]
        self.sizes = np.array([len(r[1]) for r in rows], dtype=np.int64)
        lists = defaultdict(list)
        for k, (_, tokens, _) in enumerate(rows):
            for t in tokens:
                lists[t].append(k)
        self.lists = {t: np.array(v, dtype=np.int64) for t, v in lists.items()}

    def shared(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sets that share a token with these, how many they share)."""
        found = [x for t in tokens if (x := self.lists.get(t)) is not None]
        if not found:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        n = np.bincount(np.concatenate(found), minlength=len(self.ids))
        at = np.flatnonzero(n)
        return at, n[at]


def _chunks(queries: DataFrame, q: str, mark: str | None) -> Iterator[list]:
    chunk = []
    for r in queries.where(F.col(q).isNotNull() & (F.size("tokens") > 0)).select(q, "tokens", (F.col(mark) if mark else F.lit("")).alias("_m")).orderBy(q).toLocalIterator():
        chunk.append((r[0], r[1], r[2] or ""))
        if len(chunk) >= CHUNK:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def _frame(sets: Sets, hits: list[tuple]) -> pd.DataFrame:
    """k (number of the query), q, r, shared, overlap, at of hits."""
    size, k = [len(h[0]) for h in hits], np.concatenate([h[0] for h in hits])
    return pd.DataFrame({"k": k, "q": sets.ids[k], "r": np.repeat([h[1] for h in hits], size), "shared": np.concatenate([h[2] for h in hits]).astype(np.int32), "overlap": np.concatenate([h[3] for h in hits]), "at": np.repeat(np.array([h[4] for h in hits], dtype=object), size)})


class _Best:
    """The best `most` hits of each query so far, and what a further hit must reach to be among them."""

    def __init__(self, sets: Sets, most: int | None, order: list[str]):
        self.most, self.order, self.rows = most, order, None
        self.ids, self.of = np.unique(sets.ids, return_inverse=True)  # a repeated id is one query with several sets
        self.least, self.last = np.full(len(self.ids), -np.inf), np.zeros(len(self.ids), dtype=np.int64)

    def may(self, k: np.ndarray, value: np.ndarray, row: int) -> np.ndarray:
        """Whether hits of the sets k with these values of the first column of the order may be among the best."""
        q = self.of[k]
        return (value > self.least[q]) | (value == self.least[q]) & ((row <= self.last[q]) if self.order[1:] == ["r"] else True)

    def add(self, hits: pd.DataFrame) -> None:
        x = hits if self.rows is None else pd.concat([self.rows, hits])
        x = x.sort_values(["q", *self.order], ascending=[True, *(c in ("at", "r") for c in self.order)], kind="stable")
        nth = x.groupby("q", sort=False).cumcount()
        full = x[nth == self.most - 1]
        if self.order[0] in ("shared", "overlap"):
            at = np.searchsorted(self.ids, full["q"])
            self.least[at], self.last[at] = full[self.order[0]], full["r"]
        self.rows = x[nth < self.most]


def search(queries: DataFrame, rows: DataFrame, q: str, r: str, least: float, shared: int = 1, most: int | None = None, order: list[str] | None = None, before: str | None = None, at: str | None = None) -> DataFrame:
    """q, r, shared, overlap (and at) of the rows (r, tokens) that overlap each query (q, tokens) by least and share at least `shared` tokens; of each query the best `most`.

    order: of shared and overlap (descending), at and r (ascending), what makes the best; before: only rows whose text `at` is empty or below the query's text `before`.
    """
    spark, order, out = queries.sparkSession, order or ["overlap", "r"], None
    rising = [c in ("at", "r") for c in order]
    for chunk in _chunks(queries, q, before):
        held = ship(spark, Sets(chunk))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            sets = pickle.loads(held.value)
            best, hits, n_hits = _Best(sets, most, order), [], 0
            for pdf in batches:
                for i, tokens, mark in zip(pdf["r"], pdf["tokens"], pdf["at"]):
                    k, n = sets.shared(tokens)
                    if len(k):
                        overlap = n / (sets.sizes[k] + len(tokens) - n)
                        fits = (n >= shared) & (overlap >= least) & (overlap > 0)
                        if most is not None:
                            fits &= best.may(k, n if order[0] == "shared" else overlap, i)
                        k, n, overlap = k[fits], n[fits], overlap[fits]
                        if before and mark and len(k):
                            fits = np.fromiter((mark < sets.marks[x] for x in k.tolist()), bool, len(k))
                            k, n, overlap = k[fits], n[fits], overlap[fits]
                        if len(k):
                            hits.append((k, i, n, overlap, mark))
                            n_hits += len(k)
                    if n_hits >= FLUSH:
                        if most is None:
                            yield _frame(sets, hits).drop(columns="k")
                        else:
                            best.add(_frame(sets, hits))
                        hits, n_hits = [], 0
            if hits and most is None:
                yield _frame(sets, hits).drop(columns="k")
            elif most is not None:
                if hits:
                    best.add(_frame(sets, hits))
                if best.rows is not None:
                    yield best.rows.drop(columns="k")

        x = rows.where(F.col(r).isNotNull() & (F.size("tokens") > 0)).select(F.col(r).cast("bigint").alias("r"), "tokens", F.coalesce(F.col(at) if at else F.lit(""), F.lit("")).alias("at"))
        part = x.mapInPandas(run, "q bigint, r bigint, shared int, overlap double, at string")
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = spark.createDataFrame([], "q bigint, r bigint, shared int, overlap double, at string")
    if most is not None:
        w = W.partitionBy("q").orderBy(*[F.asc(c) if up else F.desc(c) for c, up in zip(order, rising)])  # at most `most` rows a task and query
        out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return out.withColumnsRenamed({"q": q, "r": r})


def greatest_overlap(rows: DataFrame, r: str, bounded: DataFrame) -> DataFrame:
    """r, best: each row's (r, tokens) greatest overlap with the sets of a bounded table (id, tokens; the caller limits it); 0 if it shares nothing."""
    sets = Sets([(i, x.tokens, "") for i, x in enumerate(bounded.select("tokens").where(F.size("tokens") > 0).collect())])
    held = ship(rows.sparkSession, sets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = pickle.loads(held.value)
        for pdf in batches:
            best = []
            for tokens in pdf["tokens"]:
                k, n = sets.shared(tokens)
                best.append(float((n / (sets.sizes[k] + len(tokens) - n)).max()) if len(k) else 0.0)
            yield pd.DataFrame({"r": pdf["r"], "best": best})

    return rows.select(F.col(r).cast("bigint").alias("r"), "tokens").mapInPandas(run, "r bigint, best double").withColumnRenamed("r", r)
