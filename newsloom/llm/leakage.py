"""Problem 8: evaluation passages inside training documents.

A document holds a leaked passage if WINDOW consecutive words of an item occur in it in order with at most
EDITS words changed, missing or parted by an added word. Of such a window at least
ceil((WINDOW - EDITS) / (EDITS + 1)) words stand unbroken, so every case shares an unbroken n-gram of that length
(8 words of 25). The set of all item n-grams is broadcast: its size is that of the held-out items, which is
checked against MAX_ITEM_WORDS; more items are worked off in chunks of that size, each one scan.

Documents are scanned in Arrow batches: words unknown to the items become 0, window hashes are computed for
a whole batch at once and looked up in the sorted hash array; only hits are looked at word by word. A hit is
extended to both sides with up to EDITS edits (furthest-reaching, exact), so no case is lost. A changed first or
last word of a window counts as one of its edits, so 25 words with a changed first word are a case.

Defined results: null text and null item text hold nothing; items shorter than WINDOW words never leak; a
document delivered twice gives its rows once, and is cleaned row by row, each by the passages of its own text; an item id with several texts leaks if one of them does;
words are lower-case runs of letters and digits.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.session import ship, table

WINDOW = 25
EDITS = 2
MAX_ITEM_WORDS = 1_000_000
WORD = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def _hashes_at(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the window of n ids from each place on."""
    h = np.zeros(len(at), dtype=np.uint64)
    v = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(29)
    for k in range(n):
        h = h * BASE + v[at + k]
    return h


class Index:
    """Word numbers, item texts as word numbers, and the sorted n-gram hashes of all items with where they stand."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, edits: int = EDITS):
        self.window, self.edits = window, edits
        self.n = -(-(window - edits) // (edits + 1))
        self.words: dict[str, int] = {}
        self.items, h, at = [], [], []
        for item_id, text in items:
            ids = np.array([self.words.setdefault(w, len(self.words) + 1) for w in WORD.findall((text or "").lower())], dtype=np.int64)
            if len(ids) >= window:
                g = _hashes_at(ids, np.arange(len(ids) - self.n + 1), self.n)
                h.append(g)
                at.append(np.stack([np.full(len(g), len(self.items)), np.arange(len(g))], axis=1))
                self.items.append((item_id, ids))
        self.hashes, self.at = (np.concatenate(h), np.concatenate(at)) if h else (np.empty(0, dtype=np.uint64), np.empty((0, 2), dtype=np.int64))
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.at = self.hashes[order], self.at[order]

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item id, first and last word of the passage in the text, words of the item) of each case; one per text and item stretch."""
        ids, starts, get = [], [0], self.words.get
        for t in texts:
            ids += [get(w, 0) for w in WORD.findall((t or "").lower())]
            ids += [0] * self.n  # no window spans two texts
            starts.append(len(ids))
        ids, begins = np.array(ids, dtype=np.int64), np.array(starts)
        # only windows without an unknown word can match
        strange = np.concatenate([[0], np.cumsum(ids == 0)])
        known = np.nonzero(strange[self.n :] == strange[: len(strange) - self.n])[0]
        h = _hashes_at(ids, known, self.n)
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        hits: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        for x in np.nonzero(hi > lo)[0]:
            p = known[x]
            doc = int(np.searchsorted(begins, p, "right")) - 1
            for item, q in self.at[lo[x] : hi[x]]:
                hits[doc, int(item), int(p) - int(q)].append(int(p))
        for (doc, item, shift), places in hits.items():
            words = self.items[item][1]
            text = ids[starts[doc] : starts[doc + 1]]
            done = -1
            for p in places:
                if p <= done:
                    continue
                i = p - starts[doc]
                j = p - shift
                if not np.array_equal(text[i : i + self.n], words[j : j + self.n]):
                    continue
                right = _extend(text[i:], words[j:], self.edits)
                left = _extend(text[:i][::-1], words[:j][::-1], self.edits)
                done = p + right[0][0] - self.n
                # edits not needed inside may stand for changed words at the window's ends, as far as the item goes on there
                options = []
                for a in range(self.edits + 1):
                    for b in range(self.edits + 1 - a):
                        beyond = (len(words) - j - right[a][1]) + (j - left[b][1])
                        options.append((right[a][1] + left[b][1] + min(beyond, self.edits - a - b), -(a + b), i - left[b][0], i + right[a][0] - 1))
                best = max(options)
                if best[0] >= self.window:
                    yield doc, self.items[item][0], best[2], best[3], best[0]


def _extend(text: np.ndarray, words: np.ndarray, edits: int) -> list[tuple[int, int]]:
    """For 0..edits edits: (text words, item words) consumed from the start, most item words first, ending in a match."""
    n, m = len(text), len(words)

    def slide(i: int, j: int) -> tuple[int, int]:
        k = min(n - i, m - j)
        if k <= 0:
            return i, j
        differ = np.nonzero(text[i : i + k] != words[j : j + k])[0]
        k = int(differ[0]) if len(differ) else k
        return i + k, j + k

    first = slide(0, 0)
    reached = {first[0] - first[1]: first}
    out = [first]
    for _ in range(edits):
        new: dict[int, tuple[int, int]] = {}
        for i, j in reached.values():
            for di, dj in ((1, 1), (1, 0), (0, 1)):  # changed, added, missing
                if i + di <= n and j + dj <= m:
                    a, b = slide(i + di, j + dj)
                    if (a, b) != (i + di, j + dj) and (a - b not in new or new[a - b][1] < b):
                        new[a - b] = (a, b)
                    elif a - b not in new:
                        new[a - b] = (a, b)
        reached = new
        ending = [x for x in new.values() if x[0] > 0 and x[1] > 0 and text[x[0] - 1] == words[x[1] - 1]]
        out.append(max([out[-1], *ending], key=lambda x: x[1]))
    return out


def _chunks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    chunk, words = [], 0
    for r in items.where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).select(item_id, text).orderBy(item_id, text).toLocalIterator():
        chunk.append((r[0], r[1]))
        words += len(r[1]) // 2 + 1
        if words > MAX_ITEM_WORDS:
            yield chunk
            chunk, words = [], 0
    if chunk:
        yield chunk


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """doc_id, item_id, first_word, last_word, n_words: the leaked passages of every document."""
    spark, out = docs.sparkSession, None
    schema = f"{doc_id} bigint, {item_id} bigint, first_word int, last_word int, n_words int"
    for chunk in _chunks(items, item_id, item_text):
        held = ship(spark, Index(chunk))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            index = pickle.loads(held.value)
            for pdf in batches:
                ids, texts = pdf.iloc[:, 0].to_numpy(), pdf.iloc[:, 1].tolist()
                rows = [(ids[k], *rest) for k, *rest in index.find(texts)]
                if rows:
                    yield pd.DataFrame(rows, columns=[doc_id, item_id, "first_word", "last_word", "n_words"])

        part = docs.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint"), text).mapInPandas(run, schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _word_spans(t: str) -> list[tuple[int, int]]:
    """Where the words of t.lower() stand in t."""
    low = t.lower()
    if len(low) == len(t):
        return [m.span() for m in WORD.finditer(low)]
    at = [i for i, c in enumerate(t) for _ in c.lower()]  # letters that become two in lower case
    return [(at[m.start()], at[m.end() - 1] + 1) for m in WORD.finditer(low)]


def without_passages(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """doc_id, text, n_passages of every row of docs, its leaked passages taken out from first to last word; found and cut in one pass over the row."""
    x = docs.select(F.col(doc_id).cast("bigint").alias(doc_id), F.col(text).alias(text), F.array().cast("array<bigint>").alias("_spans"))
    schema = f"{doc_id} bigint, {text} string, _spans array<bigint>"
    for chunk in _chunks(items, item_id, item_text):
        held = ship(docs.sparkSession, Index(chunk))

        def find(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            index = pickle.loads(held.value)
            for pdf in batches:
                spans = [list(s) for s in pdf["_spans"]]
                for k, _, first, last, _ in index.find(pdf[text].tolist()):
                    spans[k] += [first, last]
                yield pdf.assign(_spans=spans)

        x = x.mapInPandas(find, schema)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept, gone = [], []
            for t, s in zip(pdf[text], pdf["_spans"]):
                spans = set(zip(s[::2], s[1::2]))
                gone.append(len(spans))
                if not spans:
                    kept.append(t)
                    continue
                at = _word_spans(t)
                parts, end = [], 0
                for a, b in sorted((at[i][0], at[j][1]) for i, j in spans):
                    if a >= end:
                        parts.append(t[end:a])
                    end = max(end, b)
                kept.append("".join([*parts, t[end:]]))
            yield pd.DataFrame({doc_id: pdf[doc_id], text: kept, "n_passages": np.array(gone, dtype=np.int32)})

    return x.mapInPandas(cut, f"{doc_id} bigint, {text} string, n_passages int")


def _p8(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "item_text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _p8(spark, d).select("doc_id", "item_id").distinct()


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """All documents without the leaked passages."""
    return without_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "item_text")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluation item and in how many documents it leaked."""
    hits = p8_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return table(spark, d, "eval_items").select("item_id", "final_label").join(hits, "item_id", "left").select("item_id", "final_label", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


QUERIES = {"p8_found": p8_found, "p8_clean": p8_clean, "p8_items": p8_items}
SQL: dict[str, str] = {}
