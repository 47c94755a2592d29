"""Problem 7: near-duplicate records, found exactly by pigeonhole blocks of their word-set fingerprints.

A record's fingerprint is the set of its words' hashes, cut into blocks in one order for all records: words in few records first.
Two sets that overlap by t differ in at most d = (1 - t) / (1 + t) * (|A| + |B|) words, so by the pigeonhole
principle the first d + 1 words of either cannot all be missing from the other. The smaller set shares at least s = 2 t / (1 + t) |A|
words, the larger t |B|, and the k-th shared word is among the first |A| - s + k and |B| - s + k. So records are joined on

* each of those first words (k = 1) that at most RARE records hold,
* every two of the words beyond (k = 2), for sets of at most LONG words,
* each of the words beyond, for pairs with a set of more than LONG words.

The first one or two shared words of every pair are a block of both, so no pair is lost. A block of one word has at most RARE
records whatever the input's size. Of the blocks of commoner words only those are made that some record may have as the smaller set
of a pair (few: most sets begin with more rare words than a smaller set may miss); they are marked in MARKS bits, and salted.
Within a block a pair is dropped if its sizes, the words left after the block, or the distance of 128-bit parity signatures (at most
the sets' own distance) rule the overlap out; a sorted block is compared as matrices of its signatures. Longer signatures follow, and
every candidate left is verified by the exact Hamming distance of the two word sets:
overlap >= t  <=>  distance <= (1 - t) / (1 + t) * (|A| + |B|).

The order needs no exact frequencies, only the same for all records: they are counted in a sketch of SKETCH counters,
one pass over all records, which is what is broadcast (4 MB, whatever the input's size).

Identical word sets are one record from the start (named by the hash of the set), so a hot group of copies
costs one record; copies are put back at the end, pair by pair only where the caller asks for pairs.

Defined results: null text is empty text; records without any word pair with nothing; an id that
occurs in several rows counts as one record per distinct word set; empty tables give no pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.functions.text import word_set
from newsloom.session import broadcast_if_small, stage, table

THRESHOLD = 0.7
SCALE = 1_000_000  # thresholds are whole multiples of 1/SCALE
RARE = 5_000  # records that hold a word which is a block of its own
SKETCH = 1 << 20  # counters of words, 4 MB
PIECE = 1 << 14  # counters summed in one row
LONG = 200  # words from which sets have no blocks of two words
HOT = 20_000  # records that hold a word, for each salt of its blocks
SALTS = 64
MARKS = 1 << 25  # bits for blocks of common words, 4 MB
ROWS = 400_000  # rows of sorted blocks compared at once
TILE = 1 << 18  # pairs of a matrix of signatures
BIG = 48  # rows of a block from which it is compared as matrices
SIGNATURES = 4  # of 64 bits each, compared before words are
CHUNK = 2_000  # records whose words are held at once
SMALL = 500_000  # ids of verified records that are broadcast (4 MB); more are joined by a shuffle
WORD = re.compile(r"[^\W_]+")


class Words:
    """64-bit hashes of the distinct words of texts; hashes of words seen before are kept, at most KEEP of them."""

    KEEP = 200_000

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def values(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all texts' distinct words, text after text, and where each text's begin (one more than texts)."""
        seen, find, out, sizes = self.seen, WORD.findall, [], []
        for t in texts:
            words = set(find(t.lower())) if t else ()
            sizes.append(len(words))
            for w in words:
                h = seen.get(w)
                if h is None:
                    if len(seen) >= self.KEEP:
                        seen.clear()
                    h = seen[w] = xxhash.xxh3_64_intdigest(w)
                out.append(h)
        return np.array(out, dtype=np.uint64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def records(self, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, words, starts) of the records that have words, at most CHUNK at a time."""
        for pdf in batches:
            for at in range(0, len(pdf), CHUNK):
                part = pdf.iloc[at : at + CHUNK]
                values, starts = self.values(part["text"].tolist())
                some = np.diff(starts) > 0
                if some.any():
                    yield part["id"].to_numpy()[some], values, np.append(starts[:-1][some], starts[-1])


def _stored(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(same, words, starts) of records that prints stored, each word set once in a task, at most CHUNK at a time."""
    seen: set[int] = set()
    for pdf in batches:
        for at in range(0, len(pdf), CHUNK):
            part = pdf.iloc[at : at + CHUNK].drop_duplicates("same")
            part = part[np.fromiter((h not in seen for h in part["same"].tolist()), bool, len(part))]
            if len(seen) > 500_000:
                seen.clear()
            seen.update(part["same"].tolist())
            if len(part):
                yield part["same"].to_numpy(), np.frombuffer(b"".join(part["words"]), dtype=np.uint64), np.concatenate([[0], np.cumsum(part["n"].to_numpy())]).astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _set_hash(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    at = starts[:-1]
    return _mix(np.add.reduceat(_mix(values), at) ^ np.bitwise_xor.reduceat(_mix(values + np.uint64(1)), at)).view(np.int64)


def _pairs_of(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of every two within each run starts[r] ... starts[r] + counts[r] - 1."""
    first = np.repeat(starts, counts) + _within(counts)
    after = np.repeat(counts, counts) - _within(counts) - 1
    i = np.repeat(first, after)
    return i, i + 1 + _within(after)


def _within(counts: np.ndarray) -> np.ndarray:
    """0 ... n - 1 for each n of counts, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def prints(docs: DataFrame, words: bool = False) -> tuple[DataFrame, np.ndarray]:
    """(id, same (hash of the word set), n, s0 ... (parity signatures), words (their hashes, if asked for) of every record (id, text) that has words; the sketch of word counts)."""
    sig = [f"s{k}" for k in range(SIGNATURES)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SKETCH, dtype=np.int64)
        for ids, values, starts in Words().records(batches):
            counts += np.bincount((values & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            bit = (_mix(values + np.uint64(2)) >> np.uint64(32)) % np.uint64(64 * SIGNATURES)
            of = lambda k: np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == k, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0)), starts[:-1]).view(np.int64)
            yield pd.DataFrame({"id": ids, "same": _set_hash(values, starts), "n": np.diff(starts).astype(np.int32), **{s: of(k) for k, s in enumerate(sig)}, "counts": None, "words": [values[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())] if words else None})
        for at in range(0, SKETCH, PIECE):
            if counts[at : at + PIECE].any():
                yield pd.DataFrame({"id": [at // PIECE], "same": 0, "n": np.array([0], dtype=np.int32), **dict.fromkeys(sig, 0), "counts": [np.minimum(counts[at : at + PIECE], 0x7FFFFFFF).astype(np.int32).tobytes()], "words": None})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, dtype=np.int32).astype(np.int64) for b in pdf["counts"])
        return pd.DataFrame({"id": pdf["id"].iloc[:1], "counts": [np.minimum(total, 0x7FFFFFFF).astype(np.int32).tobytes()]})

    both = stage(docs.mapInPandas(run, "id bigint, same bigint, n int" + "".join(f", {s} bigint" for s in sig) + ", counts binary, words binary"), "p7-prints")
    counts = np.zeros(SKETCH, dtype=np.int32)
    for r in both.where("n = 0").select("id", "counts").groupBy("id").applyInPandas(add, "id bigint, counts binary").collect():  # SKETCH / PIECE rows
        counts[r.id * PIECE : (r.id + 1) * PIECE] = np.frombuffer(r.counts, dtype=np.int32)
    return both.where("n > 0").drop("counts"), counts


def _mark(key: np.ndarray) -> np.ndarray:
    return (key & np.uint64(MARKS - 1)).astype(np.int64)


def _frequencies(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return counts[(values & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.int64)


def _narrow(n: np.ndarray, t: int) -> np.ndarray:
    """Words of a smaller set of n that need not be shared."""
    return n + (-2 * t * n // (SCALE + t))


def _ordered(values: np.ndarray, held: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word, record after record in the order of blocks: record, word, its frequency and place in the record."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((values, (row << 32) | held))
    return row, values[order], held[order], np.arange(len(values)) - starts[row]


def _common(row: np.ndarray, values: np.ndarray, held: np.ndarray, pos: np.ndarray, n: np.ndarray, t: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]]:
    """(record, block, position of its last word, number of its words, frequency) of the blocks without a rare word."""
    wide, rare = n + (-t * n // SCALE), held <= RARE
    # blocks of one common word: long sets, and sets so small that a pair may share a single word
    x = np.flatnonzero((pos <= wide[row]) & ~rare & ((n[row] * SCALE >= t * LONG) | (n[row] <= SCALE // t) & (SCALE // t > 1)))
    yield row[x], _mix(values[x] ^ np.uint64(1)), pos[x], 1, held[x]
    two = np.flatnonzero((pos <= wide[row] + 1) & ~rare & (n[row] <= LONG))
    r, at, count = np.unique(row[two], return_index=True, return_counts=True)
    for c in range(0, len(r), 200):  # records at once
        i, j = _pairs_of(at[c : c + 200], count[c : c + 200])
        i, j = two[i], two[j]
        yield row[i], _mix(_mix(values[i] ^ np.uint64(2)) ^ values[j]), pos[j], 2, held[i]


def marked(values: np.ndarray, starts: np.ndarray, counts: np.ndarray, t: int) -> np.ndarray:
    """Marks of the blocks of common words that a record may have as the smaller set of a pair."""
    n, held = np.diff(starts), _frequencies(values, counts)
    some = np.add.reduceat(held <= RARE, starts[:-1], dtype=np.int64) <= _narrow(n, t)  # rare words come first
    if not some.any():
        return np.zeros(0, dtype=np.int64)
    few, n = np.repeat(some, n), n[some]
    narrow = _narrow(n, t)
    return np.unique(np.concatenate([_mark(block[last < narrow[r] + k]) for r, block, last, k, _ in _common(*_ordered(values[few], held[few], np.concatenate([[0], np.cumsum(n)])), n, t)]))


def cells(values: np.ndarray, starts: np.ndarray, same: np.ndarray, counts: np.ndarray, t: int, marks: np.ndarray) -> pd.DataFrame:
    """block, same, size, sig, sig2 of the records' blocks; record i's words are values[starts[i]:starts[i + 1]], none of them empty. marks: bytes, not 0 where marked() is.

    size: number of words << 32, words in and behind the block << 2, and 1 if the smaller set of a pair may have it, 2 if the larger may.
    """
    n = np.diff(starts)
    bit = _mix(values) >> np.uint64(57)
    half = lambda k: np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == k, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0)), starts[:-1]).view(np.int64)
    sig, sig2 = half(0), half(1)
    narrow = _narrow(n, t)
    row, values, held, pos = _ordered(values, _frequencies(values, counts), starts)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # record, block, size

    def add(r: np.ndarray, block: np.ndarray, last: np.ndarray, k: int, may: np.ndarray) -> None:
        out.append((r, block, (n[r] << 32) + ((n[r] - last - 1 + k) << 2) + may))

    x = np.flatnonzero((pos <= (n + (-t * n // SCALE))[row]) & (held <= RARE))
    add(row[x], values[x], pos[x], 1, (pos[x] < narrow[row[x]] + 1) + 2)
    for r, block, last, k, often in _common(row, values, held, pos, n, t):
        x = np.flatnonzero(marks[_mark(block)])
        r, block, last, salts = r[x], block[x], last[x], np.clip(-(-often[x] // HOT), 1, SALTS)
        lead, one = last < narrow[r] + k, salts == 1
        add(r[one], block[one], last[one], k, lead[one] + 2)
        # of a salted block, the larger set has its own salt and the smaller, of which there are fewer, all
        x = np.flatnonzero(~one)
        add(r[x], _mix(block[x] ^ _mix((same[r[x]] % salts[x]).astype(np.uint64))), last[x], k, np.full(len(x), 2))
        x = np.flatnonzero(~one & lead)
        x, nth = np.repeat(x, salts[x]), _within(salts[x])
        add(r[x], _mix(block[x] ^ _mix(nth.astype(np.uint64))), last[x], k, np.full(len(x), 1))
    r, block, size = (np.concatenate(x) for x in zip(*out))
    return pd.DataFrame({"block": block.view(np.int64), "same": same[r], "size": size, "sig": sig[r], "sig2": sig2[r]})


def candidate_cells(known: DataFrame, counts: np.ndarray, t: int) -> DataFrame:
    """What prints stored -> the records' blocks (see cells), those of equal word sets once in each task."""
    sc = known.sparkSession.sparkContext
    sketch, stored = sc.broadcast(counts), known.select("same", "n", "words")

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, values, starts in _stored(batches):
            yield pd.DataFrame({"mark": marked(values, starts, sketch.value, t)})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "bits": [np.packbits(np.bincount(pdf["mark"] % PIECE, minlength=PIECE) > 0).tobytes()]})

    marks = np.zeros(MARKS // 8, dtype=np.uint8)
    found = stored.mapInPandas(mark, "mark int").distinct().withColumn("piece", F.expr(f"mark div {PIECE}"))
    for r in found.groupBy("piece").applyInPandas(pack, "piece bigint, bits binary").collect():  # at most MARKS / PIECE rows
        marks[r.piece * PIECE // 8 : (r.piece + 1) * PIECE // 8] = np.frombuffer(r.bits, dtype=np.uint8)
    held = sc.broadcast(marks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags = np.unpackbits(held.value)
        for same, values, starts in _stored(batches):
            yield cells(values, starts, same, sketch.value, t, flags)

    return stored.mapInPandas(run, "block bigint, same bigint, size bigint, sig bigint, sig2 bigint")


def block_pairs(block: np.ndarray, same: np.ndarray, size: np.ndarray, sig: np.ndarray, sig2: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """same of the two sets of each pair that is close, in rows of whole blocks sorted by block, size and same."""
    kept = np.ones(len(block), dtype=bool)  # copies of a set once
    kept[1:] = (block[1:] != block[:-1]) | (size[1:] != size[:-1]) | (same[1:] != same[:-1])
    block, same, size, sig, sig2 = block[kept], same[kept], size[kept], sig[kept].view(np.uint64), sig2[kept].view(np.uint64)
    new = np.ones(len(block), dtype=bool)
    new[1:] = block[1:] != block[:-1]
    nth = np.cumsum(new) - 1
    n, room = size >> 32, size >> 2 & 0x3FFFFFFF
    end = np.searchsorted((nth << 32) | n, (nth << 32) | (SCALE * n // t), side="right")  # the last that is not too large
    lead = np.flatnonzero((size & 1 > 0) & (end > np.arange(len(n)) + 1))
    big = np.bincount(nth)[nth[lead]] >= BIG
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        total = n[i] + n[j]
        ok = (j > i) & (j < end[i]) & (size[j] & 2 > 0) & (same[i] != same[j]) & ((SCALE + t) * np.minimum(room[i], room[j]) >= t * total)
        ok[ok] = (SCALE + t) * (np.bitwise_count(sig[i[ok]] ^ sig[j[ok]]).astype(np.int64) + np.bitwise_count(sig2[i[ok]] ^ sig2[j[ok]])) <= (SCALE - t) * total[ok]
        out.append((same[i[ok]], same[j[ok]]))

    x, todo = lead[~big], (end - np.arange(len(n)) - 1)[lead[~big]]
    ends = np.cumsum(todo)
    at = 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4 * TILE, side="right")))
        keep(i := np.repeat(x[at:to], todo[at:to]), i + 1 + _within(todo[at:to]))
        at = to
    # distance <= (1 - t) / t * n of the smaller, whatever the larger's size
    most = np.minimum((SCALE - t) * n // t, 255).astype(np.uint8)
    x = lead[big]
    cut = np.flatnonzero(np.diff(nth[x], prepend=-1, append=-1))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):  # leads of one block
        while a < b:
            last = int(end[x[b - 1]])
            to = min(b, a + max(1, TILE // (last - int(x[a]))))
            rows, first, last = x[a:to], int(x[a]) + 1, int(end[x[to - 1]])
            near = np.bitwise_count(sig[rows, None] ^ sig[None, first:last])
            near += np.bitwise_count(sig2[rows, None] ^ sig2[None, first:last])
            i, j = np.nonzero(near <= most[rows, None])
            if len(i):
                keep(rows[i], j + first)
            a = to
    if not out:
        return same[:0], same[:0]
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def close_pairs(block: DataFrame, t: int) -> DataFrame:
    """a, b (a < b): hashes of word sets that share a block and are close by it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, held, rows, need = ["block", "same", "size", "sig", "sig2"], [], 0, ROWS

        def found(parts: list[np.ndarray]) -> pd.DataFrame:
            a, b = block_pairs(*parts, t)
            return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

        for pdf in batches:
            held.append([pdf[c].to_numpy() for c in names])
            rows += len(pdf)
            if rows >= need:
                parts = [np.concatenate(c) for c in zip(*held)]
                at = int(np.searchsorted(parts[0], parts[0][-1]))  # where the last block, which may go on, begins
                if at:
                    yield found([c[:at] for c in parts])
                held, rows = [[c[at:] for c in parts]], rows - at
                need = max(ROWS, 2 * rows)
        if rows:
            yield found([np.concatenate(c) for c in zip(*held)])

    return block.repartition("block").sortWithinPartitions("block", "size", "same").mapInPandas(run, "a bigint, b bigint").distinct()


def near_pairs(df: DataFrame, row_id: str, text: Column, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(pairs of representatives: a, b, overlap with a < b; membership: id, rep). rep is the smallest id with the same word set."""
    t = round(threshold * SCALE)
    docs = df.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("bigint").alias("id"), text.alias("text"))
    known, counts = prints(docs, words=True)
    near = close_pairs(candidate_cells(known, counts, t), t)
    # longer signatures next: they leave hardly any pair whose words differ by more
    sig = [f"s{k}" for k in range(SIGNATURES)]
    sets = known.groupBy("same").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", *sig)])
    side = lambda c: sets.withColumnsRenamed({"same": c} | {k: f"{c}_{k}" for k in ("id", "n", *sig)})
    differ = " + ".join(f"bit_count(a_{k} ^ b_{k})" for k in sig)
    near = near.join(side("a"), "a").join(side("b"), "b").where(f"{SCALE + t}L * ({differ}) <= {SCALE - t}L * (a_n + b_n)").where("a_id != b_id").select("a_id", "b_id").distinct()
    near = stage(near, "p7-near")
    ends = near.select(F.col("a_id").alias("id")).union(near.select(F.col("b_id").alias("id"))).distinct()
    # an id with several word sets is verified by each of them
    words = stage(docs.join(broadcast_if_small(ends, SMALL), "id", "left_semi").select("id", word_set(F.col("text")).alias("words")), "p7-sets")
    both = near.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).join(words.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(words.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    both = both.withColumn("total", F.size("wa") + F.size("wb")).withColumn("distance", F.col("total") - 2 * F.size(F.array_intersect("wa", "wb"))).drop("wa", "wb")
    # overlap shared / (total - shared) >= t, as the Hamming distance of the sets, total - 2 shared
    pairs = both.where((SCALE + t) * F.col("distance") <= (SCALE - t) * F.col("total")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), ((F.col("total") - F.col("distance")) / (F.col("total") + F.col("distance"))).alias("overlap"))
    members = known.select("id", "same").join(sets.select("same", F.col("id").alias("rep")), "same").select("id", "rep").distinct()
    return pairs, members


def near_duplicates(df: DataFrame, row_id: str, text: Column, threshold: float = THRESHOLD) -> DataFrame:
    """id_a, id_b of all pairs of rows that overlap by at least the threshold, exact copies included."""
    pairs, members = near_pairs(df, row_id, text, threshold)
    left, right = members.select(F.col("rep").alias("a"), F.col("id").alias("i")), members.select(F.col("rep").alias("b"), F.col("id").alias("j"))
    across = pairs.select("a", "b").join(left, "a").join(right, "b").select("i", "j")
    twice = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep")
    copies = members.join(twice, "rep", "left_semi")
    within = copies.select("rep", F.col("id").alias("i")).join(copies.select("rep", F.col("id").alias("j")), "rep").where("i < j").select("i", "j")
    return across.unionAll(within).select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))


def feed_text() -> Column:
    return F.concat_ws(" ", F.col("title"), F.col("summary"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    feed = near_duplicates(table(spark, d, "article_feed").select("feed_pos", "title", "summary"), "feed_pos", feed_text())
    events = near_duplicates(table(spark, d, "news_events").select("event_no", "headline"), "event_no", F.col("headline"))
    return feed.select(F.lit("article_feed").alias("rec_type"), "id_a", "id_b").unionAll(events.select(F.lit("news_events").alias("rec_type"), "id_a", "id_b"))


def groups(df: DataFrame, row_id: str, text: Column, threshold: float = THRESHOLD) -> DataFrame:
    """id, class_id of every record: the smallest id it reaches over near pairs and equal word sets (its own if it has no partner)."""
    pairs, members = near_pairs(df, row_id, text, threshold)
    found = components(pairs.select("a", "b"))
    ids = df.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("bigint").alias("id")).distinct()
    # an id with several word sets ties their classes together
    ties = members.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a != b").select("a", "b")
    if ties.limit(1).count():
        found = components(pairs.select("a", "b").unionAll(ties))
    of = members.groupBy("id").agg(F.min("rep").alias("rep")).join(found.select(F.col("id").alias("rep"), "root"), "rep", "left").select("id", F.coalesce("root", "rep").alias("class_id"))
    return ids.join(of, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))


def components(pairs: DataFrame) -> DataFrame:
    """id, root (smallest id of its component) of every end of the pairs (a, b): labels take the smallest of their neighbours' and then their label's label, until nothing changes."""
    edges = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = stage(edges, "p7-edges")
    label = stage(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "p7-label")
    while True:
        near = edges.join(label.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        low = label.join(near, "id").select("id", F.least("root", "near").alias("low"), "root")
        top = low.join(label.select(F.col("id").alias("low"), F.col("root").alias("top")), "low").select("id", F.least("low", "top").alias("root"), (F.least("low", "top") < F.col("root")).alias("moved"))
        new = stage(top, "p7-label")
        label = new.select("id", "root")
        if not new.where("moved").limit(1).count():
            return label


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every row of both tables with the class of near copies it belongs to."""
    feed = groups(table(spark, d, "article_feed").select("feed_pos", "title", "summary"), "feed_pos", feed_text())
    events = groups(table(spark, d, "news_events").select("event_no", "headline"), "event_no", F.col("headline"))
    return feed.select(F.lit("article_feed").alias("rec_type"), F.col("id").alias("rec_id"), "class_id").unionAll(events.select(F.lit("news_events").alias("rec_type"), F.col("id").alias("rec_id"), "class_id"))


QUERIES = {"p7_found": p7_found, "p7_groups": p7_groups}


def overlap_pairs(rows: str, name: str) -> str:
    """Common table expressions that end in {name}(x, y): all pairs x < y of rows (a query of k, t) whose word sets overlap by 0.7.

    Two such sets share one of the first n - ceil(0.7 n) + 1 words of either in order of rarity.
    """
    return rf"""{name}_f AS (SELECT k, list_distinct(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+')) AS w FROM ({rows}) r), {name}_t AS (SELECT k, len(w) AS n, unnest(w) AS tok FROM {name}_f),
  {name}_d AS (SELECT tok, count(*) AS c FROM {name}_t GROUP BY tok), {name}_l AS (SELECT k, n, list_sort(list(struct_pack(c := c, tok := tok))) AS l FROM {name}_t JOIN {name}_d USING (tok) GROUP BY k, n),
  {name}_p AS (SELECT k, unnest(l[1:n - CAST(ceil(0.7 * n - 1e-9) AS INTEGER) + 1]).tok AS tok FROM {name}_l), {name}_c AS (SELECT DISTINCT a.k AS x, b.k AS y FROM {name}_p a JOIN {name}_p b ON a.tok = b.tok AND a.k < b.k),
  {name} AS (SELECT x, y FROM {name}_c JOIN {name}_f a ON a.k = x JOIN {name}_f b ON b.k = y WHERE 17 * len(list_intersect(a.w, b.w)) >= 7 * (len(a.w) + len(b.w)))"""


_FEED, _EVENTS = "SELECT feed_pos AS k, concat_ws(' ', title, summary) AS t FROM article_feed", "SELECT event_no AS k, coalesce(headline, '') AS t FROM news_events"
SQL = {
    "p7_found": f"""WITH {overlap_pairs(_FEED, 'feed')}, {overlap_pairs(_EVENTS, 'evt')}
  SELECT 'article_feed' AS rec_type, x AS id_a, y AS id_b FROM feed UNION ALL SELECT 'news_events', x, y FROM evt""",
    "p7_groups": f"""WITH RECURSIVE {overlap_pairs(_FEED, 'feed')}, {overlap_pairs(_EVENTS, 'evt')},
  fe AS (SELECT x AS a, y AS b FROM feed UNION SELECT y, x FROM feed), ee AS (SELECT x AS a, y AS b FROM evt UNION SELECT y, x FROM evt),
  fr(id, seen) AS (SELECT a, b FROM fe UNION SELECT r.id, e.b FROM fr r JOIN fe e ON e.a = r.seen), er(id, seen) AS (SELECT a, b FROM ee UNION SELECT r.id, e.b FROM er r JOIN ee e ON e.a = r.seen),
  fc AS (SELECT id, min(seen) AS c FROM fr GROUP BY id), ec AS (SELECT id, min(seen) AS c FROM er GROUP BY id)
  SELECT 'article_feed' AS rec_type, feed_pos AS rec_id, least(coalesce(c, feed_pos), feed_pos) AS class_id FROM article_feed LEFT JOIN fc ON fc.id = feed_pos
  UNION ALL SELECT 'news_events', event_no, least(coalesce(c, event_no), event_no) FROM news_events LEFT JOIN ec ON ec.id = event_no""",
}
