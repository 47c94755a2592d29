"""Problem 10: text decoded with the wrong character encoding.

A chain undoes one wrong decoding: encode with the wrong encoding, decode with the right one. Every chain
gives a candidate text; the candidate with the least description length is chosen, that is its size after
compression with a zstandard dictionary of the text's language, plus ESCAPE bytes for each sign that the language
hardly uses and COST bytes per chain step. If no
candidate is shorter than the text as it is, the text stays. Chains are applied step by step, so text
decoded wrongly twice, or by two ways in two places, comes out too.

Chains that end in UTF-8 change only runs of non-ASCII characters whose bytes are valid UTF-8; chains between two
one-byte encodings change only words that hold characters unusual in the language and become usual by it.

The dictionaries and the usual characters of each language come from counts over all labelled documents and their whole
texts, each text once however many copies (its numbers aside) there are: in how many texts a character stands, and how often each word
and, where signs are, each three words; a dictionary holds the DICTIONARY bytes of them that would save most, of those without an unusual character;
signs in runs that some encoding turns into UTF-8 are no evidence of being usual. Only documents with a sign unusual in their language (control and replacement characters are), with a run that
could be UTF-8 read in a Western encoding, or with the case of Cyrillic words turned are compressed; the rest have no candidate chain that could apply.

Defined results: null, empty and plain ASCII texts are unchanged and never affected; text without a language, or
with one that no clean word is labelled with, is held against every language; characters lost for good (U+FFFD, or wrong
sequences that no chain undoes) mark the document as affected and stay; a document id delivered twice gives a row each time
in the operator and one in p10_found.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import compress, filterfalse
from operator import not_

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from newsloom.session import ship, stage, table

USUAL = 0.08  # share of a language's texts that hold a usual character
COST = 3
ESCAPE = 4  # bytes for a sign outside the language's usual ones
DICTIONARY = 48_000
LEAST = 4  # bytes of a piece in a dictionary
OFTEN = 3  # times that a piece is found whose score may bound those of a dictionary
HELD = 400_000  # distinct pieces counted in a task before the counts are handed on
KNOWN = 20_000  # decoded sequences held
UNKNOWN = ("", "und", "unk", "mul", "zxx")
# Encodings that texts are read in by mistake, and pairs of one-byte encodings, read as and written in.
READ_AS = ["cp1252", "latin_1", "mac_roman", "cp1251", "cp850", "cp437", "koi8_r", "cp866", "cp1250", "iso8859_15", "cp1254"]
ONE_BYTE = [
    ("cp850", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1250", "cp1252"), ("cp1252", "cp1251"), ("latin_1", "cp1251"),
    ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp850", "cp1251"), ("cp1251", "koi8_r"), ("cp1252", "koi8_r"), ("latin_1", "koi8_r"),
    ("cp1251", "cp866"), ("cp1252", "cp866"), ("cp437", "cp866"), ("cp1252", "cp1250"), ("latin_1", "cp1250"),
]
# .!?;: and perhaps a quotation mark before spaces, line breaks, or a comma and a space; begins with one class of signs, so that a search skips all others at once
PIECE = re.compile(r"([.!?;:\n,](?:(?<=[.!?;:])[”\"»]?\s+|(?<=\n)\n*|(?<=,) ))")
WORD = re.compile(r"\S+")
PART = re.compile(r"\S{1,16}\s?")
DIGITS = re.compile(r"\d+")
ASCII = bytes(range(128))
ZEROS = bytes.maketrans(b"123456789", b"000000000")
BELOW = re.compile("[\x00-\x1f]")
CONTROL = re.compile("[\x80-\x9f]")
# UTF-8 lead characters of Latin text and three-byte signs, read as cp1252 or latin-1, with what may follow
SEQUENCE = re.compile("[ÂÃÄÅ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘-”•–—˜™š›œžŸ]|â[\x80-\x8f€‚ˆ„]")
LONE = re.compile("(?<=[a-z])[ÃÂ](?![A-ZÀ-Þ])")
CAPITALS = frozenset(map(chr, range(ord("А"), ord("Я") + 1)))
TURNED_CASE = re.compile("(?<![Ѐ-ӿ])[а-я][А-Я]{2}|[А-Я][а-я][А-Я]{2}")


def _tables(name: str) -> tuple[dict[str, int], list[str]]:
    """Character to byte and byte to character; bytes that the encoding lacks stand for the control of that number."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return {c: b for b, c in reversed(list(enumerate(chars)))}, chars


def _class(signs: frozenset[str] | set[str]) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(signs)) + "]"


def _utf8_runs(names: list[str]) -> tuple[frozenset[str], frozenset[str], re.Pattern]:
    """Signs that lead a UTF-8 sequence of two or three bytes in one of the encodings, signs that continue one, and what such a sequence looks like."""
    tables = [_tables(n)[1] for n in names]
    of = lambda a, b: frozenset(c for chars in tables for c in chars[a : b + 1])
    two, three, more = of(0xC2, 0xDF), of(0xE0, 0xF4), of(0x80, 0xBF)
    # begins with one class of signs, so that a search skips all others at once
    return two | three, more, re.compile(f"{_class(two | three)}(?:(?<={_class(two)}){_class(more)}|(?<={_class(three)}){_class(more)}{{2}})")


# of encodings in which right text hardly ever forms such a run
LEADS, FOLLOWERS, UTF8_RUN = _utf8_runs(["cp1252", "latin_1", "cp1250", "iso8859_15", "cp1254"])


def _signs(text: str) -> str:
    """The non-ASCII characters of text, in their order."""
    return text.encode("utf-8", "surrogatepass").translate(None, ASCII).decode("utf-8", "surrogatepass")


def _may_run(text: str, signs: set[str]) -> bool:
    return not LEADS.isdisjoint(signs) and not FOLLOWERS.isdisjoint(signs) and UTF8_RUN.search(text) is not None


def _may_be_turned(text: str, signs: set[str]) -> bool:
    return not CAPITALS.isdisjoint(signs) and TURNED_CASE.search(text) is not None


class Utf8:
    """Turns valid UTF-8 sequences in text that was read in an encoding; a run may hold right characters beside wrong ones."""

    def __init__(self, name: str):
        self.to = {c: b for c, b in _tables(name)[0].items() if b >= 0x80}
        self.length = {c: 2 if b <= 0xDF else 3 if b <= 0xEF else 4 for c, b in self.to.items() if 0xC2 <= b <= 0xF4}
        self.leads, self.followers = frozenset(self.length), frozenset(c for c, b in self.to.items() if b <= 0xBF)
        self.known: dict[str, str] = {}  # sequences decoded so far
        self.sequence = re.compile(f"{_class(self.leads)}{_class(self.followers)}{{1,3}}")

    def turn(self, text: str, signs: set[str]) -> str:
        """signs: the non-ASCII characters of text."""
        return text if self.leads.isdisjoint(signs) or self.followers.isdisjoint(signs) else self.sequence.sub(self._decoded, text)

    def _decoded(self, found: re.Match) -> str:
        x = found.group()
        if (new := self.known.get(x)) is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            new = self.known[x] = self._decode(x)
        return new

    def _decode(self, x: str) -> str:
        k = self.length[x[0]]
        if len(x) < k:
            return x
        try:
            return bytes(map(self.to.__getitem__, x[:k])).decode("utf-8") + x[k:]
        except UnicodeDecodeError:
            return x


class Bytes:
    """Turns words written in one one-byte encoding and read in another, if they consist of usual signs and printable ASCII afterwards."""

    def __init__(self, name: str, right: str, usual: frozenset[str]):
        to, back = _tables(name)[0], _tables(right)[1]
        new = {c: back[b] for c, b in to.items() if c > "\x7f"}
        self.new = str.maketrans({c: x for c, x in new.items() if "\x1f" < x <= "\x7f" or x in usual})
        self.signs = frozenset(map(chr, self.new))

    def turn(self, text: str, signs: set[str], words: list[tuple[int, str, set[str]]]) -> str:
        """signs: the non-ASCII characters of text; words: where those that may turn begin, what they are and their non-ASCII characters."""
        if self.signs.isdisjoint(signs):
            return text
        out, at = [], 0
        for start, old, held in words:
            if self.signs.issuperset(held) and (new := old.translate(self.new)) != old:
                out += (text[at:start], new)
                at = start + len(old)
        return "".join(out) + text[at:] if out else text


def _one_number(text: str, signs: set[str]) -> str:
    """text with a zero for every number; signs: its non-ASCII characters."""
    if any(map(str.isdecimal, signs)):
        return DIGITS.sub("0", text)
    raw = text.encode("utf-8", "surrogatepass").translate(ZEROS)
    while b"00" in raw:
        raw = raw.replace(b"00", b"0")
    return raw.decode("utf-8", "surrogatepass")


def tally(counts: dict[tuple[str, str], Counter], lang: str, text: str) -> None:
    """Adds the text to counts[lang, kind]: its kinds are "text", "sign" (texts that hold it) and "piece"."""
    counts[lang, "text"][""] += 1
    signs, pieces = set(_signs(text)), counts[lang, "piece"]
    parts = PART.findall(_one_number(text, signs))
    pieces.update(parts)
    if not signs:
        return
    counts[lang, "sign"].update(set(_signs(UTF8_RUN.sub(" ", text))) if _may_run(text, signs) else signs)
    held = list(compress(range(len(parts)), map(not_, map(str.isascii, parts))))
    if 4 * len(held) > len(parts):
        pieces.update(filterfalse(str.isascii, map("".join, zip(parts, parts[1:], parts[2:]))))
        return
    at, last = [], -1  # where three parts with a sign among them begin
    for i in held:
        at += range(max(last + 1, i - 2), i + 1)
        last = i
    pieces.update([parts[i] + parts[i + 1] + parts[i + 2] for i in at if i < len(parts) - 2])


def usual_signs(signs: dict[str, int], texts: int) -> frozenset[str]:
    return frozenset(c for c, n in signs.items() if n >= max(2, USUAL * texts) and not "\x80" <= c <= "\x9f" and c != "�")


class Model:
    """Usual characters and a compressor for each language; fitted on (language, text) pairs, or see of()."""

    def __init__(self, texts: list[tuple[str, str]]):
        counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        for lang, text in texts:
            tally(counts, lang, text)
        usual = {k: usual_signs(counts[k, "sign"], counts[k, "text"][""]) for k in {k for k, _ in texts}}
        pieces = {k: {x: n for x, n in counts[k, "piece"].items() if len(x.encode()) >= LEAST and all(c <= "\x7f" or c in u for c in x)} for k, u in usual.items()}
        self._set(usual, {k: sorted(of, key=lambda x: (-of[x] * (len(x.encode()) - 2), x.encode())) for k, of in pieces.items()})

    @classmethod
    def of(cls, usual: dict[str, frozenset[str]], pieces: dict[str, list[str]]) -> Model:
        """pieces: of each language, the best first."""
        m = cls([])
        m._set(usual, pieces)
        return m

    def _set(self, usual: dict[str, frozenset[str]], pieces: dict[str, list[str]]) -> None:
        self.usual: dict[str, frozenset[str]] = {}
        self.data: dict[str, bytes] = {}
        for lang in sorted(usual):
            if best := pieces.get(lang):
                self.usual[lang], self.data[lang] = usual[lang], "".join(reversed(best[: DICTIONARY // LEAST])).encode()[-DICTIONARY:]
        self.all_usual = frozenset().union(*self.usual.values()) if self.usual else frozenset()
        self.made: dict = {}
        self.sizes: dict[tuple[str, str], int] = {}  # of the text being restored

    def __getstate__(self):
        return self.__dict__ | {"made": {}, "sizes": {}}

    def size(self, lang: str, text: str) -> int:
        if (n := self.sizes.get((lang, text))) is None:
            n = self.sizes[lang, text] = self._size(lang, text)
        return n

    def _size(self, lang: str, text: str) -> int:
        c = self.made.get(lang)
        if c is None:
            d = zstandard.ZstdCompressionDict(self.data[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(12, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
            c = self.made[lang] = zstandard.ZstdCompressor(dict_data=d, compression_params=p)
        usual = self.usual[lang]
        signs = _signs(text)
        return len(c.compress(text.encode())) + ESCAPE * sum(map(signs.count, set(signs) - usual))

    def utf8(self, name: str) -> Utf8:
        if (name, "utf_8") not in self.made:
            self.made[name, "utf_8"] = Utf8(name)
        return self.made[name, "utf_8"]

    def one_byte(self, usual: frozenset[str]) -> dict[tuple[str, str], Bytes]:
        if usual not in self.made:
            self.made[usual] = {(a, b): Bytes(a, b, usual) for a, b in ONE_BYTE}
        return self.made[usual]

    def languages(self, lang: str | None, signs: set[str]) -> list[str]:
        """The text's language if it was fitted, else those that leave the fewest of its signs unusual."""
        if lang in self.usual:
            return [lang]
        left = {k: len(signs - u) for k, u in self.usual.items()}
        return [k for k, n in left.items() if n == min(left.values())]

    def better_pieces(self, a: list[str], new: str, langs: list[str]) -> str:
        """Of each sentence or part of one the version with the shorter description; a: those of the text that new was made from."""
        b = PIECE.split(new)
        if len(a) != len(b):
            return new
        size = lambda x: min(self.size(k, x) for k in langs)
        return "".join(x if x == y or size(x) <= size(y) else y for x, y in zip(a, b))

    def restore(self, text: str | None, lang: str | None) -> tuple[str, str, bool] | None:
        """(text restored as far as possible, chains, whether something stays lost), or None if the text is not affected."""
        if not text or text.isascii():
            return None
        signs = set(_signs(text))
        langs = self.languages(lang, signs) if self.usual else []
        unusual = signs - frozenset().union(*(self.usual[k] for k in langs)) if langs else signs
        if not unusual and not _may_run(text, signs) and not _may_be_turned(text, signs):
            return None
        if not langs:
            return (text, "", True) if "�" in text or CONTROL.search(text) or SEQUENCE.search(text) else None
        now, chains = text, []
        self.sizes.clear()
        while True:  # each step makes the description shorter
            signs = set(_signs(now))
            langs = self.languages(lang, signs)
            usual = frozenset().union(*(self.usual[k] for k in langs))
            unusual = signs - usual
            turned = _may_be_turned(now, signs)
            if not unusual and not _may_run(now, signs) and not turned:
                break
            mine = usual if lang in self.usual else self.all_usual
            targets = langs if lang in self.usual else sorted(self.usual)
            words = [(m.start(), x, set(_signs(x))) for m in WORD.finditer(now) if not (x := m.group()).isascii() and not BELOW.search(x)]
            strange = [x for x in words if not unusual.isdisjoint(x[2])]
            whole = {(a, "utf_8", True): self.utf8(a).turn(now, signs) for a in READ_AS}
            whole |= {(*pair, strict): chain.turn(now, signs, strange if strict else words) for pair, chain in self.one_byte(mine).items() for strict in (True, False)}
            options, seen, pieces = {}, {now}, PIECE.split(now)
            for chain, new in whole.items():
                if new not in seen:
                    seen.add(new)
                    options[chain] = self.better_pieces(pieces, new, targets)
            # only lines that some chain changes are compared
            best = (0, "", now)
            lines = now.split("\n")
            for chain, new in options.items():
                if new == now:
                    continue
                other = new.split("\n")
                pair = [(x, y) for x, y in zip(lines, other) if x != y] if len(lines) == len(other) else [(now, new)]
                old_part, new_part = "\n".join(x for x, _ in pair), "\n".join(y for _, y in pair)
                if unusual.isdisjoint(old_part) and not UTF8_RUN.search(old_part) and not turned:
                    continue
                gain = min(self.size(k, old_part) for k in targets) - min(self.size(k, new_part) for k in targets) - COST
                if gain > best[0]:
                    best = (gain, ">".join(chain[:2]), new)
            if not best[1]:
                break
            now = best[2]
            chains.append(best[1])
        lost = "�" in now or bool(CONTROL.search(now)) or bool(SEQUENCE.search(now)) or bool(set(LONE.findall(now)) & (set(_signs(now)) - frozenset().union(*(self.usual[k] for k in self.languages(lang, set(_signs(now)))))))
        return (now, " ".join(chains), lost) if chains or lost else None


def fit(docs: DataFrame, text: str, lang: str) -> Model:
    """Model from all labelled documents, each text once however many copies there are."""
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & ~F.lower(lang).isin(*UNKNOWN)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    known = known.withColumn("copy", F.xxhash64(F.regexp_replace("text", r"\p{Nd}+", "0"), "lang", F.lit(10)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        last = None

        def out() -> Iterator[pa.RecordBatch]:
            for (k, kind), c in counts.items():
                yield pa.RecordBatch.from_arrays([pa.repeat(k, len(c)), pa.repeat(kind, len(c)), pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], ["lang", "kind", "x", "n"])

        for batch in batches:
            for k, t, copy in zip(*(batch[c].to_pylist() for c in ("lang", "text", "copy"))):
                if copy != last:
                    last = copy
                    tally(counts, k, t)
            if sum(map(len, counts.values())) > HELD:
                yield from out()
                counts.clear()
        yield from out()

    every = known.repartition("copy").sortWithinPartitions("copy", "text").mapInArrow(count, "lang string, kind string, x string, n bigint")
    every = stage(every.groupBy("lang", "kind", "x").agg(F.sum("n").alias("n")), "p10-counts")
    texts = {r.lang: r.n for r in every.where("kind = 'text'").collect()}
    often = every.where("kind = 'sign'").join(F.broadcast(every.where("kind = 'text'").select("lang", F.col("n").alias("texts"))), "lang").where(f"n >= greatest(2, {USUAL} * texts)")
    signs: dict[str, dict[str, int]] = {k: {} for k in texts}
    for r in often.select("lang", "x", "n").collect():
        signs[r.lang][r.x] = r.n
    usual = {k: usual_signs(signs[k], n) for k, n in texts.items()}
    if not usual:
        return Model([])
    return Model.of(usual, best_pieces(every.where("kind = 'piece'").select("lang", "x", "n"), usual))


def best_pieces(pieces: DataFrame, usual: dict[str, frozenset[str]]) -> dict[str, list[str]]:
    """The pieces (lang, x, n) without an unusual character that fill each language's dictionary, the best first."""
    score, clean = "n * (octet_length(x) - 2)", r"(octet_length(x) = length(x) or translate(x, usual, '') not rlike '[^\\x00-\\x7F]')"

    def of(least: dict[str, int]) -> DataFrame:
        known = pieces.sparkSession.createDataFrame([(k, "".join(sorted(u)), least.get(k, 0)) for k, u in usual.items()], "lang string, usual string, least bigint")
        return pieces.where(f"octet_length(x) >= {LEAST}").join(F.broadcast(known), "lang").where(f"{score} >= least and {clean}")

    # what pieces found OFTEN times fill a dictionary with, no piece of a lower score comes into it; so few are ranked
    bins = of({}).where(f"n >= {OFTEN}").groupBy("lang", F.expr(f"int(8 * log2({score}))").alias("bin")).agg(F.sum(F.expr("octet_length(x)")).alias("bytes"), F.min(F.expr(score)).alias("least"))
    held, least = Counter(), {}
    for r in sorted(bins.collect(), key=lambda r: -r.least):
        if held[r.lang] < DICTIONARY:
            held[r.lang] += r.bytes
            if held[r.lang] >= DICTIONARY:
                least[r.lang] = r.least
    nth = lambda *by: F.row_number().over(W.partitionBy("lang", *by).orderBy(F.expr(score).desc(), "x"))
    best = of(least).withColumn("nth", nth(F.expr("pmod(xxhash64(x), 64)"))).where(F.col("nth") <= DICTIONARY // LEAST)  # so that no task sorts a whole language
    best = best.withColumn("nth", nth()).where(F.col("nth") <= DICTIONARY // LEAST)
    found = defaultdict(list)
    for r in sorted(best.select("lang", "x", "nth").collect(), key=lambda r: r.nth):  # a dictionary of each language
        found[r.lang].append(r.x)
    return found


def restored(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """doc_id, text (restored as far as possible), chains, lost of every affected document."""
    held = ship(docs.sparkSession, fit(docs, text, lang))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = pickle.loads(held.value)
        for pdf in batches:
            rows = [(i, *r) for i, t, k in zip(pdf["id"], pdf["text"], pdf["lang"]) if (r := m.restore(t, k)) is not None]
            if rows:
                yield pd.DataFrame(rows, columns=["id", "text", "chains", "lost"])

    x = docs.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    return x.mapInPandas(run, "id bigint, text string, chains string, lost boolean").select(F.col("id").alias(doc_id), "text", "chains", "lost")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return restored(table(spark, d, "documents"), "doc_id", "text", "lang").select("doc_id").distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return restored(table(spark, d, "documents"), "doc_id", "text", "lang")


QUERIES = {"p10_found": p10_found, "p10_restored": p10_restored}
SQL: dict[str, str] = {}
