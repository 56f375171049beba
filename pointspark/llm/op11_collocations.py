"""Phrases of several words that stand together more often than their parts would, by Apriori level-wise passes.

A text is lower-cased (A-Z), cut at punctuation and line ends to pieces and these at spaces and tabs to words; a
phrase is a run of words inside of a piece. Level by level, k = 1, 2, ..., a pass over the texts counts k-grams by
language; a k-gram is emitted only when both (k-1)-grams in it are frequent. What is frequent is known to every task
from a broadcast bitmap of hashes, of 2^28 bits (32 MB) at most whatever the corpus: a hash that meets another costs a
count that is then found too low, never a wrong result, as a frequent phrase has only frequent parts. Occurrences are
summed in tasks, ``at_once`` of them together, before they are shuffled by phrase. Level tables hold all that
has ``min_count`` occurrences, so they have the counts of both sides of every cut.

Defined cases: a null text has no words; a null language is ``und``; empty texts, ties (to the smaller phrase, in the order
of UTF-8 bytes), repeated rows (each counts) and texts of any length need nothing special, a text is a few arrays in
one task; an empty table or one without candidates gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointspark.llm.common import mix, release, small_batches
from pointspark.shared import materialize

#: Pieces end at these characters (fixed); inside of a piece only spaces and tabs part words, as bytes.split() does.
ENDS = b".,;:!?\n\x0b\x0c\r"
_TO_LINES = bytes.maketrans(ENDS, b"\n" * len(ENDS))
#: Bits of a slice of the bitmap, and of the whole bitmap at least and at most, as powers of two.
SLICE, LEAST, MOST = 16, 16, 28
#: Parts that the phrases of a language are ranked in first.
PARTS = 32
_U = np.uint64


def words_of(text: str) -> tuple[list[bytes], np.ndarray]:
    """Words of a text, and for each how many words its piece has from it on."""
    words, ends = [], []
    for piece in text.encode("utf-8", "surrogatepass").lower().translate(_TO_LINES).split(b"\n"):
        if w := piece.split():
            words += w
            ends.append(len(words))
    ends = np.array(ends, np.int64)
    return words, np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(words))


def gram_hashes(h: np.ndarray, k: int, lang: str) -> np.ndarray:
    """Hashes of the runs of ``k`` words whose hashes follow each other in ``h``, of a language's own."""
    n = max(0, len(h) - k + 1)
    acc = mix(h[:n], xxhash.xxh3_64_intdigest(lang))
    with np.errstate(over="ignore"):
        for j in range(1, k):
            acc = mix(acc + h[j : j + n], j)
    return acc


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Bitmap:
    """Which hashes may be those of frequent phrases."""

    def __init__(self, bits: int, slices: dict[int, bytes]):
        self.shift = _U(64 - bits)
        self.bytes = np.zeros(1 << (bits - 3), np.uint8)
        for at, held in slices.items():
            self.bytes[at << (SLICE - 3) : (at + 1) << (SLICE - 3)] = np.frombuffer(held, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> self.shift).astype(np.int64)
        return (self.bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitmap(frequent: DataFrame, k: int) -> Bitmap:
    """Bitmap of a level table (lang, phrase, f): positions are made in tasks and gathered by slices of a fixed number."""
    bits = min(MOST, max(LEAST, (16 * frequent.count()).bit_length()))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [gram_hashes(word_hashes(p.encode().split(b" ")), k, lang)[0] for lang, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            at = np.unique(np.array(h, np.uint64) >> _U(64 - bits)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"slice": pa.array((at >> SLICE).astype(np.int32)), "at": pa.array((at & ((1 << SLICE) - 1)).astype(np.int32))})

    def gather(group: pa.Table) -> pa.Table:
        held = np.zeros(1 << SLICE, np.uint8)
        held[group.column("at").to_numpy()] = 1
        return pa.table({"slice": group.column("slice")[:1], "held": pa.array([np.packbits(held, bitorder="little").tobytes()])})

    slices = frequent.select("lang", "phrase").mapInArrow(positions, "slice int, at int").groupBy("slice").applyInArrow(gather, "slice int, held binary")
    return Bitmap(bits, {r["slice"]: bytes(r["held"]) for r in slices.toLocalIterator()})  # 2^12 slices of 8 KB at most


class Vocabulary(dict):
    """Numbers of the words met, from 0; a word is hashed once."""

    def __init__(self) -> None:
        self.words: list[bytes] = []
        self.known, self.hashed = np.empty(1024, np.uint64), 0

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.words)
        self.words.append(word)
        return at

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def hashes(self) -> np.ndarray:
        n = len(self.words)
        if n > self.hashed:
            if n > len(self.known):
                self.known = np.resize(self.known, 2 * n)
            self.known[self.hashed : n] = word_hashes(self.words[self.hashed :])
            self.hashed = n
        return self.known


def runs_of(ids: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Runs of ``k`` numbers from ``starts`` on: one integer each for up to three, else a row each."""
    columns = [ids[starts + j] for j in range(k)]
    return sum(c << (21 * (k - 1 - j)) for j, c in enumerate(columns)) if k <= 3 else np.stack(columns, axis=1)


def phrases_of(runs: np.ndarray, words: list[bytes], k: int) -> list[bytes]:
    columns = [((runs >> (21 * (k - 1 - j))) & 0x1FFFFF) for j in range(k)] if k <= 3 else list(runs.T)
    return [b" ".join(map(words.__getitem__, run)) for run in zip(*[c.tolist() for c in columns], strict=True)]


#: Words of a vocabulary; their numbers must stay below 2^21.
MOST_WORDS = 400_000


def counts(docs: DataFrame, k: int, known: Bitmap | None, at_once: int = 2_000_000) -> DataFrame:
    """``lang, phrase, f`` of the k-grams whose (k-1)-grams are ``known``; for k = 1 the empty phrase counts all words."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def batch_of(langs: list[str], phrases: list[bytes], f: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "phrase": pa.array(phrases, pa.binary()), "f": pa.array(f, pa.int64())})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                yield lang.as_py(), *words_of(text.as_py())

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flushed() -> pa.RecordBatch:
            langs, phrases = [lang for lang, c in held.items() for _ in range(len(c))], [p for c in held.values() for p in c]
            f = np.fromiter((n for c in held.values() for n in c.values()), np.int64, len(langs))
            held.clear()
            return batch_of(langs, phrases, f)

        for lang, words, _ in rows(batches):
            own = held.setdefault(lang, Counter())
            own.update(words)
            own[b""] += len(words)
            if sum(map(len, held.values())) >= at_once // 8:
                yield flushed()
        yield flushed()

    def count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, vocabulary = shared.value, Vocabulary()
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                runs, f = np.unique(np.concatenate(parts), return_counts=True, axis=None if k <= 3 else 0)
                for at in range(0, len(runs), 100_000):
                    some = phrases_of(runs[at : at + 100_000], vocabulary.words, k)
                    yield batch_of([lang] * len(some), some, f[at : at + 100_000])
            held.clear()

        for lang, words, left in rows(batches):
            if len(words) < k:
                continue
            ids = vocabulary.numbers(words)
            frequent = known.has(gram_hashes(vocabulary.hashes()[ids], k - 1, lang))
            starts = np.flatnonzero(frequent[:-1] & frequent[1:] & (left[: len(words) - k + 1] >= k))
            if len(starts):
                held.setdefault(lang, []).append(runs_of(ids, starts, k))
                size += len(starts)
            if size >= at_once or len(vocabulary) > MOST_WORDS:
                yield from flushed()
                size = 0
                if len(vocabulary) > MOST_WORDS:
                    vocabulary = Vocabulary()
        yield from flushed()
        release()

    parts = docs.mapInArrow(count_words if k == 1 else count_runs, "lang string, phrase binary, f long")
    return parts.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("f").alias("f"))


def levels(docs: DataFrame, max_words: int = 3, min_count: int = 10, text: str = "text", lang: str = "lang") -> tuple[DataFrame, list[DataFrame]]:
    """Words of each language (``lang, n``), and the level tables (``lang, phrase, f``) of 1 to ``max_words`` words."""
    small_batches(docs.sparkSession)
    plain = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")), F.col(text).cast("string")).filter(F.col(text).isNotNull())
    known, found = None, []
    for k in range(1, max_words + 1):
        every = counts(plain, k, known)
        found.append(materialize(every.filter((F.col("f") >= min_count) | (F.col("phrase") == "")), f"level-{k}"))
        if k < max_words:
            known = bitmap(found[-1].filter("phrase <> ''"), k)
    totals = found[0].filter("phrase = ''").select("lang", F.col("f").alias("n"))
    return totals, [found[0].filter("phrase <> ''"), *found[1:]]


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, covered: int = 50, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    A phrase of ``a`` occurrences, cut after its first words into parts of ``l`` and ``r``, scores
    floor(1000000 a a / (l r)) at its lowest-scoring cut. Phrases inside of a longer candidate with ``covered``
    percent of their occurrences are left out.
    """
    totals, tables = levels(docs, max_words, min_count, text, lang)
    phrases = reduce(DataFrame.unionByName, [t.select("lang", "phrase", F.col("f").alias("a"), F.lit(k + 2).alias("k")) for k, t in enumerate(tables[1:])])
    part = lambda first, size: F.array_join(F.slice("w", first, size), " ")
    worded = phrases.withColumn("w", F.split("phrase", " "))
    # the most occurrences of a candidate around each phrase
    sizes = worded.filter("k > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    inner = sizes.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    around = inner.select(F.col("lang").alias("_lang"), part(F.col("at"), F.col("size")).alias("_phrase"), "a").groupBy("_lang", "_phrase").agg(F.max("a").alias("_most"))
    kept = worded.join(around, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left").filter(F.col("_most").isNull() | (100 * F.col("_most") < covered * F.col("a"))).select("lang", "phrase", "a", "k", "w")
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    parts = reduce(DataFrame.unionByName, tables[:-1])
    for name, f in (("first", "l"), ("rest", "r")):
        table = parts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("f").alias(f))
        cuts = cuts.join(table, (F.col("lang") == F.col("_lang")) & (F.col(name) == F.col("_phrase"))).drop("_lang", "_phrase")
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    millions = (wide("a") * wide("a")).cast("decimal(30,0)") * F.lit(1_000_000).cast("decimal(8,0)")
    cuts = cuts.withColumn("_over", millions).withColumn("_under", (wide("l") * wide("r")).cast("decimal(30,0)")).withColumn("score", F.expr("_over div _under"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    # a language's best first in each of a fixed number of parts, so no task sees more than their best
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).cast("int")
    some = best.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    named = ranked.join(totals.select(F.col("lang").alias("_lang"), "n"), F.col("lang") == F.col("_lang"))
    return named.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
