"""Language ID by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is the ``profile_size`` most frequent character n-grams (1 to 3 letters, words padded by a blank) of
a language, by rank. A document's own most frequent n-grams are compared with every profile: each n-gram costs
the distance between its two ranks, or the profile's size where the profile lacks it; the least total wins and
ties go to the language first by name. The score is 1 - total / greatest possible total.

The classifier is fitted on a bounded sample: of each language the rows whose hash is lowest, about
``sample_rows`` in expectation and all where there are fewer. Predictions read whole texts and nothing else; the
other columns of a row stay in the JVM, and only predictions come back from Python.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing could
be learned; repeated rows each get their own result; null identifiers count as held out of training; an empty
table gives an empty result; further columns are carried, but columns named ``lang_pred`` or ``score`` are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointspark.llm.common import nested, release, row_keys, small_batches, unnested
from pointspark.shared import materialize

UND = "und"
_BITS = np.uint64(21)  # of a code point
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.bool_)
    return _letters


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of a text, most frequent first (ties by code), and their counts."""
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    if not text:
        return none
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter()[points]
    if not letter.any():
        return none
    # runs of non-letters become one blank; a blank stands at both ends
    c = np.where(letter, points, 32).astype(np.uint64)
    c = np.concatenate(([np.uint64(32)], c, [np.uint64(32)]))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = c[keep]
    two = (c[:-1] << _BITS) | c[1:]
    three = (two[:-1] << _BITS) | c[2:]
    # a gram that is or crosses a blank in the middle says nothing about a word
    all_ = np.concatenate((c[c != 32], two, three[c[1:-1] != 32]))
    code, n = np.unique(all_, return_counts=True)
    order = np.argsort(-n, kind="stable")
    return code[order], n[order]


def held_out(doc_id: str = "doc_id"):
    """Rows that must not be learned from: crc32 of the identifier as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def learn(docs: DataFrame, sample_rows: int = 4000, profile_size: int = 300) -> dict[str, np.ndarray]:
    """Profiles by language from ``doc_id, text, lang``; n-gram codes in order of rank.

    Every label gets a profile; ``sample_rows`` bounds the expected training rows of each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.filter(~held_out()).filter("lang is not null and text is not null").select(row_keys("doc_id", "text")[0].alias("_h"), F.col("lang").cast("string").alias("_lang"), F.col("text").cast("string").alias("_text"))
    counts = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    # an unsigned hash below rate * 2^63, of its upper 63 bits
    top = float(1 << 63)
    limits = spark.createDataFrame([(lang, min(top, top * min(1.0, sample_rows / n))) for lang, n in counts.items()], "_l string, _limit double")
    sample = rows.join(F.broadcast(limits), F.col("_lang") == F.col("_l")).filter(F.shiftrightunsigned("_h", 1).cast("double") <= F.col("_limit")).select("_lang", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(grams(text))
            for lang, found in by.items():
                code, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n for _, n in found]), len(code)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"_lang": [lang] * len(code), "code": pa.array(code.view(np.int64)), "n": pa.array(n)})
        release()

    per = materialize(sample.mapInArrow(count, "_lang string, code long, n long").groupBy("_lang", "code").agg(F.sum("n").alias("n")), "grams")
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("n"), "code"))
    best = per.withColumn("_at", place).filter(F.col("_at") <= profile_size).groupBy("_lang").agg(F.array_sort(F.collect_list(F.struct("_at", "code"))).alias("_p"))
    # profile_size codes for each label
    return {r["_lang"]: np.array([x["code"] for x in r["_p"]], np.int64).view(np.uint64) for r in best.orderBy("_lang").collect()}


class Ranker:
    """Out-of-place distances of texts to a set of profiles."""

    def __init__(self, profiles: dict[str, np.ndarray], profile_size: int = 300):
        self.names, self.size = sorted(profiles), profile_size
        self.codes = [np.sort(profiles[x]) for x in self.names]
        self.ranks = [np.argsort(profiles[x], kind="stable") for x in self.names]

    def predict(self, text: str | None) -> tuple[str, float]:
        code = grams(text)[0][: self.size]
        if not len(code) or not self.names:
            return UND, 0.0
        own, best = np.arange(len(code)), None
        for name, codes, ranks in zip(self.names, self.codes, self.ranks, strict=True):
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            cost = int(np.where(codes[at] == code, np.minimum(np.abs(ranks[at] - own), self.size), self.size).sum())
            if best is None or cost < best[0]:
                best = cost, name
        return best[1], 1.0 - best[0] / (self.size * len(code))


def predictor(spark: SparkSession, profiles: dict[str, np.ndarray], profile_size: int = 300) -> Callable[[Column], Column]:
    """A function of a text column: ``struct<lang_pred, score>``."""
    small_batches(spark)
    table = spark.sparkContext.broadcast(profiles)  # profile_size codes for each label

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        ranker = Ranker(table.value, profile_size)
        got = [ranker.predict(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["lang_pred", "score"])

    return predict.asNondeterministic()  # else a filter on the result would ask for it twice


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], profile_size: int = 300, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; a prediction reads the text alone."""
    predicted = docs.select(nested(docs), predictor(docs.sparkSession, profiles, profile_size)(F.col(text).cast("string")).alias("_p"))
    return predicted.select(*unnested(docs, "lang_pred", "score"), "_p.lang_pred", "_p.score")
