"""Documents to packed training sequences: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.llm.common import field, nested, unnested
from pointspark.llm.op2_ngram_join import keep_one_each
from pointspark.llm.op5_langid import UND, learn, predictor
from pointspark.llm.op6_packing import best_two_fit
from pointspark.llm.op9_mixing import mixed_rows
from pointspark.llm.op10_line_dedup import cleaned_lines
from pointspark.llm.queries import WORD_BPE, vocabulary
from pointspark.shared import clear, discard, mark, materialize


#: Words that the encoder of the packing stage remembers: the worker that runs it has served the other stages, too.
PACKING_WORDS = 150_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without a letter."""
    predict = predictor(spark, learn(docs))
    return docs.select(nested(docs), predict(F.col("text").cast("string")).alias("_p")).filter(F.col("_p.lang_pred") != UND).select(*unnested(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated multi-line chunks out of the texts; ``n_chars`` follows."""
    changed = {"text": F.col("_cleaned")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("_cleaned").cast(docs.schema["n_chars"].dataType)
    return cleaned_lines(docs).select(*[changed.get(c, field(c)).alias(c) for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest doc_id stays."""
    return keep_one_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    return mixed_rows(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece, with its ids."""
    return best_two_fit(docs, vocabulary(WORD_BPE), with_ids=True, words=PACKING_WORDS)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard_join", ngram_jaccard_join), ("source_mixing", source_mixing), ("best_fit_packing", best_fit_packing)]

#: Learned profiles, hash-chosen chunk bounds and tokenizers have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        began, last = mark(), docs
        docs = materialize(stage(spark, docs, sf_dir), name)
        clear(spark, began, keep=(docs,))
        discard(last)
    return docs
