"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.llm.common import table
from pointspark.llm.op1_substring_dedup import remove_repeats
from pointspark.llm.op2_ngram_join import ngram_components
from pointspark.llm.op3_sstable import token_shards
from pointspark.llm.op4_chat import answers_swapped, format_sides
from pointspark.llm.op5_langid import held_out, identify, learn
from pointspark.llm.op6_packing import best_two_fit
from pointspark.llm.op7_topk import top_k
from pointspark.llm.op8_embedding_dedup import near_duplicates
from pointspark.llm.op9_mixing import mix
from pointspark.llm.op10_line_dedup import dedup_lines
from pointspark.llm.op11_collocations import collocations
from pointspark.llm.op12_html import extract, train
from pointspark.llm.op13_merkle import manifest

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.transform("removed", lambda r: F.struct(r.start.alias("start"), r.end.alias("end")))
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_sentences", "n_removed", F.to_json(spans).alias("removed"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op3_sstable_shards(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return token_shards(spark, table(spark, sf_dir, "documents"), tokenizer or vocabulary(BYTE_BPE)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_sides(answers_swapped(table(spark, sf_dir, "conversations")))
    masks = {c: F.array_join(F.transform(c, lambda m: F.concat_ws("-", m.start, m.end)), ",") for c in ("chosen_mask", "rejected_mask")}
    return out.withColumns(masks)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return best_two_fit(table(spark, sf_dir, "documents"), tokenizer or vocabulary(WORD_BPE)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_removed")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_ngram_jaccard_join, op3_sstable_shards, op4_preference_format, op5_language_id, op6_best_fit_packing, op7_exact_topk, op8_embedding_near_dedup, op9_source_mixing, op10_line_dedup, op11_phrase_collocations, op12_html_extraction, op13_merkle_manifest)}
