"""The corpus operators as queries over their whole tables, with SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitsliced_topk, conversation_repair, divergence_rules, importance_resampling, line_windows, minhash, packing, page_text
from . import piece_codec, quality_fm, repeat_windows, token_counts, warc
from .common import read

#: Folder of public tokenizer files; the environment may name another.
TOKENIZERS = os.environ.get("TALLYWORKS_TOKENIZERS", "")


def tokenizer_path(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_fm.score(docs, quality_fm.train(docs, read(spark, sf_dir, "labels")))


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return divergence_rules.judge(docs, divergence_rules.references(docs)).drop("char_jsd", "word_jsd")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = warc.resolve_revisits(warc.page_records(read(spark, sf_dir, "pages")))
    return resolved.withColumn("headers", warc.header_lines(F.col("headers")))


def op5_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced_topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(read(spark, sf_dir, "pages"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=2, percent=80)


def op8_repeat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_windows.measure(read(spark, sf_dir, "documents"))


def op9_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_windows.remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digests(conversation_repair.damage(read(spark, sf_dir, "conversations")))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_quality_fm, op2_piece_codec, op3_divergence_rules, op4_warc, op5_bitsliced_topk, op6_page_text, op7_minhash,
        op8_repeat_windows, op9_line_windows, op10_packing, op11_importance_resampling, op12_conversation_repair, op13_token_counts,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc": warc.ORACLE, "op5_bitsliced_topk": bitsliced_topk.ORACLE, "op7_minhash": minhash.ORACLE,
        "op9_line_windows": line_windows.ORACLE, "op11_importance_resampling": importance_resampling.ORACLE,
    }
