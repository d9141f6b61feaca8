"""A corpus pipeline over ``documents``: quality classifier, line dedup, near-dedup, repeated passages, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame; all but the last
return the columns of documents. Where a stage changes ``text``, ``n_chars`` follows it. Documents that lose all their
words to a stage, as exact copies of three or more lines do, go with them: their text is held by the documents that stay. Documents that
had no word to begin with stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm import line_windows, minhash, packing, quality_fm, repeat_windows
from tallyworks.llm.common import drop_scratch, finished, free_name, read
from tallyworks.llm.queries import tokenizer_path


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(columns)


def _without_emptied(remove: Callable[[DataFrame], DataFrame], docs: DataFrame) -> DataFrame:
    """``remove(docs)`` less the documents that had words before and have none after."""
    has_word = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    had_word = free_name(docs, "had_word")
    left = remove(docs.withColumn(had_word, has_word))
    return _recounted(left.where(~F.col(had_word) | has_word), docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.7."""
    return quality_fm.keep_good(docs, quality_fm.train(docs, read(spark, sf_dir, "labels")))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of three-line windows that occurred before; texts left without a word go."""
    return _without_emptied(lambda d: line_windows.remove_repeats(d, counts=False), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked by five-word shingles with a similarity of 0.8 or more."""
    return minhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes of 50-byte strings that a document with a smaller id holds; texts left without a word go."""
    return _without_emptied(repeat_windows.remove_repeats, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens of what is left, placed in sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", repeated_lines),
    ("MinHash near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", pack),
]

#: The classifier and the tokenizer have no SQL form; tests/llm/test_pipeline.py holds the stages after the classifier, and run(), against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, finished(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir))
        drop_scratch(before)
    return STAGES[-1][1](spark, docs, sf_dir)
