"""The corpus pipeline: documents to packed training windows, five stages, each over whole tables.

1. quality rules: failing lines go, and so do the documents that the rules reject;
2. line dedup: lines held by three documents or more stay only in the last of them;
3. n-gram Jaccard join: of each class of near copies one document stays;
4. suffix-array dedup: characters inside repeated long strings go;
5. packing: what is left is laid out in windows of token ids.

All stages but the last return the columns of ``documents``; a stage may leave a document with an empty
text, which is kept as such. ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import line_dedup, ngram_join, packing, quality_rules, suffix_dedup
from tidemark.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Kept documents without their failing lines; null and empty texts go, rows without an id are judged as others, repeated rows each for itself."""
    return quality_rules.clean(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three hold, but for the largest id; a null text becomes empty, rows without an id keep all lines, rows of one id count as one document."""
    return line_dedup.drop_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each class of near copies; empty texts are one class, rows without an id stay, repeated rows are one, other texts of one id are documents of their own."""
    return ngram_join.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the characters inside repeated strings; a null text becomes empty, repeated rows repeat each other's strings and lose them."""
    return suffix_dedup.remove_repeats(docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 ids with their places; a null or empty text is the end id alone, rows without an id and repeated rows are packed each for itself."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram jaccard join", near_copies), ("suffix-array dedup", repeats), ("packing", windows)]

#: The last stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
