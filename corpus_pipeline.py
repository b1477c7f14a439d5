"""A corpus pipeline from five operators; each stage is written as Parquet and read again by the next.

All stages take null and empty texts, ties, repeated rows and ids, empty tables and columns of any other names; what each
makes of them is stated with it. All but the last return the columns of their input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripleweave.llm.base import cut, file_order, fresh
from tripleweave.llm.exact import drop_copies
from tripleweave.llm.langid import accepted, fit, held_out
from tripleweave.llm.mixing import taken_rows
from tripleweave.llm.packing import pack_documents
from tripleweave.llm.simhash import one_of_each


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject; it learns from the labelled rows of these documents
    that are not held out. Null, empty and letterless texts go, as do ties between languages; where no row has a label,
    nothing can be rejected and all rows stay. Rows that repeat are judged alike."""
    return accepted(docs, fit(docs.where(~held_out()), rank=F.xxhash64("doc_id")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id; null text is empty text; of rows that repeat with their id one
    stays; a row without id stays only where no other has its text."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, one row: that of the smallest id, by the text's MD5 where an id repeats. Texts
    without words are one group; a row without id stays only where its group has no other."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or twice, each copy at the training time that its source's
    schedule gives it; the files written of the rows follow each other in that time. Texts without words are not taken; a
    null source is a source; rows of one id are judged each by its text."""
    return taken_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences of documents that are near in the training order, which is that of
    the files; column place rises with it. Null and empty texts are one end token; rows that repeat are documents of their
    own."""
    (place,) = fresh(docs, "place")
    return pack_documents(docs.withColumn(place, file_order(docs)), order_col=place).withColumnRenamed(place, "place")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]
#: Compression by zstandard, XXH64 and tokenizers have no SQL; tests/llm/test_pipeline.py holds stages and run() against
#: plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
