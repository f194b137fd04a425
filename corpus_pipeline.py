"""From raw documents to packed training sequences: five stages, each one of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import decontaminate, exact_dedup, langid, near_dedup, packing
from panelspark.llm.common import staged, table
from panelspark.llm.queries import tokenizer_path

#: Documents whose best language scores less than this are in none of the known languages.
LEAST_LANGUAGE_SCORE = 0.35
#: Near copies share so many percent of their distinct 5-word shingles.
LEAST_SIMILARITY = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts that are null, without letters or in none of the languages go.

    Rows that repeat a doc_id are judged each by its own text and all stay or go with it; so does a null doc_id.
    """
    model = langid.train_on(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    return langid.keep_known_languages(docs, model, LEAST_LANGUAGE_SCORE)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id, a null one first; of rows that repeat it exactly one."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id; rows that repeat a doc_id stay or go together,
    and rows without one stay."""
    return near_dedup.drop_near_copies(docs, LEAST_SIMILARITY)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item; all rows of a doc_id go if one of them repeats one, and rows without doc_id stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 4096; rows that repeat a doc_id are packed each, and no documents give no rows."""
    return packing.pack_documents(docs, tokenizer_path(), capacity=4096)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_leaks),
    ("packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned models and the tokenizer are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None
