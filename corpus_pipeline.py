"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Every stage but the last returns the columns of ``documents``; what a stage drops is gone
for the stages after it.  Decisions are taken for rows, told apart by a number of their own, never
for ids: a row stays or goes by its own text.

Defined results: of rows with equal texts one stays, also where they repeat an id or have none; rows
that share an id and differ in text are judged one by one; null, empty and letterless texts go in the first stage (they have no
language); ties go to the largest id in exact copies and to the smallest in near copies, then to the row number; a null ``doc_id``
is never linked as a near copy, else treated like others; empty tables give empty tables of the same columns; extra columns are kept as they are up
to packing, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snpweave.llm.common import numbered_rows, without_rows
from snpweave.llm.decontam import find_leaks
from snpweave.llm.exact_dedup import exact_dedup
from snpweave.llm.langid import keep_languages, learn
from snpweave.llm.minhash import minhash_components
from snpweave.llm.packing import pack
from snpweave.llm.queries import packed_digests, tokenizer_path
from snpweave.storage import Scope, discard, materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents go if no language has this mean marginal over their words (or if they have no letter).
LEAST_LANGUAGE_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learnt language stay."""
    return keep_languages(docs, learn(docs), least=LEAST_LANGUAGE_SCORE)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id stays."""
    marked, row = numbered_rows(docs)
    judged = exact_dedup(marked.select(row, "doc_id", "text"), row_col=row)
    return without_rows(marked, row, judged.where("NOT kept").select(F.col("row").alias(row)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id stays."""
    marked, row = numbered_rows(docs)
    judged = minhash_components(marked.select(row, "doc_id", "text"), row_col=row)
    return without_rows(marked, row, judged.where("NOT first").select(F.col("row").alias(row)))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one, go."""
    marked, row = numbered_rows(docs)
    leaks = find_leaks(marked, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=row)
    return without_rows(marked, row, leaks.select(F.col("doc_id").alias(row)).distinct())


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Everything that is left, as pieces of full windows of 2,048 tokens."""
    return packed_digests(pack(docs, tokenizer_path()))


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("exact_dedup", exact_copies),
    ("minhash", near_copies),
    ("decontam", benchmark_leaks),
    ("packing", packing),
]

#: Language decisions, verified near-duplicate links and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the whole documents table; a stage's scratch tables go once its result is written."""
    docs = raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with Scope(spark) as used:
            made = stage(spark, docs, sf_dir)
        kept = materialize(made, f"pipeline-{name}")
        used.release()
        if docs is not raw:
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
