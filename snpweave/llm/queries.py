"""The ten operators applied to the shared tables with production parameters; ``(spark, sf_dir) -> DataFrame`` each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out
from .decontam import find_leaks
from .exact_dedup import exact_dedup
from .langid import learn, tag_languages
from .licenses import license_scan
from .minhash import minhash_components
from .packing import pack
from .quality import quality_scores
from .secrets import secret_report
from .toxicity import toxicity_scores
from .urlfilter import RULES, filter_urls

#: The tokenizer whose ids are packed; a file of the installed vocabulary package.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tagged = tag_languages(docs, learn(docs))
    return tagged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("row")


def packed_digests(pieces: DataFrame) -> DataFrame:
    """Pieces with their ids' crc32 in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(pack(table(spark, sf_dir, "documents"), tokenizer_path()))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language": op1_language,
        "op2_toxicity": op2_toxicity,
        "op3_decontam": op3_decontam,
        "op4_secrets": op4_secrets,
        "op5_quality": op5_quality,
        "op6_minhash": op6_minhash,
        "op7_urls": op7_urls,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_licenses": op9_licenses,
        "op10_packing": op10_packing,
    }
