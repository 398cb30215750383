"""The queries of this subpackage, one opN_ for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, fresh_dir, table


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _held_out(of: int, remainder: int) -> Column:
    return F.coalesce(fold(F.col("doc_id"), of) == remainder, F.lit(False)).alias("held_out")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identified, learn

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = learn(docs.where(fold(F.col("doc_id"), 4) != 2))
    return identified(docs.select("doc_id", "text"), filters).select("doc_id", _held_out(4, 2), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"), F.col("_coverage").alias("coverage"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import scored

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold(F.col("doc_id"), 5) != 1).alias("train"))
    return scored(docs).select("doc_id", _held_out(5, 1), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), _tokenizer()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import digest, matches

    return digest(matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import applied, written

    return applied(written(table(spark, sf_dir, "documents"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits", "base_failed", "kept")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the full policy alone keeps out, from the ledger's bits."""
    from .quality import ablations, written

    return ablations(written(table(spark, sf_dir, "documents")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import deduplicated_lines

    return deduplicated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    return read_archives(spark, write_archives(table(spark, sf_dir, "pages"), fresh_dir(spark, "warc")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, scored

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    index = learn(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    return scored(docs, index).select("doc_id", _held_out(4, 2), "score", "predicted", "neighbours")


def op10_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import read_tokens, write_tokens

    manifest = write_tokens(table(spark, sf_dir, "documents"), fresh_dir(spark, "tokens"), _tokenizer())
    return read_tokens(spark, manifest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()} | {"quality_ablations": quality_ablations}


def oracle_sql() -> dict[str, str]:
    from . import line_dedup, quality

    return {"op5_quality_rules": quality.SQL, "quality_ablations": quality.ABLATION_SQL, "op6_line_dedup": line_dedup.SQL}
