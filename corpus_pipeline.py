"""A corpus pipeline of five stages over documents (doc_id, text, lang, source,
n_chars). Each stage works on all that its predecessor kept, written as Parquet
and read again; all but the last return the columns of documents.

1. Language ID learns from the labelled rows of its input; documents without a
   letter, or of whose n-grams no language has a fifth, go.
2. Line dedup removes later occurrences of repeated three-line windows.
3. Near-dedup on five-word shingles keeps the document with the least id of each
   group. Candidates come from SimHash; of them, pairs of Jaccard similarity PERCENT or
   more are linked, no others (docspark/llm/jaccard.py).
4. Decontamination removes spans that match a benchmark window, and documents
   that are mostly such spans.
5. Best-fit packing gives every piece its sequence and offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docspark.llm import decontaminate, jaccard, langid, line_dedup, packing
from docspark.llm.common import made, stored, swept, table
from docspark.session import ship

SHINGLE = 5
PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.with_language(docs, langid.learn(docs.select("doc_id", "text", "lang")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard.deduplicated(docs, SHINGLE, PERCENT)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    # executors have run four stages by now: less text at once leaves memory to them
    placed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), group=1_500_000)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("best_fit_packing", pack),
]

#: SQL can express neither n-gram filters nor byte-pair encoding; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote on its way is deleted once its result
    is written."""
    docs = table(spark, sf_dir, "documents")
    since = made()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        swept(spark, since, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
