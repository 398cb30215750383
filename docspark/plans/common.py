"""Reading the tables that queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to all cores by a key, for a step in Python that takes long over a row:
    a table of short rows may be one file, or one row group, and so one core's work."""
    return rows.repartition(max(32, 3 * rows.sparkSession.sparkContext.defaultParallelism), key)
