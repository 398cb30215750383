import pytest
from compare import SF, oracle, rows_of
from pyspark.sql import functions as F

from docspark.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == oracle(ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_short_rows_are_dealt_to_all_cores(spark):
    for name in ("pptx_import", "rtf_text", "latex_text", "markup_tokens", "visual_order", "bidi_levels"):
        used = QUERIES[name](spark, SF).select(F.spark_partition_id().alias("k")).groupBy("k").count().count()
        assert used >= spark.sparkContext.defaultParallelism, name
