"""All queries of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from benthos.operators import packed_values
from benthos.plans import boxes, evaluation, preparation, review, sequences  # noqa: F401  (they register)
from benthos.plans.registry import QUERIES, SQL, query  # noqa: F401
from benthos.sources.tables import table


@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return packed_values.split_values(packed_values.list_answers(table(spark, d, "samples"), table(spark, d, "predictions")))


@query()
def p2_delimiters(spark: SparkSession, d: str) -> DataFrame:
    return packed_values.infer_delimiters(packed_values.list_answers(table(spark, d, "samples"), table(spark, d, "predictions")))
