"""All registered queries of the library and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.plans import document_queries, layout_queries, relational_queries, report_queries, symbol_queries

MODULES = (symbol_queries, relational_queries, report_queries, document_queries, layout_queries)


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["check_accounting"](spark, sf_dir)
