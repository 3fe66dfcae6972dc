"""Names of the queries over the test tables, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscale.plans import formats, gates, relational, reports, scalars, screening, tags, texts
from folioscale.plans.registry import Query

_PARTS = (screening, tags, texts, relational, reports, scalars, formats, gates)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.direction_summary(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for part in _PARTS for name, query in part.registry.queries.items()}


def oracle() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.registry.oracle().items()}
