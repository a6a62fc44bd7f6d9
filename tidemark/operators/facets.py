"""Counts beside a list of listings, each over one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facet(df: DataFrame, column: str, filters: dict[str, Column]) -> DataFrame:
    """(value, n) of a facet under all filters but its own; a null value counts as unknown."""
    for name, test in filters.items():
        if name != column:
            df = df.filter(test)
    values = F.explode(column) if dict(df.dtypes)[column].startswith("array") else F.coalesce(F.col(column), F.lit("unknown"))
    return df.select(values.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def conditional_counts(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row: how many rows pass each test."""
    return df.agg(*[F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, test in tests.items()])
