"""Parquet tables as relations of integer columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binding(spark: SparkSession, sf_dir: str, name: str, alias: str, *columns: str) -> DataFrame:
    """The named columns of a table, renamed to alias_column so that self-joins stay unambiguous."""
    df = table(spark, sf_dir, name)
    return df.select(*(df[c].alias(f"{alias}_{c}") for c in columns))
