"""Parquet tables of a data folder, and reads by first arrival."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def first_arrivals(df: DataFrame, key: str, columns: Sequence[str], arrived: str = "ingested_at") -> DataFrame:
    """One row per ``key``: ``columns`` of the row that arrived first.

    Redelivered rows collapse on the map side first, so a key with very many copies costs one row per input split.
    Ties of ``arrived`` go to the smallest values; a null ``arrived`` counts as earliest; null keys are dropped.
    """
    first = F.min(F.struct(F.col(arrived).alias("_at"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)]))
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(first.alias("_first"))
        .select(key, *[F.col(f"_first._{i}").alias(c) for i, c in enumerate(columns)])
    )
