"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Read ``<folder>/<name>.parquet``; naming columns keeps the scan narrow even before Catalyst."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def latest(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """One row per key: the one that is last in ``order`` (nulls come first, so any value beats null).

    Rows with a null key are dropped: a record without identity cannot be versioned.
    Duplicate rows tie on the whole order and any of them stands for the others.
    """
    sort = [(F.col(o) if isinstance(o, str) else o).desc_nulls_last() for o in order]
    window = Window.partitionBy(key).orderBy(*sort)
    return (
        df.filter(F.col(key).isNotNull())
        .withColumn("_rank", F.row_number().over(window))
        .filter("_rank = 1")
        .drop("_rank")
    )
