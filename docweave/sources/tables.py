"""Parquet tables, and a spread of scans over idle cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if a scan would leave some without a task, whatever its size."""
    execution, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    if execution.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":  # it comes from an exchange
        return df
    return df.repartition(cores) if execution.toRdd().getNumPartitions() < cores else df
