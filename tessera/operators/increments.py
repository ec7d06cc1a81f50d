"""What is left to do: inputs without results, results without derivatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(inputs: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Inputs whose result does not exist yet."""
    return inputs.join(results.select(key), key, "left_anti")


def pending_tasks(inputs: DataFrame, outputs: DataFrame, key: str, tasks: list[str]) -> DataFrame:
    """Inputs lacking at least one of the task outputs."""
    done = (
        outputs.where(F.col("task").isin(tasks)).select(key, "task").distinct().groupBy(key).agg(F.count("*").alias("_n"))
        .where(F.col("_n") >= len(tasks)).select(key)
    )
    return inputs.join(done, key, "left_anti")


def missing_derivatives(results: DataFrame, derivatives: DataFrame, key: str) -> DataFrame:
    """Finished inputs whose derived output is missing: to be exported without recomputation."""
    return results.select(key).distinct().join(derivatives.select(key), key, "left_anti")
