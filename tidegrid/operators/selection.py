"""Choices of rows: firsts of a group, deduplication, complements, assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group in order; Spark cuts groups before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__place", place).filter(F.col("__place") <= n).drop("__place")


def deduplicated(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in order."""
    return first_per_group(rows, keys, order, 1)


def assigned(files: DataFrame, assignment: DataFrame, on: list[str]) -> DataFrame:
    """Files with their split."""
    return files.join(assignment, on)


def complement(rows: DataFrame, chosen: DataFrame, on: list[str]) -> DataFrame:
    """Distinct keys that are not chosen."""
    return rows.select(*on).distinct().join(chosen, on, "left_anti")


def split_manifest(files: DataFrame, assignment: DataFrame, on: list[str]) -> DataFrame:
    """Per file: split, label, person and rows, ``train`` or ``validation`` by the assignment's flag."""
    rows = assigned(files, assignment, on)
    return rows.select("name", F.when(F.col("is_train"), "train").otherwise("validation").alias("split"), "label", "person", "row_count")
