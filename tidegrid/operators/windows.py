"""Count-based windows over segments, and their manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import window_key
from .ranges import ranked


def windows(segments: DataFrame, columns: list[str], lengths: list[int], stride: int) -> DataFrame:
    """Windows of each length at starts 0, stride, 2 stride ...; partial ones are dropped, none crosses a segment.

    ``segments`` has source, segment_id, n_steps and parallel arrays; a tumbling window is
    one whose stride is its length.
    """
    sized = segments.withColumn("window_length", F.explode(F.array(*map(F.lit, lengths)))).filter(F.col("n_steps") >= F.col("window_length"))
    starts = sized.withColumn("start_index", F.explode(F.sequence(F.lit(0), F.col("n_steps") - F.col("window_length"), F.lit(stride))))
    others = [c for c in segments.columns if c not in columns]
    return starts.select(*others, "window_length", "start_index", *(F.slice(c, F.col("start_index") + 1, F.col("window_length")).alias(c) for c in columns))


def step_windows(steps: DataFrame, columns: list[str], lengths: list[int], stride: int, order: str = "step_index") -> DataFrame:
    """The windows of ``windows`` from step rows: each row goes to the windows that cover it, so no array is longer than a window."""
    at = F.row_number().over(Window.partitionBy("source", "segment_id").orderBy(order)) - 1
    rows = steps.select("source", "segment_id", F.col(order).alias("_o"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(columns)), at.alias("_at"))
    rows = rows.withColumn("window_length", F.explode(F.array(*map(F.lit, lengths))))
    first = F.greatest(F.ceil((F.col("_at") - F.col("window_length") + 1) / stride), F.lit(0)).cast("int")
    last = F.floor(F.col("_at") / stride).cast("int")
    rows = rows.withColumns({"_first": first, "_last": last}).filter("_first <= _last")
    rows = rows.withColumn("_k", F.explode(F.sequence("_first", "_last"))).withColumn("start_index", F.col("_k") * stride)
    packed = F.array_sort(F.collect_list(F.struct("_at", *(f"_{i}" for i in range(len(columns))))))
    cut = rows.groupBy("source", "segment_id", "window_length", "start_index").agg(packed.alias("_w")).filter(F.size("_w") == F.col("window_length"))
    return cut.select("source", "segment_id", "window_length", "start_index", *(F.col(f"_w._{i}").alias(c) for i, c in enumerate(columns)))


def window_starts(steps: DataFrame, lengths: list[int], stride: int, partition: tuple[str, ...] = ("source", "segment_id")) -> DataFrame:
    """Keys of all windows without their values, from step rows."""
    n = steps.groupBy(*partition).agg(F.count("*").cast("int").alias("n_steps"))
    return windows(n, [], lengths, stride)


def manifest(cut: DataFrame) -> DataFrame:
    """Key, place and interpolation of each window; ``cut`` has interp_mask and grid_t_us arrays."""
    made = F.aggregate("interp_mask", F.lit(0), lambda s, x: s + x)
    return cut.select(
        window_key("source", "segment_id", "start_index").alias("window_path"),
        "source",
        "segment_id",
        "window_length",
        "start_index",
        (F.col("start_index") + F.col("window_length") - 1).alias("end_index"),
        made.alias("interpolated_steps"),
        (made / F.col("window_length")).alias("interp_ratio"),
        F.element_at("grid_t_us", 1).alias("grid_start"),
        F.element_at("grid_t_us", -1).alias("grid_end"),
    )


def blocks(rows: DataFrame, partition: list[str], order: list[str], k: int, name: str = "block") -> DataFrame:
    """``k`` blocks of like size in order; extra rows go to the first ones. Ranks come in two levels, so no class is one task."""
    placed = ranked(rows, partition, [F.col(c) for c in order])
    size, extra, at = F.floor(F.col("_count") / k), F.col("_count") % k, F.col("_rank") - 1
    block = F.when(at < extra * (size + 1), F.floor(at / (size + 1))).otherwise(extra + F.floor((at - extra * (size + 1)) / F.greatest(size, F.lit(1)))) + 1
    return placed.select(*rows.columns, block.cast("int").alias(name))
