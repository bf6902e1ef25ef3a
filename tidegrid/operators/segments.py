"""Gaps, segments and regular grids with fixed steps.

A log has a source, an order within it (``row_no``, file order, never time order) and a
time in microseconds. A row snaps when its gap to the row before is near a whole number
of grid steps, at most ``max_steps``; every other row but the first opens a segment.
Snapped rows are expanded to their steps, the missing ones filled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


@dataclass(frozen=True)
class Grid:
    """Step, tolerance (both in microseconds), most steps a gap may span, and fill: linear, ffill or nearest.

    With ``range_rows`` a source is scanned in ranges of so many row numbers (``ranges``), each
    in a task of its own; without, as one window.
    """

    step_us: int = 11_000
    tolerance_us: int = 4_000
    max_steps: int = 3
    fill: str = "linear"
    range_rows: int | None = None


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` to as many partitions as the session has for shuffles.

    For work on arrays, where few bytes take much time: the number is explicit, so that small
    partitions aren't joined, and later windows by the same keys need no other exchange.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), *keys)


def gaps(log: DataFrame, values: list[str] | None = None, range_rows: int | None = None) -> DataFrame:
    """``gap_us`` to the row before, null on a source's first row; with ``prev_{v}`` for each value."""
    if range_rows:
        return _ranged_gaps(log, values or [], range_rows).drop(ranges.RANGE)
    w = Window.partitionBy("source").orderBy("row_no")
    before = {f"prev_{v}": F.lag(v).over(w) for v in values or []}
    return log.withColumns({"gap_us": F.col("t_us") - F.lag("t_us").over(w)} | before)


def _ranged_gaps(log: DataFrame, values: list[str], range_rows: int) -> DataFrame:
    rows = ranges.with_previous(ranges.cut(log, "row_no", range_rows), ["source"], "row_no", ["t_us", *values])
    return rows.withColumns({"gap_us": F.col("t_us") - F.col("_prev.t_us")} | {f"prev_{v}": F.col(f"_prev.{v}") for v in values}).drop("_prev")


def with_vectors(gapped: DataFrame, vectors: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Rows of ``gaps`` over the columns ``on`` with the values of ``vectors``, which has one row a key, and ``prev_{v}``.

    So sorts and windows hold a key a row instead of its arrays and those of the row before.
    """
    before = vectors.select(*(F.col(k).alias(f"prev_{k}") for k in on), *(F.col(v).alias(f"prev_{v}") for v in values))
    met = gapped.join(vectors.select(*on, *values), on, "left").join(before, [f"prev_{k}" for k in on], "left")
    return met.drop(*on, *(f"prev_{k}" for k in on))


def snapped(gapped: DataFrame, grid: Grid) -> DataFrame:
    """``n_steps`` (half-even, -1 for a gap that isn't positive) and ``snapped``."""
    n = F.when(F.col("gap_us") > 0, F.bround(F.col("gap_us") / F.lit(float(grid.step_us)), 0).cast("long")).otherwise(F.lit(-1).cast("long"))
    near = (F.col("gap_us") > 0) & F.col("n_steps").between(1, grid.max_steps) & (F.abs(F.col("gap_us") - F.col("n_steps") * grid.step_us) <= grid.tolerance_us)
    return gapped.withColumn("n_steps", n).withColumn("snapped", F.coalesce(near, F.lit(False)))


def segmented(log: DataFrame, grid: Grid, values: list[str] | None = None) -> DataFrame:
    """Gaps, snaps, ``segment_id`` from 0, ``step`` within the segment and its first time ``t0_us``."""
    if grid.range_rows:
        rows = snapped(_ranged_gaps(log, values or [], grid.range_rows), grid)
        opens = F.col("gap_us").isNotNull() & ~F.col("snapped")
        rows = ranges.with_runs(rows, "row_no", opens, F.when(F.col("snapped"), F.col("n_steps")).otherwise(0), "t_us")
        return rows.withColumns({"segment_id": F.col("run").cast("int"), "step": F.col("total"), "t0_us": F.col("head")}).drop(ranges.RANGE, "run", "total", "head")
    run = Window.partitionBy("source").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy("source", "segment_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = snapped(gaps(log, values), grid)
    rows = rows.withColumn("segment_id", F.sum((F.col("gap_us").isNotNull() & ~F.col("snapped")).cast("int")).over(run).cast("int"))
    return rows.withColumns({"step": F.sum(F.when(F.col("snapped"), F.col("n_steps")).otherwise(0)).over(inside), "t0_us": F.first("t_us").over(inside)})


def _blend(rows: DataFrame, value: str, grid: Grid, observed: Column) -> Column:
    alpha = F.col("_i") / F.col("_n")
    now, before = F.col(value), F.col(f"prev_{value}")

    def mixed(a: Column, b: Column) -> Column:
        if grid.fill == "linear":
            return (1 - alpha) * a + alpha * b
        if grid.fill == "ffill":
            return a
        if grid.fill == "nearest":
            return F.when(alpha < 0.5, a).otherwise(b)
        raise ValueError(f"unknown fill {grid.fill}")

    kind = rows.schema[value].dataType.simpleString()
    made = F.zip_with(before, now, mixed).cast(kind) if kind.startswith("array") else mixed(before, now).cast(kind)
    return F.when(observed, now).otherwise(made)


def resampled(log: DataFrame, grid: Grid, values: list[str], vectors: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
    """Rows on the grid: step_index, grid_t_us, interp_mask, delta_t_ms, the values, and where they come from.

    ``actual_t_us`` and ``source_row`` are null on filled rows. ``delta_t_ms`` is 0 at a
    segment's start, the step on filled rows and the whole gap on the row after a gap.
    Complex values are two array columns, filled apart. Values may stand in ``vectors``, one
    row for each key ``on`` of the log: then the log is scanned without them.
    """
    held = log if vectors is None else vectors
    if not grid.range_rows and any(held.schema[v].dataType.simpleString().startswith("array") for v in values):
        log = spread(log, "source")
    rows = segmented(log, grid, values if vectors is None else on)
    if vectors is not None:
        rows = with_vectors(rows, vectors, on, values)
    rows = rows.withColumn("_n", F.when(F.col("snapped"), F.col("n_steps")).otherwise(F.lit(1).cast("long")))
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    seen = F.col("_i") == F.col("_n")
    at = F.col("step") - F.col("_n") + F.col("_i")
    delta = F.when(~F.col("snapped"), F.lit(0.0)).when(~seen, F.lit(grid.step_us / 1000.0)).otherwise(F.col("gap_us") / 1000.0)
    kept = [c for c in log.columns if c not in {"t_us", "row_no", *values, *(on or [])}]
    return rows.select(
        *kept,
        "segment_id",
        at.alias("step_index"),
        (F.col("t0_us") + at * grid.step_us).alias("grid_t_us"),
        F.when(seen, F.col("t_us")).alias("actual_t_us"),
        F.when(seen, F.col("row_no")).alias("source_row"),
        (~seen).cast("int").alias("interp_mask"),
        delta.alias("delta_t_ms"),
        *(_blend(rows, v, grid, seen).alias(v) for v in values),
    )


def to_segments(steps: DataFrame, columns: list[str]) -> DataFrame:
    """One row a segment: parallel arrays of ``columns`` in step order, and ``n_steps``.

    A segment is one row, as long as a source has packets without a split.
    """
    packed = F.array_sort(F.collect_list(F.struct("step_index", *columns)))
    rows = steps.groupBy("source", "segment_id").agg(packed.alias("_s"))
    return rows.select("source", "segment_id", F.size("_s").alias("n_steps"), *(F.col(f"_s.{c}").alias(c) for c in columns))
