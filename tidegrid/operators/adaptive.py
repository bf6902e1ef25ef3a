"""Segmentation with a base gap that follows the log.

A gap is k steps when it is within tolerance of k times the base gap, k with the least
relative error, the lowest on ties. Each one-step gap moves the base by an exponential
mean. The state makes this an ordered fold over a source's gaps: rows stream through in
order, and the base and the segment are all that is carried from one to the next.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from .segments import gaps


@dataclass(frozen=True)
class Adaptive:
    max_steps: int = 3
    ema_span: int = 50
    initial_gaps: int = 50
    relative: float = 0.18
    absolute_us: float = 4_000.0
    long_factor: float = 3.5


def base_gaps(log: DataFrame, initial_gaps: int, range_rows: int | None = None) -> DataFrame:
    """(source, base_gap_us): median of the first positive gaps; sources without one are left out.

    A task sends at most ``initial_gaps`` rows of a source.
    """
    w = Window.partitionBy("source").orderBy("row_no")
    positive = gaps(log, range_rows=range_rows).filter("gap_us > 0").withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= initial_gaps)
    return positive.groupBy("source").agg(F.median("gap_us").alias("base_gap_us"))


def fitted(gap: int, base: float, a: Adaptive) -> int | None:
    """k of a gap, None where no k from 1 to ``max_steps`` fits."""
    best, found = math.inf, None
    if gap > 0 and base > 0:
        for k in range(1, a.max_steps + 1):
            want = base * k
            off = abs(gap - want)
            if off <= max(a.absolute_us, want * a.relative) and off / want < best:
                best, found = off / want, k
    return found


def advanced(gap: int, base: float, segment: int, a: Adaptive) -> tuple[int | None, str | None, float, int]:
    """What a gap is, k or the reason of a split, and the base and the segment after it."""
    k = fitted(gap, base, a)
    if k is None:
        return None, "nonpositive" if gap <= 0 else "long" if 0 < base * a.long_factor < gap else "unmatched", base, segment + 1
    if k == 1:
        alpha = 2.0 / (a.ema_span + 1.0)
        base = alpha * gap + (1.0 - alpha) * base
    return k, None, base, segment


def adaptive_segments(log: DataFrame, a: Adaptive) -> DataFrame:
    """(source, row_no, gap_us, k, base_gap_us, segment_id, split_reason) of every row.

    ``k`` is null on a source's first row and on splits; ``base_gap_us`` is the base that
    the gap was held against; split_reason is nonpositive, long or unmatched.
    """
    w = Window.partitionBy("source").orderBy("row_no")
    rows = gaps(log).select("source", F.col("row_no").cast("long").alias("row_no"), F.col("gap_us").cast("long").alias("gap_us"), F.row_number().over(w).alias("_n"))
    rows = rows.join(base_gaps(log, a.initial_gaps).withColumnRenamed("base_gap_us", "_first"), "source", "left")
    rows = rows.repartition("source").sortWithinPartitions("source", "_n")
    added = [("k", pa.int32()), ("base_gap_us", pa.float64()), ("split_reason", pa.string()), ("segment_id", pa.int32())]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, segment = 0.0, 0
        for batch in batches:
            out: list[tuple] = []
            for n, gap, first in zip(*(batch.column(c).to_pylist() for c in ("_n", "gap_us", "_first")), strict=True):
                if n == 1:
                    base, segment = first or 0.0, 0
                    out.append((None, base, None, 0))
                    continue
                k = reason = None
                used = base
                if gap is not None:
                    k, reason, base, segment = advanced(gap, base, segment, a)
                out.append((k, used, reason, segment))
            columns = zip(*out, strict=True) if out else [()] * len(added)
            kept = ["source", "row_no", "gap_us"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c, t) for c, (_, t) in zip(columns, added, strict=True))], names=[*kept, *(c for c, _ in added)])

    schema = StructType([*rows.select("source", "row_no", "gap_us").schema, *(StructField(c, from_arrow_type(t)) for c, t in added)])
    return rows.mapInArrow(fold, schema)


def adaptive_resampled(log: DataFrame, a: Adaptive, values: list[str]) -> DataFrame:
    """Rows of adaptive segments with gaps filled linearly; grid times advance by gap / k."""
    w = Window.partitionBy("source").orderBy("row_no")
    rows = log.withColumns({f"prev_{v}": F.lag(v).over(w) for v in values}).join(adaptive_segments(log, a), ["source", "row_no"])
    inside = Window.partitionBy("source", "segment_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    k = F.coalesce("k", F.lit(1))
    gap = F.when(F.col("k").isNotNull(), F.col("gap_us")).otherwise(0)
    rows = rows.withColumns({"_k": k, "_t0": F.first("t_us").over(inside), "_end": F.sum(gap).over(inside), "_gap": gap, "_step": F.sum(F.coalesce("k", F.lit(0))).over(inside)})
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_k"))))
    seen, share = F.col("_i") == F.col("_k"), F.col("_i") / F.col("_k")

    def blend(v: str) -> Column:
        mixed = lambda x, y: (1 - share) * x + share * y
        kind = log.schema[v].dataType.simpleString()
        made = F.zip_with(f"prev_{v}", v, mixed).cast(kind) if kind.startswith("array") else mixed(F.col(f"prev_{v}"), F.col(v)).cast(kind)
        return F.when(seen, F.col(v)).otherwise(made)

    return rows.select(
        "source",
        "segment_id",
        F.when(F.col("k").isNull(), F.lit(0)).otherwise(F.col("_step") - F.col("_k") + F.col("_i")).cast("long").alias("step_index"),
        F.when(F.col("k").isNull(), F.col("t_us")).otherwise(F.bround(F.col("_t0") + F.col("_end") - F.col("_gap") + F.col("_gap") * share).cast("long")).alias("grid_t_us"),
        (~seen).cast("int").alias("interp_mask"),
        F.when(F.col("k").isNull(), 0.0).otherwise(F.col("_gap") / F.col("_k") / 1000.0).alias("delta_t_ms"),
        F.when(seen, F.col("row_no")).alias("source_row"),
        *(blend(v).alias(v) for v in values),
    )


def adaptive_counters(log: DataFrame, a: Adaptive) -> DataFrame:
    """One row: sources, segments, the k histogram, moves of the base, split reasons, filled points and the mean first base gap."""
    rows = adaptive_segments(log, a)
    count = lambda c: F.sum(c.cast("int"))
    total = rows.agg(
        F.countDistinct("source").alias("sources"),
        (F.countDistinct("source") + F.count("split_reason")).alias("segments"),
        *(F.coalesce(count(F.col("k") == k), F.lit(0)).alias(f"classified_k{k}") for k in range(1, a.max_steps + 1)),
        F.coalesce(count(F.col("k") == 1), F.lit(0)).alias("ema_updates"),
        F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("interpolated_points"),
        *(F.coalesce(count(F.col("split_reason") == r), F.lit(0)).alias(f"{r}_gap_splits") for r in ("nonpositive", "long", "unmatched")),
    )
    return total.crossJoin(base_gaps(log, a.initial_gaps).agg(F.avg("base_gap_us").alias("mean_initial_gap_us")))  # one row each
