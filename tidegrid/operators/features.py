"""Features of ordered steps within a segment. Rolling frames end before the current row.

Values are scalars or arrays; rows come from ``segments.resampled``. With ``range_steps`` a
segment is worked on in ranges of so many steps, each with the steps before it that its
frames reach; ``step_index`` has no holes then.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges
from .vector_rows import over_rows, over_rows_before

FLOOR = 1e-6


class _Frames:
    """Steps and the window over the ``n`` before each."""

    def __init__(self, steps: DataFrame, n: int, range_steps: int | None) -> None:
        self.n, self.ranged = n, bool(range_steps)
        self.steps = ranges.with_halo(steps, "step_index", range_steps, n) if range_steps else steps
        self.order = Window.partitionBy("source", "segment_id", *([ranges.RANGE] if range_steps else [])).orderBy("step_index")

    def after(self, columns: dict[str, Column]) -> DataFrame:
        """The columns on rows that have n rows before them in their segment."""
        rows = self.steps.withColumns({"_r": F.row_number().over(self.order), **columns})
        if self.ranged:
            return rows.filter(~F.col("_halo") & (F.col("step_index") >= self.n)).drop("_r", "_halo", ranges.RANGE)
        return rows.filter(F.col("_r") > self.n).drop("_r")

    def means(self, value: str, of=lambda x: x) -> Column:
        """Mean of the n rows before, by element for arrays."""
        w, n = self.order.rowsBetween(-self.n, -1), self.n
        if not _is_array(self.steps, value):
            return F.avg(of(F.col(value))).over(w)
        rows = F.collect_list(value).over(w)
        total = F.aggregate(F.slice(rows, 2, n), F.transform(rows[0], lambda x: of(x.cast("double"))), lambda s, r: F.zip_with(s, r, lambda a, b: a + of(b.cast("double"))))
        return F.transform(total, lambda x: x / n)


def _is_array(steps: DataFrame, value: str) -> bool:
    return steps.schema[value].dataType.simpleString().startswith("array")


def first_difference(steps: DataFrame, value: str, range_steps: int | None = None) -> DataFrame:
    """``value`` less the one before; a segment's first row goes."""
    frames = _Frames(steps, 1, range_steps)
    before = F.lag(value).over(frames.order)
    diff = F.zip_with(value, before, lambda a, b: a - b) if _is_array(steps, value) else F.col(value) - before
    return frames.after({"_d": diff}).withColumn(value, F.col("_d")).drop("_d")


def ma_residual(steps: DataFrame, value: str, n: int, range_steps: int | None = None) -> DataFrame:
    """``value`` less the mean of the n rows before."""
    frames = _Frames(steps, n, range_steps)
    out = frames.after({"_m": frames.means(value)})
    diff = F.zip_with(value, "_m", lambda a, m: a - m) if _is_array(steps, value) else F.col(value) - F.col("_m")
    return out.withColumn(value, diff).drop("_m")


def rolling_std(steps: DataFrame, value: str, n: int, range_steps: int | None = None) -> DataFrame:
    """Population deviation of the n rows before, its variance at least ``FLOOR``."""
    frames = _Frames(steps, n, range_steps)
    if _is_array(steps, value):
        squares = F.zip_with("_q", F.transform("_m", lambda m: m * m), lambda q, m: F.sqrt(F.greatest(q - m, F.lit(FLOOR))))
        return frames.after({"_m": frames.means(value), "_q": frames.means(value, lambda x: x * x)}).withColumn(value, squares).drop("_m", "_q")
    return frames.after({"_v": F.var_pop(value).over(frames.order.rowsBetween(-n, -1))}).withColumn(value, F.sqrt(F.greatest("_v", F.lit(FLOOR)))).drop("_v")


def phase_sin_cos(steps: DataFrame, re: str, im: str, out: str = "features", kept: list[str] | None = None) -> DataFrame:
    """Sines, then cosines of the phases."""

    def make(z: list[np.ndarray]) -> np.ndarray:
        angle = np.arctan2(z[1], z[0])
        return np.concatenate([np.sin(angle), np.cos(angle)], axis=1)

    return over_rows(steps, [re, im], make, out, kept or steps.columns)


def phase_difference(steps: DataFrame, re: str, im: str, out: str = "features", kept: list[str] | None = None) -> DataFrame:
    """Angle of z[t] * conj(z[t-1]) by carrier, safe at the wrap; a segment's first row goes."""

    def make(z: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        (a, b), (p, q) = (m[at] for m in z), (m[at - 1] for m in z)
        return np.arctan2(b * p - a * q, a * p + b * q)

    return over_rows_before(steps, [re, im], 1, make, out, kept or steps.columns)


def phase_rolling_std(steps: DataFrame, re: str, im: str, n: int, out: str = "features", kept: list[str] | None = None) -> DataFrame:
    """Circular deviation of the phases of the n rows before: sqrt(-2 ln R), R within [1e-6, 1]."""

    def make(z: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        angle = np.arctan2(z[1], z[0])
        c, s = (sum(x[at - k] for k in range(1, n + 1)) / n for x in (np.cos(angle), np.sin(angle)))
        return np.sqrt(np.maximum(-2 * np.log(np.clip(np.sqrt(c * c + s * s), FLOOR, 1.0)), 0.0))

    return over_rows_before(steps, [re, im], n, make, out, kept or steps.columns)


def transformed(steps: DataFrame, feature: str, value: str, n: int = 10, range_steps: int | None = None) -> DataFrame:
    """The feature of that name: raw, diff, ma or std."""
    if feature == "raw":
        return steps
    if feature == "diff":
        return first_difference(steps, value, range_steps)
    if feature == "ma":
        return ma_residual(steps, value, n, range_steps)
    if feature == "std":
        return rolling_std(steps, value, n, range_steps)
    raise ValueError(f"unknown feature {feature}")
