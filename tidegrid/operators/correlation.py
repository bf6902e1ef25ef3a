"""Lagged self-correlation of complex segments.

For lag l, carrier c and time t: ``z[t] conj(z[t-l]) / (|z[t]| |z[t-l]| + eps)``, made real,
averaged over carriers and normalised by time column. A column depends only on its own
time and the rows before it, so one profile of a whole segment is computed; windows, also
those that cut first and correlate then, are slices of it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_rows import over_rows_before
from .windows import step_windows

EPS = 1e-6


def normalised_columns(columns: np.ndarray, mode: str, zero_on_empty: bool = True) -> np.ndarray:
    """Time columns (rows of the array) as shares: shifted or clamped to be non-negative, divided by their sums.

    A sum of at most ``EPS`` gives zeros, or the column as it is without ``zero_on_empty``.
    """
    if mode == "shift":
        columns = columns - np.minimum(columns.min(1, keepdims=True), 0.0)
    elif mode == "clamp":
        columns = np.maximum(columns, 0.0)
    elif mode != "none":
        raise ValueError(f"unknown normalisation {mode}")
    total = columns.sum(1, keepdims=True)
    full = total > EPS
    return np.where(full, columns / np.where(full, total, 1.0), 0.0 if zero_on_empty else columns)


def _real(x: np.ndarray, rho: str) -> np.ndarray:
    if rho == "real":
        return x.real
    if rho == "abs-real":
        return np.abs(x.real)
    if rho == "magnitude":
        return np.abs(x)
    raise ValueError(f"unknown mode {rho}")


def _lagged(z: np.ndarray, at: np.ndarray, lags: int, rho: str) -> np.ndarray:
    """Mean over carriers of the normalised products of rows ``at`` with each of the ``lags`` rows before them."""
    size = np.abs(z)
    out = np.empty((len(at), lags))
    for lag in range(1, lags + 1):
        out[:, lag - 1] = _real(z[at] * z[at - lag].conj() / (size[at] * size[at - lag] + EPS), rho).mean(1)
    return out


def lag_profile(steps: DataFrame, re: str, im: str, lags: int, rho: str = "real", mode: str = "shift", zero_on_empty: bool = True, kept: tuple[str, ...] = ()) -> DataFrame:
    """One row a time that has ``lags`` rows of as many carriers before it: (source, segment_id, step_index, ``kept``, profile of ``lags`` shares).

    Segments are dealt to tasks and stream through in order; what is carried from one
    batch to the next are the ``lags`` rows before it.
    """
    if lags < 1:
        raise ValueError("lags must be positive")
    normalised_columns(np.zeros((1, 1)), mode)
    _real(np.zeros(1, complex), rho)
    make = lambda z, at: normalised_columns(_lagged(z[0] + 1j * z[1], at, lags, rho), mode, zero_on_empty)
    return over_rows_before(steps, [re, im], lags, make, "profile", ["source", "segment_id", "step_index", *kept])


def profile_windows(profiles: DataFrame, length: int, stride: int, lags: int, paper_style: bool = False, kept: tuple[str, ...] = ()) -> DataFrame:
    """Windows of profile columns: (source, segment_id, start_index, sdp as time columns, arrays of ``kept``).

    Lag-first windows are ``length`` columns of the profile. Paper-style windows cut
    ``length`` packets first, so ``length - lags`` columns are left of each.
    """
    width = length - lags if paper_style else length
    if width < 1:
        raise ValueError("the window must be longer than the lags")
    cut = step_windows(profiles, ["profile", *kept], [width], stride)
    return cut.select("source", "segment_id", "start_index", F.col("profile").alias("sdp"), *kept)


#: What a window keeps of its steps: whether and when they were observed, and where they come from.
PROVENANCE = ("interp_mask", "grid_t_us", "actual_t_us", "source_row")


def profile_manifest(steps: DataFrame, length: int, stride: int, lags: int, paper_style: bool = False) -> DataFrame:
    """One row a window: its key, lags, columns, filled steps and their share, and its grid's ends.

    Paper-style windows are ``length`` steps from start_index on. Lag-first windows follow
    the ``lags`` steps that their first column looks back on; filled steps count from the
    window's own first step.
    """
    first = 0 if paper_style else lags
    cut = step_windows(steps, ["interp_mask", "grid_t_us"], [length + first], stride)
    own = lambda c: F.slice(c, first + 1, length)
    made = F.aggregate(own("interp_mask"), F.lit(0), lambda s, x: s + x)
    return cut.select(
        "source", "segment_id", "start_index",
        F.lit(length).alias("window_length"), F.lit(lags).alias("lag_steps"), F.lit(length - lags if paper_style else length).alias("wt"),
        made.alias("window_interp_count"), (made / length).alias("window_interp_ratio"),
        F.element_at(own("grid_t_us"), 1).alias("grid_start"), F.element_at(own("grid_t_us"), -1).alias("grid_end"),
    )


def context_windows(steps: DataFrame, length: int, stride: int, lags: int) -> DataFrame:
    """Per lag-first window: provenance arrays of its own steps (``current_``) and of them with the ``lags`` steps before (``context_``)."""
    cut = step_windows(steps, list(PROVENANCE), [length + lags], stride)
    return cut.select("source", "segment_id", "start_index", *(F.slice(c, lags + 1, length).alias(f"current_{c}") for c in PROVENANCE), *(F.col(c).alias(f"context_{c}") for c in PROVENANCE))


def context_places(windows: DataFrame, length: int, lags: int) -> DataFrame:
    """First and last step of a lag-first window and of the rows that its columns look back on."""
    return windows.withColumns({"first_step": F.col("start_index") + lags, "last_step": F.col("start_index") + lags + length - 1, "context_first_step": F.col("start_index")})
