"""Distribution statistics of gaps, channels, classes and carriers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .moments import deviation, vector_moments


def quantiles(values: DataFrame, by: list[str], value: str, points: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Exact interpolated quantiles by group, in columns named by ``points``; nulls don't count.

    For large groups: a mergeable sketch bounds each quantile's place from both sides, rows
    below the bounds are only counted, and the few rows between them are ranked. So no
    task holds a group's values; the rank must lie between the bounds, or the query fails.
    """
    rows = values.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    slack = 3.0 / accuracy
    ends = [(max(0.0, p - slack), min(1.0, p + slack)) for p in points.values()]
    at = sorted({e for pair in ends for e in pair})
    rough = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.percentile_approx("_v", at, accuracy).alias("_e"))
    few = F.col("_n") <= accuracy  # then the bounds of the sketch could leave out a neighbour of the quantile
    asked = [F.struct(F.lit(name).alias("q"), (F.col("_n") - 1).cast("double").alias("m"), F.lit(p).alias("p"), F.when(few, F.col("_least")).otherwise(F.col("_e")[at.index(a)]).alias("lo"), F.when(few, F.col("_most")).otherwise(F.col("_e")[at.index(b)]).alias("hi")) for (name, p), (a, b) in zip(points.items(), ends, strict=True)]
    same = [F.col(f"_by{i}").eqNullSafe(F.col(c)) for i, c in enumerate(by)]
    bounds = rough.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.array(*asked).alias("_asked"))
    met = rows.join(bounds, same) if by else rows.crossJoin(F.broadcast(bounds))  # one row of bounds
    near = met.withColumn("_q", F.explode("_asked")).filter(F.col("_v") <= F.col("_q.hi"))
    counted = near.groupBy(*by, "_q", F.when(F.col("_v") >= F.col("_q.lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*by, "_q.q").orderBy(F.asc_nulls_first("_v"))
    rank = F.col("_q.m") * F.col("_q.p")
    ranked = counted.withColumn("_up", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_v").isNotNull())
    holds = lambda k: F.max(F.when((F.col("_up") - F.col("_c") <= k) & (k < F.col("_up")), F.col("_v").cast("double")))
    found = ranked.groupBy(*by, "_q").agg(holds(F.floor(rank)).alias("_a"), holds(F.ceil(rank)).alias("_b"))
    part = rank - F.floor(rank)
    exact = F.coalesce(F.col("_a") + (F.col("_b") - F.col("_a")) * part, F.raise_error(F.lit("a quantile lies outside its bounds")))
    return found.withColumn("_x", exact).groupBy(*by).agg(*(F.max(F.when(F.col("_q.q") == name, F.col("_x"))).alias(name) for name in points))


def _with(stats: DataFrame, by: list[str], more: DataFrame) -> DataFrame:
    """Two tables of one row a group side by side."""
    if not by:
        return stats.crossJoin(more)  # one row each
    other = more.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), *(c for c in more.columns if c not in by))
    return stats.join(other, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]).drop(*(f"_by{i}" for i in range(len(by))))


def gap_summary(gapped: DataFrame, *by: str, gap: str = "gap_us") -> DataFrame:
    """Count, mean, median, population deviation, p90 and p99 of gaps; all gaps count, also those that aren't positive."""
    present = gapped.filter(F.col(gap).isNotNull())
    plain = present.groupBy(*by).agg(F.count("*").alias("n_gaps"), F.avg(gap).alias("mean_gap"), F.stddev_pop(gap).alias("std_gap"))
    return _with(plain, list(by), quantiles(present, list(by), gap, {"median_gap": 0.5, "p90_gap": 0.9, "p99_gap": 0.99}))


def placed(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``rows`` with each value's place in its group's ascending order from 0 (``_place``) and the group's values (``_count``); nulls come last.

    For rows that are dealt by ``by`` already: it takes a sort that can spill and no
    further shuffle, where the built-in percentile keeps a group's distinct values in memory.
    """
    w = Window.partitionBy(*by)
    place = F.count(F.lit(1)).over(w.orderBy(F.col(value).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)) - 1
    return rows.withColumns({"_count": F.count(value).over(w), "_place": place})


def at_rank(value: str, share: float, over: WindowSpec | None = None) -> Column:
    """The interpolated quantile of rows from ``placed``: an aggregate, or a window's value with ``over``."""
    at = F.lit(float(share)) * (F.col("_count") - 1)
    found = [F.max(c) for c in (F.when(F.col("_place") == F.floor(at), F.col(value)), F.when(F.col("_place") == F.ceil(at), F.col(value)), at - F.floor(at))]
    low, high, part = (c if over is None else c.over(over) for c in found)
    return (low + (high - low) * part).cast("double")


def file_stats(gapped: DataFrame, long_sources: bool = False) -> DataFrame:
    """Per source: rows, duration and gap statistics, null with fewer than two rows.

    With ``long_sources`` the quantiles are taken between the bounds of a sketch, so that no
    task gets a source's gaps.
    """
    if long_sources:
        plain = gapped.groupBy("source").agg(F.count("*").alias("row_count"), F.max_by("t_us", "row_no").alias("_b"), F.min_by("t_us", "row_no").alias("_a"), F.avg("gap_us").alias("mean_gap"))
        met = plain.join(quantiles(gapped, ["source"], "gap_us", {"median_gap": 0.5, "p90_gap": 0.9}), "source", "left")
        return met.select("source", "row_count", F.when(F.col("row_count") > 1, F.col("_b") - F.col("_a")).alias("duration_us"), "median_gap", "mean_gap", "p90_gap")
    return placed(gapped, ["source"], "gap_us").groupBy("source").agg(
        F.count("*").alias("row_count"),
        F.when(F.count("*") > 1, F.max_by("t_us", "row_no") - F.min_by("t_us", "row_no")).alias("duration_us"),
        at_rank("gap_us", 0.5).alias("median_gap"),
        F.avg("gap_us").alias("mean_gap"),
        at_rank("gap_us", 0.9).alias("p90_gap"),
    )


def two_level(stats: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, median and population deviation of per-file values by group; groups without values are left out."""
    return stats.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n_files"), F.avg(value).alias("mean_value"), F.median(value).alias("median_value"), F.stddev_pop(value).alias("std_value"))


def totals(files: DataFrame, by: list[str], rows: str = "row_count") -> DataFrame:
    return files.groupBy(*by).agg(F.count("*").alias("n_files"), F.sum(rows).alias("n_rows"))


def rollup_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Counts by the columns, by each prefix of them, and in all; nulls stand for all."""
    return rows.rollup(*by).agg(F.count("*").alias("n"))


def histogram(values: DataFrame, value: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts and density in equal bins from least to largest value; the largest belongs to the last bin."""
    by = by or []
    span = values.filter(F.col(value).isNotNull()).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count("*").alias("_n"))
    width = (F.col("_high") - F.col("_low")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_low")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    binned = values.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(span)).withColumns({"bin": place, "_width": width})  # one row of bounds
    counts = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.first("_width").alias("_w"), F.first("_low").alias("_l"))
    share = F.sum("n").over(Window.partitionBy(*by)) if by else F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select(*by, "bin", (F.col("_l") + F.col("bin") * F.col("_w")).alias("low"), "n", F.when(F.col("_w") > 0, F.col("n") / (share * F.col("_w"))).alias("density"))


def log_gap_ms(gap_us: Column | str) -> Column:
    gap_us = F.col(gap_us) if isinstance(gap_us, str) else gap_us
    return F.log10(F.greatest(gap_us / 1000.0, F.lit(1e-3)))


def box_stats(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles by group, and the outermost values within 1.5 quartile ranges."""
    present = values.filter(F.col(value).isNotNull())
    q = quantiles(present, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    near = F.col(value).between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return _with(present, by, q).groupBy(*by).agg(
        F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("q1", "median", "q3")),
        F.min(F.when(near, F.col(value))).alias("whisker_low"), F.max(F.when(near, F.col(value))).alias("whisker_high"),
    )


def gap_bucket(gap: Column | str, step: int, tolerance: int, most: int = 3) -> Column:
    """``1x`` to ``{most}x`` and ``{most + 1}x+`` for gaps near a multiple of the step, else ``off_grid``."""
    gap = F.col(gap) if isinstance(gap, str) else gap
    n = F.bround(gap / float(step), 0).cast("long")
    near = (n >= 1) & (F.abs(gap - n * step) <= tolerance)
    return F.when(near & (n <= most), F.concat(n.cast("string"), F.lit("x"))).when(near, F.lit(f"{most + 1}x+")).otherwise("off_grid")


def bucket_counts(gapped: DataFrame, step: int, tolerance: int, most: int = 3) -> DataFrame:
    """Gaps by bucket with their share."""
    counts = gapped.filter(F.col("gap_us").isNotNull()).groupBy(gap_bucket("gap_us", step, tolerance, most).alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # a few rows


def trimmed_groups(gapped: DataFrame, value: str, gap: str = "gap_us", parts: tuple[str, str] | None = None, attach: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Gaps up to the 99th percentile in small and large groups (quartiles): count, mean gap, mean absolute value change.

    ``parts`` names real and imaginary arrays (with ``prev_`` ones): then also ``complex_rmse``,
    the root of the mean squared distance between a row's carriers and the row's before.
    ``attach`` adds the arrays to rows that lack them; they are met once the quantiles are known.
    """
    present = gapped.filter(F.col(gap).isNotNull())
    cuts = quantiles(present, [], gap, {"_a": 0.25, "_b": 0.75, "_z": 0.99})
    rows = present.crossJoin(F.broadcast(cuts)).filter(F.col(gap) <= F.col("_z"))  # one row of cuts
    group = F.when(F.col(gap) <= F.col("_a"), "small").when(F.col(gap) >= F.col("_b"), "large").otherwise("middle")
    more = []
    if attach:
        rows = attach(rows)
    if parts:
        apart = lambda x, y: x.cast("double") - y.cast("double")
        off = [F.aggregate(F.zip_with(c, f"prev_{c}", lambda x, y: apart(x, y) * apart(x, y)), F.lit(0.0), lambda s, x: s + x) for c in parts]
        more = [F.sqrt(F.sum(off[0] + off[1]) / F.sum(F.size(parts[0]))).alias("complex_rmse")]
    return rows.groupBy(group.alias("gap_group")).agg(F.count("*").alias("n"), F.avg(gap).alias("mean_gap"), F.avg(F.abs(F.col(value) - F.col(f"prev_{value}"))).alias("mean_change"), *more)


def channel_stats(rows: DataFrame, vector: str, policy: str = "floor", by: list[str] | None = None) -> DataFrame:
    """Count, mean and population deviation by channel in one pass over whole vectors.

    ``floor`` keeps variances at 1e-6 or more; ``unit`` turns deviations under 1e-6 into 1.
    """
    std = deviation(policy)
    return vector_moments(rows, vector, by).select(*(by or []), "channel", "n", "mean", std.alias("std"))


def train_stats(rows: DataFrame, vector: str, delta: str | None = "delta_t_ms") -> DataFrame:
    """One row: means and floored deviations by channel, and those of ``delta``, which is scaled apart (0 and 1 without it)."""
    v = F.col(vector).cast("array<double>")
    stats = vector_moments(rows, F.concat(F.array(F.col(delta).cast("double") if delta else F.lit(None).cast("double")), v))
    packed = stats.withColumn("std", deviation("floor")).agg(F.array_sort(F.collect_list(F.struct("channel", "mean", "std"))).alias("_s"))
    own = F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0)))
    first = lambda c, none: F.coalesce(F.try_element_at("_s", F.lit(1))[c], F.lit(none))
    return packed.select(own["mean"].alias("means"), own["std"].alias("stds"), first("mean", 0.0).alias("delta_mean"), first("std", 1.0).alias("delta_std"))


def packed_stats(stats: DataFrame) -> DataFrame:
    """One row: arrays of means and deviations in channel order."""
    rows = stats.agg(F.array_sort(F.collect_list(F.struct("channel", "mean", "std"))).alias("_s"))
    return rows.select(F.col("_s.mean").alias("means"), F.col("_s.std").alias("stds"))


def _cell_moments(rows: DataFrame, matrix: str, by: list[str]) -> DataFrame:
    """Moments by group, row and column of matrices whose rows are equally long; those of another width are counted apart."""
    flat = rows.select(*by, F.size(F.get(F.col(matrix), F.lit(0))).alias("_w"), F.flatten(matrix).alias("_m")).filter("_w > 0")
    cells = vector_moments(flat, "_m", [*by, "_w"])
    return cells.withColumns({"row": F.floor(F.col("channel") / F.col("_w")).cast("int"), "column": (F.col("channel") % F.col("_w")).cast("int")}).drop("_w", "channel")


def pixel_stats(rows: DataFrame, matrix: str) -> DataFrame:
    """Mean and floored deviation by cell of a matrix column."""
    return _cell_moments(rows, matrix, []).select("row", "column", "mean", deviation("floor").alias("std"))


def class_heatmap(rows: DataFrame, matrix: str, label: str) -> DataFrame:
    """Mean and deviation by class and cell, with the least and largest of each over all classes: the shared scale of their maps."""
    maps = _cell_moments(rows, matrix, [label]).select(label, "row", "column", "mean", deviation().alias("std"))
    scale = maps.agg(*(f(c).alias(f"{c}_{name}") for c in ("mean", "std") for name, f in (("min", F.min), ("max", F.max))))
    return maps.crossJoin(F.broadcast(scale))  # one row of bounds


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """total / (classes * count) by class."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    all_ = Window.partitionBy(F.lit(0))
    return counts.withColumn("weight", F.sum("n").over(all_) / (F.count("*").over(all_) * F.greatest("n", F.lit(1))))


def temporal_variation(cut: DataFrame, value: str) -> DataFrame:
    """Per window of scalars: mean absolute step change, and population deviation over time."""
    v = F.col(value)
    n = F.size(v)
    change = F.aggregate(F.zip_with(F.slice(v, 2, F.greatest(n - 1, F.lit(0))), F.slice(v, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    total = lambda f: F.aggregate(v, F.lit(0.0), lambda s, x: s + f(x))
    mean = total(lambda x: x) / n
    return cut.withColumn("mean_change", F.when(n > 1, change / (n - 1))).withColumn("_m", mean).withColumn("time_std", F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - F.col("_m")) * (x - F.col("_m"))) / n)).drop("_m")


def vector_variation(cut: DataFrame, value: str) -> DataFrame:
    """Per window of vectors: mean absolute step change, and the mean over carriers of their deviation over time; null for windows of no or ragged vectors."""

    @F.pandas_udf("mean_change double, time_std double")
    def vary(windows: pd.Series) -> pd.DataFrame:
        out = []
        for w in windows:
            ragged = w is None or len(w) == 0 or len({-1 if v is None else len(v) for v in w}) > 1 or w[0] is None or len(w[0]) == 0
            x = None if ragged else np.stack(w).astype(float)
            out.append((None, None) if ragged else (float(np.abs(np.diff(x, axis=0)).mean()) if len(x) > 1 else None, float(x.std(0).mean())))
        return pd.DataFrame(out, columns=["mean_change", "time_std"], index=windows.index)

    return cut.withColumn("_v", vary(value)).select(*cut.columns, "_v.mean_change", "_v.time_std")


def carrier_summary(packets: DataFrame, amplitude: str, phase: str) -> DataFrame:
    """Mean and deviation of amplitude and deviation of phase, by carrier; both vectors have as many."""
    both = packets.select(F.size(amplitude).alias("_w"), F.concat(F.col(amplitude).cast("array<double>"), F.col(phase).cast("array<double>")).alias("_b")).filter("_w > 0")
    cells = vector_moments(both, "_b", ["_w"]).withColumns({"carrier": (F.col("channel") % F.col("_w")).cast("int"), "_phase": F.col("channel") >= F.col("_w"), "_std": deviation()})
    pick = lambda c, phase: F.max(F.when(F.col("_phase") == phase, F.col(c)))
    return cells.groupBy("_w", "carrier").agg(pick("mean", False).alias("mean_amplitude"), pick("_std", False).alias("std_amplitude"), pick("_std", True).alias("std_phase")).drop("_w")


def amplitude_phase_summary(packets: DataFrame, by: list[str], re: str, im: str) -> DataFrame:
    """Rows, mean and deviation of amplitude and deviation of phase over all cells of a group's complex rows."""
    cell = F.explode(F.arrays_zip(F.col(re).cast("array<double>").alias("r"), F.col(im).cast("array<double>").alias("i")))
    cells = packets.select(*by, cell.alias("z")).select(*by, F.sqrt(F.col("z.r") * F.col("z.r") + F.col("z.i") * F.col("z.i")).alias("_a"), F.atan2("z.i", "z.r").alias("_p"))
    found = cells.groupBy(*by).agg(F.avg("_a").alias("amplitude_mean"), F.stddev_pop("_a").alias("amplitude_std"), F.stddev_pop("_p").alias("phase_std"))
    return _with(packets.groupBy(*by).agg(F.count("*").alias("rows_used")), by, found)


def build_counters(steps: DataFrame, cut: DataFrame, files: DataFrame, shrunk: int = 0) -> DataFrame:
    """Files, segments before and after a feature that takes ``shrunk`` steps, and windows, by split and label.

    ``files`` has source, split and label of every file, also of those without a step.
    """
    sized = steps.groupBy("source", "segment_id").agg(F.count("*").alias("_n"))
    by_file = sized.groupBy("source").agg(F.count("*").alias("_before"), F.sum((F.col("_n") > shrunk).cast("long")).alias("_after"))
    made = cut.groupBy("source").agg(F.count("*").alias("_windows"))
    rows = files.select("source", "split", "label").join(by_file, "source", "left").join(made, "source", "left")
    none = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return rows.groupBy("split", "label").agg(F.count("*").alias("files_seen"), F.count("_before").alias("files_with_segments"), none("_before").alias("segments_before"), none("_after").alias("segments_after"), none("_windows").alias("windows"))


def convergence(history: DataFrame, patience: int = 10) -> DataFrame:
    """Per run: best epoch (first on ties), its accuracy, the last gap between training and validation, and epochs left when patience ran out."""
    best = history.groupBy("run").agg(
        F.max(F.struct("validation_accuracy", (-F.col("epoch")).alias("back"))).alias("_b"),
        F.max("epoch").alias("last_epoch"),
        F.max_by(F.col("train_accuracy") - F.col("validation_accuracy"), "epoch").alias("final_gap"),
    )
    return best.select("run", (-F.col("_b.back")).alias("best_epoch"), F.col("_b.validation_accuracy").alias("best_accuracy"), "final_gap", F.greatest(F.col("last_epoch") + F.col("_b.back") - patience, F.lit(0)).alias("epochs_past_patience"))
