"""Robust normalisation and outlier filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .statistics import at_rank, placed, quantiles

EPS = 1e-8


def scale_factor(low: Column | str, high: Column | str, low_at: Sequence[int] = V.OVERLAP_LLTF, high_at: Sequence[int] = V.OVERLAP_HTLTF) -> Column:
    """Median of high / low amplitudes over shared carriers.

    Carriers with a low amplitude of at most ``EPS`` don't count; null where none is left
    or the factor isn't above ``EPS``.
    """
    ratios = F.zip_with(V.gather(low, low_at), V.gather(high, high_at), lambda a, b: F.when(a > EPS, b.cast("double") / a))
    fine = F.filter(ratios, lambda r: r.isNotNull() & ~F.isnan(r) & (F.abs(r) < float("inf")))
    return V.let(V.median(fine), lambda m: F.when(m > EPS, m))


def normalised_amplitude(high: Column | str, scale: Column | str) -> Column:
    scale = F.col(scale) if isinstance(scale, str) else scale
    return F.when(scale.isNotNull(), F.transform(high, lambda x: x / scale))


def normalised_complex(re: Column | str, im: Column | str, scale: Column | str) -> tuple[Column, Column]:
    """Both parts divided; the phase stays."""
    return normalised_amplitude(re, scale), normalised_amplitude(im, scale)


def mad_scores(packets: DataFrame, strength: Column | str = "strength", long_sources: bool = False) -> DataFrame:
    """``packets`` with ``mad_score``: distance from the source's median in scaled median deviations.

    ``strength`` is a packet's mean amplitude. The scale is 1.4826 times the median absolute
    deviation, at least 1e-6. Both medians are taken by rank over one deal by source, in
    sorts that can spill; with ``long_sources`` between the bounds of a sketch, so that no
    task gets a source's rows.
    """
    s = F.col(strength) if isinstance(strength, str) else strength
    if long_sources:
        rows = packets.withColumn("_strength", s.cast("double"))
        off = F.abs(F.col("_strength") - F.col("_m"))
        centred = rows.join(quantiles(rows, ["source"], "_strength", {"_m": 0.5}), "source").withColumn("_off", off).drop("_m")
        scaled = centred.join(quantiles(centred, ["source"], "_off", {"_d": 0.5}), "source")
        return scaled.withColumn("mad_score", F.col("_off") / F.greatest(F.lit(1.4826) * F.col("_d"), F.lit(1e-6))).select(*packets.columns, "mad_score")
    w = Window.partitionBy("source")
    ranked = placed(packets.withColumn("_strength", s.cast("double")), ["source"], "_strength")
    centred = ranked.withColumn("_off", F.abs(F.col("_strength") - at_rank("_strength", 0.5, w))).drop("_place", "_count")
    scale = F.greatest(F.lit(1.4826) * at_rank("_off", 0.5, w), F.lit(1e-6))
    return placed(centred, ["source"], "_off").withColumn("mad_score", F.col("_off") / scale).drop("_strength", "_off", "_place", "_count")


def mad_filtered(packets: DataFrame, most: float, strength: Column | str = "strength", long_sources: bool = False) -> DataFrame:
    """Packets with a score of at most ``most``. It runs before gaps are taken: removals widen them."""
    return mad_scores(packets, strength, long_sources).filter(F.col("mad_score") <= most).drop("mad_score")
