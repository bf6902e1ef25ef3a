"""Fixed-grid segmentation and resampling of a stream of packets.

State per source: the last packet, its segment and step, so memory doesn't grow with the
stream. A gap is filled when the packet after it arrives; a packet that arrives out of
order has a gap that isn't positive and opens a segment, as in a log's file order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.segments import Grid

STEPS = "source string, segment_id int, step_index long, grid_t_us long, actual_t_us long, interp_mask int, delta_t_ms double, amp double"
STATE = "t_us long, amp double, segment_id int, step long, t0_us long"


def resampled_stream(packets: DataFrame, grid: Grid, timeout: GroupStateTimeout = GroupStateTimeout.NoTimeout) -> DataFrame:
    """Steps of a stream of (source, t_us, amp); packets of one batch are taken in their order of arrival column ``row_no``."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("row_no", kind="stable")
        out = []
        for t, amp in zip(rows["t_us"], rows["amp"], strict=True):
            t, amp = int(t), float(amp)
            if held is None:
                held = (t, amp, 0, 0, t)
                out.append((key[0], 0, 0, t, t, 0, 0.0, amp))
                continue
            last, before, segment, step, t0 = held
            gap = t - last
            n = round(gap / grid.step_us) if gap > 0 else -1  # half-even
            if gap > 0 and 1 <= n <= grid.max_steps and abs(gap - n * grid.step_us) <= grid.tolerance_us:
                for i in range(1, n + 1):
                    a, seen = i / n, i == n
                    fill = (1 - a) * before + a * amp if grid.fill == "linear" else before if grid.fill == "ffill" or a < 0.5 else amp
                    out.append((key[0], segment, step + i, t0 + grid.step_us * (step + i), t if seen else None, int(not seen), gap / 1000.0 if seen else grid.step_us / 1000.0, amp if seen else fill))
                held = (t, amp, segment, step + n, t0)
            else:
                held = (t, amp, segment + 1, 0, t)
                out.append((key[0], segment + 1, 0, t, t, 0, 0.0, amp))
        if held is not None:
            state.update(held)
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in STEPS.split(", ")])
        yield frame.astype({"actual_t_us": "Int64"})

    keyed = packets.select(F.col("source").cast("string").alias("source"), "row_no", "t_us", F.col("amp").cast("double").alias("amp"))
    return keyed.groupBy("source").applyInPandasWithState(advance, STEPS, STATE, "append", timeout)


def windowed_gap_stats(packets: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Packets and mean amplitude by source and time window; packets later than the watermark are dropped."""
    return packets.withWatermark(time, late).groupBy("source", F.window(time, width)).agg(F.count("*").alias("n"), F.avg("amp").alias("mean_amp"))
