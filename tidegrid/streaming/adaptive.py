"""Adaptive segmentation of a stream of packets.

State per source: the last time, the moving base gap and the segment; before the base is
known, the packets that wait for it, until so many positive gaps are there or the source
has been silent for a while. So memory doesn't grow with the stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.adaptive import Adaptive, advanced

ROWS = "source string, row_no long, gap_us long, k int, base_gap_us double, segment_id int, split_reason string"
NAMES = [c.split()[0] for c in ROWS.split(", ")]


class AdaptiveProcessor(StatefulProcessor):
    """Rows as ``adaptive_segments`` gives them; ``silent_ms`` closes the wait for a base."""

    def __init__(self, a: Adaptive, silent_ms: int | None) -> None:
        self.a, self.silent_ms = a, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", "t_us long, base double, segment int")
        self.held = handle.getListState("held", "row_no long, t_us long")

    def _rows(self, source: str, packets: list[tuple[int, int]], last: tuple[int, float, int] | None, base: float = 0.0) -> pd.DataFrame:
        """The packets' rows; ``last`` is the fold before them, None for a source's first one."""
        out, (t, base, segment) = [], last or (None, base, 0)
        for row, now in packets:
            if t is None:
                out.append((source, row, None, None, base, 0, None))
            else:
                used = base
                k, reason, base, segment = advanced(now - t, base, segment, self.a)
                out.append((source, row, now - t, k, used, segment, reason))
            t = now
        self.fold.update((t, base, segment))
        return pd.DataFrame(out, columns=NAMES).astype({"gap_us": "Int64", "k": "Int32", "split_reason": object})

    def _first_gaps(self, packets: list[tuple[int, int]]) -> list[int]:
        gaps = [b[1] - a[1] for a, b in zip(packets, packets[1:], strict=False)]
        return [g for g in gaps if g > 0][: self.a.initial_gaps]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values("row_no", kind="stable")
        packets = list(zip(new["row_no"].astype(int).tolist(), new["t_us"].astype(int).tolist(), strict=True))
        if self.fold.exists():
            yield self._rows(key[0], packets, tuple(self.fold.get()))
            return
        for timer in self.handle.listTimers() if self.silent_ms else ():
            self.handle.deleteTimer(timer)
        packets = [*((int(r[0]), int(r[1])) for r in self.held.get()), *packets]
        first = self._first_gaps(packets)
        if len(first) >= self.a.initial_gaps:
            self.held.clear()
            yield self._rows(key[0], packets, None, float(median(first)))
        else:
            self.held.put(packets)
            if self.silent_ms:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        packets = [(int(r[0]), int(r[1])) for r in self.held.get()]
        self.held.clear()
        first = self._first_gaps(packets)
        yield self._rows(key[0], packets, None, float(median(first)) if first else 0.0)

    def close(self) -> None:
        pass


def adaptive_stream(packets: DataFrame, a: Adaptive, silent_ms: int | None = 3_600_000) -> DataFrame:
    """Segments of a stream of (source, row_no, t_us), as ``adaptive_segments`` gives them of a log.

    A source's packets arrive in the order of ``row_no`` from batch to batch; within a batch
    they are sorted. A source that is silent for ``silent_ms`` before it has its first gaps
    takes what it has; with None it waits on, and the query can end with its input
    (``availableNow``), which timers don't let it. It needs the RocksDB state store.
    """
    keyed = packets.select(F.col("source").cast("string").alias("source"), F.col("row_no").cast("long").alias("row_no"), F.col("t_us").cast("long").alias("t_us"))
    return keyed.groupBy("source").transformWithStateInPandas(AdaptiveProcessor(a, silent_ms), ROWS, "append", "processingTime" if silent_ms else "none")
