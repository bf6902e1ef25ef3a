"""Means and deviations of vectors by element, as mergeable moments.

A task folds its Arrow batches into (n, mean, sum of squared differences) arrays, a row a
group; parts are merged by Chan's rule in two levels. A packet with 228 carriers is one
row all along, not 228.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-6
PART = "_n array<long>, _mean array<double>, _m2 array<double>"


def merged(n: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Moments of all parts together, by element; parts are rows."""
    total = n.sum(0)
    share = n / np.maximum(total, 1)
    centre = (share * mean).sum(0)
    return total, centre, m2.sum(0) + (n * (mean - centre) ** 2).sum(0)


def of_batch(x: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Moments of the columns of ``x`` over the cells that are ``there``."""
    n = there.sum(0)
    mean = np.where(there, x, 0.0).sum(0) / np.maximum(n, 1)
    return n, mean, (np.where(there, x - mean, 0.0) ** 2).sum(0)


def _padded(parts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(parts), max(map(len, parts), default=0)))
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out


def _rectangle(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values, a row a list, and which cells are there: null lists, null elements and the ends of short lists aren't."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    there = np.arange(size.max(initial=0))[None] < size[:, None]
    x = np.zeros(there.shape)
    values = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    x[there] = values
    if flat.null_count:
        valid = there.copy()
        valid[there] = flat.is_valid().to_numpy(zero_copy_only=False)
        there = valid
    return x, there


def vector_moments(rows: DataFrame, vector: Column | str, by: list[str] | None = None, salts: int = 64) -> DataFrame:
    """(by, channel, n, mean, m2): by element of ``vector``, whose nulls don't count; m2 is the sum of squared differences.

    Vectors may differ in length. Tasks' parts meet by ``salts`` first, so that no task gets
    one row of every task.
    """
    by = by or []
    table = rows.select(*by, (F.col(vector) if isinstance(vector, str) else vector).alias("_v"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields[: len(by)]]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple]] = {}
        types = None
        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            x, there = _rectangle(batch.column("_v"))
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * batch.num_rows
            names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            of = np.fromiter((names[k] for k in keys), np.int64, len(keys))
            for k, i in names.items():
                own = of == i
                held.setdefault(k, []).append(of_batch(x[own], there[own]))
                if len(held[k]) > 64:
                    held[k] = [merged(*map(_padded, zip(*held[k], strict=True)))]
        if held:
            parts = [merged(*map(_padded, zip(*p, strict=True))) for p in held.values()]
            columns = [pa.array([k[i] for k in held], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([p[0].astype(np.int64) for p in parts], pa.list_(pa.int64())), *(pa.array([p[j] for p in parts], pa.list_(pa.float64())) for j in (1, 2))], names=[*by, "_n", "_mean", "_m2"])

    def merge(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return merged(*(_padded([np.asarray(x, float) for x in group[c]]) for c in ("_n", "_mean", "_m2")))

    def salted(group: pd.DataFrame) -> pd.DataFrame:
        n, mean, m2 = merge(group)
        return pd.DataFrame([[*(group[c].iloc[0] for c in by), n.astype(np.int64).tolist(), mean.tolist(), m2.tolist()]], columns=[*by, "_n", "_mean", "_m2"])

    def last(group: pd.DataFrame) -> pd.DataFrame:
        n, mean, m2 = merge(group)
        frame = {c: [group[c].iloc[0]] * len(n) for c in by}
        return pd.DataFrame(frame | {"channel": np.arange(len(n), dtype=np.int32), "n": n.astype(np.int64), "mean": [m if c else None for m, c in zip(mean, n, strict=True)], "m2": [s if c else None for s, c in zip(m2, n, strict=True)]})

    parts = table.mapInArrow(fold, ", ".join([*kinds, PART])).withColumn("_salt", F.spark_partition_id() % salts)
    some = parts.groupBy(*by, "_salt").applyInPandas(salted, ", ".join([*kinds, PART]))
    return some.groupBy(*by).applyInPandas(last, ", ".join([*kinds, "channel int, n long, mean double, m2 double"]))


def deviation(policy: str = "plain") -> Column:
    """Population deviation of rows of ``vector_moments``, null without values: ``floor`` keeps variances at 1e-6 or more, ``unit`` turns deviations under 1e-6 into 1."""
    variance, some = F.col("m2") / F.col("n"), F.col("n") > 0
    if policy == "plain":
        return F.when(some, F.sqrt(variance))
    if policy == "floor":
        return F.when(some, F.sqrt(F.greatest(variance, F.lit(FLOOR))))
    if policy == "unit":
        return F.when(some, F.when(F.sqrt(variance) < FLOOR, 1.0).otherwise(F.sqrt(variance)))
    raise ValueError(f"unknown policy {policy}")
