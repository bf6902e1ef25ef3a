"""Vectors in order: numpy over Arrow batches of sorted rows, which carry the last rows of the batch before."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .segments import spread

Make = Callable[[list[np.ndarray], np.ndarray], np.ndarray]


def matrices(batch: pa.RecordBatch, vectors: Sequence[str], width: int) -> list[np.ndarray]:
    """A matrix, a row each, of each vector column; all lists have ``width`` elements."""
    return [batch.column(v).flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(batch.num_rows, width) for v in vectors]


def _widths(batch: pa.RecordBatch, vectors: Sequence[str]) -> np.ndarray:
    """Width of each row's vectors, -1 where one is null or they differ."""
    every = np.stack([pc.fill_null(pc.list_value_length(batch.column(v)), -1).to_numpy(zero_copy_only=False) for v in vectors])
    return np.where((every == every[0]).all(0), every[0], -1)


def _listed(found: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, found.size + 1, max(1, found.shape[1]), dtype=np.int32)[: len(found) + 1], found.ravel())


def over_rows_before(steps: DataFrame, vectors: Sequence[str], n: int, make: Make, out: str, kept: Sequence[str]) -> DataFrame:
    """``kept`` columns and ``out`` of each row that has ``n`` rows of as many elements before it in its segment.

    ``make`` gets a matrix for each of ``vectors`` and the places of the rows asked for in
    it, each with its n rows before it. Segments are dealt to tasks and stream through in
    order. A row without a vector has no result, nor have the n rows after it.
    """
    asked = list(dict.fromkeys(["source", "segment_id", "step_index", *kept, *vectors]))
    rows = spread(steps.select(*asked), "source", "segment_id").sortWithinPartitions("source", "segment_id", "step_index")
    schema = StructType([*(f for c in kept for f in rows.select(c).schema), StructField(out, ArrayType(DoubleType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, place, before = None, 0, [np.zeros((0, 0))] * len(vectors)  # of the row before: segment, place in it, and the last rows
        for whole in batches:
            widths = _widths(whole, vectors)
            edges = [0, *(np.flatnonzero(widths[1:] != widths[:-1]) + 1).tolist(), whole.num_rows]
            for i, j in zip(edges, edges[1:], strict=False):
                batch, count = whole.slice(i, j - i), j - i
                if not count:
                    continue
                if widths[i] < 0:
                    key = None
                    continue
                z = matrices(batch, vectors, int(widths[i]))
                opens = np.ones(count, bool)
                names = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("source", "segment_id")]
                opens[0] = key != (names[0][0], names[1][0]) or before[0].shape[1] != z[0].shape[1]
                opens[1:] = (names[0][1:] != names[0][:-1]) | (names[1][1:] != names[1][:-1])
                start = np.maximum.accumulate(np.where(opens, np.arange(count), 0))
                places = np.arange(count) - start + np.where(np.cumsum(opens) == 0, place + 1, 0)
                if opens[0]:
                    before = [np.zeros((0, m.shape[1])) for m in z]
                at = np.flatnonzero(places >= n)
                z = [np.concatenate([b, m]) for b, m in zip(before, z, strict=True)]
                behind = len(z[0]) - count
                key, place, before = (names[0][-1], names[1][-1]), int(places[-1]), [m[len(m) - min(n, len(m)) :] for m in z]
                if len(at):
                    found = make(z, at + behind)
                    yield pa.RecordBatch.from_arrays([*batch.select(list(kept)).take(pa.array(at)).columns, _listed(found)], names=[*kept, out])

    return rows.mapInArrow(run, schema)


def over_rows(rows: DataFrame, vectors: Sequence[str], make: Callable[[list[np.ndarray]], np.ndarray], out: str, kept: Sequence[str]) -> DataFrame:
    """``kept`` columns and ``out``, made of each row's own vectors; null where one is null or their sizes differ."""
    asked = list(dict.fromkeys([*kept, *vectors]))
    schema = StructType([*(f for c in kept for f in rows.select(c).schema), StructField(out, ArrayType(DoubleType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            widths = _widths(whole, vectors)
            edges = [0, *(np.flatnonzero(widths[1:] != widths[:-1]) + 1).tolist(), whole.num_rows]
            for i, j in zip(edges, edges[1:], strict=False):
                if j == i:
                    continue
                batch = whole.slice(i, j - i)
                made = pa.nulls(j - i, pa.list_(pa.float64())) if widths[i] < 0 else _listed(make(matrices(batch, vectors, int(widths[i]))))
                yield pa.RecordBatch.from_arrays([*batch.select(list(kept)).columns, made], names=[*kept, out])

    return rows.select(*asked).mapInArrow(run, schema)
