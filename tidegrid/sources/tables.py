"""Windows, manifests, summaries and checkpoints as tables and small files."""

from __future__ import annotations

import io
import json
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranges import ranked


def write_windows(cut: DataFrame, path: str, *by: str) -> None:
    """One Parquet table of all windows; variants are projections of it, splits a column."""
    cut.write.partitionBy(*by).mode("overwrite").parquet(path)


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def channels(cut: DataFrame, variant: str) -> DataFrame:
    """A window's variant: ``interp_only``, ``interp_mask`` or ``interp_mask_deltat``."""
    extra = {"interp_only": [], "interp_mask": ["interp_mask"], "interp_mask_deltat": ["interp_mask", "delta_t_ms"]}[variant]
    drop = [c for c in ("interp_mask", "delta_t_ms") if c not in extra]
    return cut.drop(*drop)


def variants(cut: DataFrame) -> dict[str, DataFrame]:
    """Every variant of a window table: projections of the one table."""
    return {v: channels(cut, v) for v in ("interp_only", "interp_mask", "interp_mask_deltat")}


def channel_first(cut: DataFrame, vector: str, mask: str | None = None, out: str = "channels") -> DataFrame:
    """Windows with ``out``: an array a carrier over time, the mask as the last one; windows of vectors of one width."""
    n = F.size(F.get(F.col(vector), F.lit(0)))
    carriers = F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.transform(F.col(vector), lambda row: F.get(row, c).cast("double")))
    carriers = F.when(n > 0, carriers)
    both = F.concat(carriers, F.array(F.col(mask).cast("array<double>"))) if mask else carriers
    return cut.withColumn(out, both)


def write_steps(steps: DataFrame, name: str, path: str, buckets: int, order: str = "step_index") -> DataFrame:
    """Steps as a table in buckets of (source, segment), each one file sorted by segment and step; read back.

    Windows, joins and features by (source, segment) of what is read need no exchange.
    """
    keys = ["source", "segment_id"]
    dealt = steps.repartition(buckets, *keys).sortWithinPartitions(*keys, order)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys, order).option("path", path).mode("overwrite").saveAsTable(name)
    return steps.sparkSession.table(name)


def counted_write(rows: DataFrame, path: str, by: list[str], values: list[tuple], *partition: str) -> DataFrame:
    """Write ``rows`` as Parquet and return their counts by the given ``values`` of ``by``, taken while they are written.

    One job: the counts are metrics of the rows that pass. ``values`` that don't occur count 0;
    rows of none of them are counted in a last row of nulls if there are any.
    """
    spark = rows.sparkSession
    seen = Observation()
    met = [reduce(and_, (F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(by, row, strict=True))) for row in values]
    counts = [F.count(F.when(m, 1)).alias(f"n{i}") for i, m in enumerate(met)]
    writer = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    found = seen.get
    out = [(*row, found[f"n{i}"]) for i, row in enumerate(values)]
    other = found["rows"] - sum(n for *_, n in out)
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in by]
    return spark.createDataFrame([*out, *([(*[None] * len(by), other)] if other else [])], ", ".join([*kinds, "n long"]))


def class_windows(spark: SparkSession, path: str, names: list[str], by: str = "label", order: str = "window_path") -> DataFrame:
    """The windows of some classes of a stored table, each read as its partition, together, with their place in their class's sorted listing (``position`` from 0)."""
    parts = [read_windows(spark, path).filter(F.col(by) == name) for name in names]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return ranked(whole, [by], [F.col(order)], "position", "_n").withColumn("position", F.col("position") - 1).drop("_n")


def probe(cut: DataFrame, vector: str = "amp") -> dict:
    """Which optional channels a window table has, and its vector width."""
    first = cut.select(F.size(F.element_at(vector, 1)) if cut.schema[vector].dataType.simpleString().startswith("array<array") else F.lit(1)).first()
    return {"interp_mask": "interp_mask" in cut.columns, "delta_t_ms": "delta_t_ms" in cut.columns, "width": None if first is None else first[0]}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def write_manifest(manifest: DataFrame, path: str, *order: str) -> None:
    """CSV in order; a range sort, so any size is written in parallel."""
    manifest.orderBy(*order).write.option("header", True).mode("overwrite").csv(path)


def classes(manifests: DataFrame) -> DataFrame:
    """Class names from files named ``{class}_manifest.csv``, sorted."""
    name = F.regexp_extract("path", r"([^/]+)_manifest\.csv$", 1)
    return manifests.select(name.alias("class")).filter("class <> ''").distinct().orderBy("class")


def wide(steps: DataFrame, vector: str, width: int, prefix: str = "sc_") -> DataFrame:
    """One column a carrier, ``sc_000`` on."""
    return steps.select(*(c for c in steps.columns if c != vector), *(F.get(vector, F.lit(i)).alias(f"{prefix}{i:03d}") for i in range(width)))


def resampled_csv(steps: DataFrame, vector: str, width: int) -> DataFrame:
    """The columns of a resampled log as CSV: time since the segment's start, blanks for what filled steps don't have, one column a carrier."""
    start = F.min("grid_t_us").over(Window.partitionBy("source", "segment_id"))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = steps.withColumns({"_since": F.col("grid_t_us") - start, "actual_timestamp": blank("actual_t_us"), "source_row_number": blank("source_row")})
    named = rows.select(F.col("source").alias("source_csv"), "segment_id", "step_index", F.col("_since").alias("relative_time_us"), F.col("grid_t_us").alias("grid_timestamp"), "actual_timestamp", "source_row_number", "interp_mask", vector)
    return wide(named, vector, width)


def summary_json(counts: DataFrame, by: list[str]) -> DataFrame:
    """One JSON document a group, of the other columns."""
    rest = [c for c in counts.columns if c not in by]
    return counts.select(*by, F.to_json(F.struct(*rest)).alias("summary"))


def pack_weights(params: dict[str, np.ndarray]) -> bytes:
    """A checkpoint's bytes."""
    buffer = io.BytesIO()
    np.savez_compressed(buffer, **params)
    return buffer.getvalue()


def unpack_weights(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as f:
        return {k: f[k] for k in f.files}


def write_run(spark: SparkSession, path: str, params: dict[str, np.ndarray], means: np.ndarray, stds: np.ndarray, summary: dict, kernels: tuple | None = None) -> None:
    """A training run as a table of one row: its weights with what standardises their input, and its summary as JSON."""
    raw = pack_weights({f"p.{k}": v for k, v in params.items()} | {"means": means, "stds": stds})
    row = [(bytearray(raw), json.dumps(kernels), json.dumps(summary))]
    spark.createDataFrame(row, "weights binary, kernels string, summary string").coalesce(1).write.mode("overwrite").parquet(path)


def read_run(spark: SparkSession, path: str) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, dict, list | None]:
    """(weights, means, stds, summary, kernels) of a run, for inference or to go on training."""
    row = spark.read.parquet(path).first()
    found = unpack_weights(bytes(row.weights))
    return {k[2:]: v for k, v in found.items() if k.startswith("p.")}, found["means"], found["stds"], json.loads(row.summary), json.loads(row.kernels)
