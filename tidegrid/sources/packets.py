"""Packet logs as CSV; their rows are numbered in file order (``csv_log``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.normalise import normalised_amplitude, scale_factor
from ..operators.selection import first_per_group
from .csv_log import numbered_csv as numbered_csv


def packets(rows: DataFrame, width: int, strict_time: bool = False) -> DataFrame:
    """Valid packets of CSV rows: (source, row_no, t_us, data).

    The text of ``len`` and the number of integers must be ``width``. A time that doesn't
    parse drops the row, or raises with ``strict_time``.
    """
    time = F.col("local_timestamp").cast("long") if strict_time else F.col("local_timestamp").try_cast("long")
    fine = rows.filter(F.col("len") == str(width)).withColumn("data", V.parse_list("data")).filter((F.size("data") == width) & ~F.exists("data", lambda x: x.isNull()))
    out = fine.select(F.col("source_csv").alias("source"), F.col("source_row_number").alias("row_no"), time.alias("t_us"), "data")
    return out if strict_time else out.filter(F.col("t_us").isNotNull())


def complex_packets(valid: DataFrame) -> DataFrame:
    """Packets with ``re`` and ``im`` instead of flat integers."""
    return valid.withColumns({"re": V.real("data"), "im": V.imag("data")}).drop("data")


def amplitude_packets(valid: DataFrame) -> DataFrame:
    """Packets with ``amp``."""
    return complex_packets(valid).withColumn("amp", V.amplitude("re", "im")).drop("re", "im")


def normalised_packets(valid: DataFrame) -> DataFrame:
    """Amplitudes of the second training field over the robust scale of the first; rows without a scale go.

    ``valid`` holds 332 integers: 52 carriers of the first field, then 114 of the second.
    """
    amps = complex_packets(valid).withColumn("_a", V.amplitude("re", "im")).drop("re", "im")
    parts = amps.withColumns({"_l": F.slice("_a", 1, 52), "_h": F.slice("_a", 53, 114)})
    return parts.withColumn("_k", scale_factor("_l", "_h")).filter("_k is not null").withColumn("amp", normalised_amplitude("_h", "_k")).drop("_a", "_l", "_h", "_k")


def load(rows: DataFrame, input_format: str) -> DataFrame:
    """``amplitude`` (228 integers) or ``normalised`` (332 integers) packets."""
    if input_format == "amplitude":
        return amplitude_packets(packets(rows, 228))
    if input_format == "normalised":
        return normalised_packets(packets(rows, 332))
    raise ValueError(f"unknown input format {input_format}")


def row_counts(rows: DataFrame) -> DataFrame:
    """Rows of each file, invalid ones included."""
    return rows.groupBy("source_csv").agg(F.count("*").alias("row_count"))


def labelled(rows: DataFrame, depth: int = 1) -> DataFrame:
    """``label`` from the folder of each file, ``depth`` levels up."""
    return rows.withColumn("label", F.element_at(F.split("source_csv", "/"), -1 - depth))


def width_of(vectors: DataFrame, order: list[str], vector: str = "data") -> DataFrame:
    """One row: the width of the first valid row in order, and how many rows have another one or no vector; no row without a valid one."""
    valid = F.when(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()), F.size(vector))
    sizes = vectors.groupBy(valid.alias("width")).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    found = sizes.agg(F.min_by("width", F.when(F.col("width").isNotNull(), F.col("first"))).alias("width"), F.map_from_entries(F.collect_list(F.struct(F.coalesce("width", F.lit(-1)).alias("w"), "n"))).alias("_n"), F.sum("n").alias("_all"))
    return found.filter("width is not null").select("width", (F.col("_all") - F.element_at("_n", F.col("width"))).alias("other_rows"))


def row_vectors(train: DataFrame, validation: DataFrame, order: list[str], vector: str = "data") -> tuple[DataFrame, DataFrame, int, int]:
    """Rows of both splits that have the width of their split's first valid row, that width, and how many rows were skipped.

    No valid row in a split, or other widths in the two, is an error.
    """
    found = [width_of(rows, order, vector).first() for rows in (train, validation)]
    if None in found:
        raise ValueError("no valid row")
    if found[0].width != found[1].width:
        raise ValueError(f"widths differ: {found[0].width} in train, {found[1].width} in validation")
    fine = (F.size(vector) == found[0].width) & ~F.exists(vector, lambda x: x.isNull())
    return train.filter(fine), validation.filter(fine), found[0].width, found[0].other_rows + found[1].other_rows


def first_valid(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group in order; an error if there is none at all."""
    found = first_per_group(rows, by, order, n)
    if found.isEmpty():
        raise ValueError("no valid row")
    return found


def fan_out(rows: DataFrame) -> DataFrame:
    """Each row in three carrier variants; a row without 384 valid integers stays as ``len`` 0 and ``[]``."""
    data = V.parse_list("data")
    valid = (F.size(data) == V.RAW_INTS) & ~F.exists(data, lambda x: x.isNull())
    variants = F.explode(F.array(*map(F.lit, V.VARIANTS))).alias("variant")
    spread = rows.withColumn("_v", F.when(F.coalesce(valid, F.lit(False)), data)).select("*", variants)
    cut = None
    for name, pairs in V.VARIANTS.items():
        cut = (F.when if cut is None else cut.when)(F.col("variant") == name, V.gather_pairs("_v", pairs))
    out = spread.withColumn("_c", F.coalesce(cut, F.expr("cast(array() as array<int>)")))
    return out.withColumns({"data": V.list_text("_c"), "len": F.size("_c").cast("string")}).drop("_v", "_c")


def variant_counters(spread: DataFrame) -> DataFrame:
    """Rows of ``fan_out`` by variant: all, those without a valid vector, and the others."""
    bad = (F.col("len") == "0").cast("long")
    return spread.groupBy("variant").agg(F.count("*").alias("rows_seen"), F.sum(bad).alias("rows_invalid_length"), F.sum(1 - bad).alias("rows_written"))


def only_second_field(rows: DataFrame) -> DataFrame:
    """One row for each row, cut to the second training field; invalid ones are ``len`` 0 and ``[]``."""
    return fan_out(rows).filter("variant = 'htltf_only'").drop("variant")


def write_variants(rows: DataFrame, path: str, *by: str) -> None:
    """CSV partitioned by variant and further columns, a writer task for each file."""
    rows.repartition("variant", "source_csv").sortWithinPartitions("variant", "source_csv", "source_row_number").write.partitionBy("variant", *by).option("header", True).mode("overwrite").csv(path)
