"""Log-shaped views over the driver's tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.ranges import ranked
from ..operators.segments import Grid

#: Events are hours apart: a 4 h grid, 1.5 h of tolerance, at most six steps.
GRID = Grid(step_us=14_400_000_000, tolerance_us=5_400_000_000, max_steps=6)
#: The same, in ranges of 16 rows: a source of the test tables has several.
LONG_GRID = replace(GRID, range_rows=16)
#: 32 carriers: 0 to 9 stand for the first field, 10 to 31 for the second; 10 to 19 overlap.
LOW, HIGH = list(range(10)), list(range(10, 32))
OVERLAP_LOW, OVERLAP_HIGH = list(range(10)), list(range(10))
#: The key of a packet's vector, and how many vectors are broadcast: 16 MB at 64 floats each.
VECTOR = ["_v", "_copy"]
MOST_VECTORS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar packet log: a user is a source, ordered by time and event."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), F.col("value").alias("amp"), "event_id")
    return events.withColumn("row_no", F.row_number().over(Window.partitionBy("source").orderBy("t_us", "event_id")))


def long_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``packets``, numbered in two levels: no source is one task."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), F.col("value").alias("amp"), "event_id")
    return ranked(events, ["source"], [F.col("t_us"), F.col("event_id")], "row_no", "_n").drop("_n")


def complex_packets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Complex packet log in two tables: packets with the key (``VECTOR``) of their vector, and ``re`` and ``im`` by key.

    A packet has the 32 carriers of the embedding with the event's number, modulo their count;
    one without is left out, and copies of a vec_id are numbered. Logs are scanned with the
    keys, and ``segments.with_vectors`` brings the carriers to what is left. Up to
    ``MOST_VECTORS`` are broadcast, so that no row is shuffled with its carriers.
    """
    rows = table(spark, sf_dir, "embeddings")
    n = rows.agg(F.count("*").alias("_n"))
    copy = F.row_number().over(Window.partitionBy("vec_id").orderBy("embedding"))
    vectors = rows.filter("vec_id is not null").select(F.col("vec_id").alias("_v"), copy.alias("_copy"), V.real("embedding").alias("re"), V.imag("embedding").alias("im"))
    if rows.limit(MOST_VECTORS + 1).count() <= MOST_VECTORS:
        vectors = F.broadcast(vectors)  # a bound of our own
    numbered = packets(spark, sf_dir).crossJoin(F.broadcast(n)).withColumn("_v", F.col("event_id") % F.col("_n"))  # one row: the count
    return numbered.join(vectors.select(*VECTOR), "_v").drop("_n"), vectors


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File dimension of users: label by parity, person a letter by remainder, date of the last packet, rows."""
    rows = packets(spark, sf_dir).groupBy("source").agg(F.count("*").alias("row_count"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))
    return rows.select(
        "source",
        F.when(F.col("source") % 2 == 0, "big").otherwise("small").alias("label"),
        F.chr(97 + F.col("source") % 7).alias("person"),
        F.date_format(F.timestamp_micros("last_us"), "yyMMdd").alias("date"),
        "first_us",
        "row_count",
        F.concat(F.lit("csi_"), F.date_format(F.timestamp_micros("first_us"), "yyyyMMdd_HHmmss")).alias("name"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality as the truth; toxicity and two rules as three models' predictions."""
    labels = table(spark, sf_dir, "labels").filter("quality is not null and toxic is not null")
    models = F.explode(F.array(
        F.struct(F.lit("a").alias("model"), F.col("toxic").alias("pred")),
        F.struct(F.lit("b").alias("model"), (F.col("doc_id") % 3 != 0).cast("int").alias("pred")),
        F.struct(F.lit("c").alias("model"), F.lit(1).alias("pred")),
    ))
    return labels.select(F.col("doc_id").alias("sample_id"), F.col("quality").cast("int").alias("true"), models.alias("m")).select("sample_id", "true", "m.model", F.col("m.pred").cast("int").alias("pred"))
