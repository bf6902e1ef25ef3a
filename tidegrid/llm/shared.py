"""Helpers that several of the training-data operators use."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs on this machine alone (tests, a laptop) a
    folder of our own is set; on a cluster that is an error.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = "file://" + tempfile.mkdtemp(prefix="tidegrid-")
        spark.conf.set("spark.checkpoint.dir", there)
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs only the tasks that it ran.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that was written and won't be read again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Stands for a null id inside Python tasks, where a column of longs can't hold nulls.
NULL_ID = -(1 << 63)


def id_in(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID)).alias(name)


def id_out(df: DataFrame, name: str = "doc_id") -> DataFrame:
    return df.withColumn(name, F.when(F.col(name) != NULL_ID, F.col(name)))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def with_groups(rows: DataFrame, key: str, *aggregates: Column, where: str | None = None, least: int = 1000, most_hot: int = 2000) -> DataFrame:
    """``rows`` with aggregates of their group, for groups that meet ``where`` (which may use ``n``, the group's rows).

    Groups with over ``least`` rows and over 1 / ``most_hot`` of all rows, thus fewer than
    ``most_hot``, are broadcast: their rows stay where they are. Only the rows of the other
    groups are dealt by ``key``. ``rows`` should be a stored table.
    """
    groups = stored(rows.groupBy(key).agg(F.count("*").alias("n"), *aggregates), "groups")
    bound = max(least, (groups.agg(F.sum("n")).first()[0] or 0) // most_hot)
    hot = groups.filter(F.col("n") > bound).select(F.col(key), F.struct(*[c for c in groups.columns if c != key]).alias("_hot"))  # fewer than most_hot rows
    marked = rows.join(F.broadcast(hot), key, "left")
    often = marked.filter(F.col("_hot").isNotNull()).select(*rows.columns, "_hot.*")
    rest = marked.filter(F.col("_hot").isNull()).drop("_hot").join(groups.filter(F.col("n") <= bound), key).select(*often.columns)
    both = often.union(rest)
    return (both.filter(where) if where else both).drop("n")


BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def share_code(spark: SparkSession) -> None:
    """Ready a session for the operators.

    Python workers that start elsewhere can import this package. Rows are whole texts and
    sets here, so Arrow batches are set to ``BATCH_ROWS`` rows unless the session has a
    size of its own: with Spark's 10,000 a batch of a few KB a row takes tens of MB,
    several times over in JVM and Python.
    """
    if spark.conf.get(BATCH_KEY, None) in (None, "10000"):
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen before (bounded)."""

    limit = 60_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of ``text``: A-Z in lower case, cut at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_hashes.__getitem__, words), U64, len(words))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct ``n``-word shingles, sorted; a shorter text is one shingle, no word none."""
    if len(words) == 0:
        return words
    with np.errstate(over="ignore"):
        if len(words) < n:
            h = U64(len(words))
            for w in words:
                h = h * U64(0x9E3779B97F4A7C15) + w
            return mix64(np.array([h], U64))
        m = len(words) - n + 1
        h = np.full(m, n, U64)
        for i in range(n):
            h = h * U64(0x9E3779B97F4A7C15) + words[i : i + m]
        return np.unique(mix64(h))
