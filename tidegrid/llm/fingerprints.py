"""Bottom-k sketches of word shingles.

A document's fingerprint is the k smallest 64-bit hashes of its distinct five-word
shingles. Sketches of parts merge into the sketch of the whole; two sketches estimate
resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

K, WORDS = 128, 5
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double, contained_in_edited double"


def sketch(text: str, k: int = K, words: int = WORDS) -> np.ndarray:
    """The k smallest shingle hashes, ascending; empty without words."""
    return shared.shingle_hashes(shared.word_hashes(text), words)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of two shingle sets."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard index of the sets; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, union, assume_unique=True).sum() / len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    if not len(a):
        return 1.0
    shared_size = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return min(1.0, shared_size / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u8").astype(np.uint64)


def with_next(docs: DataFrame, spark_partitions: int) -> DataFrame:
    """Documents dealt into ranges of doc_id, in order, each range followed by the first document of the next one.

    Ranges come from quantiles of doc_id, and range i is partition i, so each task gets one
    share of the rows; the only rows that meet twice are the first of each range.
    """
    spark = docs.sparkSession
    rows = docs.select(shared.id_in().alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("at", F.col("place").cast("double"))
    cuts = sorted(set(rows.approxQuantile("at", [i / spark_partitions for i in range(1, spark_partitions)], 0.25 / spark_partitions)))
    ranged = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="at", outputCol="range").transform(rows) if cuts else rows.withColumn("range", F.lit(0.0))
    ranged = ranged.withColumn("range", F.col("range").cast("int"))
    firsts = sorted(tuple(r) for r in ranged.groupBy("range").agg(F.min("place").alias("place")).collect())  # one row a range
    guests = [(place, firsts[i - 1][0]) for i, (_, place) in enumerate(firsts)]  # the first of all follows the last
    guest = F.broadcast(spark.createDataFrame(guests, "place long, before int"))
    both = F.array(F.struct(F.col("range"), F.lit(0).alias("guest")), F.struct(F.col("before").alias("range"), F.lit(1).alias("guest")))
    dealt = ranged.join(guest, "place", "left").withColumn("to", F.explode(F.filter(both, lambda x: x["range"].isNotNull())))
    return dealt.select(F.col("place").alias("doc_id"), "text", "to.range", "to.guest").repartitionById(spark_partitions, "range").sortWithinPartitions("range", "guest", "doc_id", F.xxhash64("text"))


def fingerprints(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document.

    The edited text has its last quarter (rounded down) replaced by as many code points
    of the next document, by doc_id; the last document is followed by the first. A null
    text is empty, a null doc_id comes first, rows with one doc_id follow each other by a
    hash of their text. A very long text is sketched whole. Without words a fingerprint is
    empty. Further columns are ignored; an empty table gives no row.
    """
    spark = docs.sparkSession
    shared.share_code(spark)

    def print_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        held = None  # the row that waits for its next one: range, doc_id, text, sketch
        for pdf in batches:
            out = []
            for doc, text, where, is_guest in zip(pdf["doc_id"], pdf["text"], pdf["range"], pdf["guest"], strict=True):
                mine = sketch(text, k, words)
                if held is not None and held[0] == where:
                    _, old_id, old, theirs = held
                    cut = len(old) // 4
                    edited = old[: len(old) - cut] + text[:cut]
                    changed = sketch(edited, k, words)
                    out.append((old_id, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_text(theirs), to_text(changed), resemblance(theirs, changed, k), resemblance(theirs, mine, k), distinct(theirs, k), containment(theirs, changed, k)))
                held = None if is_guest else (where, doc, text, mine)
            yield pd.DataFrame(out, columns=names)

    ordered = with_next(docs, shared.shuffle_partitions(spark))
    return shared.id_out(ordered.mapInPandas(print_pairs, RESULT))
