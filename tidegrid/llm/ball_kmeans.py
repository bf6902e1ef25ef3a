"""Ball k-means in exact integers.

A cluster is a ball: its centre, the largest distance of a member (radius), the number and
the sum of its members. Another centre can take a member only if half its distance from
this centre is within the radius: these are the ball's neighbours. Members nearer than half
the nearest neighbour are the stable core and stay unseen by any other centre; the rest lie
in annuli, between half the distances of one neighbour and the next, and are compared
exactly with the neighbours up to theirs. A ball stays as it is if neither its centre nor a
neighbour's has moved.

Each round reads the rows that the round before wrote, with their cluster, and writes them
again: no shuffle, and nothing but k balls comes to the driver. A round's table is removed
when the next one is written.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Components are integers of at most this size, so that four times a distance fits 64 bits.
LARGEST = 1 << 26
COUNT, DISTANCE, RADIUS, SUMS = 0, 1, 2, 3  # the columns of a ball
ROWS = "key long, q binary, cluster int, distance long, balls array<long>"


def quantised(vectors: DataFrame, key: str, vector: str, size: int, scale: int) -> DataFrame:
    """(key, q) of the vectors with ``size`` components, none null or not finite; q holds floor(scale * x) as int32."""
    x = F.col(vector)
    fine = F.coalesce((F.size(x) == size) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            q = np.floor(scale * np.array(pdf["vector"].tolist(), np.float64).reshape(-1, size))
            if (np.abs(q) > LARGEST).any():
                raise ValueError(f"a component is over {LARGEST} after scaling: its distances may not fit 64 bits")
            yield pd.DataFrame({"key": pdf["key"], "q": [row.tobytes() for row in q.astype("<i4")]})

    return vectors.filter(fine).select(shared.id_in(key).alias("key"), x.alias("vector")).mapInPandas(cut, "key long, q binary")


def first_centres(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k rows of the smallest digest of seed and key; a row without key comes last, rows of one key in order of their vectors."""
    text = F.concat(F.lit(f"{seed}:"), F.when(F.col("key") != shared.NULL_ID, F.col("key")).cast("string"))
    chosen = rows.orderBy(F.sha2(text, 256).asc_nulls_last(), "q").limit(k).collect()
    return np.array([np.frombuffer(r.q, "<i4") for r in chosen], np.int64)


def squared(q: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = q - centre
    return np.einsum("ij,ij->i", d, d)


def nearest(q: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance by comparison with every centre; ties to the smaller number."""
    best, cluster = squared(q, centres[0]), np.zeros(len(q), np.int32)
    for c in range(1, len(centres)):
        d = squared(q, centres[c])
        nearer = d < best
        best[nearer], cluster[nearer] = d[nearer], c
    return cluster, best


def moved(q: np.ndarray, cluster: np.ndarray, distance: np.ndarray, centres: np.ndarray, resting: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of rows that were in ``cluster``, and how many comparisons it took.

    Rows of ``resting`` balls keep both.
    """
    cluster, distance = cluster.copy(), distance.copy()
    between = ((centres[:, None] - centres[None]) ** 2).sum(2)
    was, compared = cluster.copy(), 0
    for c in np.flatnonzero(~resting):
        members = np.flatnonzero(was == c)
        if not len(members):
            continue
        own = squared(q[members], centres[c])
        compared += len(members)
        distance[members] = own
        order = np.argsort(between[c], kind="stable")
        order = order[(order != c) & (between[c][order] <= 4 * own.max())]  # the neighbours, nearest first
        for other in order:
            reached = np.flatnonzero(4 * own >= between[c, other])  # of this annulus or one further out
            at = members[reached]
            d = squared(q[at], centres[other])
            compared += len(at)
            nearer = (d < distance[at]) | ((d == distance[at]) & (other < cluster[at]))
            distance[at[nearer]], cluster[at[nearer]] = d[nearer], other
    return cluster, distance, compared


def balls_of(q: np.ndarray, cluster: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, SUMS + q.shape[1]), np.int64)
    for c in range(k):
        own = cluster == c
        if own.any():
            out[c] = [own.sum(), distance[own].sum(), distance[own].max(), *q[own].sum(0)]
    return out


def _round(rows: DataFrame, centres: np.ndarray, resting: np.ndarray, path: str) -> DataFrame:
    """Every row's cluster, written; a batch's first row carries the batch's balls."""
    k, size = centres.shape

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            q = np.frombuffer(b"".join(pdf["q"]), "<i4").reshape(-1, size).astype(np.int64)
            if "cluster" in pdf:
                cluster, distance, _ = moved(q, pdf["cluster"].to_numpy(), pdf["distance"].to_numpy(), centres, resting)
            else:
                cluster, distance = nearest(q, centres)
            balls = [balls_of(q, cluster, distance, k).ravel(), *[None] * (len(pdf) - 1)]
            yield pd.DataFrame({"key": pdf["key"], "q": pdf["q"], "cluster": cluster, "distance": distance, "balls": balls})

    spark = rows.sparkSession
    rows.drop("balls").mapInPandas(assign, ROWS).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(ROWS).parquet(path)


def _balls(rows: DataFrame, k: int, size: int) -> np.ndarray:
    """The k balls of all rows, in Python integers; only the column of the batches' balls is read."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for b in pdf["balls"]:
                b = np.asarray(b, np.int64).reshape(k, -1)
                if total is None:
                    total = np.zeros(b.shape, object)
                radius = np.maximum(total[:, RADIUS], b[:, RADIUS])
                total = total + b
                total[:, RADIUS] = radius
        if total is not None:
            yield pd.DataFrame({"place": np.arange(total.size), "value": [str(v) for v in total.ravel()]})

    parts = rows.select("balls").filter("balls is not null").mapInPandas(merge, "place int, value string")
    value, place = F.col("value").cast("decimal(38,0)"), F.col("place") % (SUMS + size)
    found = parts.groupBy("place").agg(F.when(F.first(place) == RADIUS, F.max(value)).otherwise(F.sum(value)).alias("value")).collect()
    out = np.zeros(k * (SUMS + size), object)
    for r in found:
        out[r.place] = int(r.value)
    return out.reshape(k, -1)


def centres_of(balls: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count); a centre without members stays."""
    rows = [[s // b[COUNT] for s in b[SUMS:]] if b[COUNT] else list(c) for b, c in zip(balls, before.tolist(), strict=True)]
    return np.array(rows, np.int64)


def resting_balls(balls: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Balls whose centre stays and none of whose neighbours, by the radius, moves."""
    move = (before != after).any(1)
    between = ((after[:, None] - after[None]) ** 2).sum(2)
    return np.array([not move[c] and not any(move[o] and between[c, o] <= 4 * balls[c, RADIUS] for o in range(len(after))) for c in range(len(after))])


def ball_k_means(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """Per vector: key, cluster, distance (squared), cluster_inertia, inertia and its centre's centroid_sha256.

    Vectors that are null, of another size, or hold a null or non-finite component take no
    part. A row without a key is clustered but starts no centre while others can; rows that
    repeat a key are clustered each; with fewer than k rows each is a centre. Ties go to
    the smaller number. Rounds end early when no centre moves, as nothing would change. An
    empty table gives no row; further columns are ignored. A component over 65,536 (2 ** 26
    after scaling) is an error.
    """
    spark = vectors.sparkSession
    shared.share_code(spark)
    schema = f"{key} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    name, made = f"{shared.shared_dir(spark)}/balls-{uuid.uuid4().hex}", 0
    rows = quantised(vectors, key, vector, size, scale)
    centres = first_centres(rows, k, seed)
    if not len(centres):
        return spark.createDataFrame([], schema)
    rows = _round(rows, centres, np.zeros(len(centres), bool), f"{name}-{made}")
    balls = _balls(rows, len(centres), size)
    for _ in range(rounds):
        new = centres_of(balls, centres)
        if (new == centres).all():
            break
        resting, centres, made = resting_balls(balls, centres, new), new, made + 1
        rows = _round(rows, centres, resting, f"{name}-{made}")
        shared.removed(spark, f"{name}-{made - 1}")
        balls = _balls(rows, len(centres), size)
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    inertia = [int(b[DISTANCE]) for b in balls]
    wide = lambda value: F.lit(str(value)).cast("decimal(38,0)").cast("long")
    out = rows.select(F.col("key").alias(key), "cluster", "distance", of([wide(i) for i in inertia]).alias("cluster_inertia"), wide(sum(inertia)).alias("inertia"), of(digests).alias("centroid_sha256"))
    return shared.id_out(out, key)
