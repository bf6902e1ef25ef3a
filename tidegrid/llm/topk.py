"""Exact inner product top-k on a bit-sliced index.

Vectors are integers. A block of rows keeps, for each attribute, the highest bits of its
values as bitmaps, one a bit, and the exact values beside them. A query's score is added
up for all rows of a block at once: each signed digit of a weight adds the attribute's
slices, or their complements, at the digit's place, and full adders on bitmaps compress
every place to one slice. The k best come from the most significant slice downward; rows
within the cut-off bits' largest effect of the k-th are resolved by their exact scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

BITS, BLOCK, QUERIES = 6, 1 << 15, 64
BLOCKS = "uid long, dims int, n int, vec_ids binary, exact binary, slices binary, low long, shift int"


def slices_of(x: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, int, int]:
    """Bitmaps (attribute, bit from the lowest, words of 64 rows) of ``(x - low) >> shift``, low and shift."""
    low = int(x.min())
    shift = max(0, int(x.max() - low).bit_length() - bits)
    q = ((x - low) >> shift).astype(np.uint8)
    n, dims = x.shape
    planes = (q.T[:, None, :] >> np.arange(bits, dtype=np.uint8)[None, :, None]) & 1
    packed = np.packbits(planes, axis=2, bitorder="little")
    out = np.zeros((dims, bits, -(-n // 64) * 8), np.uint8)
    out[..., : packed.shape[2]] = packed
    return out.view("<u8"), low, shift


def digits(weight: int) -> Iterator[tuple[int, int]]:
    """(place, sign) of the non-adjacent form, the signed binary form with the fewest digits."""
    place = 0
    while weight:
        if weight & 1:
            sign = 2 - (weight & 3)
            yield place, sign
            weight -= sign
        weight >>= 1
        place += 1


def add_up(slices: np.ndarray, weights: list[int]) -> tuple[list[np.ndarray], int]:
    """Slices of the weighted sum for all rows, from the lowest, and the constant to take from it."""
    places: dict[int, list[np.ndarray]] = {}
    bits, constant = slices.shape[1], 0
    flipped = ~slices
    for d, w in enumerate(weights):
        for place, sign in digits(w):
            from_ = slices[d] if sign > 0 else flipped[d]
            constant += 0 if sign > 0 else ((1 << bits) - 1) << place
            for b in range(bits):
                places.setdefault(place + b, []).append(from_[b])
    out, place = [], 0
    while places:
        maps = places.pop(place, [])
        carries = places.setdefault(place + 1, []) if len(maps) > 1 else None
        while len(maps) > 2:
            a, b, c = maps.pop(), maps.pop(), maps.pop()
            half = a ^ b
            maps.append(half ^ c)
            carries.append((a & b) | (half & c))
        if len(maps) == 2:
            a, b = maps
            maps = [a ^ b]
            carries.append(a & b)
        out.append(maps[0] if maps else np.zeros(slices.shape[2], np.uint64))
        place += 1
    return out, constant


def best(total: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th largest sum of the rows in the bitmap, from the most significant slice downward."""
    sure, open_, value = np.zeros_like(rows), rows, 0
    for place in range(len(total) - 1, -1, -1):
        with_bit = open_ & total[place]
        got = int(np.bitwise_count(sure | with_bit).sum())
        if got >= k:
            open_ = with_bit
            value |= 1 << place
        else:
            sure = sure | with_bit
            open_ = open_ & ~total[place]
    return value


def at_least(total: list[np.ndarray], rows: np.ndarray, value: int) -> np.ndarray:
    """Bitmap of the rows whose sum is at least ``value``."""
    if value <= 0:
        return rows
    if value >> len(total):
        return np.zeros_like(rows)
    above, equal = np.zeros_like(rows), rows
    for place in range(len(total) - 1, -1, -1):
        if value >> place & 1:
            equal = equal & total[place]
        else:
            above = above | (equal & total[place])
            equal = equal & ~total[place]
    return above | equal


def search(query: np.ndarray, own: int, ids: np.ndarray, exact: np.ndarray, slices: np.ndarray, shift: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(vec_ids, scores) of the k best rows of a block but those named ``own``."""
    n = len(ids)
    rows = np.zeros(slices.shape[2] * 8, np.uint8)
    rows[: -(-n // 8)] = np.packbits(np.ones(n, np.uint8), bitorder="little")
    rows = rows.view(np.uint64)
    need = k + int((ids == own).sum())
    picked = np.arange(n)
    if n > need:
        total, _ = add_up(slices, [int(w) for w in query])
        effect = int(np.abs(query).sum()) * ((1 << shift) - 1)  # between all cut-off bits for and all against a row
        slack = -(-effect >> shift) + 1
        chosen = at_least(total, rows, best(total, rows, need) - slack)
        picked = np.flatnonzero(np.unpackbits(chosen.view(np.uint8), bitorder="little")[:n])
    picked = picked[ids[picked] != own]
    scores = exact[picked].astype(np.int64) @ query
    order = np.lexsort((ids[picked], -scores))[:k]
    return ids[picked][order], scores[order]


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and ``floor(scale * x)`` of each component; without null ids, null vectors, null or non-finite components."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"))


def index(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The bit-sliced index: one row a block of rows of like dimension. Every row is in it."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        uid = TaskContext.get().partitionId() << 32

        def made(dims: int) -> pd.DataFrame:
            nonlocal uid
            rows = held.pop(dims)
            x = np.array([q for _, q in rows], np.int64).reshape(len(rows), dims)
            kind = np.int16 if not x.size or np.abs(x).max() < 1 << 15 else np.int64
            maps, low, shift = slices_of(x) if dims else (np.zeros((0, BITS, -(-len(rows) // 64)), "<u8"), 0, 0)
            uid += 1
            return pd.DataFrame({"uid": [uid], "dims": [dims], "n": [len(rows)], "vec_ids": [np.array([i for i, _ in rows], "<i8").tobytes()], "exact": [x.astype(kind).tobytes()], "slices": [maps.tobytes()], "low": [low], "shift": [shift]})

        for pdf in batches:
            for i, q in zip(pdf["vec_id"], pdf["q"], strict=True):
                held.setdefault(len(q), []).append((i, q))
                if len(held[len(q)]) == block:
                    yield made(len(q))
        for dims in list(held):
            yield made(dims)

    return rows.mapInPandas(build, BLOCKS)


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, block: int = BLOCK) -> DataFrame:
    """The k best rows of every query by integer inner product; queries are the rows whose vec_id ``every`` divides.

    Ties go to the smaller vec_id. Rows that share a query's vec_id are its own and no
    candidates for it; of several vectors with a query's id the least is the query.
    Vectors of another dimension are no candidates. Null vectors and vectors with null or
    non-finite components take no part; further columns are ignored; an empty table gives
    no row. Scores must fit into a long. Each block of rows meets each block of queries
    once; at most k rows of such a pair go on. A block goes once to each of its places, and
    its queries stream past it there; blocks have several places where there are few of them.
    """
    spark = vectors.sparkSession
    shared.share_code(spark)
    rows = quantised(vectors, scale)
    blocks = shared.stored(index(rows, block), "slices")
    names = blocks.select("uid").withColumn("block", F.row_number().over(Window.orderBy("uid")) - 1)  # one small row a block of rows
    names = shared.stored(names, "block-names")
    n, tasks = names.count(), shared.shuffle_partitions(spark)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sides = -(-2 * tasks // n) if n < 2 * tasks else 1

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def made(dims: int) -> pd.DataFrame:
            rows = held.pop(dims)
            return pd.DataFrame({"dims": [dims], "query_ids": [np.array([i for i, _ in rows], "<i8").tobytes()], "queries": [np.array([q for _, q in rows], "<i8").tobytes()]})

        for pdf in batches:
            for i, q in zip(pdf["vec_id"], pdf["q"], strict=True):
                held.setdefault(len(q), []).append((i, q))
                if len(held[len(q)]) == QUERIES:
                    yield made(len(q))
        for dims in list(held):
            yield made(dims)

    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("q").alias("q"))
    bundles = asked.mapInPandas(bundle, "dims int, query_ids binary, queries binary").withColumn("side", F.pmod(F.xxhash64("query_ids"), F.lit(sides)).cast("int"))
    hosts = blocks.join(names, "uid").withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    guests = bundles.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    met = hosts.drop("uid").unionByName(guests, allowMissingColumns=True).withColumn("guest", F.col("queries").isNotNull())
    place = F.pmod(F.col("block").cast("long") * sides + F.col("side"), F.lit(min(tasks, n * sides))).cast("int")
    met = met.repartitionById(min(tasks, n * sides), place).sortWithinPartitions("block", "side", "guest")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = None
        for pdf in batches:
            for row in pdf.itertuples():
                if not row.guest:
                    here, size, dims, shift = (row.block, row.side), int(row.n), int(row.dims), int(row.shift)
                    ids = np.frombuffer(row.vec_ids, "<i8")
                    matrix = np.frombuffer(row.exact, np.int16 if len(row.exact) == 2 * dims * size else np.int64).reshape(size, dims)
                    bitmaps = np.frombuffer(row.slices, "<u8").reshape(dims, BITS, -1) if dims else np.zeros((0, BITS, -(-size // 64)), np.uint64)
                elif here == (row.block, row.side) and dims == row.dims:
                    asked_ids = np.frombuffer(row.query_ids, "<i8")
                    for own, q in zip(asked_ids, np.frombuffer(row.queries, "<i8").reshape(len(asked_ids), dims), strict=True):
                        found, scores = search(q, own, ids, matrix, bitmaps, shift, k)
                        yield pd.DataFrame({"query_id": own, "vec_id": found, "score": scores})

    near = met.mapInPandas(meet, "query_id long, vec_id long, score long")
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
