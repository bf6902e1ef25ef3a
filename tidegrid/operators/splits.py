"""Leakage-safe splits: by group subsets, time, blocks and seeded order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .ranges import chosen_by_digest, ranked


def group_split(totals: DataFrame, group: str, rows: str, share: float = 0.8, ties: str = "size", most_masks: int = 20, most_halves: int = 44) -> DataFrame:
    """The training flag of each group, for the proper subset whose rows come nearest to ``share`` of all.

    ``totals`` has one row a group, 2 at least. Ties go to the smaller subset, then the
    first in order (``size``), or to the first in order alone (``order``). Up to
    ``most_masks`` groups every subset is one row of a bit mask; up to ``most_halves`` the
    subsets of one half of the groups are dealt to tasks, each of which finds the nearest
    sums of the other half; with more, the sums that subsets reach are a table that grows
    group by group, with the best subset of each sum. All are exact. Group totals are a
    dimension and are collected.
    """
    spark = totals.sparkSession
    groups = [(r[0], r[1]) for r in totals.select(group, rows).orderBy(group).collect()]
    n = len(groups)
    if n < 2:
        raise ValueError("a subset search needs 2 groups at least")
    target = float(sum(r for _, r in groups) * share)
    if n <= most_masks:
        masks = spark.range(1, 2**n - 1).withColumnRenamed("id", "mask")
        bit = lambda i: F.shiftright("mask", i).bitwiseAND(F.lit(1))
        held = sum((bit(i) * F.lit(r) for i, (_, r) in enumerate(groups)), F.lit(0))
        subsets = masks.select(held.alias("held"), F.array_compact(F.array(*(F.when(bit(i) == 1, F.lit(i)) for i in range(n)))).alias("places"))
    elif n <= most_halves:
        subsets = _nearest([r for _, r in groups], target, spark, ties)
    else:
        subsets = _reached([r for _, r in groups], spark, ties)
    diff = F.abs(F.col("held") - F.lit(target))
    key = [diff.alias("d"), F.size("places").alias("size"), F.col("places").alias("p")] if ties == "size" else [diff.alias("d"), F.col("places").alias("p"), F.col("held").alias("h")]
    best = subsets.agg(F.min_by("places", F.struct(*key)).alias("places"))
    numbered = spark.createDataFrame([(g, i) for i, (g, _) in enumerate(groups)], f"{group} {totals.schema[group].dataType.simpleString()}, _i int")
    return numbered.crossJoin(F.broadcast(best)).select(group, F.array_contains("places", F.col("_i")).alias("is_train"))  # one row: the subset


def _bits(masks: np.ndarray, n: int) -> np.ndarray:
    return (masks[:, None] >> np.arange(n)) & 1


def _preorder(masks: np.ndarray, n: int) -> np.ndarray:
    """The place of each subset of n groups in the order of its sorted list of groups, a prefix first."""
    rank = np.zeros(len(masks), np.int64)
    for i in range(n):
        has, later = (masks >> i) & 1 == 1, masks >> (i + 1) > 0
        rank += np.where(has, 1, np.where(later, 1 << (n - 1 - i), 0))
    return rank


def _reverse(masks: np.ndarray, n: int) -> np.ndarray:
    """Masks with group 0 as the highest bit: of lists of one length, the first in order has the largest."""
    out = np.zeros(len(masks), np.int64)
    for i in range(n):
        out |= ((masks >> i) & 1) << (n - 1 - i)
    return out


def _keys(masks: np.ndarray, n: int, ties: str) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers to order subsets by, smallest first."""
    if ties == "size":
        return np.bitwise_count(masks).astype(np.int64), -_reverse(masks, n)
    return _preorder(masks, n), np.zeros(len(masks), np.int64)


def _sums_of(sizes: np.ndarray) -> np.ndarray:
    """The sum of every subset, by its mask."""
    out = np.zeros(1, np.int64)
    for s in sizes.tolist():
        out = np.concatenate([out, out + s])
    return out


def _nearest(sizes: list[int], target: float, spark: SparkSession, ties: str, chunk: int = 1 << 18) -> DataFrame:
    """(held, places) of the best proper subset of each task's part of the first half's subsets.

    A task sorts the sums of the second half, at most 2 ** 22 of them, with the best subset
    of each sum, and looks up the two that are nearest to what each of its subsets lacks.
    """
    n, half = len(sizes), len(sizes) // 2
    low, high = np.array(sizes[:half], np.int64), np.array(sizes[half:], np.int64)

    def table(masks: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, second = _keys(masks, n - half, ties)
        order = np.lexsort((second, first, sums))
        head = np.append(True, sums[order][1:] != sums[order][:-1]) if len(order) else np.zeros(0, bool)
        return sums[order][head], masks[order][head]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks, sums = np.arange(1 << (n - half)), _sums_of(high)
        tables = [table(masks, sums), table(masks[1:], sums[1:]), table(masks[:-1], sums[:-1])]  # all; not with none; not with all
        own, best = _sums_of(low), None
        for pdf in batches:
            for at in range(0, len(pdf), chunk):
                a = pdf["id"].to_numpy()[at : at + chunk]
                for kind, some in enumerate((a[(a > 0) & (a < len(own) - 1)], a[a == 0], a[a == len(own) - 1])):
                    reach, of = tables[kind]
                    if not len(some) or not len(reach):
                        continue
                    place = np.searchsorted(reach, target - own[some])
                    for k in (np.maximum(place - 1, 0), np.minimum(place, len(reach) - 1)):
                        whole, held = some | (of[k] << half), own[some] + reach[k]
                        d = np.abs(held - target)
                        near = np.flatnonzero(d == d.min())
                        first, second = _keys(whole[near], n, ties)
                        i = np.lexsort((second, first))[0]
                        found = (float(d[near[i]]), int(first[i]), int(second[i]), int(whole[near[i]]), int(held[near[i]]))
                        best = found if best is None or found < best else best
        if best is not None:
            yield pd.DataFrame({"held": [best[4]], "places": [np.flatnonzero(_bits(np.array([best[3]]), n)[0]).tolist()]})

    tasks = min(1 << half, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return spark.range(0, 1 << half, 1, tasks).mapInPandas(search, "held long, places array<int>")


def _reached(sizes: list[int], spark: SparkSession, ties: str) -> DataFrame:
    """(held, places) of the best proper subset for each sum of sizes that one reaches.

    Groups are taken from the last to the first: what is put in front of two subsets leaves
    their order as it is, so only the better one of each sum goes on. The empty subset and
    the whole are told apart, as others may have their sums.
    """
    front = spark.createDataFrame([(0, [])], "held long, places array<int>")
    for taken, i in enumerate(reversed(range(len(sizes))), 1):
        grown = F.struct((F.col("held") + F.lit(sizes[i])).alias("held"), F.concat(F.array(F.lit(i)), "places").alias("places"))
        both = front.select(F.explode(F.array(F.struct("held", "places"), grown)).alias("s")).select("s.*")
        size = F.size("places")
        order = F.struct(size, "places") if ties == "size" else F.struct("places")
        front = both.groupBy("held", (size == 0).alias("_none"), (size == taken).alias("_all")).agg(F.min_by("places", order).alias("places"))
        if taken % 16 == 0:
            front = stored(front, "sums")
    return front.filter("not _none and not _all").select("held", "places")


def _by_hash(rows: DataFrame, ratio: float, seed: int, label: str, key: str) -> DataFrame:
    """A share of each class by a digest of seed and key: the same on every run, unlike any permutation generator's."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    marked = chosen_by_digest(rows, label, digest, key, ratio)
    return marked.select(*rows.columns, F.when(F.col("chosen"), "validation").otherwise("train").alias("split"))


def time_file(files: DataFrame, ratio: float = 0.2, label: str = "label", time: str = "time", name: str = "name") -> DataFrame:
    """The latest files of each class are validation: at least one, a half-even share else."""
    placed = ranked(files, [label], [F.col(time), F.col(name)])
    back = F.col("_count") - F.col("_rank") < F.greatest(F.lit(1), F.bround(F.col("_count") * F.lit(float(ratio)), 0).cast("long"))
    return placed.select(*files.columns, F.when(back, "validation").otherwise("train").alias("split"))


def random_file(files: DataFrame, ratio: float = 0.2, seed: int = 42, label: str = "label", name: str = "name") -> DataFrame:
    """As many files in an order by a hash of seed and name."""
    return _by_hash(files, ratio, seed, label, name)


def time_block(files: DataFrame, blocks: int = 5, label: str = "label", time: str = "time", name: str = "name") -> DataFrame:
    """Files of a class in 2 to ``blocks`` blocks by time; the last block is validation."""
    placed = ranked(files, [label], [F.col(time), F.col(name)])
    n, place = F.col("_count"), F.col("_rank") - 1
    k = F.greatest(F.lit(2), F.least(F.lit(blocks), n))
    before_last = F.floor(n / k) * (k - 1) + F.least(F.pmod(n, k), k - 1)
    return placed.select(*files.columns, F.when(place >= before_last, "validation").otherwise("train").alias("split"))


def stratified_rows(rows: DataFrame, ratio: float = 0.2, seed: int = 42, label: str = "label", key: str = "key") -> DataFrame:
    """A share of the rows of each class by hash order; rows of one key go together."""
    return _by_hash(rows, ratio, seed, label, key)


def stratified_files(rows: DataFrame, ratio: float = 0.2, seed: int = 42, label: str = "label", name: str = "name") -> DataFrame:
    """All rows of a file go to one split; files of each class by hash order."""
    files = random_file(rows.select(label, name).distinct(), ratio, seed, label, name)
    return rows.join(files, [label, name])


def members(manifest: DataFrame, files: DataFrame, split: str, on: list[str]) -> DataFrame:
    """Manifest rows whose file is in the split."""
    return manifest.join(files.filter(F.col("split") == split).select(*on), on, "left_semi")
