"""Ordered scans in two levels, for sources or classes of any length.

An order is cut into ranges. What a range hands on to the next, its last row and its
running counts, is one row of a small table, on which the scan over ranges runs; joined
back, it settles each range's rows in a task of their own. So a window over a whole source
becomes windows over its ranges, and no task holds more than a range.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

RANGE = "_range"
_ALL, _HERE = Window.unboundedPreceding, Window.currentRow


def cut(rows: DataFrame, order: str, size: int) -> DataFrame:
    """``rows`` with their range: ``size`` numbers of ``order``, which counts rows from 0 or 1, maybe with holes."""
    if size < 1:
        raise ValueError("a range has one row at least")
    return rows.withColumn(RANGE, F.floor(F.col(order) / size).cast("long"))


def with_previous(rows: DataFrame, keys: list[str], order: str, values: list[str], name: str = "_prev") -> DataFrame:
    """Rows of ``cut`` with ``name``: the values on the row before in their key, null on its first one. Keys aren't null."""
    held = F.struct(*values)
    ends = rows.groupBy(*keys, RANGE).agg(F.max_by(held, order).alias("_end"))
    carried = ends.select(*keys, RANGE, F.lag("_end").over(Window.partitionBy(*keys).orderBy(RANGE)).alias("_carried"))
    before = F.lag(held).over(Window.partitionBy(*keys, RANGE).orderBy(order))
    return rows.join(carried, [*keys, RANGE]).withColumn(name, F.coalesce(before, "_carried")).drop("_carried")


def with_runs(rows: DataFrame, order: str, breaks: Column, add: Column, first: str) -> DataFrame:
    """Rows of ``cut`` by source with their run: ``run`` counts breaks so far, ``total`` sums ``add`` since the last one, ``head`` is ``first`` on the run's first row."""
    here = Window.partitionBy("source", RANGE).orderBy(order).rowsBetween(_ALL, _HERE)
    inside = Window.partitionBy("source", RANGE, "_local").orderBy(order).rowsBetween(_ALL, _HERE)
    rows = rows.withColumn("_local", F.sum(breaks.cast("long")).over(here)).withColumns({"_add": F.sum(add).over(inside), "_head": F.first(first).over(inside)})

    ends = rows.groupBy("source", RANGE).agg(F.max("_local").alias("_breaks"), F.max_by(F.struct("_add", "_head"), order).alias("_tail"))
    over = Window.partitionBy("source").orderBy(RANGE)
    opens = (F.col("_breaks") > 0) | (F.row_number().over(over) == 1)  # a run starts in this range
    ends = ends.withColumn("_opens", opens.cast("long")).withColumn("_group", F.sum("_opens").over(over.rowsBetween(_ALL, _HERE)))
    since = Window.partitionBy("source", "_group").orderBy(RANGE).rowsBetween(_ALL, _HERE)
    ends = ends.withColumns({"_sum": F.sum("_tail._add").over(since), "_first": F.first("_tail._head").over(since)})
    carried = ends.select("source", RANGE, F.coalesce(F.sum("_breaks").over(over.rowsBetween(_ALL, -1)), F.lit(0)).alias("_before"), F.lag("_sum").over(over).alias("_sum"), F.lag("_first").over(over).alias("_first"))

    rows = rows.join(carried, ["source", RANGE])
    goes_on = (F.col("_local") == 0) & F.col("_sum").isNotNull()
    found = {"run": F.col("_before") + F.col("_local"), "total": F.col("_add") + F.when(goes_on, F.col("_sum")).otherwise(0), "head": F.when(goes_on, F.col("_first")).otherwise(F.col("_head"))}
    return rows.withColumns(found).drop("_local", "_add", "_head", "_before", "_sum", "_first")


def with_halo(rows: DataFrame, order: str, size: int, n: int) -> DataFrame:
    """Rows by ranges of ``order``, which has no holes, each with the ``n`` rows before it as its halo (``_halo``)."""
    if size < n:
        raise ValueError("a range is as long as a frame at least")
    at = F.floor(F.col(order) / size).cast("long")
    late = F.col(order) % size >= size - n
    dealt = rows.withColumn(RANGE, F.explode(F.when(late, F.array(at, at + 1)).otherwise(F.array(at))))
    return dealt.withColumn("_halo", F.col(RANGE) != at)


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str = "_rank", total: str = "_count") -> DataFrame:
    """``rows`` with their rank from 1 in their group's order, and the group's rows.

    The rows are sorted by ranges of group and order, written with their partition and
    place, and counted by group and partition: a rank is a sum of counts and a place. Rows
    that are equal in ``order`` are numbered in any one way. No group is one task.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ordered = rows.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order)
    placed = stored(ordered.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ranked")
    counts = placed.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_start"))
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row for each partition that a group is in
    before = F.coalesce(F.sum("_n").over(over.orderBy("_part").rowsBetween(_ALL, -1)), F.lit(0))
    sums = counts.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_part").alias("_of"), (before - F.col("_start") + 1).alias("_move"), F.sum("_n").over(over).alias(total))
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    out = placed.join(stored(sums, "offsets"), [F.col("_part") == F.col("_of"), *same])
    return out.select(*rows.columns, (F.col("_place") + F.col("_move")).alias(name), total)


def chosen_by_digest(rows: DataFrame, by: str, digest: Column, key: str, ratio: float, deep: int = 3, most: int = 10_000) -> DataFrame:
    """``rows`` with ``chosen``: those of the smallest digests in each class, a half-even share ``ratio``, one at least.

    The last one to choose is found by counts of (class, prefix of the digest): of at most
    16 ** ``deep`` prefixes the one that holds it, refined until ``most`` rows have it, which
    are sorted. Then a row is held against one threshold, (digest, key). Rows of one key go
    together. ``digest`` is in hexadecimal.
    """
    marked = rows.select(F.col(by).alias("_by"), digest.alias("_digest"), F.col(key).alias("_key"))
    kind = marked.schema["_by"].dataType.simpleString()
    depth, open_ = 0, None

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_prefix")
        total = group["n"].cumsum()
        need = int(group["need"].iloc[0]) if "need" in group else max(1, round(int(total.iloc[-1]) * ratio))
        at = int((total >= need).to_numpy().argmax())
        return pd.DataFrame({"_of": [group["_by"].iloc[0]], "_prefix": [group["_prefix"].iloc[at]], "need": [need - int(total.iloc[at] - group["n"].iloc[at])], "rows": [int(group["n"].iloc[at])]})

    while open_ is None or (depth < 32 and (open_.agg(F.max("rows")).first()[0] or 0) > most):
        held, keys = marked, ["_by"]
        if open_ is not None:
            held, keys = _within(marked, open_), ["_by", "need"]
        depth += deep
        counts = held.groupBy(*keys, F.substring("_digest", 1, depth).alias("_prefix")).agg(F.count("*").alias("n"))
        open_ = stored(counts.groupBy("_by").applyInPandas(pick, f"_of {kind}, _prefix string, need long, rows long"), "prefixes")

    def last(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_digest", "_key"])
        return group.iloc[[int(group["need"].iloc[0]) - 1]][["_by", "_digest", "_key"]].rename(columns={"_by": "_of", "_digest": "_last", "_key": "_last_key"})

    ends = _within(marked, open_).groupBy("_by").applyInPandas(last, f"_of {kind}, _last string, _last_key {marked.schema['_key'].dataType.simpleString()}")
    met = rows.withColumn("_digest", digest).join(stored(ends, "thresholds"), F.col(by).eqNullSafe(F.col("_of")))  # one row a class
    return met.withColumn("chosen", F.struct("_digest", F.col(key).alias("_k")) <= F.struct(F.col("_last").alias("_digest"), F.col("_last_key").alias("_k"))).drop("_digest", "_of", "_last", "_last_key")


def _within(marked: DataFrame, open_: DataFrame) -> DataFrame:
    """The rows of each class under its prefix."""
    return marked.join(open_.drop("rows"), F.col("_by").eqNullSafe(F.col("_of")) & F.col("_digest").startswith(F.col("_prefix"))).drop("_of", "_prefix")
