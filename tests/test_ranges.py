"""Two-level scans, ranks and selections against windows over whole groups."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegrid.operators import adaptive as A
from tidegrid.operators import features as T
from tidegrid.operators import normalise as R
from tidegrid.operators import ranges
from tidegrid.operators import segments as G
from tidegrid.operators import splits as X
from tidegrid.operators import statistics as S
from tidegrid.operators import windows as W


def log(spark, n=3000, seed=3):
    """One source with a third of all rows, holes in the row numbers, ties and steps back in time."""
    rng, rows = random.Random(seed), []
    for source, size in [("hot", n // 3), *((f"s{i}", n // 30) for i in range(20)), ("one", 1)]:
        t, row = 0, 1
        for _ in range(size):
            row += rng.choice([1, 1, 1, 2, 40])
            t += rng.choice([10, 10, 10, 20, 30, 12, 0, -5, 70])
            rows.append((source, row, t, rng.random()))
    return spark.createDataFrame(rows, "source string, row_no int, t_us long, amp double").repartition(5)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("size", [1, 7, 100, 10**6])
def test_ranged_segments_equal_whole_ones(spark, size):
    packets = log(spark)
    plain, ranged = G.Grid(10, 4, 3), G.Grid(10, 4, 3, range_rows=size)
    columns = ["source", "row_no", "gap_us", "prev_amp", "n_steps", "snapped", "segment_id", "step", "t0_us"]
    key = lambda rows: sorted(map(repr, rows))  # noqa: E731  nulls among numbers
    got = key(tuple(r) for r in G.segmented(packets, ranged, ["amp"]).select(*columns).collect())
    assert got == key(tuple(r) for r in G.segmented(packets, plain, ["amp"]).select(*columns).collect())
    steps = ["source", "segment_id", "step_index", "grid_t_us", "interp_mask", "delta_t_ms", "amp"]
    assert rows_of(G.resampled(packets, ranged, ["amp"]), *steps) == rows_of(G.resampled(packets, plain, ["amp"]), *steps)
    assert rows_of(A.base_gaps(packets, 7, range_rows=size), "source", "base_gap_us") == rows_of(A.base_gaps(packets, 7), "source", "base_gap_us")


def test_vectors_are_carried_between_ranges(spark):
    packets = log(spark, 300).withColumn("v", F.array(F.col("amp"), -F.col("amp"))).drop("amp")
    got = [rows_of(G.resampled(packets, G.Grid(10, 4, 3, range_rows=s), ["v"]), "source", "segment_id", "step_index", "v") for s in (None, 5)]
    assert got[0] == got[1]


@pytest.mark.parametrize("size", [5, 6, 64])
def test_frames_reach_into_the_range_before(spark, size):
    steps = G.resampled(log(spark), G.Grid(10, 4, 3), ["amp"]).select("source", "segment_id", "step_index", "amp")
    for feature in ("raw", "diff", "ma", "std"):
        whole, ranged = (T.transformed(steps, feature, "amp", 5, s).withColumn("amp", F.round("amp", 9)) for s in (None, size))
        assert ranged.columns == whole.columns and rows_of(ranged, *whole.columns) == rows_of(whole, *whole.columns)
    arrays = steps.withColumn("amp", F.array("amp", F.col("amp") * 2))
    for f in (lambda s: T.ma_residual(arrays, "amp", 3, s), lambda s: T.first_difference(arrays, "amp", s), lambda s: T.rolling_std(arrays, "amp", 3, s)):
        assert rows_of(f(size), "source", "segment_id", "step_index", "amp") == rows_of(f(None), "source", "segment_id", "step_index", "amp")
    with pytest.raises(ValueError):
        T.ma_residual(steps, "amp", 5, 4)


def test_a_hot_source_spreads_over_all_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        packets = log(spark, 6000)
        found = G.segmented(packets, G.Grid(10, 4, 3, range_rows=200)).filter("source = 'hot'")
        tasks = Counter(r.part for r in found.select(F.spark_partition_id().alias("part")).collect())
        assert len(tasks) == 4 and max(tasks.values()) < 0.5 * sum(tasks.values())  # by source it would be one
        ranked = ranges.ranked(packets, ["source"], [F.col("t_us"), F.col("row_no")])
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and ranked.count() == packets.count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranks_equal_a_window(spark):
    rows = log(spark).withColumn("source", F.when(F.col("source") != "s3", F.col("source")))
    w = Window.partitionBy("source").orderBy("t_us", "row_no")
    plain = rows.withColumns({"_rank": F.row_number().over(w).cast("long"), "_count": F.count("*").over(Window.partitionBy("source"))})
    got = ranges.ranked(rows, ["source"], [F.col("t_us"), F.col("row_no")])
    assert Counter(map(repr, got.collect())) == Counter(map(repr, plain.select(*got.columns).collect()))
    alone = ranges.ranked(rows, [], [F.col("amp")])
    assert sorted(r._rank for r in alone.collect()) == list(range(1, rows.count() + 1))
    assert ranges.ranked(rows.limit(0), ["source"], [F.col("amp")]).count() == 0


@pytest.mark.parametrize("k", [1, 3, 7, 500])
def test_blocks_equal_ntile(spark, k):
    rows = log(spark, 600)
    plain = rows.withColumn("block", F.ntile(k).over(Window.partitionBy("source").orderBy("t_us", "row_no")))
    assert rows_of(W.blocks(rows, ["source"], ["t_us", "row_no"], k), *plain.columns) == rows_of(plain, *plain.columns)


@pytest.mark.parametrize("options", [{}, {"most": 3}, {"most": 3, "deep": 1}, {"most": 0, "deep": 2}])
def test_selection_by_digest_equals_sorting(spark, options):
    rows = [(f"c{i % 7 % 3}" if i % 11 else None, i) for i in range(1500)] + [("single", -1)]
    table = spark.createDataFrame(rows, "label string, key long")
    digest = F.md5(F.concat(F.lit("42:"), F.col("key").cast("string")).cast("binary"))
    w = Window.partitionBy("label")
    want = table.withColumn("chosen", F.row_number().over(w.orderBy(digest, "key")) <= F.greatest(F.lit(1), F.bround(F.count("*").over(w) * F.lit(0.2), 0).cast("int")))
    got = ranges.chosen_by_digest(table, "label", digest, "key", 0.2, **options)
    assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert ranges.chosen_by_digest(table.limit(0), "label", digest, "key", 0.2, **options).count() == 0


def test_rows_of_one_key_go_together(spark):
    rows = spark.createDataFrame([("a", i % 10) for i in range(100)], "label string, key int")
    found = Counter((r.key, r.split) for r in X.stratified_rows(rows, 0.25).collect())
    assert len(found) == 10 and sum(n for (_, s), n in found.items() if s == "validation") == 30


def test_statistics_of_long_sources(spark):
    gapped = G.gaps(log(spark))
    got, want = ({r.source: r for r in S.file_stats(gapped, x).collect()} for x in (True, False))
    assert got == want
    packets = log(spark)
    assert rows_of(R.mad_filtered(packets, 1.5, "amp", True), "source", "row_no") == rows_of(R.mad_filtered(packets, 1.5, "amp"), "source", "row_no")
