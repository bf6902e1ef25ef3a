"""Row vectors, first valid rows, counters and window tables."""

import pytest
from pyspark.sql import functions as F

from tidegrid.sources import packets as P
from tidegrid.sources import scratch
from tidegrid.sources import tables as K


def test_row_vectors_take_the_first_valid_width(spark):
    rows = lambda vs: spark.createDataFrame(list(enumerate(vs)), "k int, data array<int>")
    train = rows([None, [1, None], [1, 2], [3], [4, 5], [6], [7]])
    a, b, width, skipped = P.row_vectors(train, rows([[9, 9], [1]]), ["k"])
    assert (width, skipped) == (2, 6) and [r.k for r in a.orderBy("k").collect()] == [2, 4] and b.count() == 1
    with pytest.raises(ValueError, match="widths differ"):
        P.row_vectors(train, rows([[1]]), ["k"])
    for empty in ([], [None], [[None]]):
        with pytest.raises(ValueError, match="no valid row"):
            P.row_vectors(train, rows(empty), ["k"])


def test_first_valid_rows_or_an_error(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "label string, k int")
    assert P.first_valid(rows, ["label"], ["k"], 1).count() == 2
    with pytest.raises(ValueError, match="no valid row"):
        P.first_valid(rows.filter("k > 9"), ["label"], ["k"], 1)


def test_window_tables(spark, tmp_path):
    cut = spark.createDataFrame([("a", 0, 0, [[1.0, 2.0], [3.0, 4.0]], [0, 1], [0.0, 5.0], "big"), ("b", 0, 0, [[5.0, 6.0], [7.0, 8.0]], [1, 0], [1.0, 2.0], "small")], "source string, segment_id int, start_index int, amp array<array<double>>, interp_mask array<int>, delta_t_ms array<double>, label string")
    path = str(tmp_path / "w")
    K.write_windows(cut.withColumn("window_path", F.col("source")), path, "label")
    back = K.read_windows(spark, path)
    assert {v: K.probe(c)["delta_t_ms"] for v, c in K.variants(back).items()} == {"interp_only": False, "interp_mask": False, "interp_mask_deltat": True}
    assert K.probe(K.variants(back)["interp_only"]) == {"interp_mask": False, "delta_t_ms": False, "width": 2}
    channels = {r.source: r.channels for r in K.channel_first(back, "amp", "interp_mask").collect()}
    assert channels == {"a": [[1.0, 3.0], [2.0, 4.0], [0.0, 1.0]], "b": [[5.0, 7.0], [6.0, 8.0], [1.0, 0.0]]}
    assert [(r.label, r.position) for r in K.class_windows(spark, path, ["small", "big"]).orderBy("label").collect()] == [("big", 0), ("small", 0)]
    plan = back.filter("label = 'big'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(label" in plan


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.folder(Session())
    df = scratch.stored(spark.range(3), "x")
    assert df.count() == 3


def test_bucketed_steps_are_read_without_an_exchange(spark, tmp_path):
    from pyspark.sql import Window

    from tidegrid.operators import features as T

    rows = [(s, g, i, float(i * s)) for s in range(6) for g in range(3) for i in range(9)]
    steps = spark.createDataFrame(rows, "source int, segment_id int, step_index int, amp double").repartition(3)
    table = K.write_steps(steps, "bucketed_steps", str(tmp_path / "steps"), 4)
    try:
        assert sorted(map(tuple, table.collect())) == rows
        plans = {
            "features": T.rolling_std(table, "amp", 2),
            "windows": table.withColumn("m", F.max("amp").over(Window.partitionBy("source", "segment_id"))),
            "join": table.join(table.groupBy("source", "segment_id").agg(F.count("*").alias("n")).hint("merge"), ["source", "segment_id"]),
        }
        for name, df in plans.items():
            assert df.count() > 0
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString(), name
    finally:
        spark.sql("DROP TABLE bucketed_steps")


def test_rows_are_counted_while_they_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("a", i % 2, i) for i in range(10)] + [("b", None, 1), ("c", 0, 2)], "g string, h int, k int").repartition(3)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "")
    out = K.counted_write(rows, str(tmp_path / "w"), ["g", "h"], [("a", 0), ("a", 1), ("b", None), ("z", 9)], "g")
    jobs = len(tracker.getJobIdsForGroup("counted"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {(r.g, r.h): r.n for r in out.collect()} == {("a", 0): 5, ("a", 1): 5, ("b", None): 1, ("z", 9): 0, (None, None): 1}
    assert jobs <= 2 and spark.read.parquet(str(tmp_path / "w")).count() == 12  # the write and its shuffle
