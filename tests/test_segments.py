"""Hand-worked logs through gaps, segments, fills and windows."""

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import adaptive as A
from tidegrid.operators import features as T
from tidegrid.operators import normalise as R
from tidegrid.operators import segments as G
from tidegrid.operators import windows as W


def log(spark, times, values=None):
    values = values or [float(i) for i in range(len(times))]
    rows = [("s", i + 2, t, float(v)) for i, (t, v) in enumerate(zip(times, values, strict=True))]
    return spark.createDataFrame(rows, "source string, row_no int, t_us long, amp double")


def steps(spark, times, values=None, tolerance=4, fill="linear"):
    out = G.resampled(log(spark, times, values), G.Grid(10, tolerance, 3, fill), ["amp"])
    return [(r.segment_id, r.step_index, r.grid_t_us, r.interp_mask, r.amp) for r in out.orderBy("segment_id", "step_index").collect()]


@pytest.mark.parametrize(
    ("times", "tolerance", "segments", "grid", "mask"),
    [
        ([0, 10, 20], 4, [0, 0, 0], [0, 10, 20], [0, 0, 0]),
        ([0, 20], 4, [0, 0, 0], [0, 10, 20], [0, 1, 0]),
        ([0, 14, 24], 4, [0, 0, 0], [0, 10, 20], [0, 0, 0]),
        ([0, 5], 4, [0, 1], [0, 5], [0, 0]),
        ([0, 15], 5, [0, 0, 0], [0, 10, 20], [0, 1, 0]),
        ([0, 25], 5, [0, 0, 0], [0, 10, 20], [0, 1, 0]),
        ([0, 40], 4, [0, 1], [0, 40], [0, 0]),
        ([0, 0], 4, [0, 1], [0, 0], [0, 0]),
        ([10, 0, 10], 4, [0, 1, 1], [10, 0, 10], [0, 0, 0]),
        ([0], 4, [0], [0], [0]),
    ],
)
def test_segmentation(spark, times, tolerance, segments, grid, mask):
    got = steps(spark, times, tolerance=tolerance)
    assert [g[0] for g in got] == segments
    assert [g[2] for g in got] == grid
    assert [g[3] for g in got] == mask


def test_empty_log(spark):
    assert steps(spark, []) == []


@pytest.mark.parametrize(("times", "fill", "values"), [([0, 20], "nearest", [1.0, 5.0, 5.0]), ([0, 30], "nearest", [1.0, 1.0, 5.0, 5.0]), ([0, 30], "ffill", [1.0, 1.0, 1.0, 5.0]), ([0, 20], "linear", [1.0, 3.0, 5.0])])
def test_fills(spark, times, fill, values):
    assert [s[4] for s in steps(spark, times, [1, 5], fill=fill)] == values


def test_delta_and_provenance(spark):
    rows = G.resampled(log(spark, [0, 30]), G.Grid(10, 4, 3), ["amp"]).orderBy("step_index").collect()
    assert [r.delta_t_ms for r in rows] == [0.0, 0.01, 0.01, 0.03]
    assert [r.actual_t_us for r in rows] == [0, None, None, 30]
    assert [r.source_row for r in rows] == [2, None, None, 3]


def test_vectors_fill_like_scalars(spark):
    rows = log(spark, [0, 20, 50]).selectExpr("source", "row_no", "t_us", "array(amp, amp * 2) AS v")
    out = G.resampled(rows, G.Grid(10, 4, 3), ["v"]).orderBy("step_index").collect()
    assert [r.v for r in out][:3] == [[0.0, 0.0], [0.5, 1.0], [1.0, 2.0]]


def test_vectors_met_by_key_fill_like_those_in_the_log(spark):
    rows = log(spark, [0, 10, 40, 55, 65]).withColumn("k", (F.col("row_no") % 3).cast("int"))
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -4.0]), (2, None)], "k int, v array<float>")
    grid, columns = G.Grid(10, 4, 3), ["source", "segment_id", "step_index", "interp_mask", "delta_t_ms", "v"]
    inside = G.resampled(rows.join(vectors, "k").drop("k", "amp"), grid, ["v"]).select(columns).collect()
    by_key = G.resampled(rows.drop("amp"), grid, ["v"], vectors, ["k"])
    assert set(columns) < set(by_key.columns) and not {"k", "prev_k", "prev_v"} & set(by_key.columns)
    assert sorted(map(str, by_key.select(columns).collect())) == sorted(map(str, inside)) and len(inside) > 5


def test_sources_do_not_touch(spark):
    one = steps(spark, [0, 10, 40])
    two = G.resampled(log(spark, [0, 10, 40]).union(log(spark, [7, 17]).selectExpr("'t'", "row_no", "t_us", "amp")), G.Grid(10, 4, 3), ["amp"])
    assert sorted((r.segment_id, r.step_index, r.grid_t_us, r.interp_mask, r.amp) for r in two.filter("source = 's'").collect()) == sorted(one)


def _segment(spark, values):
    return spark.createDataFrame([("s", 0, i, float(v)) for i, v in enumerate(values)], "source string, segment_id int, step_index long, amp double")


def test_rolling_features_exclude_the_current_row(spark):
    rows = _segment(spark, [1, 2, 4, 8])
    assert [r.amp for r in T.first_difference(rows, "amp").orderBy("step_index").collect()] == [1.0, 2.0, 4.0]
    assert [r.amp for r in T.ma_residual(rows, "amp", 2).orderBy("step_index").collect()] == [2.5, 5.0]
    assert [round(r.amp, 6) for r in T.rolling_std(rows, "amp", 2).orderBy("step_index").collect()] == [0.5, 1.0]
    assert [round(r.amp, 9) for r in T.rolling_std(_segment(spark, [3, 3, 3]), "amp", 2).collect()] == [0.001]
    assert T.first_difference(_segment(spark, [1]), "amp").count() == 0
    with pytest.raises(ValueError):
        T.transformed(rows, "nope", "amp")


def test_array_features_equal_scalar_ones(spark):
    rows = _segment(spark, [1, 2, 4, 8, 3])
    wide = rows.selectExpr("source", "segment_id", "step_index", "array(amp) AS amp")
    for f in (lambda d: T.first_difference(d, "amp"), lambda d: T.ma_residual(d, "amp", 2), lambda d: T.rolling_std(d, "amp", 2)):
        a = [r.amp for r in f(rows).orderBy("step_index").collect()]
        b = [r.amp[0] for r in f(wide).orderBy("step_index").collect()]
        assert b == pytest.approx(a)


def test_window_counts(spark):
    packed = G.to_segments(_segment(spark, range(10)), ["amp"])
    cut = W.windows(packed, ["amp"], [4], 3).orderBy("start_index").collect()
    assert [c.start_index for c in cut] == [0, 3, 6]
    assert cut[1].amp == [3.0, 4.0, 5.0, 6.0]
    assert W.windows(G.to_segments(_segment(spark, range(3)), ["amp"]), ["amp"], [4], 1).count() == 0


def test_mad_scale_floor_removes_a_spike(spark):
    rows = log(spark, range(9), [5] * 8 + [6])
    assert [r.amp for r in R.mad_filtered(rows, 3.0, "amp").collect()] == [5.0] * 8


def test_scale_factor_skips_dead_carriers(spark):
    df = spark.createDataFrame([([0.0, 2.0, 4.0], [9.0, 4.0, 12.0]), ([0.0, 0.0, 0.0], [1.0, 1.0, 1.0])], "low array<double>, high array<double>")
    got = [r[0] for r in df.select(R.scale_factor("low", "high", [0, 1, 2], [0, 1, 2])).collect()]
    assert got == [2.5, None]


def _fold(times, a):
    """The adaptive rules, one packet after another."""
    gaps = [b - c for b, c in zip(times[1:], times, strict=False)]
    first = sorted([g for g in gaps if g > 0][: a.initial_gaps])
    base = (first[(len(first) - 1) // 2] + first[len(first) // 2]) / 2 if first else 0.0
    segment, out = 0, [(None, 0)]
    for g in gaps:
        fits = [(abs(g - k * base) / (k * base), k) for k in range(1, a.max_steps + 1) if base > 0 and g > 0 and abs(g - k * base) <= max(a.absolute_us, a.relative * k * base)]
        k = min(fits)[1] if fits else None
        if k == 1:
            base = 2 / (a.ema_span + 1) * g + (1 - 2 / (a.ema_span + 1)) * base
        segment += k is None
        out.append((k, segment))
    return out


def test_adaptive_fold(spark):
    import random

    rng, times, t = random.Random(4), [0], 0
    for _ in range(300):
        t += rng.choice([10, 11, 12, 20, 23, 31, 55, 0, -5, 90])
        times.append(t)
    a = A.Adaptive(max_steps=3, ema_span=5, initial_gaps=5, relative=0.18, absolute_us=1.0)
    got = [(r.k, r.segment_id) for r in A.adaptive_segments(log(spark, times), a).orderBy("row_no").collect()]
    assert got == _fold(times, a)
    assert [r.k for r in A.adaptive_segments(log(spark, [5]), a).collect()] == [None]


def test_adaptive_sources_stay_apart_and_in_batches(spark):
    a = A.Adaptive(max_steps=3, ema_span=5, initial_gaps=5, relative=0.18, absolute_us=1.0)
    times = {1: [0, 10, 21, 30, 70, 80], 2: [5], None: [0, 0, 9, 27, 80], 4: [0, 30, 60, 61, 90]}
    df = spark.createDataFrame([(s, i, t) for s, ts in times.items() for i, t in enumerate(ts)], "source long, row_no int, t_us long")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        out = A.adaptive_segments(df, a)
        rows = out.orderBy("row_no").collect()
    finally:
        spark.conf.set(key, before)
    for source in (1, 2, 4):
        assert [(r.k, r.segment_id) for r in rows if r.source == source] == _fold(times[source], a)
    assert [r.segment_id for r in rows if r.source is None] == [0, 1, 2, 3, 4]
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("stride", [1, 3, 7])
def test_step_windows_equal_slices_without_long_arrays(spark, stride):
    rows = _segment(spark, range(23))
    want = W.windows(G.to_segments(rows, ["amp"]), ["amp"], [4, 5], stride).drop("n_steps")
    got = W.step_windows(rows, ["amp"], [4, 5], stride)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # one window a row at most: packing happens after the rows were dealt to windows
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "start_index" in plan[plan.index("Aggregate") : plan.index("collect_list")]


def test_adaptive_steps_match_segments(spark):
    a = A.Adaptive(max_steps=3, ema_span=5, initial_gaps=5, relative=0.18, absolute_us=1.0)
    rows = A.adaptive_resampled(log(spark, [0, 10, 20, 40, 100, 110]), a, ["amp"]).orderBy("segment_id", "step_index").collect()
    assert [(r.segment_id, r.step_index, r.grid_t_us, r.interp_mask) for r in rows] == [(0, 0, 0, 0), (0, 1, 10, 0), (0, 2, 20, 0), (0, 3, 30, 1), (0, 4, 40, 0), (1, 0, 100, 0), (1, 1, 110, 0)]
