"""Moments of vectors and features of vectors in order, against numpy on whole arrays; error masks; weighted losses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import features as T
from tidegrid.operators import metrics as M
from tidegrid.operators import statistics as S
from tidegrid.operators.moments import deviation, merged, of_batch, vector_moments


def test_moments_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(500):
        v = (1e6 + rng.normal(size=rng.integers(0, 7))).tolist()
        if i % 9 == 0 and v:
            v[0] = None
        rows.append((["a", "b", None][i % 3], None if i % 50 == 7 else v))
    table = spark.createDataFrame(rows, "g string, v array<double>").repartition(7)
    for salts in (1, 64):
        got = {(r.g, r.channel): (r.n, r["mean"], r.m2) for r in vector_moments(table, "v", ["g"], salts).collect()}
        for g in ("a", "b", None):
            for c in range(6):
                x = np.array([v[c] for k, v in rows if k == g and v is not None and len(v) > c and v[c] is not None])
                n, mean, m2 = got[g, c]
                assert n == len(x) and mean == pytest.approx(x.mean(), rel=1e-12) and m2 == pytest.approx(((x - x.mean()) ** 2).sum(), rel=1e-6)
    assert vector_moments(table.limit(0), "v").count() == 0
    plan = S.channel_stats(table, "v")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    with pytest.raises(ValueError):
        deviation("other")


def test_parts_merge_in_any_order():
    rng = np.random.default_rng(2)
    x, there = rng.normal(size=(60, 4)), rng.random((60, 4)) < 0.7
    whole = of_batch(x, there)
    parts = [of_batch(x[a:b], there[a:b]) for a, b in ((0, 5), (5, 5), (5, 40), (40, 60))]
    for order in ([0, 1, 2, 3], [3, 1, 0, 2]):
        for got, want in zip(merged(*(np.array([parts[i][k] for i in order]) for k in range(3))), whole, strict=True):
            assert got == pytest.approx(want)


def test_train_stats_scale_the_time_channel_apart(spark):
    rows = spark.createDataFrame([([1.0, 5.0], 3.0), ([3.0, 5.0], 5.0)], "amp array<double>, delta_t_ms double")
    r = S.train_stats(rows, "amp").first()
    assert r.means == [2.0, 5.0] and r.stds == [1.0, pytest.approx(1e-3)] and (r.delta_mean, r.delta_std) == (4.0, 1.0)
    r = S.train_stats(rows, "amp", None).first()
    assert r.means == [2.0, 5.0] and (r.delta_mean, r.delta_std) == (0.0, 1.0)
    r = S.train_stats(rows.limit(0), "amp").first()
    assert r.means in ([], None) and (r.delta_mean, r.delta_std) == (0.0, 1.0)


def test_vector_variation(spark):
    w = [[0.0, 1.0], [2.0, 1.0], [4.0, 7.0]]
    rows = spark.createDataFrame([(1, w), (2, w[:1]), (3, None), (4, []), (5, [[1.0], [1.0, 2.0]]), (6, [None, [1.0]])], "k int, w array<array<double>>")
    got = {r.k: (r.mean_change, r.time_std) for r in S.vector_variation(rows, "w").collect()}
    x = np.array(w)
    assert got[1] == (np.abs(np.diff(x, axis=0)).mean(), pytest.approx(x.std(0).mean()))
    assert got[2] == (None, 0.0) and all(got[k] == (None, None) for k in (3, 4, 5, 6))


def test_phases_across_batches(spark):
    rng = np.random.default_rng(5)
    sizes = {(s, g): 1 + 4 * g + s for s in range(3) for g in range(3)}
    z = {k: rng.normal(size=(n, 2)) + 1j * rng.normal(size=(n, 2)) for k, n in sizes.items()}
    rows = [(s, g, i, x.real.tolist(), x.imag.tolist(), f"{s}{g}{i}") for (s, g), m in z.items() for i, x in enumerate(m)]
    steps = spark.createDataFrame(rows, "source long, segment_id int, step_index long, re array<double>, im array<double>, note string").repartition(5)
    for size in ("10000", "3", "1"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            turns, spreads, angles = T.phase_difference(steps, "re", "im").collect(), T.phase_rolling_std(steps, "re", "im", 3).collect(), T.phase_sin_cos(steps, "re", "im").collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(turns) == sum(n - 1 for n in sizes.values()) and len(spreads) == sum(max(0, n - 3) for n in sizes.values()) and len(angles) == len(rows)
        for r in turns:
            m, i = z[r.source, r.segment_id], r.step_index
            assert r.features == pytest.approx(np.angle(m[i] * m[i - 1].conj())) and r.note == f"{r.source}{r.segment_id}{i}"
        for r in spreads:
            before = z[r.source, r.segment_id][r.step_index - 3 : r.step_index]
            resultant = np.abs((before / np.abs(before)).mean(0))
            assert r.features == pytest.approx(np.sqrt(-2 * np.log(np.clip(resultant, 1e-6, 1))))
        for r in angles:
            m = z[r.source, r.segment_id][r.step_index]
            assert r.features == pytest.approx(np.concatenate([np.sin(np.angle(m)), np.cos(np.angle(m))]))


def test_rows_without_vectors(spark):
    rows = [("s", 0, i, None if i == 2 else [1.0, float(i)][: 1 if i > 5 else 2], [0.0, 1.0][: 1 if i > 5 else 2]) for i in range(9)]
    steps = spark.createDataFrame(rows, "source string, segment_id int, step_index long, re array<double>, im array<double>")
    assert sorted(r.step_index for r in T.phase_difference(steps, "re", "im").collect()) == [1, 4, 5, 7, 8]
    found = {r.step_index: r.features for r in T.phase_sin_cos(steps, "re", "im").collect()}
    assert len(found) == 9 and found[2] is None and len(found[0]) == 4 and len(found[8]) == 2
    assert T.phase_difference(steps.limit(0), "re", "im").count() == T.phase_sin_cos(steps.limit(0), "re", "im").count() == 0


def test_error_masks_equal_joins(spark):
    rng = np.random.default_rng(3)
    models = [f"m{i:02d}" for i in range(11)]
    wrong = {m: set(np.flatnonzero(rng.random(300) < 0.1 + 0.08 * i).tolist()) for i, m in enumerate(models)}
    wrong["m03"] = wrong["m04"] = set()
    rows = [(m, s, 1, 0 if s in wrong[m] else 1) for m in models for s in range(300)] * 2
    masks = M.error_masks(spark.createDataFrame(rows, "model string, sample_id int, true int, pred int"), models)
    got = {(r.left, r.right): (r.intersection, r.union, r.jaccard) for r in M.mask_jaccard(masks, models).collect()}
    assert len(got) == 55
    for (a, b), (both, either, share) in got.items():
        assert (both, either) == (len(wrong[a] & wrong[b]), len(wrong[a] | wrong[b])) and share == (both / either if either else 1.0)
    some = [m for m in models if wrong[m]]
    full = M.error_masks(spark.createDataFrame([r for r in rows if r[0] in some], "model string, sample_id int, true int, pred int"), some)
    assert {r.sample_id for r in M.mask_common(full, some).collect()} == set.intersection(*(wrong[m] for m in some))
    alone = {(m, s) for m in models for s in wrong[m] if sum(s in wrong[o] for o in models) == 1}
    assert {tuple(r) for r in M.mask_unique(masks, models).collect()} == alone
    counts = {r.models: r.n for r in M.mask_counts(masks, models).collect()}
    assert sum(counts.values()) == len(set.union(*wrong.values())) and counts.get("m00", 0) == sum(m == "m00" for m, _ in alone)
    plan = M.mask_jaccard(masks, models)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan
    with pytest.raises(ValueError):
        M.error_masks(masks, [str(i) for i in range(64)])


def test_losses(spark):
    rows = spark.createDataFrame([("r", 1, 1.0), ("r", 1, 3.0), ("r", 1, 5.0), ("r", 2, 9.0)], "run string, batch int, loss double")
    assert M.weighted_loss(rows, ["run"]).first().loss == 4.5 and M.batch_mean_loss(rows, ["run"]).first().loss == 6.0
    assert M.weighted_loss(rows.filter(F.col("run") == "x"), ["run"]).count() == 0
