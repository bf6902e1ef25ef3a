"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import vectors as V
from ..operators import adaptive as A
from ..operators import correlation as C
from ..operators import features as T
from ..operators import metrics as M
from ..operators import normalise as R
from ..operators import segments as G
from ..operators import selection as E
from ..operators import splits as X
from ..operators import statistics as S
from ..operators import windows as W
from ..sources import tables as K
from .views import GRID, LONG_GRID, OVERLAP_HIGH, OVERLAP_LOW, VECTOR, complex_packets, files, long_packets, packets, predictions, table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import logs  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import logs  # noqa: F401

    return dict(_SQL)


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded without negative zeros, so that both engines print alike."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def rv(v: Column | str, digits: int = 6) -> Column:
    """By element, as DuckDB rounds: half away from zero, in doubles."""
    m = float(10**digits)
    return F.transform(v, lambda x: F.signum(x.cast("double")) * F.floor(F.abs(x.cast("double")) * m + 0.5) / m + F.lit(0.0))


def q(x: str, digits: int = 6) -> str:
    return f"(round(CAST({x} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def qv(v: str, digits: int = 6) -> str:
    return f"list_transform({v}, lambda z: round(CAST(z AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


# --- views in SQL ---------------------------------------------------------------------

P = """packets AS (
  SELECT user_id AS source, epoch_us(ts) AS t_us, value AS amp, event_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row_no
  FROM events)"""
GAPS = P + """,
gaps AS (SELECT *, t_us - lag(t_us) OVER w AS gap_us, lag(amp) OVER w AS prev_amp FROM packets WINDOW w AS (PARTITION BY source ORDER BY row_no))"""
SEGMENTS = GAPS + """,
near AS (SELECT *, CASE WHEN gap_us > 0 THEN CAST(round_even(CAST(gap_us AS DOUBLE) / 14400000000, 0) AS BIGINT) ELSE -1 END AS n_steps FROM gaps),
snaps AS (SELECT *, coalesce(gap_us > 0 AND n_steps BETWEEN 1 AND 6 AND abs(gap_us - n_steps * 14400000000) <= 5400000000, false) AS snapped FROM near),
numbered AS (SELECT *, CAST(sum(CASE WHEN gap_us IS NOT NULL AND NOT snapped THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS INTEGER) AS segment_id FROM snaps),
segments AS (SELECT *, CAST(sum(CASE WHEN snapped THEN n_steps ELSE 0 END) OVER s AS BIGINT) AS step, first_value(t_us) OVER s AS t0_us,
             CASE WHEN snapped THEN n_steps ELSE 1 END AS m
             FROM numbered WINDOW s AS (PARTITION BY source, segment_id ORDER BY row_no ROWS UNBOUNDED PRECEDING))"""


def steps_sql(fill: str = "linear") -> str:
    blend = {"linear": "(1 - a) * prev_amp + a * amp", "ffill": "prev_amp", "nearest": "CASE WHEN a < 0.5 THEN prev_amp ELSE amp END"}[fill]
    return SEGMENTS + f""",
spread AS (SELECT *, CAST(i AS DOUBLE) / m AS a FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM segments)),
steps AS (SELECT source, segment_id, step - m + i AS step_index, t0_us + (step - m + i) * 14400000000 AS grid_t_us,
                 CASE WHEN i = m THEN t_us END AS actual_t_us, CASE WHEN i = m THEN row_no END AS source_row,
                 CASE WHEN i < m THEN 1 ELSE 0 END AS interp_mask,
                 CASE WHEN NOT snapped THEN CAST(0 AS DOUBLE) WHEN i < m THEN 14400000000 / 1000.0::DOUBLE ELSE gap_us / 1000.0::DOUBLE END AS delta_t_ms,
                 CASE WHEN i = m THEN amp ELSE {blend} END AS amp
          FROM spread)"""


STEPS = steps_sql()
FILES = P + """,
firsts AS (SELECT source, count(*) AS row_count, min(t_us) AS first_us, max(t_us) AS last_us FROM packets GROUP BY source),
files AS (SELECT source, CASE WHEN source % 2 = 0 THEN 'big' ELSE 'small' END AS label, chr(CAST(97 + source % 7 AS INTEGER)) AS person,
                 strftime(make_timestamp(last_us), '%y%m%d') AS date, first_us, row_count,
                 'csi_' || strftime(make_timestamp(first_us), '%Y%m%d_%H%M%S') AS name
          FROM firsts)"""
VECTORS = P + """,
vectors AS (SELECT p.*, list_transform(range(0, 32), lambda k: e.embedding[2 * k + 2]) AS re, list_transform(range(0, 32), lambda k: e.embedding[2 * k + 1]) AS im
            FROM packets p JOIN embeddings e ON e.vec_id = p.event_id % (SELECT count(*) FROM embeddings))"""
COMPLEX_STEPS = VECTORS + """,
gaps AS (SELECT *, t_us - lag(t_us) OVER w AS gap_us, lag(re) OVER w AS prev_re, lag(im) OVER w AS prev_im FROM vectors WINDOW w AS (PARTITION BY source ORDER BY row_no)),
near AS (SELECT *, CASE WHEN gap_us > 0 THEN CAST(round_even(CAST(gap_us AS DOUBLE) / 14400000000, 0) AS BIGINT) ELSE -1 END AS n_steps FROM gaps),
snaps AS (SELECT *, coalesce(gap_us > 0 AND n_steps BETWEEN 1 AND 6 AND abs(gap_us - n_steps * 14400000000) <= 5400000000, false) AS snapped FROM near),
numbered AS (SELECT *, CAST(sum(CASE WHEN gap_us IS NOT NULL AND NOT snapped THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS INTEGER) AS segment_id FROM snaps),
placed AS (SELECT *, CAST(sum(CASE WHEN snapped THEN n_steps ELSE 0 END) OVER (PARTITION BY source, segment_id ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS step,
           CASE WHEN snapped THEN n_steps ELSE 1 END AS m FROM numbered),
spread AS (SELECT *, CAST(i AS DOUBLE) / m AS a FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM placed)),
zsteps AS (SELECT source, segment_id, step - m + i AS step_index,
                  CASE WHEN i = m THEN re ELSE list_transform(range(1, 33), lambda k: CAST((1 - a) * prev_re[k] + a * re[k] AS FLOAT)) END AS re,
                  CASE WHEN i = m THEN im ELSE list_transform(range(1, 33), lambda k: CAST((1 - a) * prev_im[k] + a * im[k] AS FLOAT)) END AS im
           FROM spread)"""
PREDICTIONS = """known AS (SELECT doc_id AS sample_id, CAST(quality AS INTEGER) AS truth, CAST(toxic AS INTEGER) AS toxic FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
predictions AS (SELECT sample_id, truth, 'a' AS model, toxic AS pred FROM known
                UNION ALL SELECT sample_id, truth, 'b', CAST(sample_id % 3 <> 0 AS INTEGER) FROM known
                UNION ALL SELECT sample_id, truth, 'c', 1 FROM known),
wrong AS (SELECT DISTINCT model, sample_id FROM predictions WHERE truth <> pred)"""


def steps(spark: SparkSession, sf_dir: str, fill: str = "linear") -> DataFrame:
    return G.resampled(packets(spark, sf_dir).drop("event_id"), G.Grid(GRID.step_us, GRID.tolerance_us, GRID.max_steps, fill), ["amp"])


def complex_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, vectors = complex_packets(spark, sf_dir)
    return G.resampled(log.drop("event_id", "amp"), GRID, ["re", "im"], vectors, VECTOR)


# --- gaps and their statistics --------------------------------------------------------


@query(f"""WITH {GAPS} SELECT source, count(*) AS row_count, CASE WHEN count(*) > 1 THEN max_by(t_us, row_no) - min_by(t_us, row_no) END AS duration_us,
    median(gap_us) AS median_gap, {q('avg(gap_us)', 2)} AS mean_gap, {q('quantile_cont(gap_us, 0.9)', 2)} AS p90_gap FROM gaps GROUP BY source""")
def gap_stats(spark, sf_dir):
    return S.file_stats(G.gaps(packets(spark, sf_dir))).withColumns({"mean_gap": r("mean_gap", 2), "p90_gap": r("p90_gap", 2)})


@query(f"""WITH {FILES}, g AS (SELECT source, t_us - lag(t_us) OVER (PARTITION BY source ORDER BY row_no) AS gap_us FROM packets)
    SELECT label, count(*) AS n_gaps, {q('avg(gap_us)', 1)} AS mean_gap, median(gap_us) AS median_gap, {q('stddev_pop(gap_us)', 0)} AS std_gap,
    {q('quantile_cont(gap_us, 0.9)', 2)} AS p90_gap, {q('quantile_cont(gap_us, 0.99)', 2)} AS p99_gap FROM g JOIN files USING (source) WHERE gap_us IS NOT NULL GROUP BY label""")
def gap_stats_by_class(spark, sf_dir):
    rows = G.gaps(packets(spark, sf_dir)).join(files(spark, sf_dir).select("source", "label"), "source")
    return S.gap_summary(rows, "label").withColumns({"mean_gap": r("mean_gap", 1), "std_gap": r("std_gap", 0), "p90_gap": r("p90_gap", 2), "p99_gap": r("p99_gap", 2)})


@query(f"""WITH {GAPS}, b AS (SELECT CASE WHEN n >= 1 AND abs(gap_us - n * 14400000000) <= 2700000000 THEN CASE WHEN n <= 3 THEN CAST(n AS VARCHAR) || 'x' ELSE '4x+' END ELSE 'off_grid' END AS bucket
      FROM (SELECT gap_us, CAST(round_even(CAST(gap_us AS DOUBLE) / 14400000000, 0) AS BIGINT) AS n FROM gaps WHERE gap_us IS NOT NULL))
    SELECT bucket, count(*) AS n, {q('CAST(count(*) AS DOUBLE) / sum(count(*)) OVER ()')} AS share FROM b GROUP BY bucket""")
def gap_buckets(spark, sf_dir):
    return S.bucket_counts(G.gaps(packets(spark, sf_dir)), GRID.step_us, 2_700_000_000).withColumn("share", r("share"))


@query(f"""WITH {GAPS}, v AS (SELECT log10(greatest(gap_us / 1000.0::DOUBLE, 0.001)) AS x FROM gaps WHERE gap_us IS NOT NULL), s AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS c FROM v),
    b AS (SELECT CAST(CASE WHEN hi > lo THEN least(floor((x - lo) / ((hi - lo) / 120)), 119) ELSE 0 END AS INTEGER) AS bin, lo, (hi - lo) / 120 AS w FROM v, s)
    SELECT bin, {q('any_value(lo) + bin * any_value(w)')} AS low, count(*) AS n, {q('count(*) / (sum(count(*)) OVER () * any_value(w))')} AS density FROM b GROUP BY bin""")
def gap_histogram(spark, sf_dir):
    values = G.gaps(packets(spark, sf_dir)).filter("gap_us is not null").select(S.log_gap_ms("gap_us").alias("x"))
    return S.histogram(values, "x", 120).withColumns({"low": r("low"), "density": r("density")})


@query(f"""WITH {FILES}, g AS (SELECT source, t_us - lag(t_us) OVER (PARTITION BY source ORDER BY row_no) AS gap_us FROM packets), m AS (SELECT source, median(gap_us) AS v FROM g GROUP BY source)
    SELECT person, label, count(*) AS n_files, {q('avg(v)', 2)} AS mean_value, {q('median(v)', 2)} AS median_value, {q('stddev_pop(v)', 1)} AS std_value FROM m JOIN files USING (source) WHERE v IS NOT NULL GROUP BY ALL""")
def gap_stats_two_level(spark, sf_dir):
    stats = S.file_stats(G.gaps(packets(spark, sf_dir))).join(files(spark, sf_dir).select("source", "person", "label"), "source")
    return S.two_level(stats, ["person", "label"], "median_gap").withColumns({"mean_value": r("mean_value", 2), "median_value": r("median_value", 2), "std_value": r("std_value", 1)})


@query(f"""WITH {FILES}, g AS (SELECT source, t_us - lag(t_us) OVER (PARTITION BY source ORDER BY row_no) AS gap_us FROM packets),
    v AS (SELECT label, gap_us FROM g JOIN files USING (source) WHERE gap_us IS NOT NULL),
    b AS (SELECT label, count(*) AS n, quantile_cont(gap_us, 0.25) AS q1, quantile_cont(gap_us, 0.5) AS q2, quantile_cont(gap_us, 0.75) AS q3 FROM v GROUP BY label)
    SELECT label, any_value(n) AS n, {q('any_value(q1)', 2)} AS q1, {q('any_value(q2)', 2)} AS median, {q('any_value(q3)', 2)} AS q3,
    min(gap_us) FILTER (gap_us BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low, max(gap_us) FILTER (gap_us BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high
    FROM v JOIN b USING (label) GROUP BY label""")
def gap_box_stats(spark, sf_dir):
    rows = G.gaps(packets(spark, sf_dir)).join(files(spark, sf_dir).select("source", "label"), "source")
    return S.box_stats(rows, ["label"], "gap_us").withColumns({c: r(c, 2) for c in ("q1", "median", "q3")})


@query(f"""WITH {GAPS}, c AS (SELECT quantile_cont(gap_us, 0.25) AS a, quantile_cont(gap_us, 0.75) AS b, quantile_cont(gap_us, 0.99) AS z FROM gaps WHERE gap_us IS NOT NULL)
    SELECT CASE WHEN gap_us <= a THEN 'small' WHEN gap_us >= b THEN 'large' ELSE 'middle' END AS gap_group, count(*) AS n, {q('avg(gap_us)', 1)} AS mean_gap, {q('avg(abs(amp - prev_amp))')} AS mean_change
    FROM gaps, c WHERE gap_us IS NOT NULL AND gap_us <= z GROUP BY 1""")
def gap_trimmed_groups(spark, sf_dir):
    return S.trimmed_groups(G.gaps(packets(spark, sf_dir), ["amp"]), "amp").withColumns({"mean_gap": r("mean_gap", 1), "mean_change": r("mean_change")})


# --- segments and grids ---------------------------------------------------------------


@query(f"WITH {SEGMENTS} SELECT source, row_no, gap_us, n_steps, snapped FROM segments")
def grid_snap(spark, sf_dir):
    return G.segmented(packets(spark, sf_dir), GRID).select("source", F.col("row_no").cast("long").alias("row_no"), "gap_us", "n_steps", "snapped")


@query(f"WITH {SEGMENTS} SELECT source, row_no, segment_id, step, t0_us FROM segments")
def segment_ids(spark, sf_dir):
    return G.segmented(packets(spark, sf_dir), GRID).select("source", F.col("row_no").cast("long").alias("row_no"), "segment_id", "step", "t0_us")


def _resample_sql(fill: str) -> str:
    return f"WITH {steps_sql(fill)} SELECT source, segment_id, step_index, grid_t_us, interp_mask, {q('amp')} AS amp FROM steps"


def _resample(spark, sf_dir, fill):
    return steps(spark, sf_dir, fill).select("source", "segment_id", "step_index", "grid_t_us", "interp_mask", r("amp").alias("amp"))


@query(_resample_sql("linear"))
def resample_linear(spark, sf_dir):
    return _resample(spark, sf_dir, "linear")


@query(_resample_sql("ffill"))
def resample_ffill(spark, sf_dir):
    return _resample(spark, sf_dir, "ffill")


@query(_resample_sql("nearest"))
def resample_nearest(spark, sf_dir):
    return _resample(spark, sf_dir, "nearest")


@query(f"WITH {STEPS} SELECT source, segment_id, step_index, actual_t_us, source_row, {q('delta_t_ms', 3)} AS delta_t_ms FROM steps")
def resample_delta_t(spark, sf_dir):
    return steps(spark, sf_dir).select("source", "segment_id", "step_index", "actual_t_us", F.col("source_row").cast("long").alias("source_row"), r("delta_t_ms", 3).alias("delta_t_ms"))


@query(f"WITH {STEPS} SELECT source, count(*) AS n_steps, CAST(sum(interp_mask) AS BIGINT) AS n_filled, CAST(max(segment_id) + 1 AS INTEGER) AS n_segments, {q('avg(amp)')} AS mean_amp FROM steps GROUP BY source")
def segment_summary(spark, sf_dir):
    return steps(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_steps"), F.sum("interp_mask").alias("n_filled"), (F.max("segment_id") + 1).alias("n_segments"), r(F.avg("amp")).alias("mean_amp"))


@query(f"WITH {COMPLEX_STEPS} SELECT source, segment_id, step_index, {qv('re', 4)} AS re, {qv('im', 4)} AS im FROM zsteps")
def resample_complex(spark, sf_dir):
    return complex_steps(spark, sf_dir).select("source", "segment_id", "step_index", rv("re", 4).alias("re"), rv("im", 4).alias("im"))


# --- features -------------------------------------------------------------------------


@query(f"WITH {STEPS}, d AS (SELECT *, amp - lag(amp) OVER (PARTITION BY source, segment_id ORDER BY step_index) AS v FROM steps) SELECT source, segment_id, step_index, {q('v')} AS amp FROM d WHERE v IS NOT NULL")
def first_difference(spark, sf_dir):
    return T.first_difference(steps(spark, sf_dir), "amp").select("source", "segment_id", "step_index", r("amp").alias("amp"))


_ROLL = "(PARTITION BY source, segment_id ORDER BY step_index ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
_PLACE = "row_number() OVER (PARTITION BY source, segment_id ORDER BY step_index) AS k"


@query(f"WITH {STEPS}, d AS (SELECT *, amp - avg(amp) OVER {_ROLL} AS v, {_PLACE} FROM steps) SELECT source, segment_id, step_index, {q('v')} AS amp FROM d WHERE k > 5")
def ma_residual(spark, sf_dir):
    return T.transformed(steps(spark, sf_dir), "ma", "amp", 5).select("source", "segment_id", "step_index", r("amp").alias("amp"))


@query(f"WITH {STEPS}, d AS (SELECT *, sqrt(greatest(var_pop(amp) OVER {_ROLL}, 1e-6)) AS v, {_PLACE} FROM steps) SELECT source, segment_id, step_index, {q('v', 5)} AS amp FROM d WHERE k > 5")
def rolling_std(spark, sf_dir):
    return T.transformed(steps(spark, sf_dir), "std", "amp", 5).select("source", "segment_id", "step_index", r("amp", 5).alias("amp"))


# --- the same in two levels, for sources of any length ---------------------------------


@query(_SQL["segment_ids"])
def segment_ids_ranged(spark, sf_dir):
    return G.segmented(long_packets(spark, sf_dir), LONG_GRID).select("source", F.col("row_no").cast("long").alias("row_no"), "segment_id", "step", "t0_us")


def _long_steps(spark, sf_dir):
    return G.resampled(long_packets(spark, sf_dir).drop("event_id"), LONG_GRID, ["amp"])


@query(_SQL["resample_linear"])
def resample_linear_ranged(spark, sf_dir):
    return _long_steps(spark, sf_dir).select("source", "segment_id", "step_index", "grid_t_us", "interp_mask", r("amp").alias("amp"))


@query(_SQL["first_difference"])
def first_difference_ranged(spark, sf_dir):
    return T.transformed(_long_steps(spark, sf_dir), "diff", "amp", range_steps=16).select("source", "segment_id", "step_index", r("amp").alias("amp"))


@query(_SQL["ma_residual"])
def ma_residual_ranged(spark, sf_dir):
    return T.transformed(_long_steps(spark, sf_dir), "ma", "amp", 5, range_steps=16).select("source", "segment_id", "step_index", r("amp").alias("amp"))


@query(_SQL["rolling_std"])
def rolling_std_ranged(spark, sf_dir):
    return T.transformed(_long_steps(spark, sf_dir), "std", "amp", 5, range_steps=16).select("source", "segment_id", "step_index", r("amp", 5).alias("amp"))


@query(_SQL["gap_stats"])
def gap_stats_ranged(spark, sf_dir):
    return S.file_stats(G.gaps(long_packets(spark, sf_dir), range_rows=16), long_sources=True).withColumns({"mean_gap": r("mean_gap", 2), "p90_gap": r("p90_gap", 2)})


_KEYS = ["source", "segment_id", "step_index"]
_ANGLE = "atan2(CAST(im[k] AS DOUBLE), CAST(re[k] AS DOUBLE))"


@query(f"WITH {COMPLEX_STEPS} SELECT source, segment_id, step_index, {qv(f'list_transform(range(1, 33), lambda k: sin({_ANGLE}))', 5)} || {qv(f'list_transform(range(1, 33), lambda k: cos({_ANGLE}))', 5)} AS features FROM zsteps")
def phase_sincos(spark, sf_dir):
    return T.phase_sin_cos(complex_steps(spark, sf_dir), "re", "im", kept=_KEYS).select("source", "segment_id", "step_index", rv("features", 5).alias("features"))


@query(f"""WITH {COMPLEX_STEPS}, d AS (SELECT *, lag(re) OVER w AS pr, lag(im) OVER w AS pi FROM zsteps WINDOW w AS (PARTITION BY source, segment_id ORDER BY step_index))
    SELECT source, segment_id, step_index, {qv('''list_transform(range(1, 33), lambda k: atan2(CAST(im[k] AS DOUBLE) * pr[k] - CAST(re[k] AS DOUBLE) * pi[k], CAST(re[k] AS DOUBLE) * pr[k] + CAST(im[k] AS DOUBLE) * pi[k]))''', 5)} AS features
    FROM d WHERE pr IS NOT NULL""")
def phase_tdiff(spark, sf_dir):
    return T.phase_difference(complex_steps(spark, sf_dir), "re", "im", kept=_KEYS).select("source", "segment_id", "step_index", rv("features", 5).alias("features"))


@query(f"""WITH {COMPLEX_STEPS}, l AS (SELECT source, segment_id, step_index, k, atan2(CAST(im[k] AS DOUBLE), CAST(re[k] AS DOUBLE)) AS x FROM (SELECT *, unnest(range(1, 33)) AS k FROM zsteps)),
    m AS (SELECT *, avg(cos(x)) OVER w AS c, avg(sin(x)) OVER w AS s, row_number() OVER (PARTITION BY source, segment_id, k ORDER BY step_index) AS n FROM l
          WINDOW w AS (PARTITION BY source, segment_id, k ORDER BY step_index ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
    SELECT source, segment_id, step_index, {q('avg(sqrt(greatest(-2 * ln(least(greatest(sqrt(c * c + s * s), 1e-6), 1)), 0)))', 5)} AS mean_spread FROM m WHERE n > 5 GROUP BY ALL""")
def phase_rolling_std(spark, sf_dir):
    rows = T.phase_rolling_std(complex_steps(spark, sf_dir), "re", "im", 5, kept=_KEYS)
    return rows.select("source", "segment_id", "step_index", r(V.mean("features"), 5).alias("mean_spread"))


# --- windows --------------------------------------------------------------------------

_WINDOWS = """, sized AS (SELECT source, segment_id, CAST(count(*) AS INTEGER) AS n_steps FROM steps GROUP BY ALL),
lengths AS (SELECT *, unnest([8, 16]) AS window_length FROM sized),
cut AS (SELECT *, CAST(unnest(range(0, greatest(n_steps - window_length + 1, 0), 4)) AS INTEGER) AS start_index FROM lengths WHERE n_steps >= window_length)"""


@query(f"WITH {STEPS}{_WINDOWS} SELECT source, segment_id, window_length, start_index FROM cut WHERE window_length = 8")
def sliding_windows(spark, sf_dir):
    return W.window_starts(steps(spark, sf_dir), [8], 4).select("source", "segment_id", "window_length", "start_index")


@query(f"WITH {STEPS}{_WINDOWS} SELECT source, segment_id, window_length, start_index FROM cut")
def multi_length_windows(spark, sf_dir):
    return W.window_starts(steps(spark, sf_dir), [8, 16], 4).select("source", "segment_id", "window_length", "start_index")


@query(f"WITH {STEPS}, n AS (SELECT source, segment_id, CAST(count(*) AS INTEGER) AS n_steps FROM steps GROUP BY ALL) SELECT source, segment_id, 8 AS window_length, CAST(unnest(range(0, n_steps - 7, 8)) AS INTEGER) AS start_index FROM n WHERE n_steps >= 8")
def tumbling_windows(spark, sf_dir):
    return W.window_starts(steps(spark, sf_dir), [8], 8).select("source", "segment_id", "window_length", "start_index")


def _cut(spark, sf_dir):
    columns = ["amp", "interp_mask", "grid_t_us"]
    return W.step_windows(steps(spark, sf_dir), columns, [8, 16], 4)


_CUT = f"""WITH {STEPS}{_WINDOWS}, joined AS (
  SELECT c.source, c.segment_id, c.window_length, c.start_index, count(*) AS n, sum(s.interp_mask) AS made, min(s.grid_t_us) AS g0, max(s.grid_t_us) AS g1, list(s.amp ORDER BY s.step_index) AS amp
  FROM cut c JOIN steps s ON s.source = c.source AND s.segment_id = c.segment_id AND s.step_index >= c.start_index AND s.step_index < c.start_index + c.window_length GROUP BY ALL)"""


@query(f"""{_CUT} SELECT CAST(source AS VARCHAR) || '_seg' || CASE WHEN segment_id < 10 THEN '0' ELSE '' END || CAST(segment_id AS VARCHAR) || '_start' || lpad(CAST(start_index AS VARCHAR), 4, '0') AS window_path,
    source, segment_id, window_length, start_index, CAST(start_index + window_length - 1 AS INTEGER) AS end_index, CAST(made AS INTEGER) AS interpolated_steps, {q('made / window_length')} AS interp_ratio, g0 AS grid_start, g1 AS grid_end FROM joined""")
def window_manifest(spark, sf_dir):
    return W.manifest(_cut(spark, sf_dir)).withColumn("interp_ratio", r("interp_ratio"))


@query(f"{_CUT} SELECT window_length, count(*) AS n_windows, {q('avg(CAST(made AS DOUBLE) / window_length)')} AS mean_interp_ratio FROM joined GROUP BY ALL")
def window_interp_ratio(spark, sf_dir):
    return W.manifest(_cut(spark, sf_dir)).groupBy("window_length").agg(F.count("*").alias("n_windows"), r(F.avg("interp_ratio")).alias("mean_interp_ratio"))


@query(f"""{_CUT}, v AS (SELECT CASE WHEN source % 2 = 0 THEN 'big' ELSE 'small' END AS label,
      list_avg(list_transform(range(1, window_length), lambda k: abs(amp[k + 1] - amp[k]))) AS c, list_stddev_pop(amp) AS s FROM joined WHERE window_length = 8)
    SELECT label, count(*) AS n, {q('avg(c)')} AS mean_change, {q('avg(s)', 5)} AS mean_time_std, {q('stddev_pop(c)', 5)} AS std_change FROM v GROUP BY label""".replace("list_stddev_pop(amp)", "list_aggregate(amp, 'stddev_pop')"))
def temporal_variation(spark, sf_dir):
    rows = S.temporal_variation(_cut(spark, sf_dir).filter("window_length = 8"), "amp").withColumn("label", F.when(F.col("source") % 2 == 0, "big").otherwise("small"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), r(F.avg("mean_change")).alias("mean_change"), r(F.avg("time_std"), 5).alias("mean_time_std"), r(F.stddev_pop("mean_change"), 5).alias("std_change"))


# --- vectors --------------------------------------------------------------------------


@query("SELECT vec_id, list_transform(embedding, lambda x: CAST(round_even(CAST(x AS DOUBLE) * 128, 0) AS INTEGER)) AS data FROM embeddings")
def parse_list(spark, sf_dir):
    text = V.list_text(F.transform("embedding", lambda x: F.bround(x.cast("double") * 128, 0).cast("int")))
    return table(spark, sf_dir, "embeddings").select("vec_id", V.parse_list(text).alias("data"))


@query("SELECT vec_id, list_transform([3, 4, 7, 8, 63, 64], lambda i: CAST(embedding[i] AS DOUBLE)) AS data FROM embeddings")
def carrier_gather(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", V.gather_pairs("embedding", [1, 3, 31]).cast("array<double>").alias("data"))


@query(f"SELECT vec_id, {qv('list_transform(range(0, 32), lambda k: sqrt(CAST(embedding[2 * k + 2] AS DOUBLE) * embedding[2 * k + 2] + CAST(embedding[2 * k + 1] AS DOUBLE) * embedding[2 * k + 1]))')} AS amp FROM embeddings")
def amplitude(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", rv(V.amplitude(V.real("embedding"), V.imag("embedding"))).alias("amp"))


_AMP = "list_transform(range(0, 32), lambda k: sqrt(CAST(embedding[2 * k + 2] AS DOUBLE) * embedding[2 * k + 2] + CAST(embedding[2 * k + 1] AS DOUBLE) * embedding[2 * k + 1]))"
_SCALED = f"""amps AS (SELECT vec_id, embedding, {_AMP} AS amp FROM embeddings),
scaled AS (SELECT vec_id, embedding, amp, list_median(list_filter(list_transform(range(1, 11), lambda k: CASE WHEN amp[k] > 1e-8 THEN amp[k + 10] / amp[k] END), lambda x: x IS NOT NULL)) AS scale FROM amps)""".replace("list_median(", "list_aggregate(").replace("lambda x: x IS NOT NULL))", "lambda x: x IS NOT NULL), 'median')")


def _scaled(spark, sf_dir):
    amps = table(spark, sf_dir, "embeddings").withColumn("amp", V.amplitude(V.real("embedding"), V.imag("embedding")))
    parts = amps.withColumns({"low": F.slice("amp", 1, 10), "high": F.slice("amp", 11, 22)})
    return parts.withColumn("scale", R.scale_factor("low", "high", OVERLAP_LOW, OVERLAP_HIGH))


@query(f"WITH {_SCALED} SELECT vec_id, {q('scale')} AS scale FROM scaled")
def scale_factor(spark, sf_dir):
    return _scaled(spark, sf_dir).select("vec_id", r("scale").alias("scale"))


@query(f"WITH {_SCALED} SELECT vec_id, {qv('list_transform(range(11, 33), lambda k: amp[k] / scale)', 5)} AS amp FROM scaled")
def lltf_norm_amplitude(spark, sf_dir):
    return _scaled(spark, sf_dir).select("vec_id", rv(R.normalised_amplitude("high", "scale"), 5).alias("amp"))


@query(f"WITH {_SCALED} SELECT vec_id, {qv('list_transform(range(10, 32), lambda k: embedding[2 * k + 2] / scale)', 5)} AS re, {qv('list_transform(range(10, 32), lambda k: embedding[2 * k + 1] / scale)', 5)} AS im FROM scaled")
def lltf_norm_complex(spark, sf_dir):
    re, im = R.normalised_complex(F.slice(V.real("embedding").cast("array<double>"), 11, 22), F.slice(V.imag("embedding").cast("array<double>"), 11, 22), "scale")
    return _scaled(spark, sf_dir).select("vec_id", rv(re, 5).alias("re"), rv(im, 5).alias("im"))


@query(f"""WITH {P}, m AS (SELECT source, median(amp) AS m FROM packets GROUP BY source), o AS (SELECT p.*, abs(amp - m) AS off FROM packets p JOIN m USING (source)),
    s AS (SELECT source, greatest(1.4826 * median(off), 1e-6) AS s FROM o GROUP BY source) SELECT source, row_no, {q('amp')} AS amp FROM o JOIN s USING (source) WHERE off / s <= 3""")
def mad_filter(spark, sf_dir):
    return R.mad_filtered(packets(spark, sf_dir), 3.0, "amp").select("source", F.col("row_no").cast("long").alias("row_no"), r("amp").alias("amp"))


@query(_SQL["mad_filter"])
def mad_filter_ranged(spark, sf_dir):
    return R.mad_filtered(long_packets(spark, sf_dir), 3.0, "amp", long_sources=True).select("source", F.col("row_no").cast("long").alias("row_no"), r("amp").alias("amp"))


# --- lagged correlation ---------------------------------------------------------------


def _profile_sql(lags: int) -> str:
    """Real parts over an equi-join by lag, shifted and divided by the column's sum."""
    return COMPLEX_STEPS + f""",
places AS (SELECT *, row_number() OVER (PARTITION BY source, segment_id ORDER BY step_index) AS n FROM zsteps),
rho AS (SELECT a.source, a.segment_id, a.step_index, b.lag,
          list_avg(list_transform(range(1, 33), lambda k: (CAST(a.re[k] AS DOUBLE) * b.re[k] + CAST(a.im[k] AS DOUBLE) * b.im[k])
            / (sqrt(CAST(a.re[k] AS DOUBLE) * a.re[k] + CAST(a.im[k] AS DOUBLE) * a.im[k]) * sqrt(CAST(b.re[k] AS DOUBLE) * b.re[k] + CAST(b.im[k] AS DOUBLE) * b.im[k]) + 1e-6))) AS v
        FROM places a JOIN (SELECT *, unnest(range(1, {lags + 1})) AS lag FROM places) b ON a.source = b.source AND a.segment_id = b.segment_id AND a.step_index = b.step_index + b.lag WHERE a.n > {lags}),
low AS (SELECT *, v - least(min(v) OVER c, 0) AS s FROM rho WINDOW c AS (PARTITION BY source, segment_id, step_index)),
share AS (SELECT *, CASE WHEN sum(s) OVER c > 1e-6 THEN s / sum(s) OVER c ELSE 0 END AS p FROM low WINDOW c AS (PARTITION BY source, segment_id, step_index)),
profiles AS (SELECT source, segment_id, step_index, list(p ORDER BY lag) AS profile FROM share GROUP BY ALL)"""


def _profiles(spark, sf_dir):
    return C.lag_profile(complex_steps(spark, sf_dir), "re", "im", 4)


@query(f"WITH {_profile_sql(4)} SELECT source, segment_id, step_index, {qv('profile', 5)} AS profile FROM profiles")
def lag_profile(spark, sf_dir):
    return _profiles(spark, sf_dir).select("source", "segment_id", "step_index", rv("profile", 5).alias("profile"))


def _magnitude_sql(lags: int, of: str) -> str:
    """Products of carriers by lag, made real by ``of``; clamped shares, kept as they are where their sum is no more than 1e-6."""
    dot, cross = "CAST(a.re[k] AS DOUBLE) * b.re[k] + CAST(a.im[k] AS DOUBLE) * b.im[k]", "CAST(a.im[k] AS DOUBLE) * b.re[k] - CAST(a.re[k] AS DOUBLE) * b.im[k]"
    top = {"abs-real": f"abs({dot})", "magnitude": f"sqrt(({dot}) * ({dot}) + ({cross}) * ({cross}))"}[of]
    size = lambda t: f"sqrt(CAST({t}.re[k] AS DOUBLE) * {t}.re[k] + CAST({t}.im[k] AS DOUBLE) * {t}.im[k])"
    return COMPLEX_STEPS + f""",
places AS (SELECT *, row_number() OVER (PARTITION BY source, segment_id ORDER BY step_index) AS n FROM zsteps),
rho AS (SELECT a.source, a.segment_id, a.step_index, b.lag, greatest(list_avg(list_transform(range(1, 33), lambda k: {top} / ({size('a')} * {size('b')} + 1e-6))), 0) AS v
        FROM places a JOIN (SELECT *, unnest(range(1, {lags + 1})) AS lag FROM places) b ON a.source = b.source AND a.segment_id = b.segment_id AND a.step_index = b.step_index + b.lag WHERE a.n > {lags}),
profiles AS (SELECT source, segment_id, step_index, list(CASE WHEN total > 1e-6 THEN v / total ELSE v END ORDER BY lag) AS profile
             FROM (SELECT *, sum(v) OVER (PARTITION BY source, segment_id, step_index) AS total FROM rho) GROUP BY ALL)"""


@query(f"WITH {_magnitude_sql(4, 'magnitude')} SELECT source, segment_id, step_index, {qv('profile', 5)} AS profile FROM profiles")
def lag_profile_magnitude(spark, sf_dir):
    found = C.lag_profile(complex_steps(spark, sf_dir), "re", "im", 4, "magnitude", "clamp", zero_on_empty=False)
    return found.select("source", "segment_id", "step_index", rv("profile", 5).alias("profile"))


@query(f"WITH {_magnitude_sql(4, 'abs-real')} SELECT source, segment_id, step_index, {qv('profile', 5)} AS profile FROM profiles")
def lag_profile_abs_real(spark, sf_dir):
    found = C.lag_profile(complex_steps(spark, sf_dir), "re", "im", 4, "abs-real", "clamp", zero_on_empty=False)
    return found.select("source", "segment_id", "step_index", rv("profile", 5).alias("profile"))


def _sdp_sql(width: int) -> str:
    return f"""WITH {_profile_sql(4)}, sized AS (SELECT source, segment_id, count(*) AS n, min(step_index) AS s0 FROM profiles GROUP BY ALL),
    cut AS (SELECT *, CAST(unnest(range(0, n - {width} + 1, 4)) AS INTEGER) AS start_index FROM sized WHERE n >= {width})
    SELECT c.source, c.segment_id, c.start_index, CAST(count(*) AS INTEGER) AS width, {q('avg(p.profile[1])', 5)} AS lag1, {q('avg(p.profile[4])', 5)} AS lag4
    FROM cut c JOIN profiles p ON p.source = c.source AND p.segment_id = c.segment_id AND p.step_index >= s0 + start_index AND p.step_index < s0 + start_index + {width} GROUP BY ALL"""


def _sdp(cut: DataFrame) -> DataFrame:
    pick = lambda k: r(V.mean(F.transform("sdp", lambda p: p[k])), 5)
    return cut.select("source", "segment_id", "start_index", F.size("sdp").alias("width"), pick(0).alias("lag1"), pick(3).alias("lag4"))


@query(_sdp_sql(4))
def sdp_paper_windows(spark, sf_dir):
    return _sdp(C.profile_windows(_profiles(spark, sf_dir), 8, 4, 4, paper_style=True))


@query(_sdp_sql(8))
def sdp_lagfirst_windows(spark, sf_dir):
    return _sdp(C.profile_windows(_profiles(spark, sf_dir), 8, 4, 4))


# --- names, files and splits ----------------------------------------------------------


@query(f"""WITH {FILES} SELECT source, strftime(make_timestamp(first_us), '%y%m%d') AS date, person, label, make_timestamp(first_us - first_us % 1000000) AS captured FROM files""")
def filename_parse(spark, sf_dir):
    day = F.date_format(F.timestamp_micros("first_us"), "yyMMdd_HHmmss")
    label = F.when(F.col("label") == "small", "SMAL").otherwise(F.upper("label"))
    parsed = N.parse_capture(F.concat(F.lit("/logs/CSI_"), day, F.lit("_"), F.upper("person"), F.lit("_"), label, F.lit(".csv")))
    return files(spark, sf_dir).select("source", parsed.alias("p"), N.capture_time(F.concat("name", F.lit(".csv"))).cast("timestamp_ntz").alias("captured")).select("source", "p.date", "p.person", "p.label", "captured")


@query(f"WITH {FILES} SELECT person, label, count(*) AS n_files, CAST(sum(row_count) AS BIGINT) AS n_rows FROM files GROUP BY ALL")
def person_totals(spark, sf_dir):
    return S.totals(files(spark, sf_dir), ["person", "label"])


_SUBSETS = """, totals AS (SELECT {g} AS g, CAST(sum(row_count) AS BIGINT) AS n FROM files GROUP BY 1), numbered AS (SELECT g, n, row_number() OVER (ORDER BY g) - 1 AS i FROM totals),
masks AS (SELECT unnest(range(1, (1 << (SELECT count(*) FROM numbered)) - 1)) AS mask),
scored AS (SELECT mask, abs(sum(n) - 0.8::DOUBLE * (SELECT sum(n) FROM totals)) AS d, count(*) AS size, list(i ORDER BY i) AS places, sum(n) AS held FROM masks JOIN numbered ON (mask >> i) & 1 = 1 GROUP BY mask),
best AS (SELECT mask FROM scored ORDER BY {order} LIMIT 1)"""


@query(f"WITH {FILES}{_SUBSETS.format(g='person', order='d, size, places')} SELECT g AS person, (mask >> i) & 1 = 1 AS is_train FROM numbered, best")
def split_person(spark, sf_dir):
    return X.group_split(S.totals(files(spark, sf_dir), ["person"]), "person", "n_rows")


_DATES = "CAST(substr(date, 5, 2) AS INTEGER) % 10"


@query(f"WITH {FILES}{_SUBSETS.format(g=_DATES, order='d, places, held')} SELECT CAST(g AS INTEGER) AS day_group, (mask >> i) & 1 = 1 AS is_train FROM numbered, best")
def split_date(spark, sf_dir):
    days = files(spark, sf_dir).withColumn("day_group", F.substring("date", 5, 2).cast("int") % 10)
    return X.group_split(S.totals(days, ["day_group"]), "day_group", "n_rows", ties="order")


@query(f"""WITH {FILES}, totals AS (SELECT source % 24 AS g, CAST(sum(row_count) AS BIGINT) AS n FROM files GROUP BY 1), numbered AS (SELECT g, n, row_number() OVER (ORDER BY g) - 1 AS i FROM totals),
    goal AS (SELECT 0.8::DOUBLE * sum(n) AS t, count(*) AS k FROM numbered), half AS (SELECT unnest(range(0, 1 << 12)) AS mask),
    low AS (SELECT mask, coalesce(sum(n), 0) AS s, count(n) AS c, coalesce(list(i ORDER BY i) FILTER (n IS NOT NULL), []) AS p FROM half LEFT JOIN numbered ON i < 12 AND (mask >> i) & 1 = 1 GROUP BY mask),
    high AS (SELECT mask, coalesce(sum(n), 0) AS s, count(n) AS c, coalesce(list(i ORDER BY i) FILTER (n IS NOT NULL), []) AS p FROM half LEFT JOIN numbered ON i >= 12 AND (mask >> (i - 12)) & 1 = 1 GROUP BY mask),
    sums AS (SELECT s, min(struct_pack(c := c, p := p)) AS b FROM high WHERE c BETWEEN 1 AND 11 GROUP BY s UNION ALL SELECT s, struct_pack(c := c, p := p) FROM high WHERE c NOT BETWEEN 1 AND 11),
    pairs AS (SELECT l.s + h.s AS held, l.c + h.b.c AS size, l.p || h.b.p AS places FROM low l JOIN sums h ON l.s + h.s BETWEEN (SELECT t FROM goal) - 20 AND (SELECT t FROM goal) + 20),
    best AS (SELECT places FROM pairs WHERE size BETWEEN 1 AND (SELECT k - 1 FROM goal) ORDER BY abs(held - (SELECT t FROM goal)), size, places LIMIT 1)
    SELECT CAST(g AS BIGINT) AS day_group, list_contains(places, i) AS is_train FROM numbered, best""")
def split_many_groups(spark, sf_dir):
    """24 groups, by the sums of two halves."""
    days = files(spark, sf_dir).withColumn("day_group", F.col("source") % 24)
    return X.group_split(S.totals(days, ["day_group"]), "day_group", "n_rows")


_LAST = "CASE WHEN row_number() OVER (PARTITION BY label ORDER BY first_us DESC, source DESC) <= greatest(1, round_even(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE, 0)) THEN 'validation' ELSE 'train' END"


def _time_split(spark, sf_dir):
    return X.time_file(files(spark, sf_dir), 0.2, time="first_us", name="source")


@query(f"WITH {FILES} SELECT source, label, {_LAST} AS split FROM files")
def split_time_file(spark, sf_dir):
    return _time_split(spark, sf_dir).select("source", "label", "split")


@query(f"WITH {FILES}, b AS (SELECT *, ntile(5) OVER (PARTITION BY label ORDER BY first_us, source) AS block FROM files) SELECT source, label, CASE WHEN block = 5 THEN 'validation' ELSE 'train' END AS split FROM b")
def split_time_block(spark, sf_dir):
    return X.time_block(files(spark, sf_dir), 5, time="first_us", name="source").select("source", "label", "split")


@query(f"WITH {FILES} SELECT source, label, CAST(ntile(5) OVER (PARTITION BY label ORDER BY first_us, source) AS INTEGER) AS block FROM files")
def time_blocks(spark, sf_dir):
    return W.blocks(files(spark, sf_dir), ["label"], ["first_us", "source"], 5).select("source", "label", "block")


@query(f"WITH {STEPS}{_WINDOWS}, {FILES.removeprefix(P + ',')}, s AS (SELECT source, {_LAST} AS split FROM files) SELECT c.source, c.segment_id, c.window_length, c.start_index FROM cut c WHERE c.source IN (SELECT source FROM s WHERE split = 'validation')")
def split_semi_join(spark, sf_dir):
    cut = W.window_starts(steps(spark, sf_dir), [8, 16], 4)
    return X.members(cut, _time_split(spark, sf_dir), "validation", ["source"]).select("source", "segment_id", "window_length", "start_index")


@query(f"WITH {FILES}, s AS (SELECT source, label, {_LAST} AS split FROM files) SELECT split, label, count(*) AS n FROM s GROUP BY ROLLUP (split, label)")
def split_label_rollup(spark, sf_dir):
    return S.rollup_counts(_time_split(spark, sf_dir), "split", "label")


# --- channels, classes and carriers ---------------------------------------------------

_CELLS = "SELECT label, unnest(range(0, 64)) AS channel, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"


@query(f"WITH c AS ({_CELLS}) SELECT CAST(channel AS INTEGER) AS channel, count(*) AS n, {q('avg(x)')} AS mean, {q('sqrt(greatest(var_pop(x), 1e-6))')} AS std FROM c GROUP BY channel")
def channel_stats_floor(spark, sf_dir):
    return S.channel_stats(table(spark, sf_dir, "embeddings"), "embedding").withColumns({"mean": r("mean"), "std": r("std")})


@query(f"""WITH {COMPLEX_STEPS.replace("SELECT source, segment_id, step - m + i AS step_index,", "SELECT source, segment_id, step - m + i AS step_index, CASE WHEN NOT snapped THEN CAST(0 AS DOUBLE) WHEN i < m THEN 14400000000 / 1000.0::DOUBLE ELSE gap_us / 1000.0::DOUBLE END AS delta_t_ms,")},
    c AS (SELECT unnest(range(1, 33)) AS k, CAST(unnest(re) AS DOUBLE) AS x FROM zsteps), s AS (SELECT k, avg(x) AS m, sqrt(greatest(var_pop(x), 1e-6)) AS d FROM c GROUP BY k)
    SELECT (SELECT {qv('list(m ORDER BY k)', 5)} FROM s) AS means, (SELECT {qv('list(d ORDER BY k)', 5)} FROM s) AS stds, {q('avg(delta_t_ms)', 1)} AS delta_mean, {q('stddev_pop(delta_t_ms)', 1)} AS delta_std FROM zsteps""")
def train_stats(spark, sf_dir):
    rows = S.train_stats(complex_steps(spark, sf_dir), "re")
    return rows.select(rv("means", 5).alias("means"), rv("stds", 5).alias("stds"), r("delta_mean", 1).alias("delta_mean"), r("delta_std", 1).alias("delta_std"))


@query(f"""WITH {COMPLEX_STEPS}, sized AS (SELECT source, segment_id, count(*) AS n FROM zsteps GROUP BY ALL), cut AS (SELECT *, unnest(range(0, n - 7, 4)) AS start_index FROM sized WHERE n >= 8),
    cells AS (SELECT c.source, c.segment_id, c.start_index, s.step_index, unnest(range(1, 33)) AS k, CAST(unnest(s.re) AS DOUBLE) AS x FROM cut c JOIN zsteps s ON s.source = c.source AND s.segment_id = c.segment_id AND s.step_index >= c.start_index AND s.step_index < c.start_index + 8),
    moved AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY source, segment_id, start_index, k ORDER BY step_index)) AS d FROM cells),
    carriers AS (SELECT source, segment_id, start_index, k, avg(d) AS d, stddev_pop(x) AS t FROM moved GROUP BY ALL)
    SELECT source, segment_id, CAST(start_index AS INTEGER) AS start_index, {q('avg(d)', 5)} AS mean_change, {q('avg(t)', 5)} AS time_std FROM carriers GROUP BY ALL""")
def vector_variation(spark, sf_dir):
    cut = W.step_windows(complex_steps(spark, sf_dir), ["re"], [8], 4)
    return S.vector_variation(cut, "re").select("source", "segment_id", "start_index", r("mean_change", 5).alias("mean_change"), r("time_std", 5).alias("time_std"))


@query(f"WITH c AS ({_CELLS}) SELECT CAST(channel AS INTEGER) AS channel, count(*) AS n, {q('avg(x)')} AS mean, {q('CASE WHEN stddev_pop(x) < 1e-6 THEN 1 ELSE stddev_pop(x) END')} AS std FROM c GROUP BY channel")
def channel_stats_unit(spark, sf_dir):
    return S.channel_stats(table(spark, sf_dir, "embeddings"), "embedding", "unit").withColumns({"mean": r("mean"), "std": r("std")})


@query(f"""WITH c AS ({_CELLS}), s AS (SELECT channel, avg(x) AS m, sqrt(greatest(var_pop(x), 1e-6)) AS d FROM c GROUP BY channel), p AS (SELECT list(m ORDER BY channel) AS ms, list(d ORDER BY channel) AS ds FROM s)
    SELECT vec_id, {qv('list_transform(range(1, 65), lambda k: (embedding[k] - ms[k]) / ds[k])', 5)} AS z FROM embeddings, p""")
def standardize(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    stats = S.packed_stats(S.channel_stats(rows, "embedding"))
    return rows.crossJoin(F.broadcast(stats)).select("vec_id", rv(V.standardise(F.col("embedding").cast("array<double>"), "means", "stds"), 5).alias("z"))  # one row of statistics


@query(f"SELECT label, count(*) AS n, {q('CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*))')} AS weight FROM embeddings GROUP BY label")
def class_weights(spark, sf_dir):
    return S.class_weights(table(spark, sf_dir, "embeddings"), "label").withColumn("weight", r("weight"))


@query(f"""WITH c AS ({_CELLS}), m AS (SELECT label, CAST(channel // 8 AS INTEGER) AS row, CAST(channel % 8 AS INTEGER) AS "column", avg(x) AS mean, stddev_pop(x) AS std FROM c GROUP BY ALL)
    SELECT label, row, "column", {q('mean')} AS mean, {q('std')} AS std, {', '.join(f"{q(f'{f}({c}) OVER ()')} AS {c}_{f}" for c in ('mean', 'std') for f in ('min', 'max'))} FROM m""")
def class_heatmap(spark, sf_dir):
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 8 + 1, 8))
    return S.class_heatmap(table(spark, sf_dir, "embeddings").withColumn("m", grid), "m", "label").withColumns({c: r(c) for c in ("mean", "std", "mean_min", "mean_max", "std_min", "std_max")})


@query(f"WITH c AS ({_CELLS}) SELECT CAST(channel // 8 AS INTEGER) AS row, CAST(channel % 8 AS INTEGER) AS \"column\", {q('avg(x)')} AS mean, {q('sqrt(greatest(var_pop(x), 1e-6))')} AS std FROM c GROUP BY ALL")
def pixel_stats(spark, sf_dir):
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 8 + 1, 8))
    return S.pixel_stats(table(spark, sf_dir, "embeddings").withColumn("m", grid), "m").withColumns({"mean": r("mean"), "std": r("std")})


@query(f"""WITH a AS (SELECT unnest(range(0, 32)) AS carrier, embedding FROM embeddings), z AS (SELECT carrier, CAST(embedding[2 * carrier + 2] AS DOUBLE) AS re, CAST(embedding[2 * carrier + 1] AS DOUBLE) AS im FROM a)
    SELECT CAST(carrier AS INTEGER) AS carrier, {q('avg(sqrt(re * re + im * im))')} AS mean_amplitude, {q('stddev_pop(sqrt(re * re + im * im))')} AS std_amplitude, {q('stddev_pop(atan2(im, re))')} AS std_phase FROM z GROUP BY ALL""")
def carrier_summary(spark, sf_dir):
    re, im = V.real("embedding"), V.imag("embedding")
    rows = table(spark, sf_dir, "embeddings").select(V.amplitude(re, im).alias("a"), V.phase(re, im).alias("p"))
    return S.carrier_summary(rows, "a", "p").withColumns({c: r(c) for c in ("mean_amplitude", "std_amplitude", "std_phase")})


# --- results --------------------------------------------------------------------------


def _model(spark, sf_dir):
    return predictions(spark, sf_dir).filter("model = 'b'")


_CELLS_OF_B = f"{PREDICTIONS}, cells AS (SELECT t.c AS truth, p.c AS pred, count(x.sample_id) AS n FROM (SELECT unnest([0, 1]) AS c) t CROSS JOIN (SELECT unnest([0, 1]) AS c) p LEFT JOIN predictions x ON x.model = 'b' AND x.truth = t.c AND x.pred = p.c GROUP BY ALL)"


@query(f'WITH {_CELLS_OF_B} SELECT truth AS "true", pred, n FROM cells')
def confusion_matrix(spark, sf_dir):
    return M.confusion(_model(spark, sf_dir), [0, 1])


@query(f"""WITH {_CELLS_OF_B}, t AS (SELECT truth AS c, sum(n) AS support, sum(CASE WHEN truth = pred THEN n ELSE 0 END) AS tp FROM cells GROUP BY 1), p AS (SELECT pred AS c, sum(n) AS predicted FROM cells GROUP BY 1),
    s AS (SELECT c, support, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0 END AS pr, CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0 END AS rc FROM t JOIN p USING (c))
    SELECT c AS class, CAST(support AS BIGINT) AS support, {q('pr')} AS precision, {q('rc')} AS recall, {q('CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END')} AS f1 FROM s""")
def precision_recall_f1(spark, sf_dir):
    return M.class_scores(M.confusion(_model(spark, sf_dir), [0, 1])).withColumns({c: r(c) for c in ("precision", "recall", "f1")})


@query(f"""WITH {_CELLS_OF_B}, t AS (SELECT truth AS c, sum(n) AS support, sum(CASE WHEN truth = pred THEN n ELSE 0 END) AS tp FROM cells GROUP BY 1), p AS (SELECT pred AS c, sum(n) AS predicted FROM cells GROUP BY 1),
    s AS (SELECT CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0 END AS pr, CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0 END AS rc FROM t JOIN p USING (c))
    SELECT {q('avg(pr)')} AS macro_precision, {q('avg(rc)')} AS macro_recall, {q('avg(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END)')} AS macro_f1 FROM s""")
def macro_scores(spark, sf_dir):
    return M.macro_scores(M.class_scores(M.confusion(_model(spark, sf_dir), [0, 1]))).withColumns({c: r(c) for c in ("macro_precision", "macro_recall", "macro_f1")})


@query(f"WITH {PREDICTIONS}, runs AS (SELECT model, sample_id % 3 AS seed, avg(CAST(truth = pred AS INTEGER)) AS accuracy FROM predictions GROUP BY ALL) SELECT model, count(*) AS n_runs, {q('avg(accuracy)')} AS accuracy_mean, {q('coalesce(stddev_samp(accuracy), 0)')} AS accuracy_std FROM runs GROUP BY model")
def seed_mean_std(spark, sf_dir):
    runs = predictions(spark, sf_dir).groupBy("model", (F.col("sample_id") % 3).alias("seed")).agg(F.avg((F.col("true") == F.col("pred")).cast("int")).alias("accuracy"))
    return M.seed_summary(runs, ["model"], ["accuracy"]).withColumns({"accuracy_mean": r("accuracy_mean"), "accuracy_std": r("accuracy_std")})


_HISTORY = """h AS (SELECT o_custkey % 50 AS run, CAST(o_orderkey % 20 AS INTEGER) AS epoch, CAST(count(*) % 5 AS DOUBLE) AS acc, CAST(sum(o_custkey) % 7 AS DOUBLE) AS loss FROM orders GROUP BY ALL)"""


def _history(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("run"), (F.col("o_orderkey") % 20).cast("int").alias("epoch"))
    return rows.agg((F.count("*") % 5).cast("double").alias("validation_accuracy"), (F.sum("o_custkey") % 7).cast("double").alias("validation_loss"))


@query(f"WITH {_HISTORY} SELECT run, arg_max(epoch, (acc, -epoch)) AS first_best, arg_max(epoch, (acc, epoch)) AS last_best, arg_max(epoch, (acc, -loss, -epoch)) AS loss_best FROM h GROUP BY run")
def best_epoch(spark, sf_dir):
    return M.best_epochs(_history(spark, sf_dir), {"first_best": "first", "last_best": "last", "loss_best": "loss"})


MODELS = ["a", "b", "c"]


def _masks(spark, sf_dir):
    return M.error_masks(predictions(spark, sf_dir), MODELS)


@query(f"""WITH {PREDICTIONS}, models AS (SELECT unnest(['a', 'b', 'c']) AS m), pairs AS (SELECT x.m AS l, y.m AS r FROM models x JOIN models y ON x.m < y.m),
    j AS (SELECT l, r, (SELECT count(*) FROM wrong a JOIN wrong b ON a.sample_id = b.sample_id AND a.model = l AND b.model = r) AS i, (SELECT count(DISTINCT sample_id) FROM wrong WHERE model IN (l, r)) AS u FROM pairs)
    SELECT l AS "left", r AS "right", i AS intersection, u AS "union", {q('CASE WHEN u = 0 THEN 1 ELSE CAST(i AS DOUBLE) / u END')} AS jaccard FROM j""")
def error_jaccard(spark, sf_dir):
    return M.mask_jaccard(_masks(spark, sf_dir), MODELS).withColumn("jaccard", r("jaccard"))


@query(f"WITH {PREDICTIONS} SELECT sample_id FROM wrong GROUP BY sample_id HAVING count(*) = 3")
def errors_common(spark, sf_dir):
    return M.mask_common(_masks(spark, sf_dir), MODELS)


@query(f"WITH {PREDICTIONS} SELECT min(model) AS model, sample_id FROM wrong GROUP BY sample_id HAVING count(*) = 1")
def errors_unique(spark, sf_dir):
    return M.mask_unique(_masks(spark, sf_dir), MODELS)


@query(f"WITH {PREDICTIONS}, m AS (SELECT sample_id, string_agg(model, ',' ORDER BY model) AS models FROM wrong GROUP BY sample_id) SELECT models, count(*) AS n FROM m GROUP BY models")
def error_mask_counts(spark, sf_dir):
    return M.mask_counts(_masks(spark, sf_dir), MODELS)


@query(f"WITH {PREDICTIONS} SELECT sample_id, truth AS \"true\", CAST(string_agg(model || '=' || CAST(pred AS VARCHAR), ',' ORDER BY model) AS VARCHAR) AS predictions FROM predictions GROUP BY ALL HAVING bool_or(truth <> pred)")
def error_records(spark, sf_dir):
    rows = M.error_records(predictions(spark, sf_dir))
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("predictions")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return rows.select("sample_id", "true", flat.alias("predictions"))


# --- adaptive segmentation ------------------------------------------------------------

ADAPTIVE = A.Adaptive(max_steps=6, ema_span=8, initial_gaps=8, relative=0.18, absolute_us=5_400_000_000.0, long_factor=3.5)
_ERRORS = "list_filter(list_transform([1, 2, 3, 4, 5, 6], lambda k: CASE WHEN abs(g.gap_us - k * w.base) <= greatest(5400000000::DOUBLE, k * w.base * 0.18::DOUBLE) THEN {'e': abs(g.gap_us - k * w.base) / (k * w.base), 'k': k} END), lambda x: x IS NOT NULL)"
_WALK = GAPS + f""",
firsts AS (SELECT source, median(gap_us) AS base FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY row_no) AS j FROM gaps WHERE gap_us > 0) WHERE j <= 8 GROUP BY source),
walk AS (
  SELECT p.source, p.row_no, CAST(NULL AS BIGINT) AS gap_us, CAST(NULL AS INTEGER) AS k, coalesce(f.base, 0)::DOUBLE AS used, coalesce(f.base, 0)::DOUBLE AS base FROM gaps p LEFT JOIN firsts f USING (source) WHERE p.row_no = 1
  UNION ALL
  SELECT source, row_no, gap_us, k, base, CASE WHEN k = 1 THEN (2.0::DOUBLE / 9) * gap_us + (1 - 2.0::DOUBLE / 9) * base ELSE base END
  FROM (SELECT g.source, g.row_no, g.gap_us, w.base, CASE WHEN g.gap_us > 0 AND w.base > 0 THEN CAST(list_min({_ERRORS}).k AS INTEGER) END AS k FROM walk w JOIN gaps g ON g.source = w.source AND g.row_no = w.row_no + 1)),
split AS (SELECT *, CASE WHEN gap_us IS NOT NULL AND k IS NULL THEN CASE WHEN gap_us <= 0 THEN 'nonpositive' WHEN used > 0 AND gap_us > 3.5::DOUBLE * used THEN 'long' ELSE 'unmatched' END END AS split_reason FROM walk)"""


@query(f"WITH RECURSIVE {_WALK} SELECT source, row_no, gap_us, k, {q('used', 0)} AS base_gap_us, split_reason, CAST(sum(CASE WHEN split_reason IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS INTEGER) AS segment_id FROM split")
def adaptive_segments(spark, sf_dir):
    return A.adaptive_segments(packets(spark, sf_dir), ADAPTIVE).withColumns({"base_gap_us": r("base_gap_us", 0), "row_no": F.col("row_no").cast("long")})


@query(f"""WITH RECURSIVE {_WALK} SELECT count(DISTINCT source) AS sources, count(DISTINCT source) + count(split_reason) AS segments,
    {', '.join(f'count(*) FILTER (k = {k}) AS classified_k{k}' for k in range(1, 7))}, count(*) FILTER (k = 1) AS ema_updates, CAST(coalesce(sum(k - 1), 0) AS BIGINT) AS interpolated_points,
    {', '.join(f"count(*) FILTER (split_reason = '{x}') AS {x}_gap_splits" for x in ('nonpositive', 'long', 'unmatched'))}, (SELECT {q('avg(base)', 1)} FROM firsts) AS mean_initial_gap_us FROM split""")
def adaptive_counters(spark, sf_dir):
    return A.adaptive_counters(packets(spark, sf_dir), ADAPTIVE).withColumn("mean_initial_gap_us", r("mean_initial_gap_us", 1))


@query(f"""WITH RECURSIVE {_WALK},
    numbered AS (SELECT source, row_no, k, CAST(sum(CASE WHEN split_reason IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS INTEGER) AS segment_id FROM split),
    placed AS (SELECT n.*, g.amp, g.prev_amp, sum(coalesce(k, 0)) OVER (PARTITION BY n.source, segment_id ORDER BY n.row_no ROWS UNBOUNDED PRECEDING) AS step FROM numbered n JOIN gaps g ON g.source = n.source AND g.row_no = n.row_no),
    asteps AS (SELECT source, segment_id, CAST(CASE WHEN k IS NULL THEN 0 ELSE step - k + i END AS BIGINT) AS step_index,
        CASE WHEN k IS NULL OR i = k THEN amp ELSE (1 - CAST(i AS DOUBLE) / k) * prev_amp + CAST(i AS DOUBLE) / k * amp END AS amp FROM (SELECT *, unnest(range(1, coalesce(k, 1) + 1)) AS i FROM placed)),
    d AS (SELECT *, amp - lag(amp) OVER (PARTITION BY source, segment_id ORDER BY step_index) AS v FROM asteps)
    SELECT source, segment_id, step_index, {q('v')} AS amp FROM d WHERE v IS NOT NULL""")
def adaptive_first_difference(spark, sf_dir):
    rows = A.adaptive_resampled(packets(spark, sf_dir), ADAPTIVE, ["amp"])
    return T.transformed(rows, "diff", "amp").select("source", "segment_id", "step_index", r("amp").alias("amp"))


# --- selections, manifests and summaries ----------------------------------------------


@query(f"WITH {FILES} SELECT source, label FROM files QUALIFY row_number() OVER (PARTITION BY label ORDER BY first_us, source) <= 3")
def capped_per_class(spark, sf_dir):
    return E.first_per_group(files(spark, sf_dir), ["label"], ["first_us", "source"], 3).select("source", "label")


@query(f"WITH {FILES} SELECT label, person, min_by(source, (first_us, source)) AS source FROM files GROUP BY ALL")
def file_dedupe(spark, sf_dir):
    return E.deduplicated(files(spark, sf_dir), ["label", "person"], ["first_us", "source"]).select("label", "person", "source")


def _person_split(spark, sf_dir):
    return X.group_split(S.totals(files(spark, sf_dir), ["person"]), "person", "n_rows")


_PERSONS = f"WITH {FILES}{_SUBSETS.format(g='person', order='d, size, places')}, flags AS (SELECT g AS person, (mask >> i) & 1 = 1 AS is_train FROM numbered, best)"


@query(f"{_PERSONS} SELECT name, CASE WHEN is_train THEN 'train' ELSE 'validation' END AS split, label, person, row_count FROM files JOIN flags USING (person)")
def split_manifest(spark, sf_dir):
    return E.split_manifest(files(spark, sf_dir), _person_split(spark, sf_dir), ["person"])


@query(f"{_PERSONS} SELECT person FROM flags WHERE NOT is_train")
def split_complement(spark, sf_dir):
    return E.complement(files(spark, sf_dir), _person_split(spark, sf_dir).filter("is_train"), ["person"])


@query(f"{_PERSONS} SELECT label, CAST(sum(CASE WHEN is_train THEN row_count ELSE 0 END) AS BIGINT) AS train_rows, CAST(sum(CASE WHEN is_train THEN 0 ELSE row_count END) AS BIGINT) AS validation_rows FROM files JOIN flags USING (person) GROUP BY label")
def split_label_rows(spark, sf_dir):
    rows = E.assigned(files(spark, sf_dir), _person_split(spark, sf_dir), ["person"])
    held = lambda c: F.sum(F.when(c, F.col("row_count")).otherwise(0))
    return rows.groupBy("label").agg(held(F.col("is_train")).alias("train_rows"), held(~F.col("is_train")).alias("validation_rows"))


@query(f"""WITH {FILES} SELECT label, '{{"n_files":' || count(*) || ',"n_rows":' || CAST(sum(row_count) AS BIGINT) || '}}' AS summary FROM files GROUP BY label""")
def summary_json(spark, sf_dir):
    return K.summary_json(S.totals(files(spark, sf_dir), ["label"]), ["label"])


@query(f"WITH {FILES} SELECT person, CAST(coalesce(sum(row_count) FILTER (label = 'big'), 0) AS BIGINT) AS big, CAST(coalesce(sum(row_count) FILTER (label = 'small'), 0) AS BIGINT) AS small FROM files GROUP BY person")
def person_label_pivot(spark, sf_dir):
    return files(spark, sf_dir).groupBy("person").pivot("label", ["big", "small"]).agg(F.sum("row_count")).fillna(0, ["big", "small"])


@query("SELECT DISTINCT 'class_' || label AS class FROM embeddings")
def class_discovery(spark, sf_dir):
    paths = table(spark, sf_dir, "embeddings").select(F.format_string("windows/class_%d_manifest.csv", "label").alias("path"))
    return K.classes(paths)


@query("SELECT vec_id, CAST(CASE WHEN label % 3 = 2 THEN -1 ELSE label % 3 END AS INTEGER) AS label_id FROM embeddings")
def label_encode(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", N.label_id(F.concat(F.lit("c"), F.col("label") % 3), ["c0", "c1"]).alias("label_id"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS best FROM embeddings")
def first_argmax(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", V.first_argmax("embedding").alias("best"))


@query(f"SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS sc_000, CAST(embedding[2] AS DOUBLE) AS sc_001, CAST(embedding[3] AS DOUBLE) AS sc_002 FROM embeddings")
def wide_columns(spark, sf_dir):
    return K.wide(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "v", 3)


@query("SELECT vec_id, v.variant, list_transform(v.p, lambda k: CAST(embedding[2 * k + 1] AS DOUBLE)) AS im FROM embeddings, (SELECT unnest([{'variant': 'low', 'p': [0, 1, 2]}, {'variant': 'high', 'p': [10, 11]}, {'variant': 'both', 'p': [0, 1, 2, 10, 11]}]) AS v)")
def variant_fan_out(spark, sf_dir):
    specs = {"low": [0, 1, 2], "high": [10, 11], "both": [0, 1, 2, 10, 11]}
    rows = table(spark, sf_dir, "embeddings").withColumn("variant", F.explode(F.array(*map(F.lit, specs))))
    cut = None
    for name, pairs in specs.items():
        cut = (F.when if cut is None else cut.when)(F.col("variant") == name, V.imag(V.gather_pairs("embedding", pairs)).cast("array<double>"))
    return rows.select("vec_id", "variant", cut.alias("im"))


@query(f"WITH {GAPS}, v AS (SELECT gap_us / 3600000000.0::DOUBLE AS x FROM gaps WHERE gap_us / 3600000000.0::DOUBLE BETWEEN 0 AND 24), s AS (SELECT min(x) AS lo, max(x) AS hi FROM v), b AS (SELECT CAST(CASE WHEN hi > lo THEN least(floor((x - lo) / ((hi - lo) / 100)), 99) ELSE 0 END AS INTEGER) AS bin, lo, (hi - lo) / 100 AS w FROM v, s) SELECT bin, {q('any_value(lo) + bin * any_value(w)')} AS low, count(*) AS n, {q('count(*) / (sum(count(*)) OVER () * any_value(w))')} AS density FROM b GROUP BY bin")
def gap_histogram_clipped(spark, sf_dir):
    hours = G.gaps(packets(spark, sf_dir)).select((F.col("gap_us") / 3_600_000_000.0).alias("x")).filter(F.col("x").between(0, 24))
    return S.histogram(hours, "x", 100).withColumns({"low": r("low"), "density": r("density")})


@query(f"WITH {PREDICTIONS} SELECT {q('avg(CAST(truth = pred AS INTEGER))')} AS accuracy, count(*) AS n FROM predictions WHERE model = 'b'")
def accuracy(spark, sf_dir):
    return M.accuracy(_model(spark, sf_dir)).withColumn("accuracy", r("accuracy"))


@query(f"WITH {PREDICTIONS}, b AS (SELECT model, sample_id % 5 AS batch, avg(CAST(truth <> pred AS INTEGER)) AS m FROM predictions GROUP BY ALL) SELECT model, {q('avg(m)')} AS loss FROM b GROUP BY model")
def batch_mean_loss(spark, sf_dir):
    rows = predictions(spark, sf_dir).select("model", (F.col("sample_id") % 5).alias("batch"), (F.col("true") != F.col("pred")).cast("double").alias("loss"))
    return M.batch_mean_loss(rows, ["model"]).withColumn("loss", r("loss"))


@query(f"WITH {GAPS} SELECT source, {q('median(gap_us)', 1)} AS base_gap_us FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY row_no) AS j FROM gaps WHERE gap_us > 0) WHERE j <= 8 GROUP BY source")
def initial_base_gap(spark, sf_dir):
    return A.base_gaps(packets(spark, sf_dir), 8).withColumn("base_gap_us", r("base_gap_us", 1))


@query(f"WITH RECURSIVE {_WALK} SELECT split_reason, count(*) AS n FROM split WHERE split_reason IS NOT NULL GROUP BY split_reason")
def split_reasons(spark, sf_dir):
    return A.adaptive_segments(packets(spark, sf_dir), ADAPTIVE).filter("split_reason is not null").groupBy("split_reason").agg(F.count("*").alias("n"))


@query(f"WITH {_HISTORY}, b AS (SELECT run, max_by(epoch, (acc, -epoch)) AS best_epoch, max(acc) AS best_accuracy, max_by(1 - acc, epoch) AS g, max(epoch) AS last FROM h GROUP BY run) SELECT run, best_epoch, {q('best_accuracy')} AS best_accuracy, {q('g')} AS final_gap, greatest(last - best_epoch - 5, 0) AS epochs_past_patience FROM b")
def convergence(spark, sf_dir):
    h = _history(spark, sf_dir).withColumn("train_accuracy", F.lit(1.0))
    return S.convergence(h, 5).withColumns({"best_accuracy": r("best_accuracy"), "final_gap": r("final_gap")})


_SHUFFLED = "CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST({key} AS VARCHAR)), {key}) <= greatest(1, round_even(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE, 0)) THEN 'validation' ELSE 'train' END"


@query(f"WITH {FILES} SELECT source, label, {_SHUFFLED.format(key='source')} AS split FROM files")
def split_random_file(spark, sf_dir):
    return X.random_file(files(spark, sf_dir), 0.2, name="source").select("source", "label", "split")


@query(f"SELECT vec_id, label, {_SHUFFLED.format(key='vec_id')} AS split FROM embeddings")
def split_stratified_rows(spark, sf_dir):
    return X.stratified_rows(table(spark, sf_dir, "embeddings"), 0.2, key="vec_id").select("vec_id", "label", "split")


@query(f"WITH {FILES}, f AS (SELECT DISTINCT label, person FROM files), s AS (SELECT label, person, {_SHUFFLED.format(key='person')} AS split FROM f) SELECT source, label, person, split FROM files JOIN s USING (label, person)")
def split_stratified_files(spark, sf_dir):
    return X.stratified_files(files(spark, sf_dir), 0.2, name="person").select("source", "label", "person", "split")


@query(f"WITH {FILES} SELECT date, label, count(*) AS n_files, CAST(sum(row_count) AS BIGINT) AS n_rows FROM files GROUP BY ALL")
def date_totals(spark, sf_dir):
    return S.totals(files(spark, sf_dir), ["date", "label"])


@query(f"""WITH {COMPLEX_STEPS.replace("SELECT source, segment_id, step - m + i AS step_index,", "SELECT source, segment_id, step - m + i AS step_index, t0_us + (step - m + i) * 14400000000 AS grid_t_us, CASE WHEN i < m THEN 1 ELSE 0 END AS interp_mask,").replace("ROWS UNBOUNDED PRECEDING) AS BIGINT) AS step,", "ROWS UNBOUNDED PRECEDING) AS BIGINT) AS step, first_value(t_us) OVER (PARTITION BY source, segment_id ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS t0_us,")},
    sized AS (SELECT source, segment_id, count(*) AS n FROM zsteps GROUP BY ALL), cut AS (SELECT *, CAST(unnest(range(0, n - 11, 4)) AS INTEGER) AS start_index FROM sized WHERE n >= 12)
    SELECT c.source, c.segment_id, c.start_index, 8 AS window_length, 4 AS lag_steps, 8 AS wt, CAST(sum(z.interp_mask) AS INTEGER) AS window_interp_count, {q('sum(z.interp_mask) / 8.0::DOUBLE')} AS window_interp_ratio, min(z.grid_t_us) AS grid_start, max(z.grid_t_us) AS grid_end
    FROM cut c JOIN zsteps z ON z.source = c.source AND z.segment_id = c.segment_id AND z.step_index >= start_index + 4 AND z.step_index < start_index + 12 GROUP BY ALL""")
def sdp_manifest(spark, sf_dir):
    return C.profile_manifest(complex_steps(spark, sf_dir), 8, 4, 4).withColumn("window_interp_ratio", r("window_interp_ratio"))


@query(f"""WITH {STEPS}, sized AS (SELECT source, segment_id, count(*) AS n FROM steps GROUP BY ALL), cut AS (SELECT *, CAST(unnest(range(0, n - 11, 4)) AS INTEGER) AS start_index FROM sized WHERE n >= 12)
    SELECT c.source, c.segment_id, c.start_index, {', '.join(f"CAST(coalesce(string_agg(coalesce(CAST(s.{x} AS VARCHAR), ''), ',' ORDER BY s.step_index) FILTER (s.step_index >= start_index + {k}), '') AS VARCHAR) AS {name}_{x}" for name, k in (('current', 4), ('context', 0)) for x in ('interp_mask', 'grid_t_us', 'actual_t_us', 'source_row'))}
    FROM cut c JOIN steps s ON s.source = c.source AND s.segment_id = c.segment_id AND s.step_index >= start_index AND s.step_index < start_index + 12 GROUP BY ALL""")
def sdp_context(spark, sf_dir):
    rows = C.context_windows(steps(spark, sf_dir), 8, 4, 4)
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit(""))), ",").alias(c)
    return rows.select("source", "segment_id", "start_index", *(joined(c) for c in rows.columns[3:]))


@query(f"""WITH {STEPS}{_WINDOWS}, {FILES.removeprefix(P + ',')}, s AS (SELECT source, label, {_LAST} AS split FROM files),
    b AS (SELECT source, count(*) AS before, count(*) FILTER (n_steps > 1) AS after FROM sized GROUP BY source), w AS (SELECT source, count(*) AS n FROM cut WHERE window_length = 8 GROUP BY source)
    SELECT split, label, count(*) AS files_seen, count(before) AS files_with_segments, CAST(sum(coalesce(before, 0)) AS BIGINT) AS segments_before, CAST(sum(coalesce(after, 0)) AS BIGINT) AS segments_after, CAST(sum(coalesce(n, 0)) AS BIGINT) AS windows
    FROM s LEFT JOIN b USING (source) LEFT JOIN w USING (source) GROUP BY split, label""")
def build_counters(spark, sf_dir):
    made = steps(spark, sf_dir)
    return S.build_counters(made, W.window_starts(made, [8], 4), _time_split(spark, sf_dir).select("source", "split", "label"), shrunk=1)


@query(f"""WITH a AS (SELECT label % 2 = 0 AS even, unnest(range(0, 32)) AS c, embedding FROM embeddings), z AS (SELECT even, CAST(embedding[2 * c + 2] AS DOUBLE) AS re, CAST(embedding[2 * c + 1] AS DOUBLE) AS im FROM a)
    SELECT even, count(*) // 32 AS rows_used, {q('avg(sqrt(re * re + im * im))')} AS amplitude_mean, {q('stddev_pop(sqrt(re * re + im * im))')} AS amplitude_std, {q('stddev_pop(atan2(im, re))')} AS phase_std FROM z GROUP BY even""")
def amplitude_phase_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") % 2 == 0).alias("even"), V.real("embedding").alias("re"), V.imag("embedding").alias("im"))
    return S.amplitude_phase_summary(rows, ["even"], "re", "im").withColumns({c: r(c) for c in ("amplitude_mean", "amplitude_std", "phase_std")})


@query(f"""WITH {VECTORS}, gaps AS (SELECT *, t_us - lag(t_us) OVER w AS gap_us, lag(re) OVER w AS pr, lag(im) OVER w AS pi, lag(amp) OVER w AS prev_amp FROM vectors WINDOW w AS (PARTITION BY source ORDER BY row_no)),
    c AS (SELECT quantile_cont(gap_us, 0.25) AS a, quantile_cont(gap_us, 0.75) AS b, quantile_cont(gap_us, 0.99) AS z FROM gaps WHERE gap_us IS NOT NULL),
    o AS (SELECT *, list_sum(list_transform(range(1, 33), lambda k: (CAST(re[k] AS DOUBLE) - pr[k]) * (CAST(re[k] AS DOUBLE) - pr[k]) + (CAST(im[k] AS DOUBLE) - pi[k]) * (CAST(im[k] AS DOUBLE) - pi[k]))) AS d FROM gaps WHERE gap_us IS NOT NULL)
    SELECT CASE WHEN gap_us <= a THEN 'small' WHEN gap_us >= b THEN 'large' ELSE 'middle' END AS gap_group, count(*) AS n, {q('avg(abs(amp - prev_amp))')} AS mean_change, {q('sqrt(sum(d) / (32 * count(*)))', 5)} AS complex_rmse FROM o, c WHERE gap_us <= z GROUP BY 1""")
def gap_trimmed_rmse(spark, sf_dir):
    log, vectors = complex_packets(spark, sf_dir)
    found = S.trimmed_groups(G.gaps(log, ["amp", *VECTOR]), "amp", parts=("re", "im"), attach=lambda rows: G.with_vectors(rows, vectors, VECTOR, ["re", "im"]))
    return found.select("gap_group", "n", r("mean_change").alias("mean_change"), r("complex_rmse", 5).alias("complex_rmse"))


@query(f"""WITH {PREDICTIONS}, runs AS (SELECT model, sample_id % 3 AS seed, avg(CAST(truth = pred AS INTEGER)) AS accuracy FROM predictions GROUP BY ALL)
    SELECT model, seed, {q('accuracy')} AS accuracy, {q('avg(accuracy) OVER m')} AS accuracy_mean, {q('coalesce(stddev_samp(accuracy) OVER m, 0)')} AS accuracy_std FROM runs WINDOW m AS (PARTITION BY model)""")
def seed_runs(spark, sf_dir):
    runs = predictions(spark, sf_dir).groupBy("model", (F.col("sample_id") % 3).alias("seed")).agg(F.avg((F.col("true") == F.col("pred")).cast("int")).alias("accuracy"))
    return M.seed_runs(runs, ["model"], ["accuracy"]).withColumns({c: r(c) for c in ("accuracy", "accuracy_mean", "accuracy_std")})


@query(f"""WITH {STEPS} SELECT CAST(source AS VARCHAR) AS source_csv, segment_id, step_index, grid_t_us - min(grid_t_us) OVER (PARTITION BY source, segment_id) AS relative_time_us, grid_t_us AS grid_timestamp,
    coalesce(CAST(actual_t_us AS VARCHAR), '') AS actual_timestamp, coalesce(CAST(source_row AS VARCHAR), '') AS source_row_number, interp_mask, {q('amp')} AS sc_000, {q('2 * amp')} AS sc_001 FROM steps""")
def resampled_csv(spark, sf_dir):
    rows = steps(spark, sf_dir).withColumns({"source": F.col("source").cast("string"), "v": F.array(r("amp"), r(2 * F.col("amp")))})
    return K.resampled_csv(rows, "v", 2)


@query()
def mlp_inference(spark, sf_dir):
    """A small network fitted on at most 2,000 vectors (by hash order), applied to all."""
    import numpy as np

    from ..operators import models as L

    rows = table(spark, sf_dir, "embeddings").filter("embedding is not null and label is not null")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(2000).collect()
    x, y = np.array([s["embedding"] for s in sample], float), np.array([s["label"] for s in sample])
    means, stds = x.mean(0), np.maximum(x.std(0), 1e-6)
    model = L.Mlp([x.shape[1], 32, int(y.max()) + 1], 1)
    held = max(1, len(x) // 5)
    z = (x - means) / stds
    L.train(model, z[held:], y[held:], (z[:held], y[:held]), L.Adam(0.01), epochs=8)
    return L.predicted(rows, model, "embedding", (x.shape[1],), means, stds).select("vec_id", "label", "pred", "probability")
