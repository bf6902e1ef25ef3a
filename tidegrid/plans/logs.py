"""Registered queries over logs and tables that are written from the test tables and read back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import vectors as V
from ..operators import features as T
from ..operators import metrics as M
from ..operators import models as L
from ..operators import splits as X
from ..operators import training
from ..operators import windows as W
from ..operators.ranges import ranked
from ..sources import packets as P
from ..sources import scratch
from ..sources import tables as K
from . import catalogue
from .catalogue import _WINDOWS, COMPLEX_STEPS, FILES, PREDICTIONS, STEPS, complex_steps, q, query, qv, r, rv, steps
from .catalogue import P as PACKETS
from .views import files, packets, predictions, table

# --- a log of events: bad times and lengths, short vectors, quoted line breaks ----------

LOG_COLUMNS = ["local_timestamp", "len", "data", "note"]
_LOG = PACKETS + """,
log AS (SELECT event_id % 3 AS label, event_id, t_us, CASE WHEN event_id % 13 = 0 THEN 'bad' ELSE CAST(t_us AS VARCHAR) END AS local_timestamp, CASE WHEN event_id % 17 = 0 THEN ' 4' ELSE '4' END AS len,
    CASE WHEN event_id % 11 = 0 THEN [event_id % 7] ELSE [event_id % 7, -(event_id % 5), event_id % 11, 1] END AS ints FROM packets),
lines AS (SELECT l.*, '[' || CASE WHEN l.event_id % 4 = 0 THEN replace(array_to_string(ints, ', '), ', ', ',' || chr(10)) ELSE array_to_string(ints, ', ') END || ']' AS data, e.event_type || ', "' || e.props || '"' AS note,
    row_number() OVER (PARTITION BY label ORDER BY l.event_id) + 1 AS row_no FROM log l JOIN events e USING (event_id)),
fine AS (SELECT * FROM lines WHERE len = '4' AND len(ints) = 4 AND local_timestamp <> 'bad')"""


def _write_log(rows: DataFrame, spark: SparkSession, order: str) -> str:
    """One CSV file a label, in order."""
    path = scratch.place(spark, "log")
    writer = rows.repartition("label").sortWithinPartitions("label", order).drop(order).write.partitionBy("label")
    writer.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def _event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    ints = F.when(e % 11 == 0, F.array(e % 7)).otherwise(F.array(e % 7, -(e % 5), e % 11, F.lit(1).cast("long")))
    text = F.concat(F.lit("["), F.when(e % 4 == 0, F.array_join(ints.cast("array<string>"), ",\n")).otherwise(F.array_join(ints.cast("array<string>"), ", ")), F.lit("]"))
    more = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit(', "'), "props", F.lit('"')).alias("note"))
    rows = packets(spark, sf_dir).join(more, "event_id").select((e % 3).alias("label"), "event_id", F.when(e % 13 == 0, "bad").otherwise(F.col("t_us").cast("string")).alias("local_timestamp"), F.when(e % 17 == 0, " 4").otherwise("4").alias("len"), text.alias("data"), "note")
    found = P.numbered_csv(spark, _write_log(rows, spark, "event_id"), LOG_COLUMNS)
    return P.labelled(found)


def _label(c: str = "label") -> Column:
    return F.regexp_extract(c, "label=([0-9]+)", 1).cast("long").alias("label")


@query(f"WITH {_LOG} SELECT label, row_no AS source_row_number, local_timestamp, len, data, note FROM lines")
def csv_rows(spark, sf_dir):
    return _event_log(spark, sf_dir).select(_label(), "source_row_number", *LOG_COLUMNS)


@query(f"WITH {_LOG} SELECT label, row_no, t_us, list_transform(ints, lambda x: CAST(x AS INTEGER)) AS data FROM fine")
def csv_packets(spark, sf_dir):
    return P.packets(_event_log(spark, sf_dir), 4).select(_label("source"), "row_no", "t_us", "data")


@query(f"WITH {_LOG} SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(sum(t_us) AS HUGEINT) % 1000000007 AS t FROM fine GROUP BY label".replace("CAST(sum(t_us) AS HUGEINT) % 1000000007", "CAST(sum(t_us % 1000003) AS BIGINT)"))
def csv_packets_strict(spark, sf_dir):
    rows = _event_log(spark, sf_dir).filter(F.col("local_timestamp") != "bad")
    return P.packets(rows, 4, strict_time=True).groupBy(_label("source")).agg(F.count("*").alias("n"), F.sum(F.col("t_us") % 1000003).alias("t"))


@query(f"WITH {_LOG} SELECT label, row_no, {qv('[ints[2], ints[4]]')} AS re, {qv('[ints[1], ints[3]]')} AS im FROM fine")
def csv_complex(spark, sf_dir):
    return P.complex_packets(P.packets(_event_log(spark, sf_dir), 4)).select(_label("source"), "row_no", F.col("re").cast("array<double>").alias("re"), F.col("im").cast("array<double>").alias("im"))


@query(f"WITH {_LOG} SELECT label, count(*) AS row_count FROM lines GROUP BY label")
def csv_row_counts(spark, sf_dir):
    return P.row_counts(_event_log(spark, sf_dir)).select(_label("source_csv"), "row_count")


@query(f"WITH {_LOG} SELECT 'label=' || CAST(label AS VARCHAR) AS class, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS place FROM (SELECT DISTINCT label FROM lines)")
def csv_classes(spark, sf_dir):
    """Folders as classes, in sorted order."""
    rows = _event_log(spark, sf_dir).select(F.col("label").alias("class")).distinct()
    return ranked(rows, [], [F.col("class")]).select("class", (F.col("_rank") - 1).cast("int").alias("place"))


@query(f"WITH {_LOG} SELECT label, row_no, t_us FROM fine QUALIFY row_number() OVER (PARTITION BY label ORDER BY row_no) <= 3")
def csv_first_valid(spark, sf_dir):
    rows = P.packets(_event_log(spark, sf_dir), 4).select(_label("source"), "row_no", "t_us")
    return P.first_valid(rows, ["label"], ["row_no"], 3)


# --- raw buffers of a source: the gathered carriers of both fields ----------------------

_RAW = FILES + ", raw AS (SELECT source, source % 2 AS label, first_us, {n} AS n, list_transform(range(0, {n}), lambda k: CAST((source * 31 + k * 17) % 61 AS INTEGER) - 30) AS d FROM files)"


def _raw_log(spark: SparkSession, sf_dir: str, n: Column) -> DataFrame:
    ints = F.transform(F.sequence(F.lit(0), n - 1), lambda k: ((F.col("source") * 31 + k * 17) % 61).cast("int") - 30)
    rows = files(spark, sf_dir).select((F.col("source") % 2).alias("label"), "source", F.col("first_us").cast("string").alias("local_timestamp"), n.cast("string").alias("len"), V.list_text(ints).alias("data"), F.col("source").cast("string").alias("note"))
    return P.numbered_csv(spark, _write_log(rows, spark, "source"), LOG_COLUMNS)


_AMPS = "list_transform(range(0, n // 2), lambda c: sqrt(CAST(d[2 * c + 1] AS DOUBLE) * d[2 * c + 1] + CAST(d[2 * c + 2] AS DOUBLE) * d[2 * c + 2]))"
_RATIOS = f"list_filter(list_transform(list_zip({V.OVERLAP_LLTF}, {V.OVERLAP_HTLTF}), lambda z: CASE WHEN a[z[1] + 1] > 1e-8 THEN a[z[2] + 53] / a[z[1] + 1] END), lambda x: x IS NOT NULL)"


@query(f"WITH {_RAW.format(n=332)}, amps AS (SELECT source, {_AMPS} AS a FROM raw), s AS (SELECT source, a, list_aggregate({_RATIOS}, 'median') AS k FROM amps) SELECT source, {qv('list_transform(range(53, 167), lambda c: a[c] / k)', 5)} AS amp FROM s WHERE k > 1e-8")
def csv_normalised(spark, sf_dir):
    rows = _raw_log(spark, sf_dir, F.lit(332))
    found = P.load(rows, "normalised").join(rows.select(F.col("source_csv").alias("source"), F.col("source_row_number").alias("row_no"), "note"), ["source", "row_no"])
    return found.select(F.col("note").cast("long").alias("source"), rv("amp", 5).alias("amp"))


@query(f"WITH {_RAW.format(n=228)} SELECT label, row_number() OVER (PARTITION BY label ORDER BY source) + 1 AS row_no, first_us AS t_us, {qv(_AMPS, 5)} AS amp FROM raw")
def csv_amplitude(spark, sf_dir):
    return P.load(_raw_log(spark, sf_dir, F.lit(228)), "amplitude").select(_label("source"), "row_no", "t_us", rv("amp", 5).alias("amp"))


_SOME = "CASE WHEN source % 5 = 0 THEN 383 ELSE 384 END"
_SPECS = ", ".join(f"('{name}', {[s for p in pairs for s in (2 * p + 1, 2 * p + 2)]})" for name, pairs in V.VARIANTS.items())


def _full_log(spark, sf_dir):
    return _raw_log(spark, sf_dir, F.when(F.col("source") % 5 == 0, 383).otherwise(384))


@query(f"WITH {_RAW.format(n=_SOME)}, v(variant, slots) AS (VALUES {_SPECS}) SELECT variant, count(*) AS rows_seen, count(*) FILTER (n <> 384) AS rows_invalid_length, count(*) FILTER (n = 384) AS rows_written FROM raw, v GROUP BY variant")
def variant_counters(spark, sf_dir):
    return P.variant_counters(P.fan_out(_full_log(spark, sf_dir)))


@query(f"WITH {_RAW.format(n=_SOME)}, v(variant, slots) AS (VALUES {_SPECS}) SELECT label, row_number() OVER (PARTITION BY label ORDER BY source) + 1 AS source_row_number, CASE WHEN n = 384 THEN CAST(len(slots) AS VARCHAR) ELSE '0' END AS len, CASE WHEN n = 384 THEN '[' || array_to_string(list_transform(slots, lambda i: d[i]), ',') || ']' ELSE '[]' END AS data FROM raw, v WHERE variant = 'htltf_only'")
def second_field_rows(spark, sf_dir):
    return P.only_second_field(_full_log(spark, sf_dir)).select(_label("source_csv"), "source_row_number", "len", "data")


_ROWS = "v AS (SELECT vec_id, vec_id % 4 = 0 AS held, CASE WHEN vec_id % 10 = 3 THEN embedding[:63] ELSE embedding END AS data FROM embeddings), f AS (SELECT held, arg_min(len(data), vec_id) AS w FROM v GROUP BY held)"


@query(f"WITH {_ROWS} SELECT held, w AS width, vec_id FROM v JOIN f USING (held) WHERE len(data) = w".replace("w AS width", "CAST(w AS INTEGER) AS width"))
def row_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 10 == 3, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("data"))
    held = F.col("vec_id") % 4 == 0
    train, validation, width, _ = P.row_vectors(rows.filter(~held), rows.filter(held), ["vec_id"])
    return train.union(validation).select(held.alias("held"), F.lit(width).alias("width"), "vec_id")


# --- window tables ----------------------------------------------------------------------

FILES_TABLE = """SELECT user_id AS source, CASE WHEN user_id % 2 = 0 THEN 'big' ELSE 'small' END AS label, epoch_us(min(ts)) AS first_us FROM events GROUP BY user_id"""
_CELLS = f"""WITH {STEPS}{_WINDOWS}, cells AS (SELECT c.source, c.segment_id, c.start_index, s.* EXCLUDE (source, segment_id) FROM cut c JOIN steps s ON s.source = c.source AND s.segment_id = c.segment_id AND s.step_index >= c.start_index AND s.step_index < c.start_index + 8 WHERE c.window_length = 8)"""


def _windows(spark, sf_dir):
    return W.step_windows(steps(spark, sf_dir), ["amp", "interp_mask", "delta_t_ms", "grid_t_us"], [8], 4)


@query(f"""{_CELLS}, w AS (SELECT source, segment_id, start_index, sum(amp) AS a, CAST(sum(interp_mask) AS BIGINT) AS m, sum(delta_t_ms) AS d FROM cells GROUP BY ALL)
    SELECT variant, source, segment_id, start_index, {q('a', 4)} AS amp, CASE WHEN variant <> 'interp_only' THEN m END AS mask, CASE WHEN variant = 'interp_mask_deltat' THEN {q('d', 3)} END AS delta FROM w, (VALUES ('interp_only'), ('interp_mask'), ('interp_mask_deltat')) v(variant)""")
def window_variants(spark, sf_dir):
    """One stored table of windows, read as its three variants."""
    path = scratch.place(spark, "windows")
    K.write_windows(_windows(spark, sf_dir), path)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    out = None
    for name, cut in K.variants(K.read_windows(spark, path)).items():
        mask = total(F.col("interp_mask")).cast("long") if "interp_mask" in cut.columns else F.lit(None).cast("long")
        delta = r(total(F.col("delta_t_ms")), 3) if "delta_t_ms" in cut.columns else F.lit(None).cast("double")
        part = cut.select(F.lit(name).alias("variant"), "source", "segment_id", "start_index", r(total(F.col("amp")), 4).alias("amp"), mask.alias("mask"), delta.alias("delta"))
        out = part if out is None else out.unionByName(part)
    return out


@query(catalogue._SQL["ma_residual"])
def stored_ma_residual(spark, sf_dir):
    """Steps in a bucketed table, features of what is read from it."""
    kept = steps(spark, sf_dir).select("source", "segment_id", "step_index", "amp")
    place = scratch.place(spark, "steps")
    table_ = K.write_steps(kept, "steps_" + place.rpartition("-")[2], place, 8)
    return T.transformed(table_, "ma", "amp", 5).select("source", "segment_id", "step_index", r("amp").alias("amp"))


@query(f"{_CELLS}, w AS (SELECT DISTINCT source, segment_id, start_index FROM cells), f AS (SELECT source, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY first_us DESC, source DESC) <= greatest(1, round_even(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE, 0)) THEN 'validation' ELSE 'train' END AS split FROM ({FILES_TABLE})) SELECT split, label, count(*) AS n FROM w JOIN f USING (source) GROUP BY ALL")
def counted_windows(spark, sf_dir):
    """Windows written by split and class, counted as they are written."""
    split = X.time_file(files(spark, sf_dir), 0.2, time="first_us", name="source").select("source", "label", "split")
    cut = W.window_starts(steps(spark, sf_dir), [8], 4).join(split, "source")
    cells = [(s, c) for s in ("train", "validation") for c in ("big", "small")]
    return K.counted_write(cut, scratch.place(spark, "windows"), ["split", "label"], cells, "split", "label").filter("n > 0")


@query(f"""{_CELLS}, w AS (SELECT DISTINCT source, segment_id, start_index, CASE WHEN source % 2 = 0 THEN 'big' ELSE 'small' END AS label FROM cells),
    k AS (SELECT label, CAST(source AS VARCHAR) || '_seg' || CASE WHEN segment_id < 10 THEN '0' ELSE '' END || CAST(segment_id AS VARCHAR) || '_start' || lpad(CAST(start_index AS VARCHAR), 4, '0') AS window_path FROM w)
    SELECT label, window_path, row_number() OVER (PARTITION BY label ORDER BY window_path) - 1 AS position FROM k""")
def class_tree(spark, sf_dir):
    """Windows stored by class, the classes' parts together in sorted order."""
    path = scratch.place(spark, "classes")
    label = F.when(F.col("source") % 2 == 0, "big").otherwise("small")
    K.write_windows(_windows(spark, sf_dir).withColumns({"label": label, "window_path": N.window_key("source", "segment_id", "start_index")}), path, "label")
    return K.class_windows(spark, path, ["big", "small"]).select("label", "window_path", "position")


@query(f"""WITH {COMPLEX_STEPS.replace("SELECT source, segment_id, step - m + i AS step_index,", "SELECT source, segment_id, step - m + i AS step_index, CASE WHEN i < m THEN 1 ELSE 0 END AS interp_mask,")}, sized AS (SELECT source, segment_id, count(*) AS n FROM zsteps GROUP BY ALL), cut AS (SELECT *, unnest(range(0, n - 7, 4)) AS start_index FROM sized WHERE n >= 8),
    cells AS (SELECT c.source, c.segment_id, c.start_index, s.step_index, s.re, s.interp_mask FROM cut c JOIN zsteps s ON s.source = c.source AND s.segment_id = c.segment_id AND s.step_index >= c.start_index AND s.step_index < c.start_index + 8),
    flat AS (SELECT source, segment_id, start_index, step_index, unnest(range(1, 34)) AS k, unnest(list_append(list_transform(re, lambda x: CAST(x AS DOUBLE)), CAST(interp_mask AS DOUBLE))) AS x FROM cells)
    SELECT source, segment_id, CAST(start_index AS INTEGER) AS start_index, list({q('x', 4)} ORDER BY k, step_index) AS channels FROM flat GROUP BY ALL""")
def window_channels(spark, sf_dir):
    """Channel-first windows: 32 carriers over time, then the mask, in a row."""
    cut = W.step_windows(complex_steps(spark, sf_dir), ["re", "interp_mask"], [8], 4)
    return K.channel_first(cut, "re", "interp_mask").select("source", "segment_id", "start_index", rv(F.flatten("channels"), 4).alias("channels"))


@query(f"WITH {FILES}, m AS (SELECT unnest(['lltf_only', 'htltf_only']) AS variant, date, name, source FROM files) SELECT variant, date, name, CAST(source AS VARCHAR) AS source, row_number() OVER (ORDER BY variant, date, name, source) AS position FROM m")
def manifest_listing(spark, sf_dir):
    """A manifest by variant, date and name: written in order, read back, each row with its place."""
    rows = files(spark, sf_dir).select(F.explode(F.array(F.lit("lltf_only"), F.lit("htltf_only"))).alias("variant"), "date", "name", "source")
    path = scratch.place(spark, "manifest")
    K.write_manifest(rows, path, "variant", "date", "name", "source")
    listed = K.read_manifest(spark, path).withColumn("_source", F.col("source").cast("long"))
    return ranked(listed, [], [F.col(c) for c in ("variant", "date", "name", "_source")], "position").select("variant", "date", "name", "source", "position")


_FEATURES = {"raw": 0, "diff": 1, "ma": 5, "std": 5}


@query(f"WITH {STEPS}, n AS (SELECT source, segment_id, count(*) AS n FROM steps GROUP BY ALL) " + " UNION ALL ".join(f"SELECT '{N.variant_name(f, 5)}' AS variant, CAST(sum(greatest(n - {k}, 0)) AS BIGINT) AS n_rows FROM n" for f, k in _FEATURES.items()))
def feature_variants(spark, sf_dir):
    """Rows of each named feature variant."""
    made = scratch.stored(steps(spark, sf_dir).select("source", "segment_id", "step_index", "amp"), "steps")
    out = None
    for feature in _FEATURES:
        part = T.transformed(made, feature, "amp", 5).agg(F.lit(N.variant_name(feature, 5)).alias("variant"), F.count("*").alias("n_rows"))
        out = part if out is None else out.union(part)
    return out


# --- losses and stored runs -------------------------------------------------------------


@query(f"WITH {PREDICTIONS}, b AS (SELECT model, sample_id % 7 AS batch, avg(abs(truth - pred)) AS m, count(*) AS n FROM predictions GROUP BY ALL) SELECT model, {q('sum(m * n) / sum(n)')} AS loss, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY model")
def weighted_loss(spark, sf_dir):
    rows = predictions(spark, sf_dir).select("model", (F.col("sample_id") % 7).alias("batch"), F.abs(F.col("true") - F.col("pred")).cast("double").alias("loss"))
    return M.weighted_loss(rows, ["model"]).withColumn("loss", r("loss"))


_HIDDEN = "list_transform(range(0, 5), lambda j: greatest((j - 2) / 4.0::DOUBLE + list_sum(list_transform(range(0, 64), lambda i: CAST(embedding[i + 1] AS DOUBLE) * (((i * 7 + j * 3) % 11 - 5) / 10.0::DOUBLE))), 0))"


@query(f"SELECT vec_id, {qv(_HIDDEN, 5)} AS features FROM embeddings")
def stored_run_features(spark, sf_dir):
    """The last layer's inputs of a network that was written as a run, read and rebuilt, for every vector."""
    model = L.Mlp([64, 5, 3], 1)
    i, j = np.arange(64)[:, None], np.arange(5)[None]
    model.params |= {"w0": ((i * 7 + j * 3) % 11 - 5) / 10.0, "b0": (np.arange(5) - 2) / 4.0}
    path = scratch.place(spark, "run")
    K.write_run(spark, path, model.params, np.zeros(64), np.ones(64), {"epochs": 0})
    params, _, _, _, kernels = K.read_run(spark, path)
    rows = L.penultimate(table(spark, sf_dir, "embeddings"), L.rebuilt(params, kernels), "embedding", (64,))
    return rows.select("vec_id", rv("features", 5).alias("features"))


_CELL = "SELECT vec_id, label, unnest(range(0, 65)) AS f, unnest(list_append(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), 1.0::DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL"


def _softmax_sql(epochs: int = 3, rate: float = 0.5) -> str:
    """Full-batch gradient descent of a softmax regression from zero weights, an epoch a step."""
    steps_ = ["n AS (SELECT max(label) + 1 AS c, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)", f"x AS MATERIALIZED ({_CELL})",
        "w0 AS MATERIALIZED (SELECT f, c, 0.0::DOUBLE AS w FROM (SELECT unnest(range(0, 65)) AS f), (SELECT unnest(range(0, (SELECT c FROM n))) AS c))"]
    for e in range(epochs):
        steps_ += [f"z{e} AS MATERIALIZED (SELECT vec_id, label, c, sum(x * w) AS z FROM x JOIN w{e} USING (f) GROUP BY ALL)",
            f"g{e} AS MATERIALIZED (SELECT vec_id, c, exp(z - max(z) OVER v) / sum(exp(z)) OVER v * exp(max(z) OVER v) - CASE WHEN label = c THEN 1 ELSE 0 END AS g FROM z{e} WINDOW v AS (PARTITION BY vec_id))",
            f"w{e + 1} AS MATERIALIZED (SELECT f, c, any_value(w) - {rate} * sum(x * g) / (SELECT n FROM n) AS w FROM x JOIN g{e} USING (vec_id) JOIN w{e} USING (f, c) GROUP BY f, c)"]
    return f"WITH {', '.join(steps_)} SELECT CAST(f AS INTEGER) AS feature, CAST(c AS INTEGER) AS class, {q('w')} AS weight FROM w{epochs}"


@query(_softmax_sql())
def softmax_training(spark, sf_dir):
    """Weights of a network without hidden layers after three epochs of distributed gradient steps; feature 64 is the bias."""
    rows = scratch.stored(table(spark, sf_dir, "embeddings").filter("embedding is not null and label is not null").select("embedding", "label"), "rows")
    classes = rows.agg(F.max("label")).first()[0] + 1
    model = L.Mlp([64, classes], 1)
    model.params = {k: np.zeros_like(v) for k, v in model.params.items()}
    step = L.Sgd(0.5, momentum=0.0)
    for _ in range(3):
        found = training.sums(rows, model, "embedding", "label", (64,))
        step.step(model.params, {k[2:]: v / found["weight"] for k, v in found.items() if k.startswith("g.")})
    weights = np.vstack([model.params["w0"], model.params["b0"]])
    return spark.createDataFrame([(f, c, float(w)) for (f, c), w in np.ndenumerate(weights)], "feature int, class int, weight double").withColumn("weight", r("weight"))


@query()
def training_history(spark, sf_dir):
    """An MLP fitted over all rows by distributed gradients; a fifth of them, by hash, is validation."""
    rows = scratch.stored(table(spark, sf_dir, "embeddings").filter("embedding is not null and label is not null").select("vec_id", "embedding", "label"), "rows")
    held = F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0
    model = L.Mlp([64, 16, rows.agg(F.max("label")).first()[0] + 1], 1)
    history = training.fit(rows.filter(~held), rows.filter(held), model, "embedding", "label", (64,), L.Adam(0.02), epochs=3, parts=2, key=F.col("vec_id"))
    return spark.createDataFrame([tuple(h.values()) for h in history], "epoch int, train_loss double, train_accuracy double, validation_loss double, validation_accuracy double")


@query()
def grid_history(spark, sf_dir):
    """Two configurations with two seeds each, a task a run."""
    rows = table(spark, sf_dir, "embeddings")
    configs = [{"hidden": [16], "optimiser": "adam", "rate": 0.01, "epochs": 3}, {"hidden": [16], "optimiser": "sgd", "rate": 0.05, "epochs": 3, "rho": 0.05}]
    return training.fit_grid(rows, configs, [1, 2], "embedding", "label", "vec_id")
