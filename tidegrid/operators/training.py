"""Training as Spark jobs.

``fit``: gradients, losses and hits are sums over the rows, so each task folds its batches
and sends one row of sums; these meet in two levels. Weights go out with the job and
their gradient comes back: the size of the network, whatever the table's. ``fit_grid``:
many small runs, each configuration and seed a task over one bounded sample.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import pack_weights, unpack_weights
from .models import Adam, Cnn, Mlp, Params, Sgd, cross_entropy, sharpness_aware, train

SUMS = "sums binary"


def _added(blobs: list[bytes]) -> bytes:
    total: Params = {}
    for blob in blobs:
        for k, v in unpack_weights(bytes(blob)).items():
            total[k] = total.get(k, 0) + v
    return pack_weights(total)


def sums(rows: DataFrame, model: Mlp | Cnn, vector: str, label: str, shape: tuple[int, ...], weights: np.ndarray | None = None, gradient: bool = True, batch: int = 512, salts: int = 64) -> dict[str, np.ndarray] | None:
    """Over all rows: ``loss`` and ``weight`` sums, ``hits``, ``n``, and with ``gradient`` the loss's gradient by parameter (``g.`` names); None without rows.

    ``vector`` is a flat array of ``shape``, ``label`` a class number; rows without either
    don't count. ``weights`` are the classes'.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Params = {}
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                some = pdf.iloc[at : at + batch]
                x, y = np.stack(some["x"].to_numpy()).astype(float), some["y"].to_numpy()
                logits, kept = model.forward(x.reshape(len(x), *shape))
                loss, grad = cross_entropy(logits, y, weights)
                mass = float(len(y) if weights is None else weights[y].sum())
                part: Params = {"loss": np.float64(loss * mass), "weight": np.float64(mass), "hits": np.float64((logits.argmax(1) == y).sum()), "n": np.float64(len(y))}
                if gradient:
                    part |= {f"g.{k}": v * mass for k, v in model.backward(grad, kept).items()}
                for k, v in part.items():
                    total[k] = total.get(k, 0) + v
        if total:
            yield pd.DataFrame({"sums": [pack_weights(total)]})

    ready = rows.filter(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"))
    parts = ready.mapInPandas(fold, SUMS).withColumn("salt", F.spark_partition_id() % salts)
    merged = parts.groupBy("salt").applyInPandas(lambda g: pd.DataFrame({"sums": [_added(list(g["sums"]))]}), SUMS)
    found = [r.sums for r in merged.collect()]  # at most ``salts`` rows of the network's size
    return unpack_weights(_added(found)) if found else None


def fit(rows: DataFrame, validation: DataFrame, model: Mlp | Cnn, vector: str, label: str, shape: tuple[int, ...], optimiser: Adam | Sgd, epochs: int = 10, parts: int = 1, key: Column | None = None, weights: np.ndarray | None = None, rho: float | None = None, adaptive: bool = False) -> list[dict]:
    """History of epochs, each ``parts`` steps over the rows whose hash of ``key`` falls in a part; the model keeps its best weights by validation accuracy, the first on ties.

    ``rows`` are read once a step, twice with ``rho`` (sharpness-aware): pass a stored table.
    """
    history, best = [], (-1.0, {})
    place = F.pmod(F.xxhash64(key if key is not None else F.col(vector)), F.lit(parts))
    for epoch in range(1, epochs + 1):
        seen: list[dict] = []
        for part in range(parts):
            some, first = rows.filter(place == part) if parts > 1 else rows, []

            def gradient(some=some, first=first) -> Params:
                found = sums(some, model, vector, label, shape, weights)
                if found is None:
                    return {}
                first.append(found)
                return {k[2:]: v / found["weight"] for k, v in found.items() if k.startswith("g.")}

            grads = gradient() if rho is None else sharpness_aware(model.params, gradient, rho, adaptive)
            if grads:
                optimiser.step(model.params, grads)
                seen.append(first[0])
        held = sums(validation, model, vector, label, shape, gradient=False)
        total = lambda c: float(sum(s[c] for s in seen))
        ratio = lambda a, b: a / b if b else float("nan")
        history.append({"epoch": epoch, "train_loss": ratio(total("loss"), total("weight")), "train_accuracy": ratio(total("hits"), total("n")), "validation_loss": ratio(float(held["loss"]), float(held["weight"])) if held else float("nan"), "validation_accuracy": ratio(float(held["hits"]), float(held["n"])) if held else float("nan")})
        if history[-1]["validation_accuracy"] > best[0]:
            best = (history[-1]["validation_accuracy"], {k: v.copy() for k, v in model.params.items()})
    model.params = best[1] or model.params
    return history


GRID = "config string, seed int, epoch int, train_loss double, train_accuracy double, validation_loss double, validation_accuracy double"


def fit_grid(rows: DataFrame, configs: list[dict], seeds: list[int], vector: str, label: str, key: str, max_rows: int = 2000, share: float = 0.2) -> DataFrame:
    """Histories of an MLP for every configuration and seed, each trained by a task of its own.

    A configuration has ``hidden`` (sizes), ``optimiser`` (adam or sgd), ``rate``, ``epochs``,
    and maybe ``decay``, ``batch`` and ``rho``. All see the same ``max_rows`` rows at most, those
    of the smallest hashes of ``key``; the first ``share`` of them is validation.
    """
    spark = rows.sparkSession
    ready = rows.filter(F.col(vector).isNotNull() & F.col(label).isNotNull())
    sample = ready.orderBy(F.xxhash64(key), key).select(F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y")).limit(max_rows).collect()
    if len(sample) < 2:
        return spark.createDataFrame([], GRID)
    x, y = np.array([s.x for s in sample]), np.array([s.y for s in sample])
    held = max(1, int(len(x) * share))
    means, stds = x[held:].mean(0), np.maximum(x[held:].std(0), 1e-6)
    z, classes = (x - means) / stds, int(y.max()) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text, seed in zip(pdf["config"], pdf["seed"], strict=True):
                c = json.loads(text)
                model = Mlp([z.shape[1], *c["hidden"], classes], int(seed))
                step = {"adam": Adam, "sgd": Sgd}[c["optimiser"]](c["rate"], decay=c.get("decay", 0.0))
                history = train(model, z[held:], y[held:], (z[:held], y[:held]), step, c["epochs"], c.get("batch", 64), rho=c.get("rho"), seed=int(seed))
                yield pd.DataFrame(history).assign(config=text, seed=int(seed))

    jobs = [(json.dumps(c, sort_keys=True), s) for c in configs for s in seeds]
    return spark.createDataFrame(jobs, "config string, seed int").repartition(len(jobs), "config", "seed").mapInPandas(run, GRID)
