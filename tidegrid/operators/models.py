"""Small models: training in numpy on bounded samples, inference by Arrow batches.

An MLP and one- and two-dimensional CNNs with softmax outputs, Adam, momentum SGD and
sharpness-aware minimisation. Weights are plain arrays; inference ships them to the
executors once and scores any number of rows there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Params = dict[str, np.ndarray]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def cross_entropy(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Weighted mean loss and its gradient by logits."""
    p, rows = softmax(logits), np.arange(len(labels))
    w = np.ones(len(labels)) if weights is None else weights[labels]
    loss = -(w * np.log(np.maximum(p[rows, labels], 1e-12))).sum() / w.sum()
    p[rows, labels] -= 1
    return float(loss), p * (w / w.sum())[:, None]


class Mlp:
    """Dense layers with ReLU between them."""

    def __init__(self, sizes: list[int], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.depth = len(sizes) - 1
        self.params: Params = {}
        for i, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
            self.params |= {f"w{i}": rng.normal(0, np.sqrt(2 / a), (a, b)), f"b{i}": np.zeros(b)}

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Logits, and each layer's input; the last of them are the penultimate features."""
        inputs = [x.reshape(len(x), -1)]
        for i in range(self.depth):
            y = inputs[-1] @ self.params[f"w{i}"] + self.params[f"b{i}"]
            if i < self.depth - 1:
                inputs.append(np.maximum(y, 0))
        return y, inputs

    def backward(self, grad: np.ndarray, inputs: list[np.ndarray]) -> Params:
        out: Params = {}
        for i in reversed(range(self.depth)):
            out |= {f"w{i}": inputs[i].T @ grad, f"b{i}": grad.sum(0)}
            grad = (grad @ self.params[f"w{i}"].T) * (inputs[i] > 0)
        return out


def _unfold(x: np.ndarray, kernel: tuple[int, ...]) -> np.ndarray:
    """Patches around each position, zero padded: (n, positions..., channels * kernel)."""
    pads = [(0, 0), (0, 0), *((k // 2, k - 1 - k // 2) for k in kernel)]
    view = np.lib.stride_tricks.sliding_window_view(np.pad(x, pads), kernel, axis=tuple(range(2, 2 + len(kernel))))
    order = (0, *range(2, 2 + len(kernel)), 1, *range(2 + len(kernel), 2 + 2 * len(kernel)))
    return view.transpose(order).reshape(x.shape[0], *x.shape[2:], -1)


def _fold(patches: np.ndarray, channels: int, kernel: tuple[int, ...]) -> np.ndarray:
    """Sum of patch gradients at their positions."""
    n, shape = patches.shape[0], patches.shape[1 : 1 + len(kernel)]
    parts = patches.reshape(n, *shape, channels, *kernel)
    out = np.zeros((n, channels, *(s + k - 1 for s, k in zip(shape, kernel, strict=True))))
    for at in np.ndindex(*kernel):
        piece = np.moveaxis(parts[(slice(None), *(slice(None) for _ in shape), slice(None), *at)], -1, 1)
        out[(slice(None), slice(None), *(slice(a, a + s) for a, s in zip(at, shape, strict=True)))] += piece
    return out[(slice(None), slice(None), *(slice(k // 2, k // 2 + s) for k, s in zip(kernel, shape, strict=True)))]


class Cnn:
    """Two convolutions with ReLU, the mean over positions, a dense layer; kernels of one or two dimensions."""

    def __init__(self, channels: int, hidden: tuple[int, int], classes: int, kernels: tuple[tuple[int, ...], tuple[int, ...]], seed: int = 0):
        rng = np.random.default_rng(seed)
        sizes = [channels, *hidden]
        self.kernels, self.sizes, self.params = kernels, sizes, {}
        for i, k in enumerate(kernels):
            fan = sizes[i] * int(np.prod(k))
            self.params |= {f"k{i}": rng.normal(0, np.sqrt(2 / fan), (fan, sizes[i + 1])), f"c{i}": np.zeros(sizes[i + 1])}
        self.params |= {"w": rng.normal(0, np.sqrt(1 / hidden[1]), (hidden[1], classes)), "b": np.zeros(classes)}

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        kept = []
        for i, k in enumerate(self.kernels):
            patches = _unfold(x, k)
            x = np.moveaxis(np.maximum(patches @ self.params[f"k{i}"] + self.params[f"c{i}"], 0), -1, 1)
            kept += [patches, x]
        pooled = x.reshape(*x.shape[:2], -1).mean(2)
        return pooled @ self.params["w"] + self.params["b"], [*kept, pooled]

    def backward(self, grad: np.ndarray, kept: list[np.ndarray]) -> Params:
        out: Params = {"w": kept[-1].T @ grad, "b": grad.sum(0)}
        shape = kept[3].shape
        grad = np.broadcast_to((grad @ self.params["w"].T / np.prod(shape[2:]))[(..., *([None] * (len(shape) - 2)))], shape)
        for i in (1, 0):
            patches, y = kept[2 * i], kept[2 * i + 1]
            flat = np.moveaxis(grad * (y > 0), 1, -1)
            out |= {f"k{i}": patches.reshape(-1, patches.shape[-1]).T @ flat.reshape(-1, flat.shape[-1]), f"c{i}": flat.reshape(-1, flat.shape[-1]).sum(0)}
            if i:
                grad = _fold(flat @ self.params[f"k{i}"].T, self.sizes[i], self.kernels[i])
        return out


def rebuilt(params: Params, kernels: list | None = None) -> Mlp | Cnn:
    """The network of stored weights: layer sizes from their shapes, a CNN's ``kernels`` as they were."""
    if "w0" in params:
        depth = sum(k.startswith("w") for k in params)
        model: Mlp | Cnn = Mlp([params["w0"].shape[0], *(params[f"w{i}"].shape[1] for i in range(depth))])
    else:
        shapes = tuple(tuple(int(k) for k in x) for x in kernels or ())
        channels = params["k0"].shape[0] // int(np.prod(shapes[0]))
        model = Cnn(channels, (params["k0"].shape[1], params["k1"].shape[1]), params["w"].shape[1], shapes)
    model.params = dict(params)
    return model


def run_summary(history: list[dict]) -> dict:
    """The first epoch of the best validation accuracy with its scores, and the number of epochs."""
    best = max(history, key=lambda h: (h["validation_accuracy"], -h["epoch"]))
    return {"epochs": len(history), "best_epoch": best["epoch"]} | {k: v for k, v in best.items() if k != "epoch"}


class Adam:
    def __init__(self, rate: float = 1e-3, decay: float = 0.0):
        self.rate, self.decay, self.t, self.m, self.v = rate, decay, 0, {}, {}

    def step(self, params: Params, grads: Params) -> None:
        self.t += 1
        for k, g in grads.items():
            g = g + self.decay * params[k]
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g * g
            params[k] = params[k] - self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


class Sgd:
    def __init__(self, rate: float = 1e-2, momentum: float = 0.9, decay: float = 0.0):
        self.rate, self.momentum, self.decay, self.speed = rate, momentum, decay, {}

    def step(self, params: Params, grads: Params) -> None:
        for k, g in grads.items():
            self.speed[k] = self.momentum * self.speed.get(k, 0) + g + self.decay * params[k]
            params[k] = params[k] - self.rate * self.speed[k]


def sharpness_aware(params: Params, gradient: Callable[[], Params], rho: float = 0.05, adaptive: bool = False) -> Params:
    """The gradient at the worst nearby weights; the weights come back unchanged."""
    first = gradient()
    scale = {k: np.abs(params[k]) if adaptive else 1.0 for k in first}
    norm = np.sqrt(sum(((scale[k] * g) ** 2).sum() for k, g in first.items())) + 1e-12
    held = {k: params[k] for k in first}
    for k, g in first.items():
        params[k] = params[k] + rho / norm * scale[k] ** 2 * g
    second = gradient()
    params.update(held)
    return second


def train(model: Mlp | Cnn, x: np.ndarray, y: np.ndarray, validation: tuple[np.ndarray, np.ndarray], optimiser: Adam | Sgd, epochs: int = 10, batch: int = 64, weights: np.ndarray | None = None, rho: float | None = None, adaptive: bool = False, seed: int = 0) -> list[dict]:
    """History of epochs; the model keeps its best weights by validation accuracy, the first on ties."""
    rng, history, best = np.random.default_rng(seed), [], (-1.0, {})
    for epoch in range(1, epochs + 1):
        order, losses, hits = rng.permutation(len(x)), 0.0, 0
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            seen: list = []

            def gradient(some=some, seen=seen) -> Params:
                logits, kept = model.forward(x[some])
                loss, grad = cross_entropy(logits, y[some], weights)
                seen.append((loss, logits))
                return model.backward(grad, kept)

            grads = gradient() if rho is None else sharpness_aware(model.params, gradient, rho, adaptive)
            losses += seen[0][0] * len(some)
            hits += int((seen[0][1].argmax(1) == y[some]).sum())
            optimiser.step(model.params, grads)
        logits, _ = model.forward(validation[0])
        accuracy = float((logits.argmax(1) == validation[1]).mean())
        history.append({"epoch": epoch, "train_loss": losses / len(x), "train_accuracy": hits / len(x), "validation_loss": cross_entropy(logits, validation[1])[0], "validation_accuracy": accuracy})
        if accuracy > best[0]:
            best = (accuracy, {k: v.copy() for k, v in model.params.items()})
    model.params = best[1] or model.params
    return history


def predicted(rows: DataFrame, model: Mlp | Cnn, vector: str, shape: tuple[int, ...], means: np.ndarray | None = None, stds: np.ndarray | None = None) -> DataFrame:
    """``rows`` with ``pred`` (lowest class on ties) and ``probability``; ``vector`` is a flat array of ``shape``."""

    @F.pandas_udf("pred int, probability double")
    def score(vectors: pd.Series) -> pd.DataFrame:
        x = np.stack(vectors.to_numpy()).astype(float)
        if means is not None:
            x = (x - means) / stds
        p = softmax(model.forward(x.reshape(len(x), *shape))[0])
        return pd.DataFrame({"pred": p.argmax(1), "probability": p.max(1)})

    return rows.withColumn("_p", score(vector)).select(*rows.columns, "_p.pred", "_p.probability")


def penultimate(rows: DataFrame, model: Mlp | Cnn, vector: str, shape: tuple[int, ...]) -> DataFrame:
    """``rows`` with ``features``: the input of the model's last layer."""

    @F.pandas_udf("array<double>")
    def embed(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy()).astype(float)
        return pd.Series(list(model.forward(x.reshape(len(x), *shape))[1][-1]))

    return rows.withColumn("features", embed(vector))


def principal_components(rows: DataFrame, vector: str, k: int = 2, out: str = "components") -> DataFrame:
    """``rows`` with the first k principal components of the standardised vectors."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = rows.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    scaled = StandardScaler(withMean=True, withStd=True, inputCol="_v", outputCol="_s").fit(ready).transform(ready)
    found = PCA(k=k, inputCol="_s", outputCol="_p").fit(scaled).transform(scaled)
    return found.withColumn(out, vector_to_array("_p")).drop("_v", "_s", "_p")
