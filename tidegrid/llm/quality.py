"""Quality by a factorisation machine.

Features of a text are its hashed words (unit length together) and, one-hot by fixed
bounds, statistics of its structure and its length as metadata. Every pair of features
interacts through low-rank factors; the identity
``sum_{i<j} <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i|^2 x_i^2) / 2``
scores a text in time linear in its features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

WORD_SLOTS = 1 << 15
#: Bounds between the one-hot slots of each statistic.
BOUNDS = {
    "chars": (1, 100, 300, 1000, 3000, 10000, 30000),
    "upper": (0.005, 0.02, 0.05, 0.1, 0.3, 0.6),
    "digit": (0.0005, 0.005, 0.02, 0.05, 0.1, 0.3),
    "mark": (0.005, 0.02, 0.04, 0.08, 0.15, 0.3),
    "symbol": (0.0005, 0.005, 0.02, 0.05, 0.1, 0.2),
    "space": (0.05, 0.1, 0.14, 0.18, 0.25, 0.4),
    "wide": (0.001, 0.02, 0.06, 0.12, 0.3, 0.6),
    "word": (2, 3, 4, 5, 6, 8, 12),
    "fresh": (0.05, 0.2, 0.4, 0.6, 0.8, 0.95),
    "lines": (0.2, 0.4, 0.6, 0.8, 0.95, 0.999),
    "width": (10, 30, 60, 120, 300, 1000),
    "stops": (0.0005, 0.002, 0.005, 0.01, 0.02, 0.05),
}
STARTS = WORD_SLOTS + np.concatenate([[0], np.cumsum([len(b) + 1 for b in BOUNDS.values()])])
SLOTS = int(STARTS[-1])
_CLASS = np.zeros(256, int)
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~", b" \t\n\r\x0b\x0c", bytes(range(128, 256)))):
    _CLASS[list(_set)] = _i + 1


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text's features; an empty text has its statistics only."""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=7)
    size = max(1, len(raw))
    words = shared.word_hashes(text)
    slots, times = np.unique((words % shared.U64(WORD_SLOTS)).astype(np.int64), return_counts=True)
    lines = text.split("\n")
    stats = (
        len(text), kinds[1] / size, kinds[2] / size, kinds[3] / size, kinds[4] / size, kinds[5] / size, kinds[6] / size,
        (size - kinds[5]) / max(1, len(words)), len(slots) / max(1, len(words)), len(set(lines)) / len(lines), len(text) / len(lines), counts[46] / size,
    )
    own = STARTS[:-1] + [np.searchsorted(b, v, "right") for b, v in zip(BOUNDS.values(), stats, strict=True)]
    values = np.sqrt(times)
    norm = np.sqrt((values**2).sum()) or 1.0
    return np.concatenate([slots, own]), np.concatenate([values / norm, np.full(len(own), 1 / np.sqrt(len(own)))])


@dataclass
class FactorisationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    @classmethod
    def empty(cls, rank: int = 8, seed: int = 3) -> FactorisationMachine:
        rng = np.random.default_rng(seed)
        return cls(0.0, np.zeros(SLOTS), rng.normal(0, 0.05, (SLOTS, rank)))

    def margin(self, slots: np.ndarray, values: np.ndarray) -> float:
        v = self.factors[slots] * values[:, None]
        total = v.sum(0)
        return float(self.bias + self.weights[slots] @ values + 0.5 * (total @ total - (v * v).sum()))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(*features(text)), -35, 35))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, rate: float = 0.15, l2: float = 1e-5, seed: int = 5) -> FactorisationMachine:
        """AdaGrad on the log loss, classes weighted to the same total."""
        rng = np.random.default_rng(seed)
        if not len(labels):
            return self
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        gw, gv, gb = np.full(SLOTS, 1e-2), np.full(self.factors.shape, 1e-2), 1e-2
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                s, x = rows[i]
                f = self.factors[s]
                total = x @ f
                m = self.bias + self.weights[s] @ x + 0.5 * (total @ total - ((f * x[:, None]) ** 2).sum())
                g = weight[i] * (1 / (1 + np.exp(-np.clip(m, -35, 35))) - labels[i])
                if abs(g) < 1e-4:
                    continue
                dw = g * x + l2 * self.weights[s]
                dv = g * (x[:, None] * total[None] - f * (x * x)[:, None]) + l2 * f
                gb += g * g
                gw[s] += dw * dw
                gv[s] += dv * dv
                self.bias -= rate * g / np.sqrt(gb)
                self.weights[s] -= rate * dw / np.sqrt(gw[s])
                self.factors[s] -= rate * dv / np.sqrt(gv[s])
        return self


def learnable(id_col: str = "doc_id"):
    """Rows that labels may be learned from: the others are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, rank: int = 8) -> FactorisationMachine:
    """A model of ``labels.quality``, fitted on at most ``max_rows`` labelled documents.

    The sample is the labelled rows with the smallest hashes of doc_id among those that
    are not held out, and of rows that repeat a doc_id the least text. Only its features
    reach the driver. Null labels count as none; of several labels of one document the
    largest counts. Without labels every score is 1/2.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & learnable()).groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    chosen = spark.createDataFrame(chosen.collect(), "doc_id long, _quality int")  # max_rows rows at most
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "_quality").agg(F.min("text").alias("text"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            packed = [features(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["_quality"], "slots": [s.astype("<u2" if SLOTS <= 1 << 16 else "<u4").tobytes() for s, _ in packed], "vals": [v.astype("<f4").tobytes() for _, v in packed]})

    got = rows.mapInPandas(extract, "doc_id long, quality int, slots binary, vals binary").collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["slots"])))
    pairs = [(np.frombuffer(r["slots"], "<u2" if SLOTS <= 1 << 16 else "<u4").astype(np.int64), np.frombuffer(r["vals"], "<f4").astype(float)) for r in got]
    return FactorisationMachine.empty(rank).fit(pairs, np.array([int(r["quality"] > 0) for r in got]))


def scored(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """(row, score): each whole row, and 0 to 1, higher if label 1 is likelier. A null text is scored as an empty one."""
    fixed = FactorisationMachine(model.bias, model.weights.astype(np.float32), model.factors.astype(np.float32))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([fixed.score(t or "") for t in texts], index=texts.index, dtype=float)

    return docs.select(F.struct(*docs.columns).alias("row"), score("text").alias("score"))


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> DataFrame:
    """Per document: held_out, score and predicted.

    Repeated rows are scored apart; a very long text is scored whole, in time linear in its
    words; equal texts have equal scores; an empty table gives no row; further columns are
    ignored.
    """
    shared.share_code(docs.sparkSession)
    out = scored(docs.select("doc_id", "text"), train(docs, labels, max_rows))
    return out.select("row.doc_id", F.coalesce(~learnable("row.doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, least: float = 0.5) -> DataFrame:
    """The documents, all columns, whose score is at least ``least``.

    A null or empty text is scored by its statistics like any other; null ids and repeated
    rows don't matter, as each row is judged by itself, a very long text as a whole; an
    empty table gives no row; columns of any name pass. Without labels every document scores
    1/2 and stays.
    """
    shared.share_code(docs.sparkSession)
    return scored(docs, train(docs, labels, max_rows)).filter(F.col("score") >= least).select("row.*")
