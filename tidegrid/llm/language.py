"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams (one to three letters of the text
in lower case). Document frequencies come from all documents of the training folds; the
weights are learned by follow-the-regularised-leader with an elastic net on a bounded
sample for each language, then a temperature is fitted on a part of it that the
weights haven't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

SLOTS = 1 << 15
NONE = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the character n-grams of a whole text, ascending, and how often each occurs."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.zeros(SLOTS, np.int64)
    with np.errstate(over="ignore"):
        h = (chars + np.uint32(1)) * _FACTORS[0]
        for n in (1, 2, 3):
            if n > 1:
                if len(chars) < n:
                    break
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _FACTORS[1] + (chars[n - 1 :] + np.uint32(n)) * _FACTORS[2]
            counts += np.bincount(((h ^ (h >> np.uint32(13))) * _FACTORS[0]) >> np.uint32(17), minlength=SLOTS)
    slots = np.flatnonzero(counts)
    return slots, counts[slots]


def tf_idf(slots: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1 + np.log(counts)) * idf[slots]
    norm = np.sqrt((values * values).sum())
    return values / norm if norm else values


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal state of the weights, one column a class."""

    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.01

    def __post_init__(self):
        self.z, self.n = np.zeros((SLOTS, self.classes)), np.zeros((SLOTS, self.classes))

    def weights(self, slots=slice(None)) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        p = softmax(values @ w)
        p[label] -= 1
        g = values[:, None] * p[None]
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = n + g * g


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class LanguageModel:
    names: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability); ``und`` with 0 for a text without letters (categories Lu, Ll, Lt, Lm and Lo)."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return NONE, 0.0
        slots, counts = ngrams(text)
        p = softmax(tf_idf(slots, counts, self.idf) @ self.weights[slots] / self.temperature)
        best = int(p.argmax())
        return self.names[best], float(p[best])


def learnable(id_col: str = "doc_id"):
    """Rows that may be learned from: the others are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], names: list[str], idf: np.ndarray, epochs: int = 4, seed: int = 11) -> LanguageModel:
    """FTRL over four fifths of the rows, the temperature by the log loss of the others."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, used = order[: len(rows) // 5], order[len(rows) // 5 :]
    ftrl = Ftrl(len(names))
    vectors = [tf_idf(s, c, idf) for s, c, _ in rows]
    for _ in range(epochs):
        for i in rng.permutation(used):
            ftrl.step(rows[i][0], vectors[i], rows[i][2])
    w = ftrl.weights()
    temperature = 1.0
    if len(held):
        margins = np.array([vectors[i] @ w[rows[i][0]] for i in held])
        y = np.array([rows[i][2] for i in held])

        def loss(log_t: float) -> float:
            p = softmax(margins / np.exp(log_t))
            return -float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())

        low, high, golden = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
        for _ in range(40):
            a, b = high - golden * (high - low), low + golden * (high - low)
            low, high = (low, b) if loss(a) <= loss(b) else (a, high)
        temperature = float(np.exp((low + high) / 2))
    return LanguageModel(names, idf, w, temperature)


def train(docs: DataFrame, per_language: int = 600, most_rows: int = 60_000, most_languages: int = 200) -> LanguageModel:
    """A model of ``lang``, learned from documents that are not held out and have a language.

    Document frequencies count all of them; the weights see at most ``per_language``
    documents of each language, those with the smallest hashes of doc_id, and of rows that
    repeat a doc_id in a language the least text. With more languages than ``most_rows /
    per_language``, each gives its part of ``most_rows``. Only the ``most_languages`` with
    the most rows are learned.
    """
    fold = docs.filter(F.col("lang").isNotNull() & F.coalesce(learnable(), F.lit(False)))
    rows = fold.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(SLOTS, np.int64), 0
        for pdf in batches:
            for text in pdf["text"]:
                df[ngrams(text)[0]] += 1
                n += 1
        slots = np.flatnonzero(df)
        yield pd.DataFrame({"slot": np.append(slots, -1), "df": np.append(df[slots], n)})

    counted = rows.select("text").mapInPandas(frequencies, "slot int, df long").groupBy("slot").agg(F.sum("df").alias("df")).collect()  # one row a slot
    df, n = np.zeros(SLOTS), 0
    for slot, x in counted:
        if slot < 0:
            n = x
        else:
            df[slot] = x
    idf = np.log((1 + n) / (1 + df)) + 1

    # in two steps, so that no task gets a frequent language's rows of all partitions
    order = (F.xxhash64("doc_id"), "doc_id")
    known = [r.lang for r in fold.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(min(most_languages, most_rows)).collect()]
    per_language = min(per_language, most_rows // max(1, len(known)))
    chosen = fold.filter(F.col("lang").isin(known)).select("doc_id", "lang").distinct().withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    for by in (("lang", "part"), ("lang",)):
        chosen = chosen.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_place") <= per_language)
    chosen = shared.stored(chosen.select("doc_id", "lang"), "chosen")  # its size is known when the join is planned

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [ngrams(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "slots": [s.astype("<u2").tobytes() for s, _ in got], "counts": [c.astype("<u4").tobytes() for _, c in got]})

    rows = rows.join(chosen, ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    sample = rows.mapInPandas(extract, "doc_id long, lang string, slots binary, counts binary").collect()
    sample.sort(key=lambda r: (r["doc_id"], r["lang"], bytes(r["slots"])))
    names = sorted({r["lang"] for r in sample})
    pairs = [(np.frombuffer(r["slots"], "<u2").astype(np.int64), np.frombuffer(r["counts"], "<u4"), names.index(r["lang"])) for r in sample]
    return fit(pairs, names, idf)


def languages(docs: DataFrame, per_language: int = 600, model: LanguageModel | None = None) -> DataFrame:
    """Per document: held_out, lang_pred and score.

    A null text and one without letters are ``und`` with score 0, as is every text when
    there is nothing to learn from. Repeated rows are judged apart; a very long text is
    judged whole; of equally likely languages the first by name is given; an empty table
    gives no row; further columns are ignored.
    """
    shared.share_code(docs.sparkSession)
    model = model or train(docs, per_language)
    small = LanguageModel(model.names, model.idf.astype(np.float32), model.weights.astype(np.float32), model.temperature)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([small.predict(t) for t in texts], columns=["lang_pred", "score"], index=texts.index)

    out = docs.select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), predict("text").alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
