"""Hashed linear models trained by follow-the-regularised-leader updates on a bounded sample of labelled rows."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm.shared import append_columns, quoted, text_or_empty

#: Buckets of a model as a power of two: 2^18 weights of 4 bytes, 1 MB to broadcast.
BITS = 18
#: Labelled rows that a model is fitted on at most, about: all their sparse features go to one task.
SAMPLE = 20_000


class Ftrl:
    """FTRL-proximal logistic regression on sparse examples (places, values); place 2^bits is the bias."""

    def __init__(self, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.3, l2: float = 0.01):
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.bias = 1 << bits

    def weights(self, places: np.ndarray) -> np.ndarray:
        z, l1 = self.z[places], np.where(places == self.bias, 0.0, self.l1)
        rate = (self.beta + np.sqrt(self.n[places])) / self.alpha + self.l2
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / rate, 0.0)

    def update(self, places: np.ndarray, gradient: np.ndarray, weights: np.ndarray) -> None:
        """Places are distinct."""
        n = self.n[places]
        more = n + gradient**2
        self.z[places] += gradient - (np.sqrt(more) - np.sqrt(n)) / self.alpha * weights
        self.n[places] = more

    def learn(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        places, values = np.append(places, self.bias), np.append(values, 1.0)
        weights = self.weights(places)
        p = 1 / (1 + np.exp(-np.clip(values @ weights, -35, 35)))
        self.update(places, (p - label) * values, weights)

    def all_weights(self) -> np.ndarray:
        return self.weights(np.arange(self.bias + 1)).astype("<f4")


def sampled(labelled: DataFrame, id_col: str, most: int) -> DataFrame:
    """About ``most`` of the rows, chosen by a hash of the id; all rows if there are no more."""
    n = labelled.count()
    if n <= most:
        return labelled
    return labelled.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 20)) < int(most / n * (1 << 20)))


def fit(examples: DataFrame, encode: Callable[[], Callable[[str], Any]], learn: Callable[[list, list[int]], np.ndarray]) -> np.ndarray | None:
    """Train one model on ``examples(text, label, order)``, whatever their number; None without any.

    ``encode()`` makes a function from a text to its features, which runs where the texts are; the trainer gets
    the features of the sample alone, never texts, in order of ``order``. The driver gets the weight vector.
    """

    def make():
        features = encode()
        return lambda texts: [pa.array([pickle.dumps(features(t.as_py() or "")) for t in texts], pa.binary())]

    encoded = append_columns(examples, ["text"], [T.StructField("features", T.BinaryType())], make, drop=["text"])

    def train(table):
        table = table.sort_by("order")
        weights = learn([pickle.loads(x.as_py()) for x in table["features"]], table["label"].to_pylist())
        return pa.table({"weights": pa.array([weights.tobytes()], pa.binary())})

    found = encoded.groupBy(F.pmod("order", F.lit(1)).alias("model")).applyInArrow(train, "weights binary").collect()
    return np.frombuffer(found[0].weights, "<f4") if found else None


def labelled_texts(df: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, learn_from, most: int) -> DataFrame:
    """(text, label, order) of a bounded sample of the labelled rows that ``learn_from`` admits.

    A null label or id is no label; of several labels of one id the largest counts; a label whose id no row
    has teaches nothing, and rows repeated with id and text are examples each. The labels are bounded by the
    sample before they are broadcast to the texts. Other columns are not read, whatever their names.
    """
    own = F.col(quoted(id_col))
    clean = labels.where(F.col(quoted(label)).isNotNull() & own.isNotNull() & learn_from)
    one = clean.groupBy(own.alias("id")).agg(F.max(quoted(label)).cast("int").alias("label"))
    texts = df.select(own.alias("id"), text_or_empty(text).alias("text"))
    joined = texts.join(F.broadcast(sampled(one, "id", most)), "id")
    return joined.select("text", "label", F.xxhash64("id", "text").alias("order"))


def score_texts(df: DataFrame, text: str, out: str, weights: np.ndarray | None, margin: Callable, drop=()) -> DataFrame:
    """Append the probability of label 1: the logistic of ``margin(weights)(text)``; 0.5 throughout without a model."""
    model = df.sparkSession.sparkContext.broadcast(weights)

    def make():
        value = margin(model.value) if model.value is not None else (lambda _: 0.0)

        def compute(texts: pa.Array):
            margins = np.array([value(t.as_py() or "") for t in texts], np.float64)
            return [pa.array(1 / (1 + np.exp(-np.clip(margins, -35, 35))), pa.float64())]

        return compute

    return append_columns(df, [text_or_empty(text)], [T.StructField(out, T.DoubleType())], make, drop=drop)
