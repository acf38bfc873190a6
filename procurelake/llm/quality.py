"""Quality classifier (operator 9): hashed word n-gram logistic regression by follow-the-regularised-leader.

Words are taken twice: as written (lower case, punctuation around them removed) and as their shape (letters,
digits and marks, runs collapsed), since junk shows in shapes that no vocabulary lists. Features are the
hashed single words and pairs of both, and whether a word repeats the one before; their values are shares of
the text's words, and a score is a sparse dot product with the weights.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procurelake.llm.linear import BITS, SAMPLE, Ftrl, fit, labelled_texts, score_texts
from procurelake.llm.words import GOLDEN, WordTable, bare, mix

THRESHOLD = 0.7
EPOCHS = 4
#: Factor on the shares, so that one update moves a feature of a few per cent of the words.
SCALE = 10.0
RUNS = ((re.compile(r"[a-zß-öø-ÿ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w\s])\1+"), r"\1"))


def shape(word: str) -> str:
    for pattern, to in RUNS:
        word = pattern.sub(to, word)
    return word


def two_hashes(word: str) -> int:
    """The word's hash in the upper half, its shape's in the lower."""
    return xxhash.xxh32_intdigest(bare(word)) << 32 | xxhash.xxh32_intdigest(shape(word))


class Features:
    """Places of a text's features, each place as often as the feature occurs."""

    def __init__(self, bits: int = BITS):
        self.table, self.shift = WordTable(two_hashes), np.uint64(64 - bits)

    def of(self, text: str) -> tuple[np.ndarray, int]:
        both = self.table.of(text.split())
        n = len(both)
        out = []
        for family, one in enumerate((both >> np.uint64(32), both & np.uint64(0xFFFFFFFF))):
            one = one + np.uint64((2 * family + 1) << 40)
            out.append(mix(one * np.uint64(GOLDEN)) >> self.shift)
            if n > 1:
                out.append(mix(mix(one[:-1] * np.uint64(GOLDEN)) + one[1:]) >> self.shift)
        if n > 1:
            same = int((both[1:] == both[:-1]).sum())
            out.append(np.full(same, mix(np.array([GOLDEN], np.uint64))[0] >> self.shift, np.uint64))
        return np.concatenate(out).astype(np.int64), n


def encoder(bits: int):
    """A function from a text to the distinct places of its features and their values."""
    features = Features(bits)

    def encode(text: str) -> tuple[np.ndarray, np.ndarray]:
        places, n = features.of(text)
        places, counts = np.unique(places, return_counts=True)
        return places.astype(np.int32), (counts * (SCALE / max(1, n))).astype(np.float32)

    return encode


def learner(bits: int, epochs: int):
    def learn(examples: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> np.ndarray:
        model = Ftrl(bits)
        for _ in range(epochs):
            for (places, values), label in zip(examples, labels, strict=True):
                model.learn(places, values, label)
        return model.all_weights()

    return learn


def margin(weights: np.ndarray):
    features, bias, w = Features(int(np.log2(len(weights)))), float(weights[-1]), weights.astype(np.float64)

    def value(text: str) -> float:
        places, n = features.of(text)
        return bias + SCALE * float(w[places].sum()) / max(1, n)

    return value


def fit_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", *, learn_from=None, sample: int = SAMPLE, epochs: int = EPOCHS) -> np.ndarray | None:
    """The model's weights, from a bounded sample (``sample`` rows, about) of the labelled rows that ``learn_from`` admits; None without any.

    Null texts count as empty and teach the bias; nulls, repeated rows, empty tables and other columns are as ``labelled_texts`` says.
    """
    examples = labelled_texts(df, labels, id_col, text, "quality", F.lit(True) if learn_from is None else learn_from, sample)
    return fit(examples, lambda: encoder(BITS), learner(BITS, epochs))


def score_quality(df: DataFrame, weights: np.ndarray | None, text: str = "text", out: str = "score", drop=()) -> DataFrame:
    """Append the probability of good quality of each whole text.

    Null and empty texts score the bias alone; without a model (no labelled row) every score is 0.5. Rows,
    repeated or not, are scored each; a column named ``out`` is replaced, others pass through; an empty
    table stays empty. No shuffle.
    """
    return score_texts(df, text, out, weights, margin, drop)


def crc_part(id_col: str, parts: int):
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of three quarters of the ids are learnt from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = fit_quality(docs, labels, learn_from=crc_part("doc_id", 4) != 2)
    scored = score_quality(docs, weights, drop=["text"])
    held = F.coalesce(crc_part("doc_id", 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
