"""Toxicity classifier with counterfactual regularisation (operator 10).

A logistic model over the hashed distinct words of a text. In training, every labelled text
that mentions a group has its identity terms swapped for others of the same kind, and the squared change of
its margin is added to the loss, so that a mention of a group by itself moves no score.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procurelake.llm.linear import BITS, SAMPLE, Ftrl, fit, labelled_texts, score_texts
from procurelake.llm.quality import crc_part
from procurelake.llm.words import GOLDEN, WordTable, bare, mix

THRESHOLD = 0.5
EPOCHS = 8
#: Weight of the squared change of the margin.
PENALTY = 1.0
#: Steps and sparsity of the updates: few of the many words that a text has bear any weight.
ALPHA, L1 = 3.0, 4.0
#: Identity terms by kind; within a kind they may stand for one another.
IDENTITY = {
    "religion": "christian muslim jewish hindu buddhist catholic protestant atheist",
    "religion_people": "christians muslims jews hindus buddhists catholics protestants atheists",
    "origin": "african american asian european mexican chinese indian arab german french spanish",
    "origin_people": "africans americans asians europeans mexicans immigrants refugees foreigners",
    "gender": "woman man girl boy transgender",
    "gender_people": "women men girls boys",
    "orientation": "gay lesbian bisexual straight queer",
    "colour": "black white brown",
    "ability": "disabled deaf blind autistic",
    "age": "old young elderly teenage",
}
WORD = re.compile(r"\w+")


def swapped(text: str, kinds: dict[str, str], step: int = 1) -> str | None:
    """The text with each identity term replaced by the one ``step`` places on in its kind; None if it has none."""
    following = {}
    for terms in kinds.values():
        words = terms.split()
        following |= {w: words[(i + step) % len(words)] for i, w in enumerate(words)}
    changed = WORD.sub(lambda m: following.get(m.group().lower(), m.group()), text)
    return changed if changed != text else None


class Features:
    """Distinct places of a text's words."""

    def __init__(self, bits: int = BITS):
        self.table, self.shift = WordTable(lambda w: xxhash.xxh3_64_intdigest(bare(w))), np.uint64(64 - bits)

    def of(self, text: str) -> np.ndarray:
        words = self.table.of(text.split())
        return np.unique(mix(words * np.uint64(GOLDEN)) >> self.shift).astype(np.int64)


def encoder(bits: int, kinds: dict[str, str]):
    """A function from a text to its places and, for each swap of its identity terms, the places that go and come."""
    features = Features(bits)

    def encode(text: str) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        places = features.of(text)
        others = [features.of(x) for step in (1, 2) if (x := swapped(text, kinds, step))]
        return places.astype(np.int32), [(np.setdiff1d(places, x), np.setdiff1d(x, places)) for x in others]

    return encode


def learner(bits: int, epochs: int, penalty: float):
    def learn(examples: list, labels: list[int]) -> np.ndarray:
        model = Ftrl(bits, alpha=ALPHA, l1=L1)
        for _ in range(epochs):
            for (places, others), label in zip(examples, labels, strict=True):
                model.learn(places, np.ones(len(places)), label)
                for gone, come in others:
                    # gradient of penalty * (margin(x) - margin(x'))^2, which only the swapped features bear
                    apart = np.concatenate([gone, come])
                    sign = np.concatenate([np.ones(len(gone)), -np.ones(len(come))])
                    weights = model.weights(apart)
                    model.update(apart, 2 * penalty * (sign @ weights) * sign, weights)
        return model.all_weights()

    return learn


def margin(weights: np.ndarray):
    features, bias, w = Features(int(np.log2(len(weights)))), float(weights[-1]), weights.astype(np.float64)
    return lambda text: bias + float(w[features.of(text)].sum())


def fit_toxicity(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", *, learn_from=None, sample: int = SAMPLE, epochs: int = EPOCHS, penalty: float = PENALTY, kinds=None
) -> np.ndarray | None:
    """The model's weights, from a bounded sample (``sample`` rows, about) of the labelled rows that ``learn_from`` admits; None without any.

    Null texts count as empty and teach the bias; nulls, repeated rows, empty tables and other columns are as ``labelled_texts`` says.
    """
    examples = labelled_texts(df, labels, id_col, text, "toxic", F.lit(True) if learn_from is None else learn_from, sample)
    terms = IDENTITY if kinds is None else kinds
    return fit(examples, lambda: encoder(BITS, terms), learner(BITS, epochs, penalty))


def score_toxicity(df: DataFrame, weights: np.ndarray | None, text: str = "text", out: str = "score", drop=()) -> DataFrame:
    """Append the probability that each whole text is toxic.

    Null and empty texts score the bias alone; without a model (no labelled row) every score is 0.5. Rows,
    repeated or not, are scored each; a column named ``out`` is replaced, others pass through; an empty
    table stays empty. No shuffle.
    """
    return score_texts(df, text, out, weights, margin, drop)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of four fifths of the ids are learnt from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = fit_toxicity(docs, labels, learn_from=crc_part("doc_id", 5) != 0)
    scored = score_toxicity(docs, weights, drop=["text"])
    held = F.coalesce(crc_part("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
