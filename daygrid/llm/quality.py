"""Quality classifier: hashed word n-gram logistic regression by FTRL-proximal.

Features are word unigrams and bigrams, of the words themselves and of their
shapes (case, digits, punctuation), hashed into a fixed number of weights; values
are log counts of unit length. Follow-the-regularised-leader keeps per weight a
gradient sum and a squared sum, so that weights the data do not support stay
exactly zero. The rarer class weighs more in the fit, by the root of
the classes' ratio. A score is one sparse dot
product.

The model is fitted on at most ``TRAIN_ROWS`` labelled rows, chosen by the hash
of their id among all rows with a label that are not held out; the features of
these rows are made where the rows are, and one task folds them in a fixed order.

Defined results: a null or empty text has only the constant feature and still
gets a score; a label counts once per id (the larger one if they differ); with
no labelled row at all every score is 0.5. Null ids are scored and not held out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygrid.llm.common import give_back, giving_back, giving_back_at_end, small_batches, texts_of

BITS = 18
TRAIN_ROWS = 10_000
EPOCHS = 3
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
KNOWN_WORDS = 150_000

_RUNS = ((re.compile(r"\d+"), "0"), (re.compile(r"[^\W\d_A-Z]+"), "a"), (re.compile(r"[A-Z]+"), "A"))


def shape_of(word: str) -> str:
    """Runs of capitals, other letters and digits become A, a and 0; the rest stays."""
    if word.isascii() and word.isalpha():  # the common forms, without patterns
        if word.islower():
            return "a"
        if word[1:].islower():
            return "Aa"
    for runs, sign in _RUNS:
        word = runs.sub(sign, word)
    return word[:12]


class Words(dict):
    """Hashes of a word and of its shape, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        h = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) << 32 | zlib.crc32(shape_of(word).encode("utf-8", "surrogatepass"), 7)
        self[word] = h
        return h


_WORDS = Words()


def forget() -> None:
    """Empties the hashes of this worker; by name, as a task's own functions travel with copies of what they refer to."""
    _WORDS.clear()


def features(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct feature ids and their values; id 0 is the constant."""
    words = text.split()
    both = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    kinds = []
    for salt, h in ((11, both >> np.uint64(32)), (13, both & np.uint64(0xFFFFFFFF))):
        h = (h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        kinds.append(h)
        kinds.append((h[:-1] * np.uint64(31) + h[1:]) * np.uint64(0xBF58476D1CE4E5B9))
    ids = (np.concatenate(kinds) >> np.uint64(64 - bits)).astype(np.int32) if words else np.empty(0, np.int32)
    ids, n = np.unique(ids[ids > 0], return_counts=True)
    values = np.log1p(n)
    norm = np.sqrt(values @ values)
    return np.concatenate(([0], ids)).astype(np.int32), np.concatenate(([1.0], values / norm if norm else values)).astype(np.float32)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes over (ids, values, label) in the given order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    good = sum(y for _, _, y in rows)
    weight = [np.sqrt(max(1, good) / max(1, len(rows) - good)), 1.0]
    for _ in range(epochs):
        for ids, x, y in rows:
            zi, ni, x = z[ids], n[ids], np.asarray(x, float)
            w = weights(zi, ni)
            g = weight[y] * (1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            root = np.sqrt(ni + g * g)
            z[ids] = zi + g - (root - np.sqrt(ni)) / ALPHA * w
            n[ids] = ni + g * g
    return weights(z, n).astype(np.float32)


def held_out(id_col: str) -> F.Column:
    """Every fifth id by its checksum is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learned from the labelled rows that are not held out."""
    small_batches(docs.sparkSession)
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("label_id"))
        .agg(F.max("quality").cast("int").alias("y"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(most)
    )

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches, "learned_text"):
            made = [features(t) for t in texts]
            ids, x = ([m[k].tobytes() for m in made] for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(x, pa.binary())], names=["label_id", "y", "ids", "x"]
            )
        forget()

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        order = rows["label_id"].map(lambda i: zlib.crc32(str(i).encode(), 3))
        rows = rows.assign(order=order).sort_values(["order", "label_id", "ids"], kind="stable").drop_duplicates("label_id")
        made = [(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32), int(y)) for i, x, y in zip(rows["ids"], rows["x"], rows["y"], strict=True)]
        return pd.DataFrame({"weights": [fit_ftrl(made).tobytes()]})

    picked = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("learned_text"))
    made = picked.join(F.broadcast(chosen), "label_id").select("label_id", "y", "learned_text")
    schema = T.StructType([*made.select("label_id", "y").schema, T.StructField("ids", T.BinaryType()), T.StructField("x", T.BinaryType())])
    got = made.mapInArrow(giving_back_at_end(featurize), schema).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(giving_back(fold), "weights binary").collect()
    return np.frombuffer(got[0][0], np.float32) if got else np.zeros(1 << BITS, np.float32)


def quality_score(spark, weights: np.ndarray):
    """A column function that scores texts; the word hashes of a task are given back at its end, for the worker lives on."""
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        try:
            for texts in batches:
                out = []
                for t in texts:
                    ids, x = features(t or "")
                    out.append(1.0 / (1.0 + np.exp(-np.clip(float(w[ids] @ x), -30, 30))))
                yield pd.Series(out, dtype="float64")
        finally:
            forget()
            give_back()

    return score


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    score = quality_score(docs.sparkSession, train(docs, labels, id_col, text_col))
    return docs.select(
        F.col(id_col), held_out(id_col).alias("held_out"), score(F.col(text_col)).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    score = quality_score(docs.sparkSession, train(docs, labels))
    return docs.filter(score(F.col("text")) >= threshold)
