"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are hashed unigrams, bigrams and one-word-gap skip-grams, each present or absent in a text. FTRL-proximal keeps
``z`` and ``n`` per coordinate (hence a learning rate per coordinate) and its L1 term leaves few non-zero weights, which
are small enough to send to every task: at most ``2 ** bits`` of them.

Defined results: a null text is the empty text, and an empty text gets the score of the bias alone; rows without a label
are not learned from; a ``doc_id`` labelled more than once is toxic if any of its labels is; of rows that repeat a
``doc_id`` the smallest text is learned from, and repeated rows are scored alike, each on its own; without a labelled row all scores are 0.5 minus nothing learned, that is sigmoid(0); an empty
table gives an empty result; other columns pass through, and a column that has the name of a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import bounded_batches, read_table
from ._words import mix64, text_bytes, tidy, word_hashes, word_spans

#: Production parameters. MAX_TRAIN bounds the labelled rows that are learned from (chosen by a hash of doc_id).
BITS, MAX_TRAIN, EPOCHS = 20, 20_480, 2
ALPHA, BETA, L1, L2 = 1.5, 1.0, 2.0, 0.5
_BIGRAM, _SKIP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def hashed_features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text, sorted, one text after the other; and where each text's begin."""
    raw, at = text_bytes(column)
    starts, ends, first = word_spans(raw, at)
    words = word_hashes(raw, starts, ends)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    near = row[:-1] == row[1:]
    far = row[:-2] == row[2:]
    bigram = mix64(words[:-1] * _BIGRAM + words[1:])[near]
    skip = mix64(words[:-2] * _SKIP + words[2:])[far]
    rows = np.concatenate([row, row[:-1][near], row[:-2][far]]).astype(np.uint64)
    hashes = np.concatenate([words, bigram, skip]) >> np.uint64(64 - bits)
    both = np.unique((rows << np.uint64(bits)) | hashes)
    bounds = np.searchsorted(both >> np.uint64(bits), np.arange(len(at), dtype=np.uint64))
    return (both & np.uint64((1 << bits) - 1)).astype(np.int32), bounds


class Ftrl:
    """FTRL-proximal for logistic loss with features that are 0 or 1; the last coordinate is the bias."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, features: np.ndarray, label: int) -> None:
        at = np.append(features, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        was = self.n[at]
        self.z[at] += g - (np.sqrt(was + g * g) - np.sqrt(was)) / self.alpha * w
        self.n[at] = was + g * g


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(text, toxic) of at most ``max_train`` labelled documents whose crc32(doc_id as text) mod 5 is not 0."""
    chosen = (
        labels.where("toxic is not null and doc_id is not null and crc32(cast(doc_id as string)) % 5 <> 0")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )
    # at most max_train pairs of numbers are broadcast; of rows that repeat a doc_id one text is learned from
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_train: int = MAX_TRAIN, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights that are not zero, learned from a bounded sample in one task."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, bounds = hashed_features(batch.column("text"), bits)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), lists], ["doc_id", "toxic", "features"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        lists = table.column("features").combine_chunks()
        values, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        toxic, ids = table.column("toxic").to_numpy(), table.column("doc_id").to_numpy()
        # an id is here once, so every run learns in the same order
        order = np.argsort(ids, kind="stable")
        model, rng = Ftrl(1 << bits), np.random.Generator(np.random.PCG64(7))
        for _ in range(epochs):
            for i in rng.permutation(order):
                model.learn(values[bounds[i] : bounds[i + 1]], int(toxic[i] > 0))
        w = model.weights()
        kept = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(w[kept])], ["feature", "weight"])

    rows = training_rows(docs, labels, max_train).mapInArrow(tidy(features), "doc_id long, toxic int, features array<int>")
    found = rows.repartition(1).mapInArrow(tidy(train), "feature long, weight double").toPandas()
    return found["feature"].to_numpy(np.int64), found["weight"].to_numpy(np.float64)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a column ``into`` from 0 to 1, computed from the whole text and nothing else."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # at most 2**bits weights

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dense = np.zeros((1 << bits) + 1)
        dense[sent.value[0]] = sent.value[1]
        for column in batches:
            found, bounds = hashed_features(pa.array(column), bits)
            sums = np.concatenate([[0.0], np.cumsum(dense[found])])
            total = sums[bounds[1:]] - sums[bounds[:-1]] + dense[-1]
            yield pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))

    from pyspark.sql.functions import arrow_udf

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(scores)(batches)

    return docs.withColumn(into, arrow_udf(run, "double")(F.col(text)))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    model = fit(docs, labels)
    clean = docs.drop("held_out", "score", "predicted")
    return (
        score(clean, model)
        .withColumn("held_out", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False)))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_scores(docs, read_table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
