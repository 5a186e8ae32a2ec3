"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The learner sees a bounded sample of the labelled rows, chosen by a hash of the id: ``TRAIN_DOCS`` whole
documents.  Per-coordinate rates follow from the accumulated squared gradients, and the L1 term leaves few
weights other than zero; these alone are sent to the tasks that score, at most one for each of the
``1 << DIM_BITS`` coordinates.

A document's features are the distinct hashed words, pairs of neighbours and pairs one word apart.
Null and empty texts have no features and get the score of the bias.  Null labels and null ids are not
learned from; of several labels of a document the highest counts, and of several documents with one id that whose features have the
smallest hash is learned from, so that the bound on documents holds.  Without labels every score
is one half.  Columns of the input other than id and text are never read by the learner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cueline.llm.common import remainder, utf8
from cueline.llm.decontamination import plain_words

#: Coordinates, documents learned from, rounds over them, and the score that predicts toxicity.
DIM_BITS, TRAIN_DOCS, ROUNDS, LIMIT = 20, 20_000, 6, 0.7
#: FTRL-proximal's rates and penalties.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 12.0, 0.0
#: Multipliers that keep the kinds of features apart.
KINDS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def features(text: bytes) -> np.ndarray:
    """Coordinates of a text, with repeats."""
    from xxhash import xxh64_intdigest

    found = plain_words(text)
    h = np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found))
    shift = np.uint64(64 - DIM_BITS)
    parts = [(h * KINDS[0]) >> shift]
    for gap in (1, 2):
        if len(h) > gap:
            parts.append(((h[:-gap] * KINDS[gap] + (h[gap:] ^ (h[gap:] >> np.uint64(29)))) * KINDS[0]) >> shift)
    return np.concatenate(parts).astype(np.int64)


def learn(examples: list[tuple[np.ndarray, int]], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias) of the logistic regression, by FTRL-proximal one example at a time."""
    z, n = np.zeros(1 << DIM_BITS), np.zeros(1 << DIM_BITS)
    z0 = n0 = 0.0

    def weight(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    positive = sum(label for _, label in examples)
    # the rarer class counts more, by the root of the odds, so that a limit means the same for any mixture
    heavier = np.sqrt(max(1.0, (len(examples) - positive) / max(1, positive)))
    for _ in range(rounds):
        for at, label in examples:
            w = weight(z[at], n[at])
            bias = -z0 / ((BETA + np.sqrt(n0)) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30)))
            g = (p - label) * (heavier if label else 1.0)
            grown = np.sqrt(n[at] + g * g) - np.sqrt(n[at])
            z[at] += g - grown / ALPHA * w
            n[at] += g * g
            z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / ALPHA * bias
            n0 += g * g
    w = weight(z, n)
    kept = np.flatnonzero(w)
    return kept, w[kept], float(-z0 / ((BETA + np.sqrt(n0)) / ALPHA))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray, float]:
    """The model of the rows that may be learned from: those whose id's crc32 modulo 3 is not 1."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.where(remainder(F.col("doc_id"), 3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # at most train_docs rows of two numbers: the documented bound of what is broadcast
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8(F.col("text")).alias("text")).join(F.broadcast(sample), "doc_id")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [np.unique(features(t)).astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(at, pa.list_(pa.int32())), batch.column(2)], names=["doc_id", "at", "toxic"]
            )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            values = batch.column(1)
            rows += [
                (doc, hash_, values[i].values.to_numpy(), toxic)
                for i, (doc, hash_, toxic) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True))
            ]
        if not rows:
            return
        rows.sort(key=lambda r: (r[1], r[0], len(r[2])))
        kept, weights, bias = learn([(at, toxic) for _, _, at, toxic in rows])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(kept, -1)), pa.array(np.append(weights, bias))], names=["at", "w"])

    found_rows = texts.select("doc_id", "text", "toxic").mapInArrow(found, "doc_id bigint, at array<int>, toxic int")
    found_rows = found_rows.groupBy("doc_id").agg(F.min_by("at", F.xxhash64("at")).alias("at"), F.max("toxic").alias("toxic"))
    # one task learns from the bounded sample, as the method goes example by example
    model = (
        found_rows.withColumn("h", F.xxhash64("doc_id")).repartition(1).mapInArrow(fitted, "at bigint, w double").collect()
    )
    if not model:
        return np.empty(0, np.int64), np.empty(0), 0.0
    table = dict((r.at, r.w) for r in model)
    bias = table.pop(-1)
    at = np.array(sorted(table), dtype=np.int64)
    return at, np.array([table[i] for i in at.tolist()]), bias


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(row, score): every row of ``docs`` as a struct, and its score from the whole text."""
    at, weights, bias = model
    sent = docs.sparkSession.sparkContext.broadcast((at, weights.astype(np.float64), bias))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("row"), utf8(F.col("text")).alias("__text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weights, bias = sent.value
        dense = np.zeros(1 << DIM_BITS)
        dense[at] = weights
        for batch in batches:
            sums = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = features(text)
                own = np.unique(own[dense[own] != 0])  # most coordinates weigh nothing
                sums[i] = dense[own].sum() + bias
            scores = 1 / (1 + np.exp(-np.clip(sums, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["row", "score"])

    return packed.mapInArrow(score, StructType([packed.schema["row"], StructField("score", DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the toxicity query."""
    facts = docs.select("doc_id", "text")
    found = scored(facts, train(docs, labels))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        (remainder(F.col("row.doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= LIMIT).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The documents that score below the limit, with the columns they came with."""
    return scored(docs, train(docs, labels)).where(F.col("score") < limit).select("row.*")
