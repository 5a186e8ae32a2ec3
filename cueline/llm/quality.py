"""Quality by ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

A document becomes a few statistics of its whole text: sizes, shares of kinds of bytes, words and lines that
repeat, how far it can be compressed.  Cosines of seeded random projections approximate a Gaussian kernel over the
standardised statistics.  Tasks add up the normal equations of their rows; only the sums, whose number is set by
``FEATURES`` and ``FOLDS``, reach the driver, where ridge weights are solved.  Each fold of the labelled rows is scored by the weights
of the other folds, and its labels against these scores give the monotone curve that makes a score a probability.

All sums are of whole numbers, so the model doesn't depend on the order in which tasks end or are run again.

All labelled rows are learned from, whatever their number.  Null ids and null labels teach nothing; of several labels of
an id the highest counts, and each document with a labelled id is learned from.  Null and empty texts are documents without
words and are scored as such.  Without labels every score is one half.  An empty table gives an empty result.  Columns of
the input other than id and text are never read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.llm.common import remainder, stored, utf8

#: Cosines, the kernel's width in standard deviations, the ridge penalty in rows, folds, and the seed of the projections.
FEATURES, WIDTH, RIDGE, FOLDS, SEED = 512, 6.0, 1.0, 2, 42
#: The score that predicts good quality, and steps between raw scores that calibration tells apart.
LIMIT, STEPS = 0.7, 10_000
#: Bytes of a text that are looked at together.
PIECE = 4 << 20
#: Statistics are kept as whole numbers of this part, cosines of that; deviations beyond the last are cut.
STAT_UNIT, COS_UNIT, FAR = 1e-6, 2.0**-14, 6.0

_CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz",
    b"0123456789",
    b".",
    b",;:",
    b"!?",
    b"#$%&*|@^~<>{}[]\\/+=_`",
    b"\"'()-",
    bytes(range(0x80, 0x100)),
)
_OF_CLASS = np.array([[float(b in kind) for kind in _CLASSES] for b in range(256)])
_SPACES = list(b" \t\n\x0b\f\r")
STATISTICS = 10 + len(_CLASSES) + 2


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``PIECE`` bytes, cut at line ends or blanks where there are any."""
    begin = 0
    while len(text) - begin > PIECE:
        end = max(text.rfind(b"\n", begin, begin + PIECE), text.rfind(b" ", begin, begin + PIECE)) + 1
        end = end if end > begin else begin + PIECE
        yield text[begin:end]
        begin = end
    yield text[begin:]


def statistics(text: bytes) -> np.ndarray:
    """The statistics of a UTF-8 text, in units of ``STAT_UNIT``."""
    bytes_of, seen, lines = np.zeros(256), Counter(), Counter()
    n = long_sum = square_sum = longest = marked = pressed = 0
    for piece in _pieces(text):
        bytes_of += np.bincount(np.frombuffer(piece, dtype=np.uint8), minlength=256)
        found = piece.split()
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        n += len(found)
        long_sum += int(lengths.sum())
        square_sum += int((lengths * lengths).sum())
        longest = max(longest, int(lengths.max(initial=0)))
        marked += sum(not w[-1:].isalnum() and w[-1] < 0x80 for w in found)
        seen.update(found)
        lines.update(line for line in piece.split(b"\n") if line.strip())
        pressed += len(zlib.compress(piece, 1))
    shown = max(1.0, len(text) - bytes_of[_SPACES].sum())
    kinds = bytes_of @ _OF_CLASS / shown
    letters = max(1.0, bytes_of @ _OF_CLASS[:, 0] + bytes_of @ _OF_CLASS[:, 1])
    shares = bytes_of[bytes_of > 0] / max(1, len(text))
    words, rows = max(1, n), max(1, sum(lines.values()))
    mean = long_sum / words
    values = [
        np.log1p(len(text)),
        np.log1p(n),
        mean,
        np.sqrt(max(0.0, square_sum / words - mean * mean)),
        np.log1p(longest),
        marked / words,
        len(seen) / words,
        max(seen.values(), default=0) / words,
        np.log1p(rows),
        1 - len(lines) / rows,
        *kinds,
        bytes_of @ _OF_CLASS[:, 0] / letters,
        -(shares * np.log2(shares)).sum() + pressed / max(1, len(text)),
    ]
    return np.rint(np.array(values) / STAT_UNIT).astype(np.int64)


def measured(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns of ``docs`` and the statistics of each row's text."""
    packed = docs.select(*[F.col(f"`{c}`") for c in columns], utf8(F.col("text")).alias("__text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in batch.column(len(columns)).to_pylist()]
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            offsets = np.arange(len(found) + 1, dtype=np.int32) * STATISTICS
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*columns, "stats"])

    from pyspark.sql.types import ArrayType, LongType, StructType

    schema = StructType([f for f in packed.schema.fields if f.name != "__text"]).add("stats", ArrayType(LongType()))
    return packed.mapInArrow(each, schema)


class Scaling(NamedTuple):
    """Means and deviations of the statistics, both in ``STAT_UNIT``."""

    mean: np.ndarray
    spread: np.ndarray


def projections() -> tuple[np.ndarray, np.ndarray]:
    """Directions and phases of the cosines, from the seed."""
    r = np.random.default_rng(SEED)
    return r.standard_normal((STATISTICS, FEATURES)) / WIDTH, r.uniform(0, 2 * np.pi, FEATURES)


def fourier(stats: np.ndarray, scaling: Scaling) -> np.ndarray:
    """Cosines of rows of statistics and a constant, as whole numbers of ``COS_UNIT``."""
    scaled = np.clip((stats - scaling.mean) / scaling.spread, -FAR, FAR)
    directions, phases = projections()
    cosines = np.rint(np.cos(scaled @ directions + phases) / COS_UNIT)
    return np.hstack((cosines, np.full((len(stats), 1), 1 / COS_UNIT)))


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def scaling_of(rows: DataFrame) -> Scaling | None:
    """Exact moments of the statistics of ``rows``."""
    each = [F.col("stats")[i].cast("decimal(20,0)") for i in range(STATISTICS)]
    sums = rows.agg(F.count(F.lit(1)), *[F.sum(c) for c in each], *[F.sum((c * c).cast("decimal(38,0)")) for c in each]).first()
    n = sums[0]
    if not n:
        return None
    mean = np.array([float(s) / n for s in sums[1 : STATISTICS + 1]])
    variance = [max(0, int(q) * n - int(s) ** 2) / n / n for s, q in zip(sums[1 : STATISTICS + 1], sums[STATISTICS + 1 :], strict=True)]
    return Scaling(mean, np.maximum(np.sqrt(np.array(variance)), 1.0))


def normal_sums(rows: DataFrame, scaling: Scaling) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each fold of ``rows`` (stats, label, fold) its sums of squares and products, and of products with the label."""
    width = FEATURES + 1
    upper = np.triu_indices(width)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = np.zeros((FOLDS, len(upper[0])), dtype=np.int64)
        products = np.zeros((FOLDS, width), dtype=np.int64)
        for batch in batches:
            z, label, fold = fourier(_matrix(batch, 0), scaling), np.asarray(batch.column(1)), np.asarray(batch.column(2))
            for f in np.unique(fold).tolist():
                own = z[fold == f]
                # whole numbers below 2^53: exact in floating point
                squares[f] += (own.T @ own)[upper].astype(np.int64)
                products[f] += (own.T @ label[fold == f]).astype(np.int64)
        for f in range(FOLDS):
            if squares[f].any():
                values = np.concatenate((squares[f], products[f]))
                place = np.arange(len(values), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), f)), pa.array(place), pa.array(values)], names=["fold", "place", "value"])

    added = rows.select("stats", "label", "fold").mapInArrow(each, "fold bigint, place bigint, value bigint").groupBy("fold", "place").agg(F.sum("value").alias("value"))
    found = {}
    # at most FOLDS * (FEATURES + 1) * (FEATURES + 4) / 2 numbers
    table = added.toPandas()
    for fold, part in table.groupby("fold"):
        values = part.sort_values("place")["value"].to_numpy().astype(np.float64)
        square = np.zeros((width, width))
        square[upper] = values[: len(upper[0])]
        square = square + np.triu(square, 1).T
        found[int(fold)] = (square * COS_UNIT**2, values[len(upper[0]) :] * COS_UNIT)
    return found


def ridge(square: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Weights of the cosines; the constant is not penalised."""
    penalty = np.full(len(product), RIDGE)
    penalty[-1] = 1e-9
    return np.linalg.solve(square + np.diag(penalty), product)


def steps_of(stats: np.ndarray, scaling: Scaling, weights: np.ndarray) -> np.ndarray:
    """Raw scores in steps, from half below 0 to half above 1."""
    raw = fourier(stats, scaling) @ weights * COS_UNIT
    return np.rint(np.clip(raw, -0.5, 1.5) * STEPS).astype(np.int64)


def isotonic(steps: np.ndarray, count: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps, values): the best rising curve through the shares of positives, as points to interpolate between.

    Neighbours that would fall are pooled, and stand at the mean step of the pool.
    """
    pools: list[list[float]] = []
    order = np.argsort(steps)
    for step, n, hits in zip(steps[order].tolist(), count[order].tolist(), positive[order].tolist(), strict=True):
        pools.append([float(hits), float(n), float(step) * n])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


class Model(NamedTuple):
    scaling: Scaling
    weights: np.ndarray
    steps: np.ndarray
    values: np.ndarray

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(steps_of(stats, self.scaling, self.weights), self.steps, self.values)


def fit(rows: DataFrame) -> Model | None:
    """The model of ``rows`` (doc_id, stats, label); none without rows."""
    dealt = rows.select("stats", F.col("label").cast("bigint").alias("label"), F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    scaling = scaling_of(dealt)
    if scaling is None:
        return None
    sums = normal_sums(dealt, scaling)
    square, product = sum(s for s, _ in sums.values()), sum(p for _, p in sums.values())
    weights = ridge(square, product)
    apart = {f: ridge(square - s, product - p) if len(sums) > 1 else weights for f, (s, p) in sums.items()}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats, fold = _matrix(batch, 0), np.asarray(batch.column(2))
            found = np.zeros(len(fold), dtype=np.int64)
            for f in np.unique(fold).tolist():
                found[fold == f] = steps_of(stats[fold == f], scaling, apart[f])
            yield pa.RecordBatch.from_arrays([pa.array(found), batch.column(1)], names=["step", "label"])

    met = dealt.mapInArrow(each, "step bigint, label bigint").groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits"))
    # at most 2 * STEPS + 1 rows
    curve = met.toPandas()
    steps, values = isotonic(*(curve[c].to_numpy() for c in ("step", "n", "hits")))
    return Model(scaling, weights, steps, values)


def scored(stats: DataFrame, model: Model | None) -> DataFrame:
    """``stats`` (doc_id, stats) with the score in place of the statistics."""
    if model is None:
        return stats.select("doc_id", F.lit(0.5).alias("score"))
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.scores(_matrix(batch, 1)))], names=["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(each, "doc_id bigint, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score): every row of ``docs``, learned from the labels outside the held-out part."""
    stats = stored(measured(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id"))
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label")).dropna()
    known = known.where(remainder(F.col("doc_id"), 4) != 2).groupBy("doc_id").agg(F.max("label").alias("label"))
    return scored(stats, fit(stored(stats.join(known, "doc_id"))))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the quality query."""
    return quality_scores(docs, labels).select(
        "doc_id",
        (remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= LIMIT).cast("int").alias("predicted"),
    )
