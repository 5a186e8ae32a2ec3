"""Repeated passages by a sparse suffix array over minimiser positions.

A suffix is kept where the hash of its first ``GRAM`` words is the least in some window of ``min_words`` words, so every
stretch of ``min_words`` words has a kept suffix at a place that its words alone decide.  Sorted suffixes that
begin alike are neighbours; a suffix without such a neighbour cannot lie in a repeated passage and goes.

A kept suffix stands for the run of windows whose least position it is.  Neighbours are compared over the
whole reach of that run, to the left and to the right: where it is the same, all windows of the run repeat.
Where neighbours begin alike but part somewhere in that reach, they are extended word by word, as windows of
one suffix for each different reach.  Repeated windows that touch are one passage.

Sorting and comparing is done on 64-bit fingerprints by aggregation, so equal neighbours combine before the
shuffle and a passage in a third of all documents is one row a task.

Words are runs of other characters than white space.  Null and short texts have no passages.  Rows equal in id and text are one
document.  An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueline.llm.common import stored, utf8

#: Words of a passage at least, and words by which suffixes are sorted first.
MIN_WORDS, GRAM = 50, 8
#: Odd multiplier of the rolling fingerprints and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Rolling:
    """Fingerprints of any stretch of a document's words."""

    def __init__(self, text: bytes):
        from xxhash import xxh64_intdigest

        found = text.split()
        self.n = len(found)
        hashes = np.fromiter(map(xxh64_intdigest, found), np.uint64, self.n)
        steps = np.full(self.n + 1, BASE, dtype=np.uint64)
        back = np.full(self.n + 1, INVERSE, dtype=np.uint64)
        steps[0] = back[0] = 1
        self.back = np.cumprod(back)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(steps)[:-1])))

    def prints(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        x = (self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return x ^ (x >> np.uint64(29))


def owners(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of the least, the leftmost of equals."""
    least, place, reach = values, np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        left = least[:-step] <= least[step:]
        least = np.where(left, least[:-step], least[step:])
        place = np.where(left, place[:-step], place[step:])
        reach += step
    return place


def suffixes(text: bytes, min_words: int = MIN_WORDS, gram: int = GRAM):
    """(first words, reach, first window, last window) of the kept suffixes of a document."""
    roll = Rolling(text)
    if roll.n < min_words:
        return None
    at = np.arange(roll.n - gram + 1)
    grams = roll.prints(at, at + gram)
    own = owners(grams, min_words - gram + 1)
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    last = np.append(first[1:], len(own)) - 1
    return grams[own[first]], roll.prints(first, last + min_words), first, last


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.xxhash64(F.col("doc_id"), F.col("text")).alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), utf8(F.col("text")).alias("text")
    )


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, first_doc_id) of each longest stretch of repeated windows.

    A window is ``min_words`` words that stand at two places of the corpus at least.  ``first_doc_id`` is the smallest id
    of the documents that share part of the passage.
    """
    if not 1 <= gram <= min_words:
        raise ValueError("gram must lie between 1 and min_words")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, ids = np.asarray(batch.column(0)), batch.column(1)
            rows, parts = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                found = suffixes(text, min_words, gram)
                if found:
                    rows.append(np.full(len(found[0]), i))
                    parts.append(found)
            if rows:
                rows = np.concatenate(rows)
                g, reach, a, b = (np.concatenate([p[k] for p in parts]) for k in range(4))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), pa.array(reach.view(np.int64)), pa.array(uids[rows]), ids.take(pa.array(rows)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))],
                    names=["g", "reach", "uid", "doc_id", "a", "b"],
                )

    sparse = stored(_read(docs).mapInArrow(keep, "g bigint, reach bigint, uid bigint, doc_id bigint, a int, b int"))
    # neighbours that begin alike
    alike = stored(sparse.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("g").alias("h")))
    kept = stored(sparse.join(alike, F.col("g") == F.col("h")).drop("h"))
    # neighbours that are the same over their whole reach
    place = F.struct("uid", "a", "b")
    reaches = stored(
        kept.groupBy("g", "reach").agg(F.min(place).alias("one"), F.max(place).alias("other"), F.min("doc_id").alias("least"))
    )
    mixed = reaches.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("g").alias("h"))
    parting = reaches.join(mixed, F.col("g") == F.col("h")).select("reach", "one", "least")
    hosts = parting.groupBy(F.col("one.uid").alias("host")).agg(
        F.collect_list(F.struct("reach", F.col("one.a").alias("a"), F.col("one.b").alias("b"), "least")).alias("runs")
    )

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                roll = Rolling(text)
                a = np.array([r["a"] for r in runs])
                n = np.array([r["b"] for r in runs]) - a + 1
                which = np.repeat(np.arange(len(runs)), n)
                offset = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                start = a[which] + offset
                reach = np.array([r["reach"] for r in runs], dtype=np.int64)[which]
                least = pa.array([r["least"] for r in runs], pa.int64()).take(pa.array(which))
                out.append((roll.prints(start, start + min_words).view(np.int64), reach, offset.astype(np.int32), least))
            if out:
                w, reach, offset = (np.concatenate([o[k] for o in out]) for k in range(3))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w), pa.array(reach), pa.array(offset), pa.concat_arrays([o[3] for o in out])], names=["w", "reach", "offset", "least"]
                )

    windows = stored(
        _read(docs)
        .join(hosts, F.col("uid") == F.col("host"))
        .dropDuplicates(["uid"])
        .select("text", "runs")
        .mapInArrow(extend, "w bigint, reach bigint, offset int, least bigint")
    )
    spot = F.struct("reach", "offset")
    again = stored(
        windows.groupBy(F.col("w").alias("v")).agg(F.min(spot).alias("one"), F.max(spot).alias("other"), F.min("least").alias("first")).where("one <> other").select("v", "first")
    )
    parts = windows.join(again, F.col("w") == F.col("v")).groupBy(F.col("reach").alias("r")).agg(F.collect_list(F.struct("offset", "first")).alias("some"))
    whole = reaches.where("one <> other").select(F.col("reach").alias("q"), F.col("least"))
    found = kept.join(whole, F.col("reach") == F.col("q"), "left").join(parts, F.col("reach") == F.col("r"), "left")
    windows_of = F.when(
        F.col("q").isNotNull(), F.array(F.struct(F.col("a").alias("start"), F.col("b").alias("stop"), F.col("least").alias("first")))
    ).otherwise(F.array().cast("array<struct<start:int,stop:int,first:bigint>>"))
    singles = F.transform(
        F.coalesce("some", F.array().cast("array<struct<offset:int,first:bigint>>")),
        lambda s: F.struct((F.col("a") + s["offset"]).alias("start"), (F.col("a") + s["offset"]).alias("stop"), s["first"].alias("first")),
    )
    spans = found.select("uid", "doc_id", F.explode(F.concat(windows_of, singles)).alias("s")).select(
        "uid", "doc_id", F.col("s.start").alias("start"), (F.col("s.stop") + min_words).alias("stop"), F.col("s.first").alias("first")
    )
    spans = spans.distinct()
    # within a document: a passage begins where no earlier window reaches
    before = Window.partitionBy("uid").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("uid").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    opened = spans.withColumn("new", (F.col("start") > F.coalesce(F.max("stop").over(before), F.lit(-1))).cast("int"))
    return (
        opened.withColumn("passage", F.sum("new").over(upto))
        .groupBy("uid", "doc_id", "passage")
        .agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.min("first").alias("first_doc_id"))
        .select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id")
    )
