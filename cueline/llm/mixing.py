"""Mixing sources to target weights by fitting a subset sum to each source's budget.

Documents are counted by source and exact length.  A source's target is met by whole
passes over it, and the rest by documents chosen by length: a fixed share of each length first, then
longer lengths down to a small window, and what is left by a bounded knapsack over the lengths.  If that stays
short, as with few long documents, the knapsack runs over the whole rest behind the shares, and over the whole budget.
Only the histogram of a source, with a row for each distinct length, meets in one task; the
documents of a length are then taken in the order of a seeded hash.

Null texts have no words.  A null source is a source, last in order.  Documents without words count
like others and take no words.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueline.llm.common import dealt_rank, null_safe_join, stored, word_count

#: Weights of the sources in order, repeating, and the most a source may be repeated.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Words that the longer lengths leave to the knapsack.
WINDOW = 8192
#: Bits that a knapsack may hold; a larger one counts in units of several words first.
BITS = 1 << 29


def knapsack(sizes: list[int], spare: list[int], room: int) -> dict[int, int]:
    """How many of each size to take so that the sum is the largest that is at most ``room``."""
    mask = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for size, most in zip(sizes, spare, strict=True):
        most, bundle = min(most, room // size if size else 0), 1
        while most > 0:
            part = min(bundle, most)
            layers.append((reach, size, part))
            reach |= (reach << (size * part)) & mask
            most, bundle = most - part, bundle * 2
        if reach >> room & 1:
            break
    sum_, taken = reach.bit_length() - 1, {}
    for before, size, part in reversed(layers):
        if not before >> sum_ & 1:
            taken[size] = taken.get(size, 0) + part
            sum_ -= size * part
    return taken


def subset(sizes: np.ndarray, spare: np.ndarray, room: int) -> np.ndarray:
    """How many of each size to take for the largest sum up to ``room``.

    Exact while a bit for every sum and layer fits into ``BITS``.  Beyond, sizes are rounded up to a unit,
    so each document taken wastes less than one; what that leaves is fitted again, in smaller units.
    """
    taken = np.zeros(len(sizes), dtype=np.int64)
    while True:
        usable = np.flatnonzero((sizes > 0) & (sizes <= room) & (spare > taken))
        if not len(usable):
            return taken
        usable = usable[np.argsort(sizes[usable], kind="stable")]
        most = np.minimum(spare[usable] - taken[usable], room // sizes[usable])
        layers = sum(int(n).bit_length() for n in most)
        unit = max(1, -(-room * layers // BITS))
        units = -(-sizes[usable] // unit)
        # lengths of as many units are one; the longest of them are taken first
        whole, place = np.unique(units, return_inverse=True)
        chosen = knapsack(whole.tolist(), np.bincount(place, weights=most).astype(np.int64).tolist(), room // unit)
        if not chosen:  # with units only: a length just under the room
            chosen = {int(units[-1]): 1}
        for i, n, u in zip(usable[::-1], most[::-1], units[::-1], strict=True):
            part = min(int(n), chosen.get(int(u), 0))
            if part:
                taken[i] += part
                chosen[int(u)] -= part
                room -= part * int(sizes[i])
        if unit == 1:
            return taken


def fit(sizes: np.ndarray, counts: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """Whole passes over a source, and how many documents of each length go once more."""
    extra = np.zeros(len(sizes), dtype=np.int64)
    total = int((sizes * counts).sum())
    if total == 0:
        return 0, extra
    passes = min(MOST, int(target // total))
    goal = min(round(target - passes * total), total) if passes < MOST else 0
    if goal <= 0:
        return passes, extra
    shares = np.array([int(c) * goal // total for c in counts], dtype=np.int64)
    extra = shares.copy()
    left = goal - int((sizes * extra).sum())
    for i in np.argsort(-sizes, kind="stable"):
        if left <= WINDOW:
            break
        if sizes[i] > 0:
            more = min(int(counts[i] - extra[i]), (left - WINDOW // 2) // int(sizes[i]))
            if more > 0:
                extra[i] += more
                left -= more * int(sizes[i])
    extra += subset(sizes, counts - extra, left)
    for base in (shares, np.zeros_like(shares)):
        best = int((sizes * extra).sum())
        if best == goal:
            break
        other = base + subset(sizes, counts - base, goal - int((sizes * base).sum()))
        if int((sizes * other).sum()) > best:
            extra = other
    return passes, extra


def source_targets(sources: DataFrame) -> DataFrame:
    """Adds ``target``: the shares by weight, stopped at three times the size, the excess reshared.

    ``sources`` has one row a source (source, source_size).  Filled in the order of cap over weight,
    a source is stopped while the level reached by the others lies above its cap.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    weighed = sources.withColumn("weight", F.get(weights, (place - 1) % len(WEIGHTS)))
    cap = F.col("source_size") * float(MOST)
    everything = Window.partitionBy()
    before = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    filled = weighed.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= cap)
    # the first source below its cap sets the level of all that follow
    ordered = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, 0)
    final = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(ordered)
    return filled.withColumn("target", F.coalesce(F.least(final * F.col("weight"), cap), cap)).select("source", "source_size", "target")


def planned(docs: DataFrame, carry: list[str], seed: int = 3) -> DataFrame:
    """(row, size, source_size, target, times): the columns to carry, and how often the mix takes the document."""
    size = word_count(F.col("text")).cast("bigint")
    # written, since it is read three times and the words of all texts need counting only once
    sized = stored(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), "source", size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("order")
        )
    )
    facts = stored(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = facts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sources)

    def plan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size", ignore_index=True)
        passes, extra = fit(frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64), float(frame["target"].iloc[0]))
        return frame.assign(passes=passes, extra=extra)

    plans = null_safe_join(facts, targets, ["source"]).groupBy("source").applyInPandas(
        plan, "source string, size bigint, n bigint, source_size bigint, target double, passes bigint, extra bigint"
    )
    met = null_safe_join(sized, stored(plans), ["source", "size"])
    # only lengths of which some are taken need an order
    some = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    ranked = dealt_rank(met.where(some), ["source", "size"], "n", [F.col("order")], "rank")
    chosen = ranked.withColumn("times", F.col("passes") + (F.col("rank") < F.col("extra")).cast("bigint"))
    rest = met.where(~some).withColumn("times", F.col("passes") + (F.col("extra") > 0).cast("bigint"))
    columns = ["row", "size", "source_size", "target", "times"]
    return chosen.select(*columns).unionByName(rest.select(*columns))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The digest rows of the mixing query."""
    return planned(docs, ["doc_id"]).select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix with the columns they came with, each as often as it is taken."""
    taken = planned(docs, docs.columns).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")).alias("copy")).select("row.*")
