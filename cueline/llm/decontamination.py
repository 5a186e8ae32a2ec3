"""Benchmark decontamination: a BM25 inverted index of test items, queried by block-max WAND.

The index holds the items, and every passage of every training document is a query.  Term weights are
divided by the item's own score, so a passage's score is the share of an item's BM25 mass that it
holds and one threshold serves items of any length.  A passage goes to the index only if its terms'
largest weights, over all items and then over some span of neighbouring items, can reach the
threshold; block-max WAND then returns every item at or above it.
A candidate is verified by the runs of words that passage and item share, for the
question (all but the last line) and the answer (the last line) apart.  An edited item breaks runs,
above all in a short part, so one that fails is aligned with the passage word by word, in order: it
is held if some stretch of the passage holds ``OVERLAP`` of both parts together and ``PART`` of each.
A question without its answer is not held.

Items are dealt to shards of bounded size by a hash, with document frequencies counted over all of them;
only a shard's items are gathered and broadcast, and there are as many shards as the items need.
Passages are two strides long, a stride is no shorter than the stretch in which the longest item is
looked for, so that a copied or edited item lies in one passage whole.

Null and blank items match nothing; null and blank texts hold nothing.  Equal items are found each.
An empty table on either side gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.llm.common import stored, utf8

#: BM25's parameters, the share of an item's score to be retrieved, the overlap that verifies, and that of each part of an edited item.
K1, B, SHARE, OVERLAP, PART = 1.2, 0.75, 0.7, 0.8, 0.5
#: Words of a verified run, postings in a block, least stride in words, and words of items in a shard.
RUN, BLOCK, STRIDE, SHARD_WORDS = 5, 64, 64, 1_000_000
#: Items in a span of the first bound, and the cells that its table has at most.
SPAN, SPAN_CELLS = 4, 1 << 24

#: ASCII in lower case, all but letters and digits as spaces; other bytes stay.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def stretch(words: int) -> int:
    """Words of the stretch in which an edited item of so many words is looked for."""
    return words + max(RUN, words // 4)


class Index:
    """Postings by term, in blocks with their largest weight."""

    def __init__(self, items: list[tuple[int, bytes]], frequency: dict[bytes, int], total: int, mean: float):
        # neighbours use the same common words and are of like length, so that blocks bound closely
        items = sorted(items, key=lambda x: (max(plain_words(x[1]), key=lambda w: (frequency[w], w)), len(x[1]), x[0], x[1]))
        self.ids = [i for i, _ in items]
        self.parts = []
        lists: dict[bytes, list[tuple[int, float]]] = {}
        longest = 1
        for number, (_, text) in enumerate(items):
            head, _, tail = text.rstrip().rpartition(b"\n")
            question, answer = plain_words(head), plain_words(tail)
            if not question:
                question, answer = answer, []
            self.parts.append((question, answer))
            found = question + answer
            longest = max(longest, len(found))
            counts: dict[bytes, int] = {}
            for w in found:
                counts[w] = counts.get(w, 0) + 1
            weights = {}
            for w, tf in counts.items():
                idf = math.log(1 + (total - frequency[w] + 0.5) / (frequency[w] + 0.5))
                weights[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(found) / mean))
            own = sum(weights.values())
            for w, x in weights.items():
                lists.setdefault(w, []).append((number, x / own))
        self.stride = max(STRIDE, stretch(longest))
        self.terms = {w: i for i, w in enumerate(lists)}
        self.items = [np.array([n for n, _ in postings], dtype=np.int64) for postings in lists.values()]
        self.weights = [np.array([x for _, x in postings]) for postings in lists.values()]
        self.most = np.array([x.max() for x in self.weights])
        # the same bound by neighbouring items, for all terms at once; wider blocks where items and terms are many
        span = max(SPAN, math.ceil(len(items) * len(lists) / SPAN_CELLS))
        self.span_most = np.zeros((len(lists), math.ceil(len(items) / span)), dtype=np.float32)
        for term, (numbers, weights) in enumerate(zip(self.items, self.weights, strict=True)):
            np.maximum.at(self.span_most[term], numbers // span, weights.astype(np.float32))
        self.block_most = [np.maximum.reduceat(x, np.arange(0, len(x), BLOCK)) for x in self.weights]
        self.block_last = [x[np.minimum(np.arange(BLOCK - 1, len(x) + BLOCK - 1, BLOCK), len(x) - 1)] for x in self.items]

    def search(self, terms: list[int], share: float) -> list[tuple[int, float]]:
        """Every item whose weights over ``terms`` sum to ``share`` or more, by block-max WAND."""
        slack = share - 1e-9
        at = {t: 0 for t in terms}
        current = {t: int(self.items[t][0]) for t in terms}
        found = []
        while current:
            order = sorted(current, key=current.__getitem__)
            bound, pivot = 0.0, None
            for place, t in enumerate(order):
                bound += self.most[t]
                if bound >= slack:
                    pivot = place
                    break
            if pivot is None:
                break
            item = current[order[pivot]]
            while pivot + 1 < len(order) and current[order[pivot + 1]] == item:
                pivot += 1
            # the pivot's blocks bound the score more closely
            bound, reach = 0.0, None
            for t in order[: pivot + 1]:
                block = int(self.block_last[t].searchsorted(item))
                if block < len(self.block_last[t]):
                    bound += self.block_most[t][block]
                    last = int(self.block_last[t][block])
                    reach = last if reach is None else min(reach, last)
            if bound >= slack:
                if current[order[0]] == item:
                    score = sum(self.weights[t][at[t]] for t in order[: pivot + 1])
                    if score >= slack:
                        found.append((item, float(score)))
                    goal = item + 1
                else:
                    goal = item
            else:
                goal = (reach if reach is not None else item) + 1
                if pivot + 1 < len(order):
                    goal = min(goal, current[order[pivot + 1]])
                goal = max(goal, item + 1) if goal <= item else goal
            for t in order[: pivot + 1]:
                if current[t] < goal:
                    at[t] += int(self.items[t][at[t] :].searchsorted(goal))
                    if at[t] < len(self.items[t]):
                        current[t] = int(self.items[t][at[t]])
                    else:
                        del current[t]
        return found


def run_overlap(part: list[bytes], passage: list[bytes], run: int = RUN) -> float:
    """The share of a part's words that lie in runs of ``run`` words also found in the passage."""
    if not part:
        return 1.0
    n = min(run, len(part))
    there = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
    held = np.zeros(len(part), dtype=bool)
    for i in range(len(part) - n + 1):
        if tuple(part[i : i + n]) in there:
            held[i : i + n] = True
    return float(held.mean())


def aligned_overlap(question: list[bytes], answer: list[bytes], passage: list[bytes], overlap: float) -> tuple[float, float]:
    """The shares of question and answer that the best stretch of the passage holds in the item's order.

    The answer's share is what it adds to the longest common subsequence of question and stretch.  Both are 0 if no
    stretch has ``overlap`` of the item's words.
    """
    item = question + answer
    masks: dict[bytes, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    found = [masks.get(w, 0) for w in passage]
    known = np.array([m > 0 for m in found])
    wide, need = stretch(len(item)), math.ceil(overlap * len(item) - 1e-9)
    upto = np.concatenate(([0], np.cumsum(known)))
    there = upto[np.minimum(np.arange(len(found)) + wide, len(found))] - upto[:-1]
    every, head = (1 << len(item)) - 1, (1 << len(question)) - 1
    best, shares = need - 1, (0.0, 0.0)
    for start in np.flatnonzero(known & (there >= need)).tolist():
        # bit i of ``free`` is clear where word i of the item lengthens the subsequence
        free = every
        for m in found[start : start + wide]:
            if m:
                took = free & m
                free = ((free + took) | (free - took)) & every
        total = len(item) - free.bit_count()
        if total > best:
            asked = len(question) - (free & head).bit_count()
            best, shares = total, (asked / len(question), (total - asked) / len(answer) if answer else 1.0)
    return shares


def match(index: Index, text: bytes, share: float, overlap: float) -> list[tuple[int, float, float, float]]:
    """(item, score, question overlap, answer overlap) of the items that a document holds."""
    found = plain_words(text)
    if not found:
        return []
    get, stride = index.terms.get, index.stride
    ids = np.fromiter((get(w, -1) for w in found), np.int64, len(found))
    where = np.flatnonzero(ids >= 0)
    if not len(where):
        return []
    n_terms = len(index.terms)
    blocks = where // stride
    last = max(0, (len(found) - 1) // stride - 1)
    keys = np.unique(np.concatenate((np.minimum(blocks, last) * n_terms + ids[where], np.clip(blocks - 1, 0, last) * n_terms + ids[where])))
    passages, terms = keys // n_terms, keys % n_terms
    bound = np.bincount(passages, weights=index.most[terms], minlength=last + 1)
    best: dict[int, tuple[float, float, float]] = {}
    for p in np.flatnonzero(bound >= share - 1e-9).tolist():
        own = terms[np.searchsorted(passages, p) : np.searchsorted(passages, p, side="right")]
        if index.span_most[own].sum(axis=0).max() < share - 1e-4:
            continue
        passage = found[p * stride : (p + 2) * stride]
        for item, score in index.search(own.tolist(), share):
            if score <= best.get(item, (0.0,))[0]:
                continue
            question, answer = (run_overlap(part, passage) for part in index.parts[item])
            if question < overlap or answer < overlap:
                question, answer = aligned_overlap(*index.parts[item], passage, overlap)
                if question < PART or answer < PART:
                    continue
            best[item] = (score, question, answer)
    return [(item, *x) for item, x in best.items()]


def contaminations(docs: DataFrame, items: DataFrame, share: float = SHARE, overlap: float = OVERLAP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every verified match."""
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"

    def item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([plain_words(t) for t in batch.column(1).to_pylist()], pa.list_(pa.binary()))],
                names=["item_id", "text", "words"],
            )

    read = stored(
        items.select(F.col("item_id").cast("bigint").alias("item_id"), utf8(F.col("text")).alias("text")).mapInArrow(
            item_words, "item_id bigint, text binary, words array<binary>"
        ).where("size(words) > 0")
    )
    total, mean, all_words = read.agg(F.count(F.lit(1)), F.avg(F.size("words")), F.sum(F.size("words"))).first()
    if not total:
        return spark.createDataFrame([], schema)
    shards = math.ceil(all_words / shard_words)
    dealt = read.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    frequency = stored(read.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    queried = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8(F.col("text")).alias("text"))
    results = None
    for shard in range(shards):
        own = dealt.where(F.col("shard") == shard)
        # bounded by shard_words: the items of one shard, and the frequencies of their words
        rows = [(r.item_id, bytes(r.text)) for r in own.select("item_id", "text").collect()]
        if not rows:
            continue
        used = own.select(F.explode("words").alias("word")).distinct()
        counts = {bytes(r.word): r.n for r in frequency.join(used, "word", "left_semi").collect()}
        sent = spark.sparkContext.broadcast(Index(rows, counts, total, float(mean)))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                out = [
                    (doc, index.ids[item], *x)
                    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                    for item, *x in match(index, text, share, overlap)
                ]
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                )

        part = queried.mapInArrow(search, schema)
        results = part if results is None else results.unionByName(part)
    return results


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with the columns they came with.

    A row is known by a 64-bit hash of its text, which alone decides: rows that share an id are judged apart.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    facts = keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))
    leaking = contaminations(facts, items).select(F.col("doc_id").alias("key")).distinct()
    return keyed.join(leaking, "key", "left_anti").select("row.*")
