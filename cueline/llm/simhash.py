"""Near-duplicates by SimHash: a byte-position inverted index with count filtering.

Two fingerprints that differ in at most d of 64 bits differ in at most d of their 8 bytes, so they
share at least 8 - d bytes in place.  The lists of one byte position would hold 1/256 of all
fingerprints, so the index is kept under combinations of positions: of any four shared positions three
form a combination of a Turan system, and such a list holds one in 2^24.  Inside a list the shared positional bytes of
a pair are tallied, pairs below the guaranteed minimum are passed over, and the others are verified bit by bit.

Equal fingerprints are one entry.  A list gives a spanning forest of its links, found by a search that
leaves out what it has reached: components stay whole, and a dense group gives as many
rows as it has members, not pairs.

Null texts are empty; texts without words have fingerprint zero and link like others.  Null ids never are a
component's id unless all its ids are null.  An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.llm.common import stored, utf8
from cueline.llm.components import components

#: Words in a shingle, the seed of its hash, and the bits in which linked fingerprints may differ.
SHINGLE, SEED, BITS = 4, 42, 4
#: Shingles tallied at once.
BLOCK = 1 << 16


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The hash of every shingle of a UTF-8 text; fewer words are one shingle, no words none."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()  # on bytes both look at ASCII alone
    if not found:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(found)
    if len(found) <= shingle:
        return np.array([xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(found) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, len(found) - shingle + 1)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The SimHash of a text's shingle hashes; a bit is set if it is set in over half of them."""
    if not len(hashes):
        return 0
    tally = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        tally += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(tally * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8(F.col("text")).alias("text")).mapInArrow(
        each, "doc_id bigint, fp bigint"
    )


def position_sets(bits: int) -> list[tuple[int, ...]]:
    """Byte positions whose combinations every linked pair shares at least one of.

    For up to four differing bits: Turan's system of triples over three classes of positions, of which every four
    positions hold one.  In general any ``8 - bits`` positions.
    """
    if bits != 4:
        return list(combinations(range(8), max(1, 8 - bits)))
    kind = [0, 0, 0, 1, 1, 1, 2, 2]
    found = []
    for three in combinations(range(8), 3):
        n = [sum(kind[p] == k for p in three) for k in range(3)]
        if 3 in n or any(n[k] == 2 and n[(k + 1) % 3] == 1 for k in range(3)):
            found.append(three)
    return found


def _posting(fp: Column, positions: tuple[int, ...], number: int) -> Column:
    mask = sum(0xFF << (8 * p) for p in positions)
    signed = mask - (1 << 64) if mask >> 63 else mask
    return F.struct(F.lit(number).cast("int").alias("set"), fp.bitwiseAND(F.lit(signed).cast("bigint")).alias("bytes"))


def forest(fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct fingerprints of one list."""
    parents, children = [], []
    left = np.sort(fps)
    while len(left):
        front, left = left[:1], left[1:]
        root = front[0]
        while len(front) and len(left):
            reached = np.zeros(len(left), dtype=bool)
            for f in front:
                apart = left ^ f
                shared = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
                near = np.flatnonzero((shared >= 8 - bits) & ~reached)
                near = near[np.bitwise_count(apart[near]) <= bits]
                reached[near] = True
                if reached.all():
                    break
            front, left = left[reached], left[~reached]
            parents.append(np.full(len(front), root, dtype=np.uint64))
            children.append(front)
    if not parents:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(parents), np.concatenate(children)


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): edges that connect exactly the components of the fingerprints ``fp``."""
    postings = F.array(*[_posting(F.col("fp"), p, i) for i, p in enumerate(position_sets(bits))])
    listed = distinct.select(F.explode(postings).alias("p"), "fp").select("p.set", "p.bytes", "fp")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = kept = fps = None  # the list that may go on in the next batch

        def finish(s: np.ndarray, k: np.ndarray, f: np.ndarray):
            starts = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (k[1:] != k[:-1]))))
            ends = np.append(starts[1:], len(f))
            many = np.flatnonzero(ends - starts > 1)
            found = [forest(f[starts[i] : ends[i]], bits) for i in many]
            a = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.uint64)
            b = np.concatenate([x for _, x in found]) if found else np.empty(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            s, k, f = (np.asarray(batch.column(i)) for i in range(3))
            f = f.view(np.uint64)
            if sets is not None:
                s, k, f = np.concatenate((sets, s)), np.concatenate((kept, k)), np.concatenate((fps, f))
            if not len(f):
                continue
            last = np.flatnonzero((s != s[-1]) | (k != k[-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield finish(s[:cut], k[:cut], f[:cut])
            sets, kept, fps = s[cut:], k[cut:], f[cut:]
        if fps is not None and len(fps):
            yield finish(sets, kept, fps)

    return (
        listed.repartition("set", "bytes")
        .sortWithinPartitions("set", "bytes")
        .select("set", "bytes", "fp")
        .mapInArrow(each, "a bigint, b bigint")
        .distinct()
    )


def rooted(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, root): every distinct fingerprint and the one that names its component."""
    found = components(links(fps, bits))
    return fps.join(found, fps["fp"] == found["node"], "left").select(fps["fp"], F.coalesce("root", fps["fp"]).alias("root"))


def near_components(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id among the documents reachable by links."""
    marked = stored(fingerprints(docs, shingle))
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    grouped = stored(distinct.join(rooted(distinct.select("fp"), bits), "fp"))
    firsts = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(firsts, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def near_deduplicated(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component, that with the smallest id, with the columns it came with."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = stored(docs.select(row.alias("row"), F.monotonically_increasing_id().alias("uid")))
    marked = stored(
        fingerprints(kept.select(F.col("uid").alias("doc_id"), F.col("row.text").alias("text")), shingle).withColumnRenamed("doc_id", "uid")
    )
    named = marked.join(kept.select("uid", F.col("row.doc_id").cast("bigint").alias("doc_id")), "uid")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid")).alias("least")
    distinct = stored(named.groupBy("fp").agg(least))
    grouped = distinct.join(rooted(distinct.select("fp"), bits), "fp")
    stays = grouped.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.uid").alias("uid"))
    return kept.join(stays, "uid", "left_semi").select("row.*")


def simhash_components(docs: DataFrame) -> DataFrame:
    """The digest rows of the near-duplicate query."""
    return near_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
