"""Near copies by the Jaccard similarity of their sets of word shingles, verified on the texts.

Two texts are linked if their sets of 5-word shingles have a similarity of 0.8 or more.  A text of
fewer words is one shingle.  Equal sets are one entry.  Candidates come from three sources, each of which passes over what is
linked already:

* fingerprints of the byte-position index of ``simhash``, up to 4 bits apart;
* MinHash buckets: the smallest hashes of one band, under seeded multipliers.  A pair at 0.8 shares none of the 25 bands
  with a chance of 5 in 100 000; above that the chance falls quickly.  In a bucket all entries are compared with the smallest, so a group of
  copies gives as many pairs as it has members; those that stay apart are compared with a second one;
* for the entries of buckets that are open after that, a prefix-filtered join, which is exact: the shingles of each are put in order
  of rising frequency, and a pair at 0.8 shares one of the first fifth of both.  What many texts share comes last, so
  texts with much in common that are not alike meet in no pair.  Sizes too far apart, and places too late for the overlap that is
  needed, are part of the join key or of its condition.

Null texts are empty; texts without words are copies of each other.  Null ids are the least only among null ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.llm.common import stored, utf8
from cueline.llm.components import components
from cueline.llm.simhash import fingerprint_of, links, shingle_hashes

#: Words in a shingle, the least similarity of a link, bands and the hashes in each, the seed of the multipliers.
SHINGLE, LEAST, BANDS, ROWS, SEED = 5, 0.8, 25, 5, 42
#: Shingles hashed at once, entries of a bucket that the others are compared with, and the ratio of neighbouring classes of set sizes.
BLOCK, LEADERS, CLASS_RATIO = 4096, 2, 1.05

_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct shingle hashes of a UTF-8 text, in order; none without words."""
    return np.unique(shingle_hashes(text, SHINGLE))


def buckets(hashes: np.ndarray) -> list[int]:
    """One signed long for each band."""
    from xxhash import xxh64_intdigest

    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[None, i : i + BLOCK] * _MULTIPLIERS[:, None]).min(axis=1), out=least)
    found = [xxh64_intdigest(band.tobytes(), place) for place, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(found, dtype=np.uint64).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, each in order and without repeats, are at ``LEAST`` or above."""
    if min(len(a), len(b)) < LEAST * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    # in whole numbers: 0.8 is 4 in 5
    return 5 * common >= 4 * (len(a) + len(b) - common)


def sketches(texts: DataFrame) -> DataFrame:
    """(uid, key, fp, buckets) of (uid, text): a hash of the shingle set, the fingerprint, and the buckets."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            keys, fps, lists = [], [], []
            for text in batch.column(1).to_pylist():
                # hashing the shingles takes most of the time, so the fingerprint and the set share it
                every = shingle_hashes(text, SHINGLE)
                hashes = np.unique(every)
                keys.append(xxh64_intdigest(hashes.tobytes(), SEED))
                fps.append(fingerprint_of(every))
                lists.append(buckets(hashes) if len(hashes) else [])
            longs = [pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in (keys, fps)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(lists, pa.list_(pa.int64()))], names=["uid", "key", "fp", "buckets"])

    return texts.select("uid", utf8(F.col("text")).alias("text")).mapInArrow(each, "uid bigint, key bigint, fp bigint, buckets array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose texts, of ``texts`` (key, text), are similar."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # the first of a pair often is that of the pair before
        for batch in batches:
            met = []
            for one, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if one != last:
                    last, held = one, shingle_set(one)
                met.append(similar(held, shingle_set(other)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(met, pa.bool_()))

    other = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("other")), "b")
    both = other.join(texts.select(F.col("key").alias("a"), F.col("text").alias("one")), "a")
    return both.select("a", "b", "one", "other").mapInArrow(each, "a bigint, b bigint")


def fingerprint_pairs(marked: DataFrame) -> DataFrame:
    """Pairs (a, b) of the keys of ``marked`` (key, fp): each fingerprint's first key with its others, and first keys of linked ones."""
    firsts = stored(marked.groupBy("fp").agg(F.min("key").alias("first")))
    own = marked.join(firsts, "fp").select(F.col("first").alias("a"), F.col("key").alias("b"))
    across = (
        links(firsts.select("fp"))
        .join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a")
        .join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    )
    return own.unionByName(across).where("a < b").distinct()


def prefix_pairs(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``entries`` (key, root) with different roots that may be similar; none that are similar lack.

    With sizes n >= m, similarity 0.8 asks for ceil(4 (n + m) / 9) shingles in common.  In any one order of all shingles the
    first common one stands so early in both that as many can follow: in the first fifth of the larger set, in the first ninth of the smaller.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t) for t in batch.column(2).to_pylist()]
            lists = pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["key", "root", "shingles"])

    own = entries.join(texts, "key").select("key", "root", "text").mapInArrow(each, "key bigint, root bigint, shingles array<bigint>")
    listed = stored(own.select("key", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("h")))
    often = listed.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # shingles of one text alone come first and meet nothing; only the place behind them counts
    held = Window.partitionBy("key")
    place = F.col("n") - F.count(F.lit(1)).over(held) + F.row_number().over(held.orderBy("df", "h")) - 1
    early = listed.join(often, "h").withColumn("p", place.cast("int")).where("5 * p <= n")
    posted = stored(early.select("h", "key", "root", "n", "p"))

    def size_class(n: Column) -> Column:
        return F.floor(F.log(n.cast("double")) / F.lit(float(np.log(CLASS_RATIO)))).cast("int")

    least, most = F.ceil(F.col("n") * 4 / 5), F.least(F.col("n"), F.floor((F.col("n") - F.col("p")) * 9 / 4) - F.col("n"))
    larger = posted.where(most >= least).select(
        "h", F.explode(F.sequence(size_class(least), size_class(most))).alias("c"), F.struct("n", "key", "root", "p").alias("l")
    )
    smaller = posted.where("9 * p <= n").select("h", size_class(F.col("n")).alias("c"), F.struct("n", "key", "root", "p").alias("s"))
    need = F.col("l.n") + F.col("s.n")
    follows = (9 * (F.col("l.n") - F.col("l.p")) >= 4 * need) & (9 * (F.col("s.n") - F.col("s.p")) >= 4 * need)
    order = F.struct("l.n", "l.key") > F.struct("s.n", "s.key")
    met = larger.join(
        smaller,
        (larger["h"] == smaller["h"]) & (larger["c"] == smaller["c"]) & (F.col("l.root") != F.col("s.root")) & order & follows & (5 * F.col("s.n") >= 4 * F.col("l.n")),
    )
    return met.select(F.least("l.key", "s.key").alias("a"), F.greatest("l.key", "s.key").alias("b")).distinct()


def linked(pairs: DataFrame, postings: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) for every linked key.

    ``pairs`` (a, b) are the candidates by fingerprint, ``postings`` (bucket, key) lists buckets of two or more keys,
    ``texts`` (key, text) the texts of the keys in both.
    """
    edges = stored(verified(pairs, texts))
    roots = stored(components(edges))

    def opened(rows: DataFrame) -> DataFrame:
        """Rows (bucket, key) of buckets in which not all are joined, with their roots."""
        named = stored(
            rows.join(roots, rows["key"] == roots["node"], "left").select("bucket", "key", F.coalesce(roots["root"], rows["key"]).alias("root"))
        )
        open_ = named.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
        return stored(named.join(open_.select("bucket"), "bucket", "left_semi"))

    left = opened(postings)
    for turn in range(LEADERS + 1):
        if turn < LEADERS:
            first = left.groupBy("bucket").agg(F.min(F.struct("key", "root")).alias("f"))
            met = left.join(first, "bucket").where("key > f.key AND root <> f.root").select(F.col("f.key").alias("a"), F.col("key").alias("b")).distinct()
        else:
            met = prefix_pairs(left.select("key", "root").distinct(), texts)
        edges = edges.unionByName(stored(verified(stored(met), texts)))
        roots = stored(components(edges))
        if turn < LEADERS:
            # the first has been compared with all; a bucket whose entries are joined is done
            rest = left.join(first.select("bucket", F.col("f.key").alias("done")), "bucket").where("key <> done")
            left = opened(rest.select("bucket", "key"))
    return roots


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of linked texts, that with the smallest id, with the columns it came with."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = stored(docs.select(row.alias("row"), F.monotonically_increasing_id().alias("uid")))
    marked = stored(sketches(kept.select("uid", F.col("row.text").alias("text"))))
    named = marked.join(kept.select("uid", F.col("row.doc_id").cast("bigint").alias("doc_id")), "uid")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid")).alias("least")
    distinct = stored(named.groupBy("key").agg(least))
    firsts = stored(marked.join(distinct.select(F.col("least.uid").alias("uid")), "uid", "left_semi"))
    listed = firsts.select("key", F.explode("buckets").alias("bucket"))
    shared = listed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    postings = stored(listed.join(shared, "bucket", "left_semi"))
    pairs = stored(fingerprint_pairs(firsts.where(F.size("buckets") > 0).select("key", "fp")))
    met = postings.select("key").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("key"))).distinct()
    wanted = distinct.join(met, "key", "left_semi").select("key", F.col("least.uid").alias("uid"))
    texts = stored(kept.select("uid", utf8(F.col("row.text")).alias("text")).join(wanted, "uid").select("key", "text"))
    found = linked(pairs, postings, texts)
    grouped = distinct.join(found, distinct["key"] == found["node"], "left").select(F.coalesce("root", "key").alias("root"), "least")
    stays = grouped.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.uid").alias("uid"))
    return kept.join(stays, "uid", "left_semi").select("row.*")
