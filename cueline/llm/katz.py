"""Scoring documents with a Katz back-off bigram model.

p(w | v) = d(c) c(v w) / c(v) for pairs seen in training, with Good-Turing discounts d, and else a(v) p(w), where
a(v) hands exactly the mass that the discounts freed to the words not seen after v.  p(w) is itself discounted, and what
that frees is the probability of all unknown words as one class.  So the probabilities of the
known words and the unknown class sum to one after every history.

Documents are laid down in chunks of bounded size as local word numbers, bucketed by chunk.  The distinct words of a chunk, then its
distinct pairs, go with their training counts to buckets of the hash, where the counts of all chunks are added up; the
totals are a table partitioned by bucket, and return to the chunks in the order in which they were sent.  A token is then scored inside
its chunk: pair, else history, else word, else unknown.  Pairs are dealt by history, so that a bucket holds all of a
history and can add up what backing off needs; histories that would fill a bucket alone are dealt by pair and
their sums completed afterwards.

Words are compared by 64-bit hashes, pairs by their history and bucket and 40 further bits.  Null texts are empty and consist of their end.  Learning reads the documents
whose crc32 of the id modulo 5 is not 1; without any, nothing is known and the unknown class has all mass.  An
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.llm.common import remainder, stored, utf8
from cueline.session import shared_folder

#: Tokens in a chunk, tokens for each bucket, and how many histories can be hot: those with more tokens than a bucket
#: is meant for, and more than one in ``HOT`` of all.
CHUNK_TOKENS, BUCKET_TOKENS, HOT = 1_600_000, 1_000_000, 100_000
#: Counts above this are not discounted.
TRUSTED = 5
#: Hashes of the marks before and behind a document; the start is a history only.
START, END = np.uint64(0x51A7), np.uint64(0xE4D)

_PACK = "binary"


#: Low bytes of a pair's hash that are sent: with bucket and history, which are exact, they tell pairs apart.
PAIR_BYTES = 5


def packed(values: np.ndarray, keep: int | None = None, rising: bool = False) -> bytes:
    """Little-endian values byte plane by byte plane, compressed.

    ``keep`` takes only so many low bytes; ``rising`` values are written as differences.
    """
    from zstandard import ZstdCompressor

    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return ZstdCompressor(level=1).compress(np.ascontiguousarray(raw[:, :keep].T).tobytes())


def unpacked(data: bytes, kind: str, keep: int | None = None, rising: bool = False) -> np.ndarray:
    from zstandard import ZstdDecompressor

    raw = np.frombuffer(ZstdDecompressor().decompress(data), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    planes = raw.reshape(keep or width, len(raw) // (keep or width))
    out = np.zeros((planes.shape[1], width), dtype=np.uint8)
    out[:, : keep or width] = planes.T
    values = out.view(kind).reshape(-1)
    return np.cumsum(values, dtype=values.dtype) if rising else values


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = v * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def discounts(ranks: np.ndarray) -> np.ndarray:
    """d(0..TRUSTED) from the numbers of types seen r times, ranks[r]; above that nothing is taken.

    Katz's form of Good-Turing; where the numbers of types don't allow it (a small or repetitive corpus), half a count.
    """
    d = np.ones(TRUSTED + 1)
    n1, over = float(ranks[1]), float(ranks[TRUSTED + 1])
    common = (TRUSTED + 1) * over / n1 if n1 else 1.0
    for r in range(1, TRUSTED + 1):
        d[r] = 0.0
        if ranks[r] and common < 1:
            d[r] = ((r + 1) * float(ranks[r + 1]) / (r * float(ranks[r])) - common) / (1 - common)
        if not 0 < d[r] < 1:
            d[r] = 1 - 0.5 / r
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= TRUSTED, d[np.minimum(counts, TRUSTED)], 1.0)


class Words:
    """Word probabilities of the whole training corpus."""

    def __init__(self, tokens: int, ranks: np.ndarray):
        self.tokens, self.d = tokens, discounts(ranks)
        kept = tokens - sum(r * float(ranks[r]) * (1 - self.d[r]) for r in range(1, TRUSTED + 1))
        # without discounted words one count more keeps room for the unknown
        self.total = tokens if kept < tokens else tokens + 1
        self.unknown = 1 - kept / self.total

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.d) / self.total, self.unknown)


def _chunks(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        task, number = TaskContext.get().partitionId(), 0
        ids, train, lengths, hashes, size = [], [], [], [], 0

        def flush():
            nonlocal ids, train, lengths, hashes, size, number
            words, local = np.unique(np.concatenate(hashes), return_inverse=True)
            learn = np.repeat(np.array(train, dtype=bool), lengths)
            own = np.bincount(local[learn], minlength=len(words)).astype(np.int32)
            # frequent words get small numbers, which pack well
            order = np.argsort(-np.bincount(local, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), dtype=np.int32)
            rank[order] = np.arange(len(words), dtype=np.int32)
            row = [(task << 24) + number, size, ids, packed(np.array(train, dtype=np.uint8)), packed(np.array(lengths, dtype=np.int64)), packed(rank[local]), packed(words, rising=True), packed(order.astype(np.int32)), packed(own)]
            number += 1
            ids, train, lengths, hashes, size = [], [], [], [], 0
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())] + [pa.binary()] * 6
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["chunk", "size", "ids", "train", "lengths", "tokens", "words", "order", "own"])

        for batch in batches:
            for doc, learnt, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = text.lower().split()
                ids.append(doc)
                train.append(learnt)
                lengths.append(len(found) + 1)
                hashes.append(np.append(np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found)), END))
                size += len(found) + 1
                if size >= chunk_tokens:
                    yield flush()
        if ids:
            yield flush()

    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (remainder(F.col("doc_id"), 5) != 1).alias("train"), utf8(F.col("text")).alias("text"))
    schema = "chunk bigint, size bigint, ids array<bigint>, " + ", ".join(f"{c} {_PACK}" for c in ("train", "lengths", "tokens", "words", "order", "own"))
    return read.mapInArrow(lay, schema)


def _add_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: totals of the words, returned to each chunk, and the bucket's numbers."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    if not rows:
        return
    words, counts = [unpacked(r["words"], "<u8", rising=True) for r in rows], [unpacked(r["own"], "<i4") for r in rows]
    distinct, at = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    ranks = np.bincount(np.minimum(total, TRUSTED + 2), minlength=TRUSTED + 3)
    sizes = np.cumsum([len(w) for w in words])[:-1]
    for i, (r, back) in enumerate(zip(rows, np.split(total[at], sizes), strict=True)):
        facts = [int(total.sum()), int((total > 0).sum()), ranks.tolist()] if i == 0 else [0, 0, None]
        yield pa.RecordBatch.from_pylist(
            [{"bucket": r["bucket"], "chunk": r["chunk"], "totals": packed(back), "tokens": facts[0], "types": facts[1], "ranks": facts[2]}],
            schema=pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("totals", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64()), ("ranks", pa.list_(pa.int64()))]),
        )


def _add_pairs(batches: Iterator[pa.RecordBatch], model: Words) -> Iterator[pa.RecordBatch]:
    """One bucket: totals of the pairs, and for each history its seen pairs by count and the mass of their words."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    if not rows:
        return
    histories = [unpacked(r["histories"], "<u8", rising=True) for r in rows]
    runs = [unpacked(r["runs"], "<i4") for r in rows]
    pairs = np.concatenate([unpacked(r["pairs"], "<u8", PAIR_BYTES) for r in rows])
    own = np.concatenate([unpacked(r["own"], "<i4") for r in rows])
    mass = model.p(np.concatenate([unpacked(r["counts"], "<i8") for r in rows]))
    known, at_v = np.unique(np.concatenate(histories), return_inverse=True)
    lengths = [len(h) for h in histories]
    of = np.repeat(at_v, np.concatenate(runs))
    pairs |= of.astype(np.uint64) << np.uint64(8 * PAIR_BYTES)
    distinct, first, at = np.unique(pairs, return_index=True, return_inverse=True)
    total = np.bincount(at, weights=own, minlength=len(distinct)).astype(np.int64)
    seen = total > 0
    by = of[first]
    seen_mass = np.bincount(by[seen], weights=mass[first][seen], minlength=len(known))
    few = seen & (total <= TRUSTED)
    table = np.bincount(by[few] * TRUSTED + total[few] - 1, minlength=len(known) * TRUSTED).reshape(-1, TRUSTED).astype(np.int32)
    ranks = np.bincount(np.minimum(total, TRUSTED + 2), minlength=TRUSTED + 3).tolist()
    pair_ends = np.cumsum([int(x.sum()) for x in runs])[:-1]
    back_pairs, back_v = np.split(total[at], pair_ends), np.split(at_v, np.cumsum(lengths)[:-1])
    # masses of rare histories are few different sums
    levels, codes = np.unique(seen_mass, return_inverse=True)
    hot = np.concatenate([unpacked(r["hot"], "<u1") for r in rows]).astype(bool)
    partial = np.unique(at_v[hot])
    schema = pa.schema(
        [("bucket", pa.int64()), ("chunk", pa.int64()), ("totals", pa.binary()), ("few", pa.binary()), ("levels", pa.binary()), ("mass", pa.binary()), ("ranks", pa.list_(pa.int64())), ("hot", pa.list_(pa.struct([("v", pa.int64()), ("few", pa.list_(pa.int64())), ("mass", pa.float64())])))]
    )
    for i, (r, t, v) in enumerate(zip(rows, back_pairs, back_v, strict=True)):
        parts = [{"v": int(known[k].view(np.int64)), "few": table[k].tolist(), "mass": float(seen_mass[k])} for k in partial] if i == 0 else None
        yield pa.RecordBatch.from_pylist(
            [{"bucket": r["bucket"], "chunk": r["chunk"], "totals": packed(t), "few": packed(table[v].reshape(-1)), "levels": packed(levels[own_levels := np.unique(codes[v])]), "mass": packed(np.searchsorted(own_levels, codes[v]).astype(np.int32)), "ranks": ranks if i == 0 else None, "hot": parts}],
            schema=schema,
        )


class Chunk:
    """The tokens, words and pairs of a chunk; pairs in the order in which buckets get and return them."""

    def __init__(self, row: dict, totals: list[bytes]):
        words, order = unpacked(row["words"], "<u8", rising=True), unpacked(row["order"], "<i4")
        counts = np.concatenate([unpacked(t, "<i8") for t in totals])
        self.words, self.counts = words[order], counts[order]
        self.tokens = unpacked(row["tokens"], "<i4").astype(np.int64)
        self.lengths = unpacked(row["lengths"], "<i8")
        self.train = unpacked(row["train"], "<u1").astype(bool)
        self.start = len(words)  # the local number of the mark before a document
        first = np.cumsum(self.lengths) - self.lengths
        history = np.empty_like(self.tokens)
        history[1:] = self.tokens[:-1]
        history[first] = self.start
        pair, self.pair_of = np.unique(history * self.start + self.tokens, return_inverse=True)
        self.own = np.bincount(self.pair_of[np.repeat(self.train, self.lengths)], minlength=len(pair)).astype(np.int32)
        self.v, self.w = pair // self.start, pair % self.start

    def histories(self, started: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and training counts of all histories, by local number."""
        return np.append(self.words, START), np.append(self.counts, started)

    def deal(self, buckets: int, full: int, started: int):
        """Order of the pairs by bucket, history and hash; where they belong."""
        names, counts = self.histories(started)
        names_v = names[self.v]
        pairs = pair_hash(names_v, self.words[self.w])
        hot = counts[self.v] > full
        shift = np.uint64(64 - buckets.bit_length() + 1) if buckets > 1 else None
        key = np.where(hot, pairs, pair_hash(names_v, np.uint64(7) + np.zeros_like(names_v)))
        bucket = (key >> shift).astype(np.int64) if shift is not None else np.zeros(len(key), dtype=np.int64)
        order = np.lexsort((pairs, names_v, bucket))
        return order, bucket[order], names_v[order], pairs[order], hot[order]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs in which all keys stay the same."""
    changed = np.zeros(max(0, len(keys[0]) - 1), dtype=bool)
    for k in keys:
        changed |= k[1:] != k[:-1]
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(keys[0])), dtype=bool), changed)))


def _bucket_count(tokens: int, bucket_tokens: int) -> int:
    return 1 << max(3, int(np.ceil(np.log2(max(1, tokens / bucket_tokens)))))


def _by_chunk(back: DataFrame, *columns: str) -> DataFrame:
    """The returned parts of each chunk in the order of the buckets: as many as there are buckets."""
    return back.groupBy(F.col("chunk").alias("of")).agg(F.array_sort(F.collect_list(F.struct("bucket", *columns))).alias("parts"))


def katz_scores(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    name = f"cueline_chunks_{uuid.uuid4().hex}"
    n_files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = _chunks(docs, chunk_tokens).write.bucketBy(n_files, "chunk").option("path", f"{shared_folder(spark).rstrip('/')}/{name}")
    writer.saveAsTable(name)
    chunks = spark.table(name)
    # sizes of the corpus: sums over the chunks
    facts = chunks.agg(F.sum("size"), F.count(F.lit(1))).first()
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    if not facts[1]:
        return spark.createDataFrame([], schema)
    buckets = _bucket_count(int(facts[0]), bucket_tokens)

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, own = unpacked(row["words"], "<u8", rising=True), unpacked(row["own"], "<i4")
                bucket = (words >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)
                starts = _runs(bucket)
                for a, b in zip(starts, np.append(starts[1:], len(words)), strict=True):
                    yield pa.RecordBatch.from_pylist(
                        [{"bucket": int(bucket[a]), "chunk": row["chunk"], "words": packed(words[a:b], rising=True), "own": packed(own[a:b])}],
                        schema=pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("words", pa.binary()), ("own", pa.binary())]),
                    )

    sent = chunks.select("chunk", "words", "own").mapInArrow(send_words, "bucket bigint, chunk bigint, words binary, own binary")
    words_back = stored(
        sent.groupBy("bucket").applyInArrow(
            lambda table: pa.Table.from_batches(list(_add_words(iter(table.to_batches()))), schema=_WORDS_SCHEMA),
            "bucket bigint, chunk bigint, totals binary, tokens bigint, types bigint, ranks array<bigint>",
        )
    )
    tokens, types = words_back.agg(F.sum("tokens"), F.sum("types")).first()
    model = Words(int(tokens), _ranks(words_back))
    full = max(bucket_tokens, model.tokens // HOT)
    started = spark.table(name).select(F.explode("ids").alias("d")).where(remainder(F.col("d"), 5) != 1).count()
    located = chunks.join(_by_chunk(words_back, "totals"), F.col("chunk") == F.col("of")).drop("of")

    def send_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("bucket", pa.int64()), ("chunk", pa.int64())] + [(c, pa.binary()) for c in ("histories", "runs", "hot", "pairs", "own", "counts")]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                chunk = Chunk(row, [x["totals"] for x in row["parts"]])
                order, bucket, v, pairs, hot = chunk.deal(buckets, full, started)
                own, counts = chunk.own[order], chunk.counts[chunk.w][order]
                starts = _runs(bucket)
                for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
                    new = _runs(v[a:b])
                    yield pa.RecordBatch.from_pylist(
                        [
                            {
                                "bucket": int(bucket[a]),
                                "chunk": row["chunk"],
                                "histories": packed(v[a:b][new], rising=True),
                                "runs": packed(np.diff(np.append(new, b - a)).astype(np.int32)),
                                "hot": packed(hot[a:b][new].astype(np.uint8)),
                                "pairs": packed(pairs[a:b], PAIR_BYTES),
                                "own": packed(own[a:b]),
                                "counts": packed(counts[a:b]),
                            }
                        ],
                        schema=pa.schema(kinds),
                    )

    dealt = located.mapInArrow(
        send_pairs, "bucket bigint, chunk bigint, histories binary, runs binary, hot binary, pairs binary, own binary, counts binary"
    )
    pairs_back = stored(
        dealt.groupBy("bucket").applyInArrow(
            lambda table: pa.Table.from_batches(list(_add_pairs(iter(table.to_batches()), model)), schema=_PAIRS_SCHEMA),
            "bucket bigint, chunk bigint, totals binary, few binary, levels binary, mass binary, ranks array<bigint>, hot array<struct<v:bigint,few:array<bigint>,mass:double>>",
        )
    )
    d = discounts(_ranks(pairs_back))
    hot_rows = (
        pairs_back.select(F.explode("hot").alias("h"))
        .groupBy("h.v")
        .agg(*[F.sum(F.col("h.few")[r]).alias(f"few{r}") for r in range(TRUSTED)], F.sum("h.mass").alias("mass"))
        .collect()
    )  # at most HOT histories have over one in HOT of the tokens
    hot_sums = {r["v"]: ([r[f"few{k}"] for k in range(TRUSTED)], r["mass"]) for r in hot_rows}
    ready = located.join(
        _by_chunk(pairs_back, "totals", "few", "levels", "mass").withColumnsRenamed({"of": "pof", "parts": "pair_parts"}), F.col("chunk") == F.col("pof")
    ).drop("pof")

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield _evaluated(row, model, int(types), d, hot_sums, buckets, full, started)

    return ready.mapInArrow(evaluate, schema)


def _ranks(back: DataFrame) -> np.ndarray:
    sums = back.where("ranks IS NOT NULL").agg(*[F.sum(F.col("ranks")[r]).alias(f"r{r}") for r in range(TRUSTED + 3)]).first()
    return np.array([x or 0 for x in sums], dtype=np.int64)


_WORDS_SCHEMA = pa.schema(
    [("bucket", pa.int64()), ("chunk", pa.int64()), ("totals", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64()), ("ranks", pa.list_(pa.int64()))]
)
_PAIRS_SCHEMA = pa.schema(
    [
        ("bucket", pa.int64()),
        ("chunk", pa.int64()),
        ("totals", pa.binary()),
        ("few", pa.binary()),
        ("levels", pa.binary()),
        ("mass", pa.binary()),
        ("ranks", pa.list_(pa.int64())),
        ("hot", pa.list_(pa.struct([("v", pa.int64()), ("few", pa.list_(pa.int64())), ("mass", pa.float64())]))),
    ]
)


def backed_off(few: np.ndarray, mass: np.ndarray, counts: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total, weight) of histories: what pair counts are divided by, and what unseen words get of their own probability."""
    freed = (few * np.arange(1, TRUSTED + 1) * (1 - d[1:])).sum(axis=1)
    # nothing freed: one count more makes room for the unseen
    total = np.where(freed > 0, counts, counts + 1).astype(float)
    freed = np.where(freed > 0, freed, 1.0)
    known = counts > 0
    return total, np.where(known, freed / np.maximum(total, 1) / np.maximum(1 - mass, 1e-300), 1.0)


def _evaluated(
    row: dict, model: Words, types: int, d: np.ndarray, hot_sums: dict, buckets: int, full: int, started: int
) -> pa.RecordBatch:
    chunk = Chunk(row, [x["totals"] for x in row["parts"]])
    order, bucket, v, _, _ = chunk.deal(buckets, full, started)
    parts = row["pair_parts"]
    totals = np.empty(len(order), dtype=np.int64)
    totals[order] = np.concatenate([unpacked(x["totals"], "<i8") for x in parts])
    few = np.concatenate([unpacked(x["few"], "<i4") for x in parts]).reshape(-1, TRUSTED).astype(np.int64)
    mass = np.concatenate([unpacked(x["levels"], "<f8")[unpacked(x["mass"], "<i4")] for x in parts])
    # sums came once for each history of a bucket; a hot history lies in several and has sums of its own
    new = _runs(bucket, v)
    local = chunk.v[order][new]
    names, counts = chunk.histories(started)
    few_v, mass_v = np.zeros((len(names), TRUSTED), dtype=np.int64), np.zeros(len(names))
    few_v[local], mass_v[local] = few, mass
    signed = names.view(np.int64)
    for place in np.flatnonzero(counts > full).tolist():
        if int(signed[place]) in hot_sums:
            few_v[place], mass_v[place] = hot_sums[int(signed[place])]
    total_v, weight_v = backed_off(few_v, mass_v, counts, d)
    word_p = model.p(chunk.counts)
    seen = discounted(totals, d) / np.maximum(total_v[chunk.v], 1)
    pair_p = np.where(totals > 0, seen, weight_v[chunk.v] * word_p[chunk.w])
    first = np.cumsum(chunk.lengths) - chunk.lengths
    score = np.add.reduceat(np.log10(pair_p)[chunk.pair_of], first)
    n = model.tokens
    base = np.log10((chunk.counts + 0.5) / (n + 0.5 * (types + 1)))
    known = (chunk.counts > 0).astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(row["ids"], pa.int64()),
            pa.array(~chunk.train),
            pa.array(chunk.lengths),
            pa.array(np.add.reduceat(known[chunk.tokens], first)),
            pa.array(np.full(len(first), n)),
            pa.array(np.add.reduceat(base[chunk.tokens], first)),
            pa.array(score),
        ],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )
