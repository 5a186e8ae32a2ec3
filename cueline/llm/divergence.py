"""Source divergence audit: how far the words of each source lie from those of its language's other sources.

Terms are counted on packed bytes.  Terms of up to 8 bytes are one big-endian 64-bit word, of up to 16 bytes two,
so that order and equality of words are those of the bytes; they are put in order by a radix sort of 16-bit digits and
counted as runs.  Longer terms lie in buckets of one length, each sorted by its bytes.

A task counts slices of text, so what is exchanged are counts.  One exchange by term serves the counts of the
groups, those of the language, and the number of documents a term is in.  Pairs of sources are compared block
by block: a block holds some of a language's terms for all of its sources, and adds one sum for each pair.

A group is a (lang, source) that occurs, null read as ''.  Every row counts as a document, repeated ids too; null and
empty texts have no terms.  A language whose terms are all rare keeps none: its values are 0.  Ties rank by item.  An
empty table gives an empty result; further columns are ignored.  A text longer than a slice is cut between terms and its
parts are counted as one document; a single term is held whole, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.llm.common import stored, utf8

#: Documents a kept term is in at least, ranks of terms reported, and what shares are multiplied by.
LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Bytes of text counted at once, and (source, term) cells of a block of terms.
SLICE_BYTES, CELLS = 8 << 20, 500_000

#: Bytes of terms are ASCII letters and all bytes beyond ASCII; a letter is lowered, all else is a gap.
_LOWER = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0 for b in range(256))
_KEY = ("w0", "w1", "tail")
_COUNTS = "lang string, source string, w0 bigint, w1 bigint, tail binary, count bigint, docs bigint"


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """A stable order by unsigned columns, the most significant last: one pass for each 16-bit digit that differs."""
    order = np.arange(len(columns[0]))
    for column in columns:
        for shift in range(0, 8 * column.itemsize, 16):
            digit = (column >> column.dtype.type(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_counts(words: list[np.ndarray], group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, count, docs): one row of each run of equal (words, group), its length and the documents in it.

    Rows come in the order of their documents, and the sort is stable.
    """
    order = radix_order([group, *reversed(words)])
    fresh = np.ones(len(order), dtype=bool)
    held = [c[order] for c in (*words, group)]
    fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in held])
    own = doc[order]
    apart = fresh.copy()
    apart[1:] |= own[1:] != own[:-1]
    starts = np.flatnonzero(fresh)
    return order[starts], np.diff(np.append(starts, len(order))), np.add.reduceat(apart.astype(np.int64), starts)


def packed_terms(text: bytes, group: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> list[tuple]:
    """Counted terms of joined texts: (w0, w1, tails, group, count, docs) for each kind of length.

    ``text`` is lowered, its gaps are zero bytes; text i ends before ``ends[i]`` and has ``group[i]`` and ``doc[i]``.
    """
    raw = np.frombuffer(text + bytes(17), dtype=np.uint8)
    edges = np.flatnonzero(np.diff((raw != 0).astype(np.int8), prepend=0))
    starts, stops = edges[::2], edges[1::2]
    lengths = stops - starts
    at = np.searchsorted(ends, starts, side="right")
    group, doc = group[at], doc[at]
    loads = np.ndarray((len(raw) - 7,), dtype=">u8", buffer=raw, strides=(1,))
    found = []

    def word(rows: np.ndarray, skip: int) -> np.ndarray:
        size = np.minimum(lengths[rows] - skip, 8).astype(np.uint64)
        gap = np.uint64(64) - np.uint64(8) * size
        return (loads[starts[rows] + skip].astype(np.uint64) >> gap) << gap

    for least, most in ((1, 8), (9, 16)):
        rows = np.flatnonzero((lengths >= least) & (lengths <= most))
        if len(rows):
            words = [word(rows, skip) for skip in range(0, most, 8)]
            row, count, docs = run_counts(words, group[rows], doc[rows])
            w1 = words[1][row] if len(words) > 1 else np.zeros(len(row), dtype=np.uint64)
            found.append((words[0][row], w1, None, group[rows][row], count, docs))
    long = np.flatnonzero(lengths > 16)
    for length in np.unique(lengths[long]).tolist():
        rows = long[lengths[long] == length]
        # no term holds a zero byte, so fixed-width byte strings compare as the terms do
        terms, number = np.unique(raw[starts[rows][:, None] + np.arange(length)].view(f"S{length}").reshape(-1), return_inverse=True)
        row, count, docs = run_counts([number.astype(np.uint32)], group[rows], doc[rows])
        none = np.zeros(len(row), dtype=np.uint64)
        found.append((none, none, terms[number[row]].tolist(), group[rows][row], count, docs))
    return found


def term_counts(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(lang, source, w0, w1, tail, count, docs): counts of slices, to be added up."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        held: list[tuple[bytes, int]] = []
        size = 0

        def emit(found: list[tuple]) -> pa.RecordBatch:
            groups = list(names)
            langs, sources = pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.string())
            parts = []
            for w0, w1, tails, group, count, in_docs in found:
                at = pa.array(group.astype(np.int64))
                tail = pa.array([b""] * len(w0) if tails is None else tails, pa.binary())
                words = [pa.array(w.view(np.int64)) for w in (w0, w1)]
                parts.append([langs.take(at), sources.take(at), *words, tail, pa.array(count, pa.int64()), pa.array(in_docs, pa.int64())])
            names_ = ["lang", "source", *_KEY, "count", "docs"]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(list(c)) for c in zip(*parts, strict=True)], names=names_)

        def counted(texts: list[tuple[bytes, int]]) -> list[tuple]:
            group = np.array([g for _, g in texts], dtype=np.uint32)
            ends = np.cumsum([len(t) + 1 for t, _ in texts])
            return packed_terms(b"\0".join(t for t, _ in texts), group, np.arange(len(texts)), ends)

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                group = names.setdefault((lang, source), len(names))
                text = text.translate(_LOWER)
                if len(text) > slice_bytes:
                    merged = _merged([counted([(part, group)]) for part in _cut(text, slice_bytes)])
                    if merged:
                        yield emit(merged)
                    continue
                held.append((text, group))
                size += len(text)
                if size >= slice_bytes:
                    found = counted(held)
                    if found:
                        yield emit(found)
                    held, size = [], 0
        found = counted(held) if held else []
        if found:
            yield emit(found)

    lang, source = F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")
    return docs.select(lang, source, utf8(F.col("text")).alias("text")).mapInArrow(each, _COUNTS)


def _cut(text: bytes, size: int) -> Iterator[bytes]:
    """Parts of about ``size`` bytes that end between terms."""
    begin = 0
    while begin < len(text):
        end = text.find(b"\0", begin + size)
        end = len(text) if end < 0 else end
        yield text[begin:end]
        begin = end + 1


def _merged(parts: list[list[tuple]]) -> list[tuple]:
    """The counted parts of one document as those of the whole: counts add up, the document is one."""
    added: dict[tuple, int] = {}
    group = None
    for found in parts:
        for w0, w1, tails, groups, count, _ in found:
            group = groups[0]
            for key in zip(w0.tolist(), w1.tolist(), tails or [b""] * len(w0), count.tolist(), strict=True):
                added[key[:3]] = added.get(key[:3], 0) + key[3]
    if not added:
        return []
    w0, w1 = (np.array([k[i] for k in added], dtype=np.uint64) for i in range(2))
    count = np.array(list(added.values()))
    return [(w0, w1, [k[2] for k in added], np.full(len(w0), group), count, np.ones(len(w0), dtype=np.int64))]


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), in whole numbers."""
    over = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", over, (total + 2 * kept).cast("decimal(19,0)"))


def _term() -> Column:
    """The term as a string; the zero bytes behind a packed one are no part of it."""
    words = F.concat(*[F.unhex(F.lpad(F.hex(w), 16, "0")) for w in ("w0", "w1")])
    return F.when(F.length("tail") > 0, F.col("tail").cast("string")).otherwise(F.rtrim(words.cast("string"), F.lit("\0")))


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, w0, w1, tail, count, lang_count, first): terms in enough documents of their language.

    ``first`` is 1 in one row of each (lang, term).
    """
    dealt = term_counts(docs).repartition("lang", *_KEY)
    added = dealt.groupBy("lang", "source", *_KEY).agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    # at most one row for each source of the language
    term = Window.partitionBy("lang", *_KEY)
    return (
        added.withColumn("in_docs", F.sum("docs").over(term))
        .withColumn("lang_count", F.sum("count").over(term))
        .withColumn("first", (F.min("source").over(term) == F.col("source")).cast("int"))
        .where(F.col("in_docs") >= least_docs)
        .select("lang", "source", *_KEY, "count", "lang_count", "first")
    )


def _pair_sums(key: tuple, terms: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums of a block for every ordered pair of the language's sources."""
    names = sources["source"].to_pylist()
    place = {name: i for i, name in enumerate(names)}
    number = terms.select(list(_KEY)).to_pandas().groupby(list(_KEY), sort=False).ngroup().to_numpy()
    kept = int(number.max()) + 1 if len(number) else 0
    least = np.array([p or 0 for p in sources["p0"].to_pylist()], dtype=np.int64)
    shares = np.repeat(least[:, None], kept, axis=1)
    shares[[place[s] for s in terms["source"].to_pylist()], number] = terms["p"].to_numpy()
    left, right, values = [], [], []
    for i, name in enumerate(names):
        others = shares[i + 1 :]
        apart = others - shares[i]
        left += [name] * len(others)
        right += names[i + 1 :]
        values += (apart * apart // (others + shares[i])).sum(axis=1).tolist()
    lang = pa.array([key[0].as_py()] * (2 * len(values)), pa.string())
    columns = [lang, pa.array(left + right, pa.string()), pa.array(right + left, pa.string()), pa.array(values + values, pa.int64())]
    return pa.Table.from_arrays(columns, names=["lang", "source", "item", "value"])


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources, and the terms that set a source apart."""
    kept = stored(kept_terms(docs, least_docs))
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    langs = kept.groupBy("lang").agg(F.sum("first").alias("kept"), F.sum("count").alias("lang_n"))
    width = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("width"))
    none = F.lit(0).cast("bigint")
    frame = stored(
        groups.join(own, ["lang", "source"], "left").join(width, "lang").join(langs, "lang", "left").select(
            "lang",
            "source",
            *[F.coalesce(c, none).alias(c) for c in ("n", "kept", "lang_n")],
            F.greatest(F.ceil(F.col("width") * F.coalesce("kept", none) / CELLS), F.lit(1)).cast("int").alias("blocks"),
        )
    )
    shares = kept.join(frame, ["lang", "source"]).select(
        "lang",
        "source",
        *_KEY,
        F.pmod(F.xxhash64(*_KEY), F.col("blocks")).cast("int").alias("block"),
        _share(F.col("count"), F.col("n"), F.col("kept")).alias("p"),
        _share(F.col("lang_count"), F.col("lang_n"), F.col("kept")).alias("q"),
    )
    p, q = F.col("p"), F.col("q")
    above = shares.where(p > q).select(
        "lang", "source", F.lit("term").alias("part"), _term().alias("item"), F.call_function("div", (p - q) * (p - q), p + q).alias("value")
    )
    first = F.when(F.col("kept") > 0, _share(none, F.col("n"), F.col("kept")))
    laid = frame.select("lang", "source", first.alias("p0"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    summed = (
        shares.select("lang", "block", "source", *_KEY, "p")
        .groupBy("lang", "block")
        .cogroup(laid.groupBy("lang", "block"))
        .applyInArrow(_pair_sums, "lang string, source string, item string, value bigint")
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
    )
    pairs = summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)


DIVERGENCE_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), t AS (
    SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
    SELECT lang, term, count(*) AS lang_count FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 10
), c AS (
    SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term
), v AS (
    SELECT lang, count(*) AS kept, CAST(sum(lang_count) AS BIGINT) AS total FROM k GROUP BY lang
), g AS (
    SELECT s.lang, s.source, coalesce(CAST(sum(c.n) AS BIGINT), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN c USING (lang, source) GROUP BY s.lang, s.source
), s AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
           CAST(1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.total + 2 * v.kept) AS BIGINT) AS p,
           CAST(1 + (1000000000 * (k.lang_count + 2)) // (v.total + 2 * v.kept) AS BIGINT) AS q
    FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM s WHERE n > 0 AND p > q
), o AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10
"""
