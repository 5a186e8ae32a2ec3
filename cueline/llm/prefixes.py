"""Prefix trie of conversations: ternary search trees over range shards of turn sequences, merged at the shards' edges.

A turn is named by 128 bits of its SHA-256, a conversation by the names of its turns in a row.  Sequences are dealt out by
range, ties by conversation id, so a conversation that very many ids share is spread over shards as well.  A task reads its range in
blocks of bounded size.  In a block turns are numbered in the order of their names, and the sequences are put into a ternary
search tree, the median first and then the medians of the halves, which keeps the siblings balanced.  An iterative
walk over the tree adds up members, leaves and savings.

Sequences with one prefix are neighbours, so only the nodes on a block's first and last sequence can go on in another block.  A block
gives these two paths, with what the rest of the block hangs on them, and one task reads the paths of all blocks in order and
holds one path at a time.  The ids that end at such a node pass through it in runs, since a digest is made in sequence; ids
that end elsewhere are digested in their block.

Turns stand in the order of number (null first), role and text.  Null roles and texts are empty, rows without a
conversation id are no conversation.  The sequence of one conversation, 16 bytes a turn, is held as one value.  An empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DataType, LongType, StringType, StructField, StructType

from cueline.llm.common import stored

#: Bytes of a turn's name; turns or conversations of a block at most, but for a single conversation that is longer.
NAME, BLOCK = 16, 100_000
#: Conversations whose ids agree but for the last two digits open with turns of their first one: fewer than this.
SHARED, OPENING = 100, 6
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_TALLIES = ("members", "least", "children", "leaves", "saved", "points")


def _columns(names: str, kind: DataType) -> list[StructField]:
    return [StructField(name, kind) for name in names.split()]


_NODE = [
    *_columns("conv_id depth parent_conv_id", LongType()),
    *_columns("parent_key", BinaryType()),
    *_columns("n_convs n_children n_leaves saved_tokens", LongType()),
    *_columns("ends_sha256", StringType()),
]
_EDGE = [
    *_columns("seq", BinaryType()),
    *_columns("since", LongType()),
    *_columns("ids", BinaryType()),
    *_columns(" ".join(_TALLIES), ArrayType(LongType())),
]
_SHARD, _MERGED = StructType(_NODE + _EDGE), StructType([*_columns("key", BinaryType()), *_NODE])


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, said): the turns of each conversation in order, as structs of name and code points."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    named = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").isNotNull().alias("numbered"),
        "turn",
        role.alias("role"),
        text.alias("text"),
        F.unhex(F.substring(named, 1, 2 * NAME)).alias("name"),
        F.length(text).alias("points"),
    )

    def gathered(found: DataFrame, place: Column) -> DataFrame:
        turn = F.struct("numbered", "turn", "role", place.alias("place"), "name", "points")
        return found.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    # texts are compared only where number and role leave the order of different texts open
    first = stored(gathered(rows, F.lit(0)))
    size = F.greatest(F.size("turns") - 1, F.lit(0))
    open_ = F.exists(
        F.zip_with(F.slice("turns", F.lit(1), size), F.slice("turns", F.lit(2), size), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        lambda p: p["a"]["turn"].eqNullSafe(p["b"]["turn"]) & (p["a"]["role"] == p["b"]["role"]) & (p["a"]["name"] != p["b"]["name"]),
    )
    tied = first.where(open_).select("conv_id")
    place = F.dense_rank().over(Window.partitionBy("conv_id", "turn", "role").orderBy("text"))
    mended = gathered(rows.join(tied, "conv_id", "left_semi").withColumn("place", place), F.col("place"))
    said = F.transform("turns", lambda t: F.struct(t["name"].alias("name"), t["points"].alias("points"))).alias("said")
    return first.where(~open_).select("conv_id", said).unionByName(mended.select("conv_id", said))


def rebuilt(own: DataFrame) -> DataFrame:
    """(seq, conv_id, points): each conversation behind the opening turns of the first of its hundred."""
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENING
    opened = F.col("conv_id") - F.col("conv_id") % SHARED
    firsts = own.where(F.col("conv_id") % SHARED == 0).select(
        F.col("conv_id").alias("opened"), F.slice("said", F.lit(1), F.lit(OPENING - 1)).alias("opening")
    )
    met = own.withColumn("shared", shared.cast("int")).withColumn("opened", opened).join(firsts, "opened", "left")
    none = F.slice("said", F.lit(1), F.lit(0))
    opening = F.slice(F.coalesce("opening", none), F.lit(1), F.col("shared"))
    said = F.concat(opening, F.slice("said", F.col("shared") + 1, F.greatest(F.size("said"), F.lit(1))))
    whole = met.select("conv_id", said.alias("said"))
    return whole.select(
        F.unhex(F.array_join(F.transform("said", lambda t: F.hex(t["name"])), "")).alias("seq"),
        "conv_id",
        F.transform("said", lambda t: t["points"]).alias("points"),
    )


class TernaryTree:
    """A trie whose siblings are binary search trees; node 0 is the root of all, without a turn."""

    def __init__(self):
        self.turn, self.low, self.same, self.high = [-1], [-1], [-1], [-1]
        self.points, self.ending = [0], [-1]

    def _grown(self, turn: int, points: int) -> int:
        for column, value in ((self.turn, turn), (self.low, -1), (self.same, -1), (self.high, -1), (self.points, points), (self.ending, -1)):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, turns: list[int], points: list[int], entry: int) -> None:
        at, turn, same = 0, self.turn, self.same
        for own, length in zip(turns, points, strict=True):
            links, holder = same, at
            at = same[at]
            while at >= 0 and turn[at] != own:
                links, holder = (self.low if own < turn[at] else self.high), at
                at = links[at]
            if at < 0:
                at = links[holder] = self._grown(own, length)
        self.ending[at] = entry

    def path(self, turns: list[int]) -> list[int]:
        """The nodes of a sequence that is in the tree, the root first."""
        nodes = [0]
        for own in turns:
            at = self.same[nodes[-1]]
            while self.turn[at] != own:
                at = self.low[at] if own < self.turn[at] else self.high[at]
            nodes.append(at)
        return nodes

    def walk(self) -> list[tuple[int, int, int]]:
        """(node, parent, depth) of all nodes, every parent before its children."""
        order, waiting = [], [(0, -1, 0)]
        while waiting:
            node, parent, depth = waiting.pop()
            order.append((node, parent, depth))
            siblings = [self.same[node]]
            while siblings:
                child = siblings.pop()
                if child >= 0:
                    waiting.append((child, node, depth + 1))
                    siblings += [self.low[child], self.high[child]]
        return order


def medians(n: int) -> Iterator[int]:
    """0..n-1, the middle first, then the middles of both halves."""
    waiting = [(0, n)]
    while waiting:
        begin, end = waiting.pop()
        if begin < end:
            middle = (begin + end) // 2
            yield middle
            waiting += [(begin, middle), (middle + 1, end)]


def keys_of(seq: bytes) -> list[bytes]:
    """A digest of every prefix of a sequence, from the empty one on."""
    digest, found = hashlib.sha256(), []
    found.append(digest.digest()[:NAME])
    for i in range(0, len(seq), NAME):
        digest.update(seq[i : i + NAME])
        found.append(digest.copy().digest()[:NAME])
    return found


def _joined(ids: list[int]) -> bytes:
    return ",".join(map(str, ids)).encode()


def block_nodes(entries: list[tuple[bytes, list[int], list[int]]]) -> tuple[list[tuple], list[tuple]]:
    """(nodes, edges) of a block: distinct sequences in order, with code points and the ids that say exactly that.

    Nodes off the first and the last sequence are whole.  The edges are these two paths, each place with its own members and
    with the children, leaves and savings of the whole nodes below it, and the ids of sequences that end on the way.
    """
    names = np.frombuffer(b"".join(e[0] for e in entries), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    order = np.lexsort((names[:, 1], names[:, 0]))
    fresh = np.ones(len(order), dtype=np.int64)
    fresh[1:] = (names[order[1:]] != names[order[:-1]]).any(axis=1)
    numbers = np.empty(len(order), dtype=np.int64)
    numbers[order] = np.cumsum(fresh)
    ends = np.cumsum([len(e[0]) // NAME for e in entries]).tolist()
    turns = [numbers[a:b].tolist() for a, b in pairwise([0, *ends])]

    tree = TernaryTree()
    for i in medians(len(entries)):
        tree.insert(turns[i], entries[i][1], i)
    walked = tree.walk()
    paths = [tree.path(turns[0])] + ([tree.path(turns[-1])] if len(entries) > 1 else [])
    key: dict[int, bytes] = {}
    for nodes, (seq, _, _) in zip(paths, (entries[0], entries[-1]), strict=False):
        key.update(zip(nodes, keys_of(seq), strict=True))

    size = len(tree.turn)
    members, children, leaves, saved = [0] * size, [0] * size, [0] * size, [0] * size
    least: list[int | None] = [None] * size
    for node, parent, _ in reversed(walked):
        entry = tree.ending[node]
        if entry >= 0:
            ids = entries[entry][2]
            members[node] += len(ids)
            least[node] = ids[0] if least[node] is None else min(least[node], ids[0])
        if node not in key:
            leaves[node] = leaves[node] or 1
            saved[node] += (members[node] - 1) * tree.points[node]
            children[parent] += 1
            leaves[parent] += leaves[node]
            saved[parent] += saved[node]
        if parent >= 0:
            members[parent] += members[node]
            least[parent] = least[node] if least[parent] is None else min(least[parent], least[node])
    nodes = []
    for node, parent, depth in walked:
        if node not in key:
            entry = tree.ending[node]
            ended = _NO_ENDS if entry < 0 else hashlib.sha256(_joined(entries[entry][2])).hexdigest()
            above = (None, key[parent]) if parent in key else (least[parent], None)
            nodes.append((least[node], depth, *above, members[node], children[node], leaves[node], saved[node], ended))
    edges, told = [], set()
    for path, (seq, points, ids) in zip(paths, (entries[0], entries[-1]), strict=False):
        # what both paths share is told once
        own = [n not in told for n in path]
        told.update(path)
        columns = [[c[n] if mine else 0 for n, mine in zip(path, own, strict=True)] for c in (members, children, leaves, saved)]
        first = [least[n] if mine else None for n, mine in zip(path, own, strict=True)]
        edges.append((seq, ids[0], _joined(ids), columns[0], first, *columns[1:], [0, *points]))
    for node in key:
        entry = tree.ending[node]
        if 0 < entry < len(entries) - 1:  # ends on the way of the last sequence
            seq, _, ids = entries[entry]
            edges.append((seq, ids[0], _joined(ids), *([] for _ in _TALLIES)))
    return nodes, edges


def _shards(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The nodes and edges of a sorted range, block by block."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, n_node = to_arrow_schema(_SHARD), len(_NODE)
        nothing = (None,) * len(schema)

        def rows(entries: list) -> pa.RecordBatch:
            nodes, edges = block_nodes(entries)
            whole = [n + nothing[n_node:] for n in nodes] + [nothing[:n_node] + e for e in edges]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*whole, strict=True), schema, strict=True)], schema=schema)

        entries: list[tuple[bytes, list[int], list[int]]] = []
        size = 0
        for batch in batches:
            for seq, conv_id, points in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                grown = 1 + len(points)
                if entries and size + grown > block:
                    yield rows(entries)
                    entries, size = [], 0
                size += grown if not entries or entries[-1][0] != seq else 1
                if entries and entries[-1][0] == seq:
                    entries[-1][2].append(conv_id)
                else:
                    entries.append((seq, points, [conv_id]))
        if entries:
            yield rows(entries)

    return each


class _Place:
    """A node on the path that is being merged."""

    def __init__(self, depth: int, digest):
        self.depth, self.digest = depth, digest
        self.points = self.members = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ended = None


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes on the edges of the blocks, from the edges in order of sequence and first id."""
    schema = to_arrow_schema(_MERGED)
    path: list[_Place] = []
    done: list[tuple] = []
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth:
            place = path.pop()
            leaves = place.leaves or 1
            saved = place.saved + (place.members - 1) * place.points
            above = None
            if path:
                up = path[-1]
                above = up.digest.digest()[:NAME]
                up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
            ended = place.ended.hexdigest() if place.ended else _NO_ENDS
            done.append((place.digest.digest()[:NAME], place.least, place.depth, None, above, place.members, place.children, leaves, saved, ended))

    def taken() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        done.clear()
        return found

    for batch in batches:
        for seq, _, ids, members, least, children, leaves, saved, points in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            shared, most = 0, min(len(seq), len(last)) // NAME
            if seq[: most * NAME] == last[: most * NAME]:
                shared = most
            else:
                while seq[shared * NAME : (shared + 1) * NAME] == last[shared * NAME : (shared + 1) * NAME]:
                    shared += 1
            close(shared + 1)
            for depth in range(len(path), len(seq) // NAME + 1):
                digest = path[-1].digest.copy() if path else hashlib.sha256()
                digest.update(seq[(depth - 1) * NAME : depth * NAME] if depth else b"")
                path.append(_Place(depth, digest))
            for depth, place in enumerate(path[: len(members)]):
                place.points = points[depth]
                place.members += members[depth]
                place.children += children[depth]
                place.leaves += leaves[depth]
                place.saved += saved[depth]
                if least[depth] is not None:
                    place.least = least[depth] if place.least is None else min(place.least, least[depth])
            if path[-1].ended is None:
                path[-1].ended = hashlib.sha256(ids)
            else:
                path[-1].ended.update(b"," + ids)
            last = seq
            if len(done) >= BLOCK:
                yield taken()
    close(0)
    if done:
        yield taken()


def prefix_nodes(whole: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each node of the trie of ``whole`` (seq, conv_id, points)."""
    dealt = whole.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").select("seq", "conv_id", "points")
    found = stored(dealt.mapInArrow(_shards(block), _SHARD))
    node = [f.name for f in _NODE]
    edges = found.where(F.col("seq").isNotNull()).select("seq", "since", "ids", *_TALLIES)
    # two rows a block, and those that end on the way
    merged = stored(edges.repartition(1).sortWithinPartitions("seq", "since").mapInArrow(_merge, _MERGED))
    nodes = found.where(F.col("seq").isNull()).select(*node).unionByName(merged.select(*node))
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    below = nodes.where(F.col("parent_key").isNotNull()).join(parents, "parent_key")
    known = nodes.where(F.col("parent_key").isNull())
    return known.drop("parent_key").unionByName(below.withColumn("parent_conv_id", F.col("above")).select(*known.drop("parent_key").columns))


def conversation_prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of the prefix query: the trie of all rebuilt conversations."""
    own = stored(sequences(turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")))
    return prefix_nodes(stored(rebuilt(own)), block)


PREFIX_SQL = r"""
WITH RECURSIVE t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), c AS (
    SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY turn NULLS FIRST, role, text) AS ms,
           list(length(text) ORDER BY turn NULLS FIRST, role, text) AS ns
    FROM t GROUP BY conv_id
), h AS (
    SELECT *, conv_id - conv_id % 100 AS base,
           xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
                           lambda c, b: list_reduce([CAST(0 AS BIGINT), 1, 2, 3, 4, 5, 6, 7],
                                                    lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)),
                           CAST(4294967295 AS BIGINT)), 4294967295) % 6 AS h
    FROM c
), r AS (
    SELECT h.conv_id, list_concat(coalesce(b.ms[1:h.h], []), h.ms[h.h + 1:]) AS ms, list_concat(coalesce(b.ns[1:h.h], []), h.ns[h.h + 1:]) AS ns
    FROM h LEFT JOIN c b ON b.conv_id = h.base
), p AS (
    SELECT conv_id, len(ms) AS size, unnest(range(0, len(ms) + 1)) AS d, ms, ns FROM r
), k AS (
    SELECT conv_id, size, d, md5(array_to_string(ms[1:d], ' ')) AS k, CASE WHEN d > 0 THEN md5(array_to_string(ms[1:d - 1], ' ')) END AS up,
           CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS points
    FROM p
), n AS (
    SELECT k, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(points) AS points,
           coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = d), '') AS ends
    FROM k GROUP BY k, d
), q AS (
    SELECT n.*, (SELECT count(*) FROM n c WHERE c.up = n.k) AS n_children FROM n
), a AS (
    SELECT k, k AS top, up FROM n
    UNION ALL SELECT a.k, a.up, n.up FROM a JOIN n ON n.k = a.up
), s AS (
    SELECT a.top, CAST(sum(CASE WHEN q.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
           CAST(sum((q.n_convs - 1) * q.points) AS BIGINT) AS saved_tokens
    FROM a JOIN q USING (k) GROUP BY a.top
)
SELECT q.conv_id, q.d AS depth, u.conv_id AS parent_conv_id, q.n_convs, q.n_children, s.n_leaves, s.saved_tokens, sha256(q.ends) AS ends_sha256
FROM q JOIN s ON s.top = q.k LEFT JOIN n u ON u.k = q.up
"""
