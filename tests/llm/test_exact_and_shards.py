"""Exact groups, shards and the draw behind them, against plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import comb

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from cueline.llm.common import uniform
from cueline.llm.exact import exact_groups
from cueline.llm.queries import ORACLE, QUERIES
from cueline.llm.sharding import hypergeometric, shard_documents, uniform_shards

SCHEMA = "doc_id bigint, text string, source string, shard string, group string, n int"
LONG = "word " * 70_000


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, None, "x", "y", 1) for i, t in texts], SCHEMA)


MESSY = [
    (5, "a  b"), (3, "a b"), (4, "a\t\nb"), (9, "a b "), (None, "a b"), (7, None), (8, ""), (2, LONG), (1, LONG + "x"), (6, LONG + "y"), (10, LONG + "x"),
    (11, "same"), (11, "same"), (None, None), (12, "x" * 64), (13, "x" * 64), (14, "x" * 65), (15, "é" * 32), (16, "é" * 32),
]


@pytest.mark.parametrize("name", sorted(ORACLE))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    assert difference(QUERIES[name](spark, folder), connect(folder), ORACLE[name]) is None


@pytest.mark.parametrize("first,widening", [(1, 2), (64, 16)])
def test_exact_groups_of_messy_rows(spark, first, widening):
    texts = [(i, t) for i, t in MESSY if first > 1 or t is None or len(t) < 1000]
    groups = defaultdict(list)
    for i, t in texts:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    found = exact_groups(rows_of(spark, texts), first, widening).collect()
    assert len(found) == len(texts)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in found:
        members = by_sha[r.text_sha256]
        assert r.group_size == len(members)
        assert r.keep_id == min((m for m in members if m is not None), default=None)
    assert Counter(r.text_sha256 for r in found if r.kept) == Counter(by_sha.keys())
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_a_third_of_all_rows_is_one_text(spark):
    texts = [(i, "hot " * 30 if i % 3 == 0 else f"cold {i}") for i in range(600)]
    found = exact_groups(rows_of(spark, texts)).where("group_size > 1").collect()
    assert len(found) == 200 and {r.keep_id for r in found} == {0} and sum(r.kept for r in found) == 1


def test_empty_tables(spark):
    none = rows_of(spark, [])
    assert exact_groups(none).count() == 0
    assert uniform_shards(none, 3).columns == ["doc_id", "text", "source", "group", "n", "shard", "slot"]
    assert uniform_shards(none, 3).count() == 0
    assert shard_documents(none).count() == 0


def check_shards(found, total, n):
    places = defaultdict(list)
    for r in found:
        places[r.shard].append(r.slot)
    sizes = [len(places[s]) for s in range(n)]
    assert sum(sizes) == total and max(sizes) - min(sizes) <= 1
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


@pytest.mark.parametrize("n,block", [(1, 4), (3, 4), (24, 2048), (5, 1)])
def test_shards_hold_every_row_once(spark, n, block):
    docs = rows_of(spark, MESSY).repartition(3)
    found = uniform_shards(docs, n, block_rows=block).collect()
    check_shards(found, len(MESSY), n)
    assert Counter((r.doc_id, r.text) for r in found) == Counter(MESSY)


def test_digest_of_shards(spark):
    found = shard_documents(rows_of(spark, MESSY)).collect()
    check_shards(found, len(MESSY), 24)
    sizes = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in MESSY)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == sizes
    assert {(r.law, r.grown_shard) for r in found} == {("rows", None)}


def test_neighbours_part(spark):
    """A uniform shuffle leaves two neighbours in one shard of ten one time in ten."""
    found = uniform_shards(spark.range(4000).select(F.col("id").alias("doc_id")).repartition(5), 10, block_rows=100)
    shard = {r.doc_id: r.shard for r in found.collect()}
    together = sum(shard[i] == shard[i + 1] for i in range(3999)) / 3999
    assert 0.07 < together < 0.13


@pytest.mark.parametrize("total,marked,drawn", [(50, 20, 10), (9, 9, 4), (30, 3, 28), (7, 0, 3), (1, 1, 1)])
def test_law_of_the_draw(spark, total, marked, drawn):
    n = 20_000
    draw = hypergeometric(F.lit(total), F.lit(marked), F.lit(drawn), uniform(F.lit(3), F.col("id")))
    seen = {r.k: r["count"] / n for r in spark.range(n).select(draw.alias("k")).groupBy("k").count().collect()}
    for k in range(drawn + 1):
        law = comb(marked, k) * comb(total - marked, drawn - k) / comb(total, drawn)
        assert abs(seen.pop(k, 0) - law) < 0.015
    assert not seen
