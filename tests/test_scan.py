"""Chunked running aggregates give what one ordered pass over the rows gives."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueline.operators import scan as sc


@pytest.fixture(scope="module")
def table():
    rng = random.Random(7)
    rows = []
    for session in range(3):
        # one session holds most rows
        for i in range(120 if session == 0 else 15):
            rows.append((session, i, rng.randrange(0, 5000), rng.choice([None, rng.randrange(50)])))
    return rows


@pytest.mark.parametrize("width", [1, 7, 400, 10**9])
def test_running_kinds(spark, table, width):
    df = spark.createDataFrame(table, "s int, i int, t int, v int")
    out = sc.scan(
        df,
        "s",
        ["t", "i"],
        sc.time_chunk("t", width),
        n=sc.running_count(),
        total=sc.running_sum(F.coalesce("v", F.lit(0)), inclusive=False),
        top=sc.running_max(F.col("v")),
        low_after=sc.running_min(F.col("v"), reverse=True),
        last=sc.nearest_value(F.col("v")),
        upcoming=sc.nearest_value(F.col("v"), reverse=True),
    )
    got = {(r.s, r.i): r for r in out.collect()}
    for session in range(3):
        ordered = sorted((r for r in table if r[0] == session), key=lambda r: (r[2], r[1]))
        values = [r[3] for r in ordered]
        for k, row in enumerate(ordered):
            mine = got[(session, row[1])]
            before = [v for v in values[:k] if v is not None]
            after = [v for v in values[k + 1 :] if v is not None]
            assert mine.n == k + 1
            assert mine.total == sum(before)
            assert mine.top == (max(before) if before else None)
            assert mine.low_after == (min(after) if after else None)
            assert mine["last"] == (before[-1] if before else None)
            assert mine.upcoming == (after[0] if after else None)


@pytest.mark.parametrize("p", [0, 1, 20, 50, 99.5, 100])
def test_exact_percentile_is_linear(spark, p):
    rng = np.random.default_rng(3)
    data = {0: rng.integers(-40, 40, 101).astype(float), 1: rng.normal(0, 9, 17), 2: np.array([4.5])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g int, v double")
    out = sc.exact_percentile(df, "g", "v", p, F.floor("v").cast("bigint"), "q")
    for r in out.collect():
        assert r.q == pytest.approx(np.percentile(data[r.g], p), abs=1e-9)
        assert r.n == len(data[r.g])


def test_values_at_ranks(spark):
    df = spark.createDataFrame([(0, float(v)) for v in [5, 1, 1, 9, 7]], "g int, v double")
    out = sc.values_at_ranks(df, "g", "v", {"third": F.floor(F.col("n") * 0.5)}, F.floor("v").cast("bigint"))
    assert out.first().third == sorted([5, 1, 1, 9, 7])[2]


def test_a_rank_outside_of_the_group_keeps_its_row(spark, rows):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 30.0), (1, 31.0), (1, 55.0)], "g int, v double")
    out = sc.values_at_ranks(df, "g", "v", {"fixed": F.lit(2), "end": F.col("n")}, F.floor(F.col("v") / 10).cast("bigint"))
    assert rows(out, "g", "n", "fixed", "end") == [(0, 2, None, None), (1, 3, 55.0, None)]


def test_rows_are_sorted_once_for_window_and_join(spark):
    """The join with the carried totals takes the rows as the window left them."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(100).selectExpr("id % 3 AS g", "id AS t")
        plan = sc.scan(df, "g", ["t"], sc.time_chunk("t", 10), n=sc.running_count())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # rows, totals, and totals again by chunk for the join
    assert "SortMergeJoin" in plan and plan.count("Sort [") == 3
