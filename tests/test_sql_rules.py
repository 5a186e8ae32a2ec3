"""Queries and their SQL on the sessions of a larger table where the two once told different rules."""

from __future__ import annotations

import os
from types import SimpleNamespace

import duckdb
import pytest
from compare import TABLES, connect, difference

from cueline.catalog import collect

FROM = "/root/testdata/sf0.1"
#: A kept track that is neither assistant nor user; a struck line end; a score at half a tenth; moments within a
#: millisecond; vectors of one hash.
PARTS = {
    "conversations": "SELECT * FROM t WHERE conv_id IN (291, 604, 859, 235)",
    "lineitem": "SELECT * FROM t WHERE l_suppkey IN (291, 604, 859, 235)",
    "events": "SELECT * FROM t WHERE user_id IN (953, 187, 1026)",
    "embeddings": "SELECT * FROM t UNION ALL SELECT * REPLACE (vec_id + 100000 AS vec_id) FROM t WHERE vec_id % 9 = 0",
}
NAMES = (
    "migrate_marks migrate_marks_unchanged_text migrate_marks_across_speakers excitement highlights activity_mask resolve_time "
    "retained_ranges gain_envelope stream_tickets similar_hashes"
).split()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("parts")
    for name in TABLES:
        if name in PARTS:
            sql = PARTS[name].replace("FROM t", f"FROM read_parquet('{FROM}/{name}.parquet')")
            duckdb.execute(f"COPY ({sql}) TO '{path}/{name}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{FROM}/{name}.parquet", path / f"{name}.parquet")
    return os.fspath(path)


@pytest.mark.parametrize("name", NAMES)
def test_query_and_sql_tell_one_rule(spark, folder, name):
    queries, oracle = collect()
    df = queries[name](spark, folder)
    with connect(folder) as con:
        assert difference(SimpleNamespace(columns=df.columns, collect=df.collect), con, oracle[name]) is None
