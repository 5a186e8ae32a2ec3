"""Documents without text and blank lines, as larger tables have them."""

from __future__ import annotations

import os

import duckdb
import pytest
from compare import TABLES, connect, difference

from cueline.catalog import collect

FROM = "/root/testdata/sf0.001"
TEXTS = ["", None, " ", "\t", "ab\n\ncd", "\n", "the plan for today is that we go on", "的的的"] * 3


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("blank")
    for name in TABLES:
        os.symlink(f"{FROM}/{name}.parquet", path / f"{name}.parquet")
    (path / "documents.parquet").unlink()
    rows = duckdb.execute("SELECT unnest(range(len($t))) AS doc_id, unnest($t) AS text", {"t": TEXTS})
    texts = rows.to_arrow_table()  # noqa: F841
    duckdb.execute(
        f"COPY (SELECT doc_id, text, 'en' AS lang, 's' AS source, length(text) AS n_chars FROM texts) TO '{path}/documents.parquet' (FORMAT parquet)"
    )
    return os.fspath(path)


@pytest.mark.parametrize("name", ["is_garbled", "is_garbled_english", "validate_notes"])
def test_blank_texts(spark, folder, name):
    """a blank line is garbled, and no error.  F3: which fields an item lacks doesn't hang on its document's text."""
    queries, oracle = collect()
    with connect(folder) as con:
        assert difference(queries[name](spark, folder), con, oracle[name]) is None
