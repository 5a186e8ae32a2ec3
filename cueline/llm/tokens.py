"""Token counts by scanning flat token files for the identifier that ends a document.

``write_tokens`` lays documents out as flat files of identifiers of one fixed width, each document followed by the
separator, with no index; ``count_tokens`` takes any such files.  Files are read in blocks of fixed
length, wherever documents begin or end.  A block is searched for separators at once and gives the lengths of
the documents that lie inside, and the places of its first and last separator; a prefix scan over the
blocks of a file carries the last separator and the number of documents into each block, which
stitches the documents that cross blocks.

An empty document is a separator alone, and so is a null text.  Tokens behind a file's last separator are a last,
unterminated document.  Empty files and empty tables give no rows.  Further columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueline.llm.common import stored
from cueline.session import shared_folder

#: Where the vocabulary lies, its separator, and the bytes of an identifier.
VOCABULARY, SEPARATOR, WIDTH = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256, 2
#: Fixed value: the pattern that cuts a text before byte-pair merging, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Identifiers in a block.
BLOCK_TOKENS = 1 << 20


def open_folder(folder: str):
    """The file system of a folder's address and the path in it."""
    from pyarrow import fs

    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, separator: int = SEPARATOR, width: int = WIDTH) -> DataFrame:
    """Writes a flat file for each task; gives (doc_id, file, position) of the documents written.

    A task that runs again writes a file of another name.  Only files named in the result count, and only
    finished tasks name theirs, so what a lost task has left is never read.
    """
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary).read_bytes().splitlines())}
    sent = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary of fixed size

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=sent.value, special_tokens={})
        kind = np.dtype(f"<u{width}")
        end = np.array([separator], dtype=kind).tobytes()
        name, position, sink = f"{uuid.uuid4().hex}.bin", 0, None
        for batch in batches:
            if sink is None:
                system, path = open_folder(folder)
                system.create_dir(path, recursive=True)
                sink = system.open_output_stream(f"{path}/{name}")
            for text in batch.column(1).to_pylist():
                sink.write(np.array(encoding.encode_ordinary(text), dtype=kind).tobytes() + end)
            places = pa.array(np.arange(position, position + batch.num_rows))
            position += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * batch.num_rows), places], names=["doc_id", "file", "position"])
        if sink is not None:
            sink.close()

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return stored(texts.mapInArrow(write, "doc_id bigint, file string, position bigint"))


def count_tokens(files: DataFrame, separator: int = SEPARATOR, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(path, position, n_tokens, ended): the documents of the flat files (path, length), in order."""
    size = block_tokens * width
    cut = files.where("length > 0").select(
        "path", F.col("length").alias("bytes"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / size))).alias("block")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(f"<u{width}")
        for batch in batches:
            for path, length, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, place = open_folder(path)
                with system.open_input_file(place) as f:
                    f.seek(block * size)
                    data = f.read(min(size, length - block * size))
                data = np.frombuffer(data[: len(data) // width * width], dtype=kind)
                at = np.flatnonzero(data == separator)
                start = block * block_tokens
                first, last = (start + int(at[0]), start + int(at[-1])) if len(at) else (None, None)
                row = [[path], [block], [start + len(data)], [len(at)], [first], [last], [np.diff(at) - 1]]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["path", "block", "stop", "n", "first", "last", "inner"]
                )

    found = stored(
        cut.repartition("path", "block")
        .select("path", "bytes", "block")
        .mapInArrow(search, "path string, block bigint, stop bigint, n bigint, first bigint, last bigint, inner array<bigint>")
    )
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select(
        "path",
        "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("documents"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("ended"),
        F.lead("block").over(Window.partitionBy("path").orderBy("block")).isNull().alias("final"),
    )
    blocks = found.join(carried, ["path", "block"])
    # the document that the first separator ends, those inside, and at a file's end what no separator ended
    opened = F.when(F.col("n") > 0, F.array(F.col("first") - F.col("ended") - 1)).otherwise(F.array().cast("array<bigint>"))
    tail = F.col("stop") - F.greatest(F.coalesce("last", F.lit(-1)), "ended") - 1
    closed = F.when(F.col("final") & (tail > 0), F.array(tail)).otherwise(F.array().cast("array<bigint>"))
    return blocks.select(
        "path", "documents", "n", F.posexplode(F.concat(opened, "inner", closed)).alias("place", "n_tokens")
    ).select("path", (F.col("documents") + F.col("place")).alias("position"), "n_tokens", (F.col("place") < F.col("n")).alias("ended"))


def flat_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the flat files in a folder; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")


def document_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens) of every document, counted in flat files written from the table."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    written = write_tokens(docs, folder)
    if written.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    named = F.element_at(F.split("path", "/"), -1)
    known = written.select("file").distinct()
    files = flat_files(spark, folder).withColumn("file", named).join(known, "file", "left_semi").select("path", "length")
    counted = count_tokens(files).withColumn("file", named).select("file", "position", "n_tokens")
    return written.join(counted, ["file", "position"]).select("doc_id", "n_tokens")
