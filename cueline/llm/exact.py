"""Exact de-duplication by distributed most-significant-digit radix partitioning.

A text's bytes are read from the front in digits of growing width.  Each round splits every open
group by its next digit; a group of one row is decided, and so is a group whose texts have ended (a
digit shorter than its width).  Only open groups go on, with the bytes not yet read.  Texts are equal
because all their bytes were equal; the digest in the result decides nothing.

Null texts are empty texts.  Null ids sort behind all others; of equal rows one stays.  Equal means
equal after every run of white space is one space.  An empty table gives an empty result, and
further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.llm.common import SPACES, stored

#: Bytes of the first digit, and how much wider each next one is.
FIRST_DIGIT, WIDENING = 64, 16
#: Widest digit: what one row of a group's key may hold.
WIDEST_DIGIT = 1 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _digit(data: Column, width: int) -> Column:
    return F.substring(data, 1, width)


def exact_groups(docs: DataFrame, first_digit: int = FIRST_DIGIT, widening: int = WIDENING) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    clean = normalised(F.col("text"))
    read = docs.select("doc_id", clean.cast("binary").alias("data"), F.sha2(clean.cast("binary"), 256).alias("sha"))
    # the first split looks at the leading digit alone: most texts are alone already there
    # (a table, so that the join reads it by an exchange of its own and can split a digit that very many share)
    heads = stored(
        docs.select(_digit(clean.cast("binary"), first_digit).alias("head"))
        .groupBy("head")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    split = read.join(heads.hint("merge"), _digit(F.col("data"), first_digit) == F.col("head"), "left")
    state = stored(
        split.select(
            F.monotonically_increasing_id().alias("uid"),
            "doc_id",
            "sha",
            F.col("n").isNull().alias("final"),
            F.col("head").alias("group"),
            F.when(F.col("n") > 1, F.expr(f"substring(data, {first_digit + 1})")).alias("rest"),
        )
    )
    one = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid")
    decided = state.where("final").select("uid", "doc_id", "sha", one.alias("first"), F.lit(1).cast("bigint").alias("n"))
    opened = state.where("NOT final").drop("final")
    width = first_digit
    while not opened.isEmpty():
        width = min(width * widening, WIDEST_DIGIT)
        digits = opened.select("uid", "doc_id", "sha", "group", "rest").withColumn("digit", _digit(F.col("rest"), width))
        groups = stored(
            digits.groupBy(F.col("group").alias("g"), F.col("digit").alias("d")).agg(
                F.count(F.lit(1)).alias("n"), F.min(one).alias("first")
            )
        )
        met = digits.join(groups.hint("merge"), (F.col("group") == F.col("g")) & (F.col("digit") == F.col("d")))
        final = (F.col("n") == 1) | (F.octet_length("digit") < width)
        state = stored(
            met.select(
                "uid",
                "doc_id",
                "sha",
                "n",
                "first",
                final.alias("final"),
                F.when(~final, F.col("first.uid").cast("string").cast("binary")).alias("group"),
                F.when(~final, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
            )
        )
        decided = decided.unionByName(state.where("final").select("uid", "doc_id", "sha", "first", "n"))
        opened = state.where("NOT final")
    return decided.select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("uid") == F.col("first.uid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


EXACT_SQL = r"""
WITH t AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
