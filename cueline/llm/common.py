"""Text rules and distribution helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.session import cut_lineage

#: The six white-space characters, and a run of them, as the contracts name them.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"

#: Rows that one task may hold together where a group is split (ranks, blocks).
PART_ROWS = 2048


def words(text: Column) -> Column:
    """The maximal runs of other characters than white space; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def word_count(text: Column) -> Column:
    """How many words a text has, without a value for each."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.length(F.regexp_replace(bare, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x"))


def utf8(text: Column) -> Column:
    """The bytes of a text, for Python tasks; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def uniform(*columns: Column) -> Column:
    """A fixed pseudo-random number in [0, 1) of the columns, with 53 bits."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11)).cast("double") / F.lit(float(1 << 53))


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; the split rule of the learning contracts."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition on equal keys where null equals null."""
    met = F.lit(True)
    for key in keys:
        met = met & left[key].eqNullSafe(right[key])
    return met


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on keys that may be null; the keys come from the left."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    met = F.lit(True)
    for key in keys:
        met = met & F.col(key).eqNullSafe(F.col(f"__r_{key}"))
    return left.join(renamed, met, how).drop(*[f"__r_{k}" for k in keys])


def dealt_rank(
    df: DataFrame, keys: Sequence[str], count: str, order: Sequence[Column], into: str, part_rows: int = PART_ROWS
) -> DataFrame:
    """Adds the 0-based rank of each row within its group, in the order of a hash.

    ``count`` names a column with the size of the row's group, ``order`` begins with a hash (long).
    A group of any size is cut into parts of about ``part_rows`` rows by that hash; a rank is
    the number of rows in earlier parts plus the row's place in its part, so no task sorts
    a whole group.
    """
    parts = F.ceil(F.col(count) / F.lit(part_rows))
    cut = df.withColumn("__part", F.floor((F.shiftrightunsigned(order[0], 11).cast("double") / float(1 << 53)) * parts).cast("bigint"))
    held = cut.where(F.col(count) > part_rows).groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    placed = null_safe_join(cut, offsets, [*keys, "__part"], "left")
    inside = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    rank = F.coalesce(F.col("__before"), F.lit(0)) + inside - 1
    return placed.withColumn(into, rank.cast("bigint")).drop("__part", "__before")


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: later reads survive a lost executor."""
    return cut_lineage(df)


def free_names(df: DataFrame, *names: str) -> DataFrame:
    """Without the columns whose names an operator is about to give (any case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
