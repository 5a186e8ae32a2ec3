"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

The rows of every input block go to the shards in numbers drawn from the multivariate
hypergeometric law, which is the law of a uniform shuffle.  The blocks are leaves of a binary
tree: a node's shard counts are split between its halves by conditional hypergeometric
draws, so the matrix is drawn level by level as a DataFrame and never gathered.  Then each
block permutes its rows and deals them out by its counts, the rows are exchanged, and each
shard permutes what it got.

Nulls and equal rows are rows like others.  An empty table gives an empty result.  Columns of the
input named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.llm.common import PART_ROWS, dealt_rank, free_names, stored, uniform

#: Standard deviations on either side of the mode that a draw looks at; the rest weighs under 1e-30.
REACH = 12.0


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is written and computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` rows are ``marked``, by inverting the law at ``u``.

    Weights relative to the mode follow from the ratio of neighbours, first upwards from the mode, then
    downwards; no factorial is needed, and the cost is the law's width, not its size.
    """
    given = F.struct(
        total.cast("double").alias("n"), marked.cast("double").alias("m"), drawn.cast("double").alias("d"), u.alias("u")
    )
    zero, one = F.lit(0.0), F.lit(1.0)

    def located(x: Column) -> Column:
        low, high = F.greatest(zero, x["d"] + x["m"] - x["n"]), F.least(x["d"], x["m"])
        mode = F.least(high, F.greatest(low, F.floor((x["d"] + 1) * (x["m"] + 1) / (x["n"] + 2)).cast("double")))
        share = x["m"] / x["n"]
        spread = F.sqrt(x["d"] * share * (1 - share) * F.greatest(zero, (x["n"] - x["d"]) / F.greatest(one, x["n"] - 1)))
        reach = F.ceil(spread * REACH).cast("double") + 30
        return F.struct(low.alias("low"), high.alias("high"), mode.alias("mode"), reach.alias("reach"))

    def steps(at: Column) -> Column:
        """The numbers whose weights are taken, each with the number that it leads to."""
        mode, none = at["mode"].cast("bigint"), F.array().cast("array<bigint>")
        top = F.least(at["high"], at["mode"] + at["reach"]).cast("bigint")
        bottom = F.greatest(at["low"], at["mode"] - at["reach"]).cast("bigint")
        return F.struct(
            F.when(top > mode, F.sequence(mode, top - 1)).otherwise(none).alias("up"),
            F.when(bottom < mode, F.sequence(mode, bottom + 1, F.lit(-1).cast("bigint"))).otherwise(none).alias("down"),
        )

    def walked(x: Column, at: Column, step: Column) -> Column:
        def up(k: Column) -> Column:
            return (x["m"] - k) * (x["d"] - k) / ((k + 1) * (x["n"] - x["m"] - x["d"] + k + 1))

        def down(k: Column) -> Column:
            return k * (x["n"] - x["m"] - x["d"] + k) / ((x["m"] - k + 1) * (x["d"] - k + 1))

        def mass(numbers: Column, ratio: Callable[[Column], Column]) -> Column:
            def add(a: Column, k: Column) -> Column:
                return _let(a["w"] * ratio(k.cast("double")), lambda w: F.struct(w.alias("w"), (a["s"] + w).alias("s")))

            return F.aggregate(numbers, F.struct(one.alias("w"), zero.alias("s")), add, lambda a: a["s"])

        def find(numbers: Column, ratio: Callable[[Column], Column], rest: Column, sign: int) -> Column:
            """The number at which ``rest`` is used up; past the last step the last number."""

            def add(a: Column, k: Column) -> Column:
                goes = a["left"] >= 0
                return _let(
                    a["w"] * ratio(k.cast("double")),
                    lambda w: F.struct(
                        w.alias("w"),
                        F.when(goes, a["left"] - w).otherwise(a["left"]).alias("left"),
                        F.when(goes, k.cast("double") + sign).otherwise(a["k"]).alias("k"),
                    ),
                )

            begun = F.struct(one.alias("w"), rest.alias("left"), at["mode"].alias("k"))
            return F.aggregate(numbers, begun, add, lambda a: a["k"])

        def chosen(masses: Column) -> Column:
            # the point is laid off on the mode (1), then the numbers above, then those below
            point = x["u"] * (1 + masses["up"] + masses["down"]) - 1
            return _let(
                point,
                lambda p: F.when(p < 0, at["mode"])
                .when(p < masses["up"], find(step["up"], up, p, 1))
                .otherwise(find(step["down"], down, p - masses["up"], -1)),
            )

        return _let(F.struct(mass(step["up"], up).alias("up"), mass(step["down"], down).alias("down")), chosen)

    found = _let(given, lambda x: _let(located(x), lambda at: _let(steps(at), lambda step: walked(x, at, step))))
    return F.when((marked <= 0) | (drawn <= 0) | (total <= 0), zero).otherwise(found).cast("bigint")


def _left_counts(counts: Column, total: Column, drawn: Column, seed: int, level: int, node: Column) -> Column:
    """Shard counts of the left half: one conditional draw a shard."""

    def draw(a, item):
        u = uniform(F.lit(seed), F.lit(level), node, item["s"])
        k = hypergeometric(a["total"], item["c"], a["drawn"], u)
        return _let(
            k,
            lambda got: F.struct(
                (a["total"] - item["c"]).alias("total"),
                (a["drawn"] - got).alias("drawn"),
                F.concat(a["out"], F.array(got)).alias("out"),
            ),
        )

    begun = F.struct(
        total.cast("bigint").alias("total"), drawn.cast("bigint").alias("drawn"), F.array().cast("array<bigint>").alias("out")
    )
    items = F.transform(counts, lambda c, s: F.struct(c.alias("c"), s.cast("int").alias("s")))
    return F.aggregate(items, begun, draw, lambda a: a["out"])


def communication_matrix(blocks: DataFrame, n_blocks: int, rows: int, n_shards: int, seed: int) -> DataFrame:
    """(block, counts): how many rows of each block each shard takes; ``blocks`` has (block, n)."""
    spark = blocks.sparkSession
    depth = max(0, math.ceil(math.log2(max(1, n_blocks))))
    targets = [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]
    nodes = spark.range(1).select(
        F.lit(0).cast("bigint").alias("node"), F.lit(rows).cast("bigint").alias("n"), F.array(*[F.lit(t).cast("bigint") for t in targets]).alias("counts")
    )
    sums = (
        blocks.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "block", "n")
        .groupBy("level", F.expr(f"shiftright(block, {depth} - level)").alias("half"))
        .agg(F.sum("n").alias("n_left"))
    )
    sums = stored(sums)
    for level in range(depth):
        lefts = sums.where(F.col("level") == level + 1).select("half", "n_left")
        split = nodes.join(lefts, F.col("node") * 2 == F.col("half"), "left").select(
            "node", "n", "counts", F.coalesce("n_left", F.lit(0)).alias("n_left")
        )
        split = split.withColumn("left", _left_counts(F.col("counts"), F.col("n"), F.col("n_left"), seed, level, F.col("node")))
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("n_left").alias("n"), F.col("left").alias("counts")),
            F.struct(
                (F.col("node") * 2 + 1).alias("node"),
                (F.col("n") - F.col("n_left")).alias("n"),
                F.zip_with("counts", "left", lambda c, x: c - x).alias("counts"),
            ),
        )
        nodes = split.select(F.explode(halves).alias("h")).select("h.*").where("n > 0")
        if level % 3 == 2:
            nodes = stored(nodes)
    return stored(nodes.select(F.col("node").alias("block"), "counts"))


def uniform_shards(df: DataFrame, n_shards: int, seed: int = 11, block_rows: int = PART_ROWS) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1, counts at most one apart) and a gapless ``slot``.

    ``block_rows`` bounds what one task permutes: an input partition is cut into blocks of so many rows.
    The rows are written once, so that their numbers hold when an executor is lost.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    kept = free_names(df, "shard", "slot")
    base = stored(kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("__row"), F.monotonically_increasing_id().alias("__uid")))
    # what follows moves the numbers of the rows alone; the rows themselves are joined to their places once
    places = base.select(
        "__uid", F.shiftright("__uid", 33).alias("__pid"), F.col("__uid").bitwiseAND((1 << 33) - 1).alias("__idx")
    )
    # one row for each task that wrote the table
    parts = places.groupBy("__pid").agg(F.count(F.lit(1)).alias("rows")).withColumn("blocks", F.ceil(F.col("rows") / block_rows))
    parts = stored(parts.withColumn("first", F.sum("blocks").over(Window.orderBy("__pid")) - F.col("blocks")))
    rows, n_blocks = parts.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("blocks"), F.lit(0))).first()
    blocks = parts.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("j"), "first", "rows").select(
        (F.col("first") + F.col("j")).alias("block"), F.least(F.lit(block_rows), F.col("rows") - F.col("j") * block_rows).alias("n")
    )
    matrix = communication_matrix(blocks, int(n_blocks), int(rows), n_shards, seed)
    numbered = places.join(parts.select("__pid", "first"), "__pid").select(
        "__uid", (F.col("first") + F.floor(F.col("__idx") / block_rows)).alias("block")
    )
    local = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "__uid"), "__uid")
    placed = numbered.withColumn("__rn", F.row_number().over(local)).join(
        matrix.select(
            "block",
            F.transform(F.sequence(F.lit(1), F.lit(n_shards)), lambda s: F.aggregate(F.slice("counts", 1, s), F.lit(0).cast("bigint"), lambda a, c: a + c)).alias("ends"),
        ),
        "block",
    )
    dealt = placed.select(
        "__uid",
        F.size(F.filter("ends", lambda e: e < F.col("__rn"))).cast("int").alias("shard"),
    )
    base_size, larger = divmod(int(rows), n_shards)
    dealt = dealt.withColumn("__size", F.lit(base_size).cast("bigint") + (F.col("shard") < larger).cast("bigint"))
    order = [F.xxhash64(F.lit(seed), F.lit("shard"), "__uid"), F.col("__uid")]
    ranked = dealt_rank(dealt, ["shard"], "__size", order, "slot", block_rows).select("__uid", "shard", "slot")
    return base.join(ranked.hint("merge"), "__uid").select("__row.*", "shard", "slot")


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """The digest rows of the sharding query: law ``rows``, so ``grown_shard`` is null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return uniform_shards(facts, n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
