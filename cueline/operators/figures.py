"""Matching figures to text, near-duplicates and image order in documents."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.functions import constants as k
from cueline.functions import text as tx
from cueline.operators.intervals import spread_heavy
from cueline.operators.scan import (
    CHUNK_ROWS,
    as_list,
    nearest_value,
    row_chunk,
    running_sum,
    scan,
    with_neighbours,
)
from cueline.session import cut_lineage, settle

IMAGE_REF = r"!\[[^\]]*\]\(([^)]+)\)"


# --- text relevance ------------------------------------------------------------


def containment(a: Column, b: Column) -> Column:
    """Shared terms over the smaller set; 0 when either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return shared / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def verdict(score: Column) -> Column:
    return (
        F.when(score >= k.RELEVANCE_HEALTHY, "healthy")
        .when(score >= k.RELEVANCE_FAIL, "warning")
        .otherwise("fail")
    )


def line_type(line: Column) -> Column:
    return (
        F.when(F.startswith(line, F.lit("### ")), "h3")
        .when(F.startswith(line, F.lit("## ")), "h2")
        .when(F.startswith(line, F.lit("# ")), "h1")
        .otherwise("para")
    )


def context_lines(
    lines: DataFrame, by: str | Sequence[str] = "doc_id", rows: int = CHUNK_ROWS
) -> DataFrame:
    """Terms of each possible place: the line with the line after it.

    Top headings are no place for a figure but still serve as following line.
    """
    by = as_list(by)
    led = with_neighbours(
        lines, by, ["line_no"], row_chunk("line_no", rows), following={"next_line": "line"}
    )
    text = F.concat_ws(" ", "line", "next_line")
    return led.filter(~line_type(F.col("line")).isin("h1", "h2")).select(
        *by, "line_no", tx.terms(text).alias("terms")
    )


def containment_match(
    figures: DataFrame,
    lines: DataFrame,
    by: str | Sequence[str] = "doc_id",
    heavy_rows: int = 200_000,
) -> DataFrame:
    """Score of every figure and line of one document that share a term.

    ``figures`` has ``fig_id, terms`` and ``lines`` has ``line_no, terms``.  The
    pairs come from an inverted index, so pairs that share nothing (score 0)
    are never formed.  Frequent terms are spread over several tasks.
    """
    by = as_list(by)
    f = figures.select(*by, "fig_id", F.size("terms").alias("fig_n"), F.explode("terms").alias("term"))
    ln = settle(lines).select(
        *by, "line_no", F.size("terms").alias("line_n"), F.explode("terms").alias("term")
    )
    f, ln, keys = spread_heavy(f, ln, [*by, "term"], heavy_rows)
    shared = f.join(ln, keys).groupBy(*by, "fig_id", "line_no", "fig_n", "line_n").agg(
        F.count("*").alias("shared")
    )
    score = F.col("shared") / F.greatest(F.lit(1), F.least("fig_n", "line_n"))
    return shared.select(*by, "fig_id", "line_no", "shared", score.alias("score"))


def best_lines(scored: DataFrame, figures: DataFrame, by: str | Sequence[str] = "doc_id") -> DataFrame:
    """The best line of each figure; ties go to the earlier line.

    A figure that shares no term with any line has score 0, no line and the verdict that goes with it.
    """
    best = F.max(F.struct("score", (-F.col("line_no")).alias("less")))
    ident = [*as_list(by), "fig_id"]
    score = F.coalesce(F.col("b.score"), F.lit(0.0))
    return (
        figures.select(*ident)
        .join(scored.groupBy(*ident).agg(best.alias("b")), ident, "left")
        .select(*ident, (-F.col("b.less")).alias("line_no"), score.alias("score"), verdict(score).alias("verdict"))
    )


# --- fingerprints ----------------------------------------------------------------


def _pack(bits: Column) -> Column:
    return F.aggregate(
        bits,
        F.lit(0).cast("bigint"),
        lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("bigint")),
    )


def difference_hash(pixels: Column, rows: int = 8, cols: int = 9) -> Column:
    """64 bits: is each grey value of a ``rows x cols`` grid above its right neighbour?"""
    places = [r * cols + c for r in range(rows) for c in range(cols - 1)]
    grid = F.array(*[F.lit(p) for p in places])
    return _pack(F.transform(grid, lambda p: F.get(pixels, p) > F.get(pixels, p + 1)))


def ring_hash(vector: Column, size: int = 64) -> Column:
    """The same for a plain vector, compared around a ring; bit i is element i."""
    places = F.sequence(F.lit(size - 1), F.lit(0), F.lit(-1))
    return _pack(F.transform(places, lambda p: F.get(vector, p) > F.get(vector, (p + 1) % size)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def _bands(bands: int) -> list[tuple[int, int]]:
    """Bit offsets and widths that split 64 bits as evenly as possible."""
    width, extra = divmod(64, bands)
    out, at = [], 0
    for i in range(bands):
        size = width + (1 if i < extra else 0)
        out.append((at, size))
        at += size
    return out


def similar_hashes(
    hashes: DataFrame,
    by: str | Sequence[str] = "session_id",
    max_bits: int = 6,
    bands: int = 8,
    heavy_rows: int = 200_000,
) -> DataFrame:
    """Pairs of distinct 64-bit hashes at most ``max_bits`` apart, exactly.

    The bits are split into ``bands``.  Few differing bits leave at least
    ``bands - max_bits`` bands equal, so every combination of that many bands is
    a join key (16 bits wide for 8 bands).  A pair is kept at the first
    combination it shares.  More bands mean wider keys and fewer candidates.
    """
    by = as_list(by)
    bands = max(bands, max_bits + 1)
    parts = _bands(bands)
    need = bands - max_bits

    def band(column: str, i: int) -> Column:
        at, size = parts[i]
        return F.shiftrightunsigned(F.col(column), at).bitwiseAND(F.lit((1 << size) - 1))

    combos = list(combinations(range(bands), need))
    keys = F.array(
        *[
            F.struct(
                F.lit(n).alias("combo"),
                F.concat_ws("-", *[band("hash", i).cast("string") for i in combo]).alias("key"),
            )
            for n, combo in enumerate(combos)
        ]
    )
    distinct = settle(hashes.select(*by, "hash").distinct(), 1)
    keyed = distinct.select(*by, "hash", F.explode(keys).alias("c")).select(*by, "hash", "c.*")
    left, right, on = spread_heavy(
        keyed, keyed.withColumnRenamed("hash", "hash_b"), [*by, "combo", "key"], heavy_rows
    )
    pairs = left.join(right, on).filter(
        (F.col("hash") < F.col("hash_b")) & (hamming(F.col("hash"), F.col("hash_b")) <= max_bits)
    )
    equal = [band("hash", i) == band("hash_b", i) for i in range(bands)]
    # combinations are in lexical order: the first shared one is made of the
    # lowest equal bands
    lowest = F.slice(
        F.filter(
            F.array(*[F.when(same, F.lit(i)) for i, same in enumerate(equal)]),
            lambda i: i.isNotNull(),
        ),
        1,
        need,
    )
    listed = F.array(*[F.array(*[F.lit(i) for i in combo]) for combo in combos])
    first = F.get(listed, F.col("combo"))
    return pairs.filter(first == lowest).select(
        *by, F.col("hash").alias("hash_a"), "hash_b", hamming(F.col("hash"), F.col("hash_b")).alias("bits")
    )


def _page_runs(figures: DataFrame, by: list[str], max_gap: int) -> DataFrame:
    """Copies of one figure on nearby pages, reduced to runs of pages.

    A figure has the same hash and the same terms.  A copy without a page is
    near every other copy, so its whole figure is one run.
    """
    figure = [*by, "hash", "sig"]
    rows = settle(figures.withColumn("sig", F.xxhash64(F.array_sort("terms"))), 1)
    wild = rows.groupBy(*figure).agg(F.bool_or(F.col("deck_page").isNull()).alias("wild"))
    joined = rows.join(wild, figure)
    order = ["page", "file"]
    placed = joined.withColumn("page", F.coalesce("deck_page", F.lit(0)).cast("bigint"))
    lagged = with_neighbours(
        placed, figure, order, row_chunk("page", CHUNK_ROWS), previous={"p_page": "page"}
    )
    opens = F.col("p_page").isNull() | (~F.col("wild") & (F.col("page") - F.col("p_page") > max_gap))
    numbered = scan(
        lagged,
        figure,
        order,
        row_chunk("page", CHUNK_ROWS),
        run=running_sum(F.when(opens, 1).otherwise(0)),
    )
    return numbered


def near_duplicates(
    figures: DataFrame,
    by: str | Sequence[str] = "session_id",
    max_bits: int = 6,
    min_jaccard: float = 0.5,
    max_gap: int = 4,
    bands: int = 8,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(members, edges, review)`` of look-alike figures.

    ``figures`` has ``file, hash, terms, deck_page``.  Copies of one figure are
    first reduced to runs of nearby pages, so a large group of copies costs one
    row per run and is never paired with itself.  ``members`` maps each file to
    the first file of its run, ``edges`` links runs that look and read alike on
    nearby pages, ``review`` lists look-alike runs that fail one of the tests.
    """
    by = as_list(by)
    numbered = settle(_page_runs(figures, by, max_gap), 1)
    run_key = [*by, "hash", "sig", "run"]
    runs = settle(
        numbered.groupBy(*run_key).agg(
            F.min(F.struct("page", "file")).alias("first"),
            F.min("page").alias("lo"),
            F.max("page").alias("hi"),
            F.bool_or("wild").alias("wild"),
            F.first("terms").alias("terms"),
            F.count("*").alias("copies"),
        ),
        1,
    ).withColumn("rep", F.col("first.file"))
    members = numbered.select(*run_key, "file", "page").join(
        runs.select(*run_key, "rep"), run_key
    ).select(*by, "file", "page", "rep")

    distinct = similar_hashes(runs, by, max_bits, bands)
    same = runs.groupBy(*by, "hash").agg(F.count("*").alias("n")).filter("n > 1").select(
        *by, F.col("hash").alias("hash_a"), F.col("hash").alias("hash_b"), F.lit(0).alias("bits")
    )

    def side(name: str) -> DataFrame:
        return runs.select(
            *by,
            F.col("hash").alias(f"hash_{name}"),
            *[F.col(c).alias(f"{c}_{name}") for c in ("rep", "lo", "hi", "wild", "terms")],
        )

    pairs = (
        distinct.unionByName(same)
        .join(side("a"), [*by, "hash_a"])
        .join(side("b"), [*by, "hash_b"])
        .filter((F.col("hash_a") != F.col("hash_b")) | (F.col("rep_a") < F.col("rep_b")))
    )
    gap = F.when(F.col("wild_a") | F.col("wild_b"), 0).otherwise(
        F.greatest(F.lit(0), F.col("lo_b") - F.col("hi_a"), F.col("lo_a") - F.col("hi_b"))
    )
    scored = pairs.select(
        *by,
        F.col("rep_a").alias("a"),
        F.col("rep_b").alias("b"),
        "bits",
        jaccard(F.col("terms_a"), F.col("terms_b")).alias("jaccard"),
        gap.alias("gap"),
    )
    scored = settle(scored, 1)
    alike = (F.col("jaccard") >= min_jaccard) & (F.col("gap") <= max_gap)
    return members, scored.filter(alike), scored.filter(~alike)


def connected_components(
    edges: DataFrame, by: str | Sequence[str] = "session_id"
) -> DataFrame:
    """Smallest member of each component: ``(node, root)``.

    Every round takes the smallest label among the neighbours and then follows
    labels to their own labels, so long chains halve.  Each round is written
    out, which also cuts the lineage.  It ends when no label changes.
    """
    by = as_list(by)
    links = cut_lineage(
        edges.select(*by, F.col("a").alias("node"), F.col("b").alias("other"))
        .unionByName(edges.select(*by, F.col("b").alias("node"), F.col("a").alias("other")))
        .distinct()
    )
    labels = cut_lineage(
        links.groupBy(*by, "node").agg(F.least(F.min("other"), F.col("node")).alias("root"))
    )
    while True:
        seen = links.join(
            labels.select(*by, F.col("node").alias("other"), F.col("root").alias("r")), [*by, "other"]
        )
        near = seen.groupBy(*by, "node").agg(F.min("r").alias("r"))
        merged = labels.join(near, [*by, "node"], "left").select(
            *by, "node", F.col("root").alias("was"), F.least("root", "r").alias("root")
        )
        step = settle(merged, 1)
        jump = step.select(*by, F.col("node").alias("root"), F.col("root").alias("further"))
        updated = cut_lineage(
            step.join(jump, [*by, "root"], "left").select(
                *by, "node", "was", F.least("root", F.coalesce("further", "root")).alias("root")
            )
        )
        labels = updated.select(*by, "node", "root")
        if updated.filter("root <> was").isEmpty():
            return labels


def duplicate_groups(
    members: DataFrame, edges: DataFrame, by: str | Sequence[str] = "session_id"
) -> DataFrame:
    """Each file with the file kept for its group: the lowest page, then name.

    ``duplicate_of`` is null for the kept file and for files without a double.
    """
    by = as_list(by)
    roots = connected_components(edges, by).withColumnRenamed("node", "rep")
    grouped = members.join(roots, [*by, "rep"], "left").withColumn(
        "group", F.coalesce("root", "rep")
    )
    grouped = settle(grouped.select(*by, "file", "page", "group"))
    kept = grouped.groupBy(*by, "group").agg(F.min(F.struct("page", "file")).alias("k"))
    keep_file = F.col("k.file")
    return grouped.join(kept, [*by, "group"]).select(
        *by, "file", F.when(keep_file != F.col("file"), keep_file).alias("duplicate_of")
    )


def slug_match(notes: DataFrame, files: DataFrame) -> DataFrame:
    """Note sets ``(notes_id, file)`` whose files are at least half among a book's.

    At least one file must match; names are compared without folders.
    """
    name = F.element_at(F.split("file", "/"), -1)
    own = settle(notes.select("notes_id", name.alias("name")).distinct())
    sizes = own.groupBy("notes_id").agg(F.count("*").alias("n"))
    deployed = files.select("book_id", name.alias("name")).distinct()
    hits = own.join(deployed, "name").groupBy("notes_id", "book_id").agg(F.count("*").alias("hits"))
    return (
        hits.join(sizes, "notes_id")
        .filter(F.col("hits") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2)))
        .select("notes_id", "book_id", "hits")
    )


# --- images in documents ------------------------------------------------------------


def is_local_image(ref: Column) -> Column:
    return ~F.startswith(ref, F.lit("http")) & (ref != "cover.jpg")


def image_lines(
    lines: DataFrame,
    by: str | Sequence[str] = "doc_id",
    rows: int = CHUNK_ROWS,
    substance: str = r"[一-鿿㐀-䶿]|[A-Za-z]{2,}|\d{2,}",
) -> DataFrame:
    """Lines with their local images, the text they hang on and their chapter.

    A line of real text becomes the anchor for the images after it.  Lines with
    only remote images or only marks leave the anchor as it is.
    """
    by = as_list(by)
    refs = F.regexp_extract_all("line", F.lit(IMAGE_REF), 1)
    local = F.filter(refs, is_local_image)
    rest = tx.strip(F.regexp_replace("line", IMAGE_REF, ""))
    solid = F.regexp_like(rest, F.lit(substance)) & (F.size(local) == 0)
    marked = lines.filter(tx.strip(F.col("line")) != "").select(
        *by,
        "line_no",
        local.alias("refs"),
        F.when(solid, rest).alias("anchor_text"),
        F.startswith("line", F.lit("## ")).cast("int").alias("is_head"),
    )
    return scan(
        marked,
        by,
        ["line_no"],
        row_chunk("line_no", rows),
        anchor_no=running_sum(F.col("anchor_text").isNotNull().cast("int")),
        anchor=nearest_value(F.col("anchor_text"), inclusive=True),
        chapter=running_sum(F.col("is_head")),
    ).filter(F.size("refs") > 0)


def anchor_runs(
    lines: DataFrame,
    by: str | Sequence[str] = "doc_id",
    approved: DataFrame | None = None,
    found: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Images hanging on one line: their number and whether all are approved.

    ``approved(name)`` lists file names a person grouped on purpose, ``found`` are the image lines where they are known.
    """
    by = as_list(by)
    images = (image_lines(lines, by, **options) if found is None else found).select(
        *by, "chapter", "anchor_no", "anchor", F.explode("refs").alias("ref")
    )
    images = images.withColumn("name", F.element_at(F.split("ref", "/"), -1))
    if approved is None:
        images = images.withColumn("ok", F.lit(False))
    else:
        marks = approved.select("name").distinct().withColumn("ok", F.lit(True))
        images = images.join(marks, "name", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    return images.groupBy(*by, "chapter", "anchor_no").agg(
        F.first(F.coalesce("anchor", F.lit(""))).alias("anchor"),
        F.count("*").alias("images"),
        F.every("ok").alias("all_approved"),
    )


def overstacked(runs: DataFrame, most: int = k.MAX_PER_ANCHOR) -> DataFrame:
    return runs.filter((F.col("images") > most) & ~F.col("all_approved"))


def distribution_report(
    runs: DataFrame, by: str | Sequence[str] = "doc_id", most: int = k.MAX_PER_ANCHOR
) -> DataFrame:
    return runs.groupBy(*as_list(by)).agg(
        F.sum("images").alias("total_images"),
        F.count("*").alias("distinct_anchors"),
        F.max("images").alias("worst_run"),
        (F.count_if((F.col("images") > most) & ~F.col("all_approved")) == 0).alias("ok"),
    )


def order_inversions(
    lines: DataFrame,
    by: str | Sequence[str] = "doc_id",
    pages: DataFrame | None = None,
    rows: int = CHUNK_ROWS,
    found: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Neighbouring images of a chapter whose original order runs backwards.

    The order is the deck page from ``pages(name, deck_page)``, else the number
    before the file extension; images with neither are passed over.  ``found`` are the image lines where they are known.
    """
    by = as_list(by)
    images = (image_lines(lines, by, **options) if found is None else found).select(
        *by, "chapter", "line_no", F.posexplode("refs").alias("pos", "ref")
    )
    number = F.regexp_extract("ref", r"(\d{2,})\.\w+$", 1)
    seq = F.when(number != "", number.cast("bigint"))
    if pages is not None:
        images = images.withColumn("name", F.element_at(F.split("ref", "/"), -1)).join(
            pages.groupBy("name").agg(F.min("deck_page").alias("deck_page")), "name", "left"
        )
        seq = F.coalesce("deck_page", seq)
    placed = images.withColumn("seq", seq).filter("seq IS NOT NULL")
    lagged = with_neighbours(
        placed,
        [*by, "chapter"],
        ["line_no", "pos"],
        row_chunk("line_no", rows),
        previous={"prev_ref": "ref", "prev_seq": "seq"},
    )
    return lagged.filter("seq < prev_seq").select(
        *by, "chapter", "prev_ref", "prev_seq", "ref", "seq"
    )


def figure_context(
    lines: DataFrame, by: str | Sequence[str] = "doc_id", rows: int = CHUNK_ROWS
) -> DataFrame:
    """Image lines with the nearest text line on each side."""
    by = as_list(by)
    visible = lines.filter(tx.strip(F.col("line")) != "")
    prose = F.when(~F.startswith("line", F.lit("![")), F.col("line"))
    around = scan(
        visible,
        by,
        ["line_no"],
        row_chunk("line_no", rows),
        before=nearest_value(prose),
        after=nearest_value(prose, reverse=True),
    )
    ref = F.regexp_extract("line", r"^!\[[^\]]*\]\(([^)]+)\)\s*$", 1)
    return (
        around.withColumn("ref", ref)
        .filter((F.col("ref") != "") & is_local_image(F.col("ref")))
        .select(*by, "line_no", "ref", F.concat_ws(" ", "before", "after").alias("context"))
    )
