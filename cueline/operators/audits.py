"""Corpus audits: every rule is a DataFrame of ``(entity, rule, ok, detail)``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.functions import constants as k
from cueline.functions import text as tx
from cueline.operators import figures as fg
from cueline.operators.cleaning import residual_halfwidth
from cueline.operators.scan import (
    CHUNK_ROWS,
    as_list,
    nearest_value,
    row_chunk,
    scan,
    with_position,
)
from cueline.session import settle

TAG = r"<[^>]+>"
PROSE = r"(?s)<p\b[^>]*>.*?</p>|<h3\b[^>]*>.*?</h3>"
PROSE_SINGLE = r"(?s)<p\b[^>]*>.*?</p>|<h2\b[^>]*>.*?</h2>|<h3\b[^>]*>.*?</h3>"
NOT_PROSE = r"(?s)<head>.*?</head>|<script\b.*?</script>|<style\b.*?</style>"


def orphans(have: DataFrame, referenced: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows nothing refers to."""
    return have.join(referenced.select(*on).distinct(), list(on), "left_anti")


def dangling(referenced: DataFrame, have: DataFrame, on: Sequence[str]) -> DataFrame:
    """References to rows that do not exist."""
    return referenced.join(have.select(*on).distinct(), list(on), "left_anti")


def references(pages: DataFrame, pattern: str, keep: Sequence[str], name: str = "name") -> DataFrame:
    """Distinct captures of ``pattern`` in each page's HTML."""
    return pages.select(
        *keep, F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), 1))).alias(name)
    )


def prose_chars(html: Column, char_class: str, single: Column) -> Column:
    """Characters of a class inside the text blocks of a page."""
    body = F.regexp_replace(html, NOT_PROSE, "")
    blocks = F.when(single, F.regexp_extract_all(body, F.lit(PROSE_SINGLE), 0)).otherwise(
        F.regexp_extract_all(body, F.lit(PROSE), 0)
    )
    text = F.array_join(F.transform(blocks, lambda b: F.regexp_replace(b, TAG, "")), "\n")
    return tx.count_class(text, char_class)


def words_drift(
    books: DataFrame, pages: DataFrame, char_class: str = k.IDEOGRAPH_EXT_CLASS
) -> DataFrame:
    """Declared against counted characters of each book's prose pages."""
    with_flag = pages.join(books.select("book_id", "single"), "book_id")
    prose = with_flag.filter(F.col("single") == (F.col("name") == "index.html"))
    counted = prose.groupBy("book_id").agg(
        F.sum(prose_chars(F.col("html"), char_class, F.col("single"))).alias("actual")
    )
    drift = F.abs(F.col("words") - F.col("actual")) / F.col("actual") * 100
    known = (F.col("words") > 0) & (F.col("actual") > 0)
    return books.join(counted, "book_id").select(
        "book_id",
        F.col("words").alias("declared"),
        "actual",
        F.when(known, F.round(drift, 6)).alias("drift_pct"),
        F.when(~known, "skipped")
        .when(drift < 5, "healthy")
        .when(drift < 10, "warning")
        .otherwise("fail")
        .alias("verdict"),
    )


def page_image_load(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Bytes of the images each page refers to, and its largest one."""
    refs = references(pages, r'src="([^"]+)"', ["book_id", F.col("name").alias("page")], "image")
    sizes = images.select("book_id", F.col("name").alias("image"), "size")
    loads = refs.join(sizes, ["book_id", "image"]).groupBy("book_id", "page").agg(
        F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.count("*").alias("images")
    )
    return pages.select("book_id", F.col("name").alias("page")).join(
        loads, ["book_id", "page"], "left"
    ).na.fill(0, ["bytes", "largest", "images"])


def exact_dup_images(
    images: DataFrame, by: Sequence[str] = ("book_id",), approved: DataFrame | None = None
) -> DataFrame:
    """Groups of byte-identical images; ``soft`` when a person approved all.

    The digest stands for the bytes before anything is shuffled.
    """
    by = list(by)
    rows = images.select(*by, "name", "md5")
    if approved is None:
        rows = rows.withColumn("ok", F.lit(False))
    else:
        marks = approved.select("name").distinct().withColumn("ok", F.lit(True))
        rows = rows.join(marks, "name", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    return (
        rows.groupBy(*by, "md5")
        .agg(F.count("*").alias("copies"), F.every("ok").alias("soft"), F.min("name").alias("first"))
        .filter("copies > 1")
    )


def page_collapse(pages: DataFrame, most: int = k.MAX_PER_ANCHOR) -> DataFrame:
    """Longest row of images on a page without text between them."""
    body = F.regexp_replace("html", r"(?s)<head>.*?</head>", "")
    unit = r"(?s)<img\b[^>]*>|<p\b[^>]*>.*?</p>|<h2\b[^>]*>.*?</h2>|<h3\b[^>]*>.*?</h3>"
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("worst"))

    def step(acc: Column, token: Column) -> Column:
        image = F.startswith(token, F.lit("<img"))
        text = ~image & (tx.strip(F.regexp_replace(token, TAG, "")) != "")
        now = F.when(image, acc["now"] + 1).when(text, 0).otherwise(acc["now"])
        return F.struct(now.alias("now"), F.greatest(acc["worst"], now).alias("worst"))

    worst = F.aggregate(F.regexp_extract_all(body, F.lit(unit), 0), start, step, lambda a: a["worst"])
    return pages.select("book_id", "name", worst.alias("worst_run"), (worst <= most).alias("ok"))


def _rule(df: DataFrame, entity: str, rule: str, ok: Column, detail: Column) -> DataFrame:
    return df.select(
        F.col(entity).alias("entity"),
        F.lit(rule).alias("rule"),
        F.coalesce(ok, F.lit(False)).alias("ok"),
        detail.cast("string").alias("detail"),
    )


def book_field_rules(books: DataFrame) -> DataFrame:
    """Rules on the record of a book, one output row per rule."""
    tail = F.regexp_extract(F.regexp_replace("url", "/+$", ""), "/([^/]+)$", 1)
    url_slug = F.when(F.regexp_like("url", F.lit(r"^\./.+/$")), F.regexp_extract("url", r"^\./(.+)/$", 1)).otherwise(
        F.when(tail != "", tail)
    )
    rules = [
        ("id_matches_url", F.col("id") == url_slug, url_slug),
        ("url_relative", F.startswith("url", F.lit("./")), F.col("url")),
        ("spine_shade", F.col("spine_shade").isin(0, 1), F.col("spine_shade")),
        ("quotes", F.col("quotes").between(3, 4), F.col("quotes")),
    ]
    rules += [(f"has_{c}", F.coalesce(c, F.lit("")) != "", F.col(c)) for c in k.BOOK_TEXT_FIELDS]
    rules += [(f"positive_{c}", F.col(c) > 0, F.col(c)) for c in k.BOOK_COUNT_FIELDS]
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                F.coalesce(ok, F.lit(False)).alias("ok"),
                detail.cast("string").alias("detail"),
            )
            for name, ok, detail in rules
        ]
    )
    return books.select(F.col("book_id").alias("entity"), F.explode(entries).alias("r")).select(
        "entity", "r.rule", "r.ok", "r.detail"
    )


def page_text_rules(books: DataFrame, pages: DataFrame) -> DataFrame:
    """Rules every page of a book must meet; detail is the number that do not."""
    html = F.col("html")
    has = lambda needle: F.contains(html, needle)
    back = F.concat(F.lit('href="../#shelf-'), F.col("shelf_id"), F.lit('"'))
    label = F.concat(F.lit("回到"), F.col("shelf_label"), F.lit("書架"))
    tests = {
        "back_link": has(back),
        "back_label": has(label),
        "meta_core": reduce(lambda a, b: a & b, [has(F.lit(m)) for m in k.META_CORE]),
        "dropcap_plain": ~has(F.lit('<p class="dropcap"><strong>')),
        "bold_converted": ~F.regexp_like(html, F.lit(r"(?:<p[^>]*>|<h[23]>)[^<]*\*\*[^*]+\*\*")),
    }
    image_meta = reduce(lambda a, b: a & b, [has(F.lit(m)) for m in k.META_IMAGE])
    joined = pages.join(books.select("book_id", "shelf_id", "shelf_label"), "book_id")
    counted = joined.groupBy("book_id").agg(
        *[F.count_if(~F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()],
        F.count_if(~image_meta).alias("meta_image"),
    )
    entries = F.array(
        *[
            F.struct(F.lit(n).alias("rule"), (F.col(n) == 0).alias("ok"), F.col(n).alias("bad"))
            for n in tests
        ],
        # advice only: never a failure
        F.struct(F.lit("meta_image").alias("rule"), F.lit(True).alias("ok"), F.col("meta_image").alias("bad")),
    )
    return counted.select(F.col("book_id").alias("entity"), F.explode(entries).alias("r")).select(
        "entity", "r.rule", "r.ok", F.col("r.bad").cast("string").alias("detail")
    )


def page_set_rules(books: DataFrame, pages: DataFrame) -> DataFrame:
    """Index present, pages and links matching, and no split single-speaker books."""
    names = pages.select("book_id", "name")
    sessions = names.filter(F.regexp_like("name", F.lit(r"^session-\d+\.html$")))
    index = pages.filter("name = 'index.html'")
    linked = references(index, r'href="(session-\d+\.html)"', ["book_id"])

    def counted(df: DataFrame, rule: str) -> DataFrame:
        bad = books.select("book_id").join(
            df.groupBy("book_id").agg(F.count("*").alias("bad")), "book_id", "left"
        )
        n = F.coalesce("bad", F.lit(0))
        return _rule(bad, "book_id", rule, n == 0, n)

    key = ["book_id", "name"]
    has_index = books.select("book_id").join(
        index.select("book_id", F.lit(True).alias("there")), "book_id", "left"
    )
    single = books.filter("single").select("book_id")
    article = index.join(single, "book_id", "left_semi")
    split = sessions.join(single, "book_id", "left_semi").groupBy("book_id").agg(F.count("*").alias("n"))
    unsplit = single.join(split, "book_id", "left")
    return (
        _rule(has_index, "book_id", "index_exists", F.col("there").isNotNull(), F.lit(""))
        .unionByName(counted(orphans(sessions, linked, key), "no_orphan_pages"))
        .unionByName(counted(dangling(linked, sessions, key), "no_dangling_links"))
        .unionByName(
            _rule(unsplit, "book_id", "single_not_split", F.coalesce("n", F.lit(0)) == 0, F.coalesce("n", F.lit(0)))
        )
        .unionByName(
            _rule(article, "book_id", "single_article", F.contains("html", F.lit("<article")), F.lit(""))
        )
    )


def image_rules(
    books: DataFrame, pages: DataFrame, images: DataFrame, approved: DataFrame | None = None
) -> DataFrame:
    """Budgets, doubles, unused images and rows of images of each book."""
    load = page_image_load(pages, images).groupBy("book_id").agg(F.max("bytes").alias("most"))
    large = images.groupBy("book_id").agg(F.count_if(F.col("size") > 1024 * 1024).alias("n"))
    doubles = exact_dup_images(images, approved=approved).groupBy("book_id").agg(
        F.count_if(~F.col("soft")).alias("n")
    )
    refs = references(pages, r'src="([^"]+)"', ["book_id"])
    unused = (
        orphans(images.filter("name <> 'cover.jpg'").select("book_id", "name"), refs, ["book_id", "name"])
        .groupBy("book_id")
        .agg(F.count("*").alias("n"))
    )
    rows = page_collapse(pages).groupBy("book_id").agg(F.count_if(~F.col("ok")).alias("n"))
    all_books = books.select("book_id")
    n = F.coalesce("n", F.lit(0))
    loads = all_books.join(load, "book_id", "left")
    most = F.coalesce("most", F.lit(0))
    out = _rule(loads, "book_id", "page_load", most < 10 * 1024 * 1024, most)
    for rule, df in (
        ("image_size", large),
        ("no_double_images", doubles),
        ("no_unused_images", unused),
        ("no_image_rows", rows),
    ):
        out = out.unionByName(_rule(all_books.join(df, "book_id", "left"), "book_id", rule, n == 0, n))
    return out


def audit_books(
    books: DataFrame,
    pages: DataFrame,
    images: DataFrame,
    char_class: str = k.IDEOGRAPH_EXT_CLASS,
    approved: DataFrame | None = None,
) -> DataFrame:
    """All book rules in one long table."""
    drift = words_drift(books, pages, char_class)
    return (
        book_field_rules(books)
        .unionByName(page_set_rules(books, pages))
        .unionByName(page_text_rules(books, pages))
        .unionByName(
            _rule(drift, "book_id", "words_drift", F.col("verdict") != "fail", F.col("verdict"))
        )
        .unionByName(image_rules(books, pages, images, approved))
    )


def shelf_order(
    books: DataFrame, by: str = "shelf_id", order: str = "place", rows: int = CHUNK_ROWS
) -> DataFrame:
    """Books dated earlier than the dated book before them on the shelf."""
    real = books.filter("NOT placeholder")
    dated = F.when(F.coalesce("date", F.lit("")) != "", F.struct("book_id", "date"))
    lagged = scan(real, by, [order], row_chunk(order, rows), prev=nearest_value(dated))
    return lagged.filter((F.col("date") != "") & (F.col("date") < F.col("prev.date"))).select(
        by, "book_id", "date", F.col("prev.book_id").alias("prev_id"), F.col("prev.date").alias("prev_date")
    )


def shelf_summary(books: DataFrame, by: str = "shelf_id") -> DataFrame:
    return books.filter("NOT placeholder").groupBy(by).agg(
        F.count("*").alias("books"),
        F.sum("words").alias("words"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def run_summary(runs: DataFrame, by: Sequence[str] = ("stage",)) -> DataFrame:
    """Runs, passes, failures and warnings per stage."""
    status = F.col("status")
    return runs.groupBy(*by).agg(
        F.count("*").alias("runs"),
        *[F.count_if(status == s).alias(s) for s in ("pass", "fail", "warn")],
    )


def red_flags(
    lines: DataFrame,
    flags: Sequence[str] = tuple(k.RED_FLAGS),
    exempt: Sequence[str] = tuple(k.PLACEHOLDER_MARKS),
    keep: Sequence[str] = ("doc_id", "line_no"),
) -> DataFrame:
    """Lines holding a flagged phrase, unless the line is marked as placeholder."""
    low = F.lower("line")
    spared = reduce(lambda a, b: a | b, [F.contains(low, F.lit(e.lower())) for e in exempt])
    hits = F.filter(
        F.array(*[F.when(F.contains("line", F.lit(f)), F.lit(f)) for f in flags]),
        lambda f: f.isNotNull(),
    )
    return lines.filter(~spared).select(*keep, F.explode(hits).alias("flag"))


def publish_gate(
    lines: DataFrame, stages: DataFrame, notes: DataFrame, by: str = "doc_id"
) -> DataFrame:
    """Rules a document must pass before it is published.

    ``stages(doc, stage, status, pending)`` holds the stages of a document,
    ``notes(doc, name, status, terms)`` its images.
    """
    # every rule reads the lines; runs and order read the image lines, without the text they hang on
    lines = settle(lines, 0)
    found_images = settle(fg.image_lines(lines, by).withColumn("anchor", F.lit("")).select(by, "line_no", "chapter", "anchor_no", "anchor", "refs"), 0)
    docs = lines.select(by).distinct()
    width = residual_halfwidth(lines, by)
    runs = fg.anchor_runs(lines, by, found=found_images)
    stacked = fg.overstacked(runs).groupBy(by).agg(F.count("*").alias("n"))
    backward = fg.order_inversions(lines, by, found=found_images).groupBy(by).agg(F.count("*").alias("n"))
    state = stages.groupBy(by).agg(
        F.count_if(F.coalesce("status", F.lit("")) != "done").alias("undone"),
        F.count_if("pending").alias("pending"),
    )
    # a reference is looked up as it stands, then by its base name
    context = fg.figure_context(lines, by).withColumn("name", F.element_at(F.split("ref", "/"), -1))
    noted = F.struct("status", "terms").alias("note")
    exact = notes.select(by, F.col("name").alias("ref"), noted)
    based = notes.select(by, "name", noted.alias("base"))
    found = F.coalesce("note", "base")
    matched = settle(
        context.join(exact, [by, "ref"], "left")
        .join(based, [by, "name"], "left")
        .select(by, "context", found["status"].alias("status"), found["terms"].alias("terms"))
    )
    inserted = matched.groupBy(by).agg(
        F.count_if(F.coalesce("status", F.lit("")) != "inserted").alias("n")
    )
    score = fg.containment(F.col("terms"), tx.terms(F.col("context")))
    weak = matched.filter("terms IS NOT NULL").groupBy(by).agg(
        F.count_if(score < k.RELEVANCE_FAIL).alias("n")
    )

    def rule(name: str, df: DataFrame, column: str) -> DataFrame:
        n = F.coalesce(column, F.lit(0))
        return _rule(docs.join(df, by, "left"), by, name, n == 0, n)

    return (
        rule("full_width", width, "residual")
        .unionByName(rule("no_stacks", stacked, "n"))
        .unionByName(rule("in_order", backward, "n"))
        .unionByName(rule("stages_done", state, "undone"))
        .unionByName(rule("no_pending", state, "pending"))
        .unionByName(rule("images_inserted", inserted, "n"))
        .unionByName(rule("images_relevant", weak, "n"))
    )


def check_placement(
    lines: DataFrame,
    anchors: DataFrame,
    notes: DataFrame,
    by: str = "doc_id",
    most: int = k.MAX_PER_ANCHOR,
) -> DataFrame:
    """Problems of proposed image places: ``(doc, problem, item)``.

    ``anchors(file, after_line)`` places images behind content lines counted
    from 0 (-1 leaves one out), ``notes(file, status)`` lists the images.
    """
    content = lines.filter(
        (tx.strip(F.col("line")) != "") & ~F.startswith("line", F.lit("!["))
    ).groupBy(by).agg(F.count("*").alias("__n"))
    joined = settle(anchors.join(notes, [by, "file"], "left").join(content, by, "left"))
    line = F.col("after_line")
    problem = (
        F.when(F.col("status").isNull(), "no_note")
        .when(F.col("status") == "error", "note_error")
        .when((line != -1) & ((line < 0) | (line >= F.coalesce("__n", F.lit(0)))), "out_of_range")
    )
    bad = joined.withColumn("problem", problem)
    found = bad.filter("problem IS NOT NULL").select(by, "problem", F.col("file").alias("item"))
    usable = bad.filter("problem IS NULL AND after_line <> -1")
    stacked = usable.groupBy(by, "after_line").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    double = usable.groupBy(by, "file").agg(F.count("*").alias("n")).filter("n > 1")
    described = notes.filter(F.col("status").isin("described", "anchored"))
    lacking = described.join(anchors.select(by, "file").distinct(), [by, "file"], "left_anti")
    return (
        found.unionByName(
            stacked.select(by, F.lit("stacked").alias("problem"), line.cast("string").alias("item"))
        )
        .unionByName(double.select(by, F.lit("placed_twice").alias("problem"), F.col("file").alias("item")))
        .unionByName(lacking.select(by, F.lit("no_anchor").alias("problem"), F.col("file").alias("item")))
    )


def insert_figures(lines: DataFrame, anchors: DataFrame, by: str = "doc_id") -> DataFrame:
    """The document with image lines behind their content lines.

    Every old line is kept as it is; ``seq_line`` and ``seq_part`` order the result.
    """
    content = lines.filter((tx.strip(F.col("line")) != "") & ~F.startswith("line", F.lit("![")))
    placed = with_position(content, by, ["line_no"], row_chunk("line_no"), "after_line", 0)
    marks = anchors.filter("after_line >= 0").join(placed.select(by, "after_line", "line_no"), [by, "after_line"])
    images = marks.select(
        by,
        F.col("line_no").alias("seq_line"),
        F.concat(F.lit("1"), "file").alias("seq_part"),
        F.concat(F.lit("!["), "caption", F.lit("]("), "file", F.lit(")")).alias("line"),
    )
    old = lines.select(by, F.col("line_no").alias("seq_line"), F.lit("0").alias("seq_part"), "line")
    return old.unionByName(images)


def check_insertion(before: DataFrame, after: DataFrame, files: DataFrame, by: str = "doc_id") -> DataFrame:
    """Whether inserting images left a document as it was: ``(entity, rule, ok, detail)``.

    ``before`` and ``after`` hold ``line_no, line``, ``files`` the images put in.  Content lines must be the same in the same
    order, the number of ideographs too, and every image must be there once.
    """

    def content(lines: DataFrame, name: str) -> DataFrame:
        kept = lines.filter((tx.strip(F.col("line")) != "") & ~F.startswith("line", F.lit("![")))
        return with_position(kept, by, ["line_no"], row_chunk("line_no"), "n", 0).select(by, "n", F.col("line").alias(name))

    both = content(before, "old").join(content(after, "new"), [by, "n"], "full")
    count = lambda c: tx.count_class(F.coalesce(F.col(c), F.lit("")), k.IDEOGRAPH_CLASS)
    compared = both.groupBy(by).agg(
        F.count_if(~F.col("old").eqNullSafe(F.col("new"))).alias("moved"), (F.sum(count("new")) - F.sum(count("old"))).alias("gained")
    )
    images = after.select(by, F.explode(F.regexp_extract_all("line", F.lit(r"\(([^()]+)\)"), 1)).alias("file"))
    there = images.join(files.select(by, "file").distinct(), [by, "file"]).groupBy(by, "file").agg(F.count("*").alias("n"))
    wrong = files.select(by, "file").distinct().join(there, [by, "file"], "left").groupBy(by).agg(
        F.count_if(F.coalesce("n", F.lit(0)) != 1).alias("wrong")
    )
    docs = before.select(by).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = docs.join(compared, by, "left").join(wrong, by, "left")
    return (
        _rule(rows, by, "content_unchanged", zero("moved") == 0, zero("moved"))
        .unionByName(_rule(rows, by, "ideographs_unchanged", zero("gained") == 0, zero("gained")))
        .unionByName(_rule(rows, by, "images_once", zero("wrong") == 0, zero("wrong")))
    )


def assemble_translation(
    segments: DataFrame, parts: DataFrame, drops: DataFrame, by: str | Sequence[str] = "session_id"
) -> tuple[DataFrame, DataFrame]:
    """``(rows, problems)``: translated segments with their original times.

    ``segments(i, start_ms, end_ms)``, ``parts(i, text)``, ``drops(i)``.  A
    translation of an unknown or dropped segment is a problem; a kept segment
    without one is listed as untranslated.
    """
    by = as_list(by)
    key = [*by, "i"]
    kept = segments.join(drops.select(*key).distinct(), key, "left_anti")
    live = settle(kept.join(parts, key, "left"))
    rows = live.filter("text IS NOT NULL").withColumn("text", tx.strip(F.col("text")))
    unknown = parts.join(segments, key, "left_anti").select(*key, F.lit("unknown").alias("problem"))
    dropped = parts.join(drops.select(*key).distinct(), key, "left_semi").select(
        *key, F.lit("dropped").alias("problem")
    )
    missing = live.filter("text IS NULL").select(*key, F.lit("untranslated").alias("problem"))
    return rows.select(*key, "start_ms", "end_ms", "text"), unknown.unionByName(dropped).unionByName(missing)


def verify_timecodes(
    rows: DataFrame, original: DataFrame, by: str | Sequence[str] = "session_id"
) -> DataFrame:
    """Rows whose times are not those of an original segment."""
    times = [*as_list(by), "start_ms", "end_ms"]
    return rows.join(original.select(*times).distinct(), times, "left_anti")
