"""Audit, gate and publishing queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cueline import fixtures as fx
from cueline.catalog.matching import ILLUSTRATED, illustrated, terms_sql
from cueline.catalog.text import FENCED, mixed_cues
from cueline.fixtures import with_views
from cueline.functions import constants as k
from cueline.functions import text as tx
from cueline.operators import audits as au

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, views: str | None = None, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(views, sql) if views else sql
        return fn

    return register


VOWELS = "[aeiou]"

BOOKS = """
    bk AS (SELECT page_id // 5 AS book_id, min(page_id) AS first, max(length(url)) AS len FROM pages GROUP BY page_id // 5),
    books AS (SELECT book_id, 'b' || book_id AS id, CASE book_id % 4 WHEN 0 THEN './b' || book_id || '/' WHEN 1 THEN './x' || book_id || '/'
        WHEN 2 THEN 'https://s.org/b' || book_id ELSE './b' || book_id || '/' END AS url, 'T' AS title, CASE WHEN book_id % 6 <> 0 THEN 's' END AS subtitle,
        CASE WHEN book_id % 10 <> 3 THEN printf('20%02d.01.05', book_id * 7 % 30) END AS date, 'v' AS venue, '1h' AS duration, 1500 + len AS words, 10 AS height, book_id % 8 AS width,
        book_id % 3 AS spine_shade, book_id % 6 AS quotes, book_id % 3 = 0 AS single, book_id % 4 AS shelf_id, 'L' || book_id % 4 AS shelf_label,
        book_id AS place, book_id % 9 = 4 AS placeholder FROM bk),
    pg AS (SELECT page_id, page_id // 5 AS book_id, CASE page_id % 5 WHEN 0 THEN 'index.html' ELSE 'session-' || page_id % 5 || '.html' END AS name,
        replace(html, '</body>', '<h2>x</h2>') || CASE WHEN page_id % 10 = 0 THEN '<a href="session-1.html">1</a><a href="session-9.html">9</a>' ELSE '<a href="session-2.html">2</a>' END
        || CASE WHEN page_id % 3 <> 0 THEN '<a href="../#shelf-' || page_id // 5 % 4 || '">回到L' || page_id // 5 % 4 || '書架</a>' ELSE '' END
        || CASE WHEN page_id % 4 = 1 THEN '<p class="dropcap"><strong>A</strong></p>' ELSE '<meta og:title og:url twitter:card>' END
        || repeat('<img class="k" src="img-' || page_id || '.png">', (page_id % 5)::INT) || '<img src="img-' || page_id + 1 || '.png"><p>end **x**</p>' AS html FROM pages),
    im AS (SELECT page_id // 5 AS book_id, 'img-' || page_id || '.png' AS name, length(html) * 97 AS size, md5((page_id % 3)::VARCHAR) AS md5 FROM pages)"""


def books(spark, sf):
    p = fx.table(spark, sf, "pages")
    b = F.col("book_id")
    ids = p.groupBy(F.floor(F.col("page_id") / 5).cast("bigint").alias("book_id")).agg(
        F.max(F.length("url")).alias("len")
    )
    name = F.concat(F.lit("b"), b.cast("string"))
    return ids.select(
        "book_id",
        name.alias("id"),
        F.when(b % 4 == 1, F.concat(F.lit("./x"), b.cast("string"), F.lit("/")))
        .when(b % 4 == 2, F.concat(F.lit("https://s.org/"), name))
        .otherwise(F.concat(F.lit("./"), name, F.lit("/")))
        .alias("url"),
        F.lit("T").alias("title"),
        F.when(b % 6 != 0, "s").alias("subtitle"),
        F.when(b % 10 != 3, F.format_string("20%02d.01.05", b * 7 % 30)).alias("date"),
        F.lit("v").alias("venue"),
        F.lit("1h").alias("duration"),
        (F.col("len") + 1500).cast("bigint").alias("words"),
        F.lit(10).alias("height"),
        (b % 8).alias("width"),
        (b % 3).alias("spine_shade"),
        (b % 6).alias("quotes"),
        (b % 3 == 0).alias("single"),
        (b % 4).cast("string").alias("shelf_id"),
        F.concat(F.lit("L"), (b % 4).cast("string")).alias("shelf_label"),
        b.alias("place"),
        (b % 9 == 4).alias("placeholder"),
    )


def pages(spark, sf):
    n = F.col("page_id")
    book = F.floor(n / 5).cast("bigint")
    shelf = (book % 4).cast("string")
    num = n.cast("string")
    links = F.when(
        n % 10 == 0, '<a href="session-1.html">1</a><a href="session-9.html">9</a>'
    ).otherwise('<a href="session-2.html">2</a>')
    back = F.when(
        n % 3 != 0,
        F.concat(F.lit('<a href="../#shelf-'), shelf, F.lit('">回到L'), shelf, F.lit("書架</a>")),
    ).otherwise("")
    head = F.when(n % 4 == 1, '<p class="dropcap"><strong>A</strong></p>').otherwise(
        "<meta og:title og:url twitter:card>"
    )
    image = F.concat(F.lit('<img class="k" src="img-'), num, F.lit('.png">'))
    other = F.concat(F.lit('<img src="img-'), (n + 1).cast("string"), F.lit('.png"><p>end **x**</p>'))
    html = F.concat(
        F.replace("html", F.lit("</body>"), F.lit("<h2>x</h2>")),
        links,
        back,
        head,
        F.repeat(image, (n % 5).cast("int")),
        other,
    )
    name = F.when(n % 5 == 0, "index.html").otherwise(
        F.concat(F.lit("session-"), (n % 5).cast("string"), F.lit(".html"))
    )
    return fx.table(spark, sf, "pages").select("page_id", book.alias("book_id"), name.alias("name"), html.alias("html"))


def images(spark, sf):
    n = F.col("page_id")
    return fx.table(spark, sf, "pages").select(
        F.floor(n / 5).cast("bigint").alias("book_id"),
        F.concat(F.lit("img-"), n.cast("string"), F.lit(".png")).alias("name"),
        (F.length("html") * 97).cast("bigint").alias("size"),
        F.md5((n % 3).cast("string")).alias("md5"),
    )


def _prose(single: str) -> str:
    body = f"regexp_replace(html, '{au.NOT_PROSE}', '', 'g')"
    block = f"CASE WHEN {single} THEN regexp_extract_all({body}, '{au.PROSE_SINGLE}') ELSE regexp_extract_all({body}, '{au.PROSE}') END"
    text = f"array_to_string(list_transform({block}, lambda b: regexp_replace(b, '<[^>]+>', '', 'g')), chr(10))"
    return f"(length({text}) - length(regexp_replace({text}, '{VOWELS}', '', 'g')))"


DRIFT = f"""{BOOKS}, ct AS (SELECT pg.book_id, sum({_prose('single')})::BIGINT AS actual FROM pg JOIN books USING (book_id) WHERE single = (name = 'index.html') GROUP BY pg.book_id),
    dr AS (SELECT book_id, words, actual, abs(words - actual) / actual * 100 AS d, words > 0 AND actual > 0 AS known FROM books JOIN ct USING (book_id)),
    drift AS (SELECT book_id, words AS declared, actual, CASE WHEN known THEN round(d, 6) END AS drift_pct,
       CASE WHEN NOT known THEN 'skipped' WHEN d < 5 THEN 'healthy' WHEN d < 10 THEN 'warning' ELSE 'fail' END AS verdict FROM dr)"""


@query("words_drift", None, f"WITH {DRIFT} SELECT * FROM drift")
def words_drift(spark, sf):
    return au.words_drift(books(spark, sf), pages(spark, sf), VOWELS)


LOADS = f"""{BOOKS}, rf AS (SELECT DISTINCT book_id, name AS page, unnest(regexp_extract_all(html, 'src="([^"]+)"', 1)) AS image FROM pg),
    ld AS (SELECT pg.book_id, pg.name AS page, coalesce(sum(size), 0)::BIGINT AS bytes, coalesce(max(size), 0)::BIGINT AS largest, count(im.name) AS images
      FROM pg LEFT JOIN rf ON rf.book_id = pg.book_id AND rf.page = pg.name LEFT JOIN im ON im.book_id = rf.book_id AND im.name = rf.image GROUP BY pg.book_id, pg.name)"""


@query("page_image_load", None, f"WITH {LOADS} SELECT * FROM ld")
def page_image_load(spark, sf):
    return au.page_image_load(pages(spark, sf), images(spark, sf))


def _approved(spark, sf):
    return images(spark, sf).filter("book_id % 2 = 0").select("name")


DUPS = f"""{BOOKS}, du AS (SELECT book_id, md5, count(*) AS copies, bool_and(book_id % 2 = 0) AS soft, min(name) AS first FROM im GROUP BY book_id, md5 HAVING count(*) > 1)"""


@query("exact_dup_images", None, f"WITH {DUPS} SELECT * FROM du")
def exact_dup_images(spark, sf):
    return au.exact_dup_images(images(spark, sf), approved=_approved(spark, sf))


@query(
    "orphan_pages",
    None,
    f"""WITH {BOOKS}, rf AS (SELECT DISTINCT book_id, unnest(regexp_extract_all(html, 'href="(session-\\d+\\.html)"', 1)) AS name FROM pg WHERE name = 'index.html')
        SELECT book_id, name FROM pg WHERE name LIKE 'session%' AND (book_id, name) NOT IN (SELECT book_id, name FROM rf)""",
)
def orphan_pages(spark, sf):
    p = pages(spark, sf)
    refs = au.references(p.filter("name = 'index.html'"), r'href="(session-\d+\.html)"', ["book_id"])
    return au.orphans(p.filter("name LIKE 'session%'").select("book_id", "name"), refs, ["book_id", "name"])


@query(
    "dangling_links",
    None,
    """WITH rf AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages)
       SELECT page_id, link FROM rf WHERE link NOT IN (SELECT regexp_extract(url, '^https?://[^/]+(/[^?]*)', 1) FROM pages)""",
)
def dangling_links(spark, sf):
    """Links of the crawl that lead to no page of it."""
    p = fx.table(spark, sf, "pages")
    refs = au.references(p, r'href="([^"]+)"', ["page_id"], "link")
    have = p.select(F.regexp_extract("url", r"^https?://[^/]+(/[^?]*)", 1).alias("link"))
    return au.dangling(refs, have, ["link"]).select("page_id", "link")


COLLAPSE = r"""tk AS (SELECT book_id, name, unnest(regexp_extract_all(regexp_replace(html, '(?s)<head>.*?</head>', '', 'g'),
          '(?s)<img\b[^>]*>|<p\b[^>]*>.*?</p>|<h2\b[^>]*>.*?</h2>|<h3\b[^>]*>.*?</h3>')) AS t, generate_subscripts(regexp_extract_all(regexp_replace(html, '(?s)<head>.*?</head>', '', 'g'),
          '(?s)<img\b[^>]*>|<p\b[^>]*>.*?</p>|<h2\b[^>]*>.*?</h2>|<h3\b[^>]*>.*?</h3>'), 1) AS i FROM pg),
    g AS (SELECT *, starts_with(t, '<img') AS img, sum((NOT starts_with(t, '<img') AND regexp_replace(regexp_replace(t, '<[^>]+>', '', 'g'), '\s+', '', 'g') <> '')::INT)
          OVER (PARTITION BY book_id, name ORDER BY i) AS grp FROM tk),
    c AS (SELECT book_id, name, grp, count(*) FILTER (img) AS n FROM g GROUP BY book_id, name, grp),
    pc AS (SELECT pg.book_id, pg.name, coalesce(max(n), 0)::INT AS worst_run, coalesce(max(n), 0) <= 2 AS ok FROM pg LEFT JOIN c USING (book_id, name) GROUP BY pg.book_id, pg.name)"""


@query("page_collapse", None, f"WITH {BOOKS}, {COLLAPSE} SELECT book_id, name, worst_run, ok FROM pc")
def page_collapse(spark, sf):
    return au.page_collapse(pages(spark, sf))


_TEXT = ["id", "title", "subtitle", "date", "venue", "duration", "url"]
FIELDS = f"""{BOOKS}, bf AS (SELECT *, CASE WHEN regexp_matches(url, '^\\./.+/$') THEN regexp_extract(url, '^\\./(.+)/$', 1)
      ELSE nullif(regexp_extract(url, '/([^/]+)$', 1), '') END AS us FROM books),
    fr AS (SELECT book_id, 'id_matches_url' AS rule, coalesce(id = us, FALSE) AS ok FROM bf
      UNION ALL SELECT book_id, 'url_relative', starts_with(url, './') FROM bf UNION ALL SELECT book_id, 'spine_shade', spine_shade IN (0, 1) FROM bf
      UNION ALL SELECT book_id, 'quotes', quotes BETWEEN 3 AND 4 FROM bf
      {' '.join(f"UNION ALL SELECT book_id, 'has_{c}', coalesce({c}, '') <> '' FROM bf" for c in _TEXT)}
      {' '.join(f"UNION ALL SELECT book_id, 'positive_{c}', {c} > 0 FROM bf" for c in ('words', 'height', 'width'))})"""


@query("book_field_rules", None, f"WITH {FIELDS} SELECT book_id AS entity, rule, ok FROM fr")
def book_field_rules(spark, sf):
    return au.book_field_rules(books(spark, sf)).select("entity", "rule", "ok")


TEXTS = f"""{BOOKS}, tt AS (SELECT pg.book_id, count(*) FILTER (NOT contains(html, 'href="../#shelf-' || shelf_id || '"')) AS back_link,
      count(*) FILTER (NOT contains(html, '回到' || shelf_label || '書架')) AS back_label,
      count(*) FILTER (NOT (contains(html, 'og:title') AND contains(html, 'og:url') AND contains(html, 'twitter:card'))) AS meta_core,
      count(*) FILTER (contains(html, '<p class="dropcap"><strong>')) AS dropcap_plain,
      count(*) FILTER (regexp_matches(html, '(?:<p[^>]*>|<h[23]>)[^<]*\\*\\*[^*]+\\*\\*')) AS bold_converted,
      count(*) FILTER (NOT (contains(html, 'og:image') AND contains(html, 'twitter:image'))) AS meta_image FROM pg JOIN books USING (book_id) GROUP BY pg.book_id),
    tr AS ({' UNION ALL '.join(f"SELECT book_id, '{r}' AS rule, {r if r != 'meta_image' else '0'} = 0 AS ok, {r}::VARCHAR AS detail FROM tt" for r in ('back_link', 'back_label', 'meta_core', 'dropcap_plain', 'bold_converted', 'meta_image'))})"""


@query("page_text_rules", None, f"WITH {TEXTS} SELECT book_id AS entity, rule, ok, detail FROM tr")
def page_text_rules(spark, sf):
    return au.page_text_rules(books(spark, sf), pages(spark, sf))


SETS = """sref AS (SELECT DISTINCT book_id, unnest(regexp_extract_all(html, 'href="(session-\\d+\\.html)"', 1)) AS name FROM pg WHERE name = 'index.html'),
    ses AS (SELECT book_id, name FROM pg WHERE name LIKE 'session-%'),
    sr AS (SELECT b.book_id, 'index_exists' AS rule, EXISTS (SELECT 1 FROM pg WHERE pg.book_id = b.book_id AND name = 'index.html') AS ok FROM books b
      UNION ALL SELECT b.book_id, 'no_orphan_pages', NOT EXISTS (SELECT 1 FROM ses s WHERE s.book_id = b.book_id AND NOT EXISTS (SELECT 1 FROM sref r WHERE r.book_id = s.book_id AND r.name = s.name)) FROM books b
      UNION ALL SELECT b.book_id, 'no_dangling_links', NOT EXISTS (SELECT 1 FROM sref r WHERE r.book_id = b.book_id AND NOT EXISTS (SELECT 1 FROM ses s WHERE r.book_id = s.book_id AND r.name = s.name)) FROM books b
      UNION ALL SELECT b.book_id, 'single_not_split', NOT EXISTS (SELECT 1 FROM ses s WHERE s.book_id = b.book_id) FROM books b WHERE single
      UNION ALL SELECT pg.book_id, 'single_article', contains(html, '<article') FROM pg JOIN books b ON b.book_id = pg.book_id WHERE pg.name = 'index.html' AND single)"""


@query("page_set_rules", None, f"WITH {BOOKS}, {SETS} SELECT book_id AS entity, rule, ok FROM sr")
def page_set_rules(spark, sf):
    return au.page_set_rules(books(spark, sf), pages(spark, sf)).select("entity", "rule", "ok")


IMAGES = """ibad AS (SELECT book_id, max(bytes) AS most FROM ld GROUP BY book_id),
    ir AS (SELECT b.book_id, 'page_load' AS rule, coalesce(most, 0) < 10485760 AS ok FROM books b LEFT JOIN ibad USING (book_id)
      UNION ALL SELECT book_id, 'image_size', NOT EXISTS (SELECT 1 FROM im WHERE im.book_id = b.book_id AND size > 1048576) FROM books b
      UNION ALL SELECT book_id, 'no_double_images', NOT EXISTS (SELECT 1 FROM im x JOIN im y ON x.book_id = y.book_id AND x.md5 = y.md5 AND x.name < y.name WHERE x.book_id = b.book_id) FROM books b
      UNION ALL SELECT book_id, 'no_unused_images', NOT EXISTS (SELECT 1 FROM im WHERE im.book_id = b.book_id AND NOT EXISTS (SELECT 1 FROM rf WHERE rf.book_id = im.book_id AND rf.image = im.name)) FROM books b)"""


@query(
    "audit_books",
    None,
    f"""WITH {FIELDS.replace('WITH ', '')}, {TEXTS[len(BOOKS) + 2:]}, {SETS}, {DRIFT[len(BOOKS) + 2:]}, {LOADS[len(BOOKS) + 2:]}, {IMAGES}, {COLLAPSE}
    SELECT rule, count(*) AS checked, count(*) FILTER (NOT ok) AS failed FROM (SELECT rule, ok FROM fr UNION ALL SELECT rule, ok FROM tr UNION ALL SELECT rule, ok FROM sr
      UNION ALL SELECT 'words_drift', verdict <> 'fail' FROM drift UNION ALL SELECT rule, ok FROM ir
      UNION ALL SELECT 'no_image_rows', NOT EXISTS (SELECT 1 FROM pc WHERE pc.book_id = b.book_id AND NOT pc.ok) FROM books b) GROUP BY rule""",
)
def audit_books(spark, sf):
    rules = au.audit_books(books(spark, sf), pages(spark, sf), images(spark, sf), VOWELS)
    return rules.groupBy("rule").agg(
        F.count("*").alias("checked"), F.count_if(~F.col("ok")).alias("failed")
    )


@query(
    "shelf_order",
    None,
    f"""WITH {BOOKS}, l AS (SELECT *, last_value(CASE WHEN date IS NOT NULL THEN book_id END IGNORE NULLS) OVER w AS prev_id, last_value(date IGNORE NULLS) OVER w AS prev_date FROM books WHERE NOT placeholder
          WINDOW w AS (PARTITION BY shelf_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT shelf_id::VARCHAR AS shelf_id, book_id, date, prev_id, prev_date FROM l WHERE date < prev_date""",
)
def shelf_order(spark, sf):
    return au.shelf_order(books(spark, sf))


@query(
    "shelf_summary",
    None,
    f"""WITH {BOOKS} SELECT shelf_id::VARCHAR AS shelf_id, count(*) AS books, sum(words)::BIGINT AS words, min(date) AS first_date, max(date) AS last_date FROM books WHERE NOT placeholder GROUP BY shelf_id""",
)
def shelf_summary(spark, sf):
    return au.shelf_summary(books(spark, sf))


@query(
    "run_summary",
    "runs",
    """SELECT stage, count(*) AS runs, count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'fail') AS fail, count(*) FILTER (status = 'warn') AS warn FROM runs GROUP BY stage""",
)
def run_summary(spark, sf):
    return au.run_summary(fx.runs(spark, sf))


@query(
    "red_flags",
    "doc_lines",
    """WITH f AS (SELECT unnest(['tion', 'eau', 'the ']) AS flag)
       SELECT doc_id, line_no, flag FROM doc_lines, f WHERE contains(line, flag) AND NOT contains(lower(line), 'que')""",
)
def red_flags(spark, sf):
    return au.red_flags(fx.doc_lines(spark, sf), ["tion", "eau", "the "], ["que"])


#: The lines of the gate: of the plain lines every tenth shows one image of its own, ``n1.png``.
GATE_LINES = ILLUSTRATED.replace("WHEN line_no % 11 = 6", "WHEN line_no % 10 = 5 THEN '![e](n1.png)' WHEN line_no % 11 = 6")
#: Widths over the same lines.
GATE_WIDTHS = FENCED[FENCED.index("fenced AS") :].replace("FROM mixed", "FROM il")


def gate_lines(spark, sf):
    n = F.col("line_no")
    plain = (n % 9 != 4) & ~(n % 8).isin(1, 2, 3) & (n % 10 == 5)
    return illustrated(spark, sf).withColumn("line", F.when(plain, "![e](n1.png)").otherwise(F.col("line")))


def gate_notes(spark, sf):
    n = F.col("doc_id")
    return fx.table(spark, sf, "documents").select(
        "doc_id",
        F.lit("n1.png").alias("name"),
        F.when(n % 4 == 1, "described").otherwise("inserted").alias("status"),
        tx.terms(F.when(n % 3 == 0, F.lit("words of no document 4711")).otherwise(F.col("text"))).alias("terms"),
    )


@query(
    "publish_gate",
    "doc_lines",
    f"""WITH {GATE_LINES}, {GATE_WIDTHS}, ru AS (SELECT doc_id, chapter, anchor_no, sum(len(refs)) AS n FROM ax WHERE len(refs) > 0 GROUP BY ALL),
    ex AS (SELECT doc_id, chapter, line_no, unnest(refs) AS ref, unnest(range(len(refs))) AS pos FROM ax),
    lg AS (SELECT doc_id, n::BIGINT AS seq, lag(n::BIGINT) OVER (PARTITION BY doc_id, chapter ORDER BY line_no, pos) AS prev FROM (SELECT *, nullif(regexp_extract(ref, '(\\d{{2,}})\\.\\w+$', 1), '') AS n FROM ex) WHERE n IS NOT NULL),
    docs AS (SELECT DISTINCT doc_id FROM doc_lines),
    sr AS (SELECT doc_id, count(*) FILTER (WHERE CASE WHEN doc_id % 5 = 0 THEN 'open' ELSE 'done' END <> 'done') AS undone FROM docs GROUP BY doc_id),
    vi AS (SELECT *, CASE WHEN NOT starts_with(line, '![') THEN line END AS p FROM il WHERE regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> ''),
    cx AS (SELECT *, last_value(p IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
        first_value(p IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM vi),
    tt AS (SELECT doc_id, {terms_sql("concat_ws(' ', b, a)")} AS ct FROM cx WHERE line = '![e](n1.png)'),
    nt AS (SELECT doc_id, {terms_sql("CASE WHEN doc_id % 3 = 0 THEN 'words of no document 4711' ELSE text END")} AS nt FROM documents),
    wk AS (SELECT doc_id FROM tt JOIN nt USING (doc_id) WHERE len(list_intersect(ct, nt)) / greatest(1, least(len(ct), len(nt))) < {k.RELEVANCE_FAIL})
    SELECT docs.doc_id AS entity, 'no_stacks' AS rule, NOT EXISTS (SELECT 1 FROM ru WHERE ru.doc_id = docs.doc_id AND n > 2) AS ok FROM docs
    UNION ALL SELECT docs.doc_id, 'in_order', NOT EXISTS (SELECT 1 FROM lg WHERE lg.doc_id = docs.doc_id AND seq < prev) FROM docs
    UNION ALL SELECT doc_id, 'stages_done', undone = 0 FROM sr UNION ALL SELECT doc_id, 'no_pending', doc_id % 7 <> 0 FROM docs
    UNION ALL SELECT doc_id, 'full_width', sum(changes) = 0 FROM conv GROUP BY doc_id
    UNION ALL SELECT doc_id, 'images_inserted', NOT (doc_id % 4 = 1 AND doc_id IN (SELECT doc_id FROM tt)) FROM docs
    UNION ALL SELECT doc_id, 'images_relevant', doc_id NOT IN (SELECT doc_id FROM wk) FROM docs""",
)
def publish_gate(spark, sf):
    """All seven rules of the gate for every document."""
    n = F.col("doc_id")
    stages = fx.table(spark, sf, "documents").select(
        "doc_id",
        F.lit("clean").alias("stage"),
        F.when(n % 5 == 0, "open").otherwise("done").alias("status"),
        (n % 7 == 0).alias("pending"),
    )
    return au.publish_gate(gate_lines(spark, sf), stages, gate_notes(spark, sf)).select("entity", "rule", "ok")


@query("publish_gate_all_rules")
def publish_gate_all(spark, sf):
    lines = illustrated(spark, sf)
    docs = fx.table(spark, sf, "documents")
    stages = docs.select(
        "doc_id", F.lit("clean").alias("stage"), F.lit("done").alias("status"), F.lit(False).alias("pending")
    )
    notes = docs.select(
        "doc_id", F.lit("n1.png").alias("name"), F.lit("inserted").alias("status"), tx.terms(F.col("text")).alias("terms")
    )
    return (
        au.publish_gate(lines, stages, notes)
        .groupBy("rule")
        .agg(F.count("*").alias("checked"), F.count_if(~F.col("ok")).alias("failed"))
    )


def _anchors(spark, sf):
    v = F.col("vec_id")
    return fx.table(spark, sf, "embeddings").select(
        (v % 50).alias("doc_id"),
        F.concat(F.lit("f"), (v % 450).cast("string"), F.lit(".png")).alias("file"),
        F.when(v % 17 == 0, -1).otherwise(v * 7 % 40).cast("bigint").alias("after_line"),
    )


def _notes(spark, sf):
    v = F.col("vec_id")
    return fx.table(spark, sf, "embeddings").filter("vec_id % 10 <> 9").select(
        (v % 50).alias("doc_id"),
        F.concat(F.lit("f"), v.cast("string"), F.lit(".png")).alias("file"),
        F.when(v % 12 == 5, "error").when(v % 3 == 0, "described").otherwise("anchored").alias("status"),
    )


@query(
    "check_placement",
    "doc_lines",
    """WITH an AS (SELECT vec_id % 50 AS doc_id, 'f' || vec_id % 450 || '.png' AS file, CASE WHEN vec_id % 17 = 0 THEN -1 ELSE vec_id * 7 % 40 END AS after_line FROM embeddings),
    nt AS (SELECT vec_id % 50 AS doc_id, 'f' || vec_id || '.png' AS file, CASE WHEN vec_id % 12 = 5 THEN 'error' WHEN vec_id % 3 = 0 THEN 'described' ELSE 'anchored' END AS status FROM embeddings WHERE vec_id % 10 <> 9),
    ct AS (SELECT doc_id, count(*) AS n FROM doc_lines WHERE regexp_replace(line, '\\s+', '', 'g') <> '' AND NOT starts_with(line, '![') GROUP BY doc_id),
    j AS (SELECT an.*, CASE WHEN nt.status IS NULL THEN 'no_note' WHEN nt.status = 'error' THEN 'note_error' WHEN after_line <> -1 AND (after_line < 0 OR after_line >= coalesce(n, 0)) THEN 'out_of_range' END AS problem
          FROM an LEFT JOIN nt USING (doc_id, file) LEFT JOIN ct USING (doc_id))
    SELECT doc_id, problem, file AS item FROM j WHERE problem IS NOT NULL
    UNION ALL SELECT doc_id, 'stacked', after_line::VARCHAR FROM j WHERE problem IS NULL AND after_line <> -1 GROUP BY doc_id, after_line HAVING count(*) > 2
    UNION ALL SELECT doc_id, 'placed_twice', file FROM j WHERE problem IS NULL AND after_line <> -1 GROUP BY doc_id, file HAVING count(*) > 1
    UNION ALL SELECT doc_id, 'no_anchor', file FROM nt WHERE status IN ('described', 'anchored') AND (doc_id, file) NOT IN (SELECT doc_id, file FROM an)""",
)
def check_placement(spark, sf):
    return au.check_placement(fx.doc_lines(spark, sf), _anchors(spark, sf), _notes(spark, sf))


@query(
    "insert_figures",
    "doc_lines",
    """WITH an AS (SELECT vec_id % 50 AS doc_id, 'f' || vec_id || '.png' AS file, vec_id * 7 % 40 AS after_line FROM embeddings),
    p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS after_line FROM doc_lines WHERE regexp_replace(line, '\\s+', '', 'g') <> '' AND NOT starts_with(line, '!['))
    SELECT doc_id, line_no AS seq_line, '0' AS seq_part, line FROM doc_lines
    UNION ALL SELECT doc_id, p.line_no, '1' || file, '![c](' || file || ')' FROM an JOIN p USING (doc_id, after_line)""",
)
def insert_figures(spark, sf):
    v = F.col("vec_id")
    anchors = fx.table(spark, sf, "embeddings").select(
        (v % 50).alias("doc_id"),
        F.concat(F.lit("f"), v.cast("string"), F.lit(".png")).alias("file"),
        (v * 7 % 40).alias("after_line"),
        F.lit("c").alias("caption"),
    )
    return au.insert_figures(fx.doc_lines(spark, sf), anchors)


@query(
    "check_insertion",
    "doc_lines",
    """WITH an AS (SELECT DISTINCT vec_id % 50 AS doc_id, 'f' || vec_id || '.png' AS file, vec_id * 7 % 40 AS after_line FROM embeddings),
    c AS (SELECT doc_id, count(*) AS n, max(CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END) AS edited FROM doc_lines WHERE regexp_replace(line, '\\s+', '', 'g') <> '' AND NOT starts_with(line, '![') GROUP BY doc_id),
    d AS (SELECT DISTINCT doc_id FROM doc_lines)
    SELECT d.doc_id AS entity, 'content_unchanged' AS rule, coalesce(edited, 0) = 0 AS ok FROM d LEFT JOIN c USING (doc_id)
    UNION ALL SELECT doc_id, 'ideographs_unchanged', coalesce(edited, 0) = 0 FROM d LEFT JOIN c USING (doc_id)
    UNION ALL SELECT d.doc_id, 'images_once', NOT EXISTS (SELECT 1 FROM an WHERE an.doc_id = d.doc_id AND an.after_line >= coalesce(c.n, 0)) FROM d LEFT JOIN c USING (doc_id)""",
)
def check_insertion(spark, sf):
    """Images put in place; in every fourth document a line of content changed meanwhile."""
    v = F.col("vec_id")
    anchors = fx.table(spark, sf, "embeddings").select(
        (v % 50).alias("doc_id"),
        F.concat(F.lit("f"), v.cast("string"), F.lit(".png")).alias("file"),
        (v * 7 % 40).alias("after_line"),
        F.lit("c").alias("caption"),
    )
    before = fx.doc_lines(spark, sf)
    image = F.startswith("line", F.lit("!["))
    edited = F.when((F.col("doc_id") % 4 == 1) & ~image & (tx.strip(F.col("line")) != ""), F.concat("line", F.lit("的"))).otherwise(F.col("line"))
    after = au.insert_figures(before, anchors).select("doc_id", F.concat_ws("/", F.lpad(F.col("seq_line").cast("string"), 12, "0"), "seq_part").alias("line_no"), edited.alias("line"))
    ranked = after.withColumn("line_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")).cast("bigint"))
    return au.check_insertion(before, ranked, anchors).select("entity", "rule", "ok")


def _translation(spark, sf):
    segments = fx.cues(spark, sf).select("session_id", F.col("idx").alias("i"), "start_ms", "end_ms")
    parts = mixed_cues(spark, sf).select(
        "session_id", (F.col("idx") + F.when(F.col("idx") % 7 == 6, 100).otherwise(0)).alias("i"), "text"
    ).filter("i % 5 <> 4")
    drops = segments.filter("i % 6 = 5").select("session_id", "i")
    return segments, parts, drops


TRANSLATION = """sg AS (SELECT session_id, idx AS i, start_ms, end_ms FROM cues),
    pt AS (SELECT session_id, idx + CASE WHEN idx % 7 = 6 THEN 100 ELSE 0 END AS i, text FROM mixed WHERE (idx + CASE WHEN idx % 7 = 6 THEN 100 ELSE 0 END) % 5 <> 4),
    dp AS (SELECT session_id, i FROM sg WHERE i % 6 = 5)"""


def _mixed_sql():
    from cueline.catalog.text import MIXED

    return MIXED


@query(
    "assemble_translation",
    "cues",
    f"""WITH {_mixed_sql()}, {TRANSLATION} SELECT session_id, i, start_ms, end_ms, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text
        FROM (SELECT * FROM sg ANTI JOIN dp USING (session_id, i)) JOIN pt USING (session_id, i)""",
)
def assemble_translation(spark, sf):
    rows, _problems = au.assemble_translation(*_translation(spark, sf))
    return rows


@query(
    "translation_problems",
    "cues",
    f"""WITH {_mixed_sql()}, {TRANSLATION} SELECT session_id, i, 'unknown' AS problem FROM pt ANTI JOIN sg USING (session_id, i)
        UNION ALL SELECT session_id, i, 'dropped' FROM pt SEMI JOIN dp USING (session_id, i)
        UNION ALL SELECT session_id, i, 'untranslated' FROM (SELECT * FROM sg ANTI JOIN dp USING (session_id, i)) x ANTI JOIN pt USING (session_id, i)""",
)
def translation_problems(spark, sf):
    _rows, problems = au.assemble_translation(*_translation(spark, sf))
    return problems


@query(
    "verify_timecodes",
    "cues",
    """SELECT session_id, idx AS i FROM cues WHERE idx % 3 = 0""",
)
def verify_timecodes(spark, sf):
    """Rows whose end was moved by 7 ms are found."""
    cues = fx.cues(spark, sf)
    moved = cues.withColumn("end_ms", F.col("end_ms") + F.when(F.col("idx") % 3 == 0, 100007).otherwise(0))
    return au.verify_timecodes(moved.withColumnRenamed("idx", "i"), cues).select("session_id", "i")
