"""Text rules as column expressions (no Python per row)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueline.functions import constants as k


def pattern(body: str, ignore_case: bool = False) -> str:
    """Character classes follow Unicode, as they do in the original rules."""
    return ("(?iuU)" if ignore_case else "(?U)") + body


def any_of(patterns: Sequence[str], ignore_case: bool = False) -> str:
    # one look at the start for all that must begin there, not one for each at every character
    begun = [p[1:] for p in patterns if p.startswith("^") and "|" not in p]
    ways = [f"(?:{p})" for p in patterns if not p.startswith("^") or "|" in p]
    if begun:
        ways.insert(0, "^(?:" + "|".join(f"(?:{p})" for p in begun) + ")")
    return pattern("(?:" + "|".join(ways) + ")", ignore_case)


def bound(value: Column, rule: Callable[[Column], Column]) -> Column:
    """``rule(value)`` with the value made once for a row, however often the rule names it."""
    return F.transform(F.array(value), rule)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, pattern(r"^\s+|\s+$"), "")


def squeeze_spaces(text: Column) -> Column:
    return F.regexp_replace(strip(text), " {2,}", " ")


def no_space(text: Column) -> Column:
    return F.regexp_replace(text, pattern(r"\s+"), "")


def no_space_length(text: Column) -> Column:
    return F.length(no_space(text))


def count_class(text: Column, char_class: str) -> Column:
    """How many characters of the text belong to ``char_class`` (a ``[...]``)."""
    return F.length(text) - F.length(F.regexp_replace(text, char_class, ""))


def pairs_array(pairs: Sequence[tuple[str, str]]) -> Column:
    return F.array(
        *[F.struct(F.lit(w).alias("wrong"), F.lit(r).alias("right")) for w, r in pairs]
    )


def apply_dictionary(text: Column, entries: Column) -> Column:
    """Struct ``(text, hits)`` after replacing every entry in order.

    Hits are counted on the text as it stands when an entry's turn comes.
    """
    start = F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("hits"))

    def step(acc: Column, entry: Column) -> Column:
        now = acc["text"]
        found = (
            (F.length(now) - F.length(F.replace(now, entry["wrong"], F.lit(""))))
            / F.length(entry["wrong"])
        ).cast("bigint")
        return F.struct(
            F.replace(now, entry["wrong"], entry["right"]).alias("text"),
            (acc["hits"] + found).alias("hits"),
        )

    return F.aggregate(entries, start, step)


def has_prefix(text: Column, prefixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(text, F.lit(p)) for p in prefixes])


def strip_wrapper_prefix(text: Column, prefixes: Sequence[str]) -> Column:
    """Remove the longest matching prefix once, then leading separators."""
    result = text
    for prefix in sorted(prefixes, key=len):
        rest = F.regexp_replace(
            F.substring(text, len(prefix) + 1, 2**31 - 1), f"^[{k.STRIP_AFTER_PREFIX}]+", ""
        )
        result = F.when(F.startswith(text, F.lit(prefix)), rest).otherwise(result)
    return result


def is_short(text: Column, least: int = 3) -> Column:
    return F.length(text) < least


def is_garbled(
    text: Column,
    wide_class: str = k.WIDE_CLASS,
    noise_class: str = k.NOISE_GLYPH_CLASS,
    exotic_class: str = k.EXOTIC_CLASS,
) -> Column:
    """True when any garble rule matches."""
    wide = count_class(text, wide_class)
    size = no_space_length(text)
    # Spark makes what two rules share ahead of the test for blank lines
    ratio = F.try_divide(wide, size)
    return (
        (size == 0)
        | ((ratio < k.WIDE_RATIO_MIN) & (size > k.MIN_CHARS_FOR_RATIO))
        | F.contains(text, F.lit(k.REPLACEMENT_CHAR))
        | (count_class(text, noise_class) > k.NOISE_GLYPH_MAX)
        | F.regexp_like(text, F.lit(exotic_class))
        | (
            F.regexp_like(text, F.lit(pattern(k.LONG_LATIN)))
            & (ratio < k.LONG_LATIN_WIDE_MAX)
        )
    )


def is_garbled_english(text: Column, latin_class: str = k.LATIN_CLASS) -> Column:
    """The garble rule of English transcripts: undecodable, or too few Latin letters."""
    size = no_space_length(text)
    return (
        (size == 0)
        | F.contains(text, F.lit(k.REPLACEMENT_CHAR))
        | ((F.try_divide(count_class(text, latin_class), size) < k.WIDE_RATIO_MIN) & (size > k.MIN_CHARS_FOR_RATIO))
    )


def is_english_hallucination(text: Column) -> Column:
    def judged(t: Column) -> Column:
        few = bound(
            no_space_length(t), lambda size: (count_class(t, "[A-Za-z]") / size < k.LATIN_RATIO_MIN) & (size > k.LATIN_RATIO_CHARS)
        )
        return (
            (t == "")
            | F.regexp_like(t, F.lit(k.NON_LATIN_CLASS))
            | F.regexp_like(t, F.lit(any_of(k.ENGLISH_HALLUCINATIONS, True)))
            | few
        )

    return bound(strip(text), judged)


def is_italian_hallucination(text: Column) -> Column:
    return F.regexp_like(strip(text), F.lit(any_of(k.ITALIAN_HALLUCINATIONS, True))) | (
        F.length(F.regexp_replace(text, r"[^\p{L}\p{N}_]", "")) < 3
    )


def is_notes_noise(text: Column, lang: str) -> Column:
    t = strip(text)
    noise = (
        (t == "")
        | F.regexp_like(t, F.lit(pattern(k.NOTES_PUNCTUATION)))
        | F.regexp_like(t, F.lit(pattern(k.NOTES_JUNK, True)))
        | F.regexp_like(t, F.lit(pattern(k.NOTES_HALLUCINATIONS, True)))
        | F.contains(F.lower(t), F.lit("amara.org"))
    )
    if lang == "zh":
        noise = noise | (count_class(t, k.FOREIGN_SCRIPT_CLASS) >= 2)
    return noise


def is_batch_dropped(text: Column) -> Column:
    """Batch rule: a drop prefix, or mostly not ideographs and over 5 characters."""

    def judged(whole: Column, t: Column) -> Column:
        ratio = count_class(whole, k.IDEOGRAPH_CLASS) / F.length(t)
        return (t == "") | has_prefix(t, k.DROP_PREFIXES) | ((ratio < 0.25) & (F.length(whole) > 5))

    return bound(text, lambda whole: bound(strip(whole), lambda t: judged(whole, t)))


def strip_marker_emoji(text: Column) -> Column:
    return F.regexp_replace(text, pattern(k.MARKER_EMOJI), "")


def tidy_seam(text: Column, lang: str = "zh") -> Column:
    t = F.regexp_replace(strip(text), pattern(k.SEAM_START), "")
    if lang == "zh":
        t = strip(F.regexp_replace(t, pattern(k.SEAM_TRAILING_CAPS), ""))
        for wrong, right in k.SEAM_NAMES:
            t = F.replace(t, F.lit(wrong), F.lit(right))
    return strip(F.regexp_replace(t, pattern(r"\s{2,}"), " "))


def tidy_translation_seam(text: Column) -> Column:
    return strip(F.regexp_replace(strip(text), k.SEAM_START_DASH, ""))


def strip_garble_chars(text: Column) -> Column:
    return F.regexp_replace(text, k.GARBLE_CHARS, "")


def is_page_noise(line: Column) -> Column:
    """Bare page numbers and lines of ornaments."""
    t = strip(line)
    return F.regexp_like(t, F.lit(any_of(k.PAGE_NOISE))) | F.regexp_like(
        t, F.lit(k.DECORATIVE_LINE)
    )


def is_screen_noise(text: Column) -> Column:
    def words(low: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in k.SCREEN_SUBSTRINGS])

    return bound(
        text,
        lambda line: bound(F.lower(line), words)
        | F.regexp_like(line, F.lit(any_of(k.SCREEN_PATTERNS)))
        | (F.length(line) == 1)
        | ((F.length(line) == 2) & ~F.regexp_like(line, F.lit(f"^{k.IDEOGRAPH_CLASS}{{2}}$"))),
    )


def section_level(line: Column) -> Column:
    """Heading kind of the first pattern that matches, or null."""
    t = strip(line)
    level = F.lit(None).cast("string")
    for body, name in reversed(k.SECTION_PATTERNS):
        level = F.when(F.regexp_like(t, F.lit(pattern(body, True))), name).otherwise(level)
    return F.when(F.length(t) >= 2, level)


def heading_prefix(level: Column) -> Column:
    return F.when(level.isin(k.SUBSECTION_LEVELS), "###").otherwise("##")


def detect_lang(text: Column) -> Column:
    wide = count_class(text, k.IDEOGRAPH_CLASS)
    latin = count_class(text, "[A-Za-z]")
    return (
        F.when(wide + latin == 0, "unknown")
        .when(wide / (wide + latin) >= 0.3, "zh")
        .otherwise("en")
    )


def parse_strikes(raw: Column) -> Column:
    """Struct ``(clean, spans)`` of a text with ``~~struck~~`` parts.

    Spans are in coordinates without white space.  A marker left open is text.
    """
    pieces = F.split(raw, "~~", -1)
    count = F.size(pieces)
    # an odd number of markers leaves the last one as literal text
    tail = F.concat(F.element_at(pieces, -2), F.lit("~~"), F.element_at(pieces, -1))
    whole = F.when(
        count % 2 == 0,
        F.concat(F.slice(pieces, F.lit(1), F.greatest(count - 2, F.lit(0))), F.array(tail)),
    ).otherwise(pieces)
    numbered = F.transform(whole, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    empty = F.array().cast("array<struct<a:int,b:int>>")
    start = F.struct(F.lit(0).alias("pos"), empty.alias("spans"))

    def step(acc: Column, item: Column) -> Column:
        size = no_space_length(item["p"])
        span = F.array(F.struct(acc["pos"].alias("a"), (acc["pos"] + size).alias("b")))
        struck = (item["i"] % 2 == 1) & (size > 0)
        return F.struct(
            (acc["pos"] + size).alias("pos"),
            F.when(struck, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    spans = F.aggregate(numbered, start, step, lambda acc: acc["spans"])
    return F.struct(F.array_join(whole, "").alias("clean"), spans.alias("spans"))


def verify_markup(marked: Column, original: Column) -> Column:
    """Null when the marked text only adds strike markers, else the reason."""
    markers = F.size(F.split(marked, "~~", -1)) - 1
    return (
        F.when(markers % 2 == 1, k.MARKUP_REASONS["unpaired"])
        .when(markers == 0, k.MARKUP_REASONS["unmarked"])
        .when(
            no_space(F.replace(marked, F.lit("~~"), F.lit(""))) != no_space(original),
            k.MARKUP_REASONS["altered"],
        )
    )


def slug(name: Column) -> Column:
    kept = F.regexp_replace(name, r"[^\p{L}\p{N}_.\- ]", "")
    return F.regexp_replace(strip(kept), pattern(r"\s+"), "-")


def deck_page(text: Column, file: Column) -> Column:
    """Sequence number before the extension, else the last ``N/M`` page mark."""
    seq = F.regexp_extract(file, r"(\d{2,})\.[a-zA-Z]+$", 1)
    mark = r"\b(\d{1,3})\s*/\s*(\d{1,3})\b"
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(mark), 1).alias("n"),
        F.regexp_extract_all(text, F.lit(mark), 2).alias("m"),
    )
    usable = F.filter(
        pairs,
        lambda p: (p["m"].cast("int") >= 5) & (p["n"].cast("int") <= p["m"].cast("int")),
    )
    last = F.when(F.size(usable) > 0, F.element_at(usable, -1)["n"].cast("int"))
    return F.when(seq != "", seq.cast("int")).otherwise(last)


def terms(text: Column) -> Column:
    """Set of comparison terms: ideograph pairs, plain words, numbers."""
    runs = F.regexp_extract_all(text, F.lit(k.IDEOGRAPH_RUN), 0)
    grams = F.flatten(
        F.transform(
            runs,
            lambda run: F.when(F.length(run) == 1, F.array(run)).otherwise(
                F.transform(
                    F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))
                )
            ),
        )
    )
    words = F.transform(F.regexp_extract_all(text, F.lit(k.LATIN_TERM), 0), F.lower)
    numbers = F.regexp_extract_all(text, F.lit(k.NUMBER_TERM), 0)
    return F.array_distinct(F.concat(grams, words, numbers))


#: A run of code, or an image or link with its address: never changed.
PROTECTED = r"`[^`]*`|!?\[[^\]]*\]\([^)]*\)"
_HOLE = "\u0001"
#: Single marks whose surroundings decide; rows of dots are taken out before.
#: The mark comes first in each pattern, so most positions fail at once.
_BY_CONTEXT = [
    (r"\.(?:(?<![A-Za-z0-9]\.)|(?![A-Za-z0-9]))", "。"),
    (r",(?:(?<!\p{Nd},)|(?!\p{Nd}))", "，"),
    (r":(?!/)(?:(?<!\p{Nd}:)|(?!\p{Nd}))", "："),
]
_ALWAYS = (";!?()", "；！？（）")
_HALF_MARKS = "[,.?!:;()]"
_DOTS = "\u0002"


def _bind(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def normalize_width_line(line: Column) -> Column:
    """Struct ``(line, changes)``: half-width marks become full-width.

    Only lines with wide characters change.  Code, links, decimals, grouped
    digits, clock times and addresses keep their marks.
    """

    def convert(single: Column) -> Column:
        changed = F.translate(single, *_ALWAYS)
        for body, mark in _BY_CONTEXT:
            changed = F.regexp_replace(changed, body, mark)
        return changed

    def result(single: Column, changed: Column) -> Column:
        changes = (
            count_class(single, _DOTS)
            + count_class(single, _HALF_MARKS)
            - count_class(changed, _HALF_MARKS)
        )
        kept = F.regexp_extract_all(line, F.lit(PROTECTED), 0)
        parts = F.split(F.replace(changed, F.lit(_DOTS), F.lit(k.ELLIPSIS)), _HOLE, -1)
        pieces = F.zip_with(parts, kept, lambda p, s: F.concat(p, F.coalesce(s, F.lit(""))))
        return F.struct(F.array_join(pieces, "").alias("line"), changes.alias("changes"))

    open_text = F.regexp_replace(line, PROTECTED, _HOLE)
    converted = _bind(
        F.regexp_replace(open_text, r"\.{2,}", _DOTS),
        lambda single: _bind(convert(single), lambda changed: result(single, changed)),
    )
    unchanged = F.struct(line.alias("line"), F.lit(0).alias("changes"))
    return F.when(F.regexp_like(line, F.lit(k.WIDE_CONTEXT_CLASS)), converted).otherwise(unchanged)
