"""Clock text and millisecond columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLOCK = r"(\d+):(\d\d):(\d\d)[,.](\d{1,3})"


def _two(value: Column) -> Column:
    text = value.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(2)), F.lit("0"))


def ms_to_srt(ms: Column) -> Column:
    """``HH:MM:SS,mmm``; negative times become zero."""
    t = F.greatest(ms.cast("bigint"), F.lit(0))
    seconds = F.floor(t / 1000)
    return F.concat(
        _two(F.floor(seconds / 3600)),
        F.lit(":"),
        _two(F.floor(seconds % 3600 / 60)),
        F.lit(":"),
        _two(seconds % 60),
        F.lit(","),
        F.lpad((t % 1000).cast("string"), 3, "0"),
    )


def ms_to_clock(ms: Column) -> Column:
    """``M:SS``, or ``H:MM:SS`` from one hour on."""
    s = F.floor(ms / 1000)
    minutes = F.floor(s / 60)
    short = F.concat(minutes.cast("string"), F.lit(":"), _two(s % 60))
    long = F.concat(
        F.floor(s / 3600).cast("string"),
        F.lit(":"),
        _two(F.floor(s % 3600 / 60)),
        F.lit(":"),
        _two(s % 60),
    )
    return F.when(s >= 3600, long).otherwise(short)


def srt_to_ms(text: Column) -> Column:
    def part(i: int) -> Column:
        return F.regexp_extract(text, CLOCK, i)

    fraction = F.rpad(part(4), 3, "0")
    return F.when(
        part(1) != "",
        ((part(1).cast("bigint") * 60 + part(2).cast("bigint")) * 60 + part(3).cast("bigint"))
        * 1000
        + fraction.cast("bigint"),
    )


def clock_to_ms(text: Column) -> Column:
    """Seconds, ``mm:ss.s`` or ``h:mm:ss.s`` to milliseconds."""
    seconds = F.aggregate(
        F.split(text, ":"), F.lit(0.0), lambda acc, p: acc * 60 + p.cast("double")
    )
    return F.round(seconds * 1000).cast("bigint")
