"""Clock strings (HH:MM:SS from a stream's start, over 24 hours allowed) and seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fmt_clock(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds; fractions are cut off."""
    s = F.floor(seconds).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), s % 60)


def parse_clock(text: Column, two_parts: bool = True) -> Column:
    """Seconds of H:M:S, or of M:S where two_parts; anything else is 0."""
    p = F.split(F.trim(text), ":")
    n = lambda k: F.coalesce(F.get(p, F.lit(k)).try_cast("bigint"), F.lit(0))
    out = F.when(F.size(p) == 3, n(0) * 3600 + n(1) * 60 + n(2))
    return (out.when(F.size(p) == 2, n(0) * 60 + n(1)) if two_parts else out).otherwise(F.lit(0)).cast("bigint")


def strict_clock(text: Column) -> Column:
    """As parse_clock, but null where the text isn't a clock: such rows are rejects."""
    return F.when(text.rlike(r"^\d+:\d{1,2}(:\d{1,2})?$"), parse_clock(text))


def chunk_name(seconds: Column, span: int = 300) -> Column:
    return F.format_string("chunk_%02d", F.floor(seconds / span).cast("bigint"))


def chunk_number(name: Column) -> Column:
    """The number at the end of a file's stem, 0 where there is none."""
    return F.coalesce(F.element_at(F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_"), -1).try_cast("int"), F.lit(0))


def storyboard(seconds: Column, sheet: float = 89.932, tile: float = 9.9924, width: int = 320, height: int = 180) -> Column:
    """Where a storyboard (sheets of three by three tiles) shows a second: slide, sub, x, y."""
    sub = F.least(F.lit(8), F.floor((seconds % sheet) / tile)).cast("int")
    return F.struct((F.floor(seconds / sheet) + 1).cast("int").alias("slide"), sub.alias("sub"), ((sub % 3) * width).alias("x"), (F.floor(sub / 3) * height).cast("int").alias("y"))
