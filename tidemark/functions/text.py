"""Text expressions: sizes, dictionaries, n-grams, likeness, titles, links."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

WARN_BYTES, OVER_BYTES = 3500, 4500


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once: inside a lambda an expression is worked out anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_space(text: Column) -> Column:
    """White space of any script to single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def byte_status(n_bytes: Column, warn: int = WARN_BYTES, over: int = OVER_BYTES) -> Column:
    return F.when(n_bytes > over, "OVER").when(n_bytes > warn, "WARN").otherwise("OK")


def count_of(text: Column, word: Column) -> Column:
    """How often a word stands in a text, without overlaps."""
    return F.when(F.length(word) > 0, F.floor((F.length(text) - F.length(F.replace(text, word))) / F.length(word))).otherwise(0).cast("bigint")


def _java(replacement: str) -> str:
    """A literal replacement for Java's regular expressions."""
    return re.sub(r"([\\$])", r"\\\1", replacement)


@dataclass(frozen=True)
class Correction:
    """A literal correction: any of the patterns, in any case, becomes `correct`, but not in texts with an exclusion."""

    correct: str
    patterns: tuple[str, ...]
    exclude_if_contains: tuple[str, ...] = ()


def correct(text: Column, corrections: Sequence[Correction]) -> Column:
    """Applies corrections one after another; later ones see what earlier ones wrote."""
    for c in corrections:
        for pattern in c.patterns:
            new = F.regexp_replace(text, f"(?iu){re.escape(pattern)}" if not pattern.isalnum() else f"(?iu){pattern}", _java(c.correct))
            for word in c.exclude_if_contains:
                new = F.when(F.contains(F.lower(text), F.lit(word.lower())), text).otherwise(new)
            text = new
    return text


def mask(text: Column, terms: dict[str, str]) -> Column:
    """Replaces terms by their substitutes, the longest first."""
    return correct(text, [Correction(new, (old,)) for old, new in sorted(terms.items(), key=lambda t: (-len(t[0]), t[0]))])


def valid_patterns(dictionary: dict[str, Sequence[str]]) -> list[tuple[str, str]]:
    """(pattern, replacement) of a dictionary of replacements, long patterns first, without those that don't compile."""
    out = []
    for replacement, patterns in dictionary.items():
        for pattern in patterns:
            try:
                re.compile(pattern)
            except re.error:
                continue
            out.append((pattern, replacement))
    return sorted(out, key=lambda p: -len(p[0]))


def clean(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Applies regular expressions (any case) one after another; \\1 in a replacement is the first group."""
    for pattern, replacement in patterns:
        java = re.sub(r"\\\\(\d)", r"$\1", _java(replacement))
        text = F.regexp_replace(text, f"(?iu){pattern}", java)
    return text


def char_grams(text: Column, n: int = 3) -> Column:
    """The distinct character n-grams of a text, lower-cased and with white space folded."""

    def grams(c: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(c, i, n), ""))
        return F.when(F.size(c) >= n, F.array_distinct(found)).otherwise(F.expr("cast(array() as array<string>)"))

    return let(F.split(F.lower(fold_space(text)), ""), grams)  # characters, as a substring costs its distance from the start


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def loop_grams(text: Column) -> Column:
    """The n-grams that show loops: word pairs, or character triples of a text of under four words."""

    def grams(words: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.concat(F.get(words, i - 1), F.lit(" "), F.get(words, i)))
        triples = let(F.split(F.array_join(words, ""), ""), lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 2, F.lit(1))), lambda i: F.array_join(F.slice(c, i, 3), "")))
        none = F.expr("cast(array() as array<string>)")
        return F.when(F.size(words) >= 4, pairs).when(F.length(F.array_join(words, "")) >= 3, triples).otherwise(none)

    return let(F.filter(F.split(text, r"\s+"), lambda w: w != ""), grams)


def loop_coverage(text: Column, threshold: float = 0.4) -> Column:
    """Whether some 2-, 3- or 4-gram of characters recurs and covers more than a share of the text (8 characters or more).

    Quadratic in the text's length: for segments of a transcript; for long texts see operators.corruption.covered.
    """

    def covers(n: int) -> Column:
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: text.substr(i, F.lit(n))))
        return F.exists(grams, lambda g: (count_of(text, g) >= 2) & (count_of(text, g) * n / F.length(text) > threshold))

    return F.coalesce((F.length(text) >= 8) & (covers(2) | covers(3) | covers(4)), F.lit(False))


def tokens(text: Column) -> Column:
    """The distinct lower-case tokens of two characters or more, without clocks, tags and punctuation."""
    t = F.regexp_replace(F.regexp_replace(text, r"\d{2}:\d{2}:\d{2}", ""), r"\[.*?\]", "")
    t = F.regexp_replace(t, r"[–—,:;.?!()<>\"'\[\]{}-]", " ")
    return F.array_distinct(F.transform(F.filter(F.split(t, r"(?U)\s+"), lambda w: F.length(w) >= 2), F.lower))


def display_name(stem: Column) -> Column:
    """A file's stem as a title."""
    return F.initcap(F.regexp_replace(F.regexp_replace(stem, r"\.md$", ""), "[-_]+", " "))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), F.lit("-")).substr(1, 60)


def clean_title(text: Column, longest: int = 95) -> Column:
    """Cuts a title at the last space or bracket after 30 characters and takes away what can't end one."""
    head = text.substr(1, longest)
    at = F.length(head) - F.locate("\x00", F.reverse(F.translate(head, " )،", "\x00\x00\x00"))) + 1
    cut = F.when(F.contains(F.translate(head, " )،", "\x00\x00\x00"), F.lit("\x00")) & (at > 31), head.substr(F.lit(1), at - 1)).otherwise(head)
    return F.when(F.length(text) <= longest, text).otherwise(F.regexp_replace(cut, r"(?:[^\p{L}\p{N}]|[เ-ไ])+$", ""))


def label_text(text: Column) -> Column:
    """Without the marks of bold, italics and code."""
    return F.trim(text, F.lit(" *_`"))


def hybrid_tokens(text: Column, script: str = "\\u0E00-\\u0E7F") -> Column:
    """Tokens that run from letters of a script straight into Latin letters."""
    return F.regexp_extract_all(text, F.lit(f"([{script}]+[A-Za-z]{{2,}})"), F.lit(1))


def video_id(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?:v=|youtu\.be/|/live/|/shorts/)([A-Za-z0-9_-]+)", 1)
    return F.when(found != "", found).otherwise(url)


def is_homepage(url: Column) -> Column:
    """Whether a link has no path."""
    return F.coalesce(F.trim(F.try_parse_url(url, F.lit("PATH")), F.lit("/")) == "", F.lit(False))


def cached_url(url: Column) -> Column:
    """The page that a web cache's link stands for: the first link in its parameter q."""
    found = F.regexp_extract(F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("q"))), r"(https?://.*)$", 1)
    return F.when(found != "", found).otherwise(url)


def escape_xml(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape_xml(text: Column) -> Column:
    """escape_xml() undone."""
    return F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def has_cue(text: Column, cues: Sequence[str]) -> Column:
    """Whether any of the regular expressions matches, in any case."""
    return text.rlike("(?iu)" + "|".join(f"(?:{c})" for c in cues)) if cues else F.lit(False)


def is_uncertain(text: Column, flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | F.contains(text, F.lit("[?]"))
