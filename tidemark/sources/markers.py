"""Marker lists, assembled parts, notes and dictionaries."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import fmt_clock, parse_clock
from tidemark.functions.text import strip, valid_patterns
from tidemark.sources.transcripts import numbered_lines

# The formats of marker lines (time, tags, description) and of a note of a garbled word.
GRAMMARS = {
    "strict": r"^(\d{2}:\d{2}:\d{2})\s*-\s*((?:\[.*?\])+)\s*(.*)$",
    "flexible": r"^(\d{2}:\d{2}:\d{2})\s*(?:-\s*)?(?:\[(.*?)\])?\s*(.*)$",
    "single": r"^(\d{2}:\d{2}:\d{2})\s*-\s*(\[.*?\])\s+(.*)$",
    "audit": r"^(\d\d:\d\d:\d\d)\s*-()(.*)$",
    "mood": r"^(\d{2}:\d{2}:\d{2})()(?=.*\])(?:.*\] )?(.*)$",
    "assembly": r"^(?=\d)(.*?) - ()(.*)$",
}
NOTE = r'"([^"]+)"\s*->\s*([^@]+?)(?:\s*@\s*(\d{2}:\d{2}:\d{2}))?(?:\s*\(([^)]+)\))?$'


def parse_markers(rows: DataFrame, line: str = "line", grammar: str = "strict", default_tag: str = "[Talk]") -> DataFrame:
    """rows with time, sec, tag, desc, raw, bytes; lines that aren't markers are left out.

    strict and flexible markers are written anew in raw, so that lines which differ in spaces alone are equal; the other grammars
    keep the line. The mood grammar's line without "] " is its own description.
    """
    pattern, whole = GRAMMARS[grammar], strip(F.col(line))
    part = lambda k: F.regexp_extract(whole, pattern, k)
    found = F.concat(F.lit("["), part(2), F.lit("]")) if grammar == "flexible" else part(2)
    desc = F.when(F.contains(whole, F.lit("] ")), part(3)).otherwise(whole) if grammar == "mood" else part(3)
    out = rows.where(whole.rlike(pattern)).select("*", part(1).alias("time"), F.when(part(2) == "", default_tag).otherwise(found).alias("tag"), desc.alias("desc"), whole.alias("_line"))
    anew = F.concat("time", F.lit(" - "), "tag", F.lit(" "), "desc")
    out = out.withColumn("sec", parse_clock(F.col("time"))).withColumn("raw", anew if grammar in ("strict", "flexible") else F.col("_line"))
    return out.withColumn("bytes", F.octet_length("raw").cast("bigint")).select(*(c for c in rows.columns if c not in ("time", "sec", "tag", "desc", "raw", "bytes")), "raw", "time", "sec", "tag", "desc", "bytes")


def markers(spark: SparkSession, path: str, grammar: str = "strict") -> DataFrame:
    return parse_markers(numbered_lines(spark, path), "line", grammar)


def render(sec: Column, tag: Column, desc: Column) -> Column:
    return F.concat(fmt_clock(sec), F.lit(" - ["), tag, F.lit("] "), desc)


def blocks(lines: DataFrame, keys: tuple[str, ...] = ("file",), rule: str = "═") -> DataFrame:
    """keys, block, header, line_no, line: the bodies of blocks whose header stands between two lines of a rule."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    is_rule = F.trim("line").rlike(f"^{rule}{{3,}}$")
    # every other rule opens a header
    header = F.lag(is_rule).over(w) & F.lead(is_rule).over(w) & ~is_rule & (F.count_if(is_rule).over(w) % 2 == 1)
    marked = lines.withColumn("_rule", is_rule).withColumn("_head", F.coalesce(header, F.lit(False)))
    marked = marked.withColumn("block", F.sum(F.col("_head").cast("int")).over(w)).withColumn("header", F.last(F.when(F.col("_head"), F.trim("line")), ignorenulls=True).over(w))
    return marked.where("block > 0 and not _rule and not _head").select(*keys, F.col("block").cast("bigint").alias("block"), "header", "line_no", "line")


def notes(lines: DataFrame) -> DataFrame:
    """garbled, correct (null if unknown), ts, chunk of lines: "garbled" -> correct @ HH:MM:SS (chunk_NN).

    Time and chunk may be missing: the time is empty then, the chunk the file's stem, if lines have a file.
    """
    whole = strip(F.col("line"))
    part = lambda k: strip(F.regexp_extract(whole, NOTE, k))
    known = F.when(~F.upper(part(2)).isin("UNKNOWN", "NULL", "NONE", ""), part(2))
    stem = F.regexp_replace("file", r"\.[^.]*$", "") if "file" in lines.columns else F.lit("")
    found = lines.where(whole.rlike(NOTE) & ~whole.startswith("GARBLED_NOTES"))
    return found.select(part(1).alias("garbled"), known.alias("correct"), part(3).alias("ts"), F.when(part(4) == "", stem).otherwise(part(4)).alias("chunk"))


def dictionary(path: str, default: dict | None = None) -> dict:
    """A dictionary file; one that is missing or isn't JSON is empty."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return default or {}


def replacements(path: str) -> list[tuple[str, str]]:
    """(pattern, replacement) of a dictionary of regular expressions: {"mappings": {replacement: patterns}}, long patterns first, or
    in its older form {"replacements": [{pattern, replacement}]}, in their order. Patterns that don't compile are left out."""
    data = dictionary(path)
    if isinstance(data.get("mappings"), dict):
        listed = {k.strip(): [str(p).strip() for p in (v if isinstance(v, list) else [v])] for k, v in data["mappings"].items()}
        return valid_patterns({k: [p for p in v if p] for k, v in listed.items()})
    return [pair for e in data.get("replacements", []) if "pattern" in e for pair in valid_patterns({e.get("replacement", ""): [e["pattern"]]})]


def emotes(path: str) -> dict[str, tuple[str, float]]:
    """{code: (mood, weight)} of a dictionary of emotes, as chat.line_signals takes them."""
    return {code: (e.get("mood", ""), float(e.get("weight", 1.0))) for code, e in dictionary(path).get("emotes", {}).items()}


def tones(path: str) -> dict[str, tuple[str, list[str]]]:
    """{mood: (tone, verbs)} of a dictionary of hints, as chat.with_tone takes them."""
    return {mood: (e.get("tone", ""), list(e.get("verbs", []))) for mood, e in dictionary(path).get("hints", {}).items()}


def mapping(path: str, key: str = "mapping") -> dict[str, str]:
    """A flat mapping in a file, under a key or as the file itself: tags to macros, files' names to titles."""
    data = dictionary(path)
    return dict(data.get(key, {} if key in data else data))


def signals(path: str) -> dict[str, dict]:
    """Signals or moods by chunk, of a report (under "chunks") or of a map of chunks alone."""
    data = dictionary(path)
    return data.get("chunks", data)


def keywords(spark: SparkSession, entries: dict[str, dict]) -> DataFrame:
    """kw_pos, keyword, kind, file of a dictionary {keyword: {kind, file}}."""
    rows = [(k, word, e.get("kind"), e.get("file")) for k, (word, e) in enumerate(entries.items())]
    return spark.createDataFrame(rows, "kw_pos int, keyword string, kind string, file string")


def write_dictionary(entries: dict[str, list[str]], *paths: str) -> None:
    """Writes a dictionary, sorted, to each path: a file beside it takes its place at once."""
    ordered = {k: sorted(set(v), key=lambda p: (-len(p), p)) for k, v in sorted(entries.items(), key=lambda e: e[0].lower())}
    for path in paths:
        beside = f"{path}.new"
        with open(beside, "w", encoding="utf-8") as f:
            json.dump(ordered, f, ensure_ascii=False, indent=2)
        os.replace(beside, path)
