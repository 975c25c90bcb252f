"""Loops and repeats of automatic transcripts, and the ranges to transcribe again."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import loop_grams
from tidemark.operators.windows import islands, ordered, runs, slices


def top_grams(rows: DataFrame, keys: tuple[str, ...], text: str = "text", threshold: float = 0.4, least: int = 3) -> DataFrame:
    """keys, top_gram, top_count, n_grams, score, looped: the n-gram counted most, of equal ones the first; no row without n-grams.

    A row's n-grams are counted where it stands: sorted, equal ones are together, and one pass over them finds the largest group.
    """
    grams = F.sort_array(F.transform(loop_grams(F.col(text)), lambda g, i: F.struct(g.alias("g"), i.alias("at"))))
    start = F.expr("named_struct('g', cast(null as string), 'at', 0, 'n', 0, 'top', cast(null as string), 'top_at', 0, 'top_n', 0)")

    def step(acc, x):  # noqa: ANN001, ANN202
        more = acc["g"].eqNullSafe(x["g"])
        n, at = F.when(more, acc["n"] + 1).otherwise(1), F.when(more, acc["at"]).otherwise(x["at"])
        better = (n > acc["top_n"]) | ((n == acc["top_n"]) & (at < acc["top_at"]))
        pick = lambda new, old: F.when(better, new).otherwise(old)
        return F.struct(x["g"].alias("g"), at.alias("at"), n.alias("n"), pick(x["g"], acc["top"]).alias("top"), pick(at, acc["top_at"]).alias("top_at"), pick(n, acc["top_n"]).alias("top_n"))

    found = rows.select(*keys, grams.alias("_g")).where(F.size("_g") > 0)
    found = found.select(*keys, F.aggregate("_g", start, step).alias("_t"), F.size("_g").cast("bigint").alias("n_grams"))
    top = found.select(*keys, F.col("_t.top").alias("top_gram"), F.col("_t.top_n").cast("bigint").alias("top_count"), "n_grams")
    score = F.round(F.col("top_count") / F.col("n_grams"), 3)
    return top.withColumn("score", score).withColumn("looped", (F.col("top_count") >= least) & (F.col("top_count") / F.col("n_grams") >= threshold))


def covered(rows: DataFrame, keys: tuple[str, ...], text: str = "text", threshold: float = 0.4) -> DataFrame:
    """keys, covered: functions.text.loop_coverage for texts of any length, in one pass over each text's sorted n-grams.

    Equal n-grams stand together, in the order of their places, so the places without overlaps are counted on the way.
    """
    t = F.col(text)

    def most(n: int):  # noqa: ANN202
        grams = F.sort_array(F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.struct(t.substr(i, F.lit(n)).alias("g"), i.alias("at"))))
        start = F.struct(F.lit("").alias("g"), F.lit(0).alias("free"), F.lit(0).alias("k"), F.lit(0).alias("most"))

        def step(acc, x):  # noqa: ANN001, ANN202
            overlaps = (acc["g"] == x["g"]) & (x["at"] < acc["free"])
            k = F.when(overlaps, acc["k"]).when(acc["g"] == x["g"], acc["k"] + 1).otherwise(1)
            return F.struct(x["g"].alias("g"), F.when(overlaps, acc["free"]).otherwise(x["at"] + n).alias("free"), k.alias("k"), F.greatest(acc["most"], k).alias("most"))

        return F.aggregate(grams, start, step, lambda acc: acc["most"])

    found = [F.struct(most(n).alias("k"), F.lit(n).alias("n")) for n in (2, 3, 4)]
    hit = F.exists(F.array(*found), lambda x: (x["k"] >= 2) & (x["k"] * x["n"] / F.length(t) > threshold))
    return rows.select(*keys, F.coalesce(F.when(F.length(t) >= 8, hit), F.lit(False)).alias("covered"))


def repeats(rows: DataFrame, least: int, keys: tuple[str, ...] = ("stream",), order: tuple[str, ...] = ("pos",), text: str = "text", longer: int = 0) -> DataFrame:
    """rows with run, run_length, run_place (from 1), repeated: runs of an equal text."""
    runs_ = runs(rows, text, keys, order, "run")
    one = Window.partitionBy(*keys, "run")
    out = runs_.withColumn("run_length", F.count("*").over(one)).withColumn("run_place", F.row_number().over(one.orderBy(*order)).cast("bigint"))
    return out.withColumn("repeated", (F.col("run_length") >= least) & (F.length(text) > longer))


def collapse_repeats(rows: DataFrame, least: int = 3, longer: int = 2, fillers: tuple[str, ...] = (), **names) -> DataFrame:  # noqa: ANN003
    """rows without the repeats of a text after its first in a run; fillers and short texts may repeat."""
    text = names.get("text", "text")
    found = repeats(rows, least, longer=longer, **names)
    keep = ~F.col("repeated") | (F.col("run_place") == 1) | F.col(text).isin(*fillers)
    return found.where(keep).select(*rows.columns)


#: A loop is a pattern of so many texts, so many times or more in a row.
LOOPS = {1: 4, 2: 3, 3: 3}


def loops(rows: DataFrame, keys: tuple[str, ...] = ("stream",), order: tuple[str, ...] = ("pos",), text: str = "text", times: dict[int, int] = LOOPS, mark: str = "[?] ") -> DataFrame:
    """rows with in_loop: in a pattern of 1, 2 or 3 texts (without marks), of which one is longer than a character, that recurs.

    Each length of pattern is scanned by itself, from a stream's beginning and without overlaps, and what any scan marks counts.
    A text that equals the one p before it continues a region of period p. Where a region begins before the marked part of the one
    before ends, the scan enters it there, so the regions (few rows) stream by in order with that end as all the state. A region is
    marked in whole patterns; its odd tail stays unmarked.
    """
    w = ordered(keys, order)
    plain = rows.withColumn("_k", F.row_number().over(w)).withColumn("_t", F.trim(F.replace(F.coalesce(text, F.lit("")), F.lit(mark)), F.lit(" \t\r\n\f")))
    by_k = ordered((*keys, "_p"), ("_k",))
    lagged = plain.select(*keys, "_k", "_t", *(F.lag("_t", p).over(w).alias(f"_{p}") for p in times))
    same = lagged.select(*keys, "_k", "_t", F.explode(F.array_compact(F.array(*(F.when(F.col("_t") == F.col(f"_{p}"), F.lit(p)) for p in times)))).alias("_p"))
    regions = same.withColumn("_g", F.col("_k") - F.row_number().over(by_k)).groupBy(*keys, "_p", "_g").agg(F.min("_k").alias("_from"), F.max("_k").alias("_end"), F.max(F.length("_t") > 1).alias("_long"))
    least = F.element_at(F.create_map(*(F.lit(x) for kv in times.items() for x in kv)), F.col("_p"))
    regions = regions.select(*keys, "_p", (F.col("_from") - F.col("_p")).cast("bigint").alias("_from"), F.col("_end").cast("bigint").alias("_end")).where(F.col("_long") & (F.col("_end") - F.col("_from") + 1 >= F.col("_p") * least))
    names = [f"_x{k}" for k in range(len(keys))]

    def scanned(batches):  # noqa: ANN001, ANN202
        key, done = None, 0
        for batch in batches:
            marked = []
            for *k, p, first, end in zip(*(batch[c] for c in [*keys, "_p", "_from", "_end"]), strict=True):
                if (*k, p) != key:
                    key, done = (*k, p), 0
                first = max(first, done + 1)
                n = (end - first + 1) // p
                if n >= times[p]:
                    done = first + n * p - 1
                    marked.append((*k, first, done))
            yield pd.DataFrame(marked, columns=[*names, "_from", "_end"])

    schema = ", ".join([*(f"{n} {rows.schema[c].dataType.simpleString()}" for n, c in zip(names, keys, strict=True)), "_from bigint", "_end bigint"])
    marks = regions.repartition(*keys, "_p").sortWithinPartitions(*keys, "_p", "_from").mapInPandas(scanned, schema)
    places = marks.select(*(F.col(n).alias(c) for n, c in zip(names, keys, strict=True)), F.explode(F.sequence("_from", "_end")).alias("_k")).distinct().withColumn("in_loop", F.lit(True))
    return plain.join(places, [*keys, "_k"], "left").select(*rows.columns, F.coalesce("in_loop", F.lit(False)).alias("in_loop"))


def corrupt_ranges(rows: DataFrame, keys: tuple[str, ...] = ("stream",), order: tuple[str, ...] = ("pos",), start: str = "start_ms", end: str = "end_ms", length: int = 30_000) -> DataFrame:
    """keys, island, start, end, slice_start, slice_end: neighbouring corrupt rows as ranges, cut into pieces to transcribe."""
    w = ordered(keys, order)
    marked = islands(rows, ~F.col("corrupt").eqNullSafe(F.lag("corrupt").over(w)), keys, order).where("corrupt")
    ranges = marked.groupBy(*keys, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"))
    return slices(ranges, length)


def uncertain_runs(rows: DataFrame, within: float = 0.1, retry: float = 1.0, keys: tuple[str, ...] = ("stream",), start: str = "start", duration: str = "dur") -> DataFrame:
    """keys, island, start, end, n, total, retried: runs of uncertain rows no further apart than `within`."""
    w = ordered(keys, (start,))
    apart = F.col(start) - F.lag(F.col(start) + F.col(duration)).over(w) >= within
    found = islands(rows.where("uncertain"), apart, keys, (start,))
    out = found.groupBy(*keys, "island").agg(F.min(start).alias("start"), F.max(F.col(start) + F.col(duration)).alias("end"), F.count("*").alias("n"), F.round(F.sum(duration), 3).alias("total"))
    return out.withColumn("retried", F.col("total") > retry)


def recover(ranges: DataFrame, recognise: Callable[[DataFrame], DataFrame], least_ms: int = 1000, most_levels: int = 20) -> DataFrame:
    """Transcribes ranges (id, start, end) until they are clean: what stays corrupt is halved, level by level.

    recognise(ranges) returns id, start, end, text, corrupt. Returns those columns and uncertain: ranges under least_ms, or left at
    the last level, that are still corrupt.
    """
    done, level = None, ranges
    for depth in range(most_levels + 1):
        tried = recognise(level).persist()
        last = F.lit(depth == most_levels) | (F.col("end") - F.col("start") < least_ms)
        part = tried.where(~F.col("corrupt") | last).withColumn("uncertain", F.col("corrupt"))
        done = part if done is None else done.unionByName(part)
        again = tried.where(F.col("corrupt") & ~last)
        if again.isEmpty():
            return done
        middle = F.floor((F.col("start") + F.col("end")) / 2).cast("bigint")
        level = again.select("id", F.explode(F.array(F.struct(F.col("start").alias("start"), middle.alias("end")), F.struct(middle.alias("start"), F.col("end").alias("end")))).alias("r")).select("id", "r.*")
    return done
