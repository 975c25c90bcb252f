"""Windows over timelines. Every operator works within a stream, so no window holds more than one stream's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hop(items: DataFrame, block: float, overlap: float, keys: tuple[str, ...] = ("stream",), start: str = "start", duration: str = "dur") -> DataFrame:
    """items, once for each window [k * step, k * step + block) that its start lies in, with window (k), chunk_no (dense, without
    the empty windows), window_start and window_end. Windows begin before the stream's end (last start and duration, whole seconds)."""
    step = block - overlap
    ends = Window.partitionBy(*keys)
    total = F.floor(F.max_by(F.col(start) + F.col(duration), F.struct(F.col(start), F.col(duration))).over(ends))
    first = F.greatest(F.lit(0), F.floor((F.col(start) - block) / step) + 1).cast("bigint")
    last = F.least(F.floor(F.col(start) / step), F.ceil(total / step) - 1).cast("bigint")
    hit = items.withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
    hit = hit.withColumn("window", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    return hit.withColumn("chunk_no", (F.dense_rank().over(Window.partitionBy(*keys).orderBy("window")) - 1).cast("bigint")).withColumn("window_start", F.col("window") * F.lit(step)).withColumn("window_end", F.col("window") * F.lit(step) + block)


def tumble(events: DataFrame, span: int, keys: tuple[str, ...] = ("stream",), sec: str = "sec") -> DataFrame:
    """keys, bucket (from 0), n: counts by bucket up to each stream's last, the empty ones included."""
    counts = events.groupBy(*keys, F.floor(F.col(sec) / span).cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))
    all_buckets = counts.groupBy(*keys).agg(F.max("bucket").alias("_last")).select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"))).alias("bucket"))
    return all_buckets.join(counts, [*keys, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def range_join(windows: DataFrame, events: DataFrame, width: int, keys: tuple[str, ...] = ("stream",), sec: str = "sec", start: str = "start", end: str = "end", how: str = "inner") -> DataFrame:
    """windows with the events of start <= sec < end: an equi-join on the bins of a width that each window touches.

    how: inner, or left (windows without events stay, once). Widths near the windows' own keep the copies few.
    """
    bins = windows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.greatest(F.col(end) - 1, F.col(start))) / width))))
    there = events.withColumn("_bin", F.floor(F.col(sec) / width))
    inside = bins.join(there, [*keys, "_bin"]).where(F.col(sec).between(F.col(start), F.col(end)) & (F.col(sec) < F.col(end))).drop("_bin")
    return inside if how == "inner" else windows.join(inside.drop(*[c for c in windows.columns if c not in (*keys, start, end)]), [*keys, start, end], "left")


def first_window(windows: DataFrame, events: DataFrame, width: int, event_id: str, order: str, keys: tuple[str, ...] = ("stream",), **names: str) -> DataFrame:
    """events with the first window, by an order column of the windows, that holds them; null where none does."""
    hit = range_join(windows, events, width, keys, **names)
    best = hit.groupBy(*keys, event_id).agg(F.min_by(F.struct(*windows.drop(*keys).columns), order).alias("_w"))
    return events.join(best, [*keys, event_id], "left").select(*events.columns, "_w.*")


def ordered(keys: tuple[str, ...], order: tuple[str, ...]):  # noqa: ANN201
    return Window.partitionBy(*keys).orderBy(*order)


def islands(rows: DataFrame, differs: Column, keys: tuple[str, ...], order: tuple[str, ...], name: str = "island") -> DataFrame:
    """Numbers runs from 0: a run begins wherever differs (a condition on the row and the one before) holds."""
    w = ordered(keys, order)
    flag = rows.withColumn("_new", F.when(F.coalesce(differs, F.lit(False)), 1).otherwise(0))
    return flag.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_new")


def runs(rows: DataFrame, column: str, keys: tuple[str, ...], order: tuple[str, ...], name: str = "island") -> DataFrame:
    """Islands of an equal value."""
    return islands(rows, ~F.col(column).eqNullSafe(F.lag(column).over(ordered(keys, order))) & (F.row_number().over(ordered(keys, order)) > 1), keys, order, name)


def confirmed(rows: DataFrame, column: str, keys: tuple[str, ...], order: tuple[str, ...], name: str = "seg") -> DataFrame:
    """Islands whose value changes only where the next row has the new value, too; single flickers stay in the run around them."""
    w = ordered(keys, order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    sure = rows.withColumn("_sure", F.when(F.col(column) == F.lead(column).over(w), F.col(column)))
    current = F.coalesce(F.last("_sure", ignorenulls=True).over(so_far), F.first(column).over(so_far))
    return runs(sure.withColumn("_now", current), "_now", keys, order, name).drop("_sure", "_now")


def gaps(rows: DataFrame, longest: float, keys: tuple[str, ...], order: tuple[str, ...], start: str = "sec", end: str | None = None) -> DataFrame:
    """keys, gap_from, gap_to, gap: where a row starts more than so long after the row before ended."""
    before = F.lag(end or start).over(ordered(keys, order))
    return rows.select(*keys, before.alias("gap_from"), F.col(start).alias("gap_to"), (F.col(start) - before).alias("gap")).where(F.col("gap") > longest)


def coalesce_ranges(rows: DataFrame, within: float, keys: tuple[str, ...], start: str = "start", end: str = "end") -> DataFrame:
    """keys, island, start, end, n: ranges merged where one starts no more than so long after all before it ended."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    merged = islands(rows, F.col(start) - reach > within, keys, (start, end))
    return merged.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))


def slices(rows: DataFrame, length: int, start: str = "start", end: str = "end") -> DataFrame:
    """Ranges cut into pieces of a length, the last one shorter: slice_start, slice_end."""
    at = F.explode(F.sequence(F.col(start), F.greatest(F.col(end) - 1, F.col(start)), F.lit(length)))
    return rows.withColumn("slice_start", at).withColumn("slice_end", F.least(F.col("slice_start") + length, F.col(end)))


def batches(rows: DataFrame, size: int, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Numbers groups of so many rows from 0."""
    return rows.withColumn("batch", F.floor((F.row_number().over(ordered(keys, order)) - 1) / size).cast("bigint"))


def fill_gaps(rows: DataFrame, longest: int, most: int, keys: tuple[str, ...], order: tuple[str, ...], start: str = "sec") -> DataFrame:
    """keys, sec of rows to put into gaps of more than so long: evenly spaced, `most` at most."""
    wide = gaps(rows, longest, keys, order, start)
    n = F.least(F.lit(most), F.floor(F.col("gap") / longest)).cast("int")
    return wide.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(1), n))).select(*keys, (F.col("gap_from") + F.floor(F.col("gap") * F.col("_k") / (F.col("_n") + 1))).cast("bigint").alias(start))
