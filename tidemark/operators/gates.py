"""Gates: conditions that a plan, a transcript or a catalog has to meet before work goes on. All give columns, none stops a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import fmt_clock


def predicted_hours(duration_sec: Column, sample_elapsed_sec: Column, sample_sec: float = 10) -> Column:
    """How long a recogniser takes for a recording, by how long it took for a sample."""
    return duration_sec / (F.lit(sample_sec) / sample_elapsed_sec) / 3600


def too_slow(duration_sec: Column, sample_elapsed_sec: Column, most_hours: float = 3.0) -> Column:
    return predicted_hours(duration_sec, sample_elapsed_sec) > most_hours


def scene_plan(scenes: DataFrame, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """scenes (scene, start, end, label) with duration, invalid (no length) and overlaps (the next begins before it ends)."""
    w = Window.partitionBy(*keys).orderBy("start", "scene")
    return scenes.withColumn("duration", F.col("end") - F.col("start")).withColumn("invalid", F.col("end") <= F.col("start")).withColumn("overlaps", F.coalesce(F.lead("start").over(w) < F.col("end"), F.lit(False)))


def plan_header(scenes: DataFrame, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """keys, total_expected_duration_seconds, scenes in order, their clocks as text."""
    scene = F.struct("scene", fmt_clock(F.col("start")).alias("start"), fmt_clock(F.col("end")).alias("end"), (F.col("end") - F.col("start")).alias("duration_seconds"), "label")
    return scenes.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("total_expected_duration_seconds"), F.sort_array(F.collect_list(scene)).alias("scenes"))


def download_estimate(total_bytes: Column, wanted_sec: Column, total_sec: Column, bytes_a_second: float = 5e6) -> Column:
    """Seconds that a part of a video takes to download."""
    return F.coalesce(F.try_divide(wanted_sec, total_sec), F.lit(0.0)) * total_bytes / bytes_a_second


def buffered(scenes: DataFrame, gap: float = 900, lead: float = 300, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """scenes that begin earlier by `lead` where more than `gap` lies before them, for context."""
    w = Window.partitionBy(*keys).orderBy("start")
    apart = F.col("start") - F.lag("end").over(w) > gap
    return scenes.withColumn("_apart", apart).withColumn("start", F.when(F.col("_apart"), F.greatest(F.lit(0), F.col("start") - lead)).otherwise(F.col("start"))).drop("_apart")


def verified(rendered: DataFrame, tolerance: float = 5.0, video: str = "h264", audio: str = "aac", pixels: str = "yuv420p") -> DataFrame:
    """rendered (expected, duration, streams) with whether length, video and audio are as they should be."""
    of = lambda kind, f: F.exists("streams", lambda s: (s["codec_type"] == kind) & f(s))
    return rendered.withColumn("duration_ok", F.abs(F.col("expected") - F.col("duration")) <= tolerance).withColumn("video_ok", of("video", lambda s: (s["codec_name"] == video) & (s["pix_fmt"] == pixels))).withColumn("audio_ok", of("audio", lambda s: s["codec_name"] == audio))


def density(markers: DataFrame, keys: tuple[str, ...] = ("stream",), sec: str = "sec") -> DataFrame:
    """keys, n, hours, per_hour, status: one marker for each 8 to 15 minutes is wanted."""
    out = markers.groupBy(*keys).agg(F.count("*").alias("n"), ((F.max(sec) - F.min(sec)) / 3600).alias("hours"))
    rate = F.try_divide("n", "hours")
    return out.withColumn("per_hour", F.round(rate, 2)).withColumn("status", F.when(rate > 7.5, "DENSE").when(rate < 4, "SPARSE").otherwise("OK"))


def retag_counts(rows: DataFrame, tag: str = "tag", new_tag: str = "new_tag", keys: tuple[str, ...] = ()) -> DataFrame:
    """total, changed, unchanged and skipped lines; a skipped one has no tag."""
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col(new_tag).isNotNull()).alias("changed"), F.count_if(F.col(tag).isNotNull() & F.col(new_tag).isNull()).alias("unchanged"), F.count_if(F.col(tag).isNull()).alias("skipped"))


def catalog_valid(spark: SparkSession, least_rows: dict[str, int]) -> dict[str, bool]:
    """Whether each table is there and has so many rows."""
    return {t: spark.catalog.tableExists(t) and spark.table(t).count() >= n for t, n in least_rows.items()}


def search(items: DataFrame, pattern: str | None = None, start: float | None = None, end: float | None = None) -> DataFrame:
    """Items whose text matches and whose start lies in a range."""
    out = items if pattern is None else items.where(F.col("text").rlike(f"(?iu){pattern}"))
    out = out if start is None else out.where(F.col("start") >= start)
    return out if end is None else out.where(F.col("start") <= end)
