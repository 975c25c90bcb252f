"""Chat: weighted laugh signals, pulses, verdicts, segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import fmt_clock

# What counts as laughing. Word boundaries are spelled out, as engines differ on them beside combining marks.
LAUGH = r"5{3,}|xd+|haha+|ฮา+|ขำ+|(^|[^A-Za-z0-9_])(lol|haha)($|[^A-Za-z0-9_])"
LAUGH_MARKS = ("\U0001f602", "\U0001f923", "\U0001f480", "\U0001f921", "\U0001f62d", "\U0001f525", "\U0001f5a4", "\U0001f451", "\U0001f44d", "☠")
PULSE = "MEME_PULSE"


@dataclass(frozen=True)
class PulseConfig:
    bucket: int = 90
    pulse_score: float = 10.0
    hot_min: int = 12
    max_peaks: int = 4


def laughs(line: Column) -> Column:
    return line.rlike(f"(?iu){LAUGH}")


def line_signals(line: Column, emotes: dict[str, tuple[str, float]] | None = None) -> Column:
    """The signals of a chat line: (mood, weight) for each laugh emote, laugh word, laugh mark and +1 in it."""
    one = lambda mood, weight, there: F.when(there, F.struct(F.lit(mood).alias("mood"), F.lit(float(weight)).alias("weight")))
    found = [one(mood, weight, F.contains(line, F.lit(emote))) for emote, (mood, weight) in (emotes or {}).items()]
    found += [one(PULSE, 1.0, laughs(line)), *(one(PULSE, 1.0, F.contains(line, F.lit(m))) for m in LAUGH_MARKS), one(PULSE, 1.0, F.contains(line, F.lit("+1")))]
    return F.array_compact(F.array(*found))


def pulse_buckets(signals: DataFrame, bucket: int, keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """keys, bucket, score, n, mood, first_seq of signals (keys, sec, seq, mood, weight): buckets from second 0, the mood of the
    largest weight, of equal ones the first seen."""
    moods = signals.groupBy(*keys, F.floor(F.col("sec") / bucket).cast("bigint").alias("bucket"), "mood").agg(F.sum("weight").alias("w"), F.min("seq").alias("first_seq"), F.count("*").alias("n"))
    return moods.groupBy(*keys, "bucket").agg(
        F.round(F.sum("w"), 2).alias("score"), F.sum("n").alias("n"), F.max_by("mood", F.struct("w", -F.col("first_seq"))).alias("mood"), F.min("first_seq").alias("first_seq")
    )


def peaks(buckets: DataFrame, most: int, keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """The best buckets of each stream, numbered by rank."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "first_seq"))
    return buckets.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= most)


def verdicts(buckets: DataFrame, cfg: PulseConfig, keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """keys, n_markers, peak_start, peak_score, verdict: the mood of a stream's best bucket if it pulses, else how warm it is."""
    best = buckets.groupBy(*keys).agg(F.sum("n").alias("n_markers"), F.max_by(F.struct("bucket", "score", "mood"), F.struct("score", -F.col("first_seq"))).alias("b"))
    verdict = F.when(F.col("b.score") >= cfg.pulse_score, F.upper("b.mood")).when(F.col("n_markers") >= cfg.hot_min, "HOT").when(F.col("n_markers") >= 1, "WARM").otherwise("QUIET")
    return best.select(*keys, "n_markers", (F.col("b.bucket") * cfg.bucket).alias("peak_start"), F.col("b.score").alias("peak_score"), verdict.alias("verdict"))


def segments(buckets: DataFrame, bounds: DataFrame, cfg: PulseConfig, keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """keys, start, end, mood: pulsing peaks and the natural spans between; bounds: keys, n_start, n_secs."""
    top = peaks(buckets, cfg.max_peaks, keys).where(F.col("score") >= cfg.pulse_score)
    top = top.select(*keys, (F.col("bucket") * cfg.bucket).alias("start"), ((F.col("bucket") + 1) * cfg.bucket).alias("end"), F.lower("mood").alias("mood"))
    w = Window.partitionBy(*keys).orderBy("start")
    before = top.join(bounds, list(keys)).select(*keys, F.coalesce(F.lag("end").over(w), F.col("n_start")).alias("start"), F.col("start").alias("end"), F.lit("natural").alias("mood")).where("start < end")
    last = top.groupBy(*keys).agg(F.max("end").alias("_end"))
    tail = bounds.join(last, list(keys), "left").select(*keys, F.coalesce("_end", "n_start").alias("start"), F.col("n_secs").alias("end"), F.lit("natural").alias("mood")).where("start < end")
    return top.unionByName(before).unionByName(tail)


def stats(windows: DataFrame, keys: tuple[str, ...], messages: DataFrame, signals: DataFrame) -> DataFrame:
    """windows with n_messages, n_markers, density, n_start, n_secs; windows without messages count 0."""
    m = messages.groupBy(*keys).agg(F.count("*").alias("n_messages"), F.min("sec").alias("n_start"), F.max("sec").alias("n_secs"))
    s = signals.groupBy(*keys).agg(F.count("*").alias("n_markers"))
    both = windows.join(m, list(keys), "left").join(s, list(keys), "left").fillna(0, ["n_messages", "n_markers", "n_start", "n_secs"])
    return both.withColumn("density", F.round(F.coalesce(F.try_divide("n_markers", "n_messages"), F.lit(0.0)), 3))


def with_tone(rows: DataFrame, hints: dict[str, tuple[str, list[str]]], fallback: tuple[str, list[str]], mood: str = "verdict") -> DataFrame:
    """rows with the tone and verbs of their verdict, or the fallback's."""
    spark = rows.sparkSession
    dim = spark.createDataFrame([(k, t, v) for k, (t, v) in hints.items()], f"{mood} string, tone string, verbs array<string>")
    both = rows.join(F.broadcast(dim), mood, "left")  # a dictionary's size
    return both.withColumn("tone", F.coalesce("tone", F.lit(fallback[0]))).withColumn("verbs", F.coalesce("verbs", F.array(*map(F.lit, fallback[1]))))


def clock_segments(rows: DataFrame) -> DataFrame:
    return rows.withColumn("start", fmt_clock(F.col("start"))).withColumn("end", fmt_clock(F.col("end")))
