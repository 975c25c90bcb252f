"""The windowed and stateful operators as Structured Streaming, equal to their batch forms where nothing comes too late."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_time(rows: DataFrame, sec: str = "sec") -> DataFrame:
    """rows with ts, the second of a stream as event time."""
    return rows.withColumn("ts", F.timestamp_seconds(F.col(sec)))


def pulse_stream(signals: DataFrame, bucket: str = "90 seconds", late: str = "10 minutes", keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """keys, bucket_start, score, n of signals (keys, ts, weight), once no event can come into a bucket any more."""
    out = signals.withWatermark("ts", late).groupBy(*keys, F.window("ts", bucket).alias("w")).agg(F.round(F.sum("weight"), 2).alias("score"), F.count("*").alias("n"))
    return out.select(*keys, F.unix_seconds("w.start").alias("bucket_start"), "score", "n")


def chunk_stream(items: DataFrame, block: str = "300 seconds", step: str = "270 seconds", late: str = "10 minutes", keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """keys, window_start, n of hopping chunks; windows before the stream's start are left out."""
    out = items.withWatermark("ts", late).groupBy(*keys, F.window("ts", block, step).alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.unix_seconds("w.start").alias("window_start"), "n").where("window_start >= 0")


def session_stream(events: DataFrame, gap: str = "600 seconds", late: str = "10 minutes", keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """keys, session_start, session_end, n of events no further apart than a gap."""
    out = events.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.unix_seconds("w.start").alias("session_start"), F.unix_seconds("w.end").alias("session_end"), "n")


def dedup_stream(lines: DataFrame, columns: tuple[str, ...] = ("stream", "raw"), late: str = "10 minutes") -> DataFrame:
    """Each line once, as long as its copies come within the watermark."""
    return lines.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(columns))


def with_signals(chunks: DataFrame, signals: DataFrame, key: str = "chunk") -> DataFrame:
    """A stream of chunks beside a static table of their signals."""
    return chunks.join(signals, key, "left")


def kept_stream(rows: DataFrame, within: int = 600, key: str = "stream", tags: Sequence[str] | None = None, late: str | None = None) -> DataFrame:
    """key, sec, tag, seq without rows of a listed tag (any, if there is no list) less than so long after the last kept row, if that
    has the same tag.

    State: the last kept row of a key, and with `late` (rows with ts) the rows that one before them may still precede. Those wait
    until the watermark has passed them, so the result is the batch form's however the rows come in, if none is later than that.
    Without `late` rows are taken in order of their seconds within a micro-batch, each micro-batch after the one before.
    """
    listed = None if tags is None else frozenset(tags)

    def keep(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tag, at, secs, names, seqs = state.get if state.exists else (None, -(1 << 40), [], [], [])
        waiting = list(zip(secs, names, seqs, strict=True))
        if not state.hasTimedOut:
            for rows in batches:
                waiting += zip(rows["sec"].tolist(), rows["tag"].tolist(), rows["seq"].tolist(), strict=True)
        safe = state.getCurrentWatermarkMs() // 1000 if late else 1 << 62
        out, later = [], []
        for row in sorted(waiting, key=lambda r: (r[0], r[2])):
            if row[0] >= safe:
                later.append(row)
            elif not (row[1] == tag and row[0] - at < within and (listed is None or tag in listed)):
                tag, at = row[1], row[0]
                out.append((k[0], row[0], row[1], row[2]))
        state.update((tag, int(at), *([r[j] for r in later] for j in range(3))))
        if later:
            state.setTimeoutTimestamp(max(later[0][0] * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "sec", "tag", "seq"])

    kind = rows.schema[key].dataType.simpleString()
    if late:
        rows = rows.withWatermark("ts", late)
    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(keep, f"{key} {kind}, sec bigint, tag string, seq bigint", "tag string, sec bigint, secs array<bigint>, tags array<string>, seqs array<bigint>", "append", timeout)


def write_once(rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str]):  # noqa: ANN201
    """Starts a stream into Parquet at a path, a folder for each micro-batch, written over if the batch runs again: a run that ended
    half-way leaves nothing twice. Rows of equal keys within a micro-batch count once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(list(keys)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
