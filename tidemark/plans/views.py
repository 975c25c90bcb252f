"""The logical tables that the queries read, made of the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.markers import parse_markers, render

#: The first second of the events' time line.
EPOCH = 1704067200
#: Event kinds by macro, as MACROS has tags.
KIND_MACROS = {"Click": "TALK", "View": "TALK", "Purchase": "GAMEPLAY", "Signup": "NEWS"}
WORDS = [("error", "fault", "fault.md"), ("the", "function", None), ("ion", "suffix", "suffix.md"), ("heit", "suffix", "german.md"), ("que", "function", "romance.md"), ("license", "legal", "license.md"), ("ther", "stem", "stem.md"), ("zzz", "none", "none.md")]

SQL_CHAT = f"""chat as (select (cast(floor(epoch(ts)) as bigint) - {EPOCH}) // 86400 as stream, (cast(floor(epoch(ts)) as bigint) - {EPOCH}) % 86400 as sec,
  event_id as seq, event_type as kind, value as w, props, user_id from events)"""
SQL_CLOCK = "printf('%02d:%02d:%02d', cast({0} as bigint) // 3600, cast({0} as bigint) % 3600 // 60, cast({0} as bigint) % 60)"
SQL_MARKERS = SQL_CHAT + f""", markers as (select stream, seq, sec, {SQL_CLOCK.format("sec")} as time, '[' || upper(kind[1]) || kind[2:] || ']' as tag, props as desc,
  {SQL_CLOCK.format("sec")} || ' - [' || upper(kind[1]) || kind[2:] || '] ' || props as raw,
  case kind when 'click' then 'TALK' when 'view' then 'TALK' when 'purchase' then 'GAMEPLAY' when 'signup' then 'NEWS' else upper(kind[1]) || kind[2:] end as macro,
  strlen({SQL_CLOCK.format("sec")} || ' - [' || upper(kind[1]) || kind[2:] || '] ' || props) as bytes from chat)"""
SQL_ITEMS = "items as (select conv_id as stream, turn as pos, turn * 45.0::double as start, 45.0::double as dur, role, coalesce(text, '') as text from conversations)"
SQL_LINES = """lines as (select doc_id as doc, i - 1 as pos, string_split(text, chr(10))[i] as line from
  (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents))"""
SQL_WORDS = "kw(kw_pos, keyword, kind, file) as (values " + ", ".join(f"({k}, '{w}', '{kind}', {repr(f) if f else 'null'})" for k, (w, kind, f) in enumerate(WORDS)) + ")"


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """Queries, their SQL, and a decorator that enters both."""
    queries: dict[str, Callable] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable:
        def enter(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return enter

    return queries, oracles, query


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chat(spark: SparkSession, sf: str) -> DataFrame:
    t = F.unix_seconds(F.col("ts").cast("timestamp")) - EPOCH
    return read(spark, sf, "events").select(F.floor(t / 86400).cast("bigint").alias("stream"), (t % 86400).alias("sec"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.col("value").alias("w"), "props", "user_id")


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return chat(spark, sf).select("stream", "sec", "seq", F.col("kind").alias("mood"), F.col("w").alias("weight"))


def markers(spark: SparkSession, sf: str) -> DataFrame:
    """The events as marker lines, parsed back."""
    from tidemark.operators.markers import primary_tag

    lines = chat(spark, sf).select("stream", "seq", render(F.col("sec"), F.initcap("kind"), F.col("props")).alias("line"))
    return parse_markers(lines).drop("line").withColumn("macro", primary_tag(F.col("tag"), KIND_MACROS))


def items(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("stream"), F.col("turn").alias("pos"), (F.col("turn") * 45.0).alias("start"), F.lit(45.0).alias("dur"), "role", F.coalesce("text", F.lit("")).alias("text"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *w) for k, w in enumerate(WORDS)], "kw_pos int, keyword string, kind string, file string")
