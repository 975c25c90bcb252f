"""Live chat: replay files (JSON lines), raw feeds, chunk windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.clock import fmt_clock, parse_clock
from tidemark.functions.text import strip
from tidemark.sources.transcripts import numbered_lines

_RUNS = "message:struct<runs:array<struct<text:string,emoji:struct<shortcuts:array<string>,searchTerms:array<string>>>>>"
_AUTHOR = "authorName:struct<simpleText:string>"
_AMOUNT = "purchaseAmountText:struct<simpleText:string>"
REPLAY = (
    "struct<replayChatItemAction:struct<videoOffsetTimeMsec:string,actions:array<struct<addChatItemAction:struct<item:struct<"
    f"liveChatTextMessageRenderer:struct<{_AUTHOR},{_RUNS}>,liveChatPaidMessageRenderer:struct<{_AUTHOR},{_AMOUNT},{_RUNS}>,"
    f"liveChatPaidStickerRenderer:struct<{_AUTHOR},{_AMOUNT}>>>>>>>"
)


def run_text(run: Column) -> Column:
    """A message run as text: its text, else a channel's own shortcut, the first shortcut, or the first search term."""
    shortcuts = run["emoji"]["shortcuts"]
    term = F.get(run["emoji"]["searchTerms"], F.lit(0))
    return F.coalesce(run["text"], F.get(F.filter(shortcuts, lambda s: s.startswith(":_")), F.lit(0)), F.get(shortcuts, F.lit(0)), F.concat(F.lit(":"), F.trim(term, F.lit(":")), F.lit(":")), F.lit(""))


def replay(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, sec, author, kind (text, paid, sticker), amount, msg of a replay's first actions; bad lines are left out."""
    return parse_replay(numbered_lines(spark, path))


def parse_replay(lines: DataFrame) -> DataFrame:
    parsed = lines.select("file", "line_no", F.from_json("line", REPLAY).alias("j")).select("file", "line_no", "j.replayChatItemAction.*").where("actions is not null")
    item = F.get("actions", F.lit(0))["addChatItemAction"]["item"]
    kinds = [("text", "liveChatTextMessageRenderer"), ("paid", "liveChatPaidMessageRenderer"), ("sticker", "liveChatPaidStickerRenderer")]
    kind = F.coalesce(*(F.when(item[f].isNotNull(), F.lit(k)) for k, f in kinds))
    author = F.coalesce(*(item[f]["authorName"]["simpleText"] for _, f in kinds), F.lit("Unknown"))
    amount = F.coalesce(*(item[f]["purchaseAmountText"]["simpleText"] for _, f in kinds[1:]))
    runs = F.coalesce(*(item[f]["message"]["runs"] for _, f in kinds[:2]))
    msg = strip(F.coalesce(F.array_join(F.transform(runs, run_text), ""), F.lit("")))
    sec = F.floor(F.coalesce(F.col("videoOffsetTimeMsec").try_cast("bigint"), F.lit(0)) / 1000).cast("bigint")
    return parsed.select("file", "line_no", sec.alias("sec"), author.alias("author"), kind.alias("kind"), amount.alias("amount"), msg.alias("msg")).where("kind is not null and (kind <> 'text' or msg <> '')")


def chat_line(rows: DataFrame) -> Column:
    """[HH:MM:SS] author: message, with the amount of a paid one."""
    paid = F.when(rows["amount"].isNotNull(), F.concat(F.lit(" ("), rows["amount"], F.lit(")"))).otherwise("")
    return F.concat(F.lit("["), fmt_clock(rows["sec"]), F.lit("] "), rows["author"], paid, F.lit(": "), rows["msg"])


def feed(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, sec, line of a raw feed (seconds, tab, line); lines without seconds are left out."""
    return parse_feed(numbered_lines(spark, path))


def parse_feed(lines: DataFrame) -> DataFrame:
    parts = F.split("line", "\t", 2)
    return lines.select("file", "line_no", F.trim(F.get(parts, F.lit(0))).try_cast("bigint").alias("sec"), F.get(parts, F.lit(1)).alias("line")).where("sec is not null and line is not null")


def windows_from_index(spark: SparkSession, path: str) -> DataFrame:
    """chunk, start, end of a chunk index; entries whose bounds aren't whole numbers are left out."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<file:string,count:bigint,start:string,`end`:string>>")).alias("chunk", "w"))
    return whole.select("chunk", F.col("w.start").try_cast("bigint").alias("start"), F.col("w.end").try_cast("bigint").alias("end")).where("start is not null and end is not null")


def windows_from_logs(lines: DataFrame) -> DataFrame:
    """chunk, start, end (past the last second) of chat logs whose lines begin with [HH:MM:SS]; lines: chunk, line."""
    sec = parse_clock(F.regexp_extract("line", r"^\[(\d{2}:\d{2}:\d{2})\]", 1))
    return lines.where(F.col("line").rlike(r"^\[\d{2}:\d{2}:\d{2}\]")).groupBy("chunk").agg(F.min(sec).alias("start"), (F.max(sec) + 1).alias("end"))
