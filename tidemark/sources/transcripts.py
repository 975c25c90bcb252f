"""Transcripts: captions, speech recognition output, chunk files. All give text, start, duration, timestamp with file and place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import chunk_number, fmt_clock, parse_clock
from tidemark.functions.text import label_text, strip

CAPTIONS = "events array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string>>>>"
WHISPER = "transcription array<struct<text:string,offsets:struct<`from`:bigint,`to`:bigint>>>"
SEGMENTS = "segments array<struct<id:bigint,start:double,`end`:double,text:string>>"
ITEM = "struct<text:string,start:double,duration:double,timestamp:string,image:string>"
CHUNK = f"start_sec bigint, end_sec bigint, items array<{ITEM}>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.withColumn("file", F.col("_metadata.file_name"))


def captions(spark: SparkSession, path: str) -> DataFrame:
    """Caption events as items: file, pos, text, start, duration, timestamp; events without text are left out."""
    rows = _json(spark, path, CAPTIONS).select("file", F.posexplode("events").alias("pos", "e")).where("e.segs is not null")
    text = strip(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    start = F.coalesce("e.tStartMs", F.lit(0)) / 1000.0
    return rows.select("file", "pos", text.alias("text"), start.alias("start"), (F.coalesce("e.dDurationMs", F.lit(0)) / 1000.0).alias("duration"), fmt_clock(start).alias("timestamp")).where("text <> ''")


def items(spark: SparkSession, path: str) -> DataFrame:
    """Items stored as a JSON array of them: file, pos and the items' fields."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    item = "struct<text:string,start:double,duration:double,timestamp:string,image:string,uncertain:boolean>"
    return whole.select("file", F.posexplode(F.from_json("value", f"array<{item}>")).alias("pos", "i")).select("file", "pos", "i.*")


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """Caption files (an object with events) and item files (an array) under one path; each row of either is read by its shape."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    item = "struct<text:string,start:double,duration:double,timestamp:string>"
    plain = whole.where(F.ltrim("value").startswith("[")).select("file", F.posexplode(F.from_json("value", f"array<{item}>")).alias("pos", "i")).select("file", "pos", "i.*")
    event = whole.where(F.ltrim("value").startswith("{")).select("file", F.from_json("value", f"struct<{CAPTIONS.replace('events ', 'events:')}>").alias("d"))
    event = event.select("file", F.posexplode("d.events").alias("pos", "e")).where("e.segs is not null")
    text = strip(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    start = F.coalesce("e.tStartMs", F.lit(0)) / 1000.0
    event = event.select("file", "pos", text.alias("text"), start.alias("start"), (F.coalesce("e.dDurationMs", F.lit(0)) / 1000.0).alias("duration"), fmt_clock(start).alias("timestamp")).where("text <> ''")
    return event.unionByName(plain)


def whisper(spark: SparkSession, path: str) -> DataFrame:
    """Recognised segments (milliseconds) as items; texts of a character or none are left out."""
    rows = _json(spark, path, WHISPER).select("file", F.posexplode("transcription").alias("pos", "t"))
    start = F.col("t.offsets.from") / 1000.0
    return rows.select("file", "pos", strip(F.col("t.text")).alias("text"), start.alias("start"), ((F.col("t.offsets.to") - F.col("t.offsets.from")) / 1000.0).alias("duration"), fmt_clock(start).alias("timestamp")).where("length(text) > 1")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """Recognised segments (seconds): file, id, start, end, text."""
    return _json(spark, path, SEGMENTS).select("file", F.inline("segments"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0), line of text files.

    Large files are read in blocks: a line's number is its place in its block and the number of lines in the blocks before, of
    which there are few.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    blocks = lines.groupBy("_path", "_block").agg(F.count("*").alias("_n"))
    before = blocks.select(F.col("_path").alias("_p"), F.col("_block").alias("_b"), (F.sum("_n").over(Window.partitionBy("_path").orderBy("_block")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_path", "_block").orderBy("_id")) - 1
    found = lines.withColumn("_at", place).join(before, (F.col("_path") == F.col("_p")) & (F.col("_block") == F.col("_b")))
    return found.select("file", (F.col("_before") + F.col("_at")).cast("int").alias("line_no"), "line")


def found_files(spark: SparkSession, pattern: str) -> list[str]:
    """The files that a pattern finds, in any file system that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return [f.getPath().toString() for f in found or []]


def chunks(spark: SparkSession, path: str, both: bool = False, ordered: bool = False) -> DataFrame:
    """chunk, chunk_no, start_sec, end_sec, items of a chunk file, by its suffix, or of a folder's chunk_* files.

    Of a folder the JSON files count, or the XML files if there are none; both: all of either kind. ordered: by the chunks' numbers,
    not by their names.
    """
    if path.endswith((".json", ".xml")):
        found = chunks_xml(spark, path) if path.endswith(".xml") else chunks_json(spark, path)
    else:
        readers = {"json": chunks_json, "xml": chunks_xml}
        there = [kind for kind in readers if found_files(spark, f"{path}/chunk_*.{kind}")]
        parts = [readers[kind](spark, f"{path}/chunk_*.{kind}") for kind in (there if both else there[:1])]
        if not parts:
            return spark.createDataFrame([], f"chunk string, chunk_no int, {CHUNK}")
        found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return found.orderBy("chunk_no", "chunk") if ordered else found


def chunks_json(spark: SparkSession, path: str) -> DataFrame:
    """chunk, chunk_no, start_sec, end_sec, items of chunk_*.json."""
    return _chunks(_json(spark, path, CHUNK))


def chunks_xml(spark: SparkSession, path: str, tag: str = "chunk") -> DataFrame:
    """The same of chunk_*.xml."""
    item = "struct<_VALUE:string,_start:double,_timestamp:string,_image:string>"
    rows = spark.read.format("xml").option("rowTag", tag).schema(f"_start_sec bigint, _end_sec bigint, item array<{item}>").load(path).withColumn("file", F.col("_metadata.file_name"))
    as_items = F.transform(F.coalesce("item", F.expr(f"cast(array() as array<{item}>)")), lambda i: F.struct(F.coalesce(i["_VALUE"], F.lit("")).alias("text"), F.coalesce(i["_start"], F.lit(0.0)).alias("start"), F.lit(None).cast("double").alias("duration"), F.coalesce(i["_timestamp"], F.lit("")).alias("timestamp"), i["_image"].alias("image")))
    return _chunks(rows.select("file", F.coalesce("_start_sec", F.lit(0).cast("bigint")).alias("start_sec"), F.col("_end_sec").alias("end_sec"), as_items.alias("items")))


def _chunks(rows: DataFrame) -> DataFrame:
    name = F.regexp_replace("file", r"\.[^.]*$", "")
    return rows.select(name.alias("chunk"), chunk_number(F.col("file")).alias("chunk_no"), "start_sec", "end_sec", "items")


def chunk_texts(chunks: DataFrame) -> DataFrame:
    """chunk, chunk_no, start_sec, text: the items' texts in order, joined by spaces."""
    return chunks.select("chunk", "chunk_no", F.coalesce("start_sec", F.lit(0)).alias("start_sec"), F.array_join(F.transform("items", lambda i: F.coalesce(i["text"], F.lit(""))), " ").alias("text"))


def srt(spark: SparkSession, path: str) -> DataFrame:
    """file, block, start_sec, end_sec, text of subtitle blocks of three lines or more; an end that isn't there is the start."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", r"\r\n?", "\n").alias("value"))
    return srt_blocks(whole, "value", ("file",))


def srt_blocks(rows: DataFrame, column: str, keys: tuple[str, ...]) -> DataFrame:
    blocks = rows.select(*keys, F.posexplode(F.split(F.trim(column, F.lit("\n \t")), r"\n\s*\n")).alias("block", "b")).withColumn("l", F.split("b", "\n")).where("size(l) >= 3")
    clock = r"(\d+):(\d+):(\d+)[,.]\d+"
    second = lambda text, at="": F.regexp_extract(text, at + clock, 1).try_cast("bigint") * 3600 + F.regexp_extract(text, at + clock, 2).try_cast("bigint") * 60 + F.regexp_extract(text, at + clock, 3).try_cast("bigint")
    line = F.get("l", F.lit(1))
    rows = blocks.where(line.rlike(clock))
    ends = F.when(line.rlike(rf"-->\s*{clock}"), second(line, r"-->\s*"))
    return rows.select(*keys, "block", second(line).alias("start_sec"), F.coalesce(ends, second(line)).alias("end_sec"), F.trim(F.array_join(F.slice("l", 3, 10_000), " ")).alias("text"))


def scenes(rows: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, scene (from 1), start, end, duration, label of ranges [H:MM:SS - H:MM:SS] in a plan; of a label the bold part counts."""
    pattern = r"\[(\d{1,2}:\d{2}(?::\d{2})?)\s*[-–]\s*(\d{1,2}:\d{2}(?::\d{2})?)\]([^\n]*)"
    part = lambda k: F.regexp_extract_all(column, F.lit(pattern), F.lit(k))
    found = rows.select(*keys, F.posexplode(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"))).alias("k", "z"))
    bold = F.regexp_extract("z.c", r"\*\*(.+?)\*\*", 1)
    plain = label_text(F.regexp_replace("z.c", r"^[\s:–-]+", ""))
    number = F.col("k") + 1
    out = found.select(*keys, number.alias("scene"), parse_clock(F.col("z.a")).alias("start"), parse_clock(F.col("z.b")).alias("end"), F.when(bold != "", label_text(bold)).when(plain != "", plain).otherwise(F.concat(F.lit("Scene "), number.cast("string"))).alias("label"))
    return out.withColumn("duration", F.col("end") - F.col("start"))
