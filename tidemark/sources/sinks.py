"""Sinks: chunk files, chat logs, parts, tables. All are distributed writes; a path is never read and overwritten at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clock import fmt_clock
from tidemark.functions.text import clean, escape_xml, strip
from tidemark.operators.catalog import children as child_rows
from tidemark.operators.catalog import to_text_columns


def write_chunks(chunked: DataFrame, path: str, kind: str = "json", overlap: int = 0) -> None:
    """Writes items with chunk_no, window_start and window_end as one folder per chunk: json, xml or txt."""
    item = F.struct("start", "text", F.col("dur").alias("duration"), fmt_clock(F.col("start")).alias("timestamp"))
    chunks = chunked.groupBy("chunk_no", F.col("window_start").cast("bigint").alias("start_sec"), F.col("window_end").cast("bigint").alias("end_sec")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    if kind == "json":
        chunks.withColumn("chunk", F.col("chunk_no")).write.partitionBy("chunk").json(path)
        return
    if kind == "xml":
        lines = F.transform("items", lambda i: F.concat(F.lit('  <item start="'), i["start"].cast("string"), F.lit('" timestamp="'), i["timestamp"], F.lit('">'), escape_xml(i["text"]), F.lit("</item>")))
        head = F.format_string('<chunk id="%d" start_sec="%d" end_sec="%d">', "chunk_no", "start_sec", "end_sec")
        value = F.concat(head, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n</chunk>"))
    else:
        cutoff = F.col("end_sec") - overlap
        head = F.format_string("# chunk %d: %s - %s (stamp before %s)", F.col("chunk_no"), fmt_clock(F.col("start_sec")), fmt_clock(F.col("end_sec")), fmt_clock(cutoff))
        value = F.concat(head, F.lit("\n"), F.array_join(F.transform("items", lambda i: F.concat(i["timestamp"], F.lit(" | "), i["text"])), "\n"))
    chunks.select(F.col("chunk_no").alias("chunk"), value.alias("value")).write.partitionBy("chunk").text(path)


def write_feed(rows: DataFrame, path: str, line: Column) -> None:
    """Seconds, tab, line, in order within each file."""
    rows.select("sec", F.concat_ws("\t", F.col("sec").cast("string"), line).alias("value")).sortWithinPartitions("sec").select("value").write.text(path)


def write_chat_logs(joined: DataFrame, path: str, index_path: str) -> None:
    """Chat lines by chunk, and an index of chunk, count, start, end that keeps chunks without lines; those have an empty folder."""
    joined.where("line is not null").select("chunk", "sec", F.col("line").alias("value")).repartition("chunk").sortWithinPartitions("chunk", "sec").drop("sec").write.partitionBy("chunk").text(path)
    joined.groupBy("chunk", "start", "end").agg(F.count("line").alias("count")).write.json(index_path)
    spark = joined.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in spark.read.schema("chunk string, count bigint").json(index_path).where("count = 0").toLocalIterator():
        files.mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"chunk={r['chunk']}"))


def parts_markdown(rows: DataFrame, titles: DataFrame, keys: tuple[str, ...] = ("stream",), order: tuple[str, ...] = ("sec", "seq"), rule: str = "═" * 30) -> DataFrame:
    """keys, part, title, start, body, markdown of packed markers."""
    body = rows.groupBy(*keys, "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "raw"))), lambda r: r["raw"]), "\n").alias("body"), F.min("sec").alias("_first"))
    head = F.concat(F.lit(f"{rule}\n"), F.format_string("Part %d: ", F.col("part") + 1), F.coalesce("title", F.lit("")), F.lit(f"\n{rule}\n"))
    both = body.join(titles, [*keys, "part"], "left")
    return both.select(*keys, "part", F.coalesce("title", F.lit("")).alias("title"), fmt_clock(F.col("_first")).alias("start"), "body", F.concat(head, "body", F.lit("\n")).alias("markdown"))


def write_parts(parts: DataFrame, markdown_path: str, json_path: str, keys: tuple[str, ...] = ("stream",)) -> None:
    """Markdown and JSON of parts in their order, within the files and by the files' names."""
    ranged = parts.orderBy(*keys, "part")
    ranged.select(F.col("markdown").alias("value")).write.text(markdown_path)
    ranged.select(*keys, "part", "title", "start", "body").write.json(json_path)


def write_live_chunks(rows: DataFrame, path: str, line: Column, span: int = 300) -> None:
    """Chat lines in folders livechat_chunk_1, _2, ... by spans of seconds, in order within each."""
    name = F.concat(F.lit("livechat_chunk_"), (F.floor(F.col("sec") / span) + 1).cast("string"))
    out = rows.select(name.alias("chunk"), "sec", line.alias("value"))
    out.repartition("chunk").sortWithinPartitions("chunk", "sec").drop("sec").write.partitionBy("chunk").text(path)


def write_report(rows: DataFrame, path: str, key: str = "chunk", matched: Column | None = None) -> None:
    """A report by chunk (signals, moods, topics): a JSON line for each, and a summary of how many there are and match."""
    body = F.to_json(F.struct(*(c for c in rows.columns if c != key)))
    rows.select(key, body.alias("report")).orderBy(key).write.json(f"{path}/chunks")
    hit = F.count_if(matched if matched is not None else F.lit(True))
    rows.agg(F.count("*").alias("chunks_processed"), hit.alias("chunks_with_signals")).write.json(f"{path}/summary")


def clean_chunks(chunks: DataFrame, patterns: Sequence[tuple[str, str]], path: str | None = None) -> DataFrame:
    """chunk, pos, before, after of every item that the patterns change; the cleaned chunks go to a new path, unless it is None
    (a dry run). Texts are compared without the space around them."""
    items = chunks.select("chunk", F.posexplode("items").alias("pos", "i")).select("chunk", "pos", strip(F.coalesce("i.text", F.lit(""))).alias("before"))
    changes = items.withColumn("after", clean(F.col("before"), patterns)).where("before <> after")
    if path is not None:
        done = F.transform("items", lambda i: i.withField("text", F.when(clean(strip(i["text"]), patterns) != strip(i["text"]), clean(strip(i["text"]), patterns)).otherwise(i["text"])))
        chunks.withColumn("items", done).write.partitionBy("chunk").json(path)
    return changes


def write_catalog(rows: DataFrame, path: str, version: str, built: str, keys: tuple[str, ...], children: dict[str, str]) -> None:
    """A catalog's tables, each written anew: the entities with nested values as JSON, and a table for each array of children."""
    write_table(to_text_columns(rows.drop(*children.values())), f"{path}/entities", version, built)
    for name, array in children.items():
        write_table(to_text_columns(child_rows(rows, array, keys)), f"{path}/{name}", version, built)


def write_table(rows: DataFrame, path: str, version: str, built: str) -> None:
    """A catalog table in Parquet beside its version."""
    rows.write.mode("overwrite").parquet(f"{path}/data")
    rows.sparkSession.createDataFrame([("version", version), ("built", built)], "key string, value string").write.mode("overwrite").parquet(f"{path}/meta")
