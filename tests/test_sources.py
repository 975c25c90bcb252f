"""Sources and sinks over small files, and streams against their batch forms."""

import json

from pyspark.sql import functions as F

from tidemark.operators import windows
from tidemark.sources import livechat, markers, sinks, transcripts
from tidemark.streaming import windows as streams


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_captions_and_transcripts(spark, tmp_path):
    doc = {"events": [{"tStartMs": 1500, "dDurationMs": 500, "segs": [{"utf8": " Hel"}, {"utf8": "lo "}]}, {"tStartMs": 9}, {"tStartMs": 0, "segs": [{"utf8": "\n"}]}]}
    path = write(tmp_path / "a.json", json.dumps(doc))
    assert [(r.text, r.start, r.duration, r.timestamp) for r in transcripts.captions(spark, path).collect()] == [("Hello", 1.5, 0.5, "00:00:01")]
    write(tmp_path / "b.json", json.dumps([{"text": "x", "start": 2.0, "duration": 1.0, "timestamp": "00:00:02"}]))
    assert sorted(r.text for r in transcripts.transcript(spark, str(tmp_path)).collect()) == ["Hello", "x"]


def test_whisper(spark, tmp_path):
    path = write(tmp_path / "w.json", json.dumps({"transcription": [{"text": " hi there ", "offsets": {"from": 1000, "to": 2500}}, {"text": "x", "offsets": {"from": 0, "to": 1}}]}))
    assert [(r.text, r.start, r.duration) for r in transcripts.whisper(spark, path).collect()] == [("hi there", 1.0, 1.5)]


def test_chunks(spark, tmp_path):
    for k in (10, 2):
        write(tmp_path / f"chunk_{k:03d}.json", json.dumps({"start_sec": k, "items": [{"text": "Hello"}, {"text": "World"}]}))
    got = transcripts.chunk_texts(transcripts.chunks_json(spark, str(tmp_path / "chunk_*.json"))).orderBy("chunk_no").collect()
    assert [(r.chunk, r.start_sec, r.text) for r in got] == [("chunk_002", 2, "Hello World"), ("chunk_010", 10, "Hello World")]
    write(tmp_path / "chunk_00.xml", '<chunk id="0" start_sec="0" end_sec="300"><item start="1.5" timestamp="00:00:01">t &amp; u</item></chunk>')
    x = transcripts.chunks_xml(spark, str(tmp_path / "chunk_00.xml")).first()
    assert (x.start_sec, x.end_sec, x["items"][0].text, x["items"][0].start) == (0, 300, "t & u", 1.5)


def test_replay(spark, tmp_path):
    def line(kind, msg=None, author="A", ms="61000", **more):
        body = more | ({"authorName": {"simpleText": author}} if author else {}) | ({"message": {"runs": msg}} if msg is not None else {})
        return json.dumps({"replayChatItemAction": {"videoOffsetTimeMsec": ms, "actions": [{"addChatItemAction": {"item": {kind: body}}}]}})

    lines = [
        line("liveChatTextMessageRenderer", [{"text": "hi "}, {"emoji": {"shortcuts": [":x:", ":_own:"]}}]), line("liveChatTextMessageRenderer", []), "not json",
        line("liveChatPaidMessageRenderer", author=None, purchaseAmountText={"simpleText": "THB 40.00"}), line("liveChatTextMessageRenderer", [{"emoji": {"searchTerms": [":joy:"]}}], ms=None),
    ]
    got = livechat.replay(spark, write(tmp_path / "c.jsonl", "\n".join(lines))).orderBy("line_no").collect()
    assert [(r.sec, r.author, r.kind, r.amount, r.msg) for r in got] == [(61, "A", "text", None, "hi :_own:"), (61, "Unknown", "paid", "THB 40.00", ""), (0, "A", "text", None, ":joy:")]


def test_feed_and_markers(spark, tmp_path):
    feed = livechat.feed(spark, write(tmp_path / "f.txt", "145\t[00:02:25] a: x\nnotanumber\tgarbage\n0\t[00:00:00] b: y\n\n"))
    assert sorted(r.sec for r in feed.collect()) == [0, 145]
    path = write(tmp_path / "m.txt", "01:00:02  -[Quiz]   Which river? \n00:42:10 a walk without a label\n... \n00:07:30 - [Map][Trip] Over the pass\n7:00:00 - [Map] one digit\n00:50:00 - [] bare")
    strict = markers.markers(spark, path).orderBy("sec").collect()
    assert [(r.sec, r.tag, r.desc, r.raw) for r in strict] == [(450, "[Map][Trip]", "Over the pass", "00:07:30 - [Map][Trip] Over the pass"), (3000, "[]", "bare", "00:50:00 - [] bare"), (3602, "[Quiz]", "Which river?", "01:00:02 - [Quiz] Which river?")]
    assert all(r.bytes == len(r.raw.encode()) for r in strict)
    flexible = markers.markers(spark, path, "flexible").orderBy("sec").collect()
    assert [(r.sec, r.tag, r.raw) for r in flexible] == [(450, "[Map]", "00:07:30 - [Map] [Trip] Over the pass"), (2530, "[Talk]", "00:42:10 - [Talk] a walk without a label"), (3000, "[Talk]", "00:50:00 - [Talk] bare"), (3602, "[Quiz]", "01:00:02 - [Quiz] Which river?")]
    mood = markers.markers(spark, path, "mood").orderBy("sec").collect()
    assert [(r.sec, r.desc) for r in mood] == [(450, "Over the pass"), (3000, "bare"), (3602, "  Which river?")]
    rows = spark.createDataFrame([("00:00:05 [A] x [B] y",), ("00:00:06 [A]z",), ("00:00:07 none",)], "line string")
    assert [(r.sec, r.desc) for r in markers.parse_markers(rows, grammar="mood").orderBy("sec").collect()] == [(5, "y"), (6, "00:00:06 [A]z")]
    rows = spark.createDataFrame([("1:02 - [A] b - c",), ("x - y",), ("00:00:09 -no",)], "line string")
    assert [(r.time, r.desc) for r in markers.parse_markers(rows, grammar="assembly").collect()] == [("1:02", "[A] b - c")]


def test_blocks_srt_scenes_notes(spark, tmp_path):
    rule = "═" * 10
    lines = transcripts.numbered_lines(spark, write(tmp_path / "p.md", f"intro\n{rule}\nPart 1\n{rule}\n00:00:01 - [A] x\n{rule}\nPart 2\n{rule}\ny\nz"))
    assert [(r.block, r.header, r.line) for r in markers.blocks(lines).orderBy("line_no").collect()] == [(1, "Part 1", "00:00:01 - [A] x"), (2, "Part 2", "y"), (2, "Part 2", "z")]
    path = write(tmp_path / "s.srt", "1\n00:00:01,500 --> 00:01:02,000\nHello\nyou\n\n2\nbroken\n\n3\n01:00:00,000\nText\n")
    assert [(r.start_sec, r.end_sec, r.text) for r in transcripts.srt(spark, path).orderBy("block").collect()] == [(1, 62, "Hello you"), (3600, 3600, "Text")]
    plan = spark.createDataFrame([("[0:01:00 - 0:02:00] **Big** win\n[1:00 - 1:30]\n[0:10:00-0:11:00] - `code`",)], "t string")
    assert [(r.scene, r.start, r.end, r.label) for r in transcripts.scenes(plan, "t").collect()] == [(1, 60, 120, "Big"), (2, 60, 90, "Scene 2"), (3, 600, 660, "code")]
    notes = spark.createDataFrame([(x, "part_2.txt") for x in ('"helo" -> hello @ 00:01:02 (chunk_03)', '- "x y" -> Unknown @ 00:00:01 (chunk_1)', '"helo" -> hello', '"a" -> b c (c9)', "no", 'GARBLED_NOTES "a" -> b', "a -> b")], "line string, file string")
    want = [("helo", "hello", "00:01:02", "chunk_03"), ("x y", None, "00:00:01", "chunk_1"), ("helo", "hello", "", "part_2"), ("a", "b c", "", "c9")]
    assert [(r.garbled, r.correct, r.ts, r.chunk) for r in markers.notes(notes).collect()] == want
    assert [r.chunk for r in markers.notes(notes.drop("file")).collect()] == ["chunk_03", "chunk_1", "", "c9"]


def test_dictionary_scans(tmp_path):
    put = lambda name, data: write(tmp_path / name, json.dumps(data))
    assert markers.replacements(put("v2.json", {"mappings": {" Word ": ["ab", "abc+", "(", ""], "One": "x"}})) == [("abc+", "Word"), ("ab", "Word"), ("x", "One")]
    assert markers.replacements(put("v1.json", {"replacements": [{"pattern": "a", "replacement": "b"}, {"pattern": "["}, {"replacement": "c"}, {"pattern": "long", "replacement": "d"}]})) == [("a", "b"), ("long", "d")]
    assert markers.emotes(put("e.json", {"emotes": {":x:": {"mood": "JOY", "weight": 2}, ":y:": {"mood": "SAD"}}})) == {":x:": ("JOY", 2.0), ":y:": ("SAD", 1.0)}
    assert markers.tones(put("t.json", {"hints": {"JOY": {"tone": "glad", "verbs": ["sings"]}}})) == {"JOY": ("glad", ["sings"])}
    assert markers.mapping(put("m.json", {"mapping": {"a": "A"}})) == markers.mapping(put("n.json", {"a": "A"})) == {"a": "A"}
    assert markers.signals(put("s.json", {"chunks": {"c": {"n": 1}}})) == markers.signals(put("u.json", {"c": {"n": 1}})) == {"c": {"n": 1}}
    assert markers.replacements("none") == [] and markers.emotes("none") == {}


def test_lines_of_large_files_are_numbered(spark, tmp_path):
    (tmp_path / "a").mkdir()
    want = {}
    for name, n in (("x.txt", 3000), ("y.txt", 1), ("z.txt", 0)):
        write(tmp_path / "a" / name, "".join(f"line {k} of {name}\r\n" if k % 2 else f"line {k} of {name}\n" for k in range(n)))
        want |= {(name, k): f"line {k} of {name}" for k in range(n)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = transcripts.numbered_lines(spark, str(tmp_path / "a"))
        assert {(r.file, r.line_no): r.line for r in rows.collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_chunks_of_either_format(spark, tmp_path):
    folder = tmp_path / "c"
    folder.mkdir()
    assert transcripts.chunks(spark, str(folder)).count() == 0
    for k in (10, 9):
        write(folder / f"chunk_{k}.xml", f'<chunk id="{k}" start_sec="{k}" end_sec="300"><item start="1.5" timestamp="00:00:01">xml {k}</item></chunk>')
    assert [r.chunk for r in transcripts.chunks(spark, str(folder), ordered=True).collect()] == ["chunk_9", "chunk_10"]
    for k in (2, 11):
        write(folder / f"chunk_{k}.json", json.dumps({"start_sec": k, "end_sec": 300, "items": [{"text": " teh end "}, {"text": "fine"}]}))
    read = lambda **how: [(r.chunk, r.text) for r in transcripts.chunk_texts(transcripts.chunks(spark, str(folder), ordered=True, **how)).collect()]
    assert read() == [("chunk_2", " teh end  fine"), ("chunk_11", " teh end  fine")]
    assert read(both=True) == [("chunk_2", " teh end  fine"), ("chunk_9", "xml 9"), ("chunk_10", "xml 10"), ("chunk_11", " teh end  fine")]
    assert transcripts.chunks(spark, str(folder / "chunk_9.xml")).first().chunk == "chunk_9" and transcripts.chunks(spark, str(folder / "chunk_2.json")).first().chunk_no == 2
    both, patterns = transcripts.chunks(spark, str(folder), both=True), [("teh", "the"), ("xml", "XML")]
    dry = sorted(map(tuple, sinks.clean_chunks(both, patterns).collect()))
    assert dry == [("chunk_10", 0, "xml 10", "XML 10"), ("chunk_11", 0, "teh end", "the end"), ("chunk_2", 0, "teh end", "the end"), ("chunk_9", 0, "xml 9", "XML 9")]
    assert sorted(map(tuple, sinks.clean_chunks(both, patterns, str(tmp_path / "clean")).collect())) == dry
    back = spark.read.json(str(tmp_path / "clean"))
    assert {r.chunk: [i.text for i in r["items"]] for r in back.collect()} == {"chunk_2": ["the end", "fine"], "chunk_11": ["the end", "fine"], "chunk_9": ["XML 9"], "chunk_10": ["XML 10"]}


def test_report_parts_and_catalog_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("c2", 3, ["a"]), ("c1", 0, [])], "chunk string, n int, files array<string>")
    sinks.write_report(rows, str(tmp_path / "r"), matched=F.col("n") > 0)
    assert {r.chunk: json.loads(r.report) for r in spark.read.json(str(tmp_path / "r" / "chunks")).collect()} == {"c1": {"n": 0, "files": []}, "c2": {"n": 3, "files": ["a"]}}
    assert tuple(spark.read.json(str(tmp_path / "r" / "summary")).select("chunks_processed", "chunks_with_signals").first()) == (2, 1)
    parts = spark.range(50).select((F.col("id") % 2).alias("stream"), F.floor(F.col("id") / 2).alias("part"), F.lit("t").alias("title"), F.lit("s").alias("start"), F.lit("b").alias("body"), F.concat(F.lit("m"), F.lpad("id", 2, "0")).alias("markdown"))
    sinks.write_parts(parts.repartition(5), str(tmp_path / "md"), str(tmp_path / "js"))
    lines = [x for f in sorted((tmp_path / "md").glob("part-*")) for x in f.read_text().split()]
    assert lines == [f"m{2 * k:02d}" for k in range(25)] + [f"m{2 * k + 1:02d}" for k in range(25)]
    chat_rows = spark.createDataFrame([(5, "a"), (301, "b"), (299, "c")], "sec long, msg string")
    sinks.write_live_chunks(chat_rows, str(tmp_path / "live"), F.col("msg"))
    assert {r.chunk: r.value for r in spark.read.text(str(tmp_path / "live")).groupBy("chunk").agg(F.array_join(F.array_sort(F.collect_list("value")), "").alias("value")).collect()} == {"livechat_chunk_1": "ac", "livechat_chunk_2": "b"}
    joined = spark.createDataFrame([("k1", 0, 9, 3, "x"), ("k2", 9, 18, None, None)], "chunk string, start long, end long, sec long, line string")
    sinks.write_chat_logs(joined, str(tmp_path / "logs"), str(tmp_path / "index"))
    assert {r.chunk: r["count"] for r in spark.read.json(str(tmp_path / "index")).collect()} == {"k1": 1, "k2": 0} and (tmp_path / "logs" / "chunk=k2").is_dir()
    cards = spark.createDataFrame([(1, ["x"], [(7, "r")])], "id int, tags array<string>, sets array<struct<no:int,rarity:string>>")
    for _ in range(2):
        sinks.write_catalog(cards, str(tmp_path / "cat"), "1", "today", ("id",), {"card_sets": "sets"})
    assert tuple(spark.read.parquet(str(tmp_path / "cat" / "entities" / "data")).first()) == (1, '["x"]') and tuple(spark.read.parquet(str(tmp_path / "cat" / "card_sets" / "data")).first()) == (1, 7, "r")


def test_dictionaries(tmp_path):
    assert markers.dictionary(str(tmp_path / "none.json")) == {}
    a, b = str(tmp_path / "a.json"), str(tmp_path / "b.json")
    markers.write_dictionary({"b": ["x", "long", "x"], "A": []}, a, b)
    assert json.load(open(a)) == json.load(open(b)) == {"A": [], "b": ["long", "x"]}


def test_sinks(spark, tmp_path):
    items = spark.createDataFrame([(1, 0.0, 10.0, "a <b>"), (1, 280.0, 10.0, "c"), (1, 400.0, 10.0, "d")], "stream int, start double, dur double, text string")
    chunked = windows.hop(items, 300, 30)
    for kind in ("json", "xml", "txt"):
        sinks.write_chunks(chunked, str(tmp_path / kind), kind, 30)
    back = transcripts.chunks_json(spark, str(tmp_path / "json" / "chunk=0" / "*.json")).first()
    assert [i.text for i in back["items"]] == ["a <b>", "c"]
    assert transcripts.chunks_xml(spark, str(tmp_path / "xml" / "chunk=0" / "*.txt")).first()["items"][0].text == "a <b>"


def watermark_sources(spark, path, rows):
    """rows in order of time over several files, one a micro-batch, and at the end a row that closes every window."""
    ordered = rows.orderBy("ts").collect()
    size = -(-len(ordered) // 5)
    last = ordered[-1].asDict() | {"ts": ordered[-1].ts.replace(year=ordered[-1].ts.year + 2), "stream": 99, "seq": -1}
    for k in range(0, len(ordered), size):
        spark.createDataFrame(ordered[k : k + size], rows.schema).coalesce(1).write.mode("append").parquet(str(path))
    for _ in range(2):  # windows go out with the micro-batch after the one that closes them
        spark.createDataFrame([last], rows.schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(path))


def collected(spark, frame, name):
    q = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.table(name).collect() if r[0] != 99)


def test_streams_equal_batches(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 3).alias("stream"), F.col("event_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"), F.col("value").alias("weight"), F.col("event_type").alias("tag"))
    rows = streams.event_time(rows)
    src = watermark_sources(spark, tmp_path / "in", rows)
    want = rows.groupBy("stream", F.floor(F.col("sec") / 3600).alias("b")).agg(F.round(F.sum("weight"), 2), F.count("*")).select("stream", (F.col("b") * 3600), *[F.col(c) for c in ("round(sum(weight), 2)", "count(1)")])
    assert collected(spark, streams.pulse_stream(src, "3600 seconds", "1 hour"), "pulses") == sorted(map(tuple, want.collect())) != []
    sessions = rows.groupBy("stream", F.session_window("ts", "600 seconds").alias("w")).agg(F.count("*").alias("n")).select("stream", F.unix_seconds("w.start"), F.unix_seconds("w.end"), "n")
    assert collected(spark, streams.session_stream(src, "600 seconds", "1 hour", ("stream",)), "sessions") == sorted(map(tuple, sessions.collect())) != []
    hops = rows.groupBy("stream", F.window("ts", "300 seconds", "270 seconds").alias("w")).agg(F.count("*").alias("n")).select("stream", F.unix_seconds("w.start"), "n")
    assert collected(spark, streams.chunk_stream(src, late="1 hour"), "hops") == sorted(map(tuple, hops.collect())) != []
    unique = streams.dedup_stream(src, ("stream", "tag"), "900 days").select("stream", "tag")
    assert collected(spark, unique, "uniques") == sorted(map(tuple, rows.select("stream", "tag").distinct().collect()))
    kinds = spark.createDataFrame([("click", 1)], "tag string, known int")
    assert collected(spark, streams.with_signals(src, kinds, "tag").select("stream", "seq", "known"), "static") == sorted(map(tuple, rows.join(kinds, "tag", "left").select("stream", "seq", "known").collect()), key=lambda r: (r[0], r[1]))


def test_kept_rows_over_many_batches(spark, tmp_path):
    """The stateful operator equals its batch form over micro-batches whose rows overlap in time; what is too late is left out."""
    from tidemark.operators.markers import adjacent_dedup

    data = [(k % 3, 10_000 + k * 97 % 6000, "AAB"[k * 7 % 3], k) for k in range(300)]  # Spark takes the second 0 for late
    data.sort(key=lambda r: r[1] // 1000)  # out of order within a thousand seconds
    rows = streams.event_time(spark.createDataFrame(data, "stream long, sec long, tag string, seq long")).select("stream", "sec", "tag", "seq", "ts")
    for k in range(0, 300, 40):
        streams.event_time(spark.createDataFrame(data[k : k + 40], "stream long, sec long, tag string, seq long")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = [(s, 10**6 + j, "Z", -1) for s in (0, 1, 2, 99) for j in (0, 1)]
    for _ in range(3):
        streams.event_time(spark.createDataFrame(end, "stream long, sec long, tag string, seq long")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for tags in (None, ("A",)):
        src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = [r for r in collected(spark, streams.kept_stream(src, 600, tags=tags, late="1200 seconds"), f"kept_{tags is None}") if r[3] >= 0]
        plain = adjacent_dedup(rows, 600, tags or ("A", "B")).select("stream", "sec", "tag", "seq")
        assert got == sorted(map(tuple, plain.collect())) != []
    late = streams.event_time(spark.createDataFrame([(0, 10, "B", 777)], "stream long, sec long, tag string, seq long"))
    pulses = streams.pulse_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("weight", F.lit(1.0)), "600 seconds", "1200 seconds")
    before = collected(spark, pulses, "before_late")
    late.select(*rows.columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert collected(spark, pulses, "after_late") == before


def test_a_run_again_writes_nothing_twice(spark, tmp_path):
    spark.range(20).selectExpr("id % 15 as k").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("k long").parquet(str(tmp_path / "in"))
    for _ in range(2):
        streams.write_once(src, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"]).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 15
    import shutil

    shutil.rmtree(tmp_path / "cp")  # as if the run had ended before it was noted
    streams.write_once(src, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 15
