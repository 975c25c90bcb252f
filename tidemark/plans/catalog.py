"""Queries of catalogs, links, subtitles and dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import catalog as ops
from tidemark.plans import views
from tidemark.plans.views import SQL_CHAT, SQL_ITEMS, SQL_LINES, registry
from tidemark.sources.transcripts import srt_blocks

QUERIES, ORACLES, query = registry()


@query("""with l as (select page_id, unnest(list_distinct(regexp_extract_all(html, '(https?://[^\\s"''<>)\\]]+)', 1))) as url from (select page_id, url || ' ' || regexp_extract(url, '(https?://[^/]+)', 1) || '/ ' || html as html from pages))
select page_id, url, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) in ('', '/') as homepage from l""")
def link_audit(spark, sf):
    page = views.read(spark, sf, "pages").select("page_id", F.concat("url", F.lit(" "), F.regexp_extract("url", "(https?://[^/]+)", 1), F.lit("/ "), "html").alias("text"))
    return ops.link_audit(page, ("page_id",))


@query("""with o as (select o_custkey as cust, list(o_orderkey order by o_orderkey) as keys, list(o_orderpriority order by o_orderkey) as pri, coalesce(list(o_orderstatus order by o_orderkey) filter (where o_orderstatus <> 'P'), []) as st from orders group by 1)
select cust, i as pos, keys[i] as en, pri[i] as local, st[i] as third from (select *, unnest(range(1, least(len(keys), len(pri), len(st)) + 1)) as i from o)""")
def zip_names(spark, sf):
    o = views.read(spark, sf, "orders")
    sorted_ = lambda c, only=None: F.transform(F.sort_array(F.collect_list(F.when(only, F.struct("o_orderkey", c)) if only is not None else F.struct("o_orderkey", c))), lambda x: x[c])
    g = o.groupBy(F.col("o_custkey").alias("cust")).agg(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x).alias("keys"), sorted_("o_orderpriority").alias("pri"), sorted_("o_orderstatus", F.col("o_orderstatus") != "P").alias("st"))
    return ops.zip_names(g, {"keys": "en", "pri": "local", "st": "third"}, ("cust",))


@query("""select event_id as card, key, json_extract_string(props, '$.' || key) as value from (select event_id, props, unnest(json_keys(props)) as key from events)""")
def explode_children(spark, sf):
    cards = views.read(spark, sf, "events").select(F.col("event_id").alias("card"), F.map_entries(F.from_json("props", "map<string,string>")).alias("entries"))
    return ops.children(cards, "entries", ("card",))


@query("""with c as (select c_custkey, c_mktsegment, n_name as candidate, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
e as (select n_nationkey as id, lower(n_name) as a, 'nation ' || n_nationkey as b from nation)
select c_custkey, c.candidate, e.id, c.candidate || ' (' || r_name || ')' as display from c join e on lower(c.candidate) = e.a or lower(c.candidate) = e.b""")
def entity_lookup(spark, sf):
    n = views.read(spark, sf, "nation")
    c = views.read(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(views.read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entities = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("official"), F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("other"))
    found = ops.lookup(c.select("c_custkey", F.col("n_name").alias("candidate"), "r_name"), entities, ("official", "other"))
    return found.select("c_custkey", "candidate", "id", F.concat("candidate", F.lit(" ("), "r_name", F.lit(")")).alias("display"))


@query(f"""with {SQL_LINES}, w as (select doc, pos, lower(string_split(line, ' ')[1]) as target, lower(string_split(line, ' ')[2]) as pattern from lines where len(string_split(line, ' ')) >= 2),
u as (select target, pattern, doc, pos from (select *, row_number() over (partition by target, pattern order by doc, pos) as r from w) where r = 1)
select target, string_agg(pattern, ',' order by doc, pos, pattern) as patterns, count(*) as n from u group by target""")
def dictionary_merge(spark, sf):
    parts = F.split("line", " ")
    w = views.lines(spark, sf).where(F.size(parts) >= 2).select(F.lower(F.get(parts, F.lit(0))).alias("target"), F.lower(F.get(parts, F.lit(1))).alias("pattern"), "doc", "pos")
    return ops.merge_dictionaries(w, ("doc", "pos")).select("target", F.array_join("patterns", ",").alias("patterns"), F.size("patterns").cast("bigint").alias("n"))


@query(f"""with {SQL_ITEMS} select stream, pos as block, cast(start as bigint) as start_sec, cast(start + dur as bigint) as end_sec, trim(regexp_replace(text, '\\n+', ' ', 'g')) as text,
case when contains(lower(text), 'que') then 'que' when contains(lower(text), 'the') then 'the' end as keyword from items where trim(regexp_replace(text, '\\n+', ' ', 'g')) <> ''""")
def srt_align(spark, sf):
    from tidemark.functions.clock import fmt_clock

    clock = lambda c: F.concat(fmt_clock(c), F.lit(",000"))
    items = views.items(spark, sf).withColumn("text", F.trim(F.regexp_replace("text", r"\n+", " "))).where("text <> ''")
    block = F.concat(F.col("pos").cast("string"), F.lit("\n"), clock(F.col("start")), F.lit(" --> "), clock(F.col("start") + F.col("dur")), F.lit("\n"), "text")
    files = items.groupBy("stream").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("value"), F.sort_array(F.collect_list("pos")).alias("_p"))
    parsed = srt_blocks(files, "value", ("stream", "_p"))
    word = F.when(F.contains(F.lower("text"), F.lit("que")), "que").when(F.contains(F.lower("text"), F.lit("the")), "the")
    return parsed.select("stream", F.get("_p", F.col("block")).alias("block"), "start_sec", "end_sec", "text", word.alias("keyword"))


@query(f"""with {SQL_ITEMS}, k(i, word) as (values (1, 'heit'), (2, 'que'), (3, 'zzz'), (4, 'the')),
h as (select word, min(doc_id) as chunk from documents join k on contains(lower(text), word) group by word),
b as (select stream, pos, (select min(i) from k where contains(lower(text), word)) as i from items)
select stream, pos, word as keyword, chunk from b left join k using (i) left join h using (word)""")
def reference_alignment(spark, sf):
    """Blocks of a reference beside the first chunk that holds their keyword."""
    words = ["heit", "que", "zzz", "the"]
    found = F.explode(F.array_compact(F.array(*(F.when(F.contains(F.lower("text"), F.lit(w)), F.lit(w)) for w in words))))
    hits = views.read(spark, sf, "documents").select(found.alias("keyword"), "doc_id").groupBy("keyword").agg(F.min("doc_id").alias("chunk"))
    return ops.align_reference(views.items(spark, sf), words, hits).select("stream", "pos", "keyword", "chunk")


@query(f"""with {SQL_CHAT}, f as (select distinct 'logs/livechat_chunk_' || printf('%02d', stream) || '.txt' as file, stream from chat)
select file, case when stream % 3 = 0 then 'part_' || stream else 'chunk_' || printf('%02d', stream) end as chunk from f""")
def chat_file_chunks(spark, sf):
    streams = views.chat(spark, sf).select("stream").distinct()
    name = F.format_string("livechat_chunk_%02d.txt", "stream")
    listed = streams.where("stream % 3 = 0").withColumn("twice", F.explode(F.array(F.lit(0), F.lit(1))))
    index = listed.select((F.col("stream") * 2 + F.col("twice")).alias("pos"), F.when(F.col("twice") == 0, F.concat(F.lit("part_"), "stream")).otherwise("later").alias("chunk"), F.concat(F.lit("old/"), name).alias("file"))
    return ops.chunk_of_file(streams.select(F.concat(F.lit("logs/"), name).alias("file")), index).select("file", "chunk")


@query("""select d.doc_id, d.source, coalesce(l.quality, -1) as quality, coalesce(l.toxic, 0) as toxic, 'src' || (d.doc_id % 20) = d.source as regular from documents d left join labels l using (doc_id)""")
def signal_lookup(spark, sf):
    d = views.read(spark, sf, "documents").select("doc_id", "source")
    both = ops.with_defaults(d, views.read(spark, sf, "labels"), "doc_id", {"quality": -1, "toxic": 0})
    return both.withColumn("regular", F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")) == F.col("source"))


@query("""select '"w' || doc_id || '"' as line, 'w' || doc_id as garbled, case doc_id % 4 when 0 then null else 'x' || doc_id end as correct, case when doc_id % 3 = 0 then '00:00:0' || (doc_id % 10) else '' end as ts, case when doc_id % 5 = 0 then 'chunk_' || doc_id else 'notes_a' end as chunk from documents""")
def garbled_notes(spark, sf):
    from tidemark.sources.markers import notes

    i = F.col("doc_id").cast("string")
    correct = F.when(F.col("doc_id") % 4 == 0, "Unknown").otherwise(F.concat(F.lit("x"), i))
    ts = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" @ 00:00:0"), (F.col("doc_id") % 10).cast("string"))).otherwise("")
    chunk = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" (chunk_"), i, F.lit(")"))).otherwise("")
    lines = views.read(spark, sf, "documents").select(F.lit("notes_a.txt").alias("file"), F.concat(F.lit('- "w'), i, F.lit('" -> '), correct, ts, chunk, F.lit("  ")).alias("line"))
    return notes(lines).select(F.concat(F.lit('"'), "garbled", F.lit('"')).alias("line"), "garbled", "correct", "ts", "chunk")


@query("""select l_orderkey, '[' || string_agg('{"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey || '}', ',' order by l_linenumber, l_partkey) || ']' as lines from lineitem group by l_orderkey""")
def catalog_text(spark, sf):
    """Nested columns of a catalog as JSON, one row per key."""
    g = views.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    return ops.latest(ops.to_text_columns(g), ("l_orderkey",), ("lines",))
