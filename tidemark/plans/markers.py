"""Queries of markers: merging, retagging, clustering, packing, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import markers as ops
from tidemark.operators import windows
from tidemark.plans import views
from tidemark.plans.views import SQL_CHAT, SQL_LINES, SQL_MARKERS, registry

QUERIES, ORACLES, query = registry()
RULES = [("boss|heit", "[Boss]", 95), ("license|released", "[News]", 85), ("ción|que", "[Story]", 70), ("the", "[Talk]", 40)]
VETOES = [("license.*gnu", "[News]")]
SQL_PARTS = SQL_MARKERS + """, num as (select *, row_number() over (partition by stream order by sec, seq) as i from markers),
pk as (select stream, seq, i, 0 as part, bytes + 1 as run from num where i = 1
  union all select n.stream, n.seq, n.i, case when p.run + n.bytes + 1 > 3000 then p.part + 1 else p.part end, case when p.run + n.bytes + 1 > 3000 then n.bytes + 1 else p.run + n.bytes + 1 end
  from pk p join num n on n.stream = p.stream and n.i = p.i + 1),
parts as (select m.*, cast(pk.part as bigint) as part from pk join markers m using (stream, seq))"""


def _sized(spark, sf):
    """Markers with the bytes of their lines, line feeds included."""
    return views.markers(spark, sf).withColumn("bytes", F.col("bytes") + 1)


def _packed(spark, sf):
    return ops.greedy_pack(_sized(spark, sf).select("stream", "sec", "seq", "time", "tag", "desc", "raw", "macro", "bytes"))


@query(f"""with {SQL_LINES},
b as (select doc, pos, line, case when regexp_matches(lower(line), 'boss|heit') then '[Boss]' when regexp_matches(lower(line), 'license|released') then '[News]' when regexp_matches(lower(line), 'ción|que') then '[Story]' when regexp_matches(lower(line), 'the') then '[Talk]' end as best from lines)
select doc, pos, case when best = '[News]' and regexp_matches(lower(line), 'license.*gnu') then null when best <> '[Talk]' then best end as new_tag from b""")
def retag_rules(spark, sf):
    return views.lines(spark, sf).select("doc", "pos", ops.retag(F.col("line"), F.lit("[Talk]"), RULES, VETOES).alias("new_tag"))


@query(f"""with {SQL_MARKERS}, c as (select stream, sec, seq, case when macro = lead(macro) over w then macro end as sure, macro, first_value(macro) over w as f from markers window w as (partition by stream order by sec, seq)),
d as (select *, coalesce(last_value(sure ignore nulls) over (partition by stream order by sec, seq rows between unbounded preceding and current row), f) as cur from c)
select stream, seq, cast(sum(new) over (partition by stream order by sec, seq) as bigint) as seg from (select *, case when cur <> lag(cur) over (partition by stream order by sec, seq) then 1 else 0 end as new from d)""")
def cluster_by_tag(spark, sf):
    return windows.confirmed(views.markers(spark, sf), "macro", ("stream",), ("sec", "seq")).select("stream", "seq", "seg")


@query(f"""with {SQL_MARKERS} select stream, seq from (select *, lag(tag) over (partition by stream order by sec, seq) as b from markers) where not (tag = '[View]' and coalesce(b, '') = '[View]')""")
def story_collapse(spark, sf):
    return ops.collapse(views.markers(spark, sf), "[View]").select("stream", "seq")


@query(f"""with {SQL_LINES} select raw, first_doc, first_pos, n from (select line as raw, doc as first_doc, pos as first_pos, row_number() over (partition by line order by doc, pos) as r, count(*) over (partition by line) as n from lines where line <> '') where r = 1""")
def merge_exact(spark, sf):
    lines = views.lines(spark, sf).where("line <> ''").select(F.col("line").alias("raw"), "doc", "pos")
    first = ops.merge_exact(lines, order=("doc", "pos")).select("raw", F.col("doc").alias("first_doc"), F.col("pos").alias("first_pos"))
    return first.join(lines.groupBy("raw").agg(F.count("*").alias("n")), "raw")


@query()
def merge_fuzzy(spark, sf):
    """Lines unlike the last one kept at the same second of a day; brute force in the tests."""
    m = views.markers(spark, sf).select(F.lit(0).alias("stream"), (F.col("sec") % 600).alias("sec"), "raw", F.col("stream").alias("file_no"), F.col("seq").alias("line_no"))
    return ops.merge_fuzzy(m)


@query(f"""with recursive {SQL_MARKERS}, n as (select *, row_number() over (partition by stream order by sec, seq) as i from markers),
k as (select stream, i, seq, tag as lt, sec as ls, true as kept from n where i = 1
  union all select n.stream, n.i, n.seq, case when n.tag in ('[Click]', '[View]') and n.tag = k.lt and n.sec - k.ls < 600 then k.lt else n.tag end, case when n.tag in ('[Click]', '[View]') and n.tag = k.lt and n.sec - k.ls < 600 then k.ls else n.sec end,
  not (n.tag in ('[Click]', '[View]') and n.tag = k.lt and n.sec - k.ls < 600) from k join n on n.stream = k.stream and n.i = k.i + 1)
select stream, seq from k where kept""")
def adjacent_dedup(spark, sf):
    return ops.adjacent_dedup(views.markers(spark, sf), tags=("[Click]", "[View]")).select("stream", "seq")


@query(f"with recursive {SQL_PARTS} select stream, seq, part from parts")
def greedy_pack(spark, sf):
    return _packed(spark, sf).select("stream", "seq", "part")


@query(f"""with {SQL_MARKERS}, b as (select stream, seq, sec, row_number() over (partition by stream order by sec, seq) as i, lag(sec) over (partition by stream order by sec, seq) as p from (select stream, seq, sec - sec % 3600 as sec, sec as s from markers))
select stream, seq, cast(sum(case when sec in (21600, 43200) and i > 1 then 1 else 0 end) over (partition by stream order by sec, seq) as bigint) as seg from b""")
def hard_breaks(spark, sf):
    m = views.markers(spark, sf).select("stream", "seq", (F.col("sec") - F.col("sec") % 3600).alias("sec"))
    return ops.hard_breaks(m, (21600, 43200)).select("stream", "seq", "seg")


@query(f"""with {SQL_MARKERS}, t as (select m.stream, m.sec, m.seq, case when m.sec // 7200 % 3 <> 2 then 'topic ' || (m.sec // 7200) end as label from markers m),
f as (select *, case when row_number() over w = 1 then 0 when label is null or lag(label) over w is null or label <> lag(label) over w then 1 else 0 end as new from t window w as (partition by stream order by sec, seq))
select stream, seq, label, cast(sum(new) over (partition by stream order by sec, seq) as bigint) as seg from f""")
def topic_pack(spark, sf):
    m = views.markers(spark, sf).select("stream", "sec", "seq")
    topics = m.select("stream").distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(11).cast("bigint")))).where("k % 3 <> 2")
    topics = topics.select("stream", "k", (F.col("k") * 7200).alias("start"), ((F.col("k") + 1) * 7200).alias("end"), F.concat(F.lit("topic "), F.col("k").cast("string")).alias("label"))
    joined = windows.first_window(topics, m, 7200, "seq", "k").select("stream", "sec", "seq", "label")
    return ops.cluster_by_topic(joined).select("stream", "seq", "label", "seg")


@query(f"""with recursive {SQL_PARTS}, o as (select *, sum(bytes + 1) over (partition by stream, part order by sec, seq) - bytes - 1 as pl, sum(bytes + 1) over (partition by stream, part) as total from parts)
select stream, part, time as split_at from (select *, row_number() over (partition by stream, part order by abs(pl - total / 2), pl) as r from o where pl > 0) where r = 1""")
def split_midpoint(spark, sf):
    return ops.split_at_middle(_packed(spark, sf), ("stream", "part"))


@query(f"""with recursive {SQL_PARTS} select stream, part, count(*) as n, cast(sum(strlen(raw) + 1) as bigint) as bytes, cast(sum(length(raw) + 1) as bigint) as chars, case when sum(strlen(raw) + 1) > 4500 then 'OVER' when sum(strlen(raw) + 1) > 3500 then 'WARN' else 'OK' end as status from parts group by 1, 2""")
def part_sizes(spark, sf):
    return ops.part_sizes(_packed(spark, sf))


@query(f"""with recursive {SQL_PARTS}, d as (select stream, part, array_to_string(list_sort(list_distinct(list(macro))), ',') as macros from parts group by 1, 2)
select stream, part, macros, contains(macros, ',') and macros <> 'GAMEPLAY,TALK' as flagged from d""")
def tag_diversity(spark, sf):
    return ops.tag_diversity(_packed(spark, sf), ("stream", "part")).withColumn("macros", F.array_join("macros", ","))


@query(f"""with recursive {SQL_PARTS}, n as (select stream, part, k from parts, (select unnest(['"k": 1', '"k": 2', '"k": 3']) as k) where contains("desc", k))
select stream, part, count(distinct k) as n_names, count(distinct k) > 1 as flagged from n group by 1, 2""")
def name_diversity(spark, sf):
    names = _packed(spark, sf).select("stream", "part", F.explode(ops.names_in(F.col("desc"), ['"k": 1', '"k": 2', '"k": 3'])).alias("k"))
    return names.groupBy("stream", "part").agg(F.count_distinct("k").alias("n_names")).withColumn("flagged", F.col("n_names") > 1)


@query(f"""with {SQL_MARKERS}, m as (select stream, seq, sec // 3600 as chunk, lower(replace(replace(tag, '[', ''), ']', '')) as name from markers),
a as (select distinct stream, sec // 3600 as chunk, lower(replace(replace(tag, '[', ''), ']', '')) as ok from markers where seq % 7 = 0)
select m.stream, m.seq, m.name from m where exists (select 1 from a where a.stream = m.stream and a.chunk = m.chunk) and not exists (select 1 from a where a.stream = m.stream and a.chunk = m.chunk and (contains(a.ok, m.name) or contains(m.name, a.ok)))""")
def name_cross_reference(spark, sf):
    m = views.markers(spark, sf).select("stream", "seq", F.concat_ws("/", "stream", F.floor(F.col("sec") / 3600)).alias("chunk"), F.lower(F.regexp_replace("tag", r"[\[\]]", "")).alias("name"))
    allowed = m.where("seq % 7 = 0").groupBy("chunk").agg(F.collect_set("name").alias("allowed"))
    return ops.unsupported_names(m, allowed).select("stream", "seq", "name")


@query(f"""with {SQL_LINES}, t as (select doc, pos, list_distinct(list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(line, '\\d{{2}}:\\d{{2}}:\\d{{2}}', '', 'g'), '\\[.*?\\]', '', 'g'), '[–—,:;.?!()<>"''\\[\\]{{}}-]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 2), lambda x: lower(x))) as t from lines),
f as (select doc, pos, t, first_value(t) over (partition by doc order by pos) as t0, row_number() over (partition by doc order by pos) as k from t),
o as (select doc, min(case when k > 1 then case when len(t) = 0 or len(t0) = 0 then 0 else len(list_intersect(t, t0)) / len(list_distinct(list_concat(t, t0))) end end) as o, count(*) as n from f group by doc)
select doc, round(o, 4) as min_overlap, o < 0.1 and n >= 3 as flagged from o where n > 1""")
def keyword_coherence(spark, sf):
    return ops.keyword_coherence(views.lines(spark, sf).select("doc", "pos", F.col("line").alias("desc")), ("doc",), ("pos",))


@query(f"""with recursive {SQL_PARTS}, f as (select stream, part, macro = lag(macro, 2) over w and macro <> lag(macro) over w as flip from parts window w as (partition by stream, part order by sec, seq))
select stream, part, count(*) filter (where flip) as flips, count(*) filter (where flip) >= 2 as flagged from f group by 1, 2""")
def tag_flips(spark, sf):
    return ops.tag_flips(_packed(spark, sf), ("stream", "part"))


@query(f"""with {SQL_CHAT}, c as (select stream, sec // 600 as idx, min(seq) as s, max(kind) as category, string_agg(kind, ' ' order by sec, seq) as text, min(sec) as ts from chat group by 1, 2),
f as (select *, case when category = lag(category) over (partition by stream order by idx) then 0 else 1 end as new, row_number() over (partition by stream order by idx) as r from c),
i as (select *, sum(new) over (partition by stream order by idx) - 1 as island from f)
select stream, cast(island as bigint) as island, category, arg_min(ts, idx) as first_ts, arg_max(ts, idx) as last_ts, count(*) as n_chunks, cast(sum(strlen(text) + 1) - case when island = 0 then 0 else 1 end as bigint) as bytes,
case when sum(strlen(text) + 1) - case when island = 0 then 0 else 1 end > 400 then 'OVER' when sum(strlen(text) + 1) - case when island = 0 then 0 else 1 end > 150 then 'WARN' else 'OK' end as status from i group by stream, island, category""")
def category_blocks(spark, sf):
    kinds = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sec", "seq", "kind"))), lambda x: x["kind"]), " ")
    c = views.chat(spark, sf).groupBy("stream", F.floor(F.col("sec") / 600).cast("bigint").alias("idx")).agg(F.max("kind").alias("category"), kinds.alias("text"), F.min("sec").alias("ts"))
    return ops.category_blocks(c, warn=150, over=400)


@query()
def halved_segments(spark, sf):
    """Clustered segments over 400 bytes halved, tiny ones joined; brute force in the tests."""
    rows = windows.confirmed(_sized(spark, sf), "macro", ("stream",), ("sec", "seq")).select("stream", "sec", "seq", "bytes", "seg")
    return ops.normalise(rows, limit=400, tiny=60)


@query(f"""with recursive {SQL_PARTS}, d as (select stream, part, sec, seq, "desc" as d, row_number() over (partition by stream, part, lower("desc") order by sec, seq) as r from parts where "desc" <> ''),
l as (select stream, part, list(d order by sec, seq) as l, count(*) as n from d where r = 1 group by 1, 2)
select stream, part, case when n <= 3 then array_to_string(l, ' | ') else l[1] || ' | ' || l[n // 2 + 1] || ' | ' || l[n] end as title from l""")
def part_titles(spark, sf):
    return ops.titles(_packed(spark, sf), ("stream", "part"))


@query(f"""with {SQL_CHAT}, m as (select stream, sec, seq from chat), g(a, z, mood) as (values (3600, 7200, 'pulse'), (7000, 30000, 'natural'), (50000, 50001, 'pulse'))
select stream, seq, case when stream % 4 = 0 then true else coalesce((select first(mood order by a) <> 'natural' from g where sec >= a and sec < z), false) end as in_pulse from m""")
def mood_membership(spark, sf):
    """Whether a marker stands in a pulsing segment of its stream; streams without segments count whole."""
    m = views.chat(spark, sf).select("stream", "sec", "seq")
    segment = lambda a, z, mood: F.struct(F.lit(a).alias("start"), F.lit(z).alias("end"), F.lit(mood).alias("mood"))
    known = F.array(segment(3600, 7200, "pulse"), segment(7000, 30000, "natural"), segment(50000, 50001, "pulse"))
    moods = m.select("stream").distinct().where("stream % 4 <> 0 or stream % 8 = 0").withColumn("segments", F.when(F.col("stream") % 4 != 0, known))
    return ops.in_segment(m, moods, "stream").select("stream", "seq", "in_pulse")


@query(f"""with {SQL_MARKERS} select stream, seq, sec, case when seq % 3 = 0 then '[Talk]' else tag end as tag, "desc", time || ' - ' || case when seq % 3 = 0 then '[Talk]' else tag end || ' ' || "desc" as raw from markers""")
def flexible_markers(spark, sf):
    """Lines with and without tag, rule and single spaces, as markers written anew."""
    from tidemark.functions.clock import fmt_clock
    from tidemark.sources.markers import parse_markers

    c = views.chat(spark, sf)
    tag = F.when(F.col("seq") % 3 == 0, "").otherwise(F.concat(F.lit("["), F.initcap("kind"), F.lit("]")))
    line = F.concat(F.lit(" "), fmt_clock(F.col("sec")), F.when(F.col("seq") % 2 == 0, "  -   ").otherwise(" "), tag, F.lit("  "), "props", F.lit(" "))
    return parse_markers(c.select("stream", "seq", line.alias("line")), grammar="flexible").select("stream", "seq", "sec", "tag", "desc", "raw")
