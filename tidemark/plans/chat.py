"""Queries of chat: pulses, verdicts, segments, tones, laughs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import chat as ops
from tidemark.operators import windows
from tidemark.plans import views
from tidemark.plans.timeline import SQL_WINDOWS, chunk_windows
from tidemark.plans.views import SQL_CHAT, SQL_LINES, registry

QUERIES, ORACLES, query = registry()
#: Hours, and thresholds for the events' values, which are larger than laughs' weights.
CFG = ops.PulseConfig(bucket=3600, pulse_score=1300, hot_min=350, max_peaks=4)
HINTS = {"PURCHASE": ("glad", ["buys", "pays"]), "CLICK": ("brisk", ["clicks"]), "HOT": ("warm", ["cheers"])}
FALLBACK = ("plain", ["says"])
SQL_BUCKETS = SQL_CHAT + """,
mb as (select stream, sec // 3600 as bucket, kind, sum(w) as sw, min(seq) as first_seq, count(*) as n from chat group by 1, 2, 3),
dom as (select stream, bucket, kind from (select *, row_number() over (partition by stream, bucket order by sw desc, first_seq) as r from mb) where r = 1),
b as (select stream, bucket, round(sum(sw), 2) as score, cast(sum(n) as bigint) as n, min(first_seq) as first_seq from mb group by 1, 2),
buckets as (select b.stream, b.bucket, b.score, b.n, dom.kind as mood, b.first_seq from b join dom using (stream, bucket)),
ranked as (select *, row_number() over (partition by stream order by score desc, first_seq) as rank from buckets)"""
SQL_VERDICTS = SQL_BUCKETS + """, st as (select stream, cast(sum(n) as bigint) as n_markers from buckets group by stream),
verdicts as (select st.stream, n_markers, bucket * 3600 as peak_start, score as peak_score,
  case when score >= 1300 then upper(mood) when n_markers >= 350 then 'HOT' when n_markers >= 1 then 'WARM' else 'QUIET' end as verdict from st join ranked r on r.stream = st.stream and r.rank = 1)"""


def _buckets(spark, sf):
    return ops.pulse_buckets(views.signals(spark, sf), CFG.bucket)


@query(f"with {SQL_BUCKETS} select * from buckets")
def pulse_buckets(spark, sf):
    return _buckets(spark, sf)


@query(f"with {SQL_BUCKETS} select stream, bucket, score, mood, rank from ranked where rank <= 4")
def pulse_top4(spark, sf):
    return ops.peaks(_buckets(spark, sf), 4).select("stream", "bucket", "score", "mood", "rank")


@query(f"with {SQL_VERDICTS} select * from verdicts")
def mood_verdict(spark, sf):
    return ops.verdicts(_buckets(spark, sf), CFG)


@query(f"""with {SQL_BUCKETS}, top as (select stream, bucket * 3600 as start, (bucket + 1) * 3600 as "end", lower(mood) as mood from ranked where rank <= 4 and score >= 1300),
bounds as (select stream, min(sec) as n_start, max(sec) as n_secs from chat group by stream),
nat as (select t.stream, coalesce(lag(t."end") over (partition by t.stream order by t.start), n_start) as start, t.start as "end", 'natural' as mood from top t join bounds using (stream)),
tail as (select b.stream, coalesce(max(t."end"), b.n_start) as start, b.n_secs as "end", 'natural' as mood from bounds b left join top t on t.stream = b.stream group by b.stream, b.n_start, b.n_secs)
select stream, start, "end", mood from top union all select * from nat where start < "end" union all select * from tail where start < "end" """)
def mood_segments(spark, sf):
    bounds = views.chat(spark, sf).groupBy("stream").agg(F.min("sec").alias("n_start"), F.max("sec").alias("n_secs"))
    return ops.segments(_buckets(spark, sf), bounds, CFG)


@query(f"""with {SQL_VERDICTS}, hints(verdict, tone, verbs) as (values ('PURCHASE', 'glad', 'buys,pays'), ('CLICK', 'brisk', 'clicks'), ('HOT', 'warm', 'cheers'))
select stream, v.verdict, coalesce(tone, 'plain') as tone, coalesce(verbs, 'says') as verbs from verdicts v left join hints using (verdict)""")
def tone_lookup(spark, sf):
    toned = ops.with_tone(ops.verdicts(_buckets(spark, sf), CFG), HINTS, FALLBACK)
    return toned.select("stream", "verdict", "tone", F.array_join("verbs", ",").alias("verbs"))


@query(f"""with {SQL_CHAT}, {SQL_WINDOWS}, j as (select w.stream, w.k, c.seq, c.sec, c.kind from win w left join chat c on c.stream = w.stream and c.sec >= w.start and c.sec < w."end")
select stream, k, count(seq) as n_messages, count(*) filter (where kind = 'purchase') as n_markers, coalesce(min(sec), 0) as n_start, coalesce(max(sec), 0) as n_secs,
coalesce(round(count(*) filter (where kind = 'purchase') / nullif(count(seq), 0), 3), 0) as density from j group by 1, 2""")
def chat_stats(spark, sf):
    chat = views.chat(spark, sf).select("stream", "sec", "seq", "kind")
    wins = chunk_windows(chat)
    inside = windows.range_join(wins, chat, 300)
    return ops.stats(wins.select("stream", "k"), ("stream", "k"), inside, inside.where("kind = 'purchase'"))


@query(f"""with {SQL_LINES}, f as (select doc, pos, regexp_matches(line, '(?i)(5{{3,}}|xd+|haha+|(^|[^A-Za-z0-9_])(lol|haha)($|[^A-Za-z0-9_]))') as laugh, contains(line, '+1') as plus, contains(line, 'haha') as emote from lines)
select doc, count(*) as n_lines, count(*) filter (where laugh) as laughing, cast(sum(laugh::int + plus::int + 2 * emote::int) as double) as weight from f group by doc""")
def laugh_lines(spark, sf):
    found = views.lines(spark, sf).withColumn("s", ops.line_signals(F.col("line"), {"haha": ("LAUGH", 2.0)}))
    weight = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["weight"])
    return found.groupBy("doc").agg(F.count("*").alias("n_lines"), F.count_if(ops.laughs(F.col("line"))).alias("laughing"), F.sum(weight).alias("weight"))
