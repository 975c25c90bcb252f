"""Queries of corruption: loops, repeats, ranges to transcribe again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import corruption as ops
from tidemark.plans import views
from tidemark.plans.views import SQL_CHAT, SQL_ITEMS, SQL_LINES, registry

QUERIES, ORACLES, query = registry()


@query(f"""with {SQL_LINES}, w as (select doc, pos, list_filter(regexp_split_to_array(line, '[ \\t\\n\\f\\r\\v]+'), lambda x: x <> '') as ws from lines),
t as (select *, array_to_string(ws, '') as j from w),
g as (select doc, pos, case when len(ws) >= 4 then list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) when length(j) >= 3 then list_transform(range(1, length(j) - 1), lambda i: substring(j, i, 3)) else [] end as gs from t),
x as (select doc, pos, gs[i] as gram, i from (select *, unnest(range(1, len(gs) + 1)) as i from g)),
c as (select doc, pos, gram, count(*) as n, min(i) as first from x group by 1, 2, 3),
r as (select *, row_number() over (partition by doc, pos order by n desc, first) as k, sum(n) over (partition by doc, pos) as total from c)
select doc, pos, gram as top_gram, n as top_count, cast(total as bigint) as n_grams, round(n / total, 3) as score, n >= 3 and n / total >= 0.4 as looped from r where k = 1""")
def loop_ngrams(spark, sf):
    return ops.top_grams(views.lines(spark, sf), ("doc", "pos"), "line")


@query(f"""with {SQL_ITEMS}, t as (select stream, pos, text as t from items),
g as (select stream, pos, t, n, substring(t, i, n) as g from (select *, unnest(range(1, length(t) - n + 2)) as i from (select *, unnest([2, 3, 4]) as n from t where length(t) >= 8))),
k as (select distinct stream, pos, n, length(t) as len, g, (length(t) - length(replace(t, g, ''))) // length(g) as c from g)
select t.stream, t.pos, coalesce(bool_or(k.c >= 2 and k.c * k.n / k.len > 0.15), false) as covered from t left join k using (stream, pos) group by 1, 2""")
def loop_coverage(spark, sf):
    return ops.covered(views.items(spark, sf), ("stream", "pos"), threshold=0.15)


@query(f"""with {SQL_CHAT}, f as (select *, case when kind = lag(kind) over (partition by stream order by sec, seq) then 0 else 1 end as new from chat),
i as (select *, sum(new) over (partition by stream order by sec, seq) as run from f),
r as (select stream, seq, kind, count(*) over (partition by stream, run) as run_length, row_number() over (partition by stream, run order by sec, seq) as run_place from i)
select stream, seq, kind, run_length, run_place, run_length >= 3 as repeated, not (run_length >= 3 and run_place > 1) as stays from r""")
def consecutive_repeats(spark, sf):
    found = ops.repeats(views.chat(spark, sf), 3, order=("sec", "seq"), text="kind")
    return found.select("stream", "seq", "kind", "run_length", "run_place", "repeated", (~(F.col("repeated") & (F.col("run_place") > 1))).alias("stays"))


@query(f"""with {SQL_CHAT}, m as (select stream, sec, seq, sec * 1000 as s, sec * 1000 + 45000 as e, kind in ('error', 'click') as corrupt from chat),
f as (select *, case when corrupt is distinct from lag(corrupt) over (partition by stream order by sec, seq) then 1 else 0 end as new from m),
i as (select *, sum(new) over (partition by stream order by sec, seq) as island from f),
r as (select stream, island, min(s) as start, max(e) as "end" from i where corrupt group by 1, 2)
select stream, start, "end", a as slice_start, least(a + 30000, "end") as slice_end from (select *, unnest(range(start, "end", 30000)) as a from r)""")
def corrupt_ranges(spark, sf):
    m = views.chat(spark, sf).select("stream", "sec", "seq", (F.col("sec") * 1000).alias("start_ms"), (F.col("sec") * 1000 + 45000).alias("end_ms"), F.col("kind").isin("error", "click").alias("corrupt"))
    return ops.corrupt_ranges(m, order=("sec", "seq")).drop("island")


@query(f"""with {SQL_CHAT}, u as (select stream, seq, cast(sec as double) as start, w as dur from chat where kind = 'error'),
f as (select *, case when start - lag(start + dur) over (partition by stream order by start, seq) >= 0.1 then 1 else 0 end as new from u),
i as (select *, sum(new) over (partition by stream order by start, seq) as island from f)
select stream, cast(island as bigint) as island, min(start) as start, count(*) as n, round(sum(dur), 3) as total, round(sum(dur), 3) > 60 as retried from i group by 1, 2""")
def uncertain_runs(spark, sf):
    u = views.chat(spark, sf).select("stream", "seq", F.col("sec").cast("double").alias("start"), F.col("w").alias("dur"), (F.col("kind") == "error").alias("uncertain"))
    return ops.uncertain_runs(u, retry=60).drop("end")


# position by position, as the scan goes: how often the pattern that begins there recurs says where it goes on
@query(f"""with recursive {SQL_CHAT}, r as (select stream, seq, kind, row_number() over (partition by stream order by sec, seq) as k, count(*) over (partition by stream) as n from chat),
e as (select stream, p, k, seq, n, coalesce(kind = lag(kind, p) over (partition by stream, p order by k), false) as same from (select r.*, unnest([1, 2, 3]) as p from r)),
b as (select *, min(case when not same then k end) over (partition by stream, p order by k rows between current row and unbounded following) as other from e),
m as (select a.stream, a.p, a.k, 1 + (coalesce(b.other, a.n + 1) - b.k) // a.p as times from b a join b on b.stream = a.stream and b.p = a.p and b.k = a.k + a.p),
s as (select stream, p, cast(1 as bigint) as k from m where k = 1
  union all select s.stream, s.p, case when m.times >= case s.p when 1 then 4 else 3 end then s.k + m.times * s.p else s.k + 1 end from s join m on m.stream = s.stream and m.p = s.p and m.k = s.k),
hit as (select m.stream, m.k as a, m.k + m.times * m.p as z from s join m using (stream, p, k) where m.times >= case m.p when 1 then 4 else 3 end)
select r.stream, seq, exists (select 1 from hit where hit.stream = r.stream and r.k >= a and r.k < z) as in_loop from r""")
def loop_scan(spark, sf):
    """Loops of one to three lines."""
    return ops.loops(views.chat(spark, sf).select("stream", "sec", "seq", "kind"), ("stream",), ("sec", "seq"), "kind").select("stream", "seq", "in_loop")
