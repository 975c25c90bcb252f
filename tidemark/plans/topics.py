"""Queries of topics: categories, keywords, rarity, boundaries, sections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.text import char_grams, jaccard
from tidemark.operators import topics as ops
from tidemark.plans import views
from tidemark.plans.views import SQL_ITEMS, SQL_WORDS, registry

QUERIES, ORACLES, query = registry()
CATEGORIES = {"legal": ["license", "released under"], "german": ["heit", "ung"], "romance": ["que", "ción"], "loud": ["!!"]}
SQL_HITS = SQL_WORDS + """, hits as (select doc_id as chunk, kw_pos, keyword, kind, file, (length(text) - length(replace(lower(text), keyword, ''))) // length(keyword) as n
  from documents, kw where (length(text) - length(replace(lower(text), keyword, ''))) // length(keyword) >= 1)"""
SQL_IDF = SQL_HITS + """, idf as (select keyword, count(distinct chunk) as df, round(ln((select count(*) from documents) / count(distinct chunk)), 4) as idf from hits group by keyword)"""


def _weighted(by: str) -> str:
    return f"""{by}s as (select *, round(coalesce(score / nullif(sum(score) over (partition by chunk), 0), 0), 3) as share, row_number() over (partition by chunk order by score desc, pos) as rank
  from (select chunk, {by}, round(sum(n * idf), 4) as score, min(kw_pos) as pos from hits join idf using (keyword) where {by} is not null group by chunk, {by}))"""


SQL_GRAMS = SQL_ITEMS + """, folded as (select *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as t from items),
g as (select stream, pos, start, text, case when length(t) >= 3 then list_distinct(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) else [] end as g from folded),
adj as (select stream, pos, start, text, lag(pos) over w as before, case when lag(pos) over w is null then null when len(g) = 0 or len(lag(g) over w) = 0 then 0 else
  round(len(list_intersect(g, lag(g) over w)) / len(list_distinct(list_concat(g, lag(g) over w))), 4) end as similarity,
  case when contains(lower(text), 'que') or contains(lower(lag(text) over w), 'que') then 1 else 0 end as signal, start - lag(start) over w as apart from g window w as (partition by stream order by pos)),
found as (select * from adj where similarity is not null and case when signal > 0 then similarity < 0.12 else apart > 600 end),
bounds as (select stream, pos as idx, similarity from (select *, lead(pos) over (partition by stream order by pos) as nxt from found) where nxt is null or nxt - pos > 1)"""


def _hits(spark, sf, threshold=1):
    return ops.keyword_hits(views.read(spark, sf, "documents").select(F.col("doc_id").alias("chunk"), "text"), views.words(spark), threshold)


def _idf(spark, sf):
    return ops.idf(_hits(spark, sf), views.read(spark, sf, "documents").count())


@query("""select doc_id, case when len(c) = 0 then 'unknown' else array_to_string(c, ',') end as categories, case when len(c) = 0 then 'unknown' else c[1] end as main from (
select doc_id, list_filter([case when contains(lower(text), 'license') or contains(lower(text), 'released under') then 'legal' end, case when contains(lower(text), 'heit') or contains(lower(text), 'ung') then 'german' end,
case when contains(lower(text), 'que') or contains(lower(text), 'ción') then 'romance' end, case when contains(lower(text), '!!') then 'loud' end], lambda x: x is not null) as c from documents)""")
def classify_chunk(spark, sf):
    d = views.read(spark, sf, "documents").select("doc_id", ops.classify(F.col("text"), CATEGORIES).alias("c"))
    return d.select("doc_id", F.array_join("c", ",").alias("categories"), F.get("c", F.lit(0)).alias("main"))


@query(f"with {SQL_HITS} select * from hits where n >= 2")
def keyword_hits(spark, sf):
    return _hits(spark, sf, 2)


@query(f"with {SQL_IDF} select * from idf")
def keyword_idf(spark, sf):
    return _idf(spark, sf)


@query(f"with {SQL_IDF}, {_weighted('file')} select chunk, file, score, share, rank from files")
def signal_scores(spark, sf):
    return ops.weighted(_hits(spark, sf), _idf(spark, sf), "file")


@query(f"""with {SQL_IDF}, {_weighted('file')}, {_weighted('kind')}
select k.chunk, case when f.score > 0 then f.file end as best_file, case when f.score > 0 then f.share else 0 end as confidence,
case when f.score > 0 then upper(f.file[1]) || replace(f.file[2:], '.md', '') || ' (' || replace(f.file, '.md', '') || ')' else k.kind end as primary_topic
from kinds k left join files f on f.chunk = k.chunk and f.rank = 1 where k.rank = 1""")
def best_file_confidence(spark, sf):
    return ops.best_files(_hits(spark, sf), _idf(spark, sf))


@query(f"with {SQL_HITS} select kind, count(*) as n_keywords, cast(sum(n) as bigint) as n_hits, count(distinct chunk) as n_chunks, (select count(*) from documents) as chunks_processed from hits group by kind")
def signal_kind_counts(spark, sf):
    total = views.read(spark, sf, "documents").agg(F.count("*").alias("chunks_processed"))
    return _hits(spark, sf).groupBy("kind").agg(F.count("*").alias("n_keywords"), F.sum("n").alias("n_hits"), F.count_distinct("chunk").alias("n_chunks")).join(F.broadcast(total))


@query(f"with {SQL_GRAMS} select stream, pos, similarity from adj where similarity is not null")
def adjacent_jaccard(spark, sf):
    w = Window.partitionBy("stream").orderBy("pos")
    g = views.items(spark, sf).withColumn("g", char_grams(F.col("text")))
    return g.select("stream", "pos", F.round(jaccard(F.lag("g").over(w), F.col("g")), 4).alias("similarity")).where("similarity is not null")


def _chunks(spark, sf):
    return views.items(spark, sf).select("stream", F.col("pos").alias("idx"), "start", "text", F.contains(F.lower("text"), F.lit("que")).cast("int").alias("signal"))


def _bounds(spark, sf):
    return ops.boundaries(_chunks(spark, sf), threshold=0.12, near=1)


@query(f"with {SQL_GRAMS} select * from bounds")
def topic_boundaries(spark, sf):
    return _bounds(spark, sf)


@query("with recursive " + SQL_GRAMS + """,
c as (select i.stream, i.pos, i.start, row_number() over (partition by i.stream order by i.pos) as r, count(*) over (partition by i.stream) as total, b.idx is not null as cut,
  bool_or(b.idx is not null) over (partition by i.stream) as anyb, min(i.start) over (partition by i.stream) as s0, max(i.start) over (partition by i.stream) as s1 from items i left join bounds b on b.stream = i.stream and b.idx = i.pos),
walk as (select stream, r, total, case when cut and 1 >= 2 then start else s0 end as cur, case when cut then 0 else 1 end as held, 0 as made,
    case when cut and 1 >= 2 then s0 end as os, case when cut and 1 >= 2 then start end as oe, case when cut and 1 >= 2 then 1 end as n, start from c where r = 1 and anyb
  union all
  select c.stream, c.r, c.total, case when c.cut and w.held + 1 >= 2 then c.start else w.cur end, case when c.cut then 0 else w.held + 1 end, w.made + case when c.cut and w.held + 1 >= 2 then 1 else 0 end,
    case when c.cut and w.held + 1 >= 2 then w.cur end, case when c.cut and w.held + 1 >= 2 then c.start end, case when c.cut and w.held + 1 >= 2 then w.held + 1 end, c.start from walk w join c on c.stream = w.stream and c.r = w.r + 1),
fin as (select * from walk where r = total),
allp as (select stream, os as start, oe as "end", n from walk where os is not null
  union all select stream, cur, start + 45, held from fin where held >= 2
  union all select f.stream, (select min(start) from items i where i.stream = f.stream), f.start + 45, f.total from fin f where f.made = 0 and f.held < 2
  union all select stream, min(start), max(start) + 45, count(*) from c where not anyb group by stream, (r - 1) // 6)
select stream, row_number() over (partition by stream order by start) - 1 as section, start, "end", cast(n as bigint) as n_chunks from allp""")
def topic_sections(spark, sf):
    return ops.sections(_chunks(spark, sf), _bounds(spark, sf), least=2, tail=45)


@query(f"""with {SQL_HITS}, l as (select d.source as section, h.keyword as name, h.kind = 'suffix' as specific, sum(h.n) as n, min(h.kw_pos) as pos from hits h join documents d on d.doc_id = h.chunk group by 1, 2, 3)
select section, replace(replace(name, '-', ' '), '_', ' ') as label from (select *, row_number() over (partition by section order by case when specific then 0 else 1 end, case when specific then 0 when name = 'license' then 0 when name = 'the' then 1 else 2 end, n desc, pos) as r from l) where r = 1""")
def section_labels(spark, sf):
    d = views.read(spark, sf, "documents").select(F.col("doc_id").alias("chunk"), F.col("source").alias("section"))
    hits = _hits(spark, sf).join(d, "chunk").select("section", F.col("keyword").alias("name"), (F.col("kind") == "suffix").alias("specific"), "n", F.col("kw_pos").alias("pos"))
    return ops.section_labels(d.select("section").distinct(), hits, ["license", "the"])


@query(f"""with {SQL_HITS} select keyword, min(chunk) as first_chunk, arg_min(n, chunk) as n from hits group by keyword""")
def first_occurrence(spark, sf):
    return _hits(spark, sf).groupBy("keyword").agg(F.min("chunk").alias("first_chunk"), F.min_by("n", "chunk").alias("n"))
