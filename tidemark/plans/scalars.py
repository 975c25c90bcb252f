"""Queries of scalar functions: clocks, markers, sizes, dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import clock, text
from tidemark.plans import views
from tidemark.plans.views import SQL_CHAT, SQL_CLOCK, SQL_LINES, SQL_MARKERS, registry

QUERIES, ORACLES, query = registry()
CORRECTIONS = [text.Correction("STREAM", ("thion", "then er")), text.Correction("THE$1", ("the and",), ("license",)), text.Correction("re", ("THE$1 attion",))]
PATTERNS = text.valid_patterns({"<num>": ["[0-9]{3,}"], "\\1": ["([a-z])!!"], "": ["[*]{3}", "(unclosed"], "AND": ["and and"]})
GARBLES = {"marks": "[$&%#]{3}", "shout": "!!", "caps": "[A-Z]{6,}", "number": "[0-9]{6,}"}


@query(f"with {SQL_CHAT} select seq, {SQL_CLOCK.format('sec')} as clock, 'chunk_' || printf('%02d', sec // 300) as chunk from chat")
def fmt_clock(spark, sf):
    return views.chat(spark, sf).select("seq", clock.fmt_clock(F.col("sec")).alias("clock"), clock.chunk_name(F.col("sec")).alias("chunk"))


@query(f"with {SQL_MARKERS} select stream, seq, sec, time, tag, \"desc\", bytes from markers")
def parse_clock(spark, sf):
    return views.markers(spark, sf).select("stream", "seq", "sec", "time", "tag", "desc", "bytes")


@query("""select doc_id, length(text) as chars, strlen(text) as bytes, case when strlen(text) > 4500 then 'OVER' when strlen(text) > 3500 then 'WARN' else 'OK' end as status from documents""")
def text_bytes_status(spark, sf):
    d = views.read(spark, sf, "documents")
    return d.select("doc_id", F.length("text").cast("bigint").alias("chars"), F.octet_length("text").cast("bigint").alias("bytes"), text.byte_status(F.octet_length("text")).alias("status"))


@query("""with a as (select doc_id, text, regexp_replace(text, '(?i)thion', 'STREAM', 'g') as t from documents),
b as (select doc_id, text, regexp_replace(t, '(?i)then er', 'STREAM', 'g') as t from a),
c as (select doc_id, text, case when contains(lower(t), 'license') then t else regexp_replace(t, '(?i)the and', 'THE$1', 'g') end as t from b),
d as (select doc_id, text, regexp_replace(t, '(?i)the\\$1 attion', 're', 'g') as t from c)
select doc_id, md5(t) as digest, t <> text as changed from d""")
def literal_correct(spark, sf):
    d = views.read(spark, sf, "documents").select("doc_id", "text", text.correct(F.col("text"), CORRECTIONS).alias("t"))
    return d.select("doc_id", F.md5("t").alias("digest"), (F.col("t") != F.col("text")).alias("changed"))


@query(f"""with {SQL_LINES}, c as (select doc, pos, line, regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '(?i)[0-9]{{3,}}', '<num>', 'g'), '(?i)([a-z])!!', '\\1', 'g'), '(?i)and and', 'AND', 'g'), '(?i)[*]{{3}}', '', 'g') as cleaned from lines)
select doc, count(*) as n_lines, count(*) filter (where cleaned <> line) as n_changed, cast(sum(strlen(line) - strlen(cleaned)) as bigint) as bytes_less from c group by doc""")
def regex_clean_changes(spark, sf):
    c = views.lines(spark, sf).withColumn("cleaned", text.clean(F.col("line"), PATTERNS))
    return c.groupBy("doc").agg(F.count("*").alias("n_lines"), F.count_if(F.col("cleaned") != F.col("line")).alias("n_changed"), F.sum(F.octet_length("line") - F.octet_length("cleaned")).cast("bigint").alias("bytes_less"))


@query("""with p(warning, pattern) as (values ('marks', '[$&%#]{3}'), ('shout', '!!'), ('caps', '[A-Z]{6,}'), ('number', '[0-9]{6,}'))
select doc_id, warning, cast(len(regexp_extract_all(text, pattern)) as bigint) as n from documents, p where len(regexp_extract_all(text, pattern)) > 0""")
def garble_scan(spark, sf):
    # the patterns stay literals, so each compiles once
    counts = F.array(*(F.struct(F.lit(name).alias("warning"), F.regexp_count("text", F.lit(pattern)).cast("bigint").alias("n")) for name, pattern in GARBLES.items()))
    return views.read(spark, sf, "documents").select("doc_id", F.inline(F.filter(counts, lambda c: c["n"] > 0)))


@query("""select doc_id, cast(len(regexp_extract_all(text, '([áéíóúñäöüßçèêàâî]+[A-Za-z]{2,})', 1)) as bigint) as n_tokens, coalesce(regexp_extract(text, '([áéíóúñäöüßçèêàâî]+[A-Za-z]{2,})', 1), '') as first_token from documents""")
def hybrid_tokens(spark, sf):
    d = views.read(spark, sf, "documents").select("doc_id", text.hybrid_tokens(F.col("text"), "áéíóúñäöüßçèêàâî").alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first_token"))


@query(f"""with {SQL_CHAT} select seq, cast(floor(sec / 89.932) as int) + 1 as slide, least(8, cast(floor((sec % 89.932::double) / 9.9924) as int)) as sub,
least(8, cast(floor((sec % 89.932::double) / 9.9924) as int)) % 3 * 320 as x, least(8, cast(floor((sec % 89.932::double) / 9.9924) as int)) // 3 * 180 as y from chat""")
def storyboard(spark, sf):
    return views.chat(spark, sf).select("seq", clock.storyboard(F.col("sec").cast("double")).alias("s")).select("seq", "s.*")


@query("""select page_id, trim(substring(trim(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60)) as slug from pages""")
def url_slug(spark, sf):
    return views.read(spark, sf, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))
