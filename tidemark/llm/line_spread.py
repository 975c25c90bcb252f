r"""Lines that spread over sites are boilerplate and go.

A line's key is a 128-bit hash of its trimmed text. For each key HyperLogLog sketches of the sites (`source`) merge by aggregation;
a line on `min_sites` sites or more is boilerplate, whatever stands around it, so a fixed block goes as a whole. Where an estimate
lies within its error (three standard errors) of the threshold, the line gets an exact distinct count instead. Only DataFrame
functions are used.

Copies of a whole document spread each of its lines over sites, too, though it is one text and no boilerplate: a document counts
once, however often it is copied. So a line must also stand in `min_texts` different whole texts, which a second sketch counts
and an exact count decides near its threshold; min_texts=1 leaves the sites alone.

Defined cases: empty lines are never boilerplate; a null text stays null, with no lines; a null source is a site of its own; of
repeated doc_ids each row loses its own boilerplate; a text of boilerplate alone becomes empty; an empty table gives an empty
result; all columns of the documents are kept and other ones may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table

#: Sites that make a line boilerplate, and different texts that it must stand in.
MIN_SITES, MIN_TEXTS = 8, 8
#: Sketches of 2**LG_K registers: a standard error of 1.04 / sqrt(2**LG_K).
LG_K = 10
_TRIMMED = " \t\r"


def _key(line):  # noqa: ANN001, ANN202
    trimmed = F.trim(line, F.lit(_TRIMMED))
    return F.struct(F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit("line"), trimmed).alias("b"), (trimmed == "").alias("empty"))


def _document(docs: DataFrame):  # noqa: ANN202
    return F.coalesce(docs["doc_id"].cast("string"), F.lit(""))


def lines(docs: DataFrame) -> DataFrame:
    """doc, site, a, b (the key), whole (a hash of the text) of every line that isn't empty."""
    text = docs["text"].cast("string")
    keys = docs.select(_document(docs).alias("doc"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("site"), F.xxhash64(text).alias("whole"), F.explode(F.transform(F.split(text, "\n"), _key)).alias("k"))
    return keys.where("not k.empty").select("doc", "site", F.col("k.a").alias("a"), F.col("k.b").alias("b"), "whole")


def boilerplate(all_lines: DataFrame, min_sites: int = MIN_SITES, min_texts: int = MIN_TEXTS, lg_k: int = LG_K) -> DataFrame:
    """The keys (a, b) of lines that stand on min_sites sites and in min_texts different texts."""
    error = 3 * 1.04 / 2 ** (lg_k / 2)
    sketches = all_lines.groupBy("a", "b").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", lg_k).alias("s"), F.hll_sketch_agg("whole", lg_k).alias("t"))
    # how often a line's estimates are of their thresholds
    spread = sketches.where(F.col("n") >= max(min_sites, min_texts)).select("a", "b", F.least(F.hll_sketch_estimate("s") / min_sites, F.hll_sketch_estimate("t") / min_texts).alias("of"))
    spread = cut(spread.where(F.col("of") >= 1 - error))
    near = spread.where(F.col("of") < 1 + error).select("a", "b")
    exact = all_lines.join(near, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.countDistinct("site").alias("s"), F.countDistinct("whole").alias("t"))
    exact = exact.where((F.col("s") >= min_sites) & (F.col("t") >= min_texts)).select("a", "b")
    return spread.where(F.col("of") >= 1 + error).select("a", "b").union(exact)


def strip(docs: DataFrame, min_sites: int = MIN_SITES, min_texts: int = MIN_TEXTS, lg_k: int = LG_K) -> DataFrame:
    """docs with boilerplate lines taken out of text, and two columns more: tm_lines and tm_removed."""
    found = cut(lines(docs))
    gone = found.join(boilerplate(found, min_sites, min_texts, lg_k), ["a", "b"]).groupBy(F.col("doc").alias("tm_doc")).agg(F.collect_set(F.struct("a", "b")).alias("tm_gone"))
    both = docs.join(gone, _document(docs) == gone["tm_doc"], "left")
    whole = F.split(docs["text"].cast("string"), "\n")

    def stays(line):  # noqa: ANN001, ANN202
        key = _key(line)
        return key["empty"] | ~F.array_contains("tm_gone", F.struct(key["a"].alias("a"), key["b"].alias("b")))

    kept = F.when(F.col("tm_gone").isNull(), whole).otherwise(F.filter(whole, stays))
    both = both.withColumn("tm_kept", kept)
    columns = [F.array_join("tm_kept", "\n").alias("text") if c == "text" else docs[c] for c in docs.columns]
    n = F.when(docs["text"].isNull(), 0).otherwise(F.size(whole))
    return both.select(*columns, n.cast("long").alias("tm_lines"), (n - F.when(docs["text"].isNull(), 0).otherwise(F.size("tm_kept"))).cast("long").alias("tm_removed"))


def op3_line_spread(spark, sf_dir) -> DataFrame:
    out = strip(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("tm_lines").alias("n_lines"), F.col("tm_removed").alias("n_removed"))


# doc_ids are unique in the tables at hand; of a null text no line is left
ORACLE = r"""
with l as (
  select doc_id, text, source, i, string_split(text, chr(10))[i] as line, trim(string_split(text, chr(10))[i], ' ' || chr(9) || chr(13)) as key
  from (select *, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)),
b as (select key from l where key <> '' group by key having count(distinct coalesce(source, '')) >= 8 and count(distinct text) >= 8)
select doc_id, coalesce(string_agg(line, chr(10) order by i) filter (where b.key is null), '') as text,
       count(*) as n_lines, count(b.key) as n_removed
from l left join b on l.key = b.key group by doc_id
"""
