"""Keywords, rarity-weighted scores, topic boundaries and sections over chunks of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import char_grams, count_of, display_name, jaccard


def classify(text, categories: dict[str, list[str]]):  # noqa: ANN001, ANN201
    """The categories of which any word stands in a text, in the dictionary's order; ["unknown"] if none."""
    low = F.lower(text)
    hit = lambda words: F.coalesce(F.greatest(*(F.contains(low, F.lit(w.lower())) for w in words)), F.lit(False)) if len(words) > 1 else F.contains(low, F.lit(words[0].lower()))
    found = F.array_compact(F.array(*(F.when(hit(words), F.lit(name)) for name, words in categories.items() if words)))
    return F.when(F.size(found) == 0, F.array(F.lit("unknown"))).otherwise(found)


def keyword_hits(chunks: DataFrame, keywords: DataFrame, threshold: int = 1, key: str = "chunk", text: str = "text") -> DataFrame:
    """chunk, kw_pos, keyword, kind, file, n: how often each keyword stands in a chunk, from a threshold up.

    keywords (kw_pos, keyword, kind, file) is a dictionary: it is broadcast, and each chunk's text is read once.
    """
    words = F.collect_list(F.struct("kw_pos", "keyword", "kind", "file"))
    dim = keywords.withColumn("keyword", F.lower("keyword")).agg(words.alias("kw"))
    low = chunks.select(key, F.lower(text).alias("_t")).join(F.broadcast(dim))  # one row
    hits = F.filter(F.transform("kw", lambda k: F.struct(k["kw_pos"].alias("kw_pos"), k["keyword"].alias("keyword"), k["kind"].alias("kind"), k["file"].alias("file"), count_of(F.col("_t"), k["keyword"]).alias("n"))), lambda h: h["n"] >= threshold)
    return low.select(key, F.inline(hits))


def idf(hits: DataFrame, n_chunks: int, key: str = "chunk") -> DataFrame:
    """keyword, df, idf of the keywords that any chunk holds."""
    df = hits.where("n >= 1").groupBy("keyword").agg(F.count_distinct(key).alias("df"))
    return df.withColumn("idf", F.round(F.log(F.lit(float(n_chunks)) / F.col("df")), 4))


def weighted(hits: DataFrame, rarity: DataFrame, by: str, key: str = "chunk") -> DataFrame:
    """chunk, by, score, share, rank: sums of count * idf by file or kind; equal scores rank by the keywords' order.

    rarity has a row per keyword: it is broadcast, as the dictionary is. The hits meet by chunk alone, for sums and ranks alike.
    """
    scores = hits.repartition(key).join(F.broadcast(rarity), "keyword").where(F.col(by).isNotNull()).groupBy(key, by).agg(F.round(F.sum(F.col("n") * F.col("idf")), 4).alias("score"), F.min("kw_pos").alias("_pos"))
    total = F.sum("score").over(Window.partitionBy(key))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "_pos"))
    return scores.select(key, by, "score", F.round(F.coalesce(F.try_divide("score", total), F.lit(0.0)), 3).alias("share"), rank.cast("bigint").alias("rank"))


def best_files(hits: DataFrame, rarity: DataFrame, key: str = "chunk") -> DataFrame:
    """chunk, best_file (of a score over 0), confidence, primary_topic.

    Files and kinds are scored in one pass over the hits, which meet by chunk alone: one shuffle. rarity is a dictionary's size.
    """
    scored = hits.repartition(key).join(F.broadcast(rarity.select("keyword", "idf")), "keyword")
    each = F.explode(F.array(F.struct(F.lit("file").alias("by"), F.col("file").alias("name")), F.struct(F.lit("kind").alias("by"), F.col("kind").alias("name"))))
    sums = scored.select(key, "kw_pos", (F.col("n") * F.col("idf")).alias("_s"), each.alias("_e")).where("_e.name is not null").groupBy(key, F.col("_e.by").alias("_by"), F.col("_e.name").alias("_name")).agg(F.round(F.sum("_s"), 4).alias("score"), F.min("kw_pos").alias("_pos"))
    first = lambda by: F.max_by(F.struct("_name", "score"), F.when(F.col("_by") == by, F.struct("score", -F.col("_pos"))))
    best = sums.groupBy(key).agg(first("file").alias("_f"), first("kind").alias("_k"), F.sum(F.when(F.col("_by") == "file", F.col("score"))).alias("_all")).where("_k is not null")
    share = F.round(F.coalesce(F.try_divide(F.col("_f.score"), F.col("_all")), F.lit(0.0)), 3)
    top = best.select(key, F.when(F.col("_f.score") > 0, F.col("_f._name")).alias("best_file"), F.when(F.col("_f.score") > 0, share).otherwise(0.0).alias("confidence"), "_k")
    stem = F.regexp_replace("best_file", r"^.*/|\.md$", "")
    topic = F.when(F.col("best_file").isNotNull(), F.concat(display_name(stem), F.lit(" ("), stem, F.lit(")"))).otherwise(F.col("_k._name"))
    return top.select(key, "best_file", "confidence", topic.alias("primary_topic"))


def boundaries(chunks: DataFrame, threshold: float = 0.3, time_gap: float = 600, near: int = 2, keys: tuple[str, ...] = ("stream",), index: str = "idx") -> DataFrame:
    """keys, idx, similarity of the chunks (idx, start, text, signal) that a topic begins with.

    Neighbours differ in topic if their triples of characters are unlike and either has a signal, or if without signals their
    starts lie apart. Of boundaries no further apart than `near` the last one stays.
    """
    w = Window.partitionBy(*keys).orderBy(index)
    rows = chunks.withColumn("_g", char_grams(F.col("text")))
    rows = rows.withColumn("similarity", F.round(jaccard(F.lag("_g").over(w), F.col("_g")), 4)).withColumn("_apart", F.col("start") - F.lag("start").over(w)).withColumn("_signal", F.greatest(F.col("signal"), F.lag("signal").over(w)))
    found = rows.where(F.col("similarity").isNotNull() & F.when(F.col("_signal") > 0, F.col("similarity") < threshold).otherwise(F.col("_apart") > time_gap))
    return found.withColumn("_next", F.lead(index).over(w)).where(F.col("_next").isNull() | (F.col("_next") - F.col(index) > near)).select(*keys, index, "similarity")


def sections(chunks: DataFrame, bounds: DataFrame, least: int = 3, default: int = 6, tail: float = 300, keys: tuple[str, ...] = ("stream",), index: str = "idx") -> DataFrame:
    """keys, section (from 0), start, end, n_chunks of the sections that boundaries cut chunks (idx, start) into.

    A boundary's chunk belongs to the section that it ends. A section of under `least` chunks isn't made, and the next one starts
    where it would have; so does a short tail, unless nothing else was made. Without boundaries every `default` chunks are one.
    """
    w = Window.partitionBy(*keys).orderBy(index)
    flagged = chunks.select(*keys, index, "start").join(bounds.select(*keys, index, F.lit(True).alias("_cut")), [*keys, index], "left").withColumn("_cut", F.coalesce("_cut", F.lit(False)))
    whole = Window.partitionBy(*keys)
    flagged = flagged.withColumn("_any", F.max("_cut").over(whole)).withColumn("_row", F.row_number().over(w) - 1)
    before = F.coalesce(F.sum(F.col("_cut").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    flagged = flagged.withColumn("_part", F.when(F.col("_any"), before).otherwise(F.floor(F.col("_row") / default)))
    parts = flagged.groupBy(*keys, "_any", "_part").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("start").alias("last"), F.max("_cut").alias("closed"))
    p = Window.partitionBy(*keys).orderBy("_part")
    # a section starts where the last one made ended: at its last chunk, the boundary
    made = F.when(~F.col("_any"), F.lit(True)).otherwise(F.col("n") >= least)
    parts = parts.withColumn("_made", made).withColumn("_from", F.last(F.when(F.col("_made"), F.col("last")), ignorenulls=True).over(p.rowsBetween(Window.unboundedPreceding, -1)))
    parts = parts.withColumn("_start", F.when(~F.col("_any"), F.col("first")).otherwise(F.coalesce("_from", F.min("first").over(whole)))).withColumn("_end", F.when(F.col("closed"), F.col("last")).otherwise(F.col("last") + tail))
    none = ~F.max("_made").over(whole)
    parts = parts.withColumn("_only", none).withColumn("_total", F.sum("n").over(whole)).withColumn("_final", F.max("last").over(whole) + tail)
    kept = parts.where("_made or (_only and _part = 0)")
    number = F.row_number().over(p) - 1
    return kept.select(*keys, number.cast("bigint").alias("section"), F.col("_start").alias("start"), F.when(F.col("_only"), F.col("_final")).otherwise(F.col("_end")).alias("end"), F.when(F.col("_only"), F.col("_total")).otherwise(F.col("n")).alias("n_chunks"))


def section_labels(parts: DataFrame, hits: DataFrame, preferred: list[str], keys: tuple[str, ...] = ("section",)) -> DataFrame:
    """keys, label: the name counted most among specific ones, else the first preferred generic one, else the one counted most.

    hits: keys, name, specific, n, pos. Equal counts go to the smaller pos; sections without hits are "(auto)".
    """
    sums = hits.groupBy(*keys, "name", "specific").agg(F.sum("n").alias("n"), F.min("pos").alias("pos"))
    liked = F.coalesce(*(F.when(F.col("name") == p, F.lit(k)) for k, p in enumerate(preferred)), F.lit(len(preferred))) if preferred else F.lit(0)
    order = F.struct(~F.col("specific"), F.when(F.col("specific"), 0).otherwise(liked), -F.col("n"), "pos")
    best = sums.groupBy(*keys).agg(F.min_by("name", order).alias("label"))
    return parts.join(best, list(keys), "left").withColumn("label", F.coalesce(F.regexp_replace("label", "[-_]", " "), F.lit("(auto)")))
