"""Catalogs of entities: children, names by position, aliases, links, merged dictionaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import is_homepage


def children(parents: DataFrame, array: str, keep: tuple[str, ...]) -> DataFrame:
    """The elements of an array of structs as rows of their own, beside some columns of their parents."""
    return parents.select(*keep, F.inline(array))


def zip_names(rows: DataFrame, arrays: dict[str, str], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, pos (from 1) and one element of each array, as far as the shortest goes; arrays: column to name."""
    n = reduce(F.least, (F.size(c) for c in arrays))
    cut = [F.slice(F.col(c), 1, n).alias(name) for c, name in arrays.items()]
    return rows.select(*keys, *cut).select(*keys, F.posexplode(F.arrays_zip(*arrays.values())).alias("_p", "z")).select(*keys, (F.col("_p") + 1).alias("pos"), "z.*")


def with_alias(names: DataFrame, aliases: DataFrame, name: str = "en") -> DataFrame:
    """names with their alias where there is one; aliases: name, alias."""
    return names.join(aliases, name, "left")


def lookup(candidates: DataFrame, entities: DataFrame, names: tuple[str, ...], candidate: str = "candidate") -> DataFrame:
    """candidates joined to the entities that bear them as any of their names, in any case: an equi-join on the names as rows."""
    pairs = F.explode(F.array_distinct(F.array_compact(F.array(*(F.lower(n) for n in names)))))
    return candidates.withColumn("_k", F.lower(candidate)).join(entities.withColumn("_k", pairs), "_k").drop("_k")


def align_reference(blocks: DataFrame, keywords: list[str], hits: DataFrame, text: str = "text") -> DataFrame:
    """blocks with keyword (the first of the list that their text holds, in any case) and the columns of its first hit.

    hits: keyword and any others, a row per keyword that was found, so it is a dictionary's size; a keyword without a hit ends the
    search as well, its columns are null.
    """
    low = F.lower(text)
    found = F.coalesce(*(F.when(F.contains(low, F.lit(k.lower())), F.lit(k)) for k in keywords)) if keywords else F.lit(None).cast("string")
    return blocks.withColumn("keyword", found).join(F.broadcast(hits), "keyword", "left")


def chunk_of_file(files: DataFrame, index: DataFrame, file: str = "file") -> DataFrame:
    """files with chunk: the first of the index whose file has the same name, else the name without its chat prefix and suffix.

    index: pos, chunk, file (with or without folders).
    """
    name = lambda c: F.regexp_replace(c, r"^.*/", "")
    first = index.groupBy(name("file").alias("_n")).agg(F.min_by("chunk", "pos").alias("_c"))
    both = files.withColumn("_n", name(file)).join(first, "_n", "left")
    plain = F.replace(F.regexp_replace("_n", r"\.[^.]*$", ""), F.lit("livechat_chunk_"), F.lit("chunk_"))
    return both.withColumn("chunk", F.coalesce("_c", plain)).drop("_n", "_c")


def with_defaults(rows: DataFrame, looked_up: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """rows with the columns of what is known of their key, or its defaults."""
    both = rows.join(looked_up.select(key, *defaults), key, "left")
    return both.select(*rows.columns, *(F.coalesce(F.col(c), F.lit(d)).alias(c) for c, d in defaults.items()))


def to_text_columns(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON."""
    nested = {f.name for f in rows.schema if f.dataType.typeName() in ("array", "struct", "map")}
    return rows.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in rows.columns))


def merge_dictionaries(entries: DataFrame, order: tuple[str, ...] = ("file_no", "pos")) -> DataFrame:
    """target, patterns: each pattern of a target once, in the order that it comes up in."""
    first = entries.groupBy("target", "pattern").agg(F.min(F.struct(*order)).alias("o"))
    return first.groupBy("target").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "pattern"))), lambda x: x["pattern"]).alias("patterns"))


def blocked(target: Column, pattern: Column, never: tuple[str, ...], protected: tuple[str, ...] = ()) -> Column:
    """Whether a pattern may not go into a dictionary: it is listed, or holds a protected word that its target hasn't."""
    low = F.lower(F.trim(pattern))
    out = low.isin(*[w.lower() for w in never]) if never else F.lit(False)
    for word in protected:
        out = out | (F.contains(low, F.lit(word.lower())) & ~F.contains(F.lower(target), F.lit(word.lower())))
    return out


def link_audit(texts: DataFrame, keys: tuple[str, ...], text: str = "text") -> DataFrame:
    """keys, url, homepage: the links of each text, once."""
    urls = F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(https?://[^\s\"'<>)\]]+)"), F.lit(1))))
    return texts.select(*keys, urls.alias("url")).withColumn("homepage", is_homepage(F.col("url")))


def broken(links: DataFrame, status: str = "status", error: str = "error") -> DataFrame:
    """Links that answer 404 or 400, or don't answer for another reason than time."""
    return links.where(F.col(status).isin(404, 400) | ((F.col(status) == 0) & ~F.contains(F.lower(F.coalesce(error, F.lit(""))), F.lit("timed out"))))


def missing_tables(spark, required: list[str]) -> list[str]:  # noqa: ANN001
    return [t for t in required if not spark.catalog.tableExists(t)]


def latest(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """One row per key, the first by an order: what a unique key did on insertion."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
