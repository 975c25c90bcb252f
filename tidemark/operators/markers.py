"""Timestamp markers: merging, retagging, clustering, packing into parts, and the parts' checks."""

from __future__ import annotations

import re
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import byte_status, clean_title, jaccard, let, tokens
from tidemark.operators.windows import islands, ordered, runs

# Tags by what they belong to.
MACROS = {
    "Talk": "TALK", "Reaction": "TALK", "Donation": "TALK", "Chat": "TALK", "Greeting": "TALK", "Story": "TALK",
    "Gameplay": "GAMEPLAY", "Boss": "GAMEPLAY", "Victory": "GAMEPLAY", "News": "NEWS", "WatchParty": "NEWS", "Gacha": "NEWS",
}
# What descriptions open with beside their subject.
OPENINGS = ("ปู่โบ๊ต", "พูดถึง", "วิเคราะห์", "คุยเรื่อง", "ดู", "รับชม", "เปิดดู", "เล่าข่าว", "แสดงความคิดเห็นเกี่ยวกับ", "ตอบแชตเรื่อง", "ถกประเด็น")


def primary_tag(tag: Column, macros: dict[str, str] = MACROS) -> Column:
    """The macro of the first tag; a tag without one is its own."""
    first = F.regexp_extract(tag, r"\[(.*?)\]", 1)
    name = F.when(first == "", tag).otherwise(first)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in macros.items() for x in kv)), name), name)


def merge_exact(rows: DataFrame, keys: tuple[str, ...] = (), line: str = "raw", order: tuple[str, ...] = ("sec", "file_no", "line_no")) -> DataFrame:
    """Each line once, where it comes first."""
    w = Window.partitionBy(*keys, line).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def unlike(lines: Sequence[str], prefix: int = 40, most: float = 0.85) -> list[bool]:
    """Which lines stay: each is compared with the last one that stayed, by the ratio of matching blocks of their beginnings."""
    out, last = [], None
    for line in lines:
        stays = last is None or SequenceMatcher(None, line[:prefix], last[:prefix]).ratio() <= most
        out.append(stays)
        last = line if stays else last
    return out


def merge_fuzzy(rows: DataFrame, keys: tuple[str, ...] = ("stream",), line: str = "raw", order: tuple[str, ...] = ("file_no", "line_no"), prefix: int = 40, most: float = 0.85) -> DataFrame:
    """rows without lines much like the last one kept at the same second: a group is a stream's second."""

    def keep(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(list(order), kind="stable")
        return part[unlike(part[line].tolist(), prefix, most)]

    return rows.groupBy(*keys, "sec").applyInPandas(keep, rows.schema)


def adjacent_dedup(rows: DataFrame, within: int = 600, tags: Sequence[str] = ("[Talk]", "[WatchParty]", "[Gameplay]"), keys: tuple[str, ...] = ("stream",), order: tuple[str, ...] = ("sec", "seq")) -> DataFrame:
    """rows without those of a listed tag less than so long after the last kept row, if that has the same tag.

    What is dropped depends on what was kept, so the rows stream by in order, with the last kept one as all the state.
    """

    def kept(batches):  # noqa: ANN001, ANN202
        key, tag, at = None, None, None
        for batch in batches:
            stays = []
            for k, t, sec in zip(zip(*(batch[c] for c in keys), strict=True) if keys else [()] * len(batch), batch["tag"], batch["sec"], strict=True):
                if k != key:
                    key, tag, at = k, None, None
                stays.append(not (t in listed and t == tag and sec - at < within))
                if stays[-1]:
                    tag, at = t, sec
            yield batch[stays]

    listed = frozenset(tags)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(kept, rows.schema)


def retag(text: Column, tag: Column, rules: Sequence[tuple[str, str, int]], vetoes: Sequence[tuple[str, str]] = ()) -> Column:
    """The tag that the matching rule of the highest priority gives; null if it is the tag already, vetoed, or none matches."""
    low, best = F.lower(text), F.lit(None).cast("string")
    for pattern, target, _ in sorted(rules, key=lambda r: r[2]):
        best = F.when(low.rlike(pattern), target).otherwise(best)
    for pattern, target in vetoes:
        best = F.when((best == target) & low.rlike(pattern), None).otherwise(best)
    return F.when(best != tag, best)


def collapse(rows: DataFrame, tag: str = "[Story]", keys: tuple[str, ...] = ("stream",), order: tuple[str, ...] = ("sec", "seq")) -> DataFrame:
    """Of neighbouring rows of a tag the first."""
    before = F.lag("tag").over(ordered(keys, order))
    return rows.withColumn("_b", before).where(~((F.col("tag") == tag) & F.col("_b").eqNullSafe(F.lit(tag)))).drop("_b")


def cluster_by_topic(rows: DataFrame, keys: tuple[str, ...] = ("stream",), order: tuple[str, ...] = ("sec", "seq"), label: str = "label") -> DataFrame:
    """Islands (seg) of an equal label; rows without one stand alone."""
    before = F.lag(label).over(ordered(keys, order))
    first = F.row_number().over(ordered(keys, order)) == 1
    return islands(rows, ~first & (F.col(label).isNull() | before.isNull() | (F.col(label) != before)), keys, order, "seg")


def hard_breaks(rows: DataFrame, at: Sequence[int], keys: tuple[str, ...] = ("stream",), order: tuple[str, ...] = ("sec", "seq")) -> DataFrame:
    """Segments that begin at listed seconds."""
    first = F.row_number().over(ordered(keys, order)) == 1
    return islands(rows, F.col("sec").isin(*at) & ~first, keys, order, "seg")


def greedy_pack(rows: DataFrame, limit: int = 3000, keys: tuple[str, ...] = ("stream",), order: tuple[str, ...] = ("sec", "seq"), size: str = "bytes") -> DataFrame:
    """rows with part: a part takes rows until the next would pass the limit; one row over the limit is a part by itself.

    Where a part begins depends on the one before, so the rows stream by in order, a stream's after another's, in one sum each.
    """
    columns = list(rows.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", part bigint"

    def filled(batches):  # noqa: ANN001, ANN202
        key, part, held = None, 0, 0
        for batch in batches:
            parts = []
            for k, n in zip(zip(*(batch[c] for c in keys), strict=True) if keys else [()] * len(batch), batch[size], strict=True):
                if k != key:
                    key, part, held = k, 0, 0
                if held and held + n > limit:
                    part, held = part + 1, 0
                held += n
                parts.append(part)
            yield batch[columns].assign(part=parts)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(filled, schema)


def greedy_pack_fold(rows: DataFrame, limit: int = 3000, keys: tuple[str, ...] = ("stream",), order: tuple[str, ...] = ("sec", "seq"), size: str = "bytes") -> DataFrame:
    """keys, the last column of order, part: greedy_pack as a fold in the JVM, for streams of some thousand rows."""
    name = order[-1]
    kind = rows.schema[name].dataType.simpleString()
    start = F.struct(F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("held"), F.expr(f"cast(array() as array<struct<id:{kind},part:bigint>>)").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        over = (acc["held"] > 0) & (acc["held"] + r["_size"] > limit)
        part = F.when(over, acc["part"] + 1).otherwise(acc["part"])
        return F.struct(part.alias("part"), (F.when(over, F.lit(0)).otherwise(acc["held"]) + r["_size"]).cast("bigint").alias("held"), F.concat(acc["out"], F.array(F.struct(r[name].alias("id"), part.alias("part")))).alias("out"))

    entry = F.struct(*order, F.col(size).cast("bigint").alias("_size"))
    folded = rows.groupBy(*keys).agg(F.explode(F.aggregate(F.sort_array(F.collect_list(entry)), start, step, lambda a: a["out"])).alias("x"))
    return folded.select(*keys, F.col("x.id").alias(name), F.col("x.part").alias("part"))


def halves(sizes: Sequence[int], limit: int) -> list[int]:
    """Segment numbers of entries: a segment over the limit is cut at the entry nearest to half its bytes, again and again.

    An entry over the limit is a segment by itself.
    """
    out, todo, made = [0] * len(sizes), [(0, len(sizes))] if sizes else [], 0
    while todo:
        lo, hi = todo.pop()
        total = sum(sizes[lo:hi])
        if total <= limit or hi - lo == 1:
            out[lo:hi] = [made] * (hi - lo)
            made += 1
            continue
        run, best = 0, (None, lo + 1)
        for k in range(lo, hi - 1):
            run += sizes[k]
            if best[0] is None or abs(run - total / 2) < best[0]:
                best = (abs(run - total / 2), k + 1)
        todo += [(best[1], hi), (lo, best[1])]
    return out


def normalise(rows: DataFrame, limit: int = 3000, tiny: int = 200, keys: tuple[str, ...] = ("stream",), segment: str = "seg", order: tuple[str, ...] = ("sec", "seq"), size: str = "bytes") -> DataFrame:
    """rows with seg numbered anew: segments over the limit halved, single entries under `tiny` bytes joined to the one before."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != segment) + f", `{segment}` bigint"

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([segment, *order], kind="stable")
        new, number = [], -1
        for _, group in part.groupby(segment, sort=True):
            sizes = group[size].tolist()
            cuts = halves(sizes, limit)
            if new and len(sizes) == 1 and sizes[0] < tiny:
                new.append(number)
                continue
            new += [number + 1 + c for c in cuts]
            number = new[-1]
        return part.drop(columns=[segment]).assign(**{segment: new})

    return rows.groupBy(*keys).applyInPandas(one, schema)


def split_at_middle(rows: DataFrame, keys: tuple[str, ...] = ("part",), order: tuple[str, ...] = ("sec", "seq"), size: str = "bytes", show: str = "time") -> DataFrame:
    """keys, split_at: the marker, not the first, whose place in bytes is nearest to the part's half."""
    w = ordered(keys, order)
    rows = rows.withColumn("_at", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum(size).over(Window.partitionBy(*keys)))
    return rows.where("_at > 0").groupBy(*keys).agg(F.min_by(show, F.struct(F.abs(F.col("_at") - F.col("_all") / 2), "_at")).alias("split_at"))


def part_sizes(rows: DataFrame, keys: tuple[str, ...] = ("stream", "part"), text: str = "raw") -> DataFrame:
    """keys, n, bytes, chars, status of parts of lines, each with its line feed."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.octet_length(text) + 1).alias("bytes"), F.sum(F.length(text) + 1).alias("chars"))
    return out.withColumn("status", byte_status(F.col("bytes")))


def titles(rows: DataFrame, keys: tuple[str, ...] = ("part",), order: tuple[str, ...] = ("sec", "seq"), longest: int = 95, phrase: int = 35, openings: Sequence[str] = OPENINGS) -> DataFrame:
    """keys, title: the label of the first row's topic (topic_label, if rows have it), else the first, middle and last distinct
    descriptions, without what they open with, cut short at a space and joined."""
    desc = F.trim("desc")
    plain = F.regexp_replace(desc, rf"^(?:{'|'.join(map(re.escape, openings))})\s*", "")
    short = F.when(plain == "", desc).otherwise(plain)
    short = F.when(F.length(short) <= phrase, short).otherwise(F.regexp_replace(short.substr(1, phrase), " [^ ]*$", ""))
    texts = rows.withColumn("_s", short).where("_s <> ''").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, "_s"))).alias("x"))
    firsts = lambda low: F.transform("x", lambda r, i: F.when(F.array_position(low, F.lower(r["_s"])) == i + 1, r["_s"]))
    texts = texts.withColumn("d", F.array_compact(let(F.transform("x", lambda r: F.lower(r["_s"])), firsts)))
    n = F.size("d")
    picked = F.when(n <= 3, F.col("d")).otherwise(F.array(F.get("d", F.lit(0)), F.get("d", F.floor(n / 2).cast("int")), F.get("d", n - 1)))
    joined = texts.select(*keys, clean_title(F.array_join(picked, " | "), longest).alias("title"))
    if "topic_label" not in rows.columns:
        return joined
    first = rows.groupBy(*keys).agg(F.min_by("topic_label", F.struct(*order)).alias("_label"))
    return first.join(joined, list(keys), "left").select(*keys, F.when(F.coalesce("_label", F.lit("")) != "", clean_title(F.col("_label"))).otherwise(F.col("title")).alias("title"))


def tag_diversity(rows: DataFrame, keys: tuple[str, ...] = ("part",), column: str = "macro", allowed: Sequence[str] = ("GAMEPLAY", "TALK")) -> DataFrame:
    """keys, macros, flagged: parts of more than one macro, but for exactly the allowed ones."""
    out = rows.groupBy(*keys).agg(F.sort_array(F.collect_set(column)).alias("macros"))
    return out.withColumn("flagged", (F.size("macros") > 1) & (F.col("macros") != F.array(*map(F.lit, sorted(allowed)))))


def tag_flips(rows: DataFrame, keys: tuple[str, ...] = ("part",), order: tuple[str, ...] = ("sec", "seq"), column: str = "macro", least: int = 2) -> DataFrame:
    """keys, flips, flagged: how often a tag returns after one row of another."""
    w = ordered(keys, order)
    flip = (F.col(column) == F.lag(column, 2).over(w)) & (F.col(column) != F.lag(column).over(w))
    out = rows.withColumn("_f", flip).groupBy(*keys).agg(F.count_if("_f").alias("flips"))
    return out.withColumn("flagged", F.col("flips") >= least)


def keyword_coherence(rows: DataFrame, keys: tuple[str, ...] = ("part",), order: tuple[str, ...] = ("sec", "seq"), least: float = 0.1) -> DataFrame:
    """keys, min_overlap, flagged: the least likeness of the first description's words to another's."""
    w = ordered(keys, order)
    t = rows.withColumn("_t", tokens(F.col("desc"))).withColumn("_first", F.first("_t").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_k", F.row_number().over(w))
    out = t.groupBy(*keys).agg(F.min(F.when(F.col("_k") > 1, jaccard(F.col("_first"), F.col("_t")))).alias("o"), F.count("*").alias("n"))
    return out.where("n > 1").select(*keys, F.round("o", 4).alias("min_overlap"), ((F.col("o") < least) & (F.col("n") >= 3)).alias("flagged"))


def names_in(text: Column, names: Sequence[str]) -> Column:
    """The names that stand in a text, in any case, in the list's order."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(n.lower())), F.lit(n)) for n in names)))


def unsupported_names(rows: DataFrame, allowed: DataFrame, key: str = "chunk") -> DataFrame:
    """rows (exploded column name) whose name is neither part of an allowed name of their chunk nor holds one; allowed: chunk, allowed."""
    both = rows.join(allowed, key)
    related = F.exists("allowed", lambda a: F.contains(F.lower(a), F.lower("name")) | F.contains(F.lower("name"), F.lower(a)))
    return both.where(~related).select(*rows.columns)


def category_blocks(chunks: DataFrame, keys: tuple[str, ...] = ("stream",), order: tuple[str, ...] = ("idx",), category: str = "category", text: str = "text", show: str = "ts", warn: int = 3500, over: int = 4500) -> DataFrame:
    """keys, island, category, first_ts, last_ts, n_chunks, bytes, status: neighbouring chunks of a category, their texts joined by spaces."""
    found = runs(chunks, category, keys, order).withColumn("_b", F.octet_length(text) + 1)
    k = F.struct(*order)
    out = found.groupBy(*keys, "island", category).agg(F.min_by(show, k).alias("first_ts"), F.max_by(show, k).alias("last_ts"), F.count("*").alias("n_chunks"), F.sum("_b").alias("bytes"))
    out = out.withColumn("bytes", F.when(F.col("island") == 0, F.col("bytes")).otherwise(F.col("bytes") - 1))  # the first one has a leading space
    return out.withColumn("status", byte_status(F.col("bytes"), warn, over))


def in_segment(markers: DataFrame, moods: DataFrame, key: str = "chunk", sec: str = "sec", natural: str = "natural") -> DataFrame:
    """markers with in_pulse: whether the first segment of their chunk that holds them isn't a natural one.

    moods: chunk, segments (array of start, end, mood). Outside of all segments it is false; a chunk without segments counts whole.
    """
    there = markers.join(moods.select(key, F.col("segments").alias("_s")), key, "left")
    first = F.get(F.filter("_s", lambda s: (s["start"] <= F.col(sec)) & (F.col(sec) < s["end"])), F.lit(0))
    pulse = F.when(F.coalesce(F.size("_s"), F.lit(0)) <= 0, True).otherwise(F.coalesce(first["mood"] != natural, F.lit(False)))
    return there.withColumn("in_pulse", pulse).drop("_s")


def sparse_parts(parts: DataFrame, least: int, limit: int, keys: tuple[str, ...] = ("stream",), order: tuple[str, ...] = ("part",)) -> DataFrame:
    """parts (n, bytes) with part numbered anew: neighbours join while one of them has few entries and both fit the limit."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(order), kind="stable")
        new, number, n, size = [], -1, 0, 0
        for a, b in zip(rows["n"], rows["bytes"], strict=True):
            if number >= 0 and (a < least or n < least) and size + b <= limit:
                n, size = n + a, size + b
            else:
                number, n, size = number + 1, a, b
            new.append(number)
        return rows.assign(new_part=new)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", new_part bigint"
    return parts.groupBy(*keys).applyInPandas(one, schema)
