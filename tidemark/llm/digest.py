"""Exact digests of canonical texts.

A text's canonical form is NFKC, case-folded, NFKC again, with white space folded to single spaces and trimmed. Its fingerprint
is the 128-bit xxh3 hash of the form's UTF-8, as hex. Documents of equal digest are then compared byte by byte, and forms that
differ in spite of it get a suffix (~1, ~2, ...) in the order of their SHA-256, so equal fingerprints mean equal forms.

The comparison deals each digest's members over salted groups. A sorted group streams past, and each member is compared with the
group's distinct forms so far (one, unless the digest fails); the groups pass on those forms' SHA-256 only, so a digest that a
third of all documents share stays spread out. Only documents whose digest occurs twice take part: bitmaps over those digests and
over the documents' ids, sized by their numbers, keep the other texts from being shuffled without a join on the digest.

Defined cases: a null text is empty; repeated documents have equal fingerprints; a null doc_id stays null and sorts last in
neighbours(); documents of an equal doc_id follow each other in the order of their texts; an empty table gives an empty result;
other columns are ignored. The fingerprint of an edited text that equals its document's is that one's, else its bare digest.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bit_of, bitmap_bits, cut, held, id_bitmap, table

Digest = Callable[[bytes], str]
#: Salted groups of a digest's members.
SALTS = 64
#: neighbours() sorts in ranges of ids of so many rows each, or in so many ranges if they get more.
RANGE_ROWS, MAX_RANGES = 4000, 4096
#: Rows that a task hands on at once.
_BATCH = 256


def canonical(text: str) -> bytes:
    """NFKC, case fold, NFKC, white space folded: texts that differ only so are one."""
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def by_text(docs: DataFrame, make: Callable[[str], tuple], ddl: str, names: list[str]) -> DataFrame:
    """doc_id and what make() returns for the text, for every row of docs."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [make(t.as_py() or "") for t in batch.column(1)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*rows, strict=True))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(made, f"doc_id long, {ddl}")


def fingerprints(docs: DataFrame, digest: Digest = xxhash.xxh3_128_hexdigest) -> DataFrame:
    """doc_id and fingerprint of every row of docs; digest: of a canonical form."""

    def found(sha: bool) -> DataFrame:
        if not sha:
            return by_text(docs, lambda t: (digest(canonical(t)),), "fingerprint string", ["fingerprint"])
        return by_text(docs, lambda t: (digest(f := canonical(t)), hashlib.sha256(f).hexdigest()), "fingerprint string, tm_sha string", ["fingerprint", "tm_sha"])

    return tell_apart(docs, found, digest)


def tell_apart(docs: DataFrame, make: Callable[[bool], DataFrame], digest: Digest) -> DataFrame:
    """What make() gives (doc_id, fingerprint and any others), with suffixes where a digest stands for different forms.

    make(True) gives tm_sha as well, the SHA-256 of the form; it is asked for only if a digest has failed.
    """
    found, context = cut(make(False)), docs.sparkSession.sparkContext
    twice = cut(found.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint", "n"))
    n = twice.agg(F.count("*").alias("digests"), F.coalesce(F.sum("n"), F.lit(0)).alias("members")).first()
    if not n["digests"]:
        return found
    wide = bitmap_bits(n["digests"])
    digests = context.broadcast(id_bitmap(twice, "fingerprint", wide))

    def recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(held(digests.value, batch.column(1).to_numpy())))], names=["doc_id"])

    members = found.select("doc_id", bit_of("fingerprint", wide)).mapInArrow(recurring, "doc_id long")
    bits = bitmap_bits(n["members"])
    ids = context.broadcast(id_bitmap(members, "doc_id", bits))

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(0).to_numpy()
            keys = np.flatnonzero(held(ids.value, place))
            out = [canonical(batch.column(1)[int(k)].as_py() or "") for k in keys]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([digest(f) for f in out]), pa.array(out, pa.binary()), pa.array(place[keys] % SALTS, pa.int64())], names=["digest", "form", "salt"])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen, out = None, set(), []
        for batch in batches:
            for d, form, salt in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                form = form.as_py()
                if (d, salt) != key:
                    key, seen = (d, salt), set()
                if form not in seen:  # equal bytes
                    seen.add(form)
                    out.append((d, hashlib.sha256(form).hexdigest()))
            if len(out) >= _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["digest", "sha"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["digest", "sha"])

    dealt = docs.select(bit_of(F.col("doc_id").cast("long"), bits), F.col("text").cast("string")).mapInArrow(forms, "digest string, form binary, salt long")
    dealt = dealt.repartition("digest", "salt").sortWithinPartitions("digest", "salt")
    shas = dealt.mapInArrow(distinct, "digest string, sha string").distinct()
    failed = shas.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    suffix = Window.partitionBy("digest").orderBy("sha")
    failed = cut(shas.join(failed, "digest", "left_semi").select(F.col("digest").alias("fingerprint"), F.col("sha").alias("tm_sha"), (F.row_number().over(suffix) - 1).alias("tm_k")))
    if failed.isEmpty():
        return found
    named = F.when(F.col("tm_k") > 0, F.concat("fingerprint", F.lit("~"), F.col("tm_k").cast("string"))).otherwise(F.col("fingerprint"))
    return make(True).join(failed, ["fingerprint", "tm_sha"], "left").select(*(named.alias(c) if c == "fingerprint" else F.col(c) for c in found.columns))


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text, range, ghost: dealt by ranges of doc_id and sorted downward within them, a null doc_id last.

    Each range ends with a ghost: the document that follows its last one (the largest of the range below; after the smallest of
    all the largest). So a task that streams over the rows sees every document's successor.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = rows.count()
    if not n:
        return rows.selectExpr("doc_id", "text", "0 as range", "false as ghost").limit(0)
    ranges = min(MAX_RANGES, max(1, n // RANGE_ROWS))
    ends = rows.select(F.percentile_approx("place", [k / ranges for k in range(1, ranges)] or [0.5], 100 * ranges).alias("e")).first()["e"]
    ends = np.array(sorted(set(ends)), np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, ids.to_numpy()).astype(np.int32))

    placed = rows.select("doc_id", "text", "place", range_of("place").alias("range"))
    # one row per range, of which there are MAX_RANGES at most
    tops = sorted((r["range"], r["top"]) for r in rows.select(range_of("place").alias("range"), "place").groupBy("range").agg(F.max("place").alias("top")).collect())
    follow = [(top, after) for (_, top), (after, _) in zip(tops, [*tops[1:], tops[0]], strict=True)]
    ghosts = rows.join(F.broadcast(spark.createDataFrame(follow, "place long, range int")), "place").groupBy("doc_id", "place", "range").agg(F.min("text").alias("text"))
    both = placed.withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True)))
    return both.repartition("range").sortWithinPartitions("range", "ghost", F.desc("place"), "text")


def edited(docs: DataFrame, digest: Digest = xxhash.xxh3_128_hexdigest, sha: bool = False) -> DataFrame:
    """Every document beside its edited text, whose last third is the beginning of the next document (descending doc_id):
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (digests), near_edited, near_next (1 for equal forms, else 0).

    sha: with tm_sha, the SHA-256 of the document's form.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "tm_sha"][: 7 + sha]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double" + ", tm_sha string" * sha
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, []
        for batch in batches:
            for doc_id, text, rng, ghost in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text = text.as_py()
                form = canonical(text)
                mark = digest(form)
                if last is not None and last[0] == rng:
                    _, old_id, old, old_form, old_mark = last
                    third = len(old) // 3
                    new = old[: len(old) - third] + text[:third]
                    new_form = canonical(new)
                    row = (old_id, len(old), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), old_mark, digest(new_form), float(new_form == old_form), float(form == old_form))
                    out.append((*row, hashlib.sha256(old_form).hexdigest()) if sha else row)
                last = None if ghost else (rng, doc_id, text, form, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)], names=names)
                out = []

    return neighbours(docs).select("doc_id", "text", "range", "ghost").mapInArrow(compared, schema)


def edited_apart(docs: DataFrame, digest: Digest = xxhash.xxh3_128_hexdigest) -> DataFrame:
    """edited() with fingerprints that are equal only for equal forms."""
    found = tell_apart(docs, lambda sha: edited(docs, digest, sha), digest)
    same = F.col("near_edited") == 1
    return found.withColumn("edited_fingerprint", F.when(same, F.col("fingerprint")).otherwise(F.col("edited_fingerprint")))


def op6_canonical_digest(spark, sf_dir) -> DataFrame:
    return edited_apart(table(spark, sf_dir, "documents"))
