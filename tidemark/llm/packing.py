"""Best-fit packing from the histogram of lengths.

Documents become token ids and pieces of at most `size` tokens. The lengths' histogram has at most `size` rows, whatever the
number of documents, so best-fit decreasing runs over counts on the driver; the plan gives each length a few intervals of
ranks, each with its sequences and offsets, and the pieces take their places by joining on the rank within their length.
Ranks need no sort: a task numbers its pieces of each length, and the tasks' counts give the offsets.

Defined cases: a null or empty text is one piece of the closing id alone; repeated documents are packed as often as they
occur; an empty table gives an empty result; a null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table
from tidemark.llm.word_bpe import WordBpe

SIZE = 2048
CLOSING = b"\0\0\0\0"
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("rank", pa.int64())])
_PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
_bpe: dict[str, WordBpe] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and its rank among its task's pieces of that length.

    tokenizer: the path of the vocabulary file, as each machine sees it.
    """

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer or default_tokenizer()
        bpe = _bpe.get(path) or _bpe.setdefault(path, WordBpe(path))
        task, seen = TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = bpe.encode(text.as_py() or "") + CLOSING
                for k, at in enumerate(range(0, len(data), 4 * size)):
                    part = data[at : at + 4 * size]
                    n = len(part) // 4
                    out.append((doc_id, k, at // 4, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _PIECE, strict=True)], schema=_PIECE)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tokenised, _PIECE_DDL)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, rank after the last, sequences, first sequence, offset).

    Rank r of a row stands in sequence first + (r - lo) % sequences, at offset + length * ((r - lo) // sequences).
    A group holds equal sequences; a length splits at most one group of each free space, so the rows are bounded by the size.
    """
    groups: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by free space: (first sequence, how many)
    made, out = 0, []
    for length in sorted(counts, reverse=True):
        left, rank, free = counts[length], 0, length
        while left:
            while free <= size and not groups[free]:
                free += 1
            if free > size:
                space, each = size, size // length
                first, n = made, -(-left // each)
                made += n
            else:
                space, each = free, free // length
                first, n = groups[free].pop()
            full = min(n, left // each)
            if full:
                out.append((length, rank, rank + full * each, full, first, size - space))
                groups[space - each * length].append((first, full))
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # under `each` documents are left: they share one sequence
                out.append((length, rank, rank + left, 1, first + full, size - space))
                groups[space - left * length].append((first + full, 1))
                rank, left, full = rank + left, 0, full + 1
            if full < n:
                groups[space].append((first + full, n - full))
    return out


def pack(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    parts = cut(pieces(docs, size, tokenizer))
    per_task = parts.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    before = per_task.selectExpr("length", "task", "sum(n) over (partition by length order by task) - n as before")
    # at most a few rows for each length: broadcast
    slots = spark.createDataFrame(plan(counts, size), "length long, lo long, hi long, n long, first long, at long")
    placed = parts.join(before, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = placed.join(F.broadcast(slots), "length").where("rank >= lo and rank < hi")
    return placed.selectExpr("doc_id", "piece", "start", "length", "ids_crc32", "first + (rank - lo) % n as sequence_id", "at + length * ((rank - lo) div n) as offset")


def op9_best_fit_packing(spark, sf_dir) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
