"""What the training-data operators share: tables, lineage cuts, id bitmaps, connected components."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The least and the largest size of an id bitmap, as powers of two of bits: 128 KB and 32 MB.
LEAST_BITS, MOST_BITS = 20, 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one only where it is unset and all
    runs on one machine (tests). On a cluster without it there is no folder that all machines see: an error."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    files, where = _path(spark, path)
    files.delete(where, True)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system when the JVM ends."""
    files, where = _path(spark, path)
    files.deleteOnExit(where)


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later jobs start here, also after an executor is lost.

    The files go when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets the files of shuffles that nothing refers to any more go now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bitmap_bits(n: int) -> int:
    """The size of a bitmap of n ids: 16 bits an id, so one in 16 of the other ids gets through, up to MOST_BITS."""
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * n + 1))))


def bit_of(column, bits: int):
    """The place, from 1, of a column's value in an id bitmap; null has a place, too."""
    return (F.pmod(F.xxhash64(column), F.lit(1 << bits)) + 1).cast("long")


def id_bitmap(df: DataFrame, column: str, bits: int) -> bytes:
    """A bitmap of 2**bits bits in which every value of a column has its bit_of() set.

    It may hold more than those values, so it only thins out what a join or a comparison then decides.
    """
    place = df.select(bit_of(column, bits).alias("p"))
    parts = place.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    out, size = bytearray((1 << bits) // 8), 4096
    for part in parts:
        out[(part["b"] - 1) * size : part["b"] * size] = part["m"]
    return bytes(out)


def held(bitmap: bytes, place: np.ndarray) -> np.ndarray:
    """Which places, from 1, a bitmap holds."""
    at = np.asarray(place, np.int64) - 1
    return (np.frombuffer(bitmap, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each id of edges (a, b) reaches; edges of null ids and loops count for nothing.

    Alternating large stars and small stars: a round keeps at most one edge per edge, so no group's pairs are ever made, and
    the rounds grow with the logarithm of the longest path. Each round is written out.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        sums = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if sums["n"] == 0 or (sums["n"], sums["h"]) == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        before = (sums["n"], sums["h"])
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        e = cut(small.distinct())
