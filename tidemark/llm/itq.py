"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Rotations learned by iterative quantisation (principal axes, then alternately the nearest binary codes and the rotation that fits
them best) turn unit vectors into balanced binary codes; each rotation starts from another random one. The codes are cut into
substrings, one hash table each, and vectors that agree in a whole substring are candidates. A substring has EXTRA bits more than
the logarithm of the number of vectors, so chance brings few vectors together however many there are, and there are so many tables
that RECALL of the pairs at the very threshold meet in one: this is measured on pairs made from the learning sample, whatever its
dimensions, and rotations are added until it holds. A bit differs with probability 0.1 at a cosine of 0.95, so the tables, and with
them the work, grow with n ** 0.15 beside n.

Only keys and codes go to the tables at first. There a pair counts in the first table that holds it, and must be near by the
Hamming distance of the whole codes, by a bound from the same sample. Vectors follow only the members of such pairs, and their
cosine in double precision decides. A bucket hands on link counts and stars of its connected parts, never its pairs. Buckets over
BLOCK members are dealt as pairs of blocks, so no task holds more than two blocks; nothing is capped. Equal vectors are one, with
a multiplicity.

The rotations are learned from a bounded sample: the SAMPLE vectors with the smallest hashes of their ids. All vectors are indexed.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components links with nothing; vectors of different
lengths don't link; rows of an equal vec_id are one vector, the least; a null vec_id is left out; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bit_of, bitmap_bits, components, cut, held, id_bitmap, table

SAMPLE, EXTRA, RECALL, MOST_ROTATIONS, BLOCK, SMALL = 8192, 2, 0.97, 64, 1024, 48
#: Copies of a vector beyond which its few keys are broadcast to the members: at most one key for each HOT rows.
HOT = 10_000
_CHUNK = 100_000


def learn_rotation(x: np.ndarray, seed: int, steps: int = 25) -> np.ndarray:
    """A projection (dimensions, bits) that balances binary codes of centred vectors."""
    bits = min(x.shape[1], 64)
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :bits]
    v = x @ axes
    r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    for _ in range(steps):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return axes @ r


def substrings(u: np.ndarray, mean: np.ndarray, projection: np.ndarray, width: int) -> np.ndarray:
    """The codes' substrings: an unsigned number of `width` bits for each vector and table."""
    code = (u - mean) @ projection >= 0
    tables = code.shape[1] // width
    parts = code[:, : tables * width].reshape(len(u), tables, width)
    return (parts * (1 << np.arange(width, dtype=np.uint64))).sum(2, dtype=np.uint64).astype(np.uint32)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def tables_for(x: np.ndarray, n: int, least: float) -> tuple[np.ndarray, np.ndarray, int, int]:
    """mean, projection, width of a substring, and the Hamming distance of near pairs at most; x: sampled unit vectors of n.

    One in four of them is left out of the learning, so that the recall is that of vectors which the rotations don't know.
    """
    learned, x = (np.delete(x, np.s_[::4], 0), x[::4]) if len(x) >= 8 else (x, x)
    mean = learned.mean(0)
    width = min(32, max(4, math.ceil(math.log2(max(n, 2))) + EXTRA))
    rng = np.random.default_rng(0)
    a = x[rng.integers(0, len(x), 4096)]
    aside = rng.standard_normal(a.shape)
    aside -= (aside * a).sum(1, keepdims=True) * a
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
    b = least * a + math.sqrt(max(0.0, 1 - least * least)) * aside  # pairs at the threshold
    rotations: list[np.ndarray] = []
    while True:
        rotations.append(learn_rotation(learned - mean, len(rotations)))
        projection = np.hstack(rotations)
        if projection.shape[1] < width:
            continue
        ka, kb = (substrings(z, mean, projection, width) for z in (a, b))
        if (ka == kb).any(1).mean() >= RECALL or width == 1:
            apart = distances(ka, kb)
            return mean, projection, width, int(math.ceil(apart.mean() + 6 * apart.std()))
        if len(rotations) >= MOST_ROTATIONS:  # shorter substrings hold more pairs
            width, rotations = max(1, width - 4), rotations[:1]


def _stars(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each place the smallest id that links (a, b) lead to."""
    low = ids.copy()
    while len(a):
        least = np.minimum(low[a], low[b])
        if (least == low[a]).all() and (least == low[b]).all():
            break
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
    return low


def _key(t: np.ndarray, k: np.ndarray) -> np.ndarray:
    """One number for a table and a substring, different for different ones."""
    return (t.astype(np.int64) << 32) | k.astype(np.int64)


def _members(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], arrays: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Whole buckets, many at once: numbers by name, and packed arrays (uint32 keys, double u) as matrices."""

    def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names}
        for c in arrays:
            raw = b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist())
            out[c] = np.frombuffer(raw, np.float64 if c == "u" else np.uint32).reshape(batch.num_rows, -1)
        return out

    waiting = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if waiting is not None:
            batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
        last = int(_starts({c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("h", "x", "y")})[-1])
        if last:
            yield columns(batch.slice(0, last))
        waiting = batch.slice(last)
    if waiting is not None:
        yield columns(waiting)


def _starts(cols: dict[str, np.ndarray]) -> np.ndarray:
    change = np.zeros(len(cols["h"]), bool)
    change[:1] = True
    for c in ("h", "x", "y"):
        change[1:] |= cols[c][1:] != cols[c][:-1]
    return np.flatnonzero(change)


def _first_pairs(cols: dict[str, np.ndarray], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within a bucket, or between two of its blocks, that no earlier table holds and whose codes are near.

    Small buckets are taken all at once, neighbour by neighbour; large ones in strips.
    """
    starts, keys, table_of = _starts(cols), cols["keys"], (cols["h"] >> 32).astype(np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    group, one = np.repeat(np.arange(len(sizes)), sizes), cols["x"] == cols["y"]

    def near(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(a), _CHUNK):
            c, d = a[at : at + _CHUNK], b[at : at + _CHUNK]
            same = keys[c] == keys[d]
            fine = (same.argmax(1) == table_of[c]) & (distances(keys[c], keys[d]) <= most)
            if fine.any():
                yield c[fine], d[fine]

    small = sizes[group] <= SMALL
    for step in range(1, min(SMALL, int(sizes.max(initial=0)))):
        a = np.flatnonzero((group[step:] == group[:-step]) & small[:-step])
        yield from near(*(z[one[a] | (cols["block"][a] != cols["block"][a + step])] for z in (a, a + step)))
    for at, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        rows = np.arange(at, at + n)
        left, right = (rows[cols["block"][rows] == cols[z][at]] for z in ("x", "y"))
        for k in range(0, len(left), 128):
            part = left[k : k + 128]
            free = part[:, None] < right[None, :] if one[at] else np.ones((len(part), len(right)), bool)
            for t in range(table_of[at]):
                free &= keys[part, t][:, None] != keys[right, t][None, :]
            i, j = np.nonzero(free)
            yield from near(part[i], right[j])


def links(vectors: DataFrame, least: float) -> DataFrame:
    """vec_id, links, root: what each bucket found; vectors: vec_id, v (one length), m (how many vectors it stands for)."""
    context, n = vectors.sparkSession.sparkContext, vectors.count()
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
    mean, projection, width, most = tables_for(_unit(np.array(sample.tolist(), np.float64)), n, least)
    tables = projection.shape[1] // width

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                keys = substrings(_vectors(batch.column(1)), mean, projection, width)
                yield batch, keys, _key(np.arange(tables)[None, :], keys)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, h in coded(batches):
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel())], names=["h"])

    plain = vectors.select("vec_id", "v")
    buckets = cut(plain.mapInArrow(keyed, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    wide = bitmap_bits(buckets.count())
    shared = context.broadcast(id_bitmap(buckets, "h", wide))
    large = cut(buckets.where(F.col("n") > BLOCK).select("h", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the bitmap asks for Spark's hash of the key, so it comes as a column
            keep = pa.array(held(shared.value, batch.column(3).to_numpy()))
            yield batch.select([0, 1, 2]).filter(keep)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, keys, h in coded(batches):
            rows = np.repeat(np.arange(len(keys)), tables)
            packed = pa.array([k.tobytes() for k in keys], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel()), batch.column(0).take(pa.array(rows)), packed.take(pa.array(rows))], names=["h", "id", "keys"])

    entries = plain.mapInArrow(listed, "h long, id long, keys binary").select("h", "id", "keys", bit_of("h", wide).alias("place"))
    entries = entries.mapInArrow(entered, "h long, id long, keys binary")
    dealt = entries.join(large, "h", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.lit(0)))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    dealt = dealt.select("h", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "keys")

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _members(batches, ("h", "x", "y", "block", "id"), ("keys",)):
            wanted = np.zeros(len(cols["h"]), bool)
            for a, b in _first_pairs(cols, most):
                wanted[a] = wanted[b] = True
            if wanted.any():
                yield pa.RecordBatch.from_arrays([*(pa.array(cols[c][wanted]) for c in ("h", "x", "y", "block", "id")), pa.array([k.tobytes() for k in cols["keys"][wanted]], pa.binary())], names=["h", "x", "y", "block", "id", "keys"])

    order = ["h", "x", "y"]
    near = dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(plausible, "h long, x int, y int, block int, id long, keys binary")
    there = cut(near).join(vectors.select(F.col("vec_id").alias("id"), "v", "m"), "id").select(*order, "block", "id", "m", "keys", "v")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u = pa.array([r.tobytes() for r in _vectors(batch.column(7))], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:7], u], names=[*batch.schema.names[:7], "u"])

    def reranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _members(batches, ("h", "x", "y", "block", "id", "m"), ("keys", "u")):
            found, u = [], cols["u"]
            for a, b in _first_pairs(cols, most):
                good = np.einsum("ij,ij->i", u[a], u[b]) >= least
                found.append((a[good], b[good]))
            a, b = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
            if len(a):
                count = np.bincount(a, cols["m"][b], len(u)) + np.bincount(b, cols["m"][a], len(u))
                touched = np.unique(np.concatenate([a, b]))
                yield pa.RecordBatch.from_arrays([pa.array(cols["id"][touched]), pa.array(count[touched].astype(np.int64)), pa.array(_stars(a, b, cols["id"])[touched])], names=["vec_id", "links", "root"])

    there = there.repartition(*order).sortWithinPartitions(*order).mapInArrow(measured, "h long, x int, y int, block int, id long, m long, keys binary, u binary")
    return there.mapInArrow(reranked, "vec_id long, links long, root long")


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _vectors(column: pa.Array) -> np.ndarray:
    """Unit vectors of a column of lists of one length."""
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def near_vectors(embeddings: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vec_id; embeddings: vec_id, embedding."""
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").alias("v")).where("vec_id is not null")
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    fine = F.coalesce(F.col("v").isNotNull() & ~odd & F.exists("v", lambda c: c != 0), F.lit(False))
    # a vector's key: 128 bits; odd vectors have none
    rows = cut(rows.select("vec_id", "v", F.when(fine, F.size("v")).alias("d"), F.when(fine, F.xxhash64("v")).alias("h1"), F.when(fine, F.xxhash64(F.lit("v"), "v")).alias("h2")))
    same = cut(rows.where("d is not null").groupBy("d", "h1", "h2").agg(F.min("vec_id").alias("one"), F.count("*").alias("m")))
    found = None
    for r in sorted(same.groupBy("d").agg(F.count("*").alias("n")).where("n > 1").collect()):
        ones = same.where(F.col("d") == r["d"]).select(F.col("one").alias("vec_id"), "m")
        part = cut(links(cut(rows.where(F.col("d") == r["d"]).select("vec_id", "v").join(ones, "vec_id")), least))
        found = part if found is None else found.union(part)
    of_ones = same.select("d", "h1", "h2", "m", F.col("one").alias("vec_id"))
    if found is None:
        known = of_ones.withColumn("n", F.lit(0).cast("long")).withColumn("root", F.col("vec_id"))
    else:
        counts = found.groupBy("vec_id").agg(F.sum("links").alias("n"))
        roots = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("vec_id"), "root")
        known = of_ones.join(counts, "vec_id", "left").join(roots, "vec_id", "left")
    known = cut(known.select("d", "h1", "h2", "m", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("root")))
    # every copy has its vector's links; a vector of very many copies goes to them, as its key would meet them in one task
    key, ids = ["d", "h1", "h2"], rows.select("vec_id", "d", "h1", "h2")
    hot = known.where(F.col("m") > HOT).select(*key, F.col("n_links").alias("hot_links"), F.col("root").alias("hot_root"))
    marked = ids.join(F.broadcast(hot), key, "left")
    there = marked.where("hot_root is null").join(known.where(F.col("m") <= HOT).select(*key, "n_links", "root"), key, "left").select("vec_id", "n_links", "root")
    there = there.union(marked.where("hot_root is not null").select("vec_id", "hot_links", "hot_root"))
    root = F.coalesce("root", "vec_id")
    return there.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), (F.col("vec_id") == root).alias("kept"))


def op7_itq_hamming(spark, sf_dir) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
