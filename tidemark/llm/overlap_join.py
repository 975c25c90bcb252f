"""Jaccard self-join on word shingles by T-occurrence search.

Two sets are similar only if they share T shingles or more. Candidates come from inverted lists: shingles are put in one global
order, common ones last, and of a set of n only the first n - T + 1 go to the lists (the prefix), as sets that share T must share
one of those. The lists are a shuffle by shingle and a sorted stream over each. A pair must also pass its size, the place of the
shared shingle, and a bound by the sets' counts in 64 hash buckets, which says little of long sets, so pairs of those must pass it
again with as many buckets as suit their sizes; all of these only drop pairs that cannot be similar.

Candidates are decided by DivideSkip (divide_skip.py) on whole sets: a list's leader is the query, the members that it is to be
compared with are the group searched. The inverted lists of the query's rarer shingles are merged by a heap that counts
occurrences, members below T less the number of long lists are skipped, and the lists of its common shingles are probed by binary
search; members that reach T are links.

Pairs within a group are never all made: first each member of a list is checked against the list's leader, the similar ones become
components, and only then, in lists whose members are of several components, pairs of different components are checked. Equal sets
are one node from the start. Lists longer than BLOCK are dealt as pairs of blocks.

The order of shingles comes from counts over all documents: tasks report what recurs among the documents they read, the sums name
the common ones. It is a hint of bounded size (COMMON); any order gives the same result.

Defined cases: a null or blank text has no shingle and links with nothing; a text of fewer words is one shingle; equal sets link;
rows of an equal doc_id are one node, linked with all that one of them links with; a null doc_id is left out; an empty table gives
an empty result; other columns are ignored by classes() and kept by keep_one(), which compares rows, whatever their doc_ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import divide_skip
from tidemark.llm.common import bit_of, bitmap_bits, components, cut, free_shuffles, held, id_bitmap, table

#: Common shingles that the order knows, at most; hashes that a task counts at once; members of a list compared at once;
#: members that are checked against one leader at once, and their shingles in all.
COMMON, COUNTED, BLOCK, FANOUT, HELD = 1 << 18, 1 << 21, 1024, 128, 1 << 20
#: Rows of a block that are held against the other block at once.
STRIP = 64
BUCKETS = 64
#: Sets of more than LONG shingles have fine counts, too: EACH shingles a bucket, at most.
EACH = 8
LONG = EACH * BUCKETS
#: So many pairs are broadcast to the sets (some 16 MB); more of them meet the sets in a shuffled join.
BROADCAST_PAIRS = 400_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


def shingles(text: str, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles: A-Z lower-cased, words between ASCII white space."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.int64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(w))], np.uint64).view(np.int64)
    h = np.zeros(len(w) - words + 1, np.uint64)
    for k in range(words):
        h = (h ^ w[k : len(w) - words + 1 + k]) * _ODD[k % len(_ODD)]
        h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


class Likeness:
    """Jaccard of num / den or more, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def probe(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def index(self, n: int) -> int:
        return n - -(-2 * self.num * n // (self.num + self.den)) + 1

    def overlap(self, sizes):  # noqa: ANN001, ANN201
        """The shingles that sets of so many in all must share."""
        return -(-self.num * sizes // (self.num + self.den))

    def possible(self, n1, p1, i1, n2, p2, i2):  # noqa: ANN001, ANN201
        """Whether sets of size n that share the shingle at place p (in the index prefix if i) can be similar."""
        small, large = np.minimum(n1, n2), np.maximum(n1, n2)
        indexed = np.where(n1 < n2, i1, np.where(n2 < n1, i2, i1 | i2))
        return indexed & (self.den * small >= self.num * large) & (1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1) >= self.overlap(n1 + n2))


def _common(docs: DataFrame, words: int) -> np.ndarray:
    """The hashes of common shingles, rarer first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n > 2]), pa.array(n[n > 2].astype(np.int64))], names=["s", "n"])

        parts, n = [], 0
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    parts.append(shingles(text.as_py(), words))
                    n += len(parts[-1])
                    if n >= COUNTED:
                        yield flush(parts)
                        parts, n = [], 0
        if parts:
            yield flush(parts)

    counts = docs.select(F.col("text").cast("string")).mapInArrow(counted, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    rows = counts.where("n >= 64").orderBy(F.desc("n"), "s").limit(COMMON).toPandas()
    return rows["s"].to_numpy(np.int64)[::-1].copy()


def _node(h: np.ndarray) -> int:
    """The 64-bit id of a set."""
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


def _ranks(h: np.ndarray, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of each shingle among the common ones, -1 for others; known: the common ones, sorted."""
    if not len(known):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, rank[at], -1)


def _counts(h: np.ndarray, buckets: int) -> bytes:
    """How many of a set's shingles are in each bucket, 255 at most."""
    return np.minimum(np.bincount((h & (buckets - 1)).astype(np.int64), minlength=buckets), 255).astype(np.uint8).tobytes()


def _prefixes(docs: DataFrame, words: int, like: Likeness, hint) -> DataFrame:  # noqa: ANN001
    """doc_id, n, node (the whole set's id), prefix, n_index (how many of it are in the index prefix), counts by bucket, fine ones of
    long sets."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = hint.value
        for batch in batches:
            ns, nodes, prefixes, indexed, sketches, fine = [], [], [], [], [], []
            for text in batch.column(1):
                h = shingles(text.as_py() or "", words)
                n = len(h)
                ns.append(n)
                nodes.append(_node(h) if n else None)
                sketches.append(_counts(h, BUCKETS))
                fine.append(_counts(h, 1 << ((n - 1) // EACH).bit_length()) if n > LONG else None)
                if n and len(known):
                    h = h[np.argsort(_ranks(h, known, rank), kind="stable")]
                prefixes.append(h[: like.probe(n)] if n else h)
                indexed.append(like.index(n) if n else 0)
            flat = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int32()), pa.array(nodes, pa.int64()), lists, pa.array(indexed, pa.int32()), pa.array(sketches, pa.binary()), pa.array(fine, pa.binary())], names=["doc_id", "n", "node", "prefix", "n_index", "sketch", "fine"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null").mapInArrow(made, "doc_id long, n int, node long, prefix array<long>, n_index int, sketch binary, fine binary")


def _postings(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """s, doc (the node), m (size, place and whether it is in the index prefix, in one number) of each node's prefix.

    Documents that aren't their node's first are left out by a bitmap of the first ones; one that slips through does no harm.
    """
    wide = bitmap_bits(nodes.count())
    bits = rows.sparkSession.sparkContext.broadcast(id_bitmap(nodes, "first", wide))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(held(bits.value, _column(batch, "place"))))
            lists = batch.column(batch.schema.get_field_index("prefix"))
            size = np.diff(lists.offsets.to_numpy())
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            n, node, index = (np.repeat(_column(batch, c), size) for c in ("n", "node", "n_index"))
            yield pa.RecordBatch.from_arrays([lists.flatten(), pa.array(node), pa.array(_packed(n.astype(np.int64), k, k < index))], names=["s", "doc", "m"])

    ready = rows.where("n > 0").select("node", "n", "n_index", "prefix", bit_of("doc_id", wide).alias("place"))
    return ready.mapInArrow(spread, "s long, doc long, m long")


def _packed(n: np.ndarray, p: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Place first, so that numbers sort by it; then size, then the index prefix."""
    return p << 32 | n << 1 | i


def _unpacked(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, p, i"""
    return m >> 1 & 0x7FFFFFFF, m >> 32, (m & 1).astype(bool)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _sketches(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(name)).to_pylist()), np.uint8).reshape(-1, BUCKETS)


def _bounded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """No fewer than two sets share, by their counts in buckets; a full bucket bounds nothing."""
    least = np.minimum(a, b).astype(np.int64)
    return np.where((least == 255).any(-1), 1 << 40, least.sum(-1))


def _shared(postings: DataFrame) -> DataFrame:
    """The postings of shingles that occur twice or more."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, paired = None, False  # the row before, and whether its shingle came up before it
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            s = _column(batch, "s")
            same = s[1:] == s[:-1]
            keep = np.append(same, False) | np.insert(same, 0, paired)
            last, paired = batch.slice(len(s) - 1), bool(keep[-1])
            yield batch.slice(0, len(s) - 1).filter(pa.array(keep[:-1]))
        if last is not None and paired:
            yield last

    return postings.repartition("s").sortWithinPartitions("s").mapInArrow(stream, postings.schema)


def _to_leaders(postings: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (a, b): a member of a list and its leader, the document in whose set the shingle stands foremost."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None  # the current list's leader
        for batch in batches:
            if not batch.num_rows:
                continue
            if lead is not None:
                batch = pa.Table.from_batches([lead, batch]).combine_chunks().to_batches()[0]
            s, doc = _column(batch, "s"), _column(batch, "doc")
            n, p, i = _unpacked(_column(batch, "m"))
            start = np.append(True, s[1:] != s[:-1])
            first = np.maximum.accumulate(np.where(start, np.arange(len(s)), 0))
            lead = batch.slice(int(first[-1]), 1)
            k = np.flatnonzero(~start)
            f = first[k]
            k, f = (x[like.possible(n[k], p[k], i[k], n[f], p[f], i[f]) & (doc[k] != doc[f])] for x in (k, f))
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(doc[f]), pa.array(doc[k]), pa.array(n[f]), pa.array(n[k])], names=["a", "b", "na", "nb"])

    return postings.repartition("s").sortWithinPartitions("s", "m", "doc").mapInArrow(stream, "a long, b long, na long, nb long").distinct()


def _plausible(pairs: DataFrame, sketches: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b, na, nb) whose counts in buckets let them be similar."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                good = _bounded(_sketches(batch, "sa"), _sketches(batch, "sb")) >= like.overlap(_column(batch, "na") + _column(batch, "nb"))
                yield batch.select(["a", "b"]).filter(pa.array(good))

    both = pairs.join(sketches.select(F.col("doc").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("doc").alias("b"), F.col("sketch").alias("sb")), "b")
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(bounded, "a long, b long")


def _finer(pairs: DataFrame, sizes: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) whose fine counts let them be similar; pairs of which a set isn't long stay. sizes: doc, n, fine of long sets.

    The counts of the larger set are folded to the buckets of the smaller one.
    """

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, fa, fb = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("na", "nb", "fa", "fb"))
            good = np.ones(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(fa, fb, strict=True)):
                if x is not None and y is not None:
                    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                    if max(x.max(), y.max()) < 255:  # a full bucket bounds nothing
                        x, y = (z.reshape(-1, min(len(x), len(y))).sum(0, dtype=np.int64) for z in (x, y))
                        good[k] = np.minimum(x, y).sum() >= like.overlap(na[k] + nb[k])
            yield batch.select(["a", "b"]).filter(pa.array(good))

    for c in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("doc").alias(c), F.col("n").alias("n" + c), F.col("fine").alias("f" + c)), c, "left")
    return pairs.select("a", "b", "na", "nb", "fa", "fb").mapInArrow(bounded, "a long, b long")


def _across(postings: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (a, b) of different roots in one list, or one pair of a long list's blocks; postings: x, y (blocks), block, root and the rest."""

    def pairs(rows: list[tuple[np.ndarray, ...]], x: int, y: int) -> tuple[np.ndarray, np.ndarray]:
        doc, n, p, i, root, block, sk = (np.concatenate(c) for c in zip(*rows, strict=True))
        left, right = (np.flatnonzero(block == z) for z in (x, y))
        out = []
        for at in range(0, len(left), STRIP):
            a, b = np.meshgrid(left[at : at + STRIP], right, indexing="ij")
            a, b = a.ravel(), b.ravel()
            fine = (root[a] != root[b]) & (doc[a] != doc[b])
            if x == y:
                fine &= a < b
            a, b = a[fine], b[fine]
            fine = like.possible(n[a], p[a], i[a], n[b], p[b], i[b])
            a, b = a[fine], b[fine]
            for at2 in range(0, len(a), 100_000):
                c, d = a[at2 : at2 + 100_000], b[at2 : at2 + 100_000]
                good = _bounded(sk[c], sk[d]) >= like.overlap(n[c] + n[d])
                out.append((doc[c[good]], doc[d[good]]))
        return tuple(np.concatenate(z) if out else np.empty(0, np.int64) for z in (zip(*out, strict=True) if out else ((), ())))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            s, x, y = (_column(batch, c) for c in ("s", "x", "y"))
            cols = [_column(batch, "doc"), *_unpacked(_column(batch, "m")), _column(batch, "root"), _column(batch, "block"), _sketches(batch, "sketch")]
            cuts = np.flatnonzero((s[1:] != s[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(s)], strict=True):
                here = (s[lo], x[lo], y[lo])
                if here != key:
                    if rows:
                        a, b = pairs(rows, key[1], key[2])
                        if len(a):
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
                    key, rows = here, []
                rows.append(tuple(c[lo:hi] for c in cols))
        if rows:
            a, b = pairs(rows, key[1], key[2])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return postings.repartition("s", "x", "y").sortWithinPartitions("s", "x", "y").mapInArrow(stream, "a long, b long").distinct()


def _similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, like: Likeness, hint) -> DataFrame:  # noqa: ANN001
    """The pairs (a, b) of nodes whose whole sets are similar, by DivideSkip: a's set is the query, its b's are searched.

    The sets are made anew from the texts of the nodes' first documents, which a bitmap picks.
    """
    pairs = cut(pairs)
    free_shuffles(docs.sparkSession)
    wanted = cut(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"))
    wide = bitmap_bits(wanted.count())
    bits = docs.sparkSession.sparkContext.broadcast(id_bitmap(wanted, "first", wide))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.flatnonzero(held(bits.value, _column(batch, "place")))
            found = [h for k in rows if len(h := shingles(batch.column(0)[int(k)].as_py() or "", words))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([_node(h) for h in found], pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())], names=["id", "s"])

    texts = docs.where("doc_id is not null").select(F.col("text").cast("string"), bit_of(F.col("doc_id").cast("long"), wide).alias("place"))
    known = texts.mapInArrow(sets, "id long, s binary")
    # a leader's set goes once to each group of FANOUT members
    groups = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / FANOUT).cast("int").alias("groups"))
    tasks = pairs.join(groups, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("g"))
    heads = groups.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(None).cast("long").alias("b"))
    wants = tasks.select(F.col("b").alias("id"), "a", "g", "b").union(heads)
    # few enough pairs go to the sets; of more the sets go to the pairs
    sent = known.join(F.broadcast(wants) if pairs.count() <= BROADCAST_PAIRS else wants, "id").select("a", "g", "b", "s")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = hint.value
        key, query, ids, members, size = None, None, [], [], 0

        def links() -> pa.RecordBatch:
            least = like.overlap(len(query) + np.array([len(m) for m in members]))
            found = divide_skip.search(query, _ranks(query, *common), members, least) if members else []
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found), pa.int64()), pa.array([ids[k] for k, _ in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, g, b, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                s = np.frombuffer(s.as_py(), np.int64)
                if b is None:  # a group's query comes first
                    if members:
                        yield links()
                    key, query, ids, members, size = (a, g), s, [], [], 0
                elif key == (a, g):
                    ids.append(b)
                    members.append(s)
                    size += len(s)
                    if size >= HELD:
                        yield links()
                        ids, members, size = [], [], 0
        if members:
            yield links()

    return sent.repartition("a", "g").sortWithinPartitions("a", "g", F.col("b").asc_nulls_first()).mapInArrow(searched, "a long, b long")


def classes(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that similar sets lead to) of every row of docs."""
    like = Likeness(num, den)
    common = _common(docs, words)
    order = np.argsort(common, kind="stable")
    hint = docs.sparkSession.sparkContext.broadcast((common[order], order))
    rows = cut(_prefixes(docs, words, like, hint))
    # equal sets are one node
    nodes = cut(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first")))
    sketches = rows.where("n > 0").groupBy(F.col("node").alias("doc")).agg(F.min("sketch").alias("sketch"))
    long = rows.where("fine is not null").groupBy(F.col("node").alias("doc")).agg(F.min("n").alias("n"), F.min("fine").alias("fine"))
    lists = cut(_shared(_postings(rows, nodes)))
    free_shuffles(docs.sparkSession)
    links = cut(_similar(docs, nodes, _finer(_plausible(_to_leaders(lists, like), sketches, like), long, like), words, like, hint))
    free_shuffles(docs.sparkSession)
    roots = components(links)
    rooted = cut(lists.join(roots.select(F.col("id").alias("doc"), "root"), "doc", "left").withColumn("root", F.coalesce("root", "doc")))
    mixed = rooted.groupBy("s").agg(F.count("*").alias("n"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2 and n > 2")
    mixed = mixed.select("s", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = rooted.join(mixed, "s").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("blocks", "other")
    more = cut(_similar(docs, nodes, _finer(_across(dealt.join(sketches, "doc"), like), long, like), words, like, hint))
    free_shuffles(docs.sparkSession)
    # rows of an equal doc_id are one
    several = rows.where("n > 0").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    same = rows.where("n > 0").join(several, "doc_id").select("a", F.col("node").alias("b"))
    roots = components(links.union(more).union(same))
    rooted = nodes.join(roots, F.col("node") == F.col("id"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    found = rows.select("doc_id", "n", "node").join(rooted.join(least, "root").select("node", "component"), "node", "left")
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs, in all their columns: of each component of similar rows the one of the smallest doc_id, null ones last.

    Where whole-number doc_ids are all there and all different they name the rows, and no text is written; else the rows are written
    with numbers of their own, so repeated and null doc_ids are rows as any other. The ids that go are counted as a table first, so
    few of them are broadcast and many meet the rows in a shuffled join.
    """
    if docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
            found = classes(docs, words, num, den)
            gone = cut(found.where("doc_id <> component_id").select(F.col("doc_id").alias("tm_gone")))
            return docs.join(gone, docs["doc_id"] == gone["tm_gone"], "left_anti")
    row = "tm_row"
    while row in docs.columns:
        row += "_"
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    found = cut(classes(numbered.select(F.col(row).alias("doc_id"), "text"), words, num, den).select(F.col("doc_id").alias(row), "component_id"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    kept = found.join(numbered.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(place)["row"].alias(row)).select(row)
    gone = cut(found.select(row).join(kept, row, "left_anti"))
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def op10_divide_skip(spark, sf_dir) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), 3, 90, 100)
