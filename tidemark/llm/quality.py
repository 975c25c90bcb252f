"""Quality by Bradley-Terry: a document's score is learned from preference pairs.

Every pair sets a document of label 1 above one of label 0; the logistic loss of the pairs' feature differences gives the
weights, so a score needs no intercept. The cut is a quantile of the training scores: the share of label 0 among them. Features
count letters, marks, words and repeats over the whole text; ids, sources, languages and labels are no features.

Labels are learned from a bounded sample: `max_rows` labelled documents with the smallest hashes of their ids, the only rows
that reach the driver, as features. Every document is scored.

Defined cases: a null text is empty, and an empty text has the features of nothing; a null label counts for nothing; of repeated
labels of a document the smallest counts; repeated documents are scored each; without labels of both kinds every score is 0.5
(kept); empty tables give an empty result; other columns are ignored by the score and kept by the filter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Labelled documents that the model learns from, and pairs drawn from them, at most.
MAX_ROWS, MAX_PAIRS = 6000, 60_000
_SENTENCE, _MARKS, _BARS = b".,;:?'\"-()", b"$%&*#@^~+=<>{}[]\\/_`", b"|!"
_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def features(text: str) -> list[float]:
    """Shares of characters and words, all bounded, and the logarithm of the length."""
    data = text.encode("utf-8", "replace")
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if n else np.zeros(256, np.int64)
    share = lambda chars: float(sum(counts[b] for b in chars)) / max(n, 1)
    upper, lower, digits = (float(counts[a : b + 1].sum()) / max(n, 1) for a, b in ((65, 90), (97, 122), (48, 57)))
    words = text.split()
    w = max(len(words), 1)
    kinds = len(set(words))
    pairs = list(zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x]
    ends = sum(1 for x in words if x[-1] in ".!?")
    return [
        upper, lower, digits, share(_SENTENCE), share(_MARKS), share(_BARS), share(b"\n"), share(b" \t"), float(counts[128:].sum()) / max(n, 1),
        share(b"$"), share(b"&"), share(b"*"), share(b"#"), share(b"%"), share(b"|"), share(b"!"),
        min(math.sqrt(share(_MARKS)), 0.5), min(math.sqrt(share(_BARS)), 0.5),
        min(n / w, 40) / 40, kinds / w, len(set(pairs)) / max(len(pairs), 1), sum(1 for a, b in pairs if a == b) / max(len(pairs), 1),
        ends / w, sum(1 for x in words if len(x) <= 3) / w, sum(1 for x in words if x.isupper() and len(x) > 1) / w,
        sum(1 for x in words if not x[0].isalnum() or not x[-1].isalnum() and x[-1] not in ".,;:?!'\")") / w,
        len(set(lines)) / max(len(lines), 1), min(len(lines) / w, 1), math.log1p(w) / 10, float(not words),
    ]


@dataclass(frozen=True)
class BradleyTerry:
    """Scores: sigmoid of the weighted, standardised features less the cut."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        s = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights - self.cut
        return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, max_pairs: int = MAX_PAIRS, ridge: float = 2.0, steps: int = 30) -> BradleyTerry | None:
    """Newton's method on the mean logistic loss of preference pairs; None without labels of both kinds."""
    better, worse = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(better) or not len(worse):
        return None
    mean, scale = x.mean(0), x.std(0)
    z = np.clip((x - mean) / np.where(scale > 1e-9, scale, 1), -6, 6)
    rng = np.random.default_rng(0)
    n = min(max_pairs, len(better) * len(worse), 40 * max(len(better), len(worse)))
    d = z[better[rng.permutation(n) % len(better)]] - z[worse[rng.integers(0, len(worse), n)]]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -500, 500)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), d.T @ (1 - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    return BradleyTerry(mean, np.where(scale > 1e-9, scale, 1), w, float(np.quantile(s, len(worse) / (len(worse) + len(better)), method="midpoint")))


def _sampled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """doc_id, y, text of the documents whose labels are learned; labels: doc_id, y."""
    known = labels.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # the bound of what is broadcast
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> BradleyTerry | None:
    """Fits the weights to labels (doc_id, y: 1 or 0)."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["y", "x"])

    sample = _sampled(docs, labels, max_rows).select(F.col("y").cast("int"), F.col("text").cast("string"))
    rows = sorted(sample.mapInArrow(measured, "y int, x array<double>").collect())
    return fit(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])) if rows else None


def score(docs: DataFrame, model: BradleyTerry | None) -> DataFrame:
    """doc_id and score of every row of docs."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([features(t.as_py() or "") for t in batch.column(1)])
                s = np.full(len(x), 0.5) if model is None else model.scores(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], schema=_OUT)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scored, "doc_id long, score double")


def held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def learned_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out(3, 1)).select(F.col("doc_id").cast("long"), F.col("quality").alias("y"))


def keep_good(docs: DataFrame, model: BradleyTerry | None) -> DataFrame:
    """The rows of docs, in all their columns, whose text scores 0.5 or more."""

    @F.pandas_udf("double")
    def quality(texts):  # noqa: ANN001, ANN202
        x = np.array([features(t or "") for t in texts]).reshape(len(texts), -1)
        import pandas as pd

        return pd.Series(np.full(len(x), 0.5) if model is None or not len(x) else model.scores(x))

    return docs.where(quality(F.col("text").cast("string")) >= 0.5)


def op1_bradley_terry(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, learned_labels(table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
