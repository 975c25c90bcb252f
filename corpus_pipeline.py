"""Documents to packed training sequences: five stages, each written as Parquet and read again as the next one's documents.

1. quality: documents that the Bradley-Terry score rejects go.
2. lines: boilerplate lines that spread over sites are taken out of the texts.
3. overlap: of documents that share five-word shingles (Jaccard 0.8 or more, through any chain) the first stays.
4. mixing: documents of rate 1 or more stay, those of wanted domains in copies, others thinned out, so that the domains' expected
   tokens meet the targets.
5. packing: token pieces with their places in sequences.

No stage can be expressed in SQL as a whole (learned scores, token ids), so ORACLE_SQL is None; the tests hold the stages against
brute force.

Defined cases: a null text is empty and kept by its score as any text; a null doc_id, repeated rows and ties are rows as any other
until the join, which keeps one row of each group of similar texts (blank texts are similar to nothing); a missing n_chars column
stays missing, a present one holds the length of the text as the line dedup left it; other columns travel along untouched up to the
packing, whatever their names; empty documents or labels give empty or unfiltered tables.

A stage's table goes when the next one is written, the last one when the JVM ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_spread, mixing, overlap_join, packing, quality
from tidemark.llm.common import drop, drop_at_exit, shared_dir, table

ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = quality.learned_labels(table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, quality.learn(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_spread.strip(docs).drop("tm_lines", "tm_removed")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return overlap_join.keep_one(docs)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs, mixing.rates(docs, mixing.labelled_domains(table(spark, sf_dir, "labels"))))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", mixing_to_targets),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        if k:
            drop(spark, f"{root}/{k - 1}")
    drop_at_exit(spark, root)
    return docs
