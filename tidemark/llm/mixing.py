"""Mixing to target weights by soft membership.

A table of labelled documents teaches a naive Bayes classifier of the presence of word beginnings and of shape (marks, capitals,
repeats), and every document gets a posterior over the domains. A document's rate is how often it is to be taken on average.
Projected gradient steps fit rates of 0 or more so that the expected tokens of each domain (sum of rate * tokens * posterior)
meet the targets in least squares. A step needs one sum per domain over all documents, and the rates are a function of the
posteriors and those few sums, so no rate travels. Only DataFrame functions are used.

The classifier learns from a bounded sample: `max_rows` labelled documents with the smallest hashes of their ids; its model has
at most `max_tokens` rows, which is what is broadcast. Posteriors, totals and rates cover every document.

Defined cases: a null text is empty, with no tokens; a null doc_id has a posterior as any other; equal rows (doc_id and text)
share a row of rates(), which counts them; a domain that no document can belong to is left out of the fit; without labels or
documents of known label the posteriors are even; empty tables give an empty result; other columns are ignored by rates() and
kept by take().
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table

MAX_ROWS, MAX_TOKENS, STEPS = 6000, 600, 25
#: Letters that a word's stem has at most: endings say little of a domain. Every word of a text counts.
STEM = 5
#: Of the labels' domains: good text, toxic text, and text of low quality.
TARGETS = {"clean": 0.97, "toxic": 0.02, "junk": 0.01}
_MARKS = r"[$%&*#@|!^~+=<>{}\[\]\\/_`]+"
_CAPITALS = "[A-Z]+"
_BASE = "\n"  # the token that every document has


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[ \n\t\r]+"), "")


def _tokens(texts: DataFrame) -> DataFrame:
    """A row per token of a text, with its n_tokens, in place of text: the distinct stems of its words, and tokens of its shape."""
    text, n, kinds = F.col("text"), F.greatest("n_tokens", F.lit(1)), F.col("tm_kinds")
    split = texts.withColumns({"n_tokens": F.size(_words(text)).cast("long"), "tm_kinds": F.array_distinct(_words(text))})
    left = lambda chars: F.octet_length(text) - F.octet_length(F.regexp_replace(text, chars, ""))
    level = lambda name, share: F.concat(F.lit(name + "\n"), F.floor(F.least(share, F.lit(1.0)) * 10).cast("string"))
    shape = F.array(
        F.lit(_BASE), level("marks", left(_MARKS) / n), level("capitals", left(_CAPITALS) / F.greatest(F.length(text), F.lit(1))),
        level("kinds", F.size(kinds) / n),
    )
    stems = F.array_distinct(F.transform(kinds, lambda w: F.lower(w.substr(1, STEM))))
    kept = [c for c in texts.columns if c != "text"]
    return split.select(*kept, "n_tokens", F.explode(F.concat(shape, stems)).alias("token"))


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], max_rows: int = MAX_ROWS, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """token and one log weight per domain (w_0, w_1, ...); labelled: doc_id, domain.

    The base token's row carries the priors and what the absence of all other tokens says.
    """
    known = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # the bound of what is broadcast
    sample = docs.join(F.broadcast(known), "doc_id").select("domain", _text(docs).alias("text")).distinct()
    sample = _tokens(sample)
    counts = cut(sample.groupBy("token").agg(*(F.count_if(F.col("domain") == d).alias(f"n_{k}") for k, d in enumerate(domains))))
    base = counts.where(F.col("token") == _BASE).first()
    totals = [base[f"n_{k}"] if base else 0 for k in range(len(domains))]
    everything = max(sum(totals), 1)
    share = [(F.col(f"n_{k}") + 0.5) / (n + 1.0) for k, n in enumerate(totals)]
    gains = []
    for k, n in enumerate(totals):
        rest = (sum(F.col(f"n_{j}") for j in range(len(domains)) if j != k) + 0.5) / (everything - n + 1.0)
        gains.append(F.when((F.col(f"n_{k}") >= 3) & (share[k] >= 3 * rest), F.col(f"n_{k}") * F.log(share[k] / rest)).otherwise(0.0))
    rows = counts.where(F.col("token") != _BASE)
    picked = None
    for gain in gains:
        best = rows.withColumn("gain", gain).where("gain > 8").orderBy(F.desc("gain"), "token").limit(max_tokens // len(domains)).drop("gain")
        picked = best if picked is None else picked.union(best)
    picked = cut(picked.distinct().select("token", *(s.alias(f"s_{k}") for k, s in enumerate(share))))
    absent = picked.agg(*(F.coalesce(F.sum(F.log(1 - F.col(f"s_{k}"))), F.lit(0.0)).alias(f"w_{k}") for k in range(len(domains)))).select(
        F.lit(_BASE).alias("token"), *(F.col(f"w_{k}") + F.log(F.lit((n + 0.5) / (everything + 0.5 * len(totals)))) for k, n in enumerate(totals))
    )
    return picked.select("token", *(F.log(F.col(f"s_{k}") / (1 - F.col(f"s_{k}"))).alias(f"w_{k}") for k in range(len(domains)))).union(absent)


def posteriors(docs: DataFrame, model: DataFrame, domains: list[str]) -> DataFrame:
    """doc_id, text_hash, n_rows, n_tokens and p_<domain> of each document (rows of equal doc_id and text together)."""
    rows = _tokens(docs.select("doc_id", _text(docs).alias("text")).withColumn("text_hash", F.xxhash64("text")))
    sums = rows.join(F.broadcast(model), "token").groupBy("doc_id", "text_hash").agg(
        F.max("n_tokens").alias("n_tokens"), F.count_if(F.col("token") == _BASE).alias("n_rows"), *(F.sum(f"w_{k}").alias(f"w_{k}") for k in range(len(domains)))
    )
    top = F.greatest(*(F.col(f"w_{k}") for k in range(len(domains))))
    odds = [F.exp((F.col(f"w_{k}") - top) / F.col("n_rows")) for k in range(len(domains))]
    return sums.select("doc_id", "text_hash", "n_rows", "n_tokens", *((o / sum(odds[1:], odds[0])).alias(f"p_{d}") for o, d in zip(odds, domains, strict=True)))


def fit_rates(soft: DataFrame, targets: dict[str, float], budget: float | None = None, steps: int = STEPS, close: float = 1e-3) -> Column:
    """The rate of a row of posteriors(), as an expression of its p_<domain>.

    budget: tokens in all, by default as many as there are. Rates start at 1; a step moves each by the posterior mean of the
    domains' relative errors, which no step size of 1 or less makes overshoot, and sets it to 0 at least. If the domains' tokens
    aren't `close` to their targets after `steps`, a warning says how far they are off.
    """
    names = list(targets)
    mass = lambda rate: [F.sum(rate * F.col("n_rows") * F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in names]
    first = soft.agg(*mass(F.lit(1.0)), F.sum(F.col("n_rows") * F.col("n_tokens")).alias("all")).first()
    total = float(budget if budget is not None else first["all"] or 0)
    there = {d: first[d] for d in names if first[d]}
    weight = sum(targets[d] for d in there) or 1.0
    rate, now = F.lit(1.0), first
    for _ in range(steps):
        error = {d: (now[d] - total * targets[d] / weight) / there[d] for d in there}
        if not error or all(abs(e) < close * max(targets[d] * total / weight / there[d], close) for d, e in error.items()):
            break
        rate = F.greatest(F.lit(0.0), rate - sum((F.lit(e) * F.col(f"p_{d}") for d, e in error.items()), F.lit(0.0)))
        now = soft.agg(*mass(rate)).first()
    else:
        off = {d: now[d] / total - targets[d] / weight for d in there} if total else {}
        if any(abs(e) > close for e in off.values()):
            warnings.warn(f"The targets aren't met after {steps} steps; shares of tokens off by {off}", stacklevel=2)
    return rate


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None) -> DataFrame:
    """doc_id, text_hash, n_rows, n_tokens, p_<domain>, rate, copies of each document.

    copies: the rate's whole part, and one more as often as its rest says, by a hash of the document.
    """
    domains = list(targets)
    soft = cut(posteriors(docs, classifier(docs, labelled, domains), domains))
    out = soft.withColumn("rate", fit_rates(soft, targets, budget))
    chance = F.pmod(F.xxhash64("doc_id", "text_hash", F.lit("mix")), F.lit(1 << 30)) / (1 << 30)
    return out.withColumn("copies", (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of docs, in all their columns, each as often as rates() says in copies."""
    wanted = mixed.where("copies > 0").select(F.col("doc_id").alias("tm_id"), F.col("text_hash").alias("tm_hash"), F.col("copies").alias("tm_copies"))
    both = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["tm_id"]) & (F.xxhash64(_text(docs)) == wanted["tm_hash"]))
    return both.withColumn("tm_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("tm_copies")))).select(*(docs[c] for c in docs.columns))


def labelled_domains(labels: DataFrame) -> DataFrame:
    """The domain of each labelled document: junk, else toxic, else clean."""
    domain = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null")


def op2_soft_mixing(spark, sf_dir) -> DataFrame:
    return rates(table(spark, sf_dir, "documents"), labelled_domains(table(spark, sf_dir, "labels"))).drop("text_hash")
