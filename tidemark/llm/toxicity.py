"""Toxicity by a weighted finite-state pattern grammar.

A lexicon, an automaton over characters, rewrites each word of a clause as a symbol: INSULT or VERB (of a threat) with its stem's
weight, TARGET, NEGATION, REPORT or WORD. Five weighted transducers (transducer.py) are composed into one machine that reads those
symbols: threat (a verb and a target within three words), negation (reaches three words ahead), reported speech (reaches to the
clause's end), insult with its target (on either side of it), and the weights of the patterns. The machine's path through a clause
says what each insult or threat in it is (plain, aimed at a target, negated, reported), and the clause scores the sum of the
stems' and the arcs' weights. A clause without an insult or a threat matches nothing and scores nothing, whatever its words.

A document's features are its matched clauses' scores, whole, by pattern and per word; a logistic model of them gives the score.
Stems, arc weights and the model are learned from a bounded sample: `max_rows` labelled documents with the smallest hashes of their
ids, half of them of label 1 where there are as many. A pattern that the sample doesn't hold keeps its seed weight. Of the words'
beginnings only counts reach the driver, and of those at most `max_stems`. Every document is scored as a whole; ids, sources,
languages and labels are no features.

Defined cases: a null text is empty and an empty text has no clause; a null label counts for nothing; of repeated labels of a
document the largest counts; repeated documents are scored each; a null doc_id is scored, and kept; without labels of both kinds
the seed stems score with the seed model; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table
from tidemark.llm.quality import held_out
from tidemark.llm.transducer import Arc, Transducer

#: Labelled documents that are learned from, learned stems, and beginnings that the driver chooses them from, at most.
MAX_ROWS, MAX_STEMS, MAX_CANDIDATES = 8000, 256, 5000
#: Word beginnings that can become stems, in letters; a whole word counts as one, too.
SHORTEST, LONGEST = 3, 8
# Seeds of the grammar.
INSULTS = ("idiot", "stupid", "moron", "imbecile", "scum", "loser", "worthless", "pathetic", "disgusting", "trash", "dumbass")
THREATS = ("kill", "hurt", "beat", "destroy", "shoot", "stab", "murder", "strangle", "find", "töte", "umbring", "tuer", "frapper", "matar", "golpear")
TARGETS = frozenset("you your you're yourself he she they them him her these those people tu vous toi te du dich euch sie ihr tú usted ustedes eres es".split())
NEGATIONS = frozenset("not no never none nobody isn't aren't wasn't don't without nicht kein keine nie ne pas jamais sans sin nunca jamás".split())
REPORTS = frozenset("said says say called calls wrote writes quoted quote reported according dit disait écrit sagte sagt schrieb dijo dice escribió".split())
INSULT, VERB, TARGET, NEGATION, REPORT, WORD = "IVTNRW"
THREAT = "H"
# What the machine writes for an insult or a threat, with the seed weights of the arcs.
PATTERNS = {"insult": 0.0, "insult target": 0.5, "insult negated": -2.0, "insult reported": -1.5, "threat": 1.0, "threat negated": -3.0, "threat reported": -2.0}
_CLAUSE = re.compile(r"[^.!?;\n|]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
REACH = 3


def threat_machine(reach: int = REACH) -> Transducer:
    """A verb becomes a threat if a target follows within `reach` words, else a word.

    A state (d, p) has promised a target within p words and ruled one out for d: each verb's path guesses which it is, and only
    the path that guessed right ends.
    """
    number = lambda d, p: d * (reach + 1) + p
    arcs: dict[int, list[Arc]] = {}
    for d in range(reach + 1):
        for p in range(reach + 1):
            out = arcs.setdefault(number(d, p), [])
            less = (max(d - 1, 0), max(p - 1, 0))
            if not d:
                out.append(Arc(TARGET, TARGET, 0.0, number(0, 0)))
            if p != 1:  # the promise can still be kept
                out += [Arc(x, x, 0.0, number(*less)) for x in (INSULT, NEGATION, REPORT, WORD)]
                out.append(Arc(VERB, THREAT, 0.0, number(less[0], less[1] if p else reach)))
            if not p:
                out.append(Arc(VERB, WORD, 0.0, number(reach, 0)))
    return Transducer(arcs, {number(d, 0): 0.0 for d in range(reach + 1)})


def negation_machine(reach: int = REACH) -> Transducer:
    """Insults and threats become negated up to `reach` words after a negation."""
    arcs = {}
    for k in range(reach + 1):
        after = max(k - 1, 0)
        arcs[k] = [Arc(NEGATION, NEGATION, 0.0, reach), *(Arc(x, x, 0.0, after) for x in (TARGET, REPORT, WORD))]
        arcs[k] += [Arc(x, f"{x} negated" if k else x, 0.0, after) for x in (INSULT, THREAT)]
    return Transducer(arcs, dict.fromkeys(arcs, 0.0))


def report_machine() -> Transducer:
    """Insults and threats after a word of report become reported ones."""
    arcs = {}
    for k in (0, 1):
        arcs[k] = [Arc(REPORT, REPORT, 0.0, 1), *(Arc(x, x, 0.0, k) for x in (TARGET, NEGATION, WORD))]
        arcs[k] += [Arc(f"{x}{how}", f"{x} reported" if k else f"{x}{how}", 0.0, k) for x in (INSULT, THREAT) for how in ("", " negated")]
    return Transducer(arcs, dict.fromkeys(arcs, 0.0))


def target_machine() -> Transducer:
    """Plain insults become aimed ones if the clause holds a target, before or after them. States: none yet, seen, promised, ruled out."""
    rest = [NEGATION, REPORT, WORD, THREAT, *(f"{x} {how}" for x in (INSULT, THREAT) for how in ("negated", "reported"))]
    stay = lambda k: [Arc(x, x, 0.0, k) for x in rest]
    aimed = f"{INSULT} target"
    return Transducer(
        {
            0: [*stay(0), Arc(TARGET, TARGET, 0.0, 1), Arc(INSULT, aimed, 0.0, 2), Arc(INSULT, INSULT, 0.0, 3)],
            1: [*stay(1), Arc(TARGET, TARGET, 0.0, 1), Arc(INSULT, aimed, 0.0, 1)],
            2: [*stay(2), Arc(TARGET, TARGET, 0.0, 1), Arc(INSULT, aimed, 0.0, 2)],
            3: [*stay(3), Arc(INSULT, INSULT, 0.0, 3)],
        },
        {0: 0.0, 1: 0.0, 3: 0.0},
    )


def pattern_machine(weights: dict[str, float]) -> Transducer:
    """The patterns' names and weights; other symbols become an empty one."""
    name = lambda p: p.replace("insult", INSULT).replace("threat", THREAT)
    return Transducer({0: [*(Arc(x, "", 0.0, 0) for x in (TARGET, NEGATION, REPORT, WORD)), *(Arc(name(p), p, w, 0) for p, w in weights.items())]}, {0: 0.0})


def composed(weights: dict[str, float] = PATTERNS) -> Transducer:
    return reduce(Transducer.compose, [threat_machine(), negation_machine(), report_machine(), target_machine(), pattern_machine(weights)])


def plain_machine(weights: dict[str, float] = PATTERNS) -> Transducer:
    """The grammar taken away: every insult is plain, every verb a threat. For comparison."""
    return Transducer({0: [*(Arc(x, "", 0.0, 0) for x in (TARGET, NEGATION, REPORT, WORD)), Arc(INSULT, "insult", weights["insult"], 0), Arc(VERB, "threat", weights["threat"], 0)]}, {0: 0.0})


@dataclass
class Grammar:
    """Weighted stems with the automaton over them, and the machine over a clause's symbols."""

    insults: dict[str, float]
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(THREATS, 2.0))
    weights: dict[str, float] = field(default_factory=lambda: dict(PATTERNS))
    make: object = composed

    def __post_init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for stems, kind in ((self.insults, INSULT), (self.threats, VERB)):
            for stem, weight in stems.items():
                self.automaton.add_word(stem, (len(stem), kind, weight))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.machine = self.make(self.weights)
        self.known = lru_cache(1 << 16)(self.machine.run)  # clauses are short and alike

    def __reduce__(self):
        return Grammar, (self.insults, self.threats, self.weights, self.make)

    def hits(self, low: str) -> list[tuple[int, str, float]]:
        """Where words begin with a stem: place, symbol, weight; of stems of one place the heaviest."""
        best: dict[int, tuple[int, str, float]] = {}
        if len(self.automaton):
            for end, (n, kind, weight) in self.automaton.iter(low):
                at = end - n + 1
                if (not at or not low[at - 1].isalpha()) and (at not in best or weight > best[at][2]):
                    best[at] = (at, kind, weight)
        return sorted(best.values())

    def clauses(self, text: str) -> list[tuple[dict[str, float], float, str]]:
        """The matched clauses: weights of their stems by pattern, score (with the arcs' weights), clause."""
        low = text.lower()
        hits, out, k = self.hits(low), [], 0
        while k < len(hits):
            begin = max(low.rfind(c, 0, hits[k][0]) for c in ".!?;\n|") + 1
            found = _CLAUSE.match(low, begin)
            end = found.end() if found else len(low)
            marks = {}
            while k < len(hits) and hits[k][0] < end:
                marks[hits[k][0]] = hits[k][1:]
                k += 1
            if matched := self.parse(low, begin, end, marks):
                out.append((*matched, low[begin:end].strip()))
        return out

    def parse(self, low: str, begin: int, end: int, marks: dict[int, tuple[str, float]]) -> tuple[dict[str, float], float] | None:
        """The machine's path through a clause: weights by pattern and the score; None if nothing matches."""
        symbols, stems = [], []
        for m in _WORD.finditer(low, begin, end):
            kind, weight = marks.get(m.start(), (None, 0.0))
            word = m[0]
            symbols.append(kind or (NEGATION if word in NEGATIONS else REPORT if word in REPORTS else TARGET if word in TARGETS else WORD))
            stems.append(weight)
        path = (self.known if len(symbols) <= 64 else self.machine.run)("".join(symbols))
        by: dict[str, float] = {}
        for pattern, weight in zip(path[1], stems, strict=True) if path else ():
            if pattern:
                by[pattern] = by.get(pattern, 0.0) + weight
        return (by, path[0] + sum(by.values())) if by else None

    def features(self, text: str) -> list[float]:
        found = self.clauses(text)
        by = dict.fromkeys(PATTERNS, 0.0)
        for weights, _, _ in found:
            for pattern, weight in weights.items():
                by[pattern] += weight
        scores = [max(score, 0.0) for _, score, _ in found]
        total, words = sum(scores), text.count(" ") + text.count("\n") + 1
        return [*map(math.log1p, by.values()), math.log1p(total), min(100 * total / words, 20.0) ** 0.5, math.log1p(max(scores, default=0.0)), float(total > 0), math.log1p(len(found))]


#: Without labels: a matched clause's score weighs in at once; what the patterns are worth is in it already.
SEED_MODEL = (np.array([*[0.0] * len(PATTERNS), 2.5, 0.5, 1.0, 0.0, 0.0]), -3.5)


@dataclass
class Toxicity:
    grammar: Grammar
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.grammar.features(t) for t in texts]).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40, toward: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method; the ridge draws the weights toward given ones (0); the intercept isn't held back."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    hold = np.append(np.full(x.shape[1], ridge), 1e-6)
    rest = np.append(np.zeros(x.shape[1]) if toward is None else toward, 0.0)
    w = rest.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(hold), x1.T @ (y - p) - hold * (w - rest))
        size = np.abs(step).max()
        w += step * min(1, 5 / max(size, 1e-12))
        if size < 1e-6:
            break
    return w[:-1], float(w[-1])


def beginnings(text: str) -> Counter:
    """How often words begin so: every beginning of SHORTEST to LONGEST letters, and shorter whole words."""
    out: Counter = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        for k in range(min(SHORTEST, len(word)), min(len(word), LONGEST) + 1):
            out[word[:k]] += n
    return out


def _informative(tox: np.ndarray, rest: np.ndarray, n_tox: int, n_rest: int) -> np.ndarray:
    """The likelihood ratio (G) of a beginning's presence against the label; 0 where it stands for label 0."""
    n, has = n_tox + n_rest, tox + rest
    out = np.zeros(len(tox))
    for cell, row, col in ((tox, has, n_tox), (rest, has, n_rest), (n_tox - tox, n - has, n_tox), (n_rest - rest, n - has, n_rest)):
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.where(cell > 0, cell * np.log(cell * n / (row * col)), 0)
    return np.where(tox * n_rest > rest * n_tox, 2 * out, 0)


def choose_stems(rows: list[tuple[str, int, int]], n_tox: int, n_rest: int, most: int = MAX_STEMS) -> list[str]:
    """The most informative beginnings, none of which begins another."""
    g = _informative(np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float), n_tox, n_rest)
    chosen: list[str] = []
    for k in sorted(range(len(rows)), key=lambda k: (-g[k], -len(rows[k][0]), rows[k][0])):
        stem = rows[k][0]
        if len(chosen) == most or g[k] < 11:
            break
        if not any(stem.startswith(c) or c.startswith(stem) for c in chosen):
            chosen.append(stem)
    return chosen


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, make=composed) -> Toxicity:  # noqa: ANN001
    """Fits stems, arc weights and model to labels (doc_id, y: 1 or 0); make: the machine of given arc weights."""
    known = labels.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = known.where("y = 1").orderBy(*order).limit(max_rows // 2).union(known.where("y = 0").orderBy(*order).limit(max_rows // 2))
    # bounded by max_rows; equal texts count once, as copies would make any of their words a stem
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    sample = sample.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).agg(F.max(F.struct("y", "text")).alias("m")).select("m.y", "m.text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen[y == 1].update(beginnings(text.as_py() or "").keys())
                seen[y == 1][""] += 1
        for k, c in enumerate(seen):
            stems = list(c)
            for at in range(0, len(stems), 50_000):
                part = stems[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([k] * len(part), pa.int32()), pa.array([c[s] for s in part], pa.int64())], names=["stem", "y", "n"])

    sample = cut(sample)
    counts = cut(sample.mapInArrow(counted, "stem string, y int, n long").groupBy("stem").agg(F.sum(F.col("n") * F.col("y")).alias("tox"), F.sum(F.col("n") * (1 - F.col("y"))).alias("rest")))
    totals = counts.where("stem = ''").first()
    n_tox, n_rest = (totals["tox"], totals["rest"]) if totals else (0, 0)
    if not n_tox or not n_rest:
        return Toxicity(Grammar(dict.fromkeys(INSULTS, 2.0), make=make), *SEED_MODEL)
    lift = F.col("tox") * n_rest - F.lit(3) * F.col("rest") * n_tox
    rows = counts.where((F.col("stem") != "") & (F.col("tox") >= max(3, n_tox // 500)) & (lift > 0)).orderBy(F.desc(F.col("tox") - F.col("rest") * (n_tox / n_rest)), "stem").limit(MAX_CANDIDATES).collect()
    stems = choose_stems([(r["stem"], r["tox"], r["rest"]) for r in rows], n_tox, n_rest)
    stems += [s for s in INSULTS if not any(s.startswith(c) or c.startswith(s) for c in stems)]

    def by_row(make):  # noqa: ANN001, ANN202
        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [make(t.as_py() or "") for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["y", "x"])

        out = sorted(sample.mapInArrow(measured, "y int, x array<double>").collect())
        return np.array([r["x"] for r in out]), np.array([r["y"] for r in out], float)

    plain, place = Grammar(dict.fromkeys(stems, 1.0)), {s: k for k, s in enumerate(stems)}

    def stem_counts(text: str) -> list[float]:
        low, row = text.lower(), [0.0] * len(place)
        for at, _, _ in plain.hits(low):
            for n in range(1, 40):
                if (k := place.get(low[at : at + n])) is not None:
                    row[k] += 1
        return [math.log1p(v) for v in row]

    x, y = by_row(stem_counts)
    weights, _ = logistic(x, y, ridge=0.5)
    # a seed counts whatever the sample says of the word alone: what it means is up to its pattern
    weights = [max(w, 1.0) if s in INSULTS else w for s, w in zip(stems, weights, strict=True)]
    known = {s: float(min(w, 8.0)) for s, w in zip(stems, weights, strict=True) if w > 0.05}
    unarmed = Grammar(known, make=make)

    def pattern_counts(text: str) -> list[float]:
        found = unarmed.clauses(text)
        return [math.log1p(sum(sum(by.values()) for by, _, _ in found)), *(math.log1p(sum(p in by for by, _, _ in found)) for p in PATTERNS)]

    # the arcs' weights: what a pattern says beside its stems
    x, y = by_row(pattern_counts)
    weights, _ = logistic(x, y, ridge=1.0, toward=np.array([2.0, *PATTERNS.values()]))
    learned = Grammar(known, weights=dict(zip(PATTERNS, map(float, weights[1:]), strict=True)), make=make)
    x, y = by_row(learned.features)
    return Toxicity(learned, *logistic(x, y, ridge=0.2, toward=SEED_MODEL[0]))


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id and score of every row of docs."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = model.scores([t.as_py() or "" for t in batch.column(1)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scored, "doc_id long, score double")


def op4_pattern_grammar(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out(5, 0)).select(F.col("doc_id").cast("long"), F.col("toxic").alias("y"))
    scores = score(docs, learn(docs, labels))
    return scores.select("doc_id", held_out(5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
