"""The operators against brute force, and their defined cases: nulls, empty and long texts, ties, repeats, empty tables, odd columns."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_tree, common, digest, divide_skip, itq, line_spread, mixing, overlap_join, packing, quality, style_tree, toxicity, transducer

DOC = "doc_id long, text string, lang string, source string, n_chars long, tm_doc int, s int, token string, root string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing", ".", ","]) for _ in range(n))


def documents(spark, rows):
    """Documents of (doc_id, text, source), with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, "x", "y") for i, t, s in rows], DOC)


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(k, prose(k), f"s{k % 3}") for k in range(12)]
    rows += [(None, prose(2), "s0"), (None, None, None), (20, None, "s0"), (21, "", None), (22, prose(1), "s1"), (23, " ".join(prose(k, 400) for k in range(40)), "s2"), (24, "one", "s0"), (24, "one", "s0"), (25, "\n\n \t", "s1")]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def nothing(spark):
    return documents(spark, [(1, "a", "b")]).limit(0)


LABELS = "doc_id long, y int"


# 1 quality


def test_bradley_terry_orders_pairs(spark):
    good = [(k, prose(k), "a") for k in range(60)]
    bad = [(100 + k, " ".join(w + "$$$" for w in prose(k).split()).upper(), "a") for k in range(60)]
    docs = documents(spark, [*good, *bad])
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _, _ in good[:40] + bad[:40]] + [(1, 1), (5000, 0), (None, 1), (7, None)], LABELS)
    model = quality.learn(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all(got[k] >= 0.5 for k in range(60)) and all(got[100 + k] < 0.5 for k in range(60))
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == 60


def test_quality_defined_cases(spark, mixed, nothing):
    none = spark.createDataFrame([], LABELS)
    rows = quality.score(mixed, quality.learn(mixed, none)).collect()
    assert len(rows) == mixed.count() and all(r.score == 0.5 for r in rows)
    one_kind = spark.createDataFrame([(1, 1), (2, 1)], LABELS)
    assert quality.learn(mixed, one_kind) is None
    both = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], LABELS)
    rows = quality.score(mixed, quality.learn(mixed, both)).collect()
    assert len(rows) == mixed.count() and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in rows)
    assert quality.score(nothing, quality.learn(nothing, none)).count() == 0


def test_held_out_is_crc32(spark):
    rows = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", quality.held_out(3, 1).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


# 2 mixing


def test_rates_meet_targets(spark):
    clean = [(k, prose(k, 50), "a") for k in range(80)]
    toxic = [(100 + k, prose(k, 40) + " vrmblx vrmblx", "a") for k in range(40)]
    junk = [(200 + k, " ".join(w + "$$$" for w in prose(k, 30).split()), "a") for k in range(40)]
    docs = documents(spark, [*clean, *toxic, *junk])
    labelled = spark.createDataFrame([(i, "clean" if i < 100 else "toxic" if i < 200 else "junk") for i, _, _ in [*clean[:30], *toxic[:30], *junk[:30]]], "doc_id long, domain string")
    targets = {"clean": 0.8, "toxic": 0.15, "junk": 0.05}
    rows = mixing.rates(docs, labelled, targets).collect()
    total = sum(r.n_tokens for r in rows)
    assert len(rows) == 160 and all(r.rate >= 0 for r in rows)
    for d, w in targets.items():
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) / total - w) < 0.01
    assert sum(r.p_toxic > 0.5 for r in rows if 100 <= r.doc_id < 200) == 40
    taken = mixing.take(docs, mixing.rates(docs, labelled, targets))
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in rows)


def test_rates_against_least_squares(spark):
    """The steps against the same ones in numpy, and what they end at against many steps of plain projected gradient descent."""
    r, targets = np.random.default_rng(6), {"a": 0.5, "b": 0.3, "c": 0.2}
    p = r.dirichlet([0.3, 0.4, 0.5], 300)
    tokens = r.integers(0, 400, 300)
    soft = spark.createDataFrame([(int(t), 1, *map(float, q)) for t, q in zip(tokens, p, strict=True)], "n_tokens long, n_rows long, p_a double, p_b double, p_c double").coalesce(1)
    got = np.array([x.r for x in soft.select("*", mixing.fit_rates(soft, targets).alias("r")).collect()])
    total, want, first = tokens.sum(), np.array(list(targets.values())), tokens @ p
    off = lambda rate: np.abs((rate * tokens) @ p / total - want).max()
    rate = np.ones(300)
    for _ in range(mixing.STEPS):
        if off(rate) < 1e-4:
            break
        rate = np.maximum(0, rate - p @ (((rate * tokens) @ p - total * want) / first))
    assert (got >= 0).all() and off(got) < 2e-3 and np.abs(got - rate).max() < 0.02
    for _ in range(2000):
        rate = np.maximum(0, rate - p @ (((rate * tokens) @ p - total * want) / first))
    assert off(rate) < 1e-9 and np.abs(got - rate).max() < 0.05
    with pytest.warns(UserWarning, match="targets"):
        mixing.fit_rates(soft, {"a": 0.02, "b": 0.97, "c": 0.01}, steps=1)


def test_posteriors_against_naive_bayes(spark):
    """By brute force over the presence of the model's tokens."""
    docs = documents(spark, [(k, f"{'red' if k % 2 else 'blue'} common word{k % 5} " + ("scarlet " if k % 6 == 1 else ""), "a") for k in range(60)])
    labelled = spark.createDataFrame([(k, "warm" if k % 2 else "cold") for k in range(40)], "doc_id long, domain string")
    model = mixing.classifier(docs, labelled, ["warm", "cold"])
    weights = {r.token: (r.w_0, r.w_1) for r in model.collect()}
    got = {r.doc_id: r.p_warm for r in mixing.posteriors(docs, model, ["warm", "cold"]).collect()}
    for row in docs.collect():
        there = {w[: mixing.STEM].lower() for w in row.text.split()} | {"\n"}
        s = [sum(w[k] for t, w in weights.items() if t in there) for k in (0, 1)]
        assert got[row.doc_id] == pytest.approx(1 / (1 + math.exp(s[1] - s[0])), abs=1e-9) and (got[row.doc_id] > 0.5) == (row.doc_id % 2 == 1)


def test_mixing_defined_cases(spark, mixed, nothing):
    none = spark.createDataFrame([], "doc_id long, domain string")
    rows = mixing.rates(mixed, none).collect()
    assert sum(r.n_rows for r in rows) == mixed.count()
    assert all(abs(r.p_clean + r.p_toxic + r.p_junk - 1) < 1e-9 for r in rows)
    twice = next(r for r in rows if r.doc_id == 24)
    assert (twice.n_rows, twice.n_tokens) == (2, 1)
    assert mixing.rates(nothing, none).count() == 0


# 3 lines


def brute_lines(rows, sites, texts):
    where, whole = {}, {}
    for _, t, s in rows:
        for x in {x.strip(" \t\r") for x in t.split("\n")} - {""} if t is not None else ():
            where.setdefault(x, set()).add(s or "")
            whole.setdefault(x, set()).add(t)
    gone = {x for x in where if len(where[x]) >= sites and len(whole[x]) >= texts}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" \t\r") not in gone)) for i, t, _ in rows]


@pytest.mark.parametrize("texts", [5, 1])
def test_lines_against_brute_force(spark, texts):
    r = random.Random(5)
    rows = []
    for k in range(150):
        body = [prose(1000 + k * 7 + j, 5) for j in range(r.randint(0, 5))]
        for b in range(12):
            if r.random() < 0.06 * (b + 1):
                body.insert(r.randint(0, len(body)), f"boilerplate number {b} " + "\t" * (b % 2))
        rows.append((k, "\n".join(body), f"s{r.randint(0, 8 + k % 4)}"))
    copied = "copied one\ncopied two\ncopied three"
    rows += [(300 + k, copied, f"s{k}") for k in range(12)] + [(400, None, "s1"), (401, "", None), (402, "\n\n", "s2"), (403, "boilerplate number 11 \t", "s3"), (None, prose(3), "s1")]
    docs = documents(spark, rows)
    out = line_spread.strip(docs, 5, texts)
    got = sorted(((x.doc_id, x.text) for x in out.collect()), key=str)
    assert got == sorted(brute_lines(rows, 5, texts), key=str)
    assert out.columns == [*docs.columns, "tm_lines", "tm_removed"]
    assert all((t == copied) == (texts > 1) for i, t in got if i and 300 <= i < 400)


def test_block_on_many_sites_goes_entirely(spark):
    block = [f"notice line {k}" for k in range(5)]
    rows = [(k, "\n".join([f"body {k}", *block, f"end {k}"]), f"s{k}") for k in range(60)]
    assert {r.doc_id: r.text for r in line_spread.strip(documents(spark, rows)).collect()} == {k: f"body {k}\nend {k}" for k in range(60)}


def test_lines_empty(nothing):
    assert line_spread.strip(nothing).count() == 0


# 4 toxicity


def test_composition_against_path_enumeration():
    r = random.Random(8)

    def machine(reads, writes):
        states = r.randint(1, 3)
        arcs = {s: [transducer.Arc(r.choice(reads), r.choice(writes), r.randint(-3, 3), r.randrange(states)) for _ in range(r.randint(0, 5))] for s in range(states)}
        return transducer.Transducer(arcs, {s: float(r.randint(0, 2)) for s in range(states) if r.random() < 0.7})

    some = 0
    for _ in range(300):
        a, b = machine("xyz", "pq"), machine("pq", "uv")
        c = a.compose(b)
        for word in ("", "x", "xy", "yzx", "xxyz"):
            want = sorted((w1 + w2, out) for w1, mid in a.paths(word) for w2, out in b.paths(mid))
            assert sorted(c.paths(word)) == want
            best = c.run(word)
            assert (best is None and not want) or (best[0] == max(w for w, _ in want) and best in want)
            some += bool(want)
    assert some > 100


def test_grammar_machine_reads_every_clause_one_way():
    """Against the patterns' definition, symbol by symbol; each clause has just one path."""
    machine = toxicity.composed()
    for n in range(6):
        for word in itertools.product("IVTNRW", repeat=n):
            want = []
            for k, x in enumerate(word):
                kind = "insult" if x == "I" else "threat" if x == "V" and "T" in word[k + 1 : k + 4] else ""
                if kind and "R" in word[:k]:
                    kind += " reported"
                elif kind and "N" in word[max(0, k - 3) : k]:
                    kind += " negated"
                elif x == "I" and "T" in word:
                    kind += " target"
                want.append(kind)
            assert list(machine.paths(word)) == [(pytest.approx(sum(toxicity.PATTERNS.get(p, 0.0) for p in want)), tuple(want))], word


def test_grammar_scores_clauses():
    g = toxicity.Grammar({"idiot": 2.0, "scum": 1.0})
    text = "You are an idiot, truly. Fine day. He said they are scum! Not an idiot\nidiotic scum; I will kill you. I will not kill you. He wrote: I shoot them; we kill time"
    w = toxicity.PATTERNS
    assert [c[:2] for c in g.clauses(text)] == [
        ({"insult target": 2.0}, 2.0 + w["insult target"]), ({"insult reported": 1.0}, 1.0 + w["insult reported"]), ({"insult negated": 2.0}, 2.0 + w["insult negated"]),
        ({"insult": 3.0}, 3.0 + 2 * w["insult"]), ({"threat": 2.0}, 2.0 + w["threat"]), ({"threat negated": 2.0}, 2.0 + w["threat negated"]), ({"threat reported": 2.0}, 2.0 + w["threat reported"]),
    ]
    assert g.clauses("unidiomatic prose, a nonidiot") == [] and g.clauses("") == []
    assert len(g.clauses("idiot " * 30_000)) == 1
    seeds = toxicity.Toxicity(toxicity.Grammar(dict.fromkeys(toxicity.INSULTS, 2.0)), *toxicity.SEED_MODEL)
    p = seeds.scores(["I will kill you", "I will not kill you", "He said I will kill you", "You idiot", "He is not an idiot", "They wrote: you idiot", "We find time to beat eggs"])
    assert (p >= 0.5).tolist() == [True, False, False, True, False, False, False]


def test_grammar_beats_words_alone(spark):
    """Insults, threats, and the same ones negated or reported: without the machine's patterns they can't be told apart."""
    r, rows = random.Random(2), []
    for k in range(400):
        word, verb = r.choice(["idiot", "moron", "scum"]), r.choice(["hurt", "shoot", "kill"])
        # every word of the cores stands in all documents, so none says anything by itself
        body = [prose(3000 + k, 8), "what will we say", "it is not she that said it", "we never are what is reported", "you are a friend", "that we will"]
        y = k % 2
        core = r.choice([f"you are a {word}", f"we will {verb} you", f"what a {word}"]) if y else r.choice([f"you are not a {word}", f"she said you are a {word}", f"we never {verb} you", f"it is reported that we {verb} you"])
        body.insert(r.randint(0, 6), core)
        rows.append((k, ". ".join(body), y))
    docs = documents(spark, [(i, t, "a") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 4 < 2], LABELS)
    held = [(i, t, y) for i, t, y in rows if i % 4 >= 2]
    right = {}
    for make in (toxicity.composed, toxicity.plain_machine):
        model = toxicity.learn(docs, labels, make=make)
        right[make] = np.mean((model.scores([t for _, t, _ in held]) >= 0.5) == np.array([y for _, _, y in held]))
    assert right[toxicity.composed] >= 0.95 and right[toxicity.composed] >= right[toxicity.plain_machine] + 0.2


def test_toxicity_learns_stems(spark):
    rows = [(k, prose(k), "a") for k in range(120)] + [(200 + k, prose(k) + f" vequ{WORDS[k % 9]} vequ{WORDS[k % 5]}", "a") for k in range(60)]
    docs = documents(spark, rows)
    model = toxicity.learn(docs, spark.createDataFrame([(i, int(i >= 200)) for i, _, _ in rows if i % 2 == 0] + [(None, 1), (3, None)], LABELS))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all(got[i] < 0.5 for i in range(120)) and all(got[200 + k] >= 0.5 for k in range(60))


def test_toxicity_defined_cases(spark, mixed, nothing):
    none = spark.createDataFrame([], LABELS)
    seeds = toxicity.learn(mixed, none)
    rows = toxicity.score(mixed, seeds).collect()
    assert len(rows) == mixed.count() and all(0 <= r.score < 0.5 for r in rows)
    assert seeds.scores(["You pathetic idiot, you are scum."])[0] > 0.5
    assert toxicity.score(nothing, toxicity.learn(nothing, none)).count() == 0


# 5 chats


def test_reply_tree_branches(spark):
    m = spark.createDataFrame(
        [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 3.0), (1, 4, 3, "user", None, 0.0), (1, 5, 2, None, "z", 1.0), (2, 1, 2, "user", "ring", 0.0), (2, 2, 1, "user", "ring", 0.0), (3, 9, 8, "user", "orphan", 0.0), (3, 9, 8, "user", "orphan", 0.0)],
        "conv_id long, msg_id long, parent_id long, role string, text string, score double",
    )
    got = sorted((r.conv_id, r.branch, r.place, r.text) for r in chat_tree.reply_paths(m, 5).collect())
    assert got == [(1, 1, 0, "q"), (1, 1, 1, "b"), (1, 1, 2, ""), (1, 2, 0, "q"), (1, 2, 1, "a"), (1, 2, 2, "z"), (3, 1, 0, "orphan")]
    assert {r.branch for r in chat_tree.reply_paths(m).collect()} == {1}
    assert chat_tree.reply_paths(m.limit(0)).count() == 0


def test_deep_path(spark):
    m = spark.range(300).selectExpr("7L conv_id", "id msg_id", "if(id > 0, id - 1, null) parent_id", "'user' role", "cast(id as string) text", "1d score")
    rows = sorted((r.place, r.text, r.branch_score) for r in chat_tree.reply_paths(m).collect())
    assert rows == [(k, str(k), 300.0) for k in range(300)]


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "</turn>", "<", "/turn>", "</turn></turn>\n", "####", "a\\", "\\", "", ": x", "😂 </turn\u2028>", "x" * 5000 + "\\</turn>" * 50]
    roles = ["user: a", "assistant", "a\nb", "### x", ":", "</turn>", "\\"]
    rows = [(c, k, k - 1 if k else None, roles[(c + k) % len(roles)], texts[(c * 5 + k) % len(texts)], 0.0) for c in range(12) for k in range(8)]
    m = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    for r in chat_tree.read_chat(chat_tree.format_chat(chat_tree.reply_paths(m))).collect():
        mine = [(x[3], x[4]) for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == mine
        assert r.loss_text == "".join(t for role, t in mine if role == "assistant")


def test_long_conversation_and_clashing_names(spark):
    turns = [(1, 9, 1, k, "assistant" if k % 2 else "user", f"text {k} ##" * 3, 0.0, "x", 5) for k in range(3000)] + [(2, 1, 1, 0, "user", "", 0.0, "x", 5)]
    chats = chat_tree.format_chat(spark.createDataFrame(turns, "conv_id long, leaf_id long, branch int, place long, role string, text string, branch_score double, whole string, n int"))
    back = {r.conv_id: r for r in chat_tree.read_chat(chats).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(t[4], t[5]) for t in turns if t[0] == 1]
    assert back[1].loss_text == "".join(t[5] for t in turns if t[4] == "assistant") and back[2].loss_text == ""
    assert chat_tree.format_chat(spark.createDataFrame(turns, "conv_id long, leaf_id long, branch int, place long, role string, text string, branch_score double, whole string, n int").limit(0)).count() == 0


def test_best_branches_against_brute_force(spark):
    r = random.Random(9)
    rows = [(c, k, r.choice([None, *range(k)]) if k else None, "user", f"{c}.{k}", float(r.randint(0, 3))) for c in range(20) for k in range(12)]
    got = {}
    for x in chat_tree.reply_paths(spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double"), 3).collect():
        got.setdefault((x.conv_id, x.branch), []).append((x.place, x.text, x.branch_score))
    for c in range(20):
        mine = {k: (up, s) for cc, k, up, _, _, s in rows if cc == c}
        leaves = set(mine) - {up for up, _ in mine.values()}

        def path(k):
            return [*(path(mine[k][0]) if mine[k][0] is not None else []), k]

        best = sorted(leaves, key=lambda k: (-sum(mine[m][1] for m in path(k)), -len(path(k)), k))[:3]
        assert {b for cc, b in got if cc == c} == set(range(1, len(best) + 1))
        for b, leaf in enumerate(best, 1):
            score = sum(mine[m][1] for m in path(leaf))
            assert sorted(got[c, b]) == [(k, f"{c}.{m}", score) for k, m in enumerate(path(leaf))]


# 6 digests


def test_fingerprints(spark, nothing):
    rows = [(1, "Straße  ﬁne", "a"), (2, "STRASSE fine ", "a"), (3, "e\u0301", "a"), (4, "é", "a"), (5, None, "a"), (6, "", "a"), (7, "other", "a"), (7, "other", "a")]
    got = [(r.doc_id, r.fingerprint) for r in digest.fingerprints(documents(spark, rows)).collect()]
    f = dict(got)
    assert len(got) == 8 and f[1] == f[2] and f[3] == f[4] and f[5] == f[6] and len(set(f.values())) == 4
    assert digest.fingerprints(nothing).count() == 0


def test_equal_digests_of_different_texts_are_told_apart(spark):
    rows = [(1, "a", "x"), (2, "b", "x"), (3, " A ", "x"), (4, "", "x"), (None, None, "x"), (5, "\n", "x"), (6, "c", "x"), (7, "c", "x"), (7, "b", "x"), (8, "long " * 50_000, "x"), (None, "b", "x")]
    got = [(r.doc_id, r.fingerprint) for r in digest.fingerprints(documents(spark, rows), lambda form: "long" if len(form) > 9 else "same").collect()]
    assert len(got) == len(rows) and {f.partition("~")[0] for _, f in got} == {"same", "long"}
    marks = {}
    for i, f in got:
        marks.setdefault(i, set()).add(f)
    assert marks[1] == marks[3] and marks[4] == marks[5] and marks[6] | marks[2] == marks[7] and marks[None] == marks[4] | marks[2]
    assert len(set.union(*marks.values())) == 5
    whole = digest.edited_apart(documents(spark, rows), lambda form: "same").collect()
    assert len(whole) == len(rows) and len({r.fingerprint for r in whole}) == 5
    forms = {}
    for i, t, _ in rows:
        forms.setdefault(i, set()).add(digest.canonical(t or ""))
    for r in whole:
        assert r.doc_id in forms and (r.near_edited == 1.0) == (r.edited_fingerprint == r.fingerprint) or r.fingerprint == "same"
    assert sum(r.doc_id is None for r in whole) == 2


def test_edited_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(digest, "RANGE_ROWS", 5)
    rows = [(k * 3, prose(k, k), "a") for k in range(40)] + [(200, "x", "a"), (201, "x", "a"), (202, None, "a"), (203, "𝒜b\nc" * 9, "a"), (None, "the null one", "a"), (204, "word " * 30_000, "a")]
    got = {r.doc_id: r for r in digest.edited(documents(spark, rows)).collect()}
    down = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    assert len(got) == len(rows)
    for k, (i, t, _) in enumerate(down):
        t, after = t or "", down[(k + 1) % len(down)][1] or ""
        n = len(t) // 3
        new = t[: len(t) - n] + after[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(digest.canonical(new) == digest.canonical(t)), float(digest.canonical(after) == digest.canonical(t)))
    assert digest.edited(documents(spark, rows).limit(0)).count() == 0


# 7 embeddings


@pytest.mark.parametrize("dims", [32, 3])
def test_near_vectors_against_brute_force(spark, monkeypatch, dims):
    monkeypatch.setattr(itq, "BLOCK", 16)
    monkeypatch.setattr(itq, "SMALL", 6)
    monkeypatch.setattr(itq, "HOT", 4)
    r = np.random.default_rng(3)
    base = r.standard_normal((60, dims))
    x = np.vstack([base, *(base[:12] + r.standard_normal((12, dims)) * s for s in (0.05, 0.1, 0.15)), base[0] + r.standard_normal((90, dims)) * 0.06, base[20:26], base[20:22], *[base[40:41]] * 7])
    rows = [(k, [float(v) for v in row], 9, 1, "x") for k, row in enumerate(x)]
    odd = [(500, None, 1), (501, [], 1), (502, [0.0] * dims, 1), (503, [float("nan")] * dims, 1), (504, [None] + [1.0] * (dims - 1), 1), (505, [float("inf")] * dims, 1), (506, [1.0, 2.0], 1), (507, [1.0, 2.0], 1), (0, rows[0][1], 9), (None, rows[0][1], 9)]
    frame = spark.createDataFrame(rows + [(*o, 1, "x") for o in odd], "vec_id long, embedding array<double>, root int, m int, h string")
    got = {g.vec_id: g for g in itq.near_vectors(frame).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    assert len(got) == len(rows) + 8 and all(got[i].n_links == 0 and got[i].component_id == i for i in range(500, 506))
    assert got[506].n_links == got[507].n_links == 1 and got[507].component_id == 506
    links = np.array([got[k].n_links for k in range(len(x))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.95 * near.sum()
    assert all(g.kept == (g.vec_id == g.component_id) for g in got.values())
    same = [k for k in range(len(x)) if (x[k] == base[40]).all()]
    assert len(same) == 8 and {got[k].component_id for k in same} == {got[40].component_id} and all(got[k].n_links >= 7 for k in same)
    assert itq.near_vectors(frame.limit(0)).count() == 0


@pytest.mark.parametrize("dims", [2, 8, 16, 24, 32, 48, 64, 128])
@pytest.mark.parametrize("shift", [0.0, 1.0])
def test_recall_at_the_threshold_whatever_the_dimensions(dims, shift):
    r = np.random.default_rng(dims)
    unit = lambda z: z / np.linalg.norm(z, axis=1, keepdims=True)
    x = unit(r.standard_normal((3000, dims)) + shift)
    mean, projection, width, most = itq.tables_for(x[:2000], 100_000, 0.95)
    a = x[2000:]
    aside = r.standard_normal(a.shape)
    aside = unit(aside - (aside * a).sum(1, keepdims=True) * a)
    b = 0.951 * a + math.sqrt(1 - 0.951**2) * aside
    ka, kb = (itq.substrings(z, mean, projection, width) for z in (a, b))
    assert ((ka == kb).any(1) & (itq.distances(ka, kb) <= most)).mean() >= 0.93


# 8 pages


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a>x</a></ul></nav>
<div class="cookie-notice">c %d</div><article><header><h1>Head &amp; shoulders</h1></header><p>One<br>two &#8212; <b>three<p>four  five</p><script>var a = "</p>";</script>
<aside>no</aside><ul><li>a<li>b</ul><form><input><button>go</button></form></article><div id="comments"><p>first!</p></div><footer>&copy; %d</footer></body></html>"""


def test_main_text(spark):
    want = "Head & shoulders\n\nOne two — three\n\nfour five\n\na\n\nb"
    rows = [(k, f"https://h{k % 2}.example/{k}", PAGE % (k, k), "x") for k in range(8)] + [(90, None, None, "x"), (91, "u", "", "x"), (92, "u", "plain &lt;text", "x"), (93, "u", "<p>unclosed <b>x", "x"), (93, "u", "<p>unclosed <b>x", "x"), (94, "u", "<div>" * 3000 + "deep", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = style_tree.main_text(pages).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert all(text[k] == want for k in range(8))
    assert (text[90], text[91], text[92], text[93], text[94]) == ("", "", "plain <text", "unclosed x", "deep")
    assert style_tree.main_text(pages.limit(0)).count() == 0


def test_alike_branches_go(spark):
    pages = [(k, "http://s.example/", f"<body><div class=a>The same promise everywhere</div><div class=b><p>{prose(k)}</p></div></body>") for k in range(6)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert all("same promise" not in r.text and len(r.text) > 50 for r in style_tree.main_text(frame).collect())


# 9 packing


def test_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    from tidemark.llm.word_bpe import WordBpe

    path = packing.default_tokenizer()
    real, mine = Tokenizer.from_file(path), WordBpe(path)
    texts = ["", " ", "Hello, World!", "naïve café e\u0301 ÀÉ", "it's we'll 12345 ½ ²", "<|endoftext|> in <|startoftext|>", "ΟΔΟΣ İstanbul", "a\x1cb\x85c\xa0d\u2003e", "ＦＵＬＬ 漢字 ไทย 😂👍🏽", "$$$ &&& ---", "x" * 300, "can't'sn't 'S", *(prose(k) for k in range(50))]
    texts += ["".join(chr(random.Random(k * 97 + j).choice([random.Random(k + j).randint(32, 0x2FF), random.Random(j).randint(0x370, 0x2000)])) for j in range(60)) for k in range(60)]
    for t in texts:
        assert np.frombuffer(mine.encode(t), np.uint32).tolist() == real.encode(t, add_special_tokens=False).ids, t
    merges = {t for t in real.get_vocab() if not t.startswith("<|")}
    assert len(merges) == len(real.get_vocab()) - 2


def test_packing_layout(spark, mixed, nothing):
    rows = packing.pack(mixed, size=64).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 64
    assert sum(r.doc_id == 24 for r in rows) == 2 and sum(r.doc_id in (20, 21, 25) for r in rows) == 3
    whole = [r for r in rows if r.doc_id == 23]
    assert all(r.length == 64 for r in whole if r.piece < len(whole) - 1) and [r.start for r in sorted(whole, key=lambda r: r.piece)] == [64 * k for k in range(len(whole))]
    assert packing.pack(nothing).count() == 0


def test_plan_places_every_rank_once():
    r = random.Random(1)
    for size in (7, 16, 50):
        counts = {n: r.randint(1, 60) for n in range(1, size + 1) if r.random() < 0.6}
        used, places = {}, 0
        for length, lo, hi, n, first, at in packing.plan(counts, size):
            for rank in range(lo, hi):
                seq, off = first + (rank - lo) % n, at + length * ((rank - lo) // n)
                span = used.setdefault(seq, [])
                span.append((off, length))
                places += 1
        assert places == sum(counts.values())
        for span in used.values():
            at = 0
            for off, n in sorted(span):
                assert off == at
                at += n
            assert at <= size
        assert len(used) <= 1.25 * -(-sum(k * v for k, v in counts.items()) // size) + 1


# 10 overlap


def brute_classes(rows, words, num):
    sets, up = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
        up[i] = i

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(100 * len(x & y) >= num * len(x | y) and x and y for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize(("words", "num", "block"), [(3, 90, 1024), (5, 80, 4)])
def test_classes_against_brute_force(spark, monkeypatch, words, num, block):
    monkeypatch.setattr(overlap_join, "BLOCK", block)
    monkeypatch.setattr(overlap_join, "FANOUT", 3)
    r = random.Random(words)
    rows = []
    for base in range(6):
        text = [f"w{r.randint(0, 10**6)}" for _ in range(70)]
        for _ in range(14):
            w = list(text)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = f"w{r.randint(0, 10**6)}"
            rows.append((len(rows) + base, " ".join(w).upper() if r.random() < 0.3 else "  ".join(w)))
    common = " ".join(f"passage{k}" for k in range(40))
    rows += [(200 + k, common + f" tail{k} tail{k + 1} end{k}") for k in range(20)] + [(300, None), (301, ""), (302, "two words"), (303, "TWO\twords"), (304, "É é"), (305, "é É"), (306, " \n"), (1, rows[1][1])]
    docs = documents(spark, [(i, t, "a") for i, t in rows] + [(None, rows[0][1], "a"), (None, None, "a")])
    got = overlap_join.classes(docs, words, num).collect()
    want = brute_classes(rows, words, num)
    assert len(got) == len(rows)
    assert {g.doc_id: g.component_id for g in got} == want
    assert next(g.n_shingles for g in got if g.doc_id == 300) == 0 and next(g.n_shingles for g in got if g.doc_id == 302) == 1
    kept = overlap_join.keep_one(docs, words, num)
    ids = [k.doc_id for k in kept.collect()]
    assert kept.columns == docs.columns and set(ids) == {i for i, c in want.items() if i == c} | {None} and ids.count(None) == 1


def test_divide_skip_against_brute_force():
    r = np.random.default_rng(4)
    for trial in range(400):
        lists = [sorted(set(r.integers(0, 12, r.integers(0, 9)).tolist())) for _ in range(r.integers(1, 12))]
        counts = {m: sum(m in row for row in lists) for m in range(12)}
        least = int(r.integers(1, 7))
        assert list(divide_skip.merge_skip(lists, least)) == [(m, n) for m, n in counts.items() if n >= least], trial
        query = np.unique(r.integers(0, 60, r.integers(1, 50)))
        members = [np.unique(r.integers(0, 60, r.integers(0, 50))) for _ in range(r.integers(0, 40))]
        need = r.integers(1, 25, len(members))
        want = [(k, n) for k, m in enumerate(members) if (n := len(np.intersect1d(query, m))) >= need[k]]
        assert divide_skip.search(query, r.integers(-1, 30, len(query)), members, need) == want, trial
    assert divide_skip.long_lists(1, 5) == 0 and 0 < divide_skip.long_lists(100, 128) < 100


def test_classes_empty(nothing):
    assert overlap_join.classes(nothing).count() == 0


def test_components_of_long_paths(spark):
    edges = spark.range(99).selectExpr("id + 1 as a", "id as b").union(spark.createDataFrame([(500, 400), (400, 450), (450, 450), (None, 3)], "a long, b long"))
    got = {r.id: r.root for r in common.components(edges).collect()}
    assert got == {k: 0 for k in range(100)} | {500: 400, 400: 400, 450: 400}
    assert common.components(edges.limit(0)).count() == 0


def test_bitmap_holds_all_ids(spark):
    ids = spark.range(0, 5000, 7)
    assert common.bitmap_bits(0) == common.bitmap_bits(9) == 20 and common.bitmap_bits(10**6) == 24 and common.bitmap_bits(10**12) == 28
    for wide in (20, 23):
        bitmap = common.id_bitmap(ids, "id", wide)
        place = np.array([r.p for r in ids.select(common.bit_of("id", wide).alias("p")).collect()])
        assert common.held(bitmap, place).all() and np.unpackbits(np.frombuffer(bitmap, np.uint8)).sum() <= ids.count()


def test_names_of_noise():
    page = '<article class="post long-form comment-enabled"><p>kept</p><div class="notices">x</div><div class="top-ads">x</div><div class="long-form">kept</div></article><article class="comment">x</article>'
    assert style_tree.extract(page, {}) == "kept\n\nkept"


def test_long_unlike_sets_are_not_sent(spark, monkeypatch):
    """Long texts that share a passage pass the coarse counts; only those that can be similar have their whole sets sent."""
    r = random.Random(5)
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    passage, near, sent = words(30), words(2600), []
    texts = [" ".join(passage + words(n)) for n in (2500, 2510, 2900, 3000)] + [" ".join(near), " ".join(near[:2200] + words(20)), " ".join(near[:1500] + words(1100))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)

    def counted(df):
        out = common.cut(df)
        if out.columns == ["node", "first"]:
            sent.append(out.count())
        return out

    monkeypatch.setattr(overlap_join, "cut", counted)
    got = {x["doc_id"]: x["component_id"] for x in overlap_join.classes(docs).collect()}
    sets = [set(overlap_join.shingles(t, 5).tolist()) for t in texts]
    links = {(a, b) for a in range(7) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert links == {(5, 4)} and got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6}
    assert sent[1:] == [2, 0]


def test_fine_counts_bound_what_sets_share(spark):
    """No pair that shares enough is dropped, whatever the sizes' buckets; a full bucket drops nothing."""
    r = np.random.default_rng(3)
    like, pairs, sizes = overlap_join.Likeness(80, 100), [], []
    for k, n in enumerate((520, 900, 1024, 1025, 2048, 2300, 5000)):
        a = np.unique(r.integers(-(2**63), 2**63 - 1, n))
        for j, part in enumerate((1.0, 0.95, 0.85, 0.81, 0.5, 0.0)):
            b = np.concatenate([a[: int(len(a) * part)], np.unique(r.integers(-(2**63), 2**63 - 1, int(len(a) * (1 - part) * 0.1) + (part < 0.6) * n // 2))])
            x, y = 100 * k + 10 * j, 100 * k + 10 * j + 1
            full = np.full(128, 255, np.uint8).tobytes() if part == 0.0 and k == 0 else None
            for doc, s in ((x, a), (y, b)):
                sizes.append((doc, len(s), full or overlap_join._counts(s, 1 << ((len(s) - 1) // overlap_join.EACH).bit_length()) if len(s) > overlap_join.LONG or full else None))
            pairs.append((x, y, len(np.intersect1d(a, b)) >= like.overlap(len(a) + len(b)), full is not None))
    found = overlap_join._finer(spark.createDataFrame([p[:2] for p in pairs], "a long, b long"), spark.createDataFrame([z for z in sizes if z[2] is not None], "doc long, n int, fine binary"), like)
    found = {tuple(x) for x in found.collect()}
    assert {p[:2] for p in pairs if p[2] or p[3]} <= found and sum(p[2] for p in pairs) >= 20 and len(found) < len(pairs) - 5
