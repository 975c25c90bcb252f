"""Each registered query over whole tables: SQL where there is some, brute force or held-out labels otherwise; and the pipeline."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import mixing, packing, quality, queries

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def sql(sf, text):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c.execute(text).df()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    want = sql(sf, queries.ORACLES[name])[list(got.columns)]
    key = list(got.columns)
    a, b = (x.sort_values(key).reset_index(drop=True).astype(str) for x in (got, want))
    assert a.equals(b)


def test_every_query_has_its_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op1_bradley_terry", "op4_pattern_grammar"):
        rows = queries.QUERIES[name](spark, sf).toPandas()
        assert len(rows) == docs and rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()




def test_vectors_have_no_false_links(spark, sf):
    got = queries.QUERIES["op7_itq_hamming"](spark, sf).toPandas().sort_values("vec_id")
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.array(rows.embedding.tolist(), np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.95).sum(1) - 1
    assert (got.n_links.values <= near).all() and got.n_links.sum() >= 0.9 * near.sum()


def stages(spark, docs, sf, path):
    """The name and the rows of each stage's input and output."""
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{path}/{k}")
        after = spark.read.parquet(f"{path}/{k}")
        yield name, docs, after
        docs = after


def brute_kept(rows):
    """Of the rows (place, doc_id, text) of each group of similar texts the first by doc_id, null last, then place; five words, 0.8."""
    sets = [(lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())((t or "").encode().lower().split()) for _, _, t in rows]
    holders, up = {}, list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, s in enumerate(sets):
        counts = Counter(j for x in s for j in holders.get(x, ()))
        for j, n in counts.items():
            if 100 * n >= 80 * len(s | sets[j]):
                a, b = sorted((root(k), root(j)))
                up[b] = a
        for x in s:
            holders.setdefault(x, []).append(k)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(k)
    return sum(1 for _ in groups), {frozenset(rows[k][1] for k in g) for g in groups.values()}


def test_pipeline_stages(spark, sf, tmp_path):
    """Each stage of the pipeline against brute force on its own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, before, after in stages(spark, docs, sf, tmp_path):
        rows, out = before.toPandas(), after.toPandas()
        assert name == "best-fit packing" or after.columns == docs.columns
        if name == "quality classifier":
            model = quality.learn(docs, quality.learned_labels(spark.read.parquet(f"{sf}/labels.parquet")))
            good = model.scores(np.array([quality.features(t or "") for t in rows.text])) >= 0.5
            assert sorted(out.doc_id) == sorted(rows.doc_id[good]) and 0.5 * len(rows) < len(out) < len(rows)
        elif name == "line dedup":
            sites, texts = {}, {}
            for t, s in zip(rows.text, rows.source, strict=True):
                for x in {x.strip(" \t\r") for x in (t or "").split("\n")} - {""}:
                    sites.setdefault(x, set()).add(s or "")
                    texts.setdefault(x, set()).add(t)
            gone = {x for x in sites if len(sites[x]) >= 8 and len(texts[x]) >= 8}
            want = {i: "\n".join(x for x in t.split("\n") if x.strip(" \t\r") not in gone) for i, t in zip(rows.doc_id, rows.text, strict=True)}
            assert dict(zip(out.doc_id, out.text, strict=True)) == want and all(out.n_chars == out.text.str.len())
        elif name == "n-gram Jaccard join":
            n, groups = brute_kept(list(zip(range(len(rows)), rows.doc_id, rows.text, strict=True)))
            assert len(out) == n and set(out.doc_id) == {min(g) for g in groups}
        elif name == "mixing sources to target weights":
            mixed = mixing.rates(before, mixing.labelled_domains(spark.read.parquet(f"{sf}/labels.parquet"))).toPandas()
            assert Counter(out.doc_id) == {i: c for i, c in zip(mixed.doc_id, mixed.copies, strict=True) if c}
            assert set(out.text) <= set(rows.text)
        else:
            assert out.groupby("sequence_id").length.sum().max() <= 2048
            lengths = [n + 1 for n in map(len, (e.ids for e in Tokenizer.from_file(packing.default_tokenizer()).encode_batch([t or "" for t in rows.text], add_special_tokens=False)))]
            assert out.length.sum() == sum(lengths) and len(out) == sum(-(-n // 2048) for n in lengths)
            assert out.sequence_id.nunique() <= math.ceil(sum(lengths) / 2048 * 1.02) + 1


def test_pipeline_defined_cases(spark, tmp_path):
    """Nulls, blanks, ties, repeats, long texts, clashing names, and empty tables."""
    text = " ".join(f"word{k}" for k in range(80))
    rows = [(1, text, "en", "a", 3, "x", "y"), (1, text, "en", "a", 3, "x", "y"), (2, text + " end", None, None, None, None, None), (3, None, "en", "a", 0, "x", "y"), (4, "", "en", "b", 0, "x", "y"), (None, text, "en", "a", 3, "x", "y"), (None, None, None, None, None, None, None), (5, "other " * 30_000, "en", "b", 1, "x", "y"), (6, " \n\t", "en", "b", 1, "x", "y")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, root string, tm_row string"
    labels = spark.createDataFrame([(None, None, None), (9, 1, 0)], "doc_id long, quality int, toxic int")
    for data, marks in ((rows, labels), (rows, labels.limit(0)), ([], labels)):
        path = str(tmp_path / f"{len(data)}-{marks.count()}")
        docs = spark.createDataFrame(data, schema)
        marks.write.parquet(f"{path}/labels.parquet")
        docs.write.parquet(f"{path}/documents.parquet")
        seen = {name: after for name, _, after in stages(spark, docs, path, f"{path}/out")}
        kept = seen["n-gram Jaccard join"].toPandas()
        assert list(kept.columns) == docs.columns
        if data:
            assert sorted(kept.doc_id.fillna(-1)) == [-1, 1, 3, 4, 5, 6]
        out = corpus_pipeline.run(spark, path)
        assert (out.count() > 0) == bool(data)
        assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
