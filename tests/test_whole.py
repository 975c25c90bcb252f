"""Registered queries do the whole job: every character and every line of the tables, against brute force."""

from tidemark.plans import registry


def tables(spark, path, **rows):
    """The tables' folder; rows: name=(rows, schema)."""
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def loops(t, threshold):
    return len(t) >= 8 and any(t.count(g) >= 2 and t.count(g) * n / len(t) > threshold for n in (2, 3, 4) for g in {t[i : i + n] for i in range(len(t) - n + 1)})


def test_loop_coverage_reads_whole_texts(spark, tmp_path):
    plain = "".join(chr(0x4E00 + k) for k in range(130))
    texts = [plain + "ab" * 60, "ab" * 10 + plain, "ab" * 60 + plain * 5, plain, "ababab", None, ""]
    sf = tables(spark, tmp_path, conversations=([(1, k, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string"))
    got = {r.pos: r.covered for r in registry.QUERIES["loop_coverage"](spark, sf).collect()}
    assert got == {k: loops(t or "", 0.15) for k, t in enumerate(texts)}
    assert got[0] and not got[1] and loops(texts[1][:120], 0.15) and not loops(texts[0][:120], 0.15)


def test_keyword_coherence_compares_every_line(spark, tmp_path):
    alike = ["red green blue"] * 5
    rows = [(1, [*alike, "other words here"]), (2, [*alike, "red green grey"]), (3, alike[:2]), (4, alike[:1])]
    sf = tables(spark, tmp_path, documents=([(i, "\n".join(x)) for i, x in rows], "doc_id long, text string"))
    got = {r.doc: (r.min_overlap, r.flagged) for r in registry.QUERIES["keyword_coherence"](spark, sf).collect()}
    assert got == {1: (0.0, True), 2: (0.5, False), 3: (1.0, False)}


def test_retag_rules_reads_every_line(spark, tmp_path):
    rows = [(1, "nothing\nthe BOSS is here\nthe end\nlicense gnu\nreleased"), (2, "die Mehrheit"), (3, None)]
    sf = tables(spark, tmp_path, documents=(rows, "doc_id long, text string"))
    got = {(r.doc, r.pos): r.new_tag for r in registry.QUERIES["retag_rules"](spark, sf).collect()}
    assert got == {(1, 0): None, (1, 1): "[Boss]", (1, 2): None, (1, 3): None, (1, 4): "[News]", (2, 0): "[Boss]"}
