"""Operators against loops in Python, over random rows, and their pinned cases."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalog, chat, corruption, markers, topics, windows


def chat_rows(spark, n=400, seed=1, streams=3, last=9000):
    r = random.Random(seed)
    rows = [(r.randrange(streams), r.randrange(last), k, r.choice("AABBC"), float(r.randint(1, 5))) for k in range(n)]
    return rows, spark.createDataFrame(rows, "stream long, sec long, seq long, tag string, w double")


def by_stream(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_hop_windows(spark):
    r = random.Random(2)
    rows = [(s, float(r.randint(0, 3000)), 20.0) for s in range(3) for _ in range(12)]
    got = sorted((x.stream, x.chunk_no, int(x.window_start), x.start) for x in windows.hop(spark.createDataFrame(rows, "stream int, start double, dur double"), 300, 30).collect())
    want = []
    for s in range(3):
        mine = sorted(x for x in rows if x[0] == s)
        total, k, number = int(mine[-1][1] + 20), 0, 0
        while k < total:
            inside = [x for x in mine if k <= x[1] < k + 300]
            want += [(s, number, k, x[1]) for x in inside]
            number, k = number + bool(inside), k + 270
    assert got == sorted(want)


def test_range_join_is_half_open(spark):
    w = spark.createDataFrame([(1, 0, 300), (1, 300, 600), (1, 270, 570), (1, 900, 1200)], "stream int, start long, end long")
    e = spark.createDataFrame([(1, s) for s in (0, 145, 299, 300, 569, 570, 600, 9000)], "stream int, sec long")
    got = {}
    for r in windows.range_join(w, e, 100, how="left").collect():
        got.setdefault(r.start, []).append(r.sec)
    assert {k: sorted(v, key=str) for k, v in got.items()} == {0: [0, 145, 299], 300: [300, 569, 570], 270: [299, 300, 569], 900: [None]}


def test_confirmed_islands(spark):
    rows, frame = chat_rows(spark)
    got = {(x.stream, x.seq): x.seg for x in windows.confirmed(frame, "tag", ("stream",), ("sec", "seq")).collect()}
    for s, mine in by_stream(rows).items():
        now, seg = mine[0][3], 0
        for k, x in enumerate(mine):
            if x[3] != now and k + 1 < len(mine) and mine[k + 1][3] == x[3]:
                now, seg = x[3], seg + 1
            assert got[s, x[2]] == seg


def test_adjacent_dedup_and_packing(spark):
    rows, frame = chat_rows(spark, seed=4)
    kept = {(x.stream, x.seq) for x in markers.adjacent_dedup(frame, 600, ("A", "B")).collect()}
    sized = frame.withColumn("bytes", (F.col("w") * 10).cast("long"))
    packed = {(x.stream, x.seq): x.part for x in markers.greedy_pack(sized, 100).collect()}
    folded = {(x.stream, x.seq): x.part for x in markers.greedy_pack_fold(sized, 100).collect()}
    want_kept, want = set(), {}
    for s, mine in by_stream(rows).items():
        last, part, held = None, 0, 0
        for x in mine:
            if not (last and x[3] in "AB" and x[3] == last[3] and x[1] - last[1] < 600):
                want_kept.add((s, x[2]))
                last = x
            size = int(x[4] * 10)
            if held and held + size > 100:
                part, held = part + 1, 0
            held += size
            want[s, x[2]] = part
    assert kept == want_kept and packed == want and folded == want


def test_one_entry_over_the_limit_is_a_part(spark):
    frame = spark.createDataFrame([(1, k, k, size) for k, size in enumerate((10, 5000, 10, 10))], "stream int, sec int, seq int, bytes long")
    assert [x.part for x in markers.greedy_pack(frame, 3000).orderBy("seq").collect()] == [0, 1, 2, 2]
    assert markers.halves([5000], 3000) == [0]
    for sizes in ([65] * 10, [1], [], [600, 600]):
        cuts = markers.halves(sizes, 500)
        assert len(cuts) == len(sizes) and cuts == sorted(cuts)
        assert all(sum(s for s, c in zip(sizes, cuts, strict=True) if c == k) <= 500 or cuts.count(k) == 1 for k in set(cuts))


def test_fuzzy_merge(spark):
    lines = ["00:01:00 - [Talk] hello there friend", "00:01:00 - [Talk] hello there friends", "00:01:00 - [News] other things happen", "00:01:00 - [Talk] hello there friend"]
    frame = spark.createDataFrame([(1, 60, 0, k, x) for k, x in enumerate(lines)], "stream int, sec int, file_no int, line_no int, raw string")
    got = sorted(x.line_no for x in markers.merge_fuzzy(frame).collect())
    want, last = [], None
    for k, x in enumerate(lines):
        if last is None or SequenceMatcher(None, x[:40], last[:40]).ratio() <= 0.85:
            want.append(k)
            last = x
    assert got == want


def loop_brute(texts):
    """A pattern of 1, 2 or 3 texts, 4, 3 or 3 times or more: for each length the list is scanned by itself, and a hit is skipped."""
    texts, hit = [t.replace("[?] ", "").strip() for t in texts], set()
    for p, least in ((1, 4), (2, 3), (3, 3)):
        at = 0
        while at + p * least <= len(texts):
            times = 0
            while texts[at + times * p : at + times * p + p] == texts[at : at + p]:
                times += 1
            if times >= least and max(map(len, texts[at : at + p])) > 1:
                hit |= set(range(at, at + times * p))
                at += times * p
            else:
                at += 1
    return [k in hit for k in range(len(texts))]


def test_loops(spark):
    assert loop_brute(["bb", "aa"] * 3 + ["bb"]) == [True] * 6 + [False]
    r, lists = random.Random(3), [["bb", "aa"] * 3, ["bb", "aa"] * 3 + ["bb"], ["[?] aa", "aa ", "aa", "aa"], ["c"] * 9, ["c", "c"] * 4 + ["aa"], ["aa", None, "aa", None, "aa", None]]
    lists += [[r.choice(["aa", "bb", "c", "[?] aa"][: 2 + n % 3]) for _ in range(r.randint(0, 24))] for n in range(3000)]
    rows = [(n, f"k{n % 2}", k, t) for n, texts in enumerate(lists) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "stream int, other string, pos int, text string")
    got = {(x.stream, x.pos): x.in_loop for x in corruption.loops(frame, ("stream", "other")).collect()}
    assert len(got) == len(rows)
    for n, texts in enumerate(lists):
        assert [got[n, k] for k in range(len(texts))] == loop_brute([t or "" for t in texts]), texts
    assert corruption.loops(frame.limit(0), ("stream", "other")).count() == 0


def test_statuses_and_segments(spark):
    chunks = spark.createDataFrame([(1, k, c, "x" * n, f"t{k}") for k, (c, n) in enumerate([("a", 3499), ("b", 3501), ("c", 4501), ("d", 3000), ("d", 1600)])], "stream int, idx int, category string, text string, ts string")
    got = [(x.category, x.bytes, x.status) for x in markers.category_blocks(chunks).orderBy("island").collect()]
    assert got == [("a", 3500, "OK"), ("b", 3501, "WARN"), ("c", 4501, "OVER"), ("d", 4601, "OVER")]
    moods = spark.createDataFrame([("c1", [(0, 90, "pulse"), (60, 200, "natural")]), ("c2", []), ("c3", None)], "chunk string, segments array<struct<start:long,end:long,mood:string>>")
    m = spark.createDataFrame([("c1", 0), ("c1", 70), ("c1", 90), ("c1", 300), ("c2", 5), ("c3", 5), ("c4", 5)], "chunk string, sec long")
    assert sorted((x.chunk, x.sec, x.in_pulse) for x in markers.in_segment(m, moods).collect()) == [("c1", 0, True), ("c1", 70, True), ("c1", 90, False), ("c1", 300, False), ("c2", 5, True), ("c3", 5, True), ("c4", 5, True)]


def test_lookups(spark):
    files = spark.createDataFrame([("/x/livechat_chunk_07.txt",), ("livechat_chunk_08.txt",), ("other.txt",)], "file string")
    index = spark.createDataFrame([(1, "late", "b/livechat_chunk_07.txt"), (0, "chunk_7", "a/livechat_chunk_07.txt")], "pos int, chunk string, file string")
    assert {x.file: x.chunk for x in catalog.chunk_of_file(files, index).collect()} == {"/x/livechat_chunk_07.txt": "chunk_7", "livechat_chunk_08.txt": "chunk_08", "other.txt": "other"}
    blocks = spark.createDataFrame([(1, "The Boss and the end"), (2, "only an end"), (3, "none")], "block int, text string")
    hits = spark.createDataFrame([("end", "c2", "00:01:00")], "keyword string, chunk string, ts string")
    assert {x.block: (x.keyword, x.chunk) for x in catalog.align_reference(blocks, ["boss", "end"], hits).collect()} == {1: ("boss", None), 2: ("end", "c2"), 3: (None, None)}
    known = spark.createDataFrame([(1, "t", None)], "block int, topic string, n int")
    assert sorted(map(tuple, catalog.with_defaults(blocks.drop("text"), known, "block", {"topic": "unknown", "n": 0}).collect())) == [(1, "t", 0), (2, "unknown", 0), (3, "unknown", 0)]


def test_loop_scores(spark):
    rows = [(1, "a perfectly normal sentence with words"), (2, "la la la " * 5), (3, "spam spam spam spam spam spam spam spam spam spam")]
    frame = spark.createDataFrame(rows, "id int, text string")
    assert {x.id: x.looped for x in corruption.top_grams(frame, ("id",)).collect()} == {1: False, 2: True, 3: True}
    got = {x.id: x.covered for x in corruption.covered(frame, ("id",)).collect()}
    for i, t in rows:
        want = len(t) >= 8 and any(t.count(g) >= 2 and t.count(g) * n / len(t) > 0.4 for n in (2, 3, 4) for g in {t[k : k + n] for k in range(len(t) - n + 1)})
        assert got[i] == want


def test_uncertain_runs_and_recovery(spark):
    u = spark.createDataFrame([(1, 0.0, 0.6, True), (1, 0.6, 0.6, True), (1, 1.2, 0.6, True), (2, 0.0, 0.4, True), (2, 0.4, 0.4, True)], "stream int, start double, dur double, uncertain boolean")
    assert {x.stream: (x.n, x.retried) for x in corruption.uncertain_runs(u).collect()} == {1: (3, True), 2: (2, False)}
    bad = lambda r: r.withColumn("text", F.lit("t")).withColumn("corrupt", (F.col("start") <= 5000) & (F.col("end") > 5000))
    got = sorted((x.start, x.end, x.uncertain) for x in corruption.recover(spark.createDataFrame([(1, 0, 8000)], "id int, start long, end long"), bad).collect())
    assert got[0][0] == 0 and got[-1][1] == 8000 and sum(x[2] for x in got) == 1 and all(a[1] == b[0] for a, b in zip(got, got[1:]))


def test_boundaries_merge_to_the_last(spark):
    r = random.Random(9)
    texts = [r.choice(["the cat sat on the mat", "dogs bark loudly at night", "the cat sat on the mats"]) for _ in range(40)]
    frame = spark.createDataFrame([(1, k, float(k * 270), t, 1) for k, t in enumerate(texts)], "stream int, idx int, start double, text string, signal int")
    got = [x.idx for x in topics.boundaries(frame).orderBy("idx").collect()]

    def grams(t):
        return {t[k : k + 3] for k in range(len(t) - 2)}

    raw = [k for k in range(1, 40) if len(grams(texts[k]) & grams(texts[k - 1])) / len(grams(texts[k]) | grams(texts[k - 1])) < 0.3]
    want = []
    for k in raw:
        if want and k - want[-1] <= 2:
            want[-1] = k
        else:
            want.append(k)
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_sections(spark, seed):
    r = random.Random(seed)
    n = r.randint(1, 25)
    cuts = sorted(r.sample(range(n), r.randint(0, min(n, 5))))
    chunks = spark.createDataFrame([(1, k, float(k * 270)) for k in range(n)], "stream int, idx int, start double")
    bounds = spark.createDataFrame([(1, k) for k in cuts], "stream int, idx int")
    got = [(x.start, x.end) for x in topics.sections(chunks, bounds).orderBy("section").collect()]
    want, held, cur = [], 0, 0.0
    if not cuts:
        want = [(k * 270.0, min(k + 5, n - 1) * 270.0 + 300) for k in range(0, n, 6)]
    else:
        for k in range(n):
            held += 1
            if k in cuts:
                if held >= 3:
                    want.append((cur, k * 270.0))
                    cur = k * 270.0
                held = 0
        if held and (held >= 3 or not want):
            want.append((cur, (n - 1) * 270.0 + 300))
        if not want:
            want = [(0.0, (n - 1) * 270.0 + 300)]
    assert got == want


def test_idf_prefers_rare_files(spark):
    kw = spark.createDataFrame([(0, "ambient", "stream", "ambient.md"), (1, "boss_rare", "game", "boss_rare.md"), (2, "never", "game", None)], "kw_pos int, keyword string, kind string, file string")
    chunks = spark.createDataFrame([("c0", "ambient boss_rare boss_rare"), ("c1", "ambient")], "chunk string, text string")
    hits = topics.keyword_hits(chunks, kw)
    rarity = topics.idf(hits, 2)
    assert {x.keyword: (x.df, x.idf) for x in rarity.collect()} == {"ambient": (2, 0.0), "boss_rare": (1, 0.6931)}
    best = {x.chunk: x for x in topics.best_files(hits, rarity).collect()}
    assert (best["c0"].best_file, best["c0"].confidence, best["c0"].primary_topic) == ("boss_rare.md", 1.0, "Boss Rare (boss_rare)")
    assert best["c1"].best_file is None and best["c1"].confidence == 0.0


def test_laughs_and_segments(spark):
    lines = ["[00:00:01] a: 5555", "x 😂😂 +1", "plain talk", "ดิlol", "xD"]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string").withColumn("s", chat.line_signals(F.col("line")))
    assert [len(x.s) for x in frame.orderBy("k").collect()] == [1, 2, 0, 1, 1]
    buckets = spark.createDataFrame([(1, 0, 18.0, 18, "MEME_PULSE", 0)], "stream int, bucket long, score double, n long, mood string, first_seq long")
    bounds = spark.createDataFrame([(1, 0, 200), (2, 5, 50)], "stream int, n_start long, n_secs long")
    got = sorted((x.stream, x.start, x.end, x.mood) for x in chat.segments(buckets, bounds, chat.PulseConfig()).collect())
    assert got == [(1, 0, 90, "meme_pulse"), (1, 90, 200, "natural"), (2, 5, 50, "natural")]
    verdict = chat.verdicts(buckets, chat.PulseConfig()).first()
    assert verdict.verdict == "MEME_PULSE"


def test_zip_stops_at_the_shortest(spark):
    frame = spark.createDataFrame([(["a", "b", "c"], ["x", "y"], [1, 2, 3])], "en array<string>, ja array<string>, no array<int>")
    assert [(x.pos, x.en, x.ja, x.no) for x in catalog.zip_names(frame, {"en": "en", "ja": "ja", "no": "no"}).collect()] == [(1, "a", "x", 1), (2, "b", "y", 2)]


def test_retag(spark):
    rules = [("boss", "[Boss]", 70), ("clear.*boss", "[Victory]", 95)]
    frame = spark.createDataFrame([("Clear the boss", "[Talk]"), ("boss", "[Boss]"), ("the boss says", "[Talk]"), ("none", "[Talk]")], "d string, t string")
    assert [x.n for x in frame.select(markers.retag(F.col("d"), F.col("t"), rules, [("boss says", "[Boss]")]).alias("n")).collect()] == ["[Victory]", None, None, None]


def test_titles_and_flips(spark):
    rows = [(0, k, k, d, m) for k, (d, m) in enumerate([("คุยเรื่อง first thing", "A"), ("Ann: second", "B"), ("First Thing", "A"), ("third " + "word " * 9, "B"), ("fourth", "A")])]
    frame = spark.createDataFrame(rows, "part int, sec int, seq int, desc string, macro string")
    assert markers.titles(frame).first().title == "first thing | third word word word word word | fourth"
    assert markers.titles(frame.withColumn("topic_label", F.when(F.col("seq") == 0, "The topic"))).first().title == "The topic"
    assert markers.titles(frame.withColumn("topic_label", F.lit(None).cast("string"))).first().title.startswith("first thing")
    assert markers.tag_flips(frame).first().flips == 3
