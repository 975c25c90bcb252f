"""Scalar functions and the pinned cases of clocks, dictionaries, titles and links."""

from pyspark.sql import functions as F

from tidemark.functions import clock, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_clocks(spark):
    for s, want in ((0, "00:00:00"), (65.9, "00:01:05"), (3665, "01:01:05"), (360000, "100:00:00")):
        assert one(spark, clock.fmt_clock(F.lit(s))) == want
    for t, want in (("01:02:03", 3723), ("02:03", 123), ("7", 0), ("", 0), ("a:b:c", 0)):
        assert one(spark, clock.parse_clock(F.lit(t))) == want
    assert one(spark, clock.parse_clock(F.lit("02:03"), two_parts=False)) == 0
    assert one(spark, clock.strict_clock(F.lit("x"))) is None
    assert one(spark, clock.chunk_number(F.lit("chunk_012.json"))) == 12 and one(spark, clock.chunk_number(F.lit("chunk.json"))) == 0


def test_white_space(spark):
    assert one(spark, text.fold_space(F.lit(" a \t b\n"))) == "a b"


def test_corrections_run_in_order_and_skip_exclusions(spark):
    rules = [text.Correction("B$1", ("a.c",)), text.Correction("done", ("b$1",), ("keep",))]
    assert one(spark, text.correct(F.lit("A.C abc"), rules)) == "done abc"
    assert one(spark, text.correct(F.lit("A.C keep"), rules)) == "B$1 keep"
    assert one(spark, text.mask(F.lit("Old Name and Old"), {"Old": "X", "Old Name": "Y"})) == "Y and X"


def test_regex_dictionary(spark):
    patterns = text.valid_patterns({"<\\1>": ["(a+)b"], "bad": ["("], "$": ["longer pattern"]})
    assert [p for p, _ in patterns] == ["longer pattern", "(a+)b"]
    assert one(spark, text.clean(F.lit("aab LONGER pattern"), patterns)) == "<aa> $"


def test_counts_and_sizes(spark):
    assert one(spark, text.count_of(F.lit("aaaa"), F.lit("aa"))) == 2 and one(spark, text.count_of(F.lit("a"), F.lit(""))) == 0
    assert [one(spark, text.byte_status(F.lit(n))) for n in (3500, 3501, 4501)] == ["OK", "WARN", "OVER"]


def test_grams_and_likeness(spark):
    assert one(spark, text.char_grams(F.lit("Ab  cD"))) == ["ab ", "b c", " cd"] and one(spark, text.char_grams(F.lit("ab"))) == []
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))
    assert abs(one(spark, text.jaccard(a, b)) - 1 / 3) < 1e-9 and one(spark, text.jaccard(a, F.expr("cast(array() as array<string>)"))) == 0
    assert one(spark, text.loop_grams(F.lit("a b c d"))) == ["a b", "b c", "c d"] and one(spark, text.loop_grams(F.lit("ab cd"))) == ["abc", "bcd"]
    assert one(spark, text.loop_coverage(F.lit("abababababab"))) and not one(spark, text.loop_coverage(F.lit("a normal sentence here"))) and not one(spark, text.loop_coverage(F.lit("aaaa")))


def test_names_and_titles(spark):
    assert one(spark, text.tokens(F.lit("00:01:02 - [Talk] The, the x boss!"))) == ["the", "boss"]
    assert one(spark, text.display_name(F.lit("boss_rare.md"))) == "Boss Rare" and one(spark, text.slug(F.lit("  A b/C! "))) == "a-b-c"
    assert one(spark, text.clean_title(F.lit("short"), 10)) == "short"
    cut = one(spark, text.clean_title(F.lit("word " * 30), 50))
    assert len(cut) <= 50 and cut.endswith("word")


def test_links_and_marks(spark):
    assert [one(spark, text.is_homepage(F.lit(u))) for u in ("https://a.b/", "https://a.b", "https://a.b/c")] == [True, True, False]
    assert one(spark, text.cached_url(F.lit("https://cache.x/search?q=cache%3Ahttps%3A%2F%2Fa.b%2Fc"))) == "https://a.b/c"
    assert one(spark, text.escape_xml(F.lit("a<b>&"))) == "a&lt;b&gt;&amp;"
    assert one(spark, text.is_uncertain(F.lit("what [?]"), F.lit(None).cast("boolean"))) and not one(spark, text.is_uncertain(F.lit("x"), F.lit(False)))
    assert one(spark, text.hybrid_tokens(F.lit("กขabc กd x"))) == ["กขabc"]
    assert one(spark, text.video_id(F.lit("https://youtu.be/a-B_1?t=3"))) == "a-B_1"


def test_storyboard(spark):
    s = one(spark, clock.storyboard(F.lit(100.0)))
    assert (s.slide, s.sub, s.x, s.y) == (2, 1, 320, 0)
