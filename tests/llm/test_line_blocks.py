"""Boilerplate goes whatever stands around it."""

from tidemark.llm import line_spread


def test_blocks_and_separated_lines_go(spark):
    block = "licence one\nlicence two\nlicence three"
    rows = [(k, f"body {k}\n{block}\nmore {k}\n\nalone\n\nend {k}\nlast one\nlast two", f"s{k}") for k in range(9)]
    copied = "copied one\ncopied two\ncopied three"
    rows += [(100 + k, copied, f"s{k}") for k in range(12)] + [(200, block, "s1")]
    out = line_spread.strip(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {k: f"body {k}\nmore {k}\n\n\nend {k}" for k in range(9)} | {100 + k: copied for k in range(12)} | {200: ""}
