"""Of similar rows one stays, whatever their doc_ids."""

from tidemark.llm import overlap_join


def test_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (1, a), (None, a), (2, a), (None, b), (None, b), (7, c), (7, c), (8, None), (9, "")]
    out = overlap_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, a), (None, b), (7, c), (8, None), (9, "")], key=str)
