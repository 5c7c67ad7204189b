"""Benchmark items of fewer words than a tile are found where they stand whole."""

from attestor.llm import decontaminate


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "Alpha, beta gamma!"), (2, "delta"), (3, "?!"), (4, "w1 w2 w3 w4"), (5, "w1 w2 w3 w4 w5")], "item_id long, text string")
    rows = [(1, "x alpha beta GAMMA y"), (2, "alpha beta x gamma"), (3, "delta"), (4, "w1 w2 w3 w4"), (5, "a w1 w2 w3 w4 w5 b delta"), (6, "deltas"), (7, None)]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(got) == {(1, 1), (3, 2), (4, 4), (5, 4), (5, 5), (5, 2)}
    assert all(r["coverage"] == 1 and r["tiles"] == 1 for r in got.values())
