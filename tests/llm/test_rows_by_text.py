"""The pipeline's filters judge rows that share an id, or have none, each by its own text."""

from attestor.llm import decontaminate, quality

GOOD, OTHER = (" ".join(f"{c}word{i}" for i in range(40)) for c in "ab")
ROWS = "doc_id long, text string"


def kept(df):
    return sorted((r["doc_id"] or 0, r["text"] or "") for r in df.collect())


def test_quality_keeps_clean_rows_of_a_rejected_id(spark):
    rows = [(None, GOOD), (None, "bad"), (None, None), (1, GOOD), (1, "bad"), (2, OTHER)]
    want = sorted([(0, GOOD), (1, GOOD), (2, OTHER)])
    assert kept(quality.keep_good(spark.createDataFrame(rows, ROWS))) == want
    named = spark.createDataFrame([(*r, None if r[0] else "en", "s") for r in rows], f"{ROWS}, lang string, source string")
    assert kept(quality.keep_good(named)) == want


def test_decontamination_keeps_clean_rows_of_a_leaking_id(spark):
    bench = spark.createDataFrame([(1, GOOD)], "item_id long, text string")
    rows = [(None, f"x {GOOD}"), (None, OTHER), (None, None), (1, f"x {GOOD}"), (1, OTHER)]
    assert kept(decontaminate.without_leaks(spark.createDataFrame(rows, ROWS), bench)) == sorted([(0, ""), (0, OTHER), (1, OTHER)])
