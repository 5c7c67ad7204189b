"""Every stage of the pipeline on awkward tables: none, null and repeated ids, empty texts, columns of clashing names."""

import random

import pytest

import corpus_pipeline

CLASHES = "found string, key string, hit_key string, hit_doc string, hit_text_key string, text_key string, tkey string, sid string, root string, bad_doc string, kept string, salt string, item string, seed string, spans string, leader_id string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
EXTRA = tuple("abcdefghijklmnop")


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    spark.createDataFrame([(1, "zero one two three four five six seven eight nine ten"), (None, None)], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at)


@pytest.mark.parametrize("k", range(5))
def test_empty_table(spark, folder, k):
    out = corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame([], SCHEMA), folder)
    assert out.count() == 0 and (k == 4 or out.columns == [c.split()[0] for c in SCHEMA.split(", ")])


def test_rows_are_judged_one_by_one(spark, folder):
    rng = random.Random(21)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    bad, secret = "la la la la la " * 30, f"{prose(rng, 30)} password = abcdefghijklmno {prose(rng, 30)}"
    leak = f"{prose(rng, 20)} Zero one two, three four five six seven eight nine ten! {prose(rng, 20)}"
    rows = [(None, a), (None, bad), (None, leak), (None, secret), (None, None), (1, a), (1, b), (1, b), (1, bad), (2, b), (2, leak), (3, ""), (3, c), (4, f"{d} end"), (4, secret), (5, d)]
    docs = spark.createDataFrame([(i, t, "en", None if i == 2 else "s", 1, *EXTRA) for i, t in rows], SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, df: sorted(((r["doc_id"] or 0, r["text"] or "") for r in stages[name](spark, df, folder).select(SCHEMA.split()[0], "text").collect()))
    listed = sorted((i or 0, t or "") for i, t in rows)
    poor = {bad, ""}
    assert run("quality", docs) == [x for x in listed if x[1] not in poor]
    assert run("decontamination", docs) == [x for x in listed if x[1] != leak]
    hidden = [(i, t.replace("password = abcdefghijklmno", "[SECRET]")) for i, t in listed]
    assert run("secrets", docs) == sorted(hidden)
    # rows with a null id stay; of the others one of each group
    kept = run("near_dedup", docs)
    assert [x for x in kept if x[0] == 0] == [x for x in listed if x[0] == 0]
    assert [x for x in kept if x[0]] == sorted([(1, a), (1, b), (1, bad), (2, leak), (3, ""), (3, c), (4, f"{d} end"), (4, secret)])
    for name in ("quality", "near_dedup", "decontamination", "secrets"):
        out = stages[name](spark, docs, folder)
        assert out.columns == docs.columns and {tuple(r)[5:] for r in out.collect()} == {EXTRA}
    assert stages["packing"](spark, docs, folder).count() == len(rows)


def test_whole_run_on_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_redaction_of_many_spans(spark):
    from attestor.llm import secrets

    text = " ".join(f"token{k}: password=abcdefghijkl{k:06d} filler" for k in range(1200))
    row = secrets.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["text"] == " ".join(f"token{k}: [SECRET] filler" for k in range(1200))
    assert secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["n_assign"] == 1200
