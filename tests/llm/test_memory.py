"""What the pipeline's stages leave in Python workers, which Spark keeps while later stages need the memory."""

import pyarrow as pa

from attestor.llm import packing

import corpus_pipeline


def test_workers_hold_little_between_stages(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(spark.sparkContext.environment, "ATTESTOR_WORKERS_OF", "test_memory")  # workers of its own

    def held(batches):
        import os

        from attestor.llm import anchors, tokens

        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([len(anchors._CACHED)]), pa.array([len(tokens._ENCODERS)])], ["pid", "powers", "encoders"])

    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.range(40).selectExpr("id AS doc_id", f"concat('{words} ', id) AS text").repartition(8)
    spark.createDataFrame([(1, words)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    left = {}
    for name in ("packing", "decontamination", "near_dedup"):
        stages[name](spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        rows = spark.range(64).repartition(16).mapInArrow(held, "pid long, powers long, encoders long").collect()
        left[name] = [sum(r[c] for r in rows) for c in ("powers", "encoders")]
    assert left["packing"][1] > 0  # an encoder stays for the next task that encodes
    assert left["decontamination"][0] == left["near_dedup"][0] == 0 and left["near_dedup"][1] == 0


def test_plan_of_packing_starts_no_python(spark):
    pieces = spark.createDataFrame([(i, 0, 0, 5 + i % 7, i) for i in range(50)], packing.PIECES)
    pieces.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/pieces-of-test")
    placed = packing.pack(spark.read.parquet(path))
    assert placed.count() == 50
    assert "ExistingRDD" not in placed._jdf.queryExecution().toString()
