"""Streams against the same rows read at once; small parsers and digests."""

import hashlib

import pytest
from pyspark.sql import functions as F

from attestor.errors import ValidationError
from attestor.functions import hashing
from attestor.operators import gold
from attestor.sources import files, settings, stores
from attestor.streaming import coder


def test_the_last_judgement_of_each_window(spark, tmp_path):
    rows = [("i", "c", "a", 1, "2024-01-01 10:00:00"), ("i", "c", "a", 0, "2024-01-01 12:00:00"), ("i", "c", "a", 0, "2024-01-01 12:00:00"), ("i", "c", "b", 1, "2024-01-01 11:00:00"), ("i", "c", "a", 1, "2024-01-03 09:00:00"), ("z", "c", "a", 1, "2024-02-01 00:00:00")]
    log = spark.createDataFrame(rows, "item_id string, code_id string, coder string, label int, t string").select("item_id", "code_id", "coder", "label", F.to_timestamp("t").alias("timestamp"))
    log.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # started again, it writes nothing twice
        coder.drained(coder.latest_judgements(stream), str(tmp_path / "out"), str(tmp_path / "progress"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["coder"], r["label"], r["at"].day) for r in got.collect() if r["item_id"] == "i") == [("a", 0, 1), ("a", 1, 3), ("b", 1, 1)]
    last = gold.latest(got.withColumn("seq", F.unix_timestamp("at")), "item_id", "code_id", "coder")
    assert {(r["coder"], r["label"]) for r in last.collect() if r["item_id"] == "i"} == {("a", 1), ("b", 1)}


def test_appended_rows_are_numbered(spark, tmp_path):
    log = stores.review_log(spark, str(tmp_path / "log"))
    log.append([{"item_id": "a", "code_id": "c", "coder": "x", "label": 1, "timestamp": "1"}])
    log.append(spark.createDataFrame([("b", "c", 0, "x", "2"), ("a", "c", 0, "x", "3")], "item_id string, code_id string, label int, coder string, timestamp string"))
    assert [(r["seq"], r["item_id"], r["label"]) for r in log.read().orderBy("seq").collect()] == [(1, "a", 1), (2, "b", 0), (3, "a", 0)]
    with pytest.raises(ValidationError):
        log.append([{"item_id": "a", "code_id": "c", "label": 2}])


def test_digests_and_small_parsers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x").write_bytes(b"abc")
    assert files.digest(spark, str(tmp_path / "d" / "x")) == hashlib.sha256(b"abc").hexdigest()
    before = files.digest(spark, str(tmp_path / "d"))
    (tmp_path / "d" / "x").write_bytes(b"abd")
    assert files.digest(spark, str(tmp_path / "d")) != before
    for bad in ("splits: {dev: x}", "splits: [1]", "engine: {concurrency: 1.5}", "engine: {concurrency: true}", "corpus: {path: 3}", "gold: {n: null}"):
        with pytest.raises(ValidationError):
            settings.parse_settings(f"version: 1\n{bad}")
    assert settings.parse_settings("version: 1\nengine: {price_per_million_input: 2}").engine.price_per_million_input == 2
    (tmp_path / ".env").write_text("# x\nexport ATTESTOR_API_KEY='k'\nATTESTOR_PLACE=here\n")
    assert settings.load_env(str(tmp_path / ".env")) == ["ATTESTOR_API_KEY (secret)", "ATTESTOR_PLACE"]
    assert hashing.strip_volatile("a\nGenerated: now\nb") == "a\nb"
