"""A project through the command line and its Python face: retries, recorded answers, exports, comparison, purge."""

import json
import random

import pytest

from attestor import cli
from attestor.errors import BackendError, ValidationError
from attestor.functions import hashing
from attestor.operators import coding, scoring
from attestor.plans.project import Project
from attestor.sources import corpus, files, stores

BOOK = "version: 1\ncodes:\n  is_yes:\n    definition: Says yes.\n  is_long:\n    definition: Is long.\n"


def yes(text, code):
    return 0.97 if (text.endswith("yes") if code == "is_yes" else "x" in text) else 0.02


def gold_rows(plan, truth, codes=("is_yes",)):
    return [{"item_id": r["item_id"], "code_id": c, "label": truth[r["item_id"]], "coder": "c1", "timestamp": stores.now(), "split": r["split"], "stratum": r["stratum"], "inclusion_probability": r["inclusion_probability"], "model_visible": False} for r in plan for c in codes]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A project with gold, and the recorded answers of its corpus."""
    root = tmp_path_factory.mktemp("project")
    rng = random.Random(3)
    truth = {f"t{i}": int(rng.random() < 0.4) for i in range(300)}
    (root / "in.csv").write_text("id,text\n" + "".join(f"{k},text number {k} {'yes' if v else 'no'}\n" for k, v in truth.items()))
    at = str(root / "p")
    assert cli.main(["--project", at, "--json", "init"], spark) == 0
    (root / "p" / "codebook.yml").write_text(BOOK)
    assert cli.main(["--project", at, "--json", "load", str(root / "in.csv"), "--id-col", "id"], spark) == 0
    p = Project(spark, at)
    p.gold().append(gold_rows(p.plan_gold(n=240).collect(), truth))
    table = {hashing.sha_of("item", r["text"]): {c: yes(r["text"], c) for c in ("is_yes", "is_long")} for r in p.items().collect()}
    (root / "recorded.json").write_text(json.dumps({"model_version": "rec-7", "probabilities": table}))
    return p, str(root / "recorded.json")


def test_commands(spark, made, capsys, monkeypatch):
    p, recorded = made
    go = lambda *args: cli.main(["--project", p.root, "--json", *args], spark)
    said = lambda: json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert go("init") != 0 and said()["ok"] is False
    assert go("splits", "show") == 0 and sum(said()["data"].values()) == 300
    assert go("codebook", "check") == 0 and set(said()["data"]["codes"]) == {"is_yes", "is_long"}
    assert go("run") != 0  # no calibration yet
    assert go("check") != 0 and said()["error"] == "BackendError"  # the recorded backend without a table
    assert go("check", "--recorded", recorded, "--resamples", "20") == 0
    rows = {r["code_id"]: r for r in said()["data"]}
    assert rows["is_yes"]["verdict"] == "ok" and rows["is_yes"]["kappa_lo"] <= 1 <= rows["is_yes"]["kappa_hi"] + 1e-9
    # a code that nobody judged stays in the table
    assert rows["is_long"]["verdict"] == "INSUFFICIENT_EVIDENCE" and rows["is_long"]["n_gold"] == 0 and "no scored gold" in rows["is_long"]["advice"]
    assert go("try", "--n", "5", "--recorded", recorded) == 0 and len(said()["data"]) == 10
    assert go("run", "--recorded", recorded, "--yes") == 0 and said()["data"] == 600
    note = p.manifest()
    assert note["model"] == "rec-7" and note["item_count"] == 300 and note["failures"] == 0 and note["cache_hits"] + note["cache_misses"] == 600
    assert go("run", "--codes", "is_yes", "--recorded", recorded, "--yes") == 0 and said()["data"] == 600
    keys = iter("yq")
    monkeypatch.setattr("builtins.input", lambda _: next(keys))
    assert go("gold", "--n", "30", "--coder", "c2") == 0 and said()["data"] == 1
    assert go("export", "--resamples", "20") == 0
    paths = said()["data"]
    text = files.read_text(spark, paths["report"])
    assert all(x in text for x in ("## Selective agreement", "## Reliability against labour", "rec-7", "cells human"))
    assert spark.read.csv(paths["coded"], header=True).count() == 300
    assert go("compare", "--backends", "recorded", "--recorded", recorded, "--resamples", "0", "--yes") == 0 and said()["data"][0]["usable"] == 1
    assert go("purge", "--gold") != 0
    assert go("purge", "--review", "--cache", "--yes") == 0 and stores.read_cache(spark, p.path("state", "cache")).isEmpty()
    assert not p.gold().read().isEmpty()


def test_retry_keeps_what_was_scored(spark, tmp_path):
    rng = random.Random(5)
    truth = {f"t{i}": int(rng.random() < 0.4) for i in range(300)}
    (tmp_path / "in.csv").write_text("id,text\n" + "".join(f"{k},text number {k} {'yes' if v else 'no'}\n" for k, v in truth.items()))
    p = Project.create(spark, str(tmp_path / "p"))
    files.write_text(spark, p.path("codebook.yml"), BOOK.split("  is_long")[0])
    p.load(str(tmp_path / "in.csv"), id_column="id")
    p.gold().append(gold_rows(p.plan_gold(n=240).collect(), truth))
    broken = scoring.CallableBackend(name="x", function=lambda t, c: 1 / 0 if "number t7" in t else yes(t, c))
    sound = scoring.CallableBackend(name="x", function=lambda t, c: None if "number t77 " in t else yes(t, c))
    p.check(sound, strict=False)
    stores.write_cache(stores.read_cache(spark, p.path("state", "cache")).limit(0), p.path("state", "cache"))
    with pytest.raises(ValidationError):
        p.run(sound, retry_failed=True)
    p.run(broken, approved=True)
    failed = {r["item_id"] for r in scoring.failed(p.scores("run")).collect()}
    assert failed == {k for k in truth if k.startswith("t7")} and p.manifest()["errors"] == {"ZeroDivisionError": len(failed)}
    before = {r["item_id"]: r["probability"] for r in p.scores("run").collect()}
    p.run(sound, retry_failed=True, approved=True)
    after = {r["item_id"]: r["probability"] for r in p.scores("run").collect()}
    assert len(after) == 300 and {k: v for k, v in after.items() if k not in failed} == {k: v for k, v in before.items() if k not in failed}
    assert {k for k, v in after.items() if v is None} == {"t77"} and p.manifest()["calls"] == len(failed)
    assert {r["source"]: r["n"] for r in coding.counts_by_source(p.decisions()).collect()}["abstain_unreviewed"] <= 1
    assert stores.new_run_id() != stores.new_run_id()


def test_recorded_backend_needs_a_table_and_every_answer(spark, tmp_path):
    with pytest.raises(BackendError):
        scoring.backend("recorded")
    with pytest.raises(BackendError):
        stores.read_recorded(spark, str(tmp_path / "none.json"))
    texts = spark.createDataFrame([("h", "text", ["a", "b"])], "text_hash string, text string, code_ids array<string>")
    known = spark.createDataFrame([("h", "a", 0.25)], "item_hash string, code_id string, probability double")
    lenient = scoring.backend("recorded", recorded=known, strict=False)
    assert {r["code_id"]: r["scored"] for r in lenient.scored(texts, [], 1).collect()} == {"a": 0.25, "b": None}
    with pytest.raises(Exception, match="no recorded answer"):
        scoring.backend("recorded", recorded=known).scored(texts, [], 1).collect()


def test_ordinals_follow_reading_order_over_many_partitions(spark):
    rows = spark.range(0, 1000, 1, 7).selectExpr("CAST(id AS STRING) AS id", "concat('text ', id) AS text")
    got = corpus.build_items(rows).orderBy("ord").collect()
    assert [(r["ord"], r["id"]) for r in got] == [(i + 1, str(i)) for i in range(1000)] and got[0]["item_id"] == "row_0001"


def test_corpus_hash_streams_sorted_ranges(spark):
    rows = [hashing.sha_of("item", str(i)) for i in range(50)] + [hashing.sha_of("item", "7")]
    df = spark.createDataFrame([(r,) for r in rows], "item_hash string").repartition(5)
    import hashlib

    assert hashing.corpus_hash(df).first()[0] == hashlib.sha256(b"6:corpus" + b"".join(b"64:" + r.encode() for r in sorted(rows))).hexdigest()
