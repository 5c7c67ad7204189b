import io
import json
import math
import random
import urllib.error

import pytest
from pyspark.sql import functions as F

from attestor.errors import BackendError, BudgetRefused, DriftError, ProjectError, SplitViolation, ValidationError
from attestor.functions import hashing, stats
from attestor.operators import coding, drift, gold, scoring, selective, splits, thresholds, units
from attestor.plans.check import Sealed
from attestor.plans.project import Project, code_tasks
from attestor.sources import corpus, settings, stores


def gs(spark, rows, code="c"):
    return spark.createDataFrame([(code, str(i), "test", float(p), int(g), float(w)) for i, (p, g, w) in enumerate(rows)], "code_id string, item_id string, split string, p double, g int, w double")


@pytest.mark.parametrize(("cells", "kappa"), [((50, 0, 0, 50), 1), ((0, 50, 50, 0), -1), ((25, 25, 25, 25), 0), ((45, 5, 5, 45), 0.8), ((1, 1, 1, 97), 0.489796), ((0, 0, 0, 100), None), ((1, 0, 0, 0), None), ((0, 1, 0, 0), 0), ((0, 0, 0, 0), None)])
def test_kappa_table(spark, cells, kappa):
    row = spark.createDataFrame([tuple(map(float, cells))], "a double, b double, c double, d double").select(stats.kappa().alias("k"), stats.kappa_reason().alias("r")).first()
    assert (row["k"] is None and row["r"]) if kappa is None else row["k"] == pytest.approx(kappa, abs=1e-6)


@pytest.mark.parametrize(("alpha", "share", "n"), [(0.05, 0.05, 59), (0.05, 0.025, 72), (0.10, 0.05, 29), (0.02, 0.05, 149)])
def test_minimum_accepted(alpha, share, n):
    assert stats.minimum_accepted(alpha, share) == n


def test_binomial_tail(spark):
    cases = [(e, n) for n in (1, 7, 60, 400) for e in (0, 1, 5, n) if e <= n]
    df = spark.createDataFrame(cases, "e int, n int").select("e", "n", stats.binomial_cdf("e", "n", 0.1).alias("p"))
    for r in df.collect():
        want = sum(math.comb(r["n"], k) * 0.1**k * 0.9 ** (r["n"] - k) for k in range(r["e"] + 1))
        assert r["p"] == pytest.approx(min(1, want), rel=1e-9)


def test_candidate_weights_sum_to_one():
    assert sum(thresholds.candidate_weights(15)) == 1 and thresholds.candidate_weights(1) == [1.0]


def test_bad_coders_never_certify_and_a_sharp_one_does(spark):
    rng = random.Random(1)
    truth = [int(rng.random() < 0.3) for _ in range(600)]
    coders = {"negative": [0.01] * 600, "positive": [0.99] * 600, "random": [rng.random() for _ in truth], "sharp": [0.97 if t else 0.03 for t in truth]}
    frame = None
    for code, ps in coders.items():
        part = gs(spark, [(p, t, 1.0) for p, t in zip(ps, truth, strict=True)], code)
        frame = part if frame is None else frame.unionByName(part)
    got = {r["code_id"]: r for r in thresholds.fit(frame, alpha=0.05).collect()}
    assert [got[c]["verdict"] for c in ("negative", "positive", "random", "sharp")] == ["NOT_AUTOMATABLE"] * 3 + ["ok"]
    # coverage is equal, so the widest valid band wins: the k-th narrowest has a share of 0.05 / 2^k
    n = sum(truth)
    k = max(k for k in range(1, 15) if 0.95**n <= 0.05 / 2**k)
    assert got["sharp"]["t_hi"] == sorted(thresholds.UPPER)[k - 1]


def test_fifteen_raw_positives_are_needed(spark):
    few = gs(spark, [(0.99, 1, 9.0)] * 14 + [(0.01, 0, 1.0)] * 200)
    row = thresholds.fit(few).first()
    assert row["verdict"] == "INSUFFICIENT_EVIDENCE" and row["t_hi"] is None


def test_grading(spark):
    fitted = thresholds.fit(gs(spark, [(0.99, 1, 1.0)] * 100 + [(0.01, 0, 1.0)] * 100))
    for k, verdict in ((0.9, "ok"), (0.72, "weak"), (0.5, "NOT_AUTOMATABLE"), (None, "INSUFFICIENT_EVIDENCE")):
        assert thresholds.grade(fitted, spark.createDataFrame([("c", k)], "code_id string, kappa double")).first()["verdict"] == verdict


def test_empty_and_null_inputs(spark):
    empty = gs(spark, [])
    assert thresholds.fit(empty).count() == 0 and selective.selective_curve(empty).count() == 0 and selective.bootstrap(empty.withColumn("d", F.lit(1)), n_resamples=3).count() == 0


def test_weights_alike_equal_no_weights(spark):
    base = [(0.9, 1, 1.0), (0.1, 0, 1.0), (0.8, 0, 1.0), (0.2, 1, 1.0)] * 30
    one, two = (thresholds.candidates(gs(spark, [(p, g, w * f) for p, g, w in base])).orderBy("band_id").select("coverage", "pos_p", "neg_p", "valid").collect() for f in (1, 3))
    for a, b in zip(one, two, strict=True):
        assert a["coverage"] == pytest.approx(b["coverage"]) and a["pos_p"] == pytest.approx(b["pos_p"]) and a["valid"] == b["valid"]


def test_splits_are_exact_and_scale_free(spark):
    items = spark.range(1000).select(F.col("id").cast("string").alias("item_id"))
    one = splits.assign_splits(items)
    assert {r["split"]: r["n"] for r in splits.split_counts(one).collect()} == {"dev": 100, "calibration": 450, "test": 450}
    many = splits.assign_splits(items.orderBy(F.desc("item_id")), one_task=10)
    assert one.exceptAll(many.select(one.columns)).isEmpty()
    with pytest.raises(ProjectError):
        splits.assign_splits(items.union(items))
    with pytest.raises(ProjectError):
        splits.assign_splits(items.limit(0))
    with pytest.raises(SplitViolation):
        splits.require_split(items, one, "test")


def test_hashing_matches_hashlib(spark):
    df = spark.createDataFrame([("  Ünḯ\r\ncode \t x \n\n\n\ny ",)], "text string")
    row = df.select(hashing.normalise_text(F.col("text")).alias("t"), hashing.item_hash(hashing.normalise_text(F.col("text"))).alias("h")).first()
    assert row["t"] == "Ünḯ\ncode x\n\ny" and row["h"] == hashing.sha_of("item", row["t"])


def test_chunks():
    text = "\n\n".join(f"Paragraph {i}. " + "word " * 60 for i in range(12))
    got = units.chunk_text(text, max_tokens=256, overlap_tokens=20)
    assert len(got) > 1 and all(f"Paragraph {i}." in "".join(got) for i in range(12))
    assert units.chunk_text("", max_tokens=10) == [] and units.chunk_text(" a ", max_tokens=10) == ["a"]
    assert all(len(c) <= 40 for c in units.chunk_text("x" * 500, max_tokens=10))
    with pytest.raises(ValueError):
        units.chunk_text("a", max_tokens=5, overlap_tokens=5)


def test_codebook_and_settings_are_strict():
    book = settings.parse_codebook("version: 1\ncodes:\n  one_code:\n    definition: A  thing.\n    examples_yes: [yes it is]\n")
    assert book.ids == ["one_code"] and book.codes[0].hash == hashing.code_hash("A thing.", ["yes it is"], [])
    for bad in ("version: 2\ncodes: {abc: {definition: x}}", "version: 1\ncodes: {A: {definition: x}}", "version: 1\ncodes: {abc: {definition: x}, abc: {definition: y}}", "version: 1\ncodes: {abc: {definition: x, type: score}}", "version: 1\ncodes: {abc: {definition: x, what: 1}}"):
        with pytest.raises(ValidationError):
            settings.parse_codebook(bad)
    for bad in ("version: 1\nsplits: {dev: 0.9}", "version: 1\nnope: {}", "version: 1\nengine: {concurrency: 0}", "version: 1\nchunking: {aggregation: sum}"):
        with pytest.raises(ValidationError):
            settings.parse_settings(bad)
    assert settings.parse_settings(settings.settings_template()) == settings.Settings()


def test_backend_contract():
    asked = [scoring.Question(c, "d" * 400) for c in "abc"]
    assert [[q.code_id for q in r] for r in scoring.split_codes("t", asked, 250)] == [["a", "b"], ["c"]]
    assert len(scoring.split_codes("t" * 2000, asked, 250)) == 3
    for bad in (True, "x", 1.5, float("nan")):
        with pytest.raises(BackendError):
            scoring.checked(bad, "a")
    assert scoring.CallableBackend(function=lambda t, c: 1 / 0).score("t", asked) == {"a": None, "b": None, "c": None}
    waits, replies = [], [urllib.error.HTTPError("u", 429, "", {"Retry-After": "2"}, None), io.BytesIO(b'{"x": 1}')]

    def opener(_):
        r = replies.pop(0)
        if isinstance(r, Exception):
            raise r
        return r

    assert scoring.post_json("http://u", {}, sleep=waits.append, opener=opener) == {"x": 1} and 1 <= waits[0] < 3
    replies.append(urllib.error.HTTPError("u", 400, "", {}, None))
    with pytest.raises(BackendError):
        scoring.post_json("http://u", {}, sleep=waits.append, opener=opener)


def test_chat_backend_reports_the_probability_of_yes(monkeypatch):
    b = scoring.ChatBackend(url="u")
    monkeypatch.setattr(scoring, "post_json", lambda *a, **k: {"choices": [{"logprobs": {"content": [{"token": " false", "logprob": math.log(0.9)}]}}]})
    assert b.score("t", [scoring.Question("a", "d")])["a"] == pytest.approx(0.1)
    assert scoring.ChatBackend.decisions('{"a": true, "b": "no"}', [scoring.Question("a", ""), scoring.Question("b", "")]) == {"a": True, "b": None}


def test_cost_and_drift_gates(spark):
    cost = drift.estimate_cost(spark.createDataFrame([("abcd" * 10,)] * 600, "text string"), 2, 50)
    with pytest.raises(BudgetRefused):
        drift.require_confirmation(cost, approved=False)
    drift.require_confirmation(cost, approved=True)
    change = drift.code_drift(spark.createDataFrame([("a", "1")], "code_id string, code_hash string"), spark.createDataFrame([("a", "2")], "code_id string, code_hash string"))
    with pytest.raises(DriftError):
        drift.require_no_drift(change, [])


def test_sealed_rows():
    s = Sealed([1, 2, 3])
    for look in (lambda: s.count(), lambda: s[0], lambda: len(s), lambda: list(s), lambda: bool(s), lambda: s.unseal("fitting")):
        with pytest.raises(PermissionError):
            look()
    assert s.unseal("reporting") == [1, 2, 3] and s.log == ["reporting"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text,note\n1,"two\nlines ""q""",\n2,plain,x\n')
    got = corpus.load_corpus(spark, str(tmp_path / "a.csv"), id_column="id").orderBy("ord").collect()
    assert [(r["item_id"], r["text"], r["note"]) for r in got] == [("1", 'two\nlines "q"', ""), ("2", "plain", "x")]
    (tmp_path / "b.jsonl").write_text('{"text": "a"}\n\n{"text": "b"}\n')
    assert [r["item_id"] for r in corpus.load_corpus(spark, str(tmp_path / "b.jsonl")).orderBy("ord").collect()] == ["row_1", "row_2"]
    (tmp_path / "c.jsonl").write_text('{"text": "a"}\n[1]\n')
    with pytest.raises(ValidationError, match=":2:"):
        corpus.load_corpus(spark, str(tmp_path / "c.jsonl"))
    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "x.txt").write_text("hello")
    (folder / "y.MD").write_text("there")
    (folder / "z.bin").write_text("no")
    assert {r["id"]: r["text"] for r in corpus.read_folder(spark, str(folder)).collect()} == {"x": "hello", "y": "there"}
    (tmp_path / "d.csv").write_text("id,text\n1,\n")
    with pytest.raises(ValidationError):
        corpus.load_corpus(spark, str(tmp_path / "d.csv"))


def test_reviews_override_gold(spark):
    log = spark.createDataFrame([("i", "c", "x", 1, 1, "test", 1.0), ("i", "c", "y", 0, 2, "test", 1.0), ("i", "c", "x", 1, 3, "test", 1.0)], "item_id string, code_id string, coder string, label int, seq long, split string, inclusion_probability double")
    assert gold.human_labels(log).first()["label"] == 0  # y was first written last
    review = spark.createDataFrame([("i", "c", 1, 1)], "item_id string, code_id string, label int, seq long")
    assert gold.human_labels(log, review).first()["label"] == 1


def test_project_end_to_end(spark, tmp_path):
    rng = random.Random(3)
    truth = {f"t{i}": int(rng.random() < 0.4) for i in range(400)}
    (tmp_path / "in.csv").write_text("id,text\n" + "".join(f"{k},text number {k} {'yes' if v else 'no'}\n" for k, v in truth.items()))
    p = Project.create(spark, str(tmp_path / "p"))
    (tmp_path / "p" / "codebook.yml").write_text("version: 1\ncodes:\n  is_yes:\n    definition: Says yes.\n")
    assert p.load(str(tmp_path / "in.csv"), id_column="id")["n"] == 400
    plan = p.plan_gold(n=300).collect()
    p.gold().append([{"item_id": r["item_id"], "code_id": "is_yes", "label": truth[r["item_id"]], "coder": "c1", "timestamp": stores.now(), "split": r["split"], "stratum": r["stratum"], "inclusion_probability": r["inclusion_probability"], "model_visible": False} for r in plan])
    scorer = scoring.CallableBackend(name="recorded", function=lambda t, c: 0.97 if t.endswith("yes") else 0.02)
    rows = p.check(scorer, resamples=20)
    assert rows[0]["verdict"] == "ok" and rows[0]["kappa"] == 1.0
    assert p.run(scorer, approved=True).count() == 400
    sources = {r["source"]: r["n"] for r in coding.counts_by_source(p.decisions()).collect()}
    assert sources["human"] == 300 and sources["auto"] == 100
    paths = p.export()
    assert spark.read.csv(paths["coded"], header=True).count() == 400 and "is_yes" in open(paths["report"]).read()
    assert stores.read_cache(spark, p.path("state", "cache")).columns == ["key", "probability", "created_at", "input_tokens"]


def test_session_keys():
    keys = iter("ynb?q")
    got = code_tasks([{"item_id": str(i), "code_id": "c", "text": "t", "probability": 0.5} for i in range(9)], ask=lambda _: next(keys))
    assert [(g["item_id"], g["label"]) for g in got] == [("0", 1)]


def test_stata_sink(spark, tmp_path):
    import pandas as pd

    stores.write_table(spark.createDataFrame([(1, "a", None), (2, None, 0.5)], "a.b int, s string, d double".replace("a.b", "`a.b`")), str(tmp_path / "x.dta"), "stata")
    assert list(pd.read_stata(tmp_path / "x.dta").columns) == ["a_b", "s", "d"]


def test_envelopes():
    from attestor.plans import report

    assert json.loads(report.error_envelope("run", DriftError("x", hint="h")))["exit_code"] == 4
    assert "1 of 1 codes usable" in report.check_table([{"code_id": "a", "verdict": "ok", "kappa": 0.9, "coverage": 0.5, "reason": None}])
