"""A project folder and the commands on it: load, split, gold, check, run, review, export, compare, purge."""

from __future__ import annotations

import json
import platform
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotCertified, ProjectError, ValidationError
from ..functions.hashing import corpus_hash
from ..operators import coding, drift, gold, sampling, scoring, splits, units
from ..sources import corpus, files, settings, stores
from . import check as checks
from . import report


class Project:
    """settings.yml and codebook.yml at the top; splits, logs, cache, calibration and runs under state/; results under out/.

    The folder may lie on any file system that Spark writes to; driver and executors must share it.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        if not files.exists(spark, self.path("settings.yml")):
            raise ProjectError(f"no project in {root}", hint="init")
        self.settings = settings.parse_settings(self._text("settings.yml"))

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _text(self, name: str) -> str:
        return files.read_text(self.spark, self.path(name))

    @classmethod
    def create(cls, spark: SparkSession, root: str, *, backend: str = "recorded", force: bool = False) -> Project:
        root = root.rstrip("/")
        if files.exists(spark, f"{root}/settings.yml") and not force:
            raise ProjectError(f"{root} holds a project already", hint="--force")
        files.write_text(spark, f"{root}/settings.yml", settings.settings_template().replace("name: recorded", f"name: {backend}"))
        if not files.exists(spark, f"{root}/codebook.yml"):
            files.write_text(spark, f"{root}/codebook.yml", "version: 1\ncodes:\n  example_code:\n    definition: Replace this by what the category means.\n")
        return cls(spark, root)

    def codebook(self, ids: list[str] | None = None) -> settings.Codebook:
        book = settings.parse_codebook(self._text("codebook.yml"))
        return book.subset(ids) if ids else book

    def items(self) -> DataFrame:
        return self.spark.read.parquet(self.path("state", "items"))

    def splits(self) -> DataFrame:
        """The frozen assignment, provided that the corpus is the one that was split."""
        found, note = stores.load_splits(self.spark, self.path("state", "splits"))
        stores.require_corpus(note, self._corpus_hash())
        return found

    def _corpus_hash(self) -> str:
        """Computed once for the items as they are written; load() removes the note."""
        note = self.path("state", "items.json")
        if not files.exists(self.spark, note):
            files.write_json(self.spark, note, {"version": 1, "corpus_hash": corpus_hash(self.items()).first()[0]})
        return files.read_json(self.spark, note)["corpus_hash"]

    def gold(self) -> stores.Log:
        return stores.gold_log(self.spark, self.path("state", "gold"))

    def reviews(self) -> stores.Log:
        return stores.review_log(self.spark, self.path("state", "review"))

    # -- commands -----------------------------------------------------------------

    def load(self, source: str, *, text_column: str = "text", id_column: str | None = None) -> dict:
        if files.exists(self.spark, self.path("state", "splits")):
            raise ProjectError("the corpus is frozen", hint="splits reset")
        items = corpus.load_corpus(self.spark, source, text_column=text_column, id_column=id_column)
        items.write.mode("overwrite").parquet(self.path("state", "items"))
        files.delete(self.spark, self.path("state", "items.json"))
        files.write_json(self.spark, self.path("state", "source.json"), {"version": 1, "corpus_path": source, "corpus_file_hash": files.digest(self.spark, source)})
        s = self.settings.splits
        shares = {"dev": s.dev, "calibration": s.calibration, "test": s.test}
        made = splits.assign_splits(self.items(), seed=s.seed, **shares)
        stores.save_splits(made, self.path("state", "splits"), seed=s.seed, corpus_hash=self._corpus_hash(), fractions=shares)
        return corpus.length_stats(self.items()).first().asDict()

    def reset_splits(self) -> None:
        for name in ("splits", "items", "splits.json", "items.json", "calibration.json"):
            files.delete(self.spark, self.path("state", name))

    def plan_gold(self, *, n: int | None = None, overlap: int = 0, code: str | None = None) -> DataFrame:
        """Uniform samples of both certified splits; for a rare code also its likely positives."""
        s, found = self.settings, self.splits()
        sizes = dict(zip(("calibration", "test"), sampling.allocation(n or s.gold.n, s.splits.calibration, s.splits.test), strict=True))
        plans = []
        for split, size in sizes.items():
            ids = splits.of_split(found, split)
            if code is None:
                plans.append(sampling.plan_uniform(ids, min(size, ids.count()), split=split, seed=s.splits.seed))
                continue
            had = self.gold().read().where(F.col("split") == split).select("item_id").distinct()
            base, take = sampling.enrich_settings(had.count(), ids.count(), size)
            p = self.scores("run").join(ids.select("item_id"), "item_id", "left_semi").where(F.col("code_id") == code).select("item_id", F.col("probability").alias("p"))
            plans.append(sampling.plan_enriched(sampling.enrichment_pool(p), had, take, split=split, seed=s.splits.seed, base_inclusion=base, code_id=code))
        plan = plans[0].unionByName(plans[1])
        return sampling.plan_overlap(plan, overlap, seed=s.splits.seed) if overlap else plan

    def latest(self, purpose: str) -> str:
        run = stores.latest_run(self.spark, self.path("state", "runs"), purpose)
        if run is None:
            raise ProjectError("nothing has been scored yet", hint="run")
        return run

    def scores(self, purpose: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.latest(purpose)}/scores")

    def manifest(self, purpose: str = "run") -> dict:
        return files.read_json(self.spark, f"{self.latest(purpose)}/manifest.json")

    def score(self, ids: DataFrame | None, scorer: scoring.Backend, *, purpose: str, codes: list[str] | None = None, approved: bool = True, over: str | None = None, cache: str = "cache") -> DataFrame:
        """Score the given items (all if none are) by cache and backend; saves the run, laid over the run `over` if one is named."""
        s, book, began = self.settings, self.codebook(codes), time.time()
        items = self.items() if ids is None else corpus.subset(self.items(), ids)
        passages = units.build_units(items, max_tokens=s.chunking.max_tokens, overlap_tokens=s.chunking.overlap_tokens)
        asked = sum(len(" ".join((c.definition, *c.examples_yes, *c.examples_no))) // 4 + 1 for c in book.codes)
        planned = drift.estimate_cost(passages, len(book.codes), asked, s.engine.price_per_million_input, s.engine.price_per_million_output)
        drift.require_confirmation(planned, approved=approved, budget=s.engine.budget_usd, above_calls=s.engine.confirm_above_calls)
        where, run_id = self.path("state", cache), stores.new_run_id()

        def written(df: DataFrame, label: str) -> DataFrame:
            path = self.path("state", "runs", run_id, label)
            df.write.mode("overwrite").parquet(path)
            return self.spark.read.parquet(path)

        table = book.table(self.spark)
        done = scoring.run(self.spark, items, table, scorer, stores.read_cache(self.spark, where), written=written, max_tokens=s.chunking.max_tokens, overlap_tokens=s.chunking.overlap_tokens, rule=s.chunking.aggregation, concurrency=s.engine.concurrency)
        scores = written(scoring.merged(self.spark.read.parquet(f"{over}/scores"), done.scores) if over else done.scores, "merged")
        usage, stats = done.usage.first(), done.stats.first()
        models = {r["model"]: r["cells"] for r in done.models.collect()}
        tokens_out = drift.OUTPUT_TOKENS * usage["texts"]
        prices = (s.engine.price_per_million_input, s.engine.price_per_million_output)
        failures = scoring.failed(scores)
        note = {
            "run_id": run_id, "created_at": stores.now(), "purpose": purpose, "over": over, "backend": scorer.name,
            "model": scorer.model_version, "models": models, "codebook_hash": book.hash, "code_hashes": {c.code_id: c.hash for c in book.codes}, "settings": s.fingerprint(),
            "corpus_hash": self._corpus_hash(), **{k: v for k, v in files.read_json(self.spark, self.path("state", "source.json")).items() if k != "version"}, "splits_seed": s.splits.seed, "chunking": s.fingerprint(), "item_count": items.count(),
            "code_count": len(book.codes), "unit_count": stats["lookups"] // max(1, len(book.codes)), "calls": usage["texts"], "input_tokens": usage["input_tokens"],
            "output_tokens": tokens_out, "cost_usd": None if None in prices else (usage["input_tokens"] * prices[0] + tokens_out * prices[1]) / 1e6, "failures": failures.count(),
            "failed_cells": usage["failed"], "errors": {r["error"]: r["cells"] for r in done.errors.collect()}, "cache_hits": stats["hits"], "cache_misses": stats["misses"],
            "wall_clock_seconds": round(time.time() - began, 3), "python_version": platform.python_version(), "platform": platform.platform(), "spark_version": self.spark.version,
        }
        run = stores.save_run(scores, failures, self.path("state", "runs"), note)
        stores.write_cache(done.cache, where)
        for label in ("units", "lookups", "scored", "merged"):
            files.delete(self.spark, f"{run}/{label}")
        return self.spark.read.parquet(f"{run}/scores")

    def try_codes(self, scorer: scoring.Backend, *, n: int = 50, codes: list[str] | None = None, approved: bool = True) -> DataFrame:
        """Scores of a sample of the dev split; the other splits stay unseen."""
        dev = splits.of_split(self.splits(), splits.DEV)
        plan = sampling.plan_uniform(dev, min(n, dev.count()), split=splits.DEV, seed=self.settings.splits.seed)
        return self.score(plan, scorer, purpose="try", codes=codes, approved=approved)

    def check(self, scorer: scoring.Backend, *, alpha: float | None = None, delta: float | None = None, resamples: int = 0, strict: bool = True, approved: bool = True) -> list[dict]:
        """Scores the gold items only, certifies every code of the codebook, saves the calibration."""
        log, t, book = self.gold().read(), self.settings.thresholds, self.codebook()
        if log.isEmpty():
            raise ValidationError("no gold sample yet", hint="gold")
        splits.require_split(log.where("split = 'test'"), self.splits(), splits.TEST)
        scores = self.score(log.select("item_id").distinct(), scorer, purpose="check", approved=approved)
        found = self.certified(scores, alpha=alpha, delta=delta, resamples=resamples)
        summary = checks.summary(log, found).first().asDict()
        note = {"backend": scorer.name, "model": scorer.model_version, "alpha": alpha or t.alpha, "delta": delta or t.delta, "code_hashes": {c.code_id: c.hash for c in book.codes}, "settings": self.settings.fingerprint(), "summary": summary}
        rows = json.loads(json.dumps(stores.save_calibration(found, self.path("state", "calibration.json"), note)))
        if strict and not any(r["verdict"] in ("ok", "weak") for r in rows):
            raise NotCertified("no code can be automated", hint="see the check table")
        return sorted(rows, key=lambda r: r["code_id"])

    def certified(self, scores: DataFrame, *, alpha: float | None = None, delta: float | None = None, resamples: int = 0) -> DataFrame:
        log, t = self.gold().read(), self.settings.thresholds
        return checks.run_check(log, scores, alpha=alpha or t.alpha, delta=delta or t.delta, codes=self.codebook().table(self.spark), resamples=resamples, seed=self.settings.splits.seed)

    def calibration(self) -> tuple[DataFrame, dict]:
        return stores.load_calibration(self.spark, self.path("state", "calibration.json"))

    def run(self, scorer: scoring.Backend, *, codes: list[str] | None = None, retry_failed: bool = False, approved: bool = False) -> DataFrame:
        """Scores the corpus unless something changed since calibration. A retry or a run of some codes is laid over the last run, whose other cells stay."""
        _, note = self.calibration()
        live = self.spark.createDataFrame([(c.code_id, c.hash) for c in self.codebook().codes], "code_id string, code_hash string")
        then = self.spark.createDataFrame(list(note["code_hashes"].items()), "code_id string, code_hash string")
        drift.require_no_drift(drift.code_drift(live, then), drift.setting_drift(self.settings.fingerprint(), note["settings"]))
        self.splits()
        ids, over = None, stores.latest_run(self.spark, self.path("state", "runs"), "run") if retry_failed or codes else None
        if retry_failed:
            if over is None or not files.exists(self.spark, f"{over}/failures"):
                raise ValidationError("nothing failed")
            ids = self.spark.read.parquet(f"{over}/failures")
        return self.score(ids, scorer, purpose="run", codes=codes, approved=approved, over=over)

    def decisions(self) -> DataFrame:
        book = self.codebook()
        bands, _ = self.calibration()
        human = gold.human_labels(self.gold().read(), self.reviews().read())
        return coding.apply_bands(self.items(), book.table(self.spark), bands, self.scores("run"), human)

    def review_queue(self, limit: int | None = None) -> DataFrame:
        return coding.review_queue(self.decisions(), gold.coded_pairs(self.reviews().read()), limit)

    def export(self, *, fmt: str = "csv", with_report: bool = True, with_chart: bool = True, resamples: int = 2000) -> dict[str, str]:
        book, out = self.codebook(), lambda name: self.path("out", name)
        decided = self.decisions().cache()
        paths = {n: out(stores.default_filename(n, fmt)) for n in ("coded", "abstentions")}
        stores.write_table(coding.coded_table(self.items(), decided, book.ids), paths["coded"], fmt)
        stores.write_table(coding.abstentions(decided, self.items()), paths["abstentions"], fmt)
        if with_report:
            paths |= self._report(decided, with_chart, resamples)
        decided.unpersist()
        return paths

    def _report(self, decided: DataFrame, with_chart: bool, resamples: int) -> dict[str, str]:
        note, paths = files.read_json(self.spark, self.path("state", "calibration.json")), {}
        log = self.gold().read()
        rows = [r.asDict() for r in self.certified(self.scores("run"), alpha=note["alpha"], delta=note["delta"], resamples=resamples).orderBy("code_id").collect()]
        curves = checks.curves(log, self.scores("run"), seed=self.settings.splits.seed)
        shown = {k: [r.asDict() for r in v.collect()] for k, v in curves.items()}  # 16 points a code at most
        usable = {r["code_id"] for r in rows if r["verdict"] in ("ok", "weak")}
        best = checks.furthest(shown["labour"], shown["baseline"], usable)
        if with_chart and best is not None:
            chart = self.path("out", "reliability_vs_labour.png")
            try:
                of = lambda k: [r for r in shown[k] if r["code_id"] == best]
                report.draw_labour_chart(of("labour"), of("baseline"), chart, f"Reliability against human labour: {best}")
                paths["chart"] = chart
            except ValidationError:  # charts are optional, the report is not
                pass
        counts = {r["source"]: r["n"] for r in coding.counts_by_source(decided).collect()}
        methods = report.methods_paragraph(n_items=self.items().count(), n_gold=log.select("item_id").distinct().count(), alpha=note["alpha"], delta=note["delta"], backend=note["backend"], model=note["model"], n_codes=len(rows), usable=len(usable))
        provenance = {k: note[k] for k in ("backend", "model", "alpha", "delta", "created_at")} | {k: v for k, v in self.manifest().items() if k in ("run_id", "models", "corpus_hash", "item_count", "calls", "failures", "cache_hits")} | {f"cells {k}": n for k, n in counts.items()}
        paths["report"] = self.path("out", "report.md")
        files.write_text(self.spark, paths["report"], report.build_report(title="Validation report", checks=rows, selective=shown["selective"], labour=shown["labour"], methods=methods, note=provenance))
        return paths

    def compare(self, scorers: dict[str, scoring.Backend], *, resamples: int = 0, approved: bool = True) -> DataFrame:
        """Usable codes, share needing review, kappa by code and cost of each backend on the gold items; each has a cache of its own."""
        log, parts, costs = self.gold().read(), [], []
        for name, scorer in scorers.items():
            scores = self.score(log.select("item_id").distinct(), scorer, purpose="compare", approved=approved, cache=f"cache-{name}")
            parts.append(self.certified(scores, resamples=resamples).select("code_id", "verdict", "coverage", "kappa", F.lit(name).alias("backend")))
            costs.append((name, self.manifest("compare")["cost_usd"]))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return checks.compare(every, self.spark.createDataFrame(costs, "backend string, cost double"))

    def purge(self, *, what: tuple[str, ...]) -> None:
        for name in what:
            if name not in ("gold", "review", "cache", "runs", "out"):
                raise ValidationError(f"cannot purge {name}")
            if name == "cache":
                for held in files.names(self.spark, self.path("state")):
                    if held == "cache" or held.startswith("cache-"):
                        files.delete(self.spark, self.path("state", held))
            files.delete(self.spark, self.path("out") if name == "out" else self.path("state", name))


def code_tasks(tasks: list[dict], *, ask: Callable[[str], str], show_probability: bool = False) -> list[dict]:
    """A session at the terminal: y, n, ? (skip), b (back), q (quit). Gold sessions hide the model's probability."""
    done: dict[int, int] = {}
    at = 0
    while at < len(tasks):
        t = tasks[at]
        shown = f" [p={t['probability']:.2f}]" if show_probability and t.get("probability") is not None else ""
        answer = ask(f"{at + 1}/{len(tasks)} {t['code_id']}{shown}\n{t['text'][:2000]}\n[y/n/?/b/q] ").strip().lower()
        if answer == "q":
            break
        if answer == "b":
            at = max(0, at - 1)
            done.pop(at, None)
        elif answer in ("y", "n", "?"):
            if answer != "?":
                done[at] = int(answer == "y")
            at += 1
    return [{**tasks[k], "label": v, "timestamp": stores.now(), "model_visible": show_probability} for k, v in sorted(done.items())]
