"""Fit, hold out, grade: one plan for all codes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import gold as gold_ops
from ..operators import selective, thresholds
from ..operators.splits import CALIBRATION, TEST


class Sealed:
    """Held-out rows that fitting cannot read: only the named purposes open them, and each opening is noted."""

    PURPOSES = ("reporting", "final_evaluation")

    def __init__(self, payload: DataFrame, label: str = "test") -> None:
        object.__setattr__(self, "_Sealed__payload", payload)
        object.__setattr__(self, "label", label)
        object.__setattr__(self, "log", [])

    def unseal(self, purpose: str) -> DataFrame:
        if purpose not in self.PURPOSES:
            raise PermissionError(f"{self.label} rows are not for {purpose!r}")
        self.log.append(purpose)
        return object.__getattribute__(self, "_Sealed__payload")

    def _refuse(self, *_: object, **__: object):
        raise PermissionError(f"{self.label} rows are sealed")

    def __getattr__(self, name: str):
        raise PermissionError(f"{self.label} rows are sealed")

    __getitem__ = __len__ = __iter__ = __contains__ = __bool__ = __call__ = __reduce__ = __deepcopy__ = _refuse

    def __repr__(self) -> str:
        return f"Sealed({self.label})"


def gold_scores(labels: DataFrame, scores: DataFrame) -> DataFrame:
    """gs: labels joined to probabilities; what the backend could not score is left out, never taken as 0; a probability outside [0, 1] is an error."""
    met = labels.join(scores.select("item_id", "code_id", stats.valid_probability(F.col("probability"), F.col("code_id")).alias("p")), ["item_id", "code_id"], "left")
    return met.where("p is not null").select("code_id", "item_id", "split", "p", "g", "w")


def held_out(gs: DataFrame, fitted: DataFrame) -> DataFrame:
    """code_id, n_test, n_test_positive, kappa, kappa_reason, test_coverage on held-out rows, under the gates of evidence."""
    counts = gs.groupBy("code_id").agg(F.count("*").alias("n_test"), F.sum("g").cast("long").alias("n_test_positive"))
    met = gs.join(F.broadcast(fitted.where("t_hi is not null").select("code_id", "t_lo", "t_hi")), "code_id")
    final = selective.finished(met, "code_id").select("code_id", F.col("kappa").alias("k"), F.col("reason").alias("why"), F.col("coverage").alias("test_coverage"))
    enough = F.coalesce(F.col("n_test_positive"), F.lit(0)) >= thresholds.MIN_POSITIVES
    made = fitted.select("code_id", "t_hi").join(counts, "code_id", "left").join(final, "code_id", "left")
    reason = F.when(F.col("t_hi").isNull(), "NO_VALID_THRESHOLD").when(~enough, "INSUFFICIENT_EVIDENCE").otherwise(F.col("why"))
    return made.select("code_id", F.coalesce("n_test", F.lit(0)).alias("n_test"), F.coalesce("n_test_positive", F.lit(0)).alias("n_test_positive"), F.when(F.col("t_hi").isNotNull() & enough, F.col("k")).alias("kappa"), reason.alias("kappa_reason"), "test_coverage")


def certify(gs: DataFrame, *, alpha: float, delta: float = 0.05, bands: DataFrame | None = None, codes: DataFrame | None = None) -> DataFrame:
    """One row a code, of codes(code_id) or of those that gs has: fitted on calibration rows alone, graded on test rows.

    gs is read once for all branches: gold labels and their probabilities, no texts.
    """
    gs = gs.cache()
    fitted = thresholds.fit(gs.where(F.col("split") == CALIBRATION), alpha=alpha, delta=delta, bands=bands, codes=gs.select("code_id").distinct() if codes is None else codes).cache()  # a row a code
    test = held_out(gs.where(F.col("split") == TEST), fitted)
    graded = thresholds.grade(fitted, test.select("code_id", "kappa"))
    return graded.join(test.drop("kappa"), "code_id", "left")


def human_ceiling(gold: DataFrame) -> DataFrame:
    """Kappa and alpha of the first two coders by code."""
    pairs = gold_ops.double_coded(gold)
    made = pairs.groupBy("code_id").agg(F.count("*").alias("n"), *stats.cells(F.col("first"), F.col("second"), F.lit(1.0)))
    return made.select("code_id", "n", stats.kappa().alias("human_kappa"), stats.krippendorff().alias("human_alpha"))


def human_interval(gold: DataFrame, *, n_resamples: int = 2000, seed: int = 42) -> DataFrame:
    """95 % interval of the first two coders' kappa by code."""
    pairs = gold_ops.double_coded(gold).select("code_id", "item_id", F.col("first").alias("g"), F.col("second").alias("d"), F.lit(1.0).alias("w"))
    made = selective.bootstrap(pairs, n_resamples=n_resamples, seed=seed)
    return made.select("code_id", F.col("lo").alias("human_lo"), F.col("hi").alias("human_hi"))


def run_check(gold: DataFrame, scores: DataFrame, *, alpha: float, delta: float = 0.05, coder: str | None = None, bands: DataFrame | None = None, codes: DataFrame | None = None, resamples: int = 0, seed: int = 42) -> DataFrame:
    """The whole check, a row for every code of codes(code_id) or, without it, of gold: certification, realised risks, Brier
    score, calibration error, human ceiling, with `resamples` the interval of kappa, and advice."""
    coder = coder or (gold_ops.primary_coder(gold).first() or [None])[0]
    gs = gold_scores(gold_ops.labels_for(gold, coder=coder), scores).cache()
    checked = certify(gs, alpha=alpha, delta=delta, bands=bands, codes=gold.select("code_id").distinct() if codes is None else codes).cache()
    test = gs.where(F.col("split") == TEST)
    parts = [thresholds.realised_risk(test, checked), stats.brier(test, "code_id").drop("n"), stats.calibration_error(test, "code_id"), human_ceiling(gold).drop("n")]
    if resamples:
        met = test.join(F.broadcast(checked.where("t_hi is not null").select("code_id", "t_lo", "t_hi")), "code_id")
        final = met.select("code_id", "item_id", "g", F.when(thresholds.accepted(), thresholds.decide()).otherwise(F.col("g")).alias("d"), "w")
        parts.append(selective.bootstrap(final, n_resamples=resamples, seed=seed).select("code_id", F.col("lo").alias("kappa_lo"), F.col("hi").alias("kappa_hi")))
        parts.append(human_interval(gold, n_resamples=resamples, seed=seed))
    for p in parts:
        checked = checked.join(F.broadcast(p), "code_id", "left")
    return checked.withColumn("advice", advice(alpha, delta))


def curves(gold: DataFrame, scores: DataFrame, *, seed: int = 42, n_resamples: int = 100) -> dict[str, DataFrame]:
    """selective, labour and baseline curves of every code on held-out gold; the baseline checks the same shares at random."""
    coder = (gold_ops.primary_coder(gold).first() or [None])[0]
    test = gold_scores(gold_ops.labels_for(gold, split=TEST, coder=coder), scores).cache()
    labour = selective.labour_curve(test).cache()
    shares = labour.select("code_id", "point", F.col("labour").alias("fraction"))
    return {
        "selective": selective.selective_curve(test).orderBy("code_id", "band_id"),
        "labour": labour.orderBy("code_id", "point"),
        "baseline": selective.random_baseline(test, shares, n_resamples=n_resamples, seed=seed).orderBy("code_id", "point"),
    }


def furthest(labour: list[dict], baseline: list[dict], among: set[str]) -> str | None:
    """The code, of those named, whose collected curve lies furthest above the random one."""
    base = {(r["code_id"], r["point"]): r["kappa"] for r in baseline}
    gains: dict[str, float] = {c: 0.0 for c in sorted(among)}
    for r in labour:
        low = base.get((r["code_id"], r["point"]))
        if r["code_id"] in gains and r["kappa"] is not None and low is not None:
            gains[r["code_id"]] += max(0.0, r["kappa"] - low)
    return max(gains, key=gains.get) if gains else None


def advice(alpha: float, delta: float):
    """A sentence on each refused code."""
    need = stats.minimum_accepted(alpha, delta / 2)
    return (
        F.when(F.col("verdict").isin("ok", "weak"), F.lit(None).cast("string"))
        .when(F.col("human_kappa") < thresholds.PUBLISHABLE, F.format_string("%s: coders disagree (kappa %.2f); sharpen the definition first", "code_id", "human_kappa"))
        .when(F.col("n_gold") == 0, F.format_string("%s: no scored gold label yet", "code_id"))
        .when(F.col("reason") == "INSUFFICIENT_EVIDENCE", F.format_string("%s: too few positives among the gold labels (%d for fitting, %d held out)", "code_id", "n_gold_positive", "n_test_positive"))
        .when(F.col("reason") == "NO_VALID_THRESHOLD", F.format_string(f"%s: no band keeps both classes' errors within alpha; at least {need} accepted items of each class are needed", "code_id"))
        .otherwise(F.format_string("%s: held-out kappa %.2f is below the bar", "code_id", "kappa"))
    )


def share_needing_review(checks: DataFrame) -> DataFrame:
    """One row: what is left to people once every usable code is automated; all of it if none is usable."""
    return checks.where("verdict in ('ok', 'weak')").agg(F.coalesce(1 - F.min("coverage"), F.lit(1.0)).alias("share"))


def compare(checks: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """Per backend: usable codes, share needing review, kappa by code (and cost)."""
    usable = F.col("verdict").isin("ok", "weak")
    made = checks.groupBy("backend").agg(F.count_if(usable).alias("usable"), F.coalesce(1 - F.min(F.when(usable, F.col("coverage"))), F.lit(1.0)).alias("share"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("code_id", "kappa")))).alias("kappas"))
    return made if costs is None else made.join(costs, "backend", "left")


def summary(gold: DataFrame, checks: DataFrame) -> DataFrame:
    """gold_n, double-coded items, whether every code's test is exact, the widest share of delta."""
    coder = gold_ops.primary_coder(gold).withColumnRenamed("coder", "main")
    per = gold.crossJoin(F.broadcast(coder)).agg(F.count_distinct("item_id").alias("gold_n"), F.count_distinct(F.when(F.col("coder") != F.col("main"), F.col("item_id"))).alias("double_coded"))
    return per.crossJoin(F.broadcast(checks.agg(F.every("exact").alias("exact"), F.max("delta_share").alias("delta_share"))))
