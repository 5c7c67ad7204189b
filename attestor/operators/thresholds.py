"""Abstention bands: the grid, class-conditional risk tests, selection and grading.

Input is gs(code_id, item_id, split, p, g, w) with p not null. Every code meets every band in one pass: the 15-row grid is
broadcast, and conditional sums are combined before the shuffle on (code, band).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats

#: Upper thresholds of the default grid.
UPPER = (0.99, 0.98, 0.97, 0.96, 0.95, 0.925, 0.90, 0.875, 0.85, 0.80, 0.75, 0.70, 0.65, 0.60, 0.55)
MIN_POSITIVES, PUBLISHABLE, COMFORTABLE, TOLERANCE = 15, 0.70, 0.75, 1e-9
OK, WEAK, NOT_AUTOMATABLE, INSUFFICIENT = "ok", "weak", "NOT_AUTOMATABLE", "INSUFFICIENT_EVIDENCE"


def grid(spark: SparkSession, upper: tuple[float, ...] = UPPER) -> DataFrame:
    """band_id (0: most conservative), t_lo, t_hi, band_width."""
    pairs = sorted(((round(1 - t, 10), t) for t in upper), key=lambda x: (-(x[1] - x[0]), -x[1], x[0]))
    return spark.createDataFrame([(i, lo, hi, hi - lo) for i, (lo, hi) in enumerate(pairs)], "band_id int, t_lo double, t_hi double, band_width double")


def candidate_weights(count: int) -> list[float]:
    """Shares of delta: halves, the last one taking the rest."""
    if count < 1:
        raise ValueError("at least one candidate")
    first = [0.5 ** (i + 1) for i in range(count - 1)]
    return [*first, 1 - sum(first)]


def accepted(p: str = "p") -> Column:
    return (F.col(p) >= F.col("t_hi")) | (F.col(p) <= F.col("t_lo"))


def decide(p: str = "p") -> Column:
    """1, 0 or null; both ends belong to the decision, the upper one first. A null band decides at one half."""
    half = F.when(F.col(p) >= 0.5, 1).otherwise(0)
    return F.when(F.col("t_hi").isNull(), half).when(F.col(p) >= F.col("t_hi"), 1).when(F.col(p) <= F.col("t_lo"), 0)


def candidates(gs: DataFrame, *, alpha: float = 0.05, delta: float = 0.05, bands: DataFrame | None = None) -> DataFrame:
    """One row a code and band: coverage, and for each true class the accepted, effective size, errors, risk, p-value and verdict."""
    spark = gs.sparkSession
    bands = grid(spark) if bands is None else bands
    m = bands.count()
    met = gs.crossJoin(F.broadcast(bands))
    acc, dec = accepted(), decide()
    sums = [F.sum("w").alias("w_all"), F.sum(F.when(acc, F.col("w"))).alias("w_acc"), F.count(F.when(acc, 1)).alias("n_accepted")]
    for name, label in (("pos", 1), ("neg", 0)):
        on = acc & (F.col("g") == label)
        sums += [F.count(F.when(on, 1)).alias(f"{name}_n"), F.coalesce(F.sum(F.when(on, F.col("w"))), F.lit(0.0)).alias(f"{name}_w"), F.coalesce(F.sum(F.when(on, F.col("w") * F.col("w"))), F.lit(0.0)).alias(f"{name}_ww"), F.coalesce(F.sum(F.when(on & (dec != label), F.col("w"))), F.lit(0.0)).alias(f"{name}_errors")]
    made = met.groupBy("code_id", "band_id", "t_lo", "t_hi", "band_width").agg(*sums)
    made = made.withColumn("coverage", F.when(F.col("w_all") > 0, F.coalesce("w_acc", F.lit(0.0)) / F.col("w_all")).otherwise(0.0))
    # delta is spent in halves, starting with the widest acceptance that the grid itself promises
    order = Window.partitionBy("code_id").orderBy("band_width", F.col("t_hi").desc())
    share = F.pow(F.lit(2.0), -F.least(F.row_number().over(order), F.lit(max(m - 1, 1)))) if m > 1 else F.lit(1.0)
    made = made.withColumn("delta_share", share * delta)
    for name in ("pos", "neg"):
        made = made.withColumn(f"{name}_risk", F.when(F.col(f"{name}_w") > 0, F.col(f"{name}_errors") / F.col(f"{name}_w")))
        made = made.withColumn(f"{name}_eff", F.when(F.col(f"{name}_ww") > 0, F.col(f"{name}_w") * F.col(f"{name}_w") / F.col(f"{name}_ww")).otherwise(0.0))
        made = made.withColumn(f"{name}_size", F.floor(F.col(f"{name}_eff") + TOLERANCE).cast("int"))
        made = made.withColumn(f"{name}_fails", F.ceil(F.col(f"{name}_risk") * F.col(f"{name}_size") - TOLERANCE).cast("int"))
        tail = stats.binomial_cdf(f"{name}_fails", f"{name}_size", alpha)
        made = made.withColumn(f"{name}_p", F.when((F.col(f"{name}_size") < 1) | F.col(f"{name}_risk").isNull(), 1.0).otherwise(tail))
        made = made.withColumn(f"{name}_passed", F.col(f"{name}_p") <= F.col("delta_share"))
    return made.withColumn("valid", F.col("pos_passed") & F.col("neg_passed"))


def fit(gs: DataFrame, *, alpha: float = 0.05, delta: float = 0.05, bands: DataFrame | None = None, min_positives: int = MIN_POSITIVES, codes: DataFrame | None = None) -> DataFrame:
    """One row a code: the widest valid band (t_lo, t_hi, coverage) or the reason there is none. A code of
    codes(code_id) without any row in gs has insufficient evidence.

    Largest coverage wins, ties go to the wider band. Fewer than `min_positives` raw positives: no test is made.
    """
    counts = gs.groupBy("code_id").agg(
        F.count("*").alias("n_gold"), F.sum("g").cast("long").alias("n_gold_positive"),
        (F.max("w") - F.min("w") <= 1e-8 + 1e-5 * F.abs(F.min("w"))).alias("exact"),
    )
    cand = candidates(gs, alpha=alpha, delta=delta, bands=bands)
    best = cand.where("valid").groupBy("code_id").agg(F.max_by(F.struct("t_lo", "t_hi", "coverage", "band_width", "delta_share"), F.struct("coverage", "band_width")).alias("best"))
    if codes is not None:
        counts = F.broadcast(codes.select("code_id").distinct()).join(counts, "code_id", "left").withColumns({"n_gold": F.coalesce("n_gold", F.lit(0)), "n_gold_positive": F.coalesce("n_gold_positive", F.lit(0)), "exact": F.coalesce("exact", F.lit(True))})
    enough = F.col("n_gold_positive") >= min_positives
    best_of = lambda c: F.when(enough, F.col(f"best.{c}")).alias(c)
    verdict = F.when(~enough, INSUFFICIENT).when(F.col("best").isNull(), NOT_AUTOMATABLE).otherwise(OK)
    reason = F.when(~enough, "INSUFFICIENT_EVIDENCE").when(F.col("best").isNull(), "NO_VALID_THRESHOLD")
    return counts.join(best, "code_id", "left").select("code_id", "n_gold", "n_gold_positive", "exact", best_of("t_lo"), best_of("t_hi"), best_of("coverage"), best_of("delta_share"), verdict.alias("verdict"), reason.alias("reason"))


def shortfall(cand: DataFrame, *, alpha: float) -> DataFrame:
    """Codes whose error-free bands accept too few items: how many there are, and how many certify."""
    clean = cand.where("pos_errors = 0 AND neg_errors = 0 AND NOT valid")
    least = F.ceil(F.log("delta_share") / F.log(F.lit(1 - alpha))).cast("long")
    made = clean.groupBy("code_id").agg(F.max(F.least("pos_n", "neg_n")).alias("have"), F.min(least).alias("need"))
    return made.where("have < need")


def grade(fitted: DataFrame, kappas: DataFrame) -> DataFrame:
    """Final verdict from held-out kappa(code_id, kappa)."""
    joined = fitted.withColumnsRenamed({"verdict": "v", "reason": "r"}).join(kappas, "code_id", "left")
    k, was_ok = F.col("kappa"), F.col("v") == OK
    verdict = F.when(~was_ok, F.col("v")).when(k.isNull(), INSUFFICIENT).when(k < PUBLISHABLE, NOT_AUTOMATABLE).when(k < COMFORTABLE, WEAK).otherwise(OK)
    reason = F.when(~was_ok, F.col("r")).when(k.isNull(), "INSUFFICIENT_EVIDENCE").when(k < PUBLISHABLE, "BELOW_PUBLICATION_BAR")
    return joined.select(*[c for c in fitted.columns if c not in ("verdict", "reason")], "kappa", verdict.alias("verdict"), reason.alias("reason"))


def realised_risk(gs: DataFrame, fitted: DataFrame) -> DataFrame:
    """Weighted error of each true class among held-out items that the fitted band accepts."""
    met = gs.join(F.broadcast(fitted.select("code_id", "t_lo", "t_hi")), "code_id").where(F.col("t_hi").isNotNull() & accepted())
    wrong = (decide() != F.col("g")).cast("double")
    of = lambda label: stats.weighted_mean(F.when(F.col("g") == label, wrong), F.when(F.col("g") == label, F.col("w")))
    return met.groupBy("code_id").agg(of(1).alias("positive_risk"), of(0).alias("negative_risk"))
