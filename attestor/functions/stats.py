"""Agreement, calibration and binomial statistics as columns over weighted confusion cells.

Cells: a gold and decided yes, b gold yes decided no, c gold no decided yes, d both no.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-12
BINS = 10


def cells(gold: Column, decided: Column, weight: Column) -> list[Column]:
    """Four aggregates named a, b, c, d; none is null on empty input."""
    pick = lambda g, d: F.coalesce(F.sum(F.when((gold == g) & (decided == d), weight)), F.lit(0.0))
    return [pick(1, 1).alias("a"), pick(1, 0).alias("b"), pick(0, 1).alias("c"), pick(0, 0).alias("d")]


_N = "((a + d) + (b + c))"


def observed_agreement() -> Column:
    return F.expr(f"CASE WHEN {_N} > 0 THEN (a + d) / {_N} END")


_PE = f"(((a + b) * (a + c) + (c + d) * (b + d)) / ({_N} * {_N}))"


def kappa() -> Column:
    """Cohen's kappa of columns a, b, c, d; null where `kappa_reason` says why."""
    return F.expr(f"CASE WHEN {_N} > 0 AND 1 - {_PE} > {EPSILON} THEN ((a + d) / {_N} - {_PE}) / (1 - {_PE}) END")


def kappa_reason() -> Column:
    return F.expr(f"CASE WHEN {_N} <= 0 THEN 'EMPTY_INPUT' WHEN 1 - {_PE} <= {EPSILON} THEN 'DEGENERATE_SINGLE_CLASS' END")


_ONES, _PAIRABLE = "(2 * a + b + c)", f"(2 * {_N})"
_EXPECTED = f"(2 * {_ONES} * ({_PAIRABLE} - {_ONES}) / ({_PAIRABLE} - 1))"


def krippendorff() -> Column:
    """Krippendorff's nominal alpha of two coders from the same cells."""
    return F.expr(f"CASE WHEN {_PAIRABLE} > 1 AND {_EXPECTED} > {EPSILON} THEN 1 - 2 * (b + c) / {_EXPECTED} END")


def krippendorff_reason() -> Column:
    return F.expr(f"CASE WHEN {_PAIRABLE} <= 1 THEN 'EMPTY_INPUT' WHEN {_EXPECTED} <= {EPSILON} THEN 'DEGENERATE_SINGLE_CLASS' END")


def weighted_mean(value: Column, weight: Column) -> Column:
    total = F.sum(weight)
    return F.when(total > 0, F.sum(value * weight) / total)


def effective_size(weight: Column) -> Column:
    """Kish's effective sample size."""
    return F.coalesce(F.when(F.sum(weight) > 0, F.sum(weight) * F.sum(weight) / F.sum(weight * weight)), F.lit(0.0))


def weight_of(inclusion: Column) -> Column:
    good = (inclusion > 0) & (inclusion <= 1)
    return F.when(inclusion.isNull(), F.lit(1.0)).when(good, 1.0 / inclusion).otherwise(F.raise_error(F.lit("inclusion probability outside (0, 1]")).cast("double"))


def binomial_cdf(errors: str, n: str, alpha: float) -> Column:
    """P(X <= errors) of Binomial(n, alpha) for two integer SQL expressions, by a log recurrence."""
    odds, miss = repr(math.log(alpha / (1 - alpha))) + "D", repr(math.log(1 - alpha)) + "D"
    return F.expr(f"""least(1.0D, aggregate(sequence(0, CAST({errors} AS INT)), struct(CAST({n} AS DOUBLE) * {miss} AS l, 0.0D AS s),
        (x, k) -> struct(CASE WHEN k < {n} THEN x.l + ln(CAST({n} - k AS DOUBLE) / (k + 1)) + {odds} ELSE x.l END AS l, x.s + exp(x.l) AS s), x -> x.s))""")


def minimum_accepted(alpha: float, share: float) -> int:
    """Error-free items of a class that certify it."""
    if not (0 < alpha < 1 and 0 < share < 1):
        raise ValueError("alpha and the share of delta lie in (0, 1)")
    return math.ceil(math.log(share) / math.log(1 - alpha))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def valid_probability(p: Column, what: Column) -> Column:
    """The probability itself, null kept; anything not in [0, 1] is an error, never clamped."""
    return F.when(p.isNull() | (~F.isnan(p) & p.between(0.0, 1.0)), p).otherwise(F.raise_error(F.concat(F.lit("invalid probability for "), what)).cast("double"))


def from_logprob(lp: Column) -> Column:
    return clamp01(F.exp(lp))


def brier(scored: DataFrame, *keys: str) -> DataFrame:
    """Weighted mean squared error by keys over p, g, w."""
    return scored.groupBy(*keys).agg(F.count("*").alias("n"), weighted_mean(F.pow(F.col("p") - F.col("g"), 2), F.col("w")).alias("brier"))


def reliability(scored: DataFrame, *keys: str, bins: int = BINS) -> DataFrame:
    """Counts, weights, mean prediction and observed rate of each of `bins` bins; empty bins are rows too."""
    bin_of = F.greatest(F.lit(0), F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))).cast("int")
    made = scored.groupBy(*keys, bin_of.alias("bin")).agg(
        F.count("*").alias("n"), F.sum("w").alias("weight"), weighted_mean(F.col("p"), F.col("w")).alias("predicted"), weighted_mean(F.col("g"), F.col("w")).alias("observed")
    )
    domain = scored.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    joined = domain.join(made, [*keys, "bin"], "left").fillna({"n": 0, "weight": 0.0})
    return joined.select(*keys, "bin", (F.col("bin") / bins).alias("lo"), ((F.col("bin") + 1) / bins).alias("hi"), "n", "weight", "predicted", "observed")


def calibration_error(scored: DataFrame, *keys: str, bins: int = BINS) -> DataFrame:
    gap = F.abs(F.col("observed") - F.col("predicted")) * F.col("weight")
    return reliability(scored, *keys, bins=bins).groupBy(*keys).agg(F.when(F.sum("weight") > 0, F.sum(gap) / F.sum("weight")).alias("ece"))
