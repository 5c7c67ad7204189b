"""What changed since calibration, and what a run would cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BudgetRefused, DriftError
from ..functions.hashing import estimate_tokens

OUTPUT_TOKENS = 32


def code_drift(live: DataFrame, recorded: DataFrame) -> DataFrame:
    """code_id, change (added, removed, changed, same) from code_id, code_hash on both sides."""
    met = live.select("code_id", F.col("code_hash").alias("now")).join(recorded.select("code_id", F.col("code_hash").alias("then")), "code_id", "full_outer")
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("then"), "changed").otherwise("same")
    return met.select("code_id", change.alias("change"))


def setting_drift(now: dict, then: dict) -> list[str]:
    """Names of chunking, seed and backend settings that differ."""
    return sorted(k for k in now.keys() | then.keys() if now.get(k) != then.get(k))


def require_no_drift(drift: DataFrame, settings: list[str]) -> None:
    """Changed codes and settings block a run; added and removed codes do not."""
    changed = [r["code_id"] for r in drift.where("change = 'changed'").orderBy("code_id").collect()]
    if changed or settings:
        raise DriftError(f"changed since calibration: {', '.join(changed + settings)}", hint="run check again")


def estimate_cost(units: DataFrame, n_codes: int, question_tokens: int, price_in: float | None = None, price_out: float | None = None) -> DataFrame:
    """One row: calls, input and output tokens, and the cost, null if a price is unknown."""
    made = units.agg(F.count("*").alias("calls"), F.coalesce(F.sum(estimate_tokens(F.col("text"))), F.lit(0)).alias("text_tokens"))
    made = made.select("calls", (F.col("text_tokens") + question_tokens * F.col("calls")).alias("input_tokens"), (OUTPUT_TOKENS * F.col("calls")).alias("output_tokens"), F.lit(n_codes).alias("n_codes"))
    known = price_in is not None and price_out is not None
    cost = (F.col("input_tokens") * float(price_in) + F.col("output_tokens") * float(price_out)) / 1e6 if known else F.lit(None).cast("double")
    return made.withColumn("cost", cost)


def needs_confirmation(cost: DataFrame, budget: float = 5.0, above_calls: int = 500) -> DataFrame:
    """Adds `confirm`: a priced run over budget, an unpriced one over the number of calls."""
    return cost.withColumn("confirm", F.when(F.col("cost").isNotNull(), F.col("cost") > budget).otherwise(F.col("calls") > above_calls))


def require_confirmation(cost: DataFrame, *, approved: bool, budget: float = 5.0, above_calls: int = 500) -> None:
    row = needs_confirmation(cost, budget, above_calls).first()
    if row["confirm"] and not approved:
        raise BudgetRefused(f"{row['calls']} calls, cost {row['cost']}: confirm with --yes")
