"""Gold samples with recorded inclusion probabilities. Draws are ranks by keyed hash, so they are reproducible in any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from .splits import global_rank

UNIFORM, ENRICHED = "uniform", "enriched"


def _chosen(ids: DataFrame, n: int, *tag: str, rows: int) -> DataFrame:
    keyed = ids.withColumn("_key", F.sha2(F.concat_ws(":", *map(F.lit, tag), "item_id"), 256))
    return global_rank(keyed, "_key", "_rank", rows=rows).where(F.col("_rank") <= n).drop("_key", "_rank")


def _plan(ids: DataFrame, split: str, stratum: str, pi: float) -> DataFrame:
    return ids.select("item_id", F.lit(split).alias("split"), F.lit(stratum).alias("stratum"), F.lit(float(pi)).alias("inclusion_probability"))


def plan_uniform(ids: DataFrame, n: int, *, split: str, seed: int) -> DataFrame:
    """n of the distinct ids without replacement, each with probability n / N."""
    pool = ids.select("item_id").distinct()
    size = pool.count()
    if n < 1:
        raise ValidationError("a sample has at least one item")
    if not size:
        raise ValidationError(f"the {split} split has no items to sample")
    if n > size:
        raise ValidationError(f"cannot draw {n} of {size} items", hint="ask for fewer, or load more")
    return _plan(_chosen(pool, n, str(seed), split, UNIFORM, rows=size), split, UNIFORM, n / size)


def enrichment_pool(scores: DataFrame, *, pool_fraction: float = 0.2, minimum: int = 1) -> DataFrame:
    """item_id, p, rank of the most probable share of the scored items; ties by id."""
    if not 0 < pool_fraction <= 1:
        raise ValidationError("pool_fraction lies in (0, 1]")
    scored = scores.where("p is not null").select("item_id", "p")
    size = max(minimum, round(pool_fraction * scored.count()))
    # a top-k: each task keeps its own first `size` rows before they meet
    top = scored.orderBy(F.col("p").desc(), "item_id").limit(size)
    return top


def plan_enriched(pool: DataFrame, already: DataFrame, n: int, *, split: str, seed: int, base_inclusion: float, code_id: str) -> DataFrame:
    """Likely positives beside an earlier sample; the probability is conditional on that sample."""
    if n < 1 or not 0 < base_inclusion <= 1:
        raise ValidationError("at least one item, and a base probability in (0, 1]")
    left = pool.select("item_id").distinct().join(already.select("item_id"), "item_id", "left_anti")
    size = left.count()
    if not size:
        raise ValidationError(f"no unsampled items are left in the pool of {code_id}", hint="widen the pool")
    take = min(n, size)
    pi = min(1.0, base_inclusion + (1 - base_inclusion) * take / size)
    return _plan(_chosen(left, take, str(seed), split, ENRICHED, code_id, rows=size), split, ENRICHED, pi)


def plan_overlap(plan: DataFrame, n: int, *, seed: int) -> DataFrame:
    """The items that a second coder judges too."""
    if n < 0:
        raise ValidationError("an overlap is not negative")
    ids = plan.select("item_id").distinct()
    return _chosen(ids, n, str(seed), "overlap", rows=ids.count())


def allocation(n: int, calibration: float, test: float) -> tuple[int, int]:
    """Shares of a sample for the two certified splits, one item at least each."""
    first = max(1, round(n * calibration / (calibration + test)))
    return first, max(1, n - first)


def enrich_settings(already: int, split_size: int, requested: int) -> tuple[float, int]:
    """Base probability and size of an enrichment round."""
    return min(0.99, max(1e-6, already / split_size)), max(1, requested // 2)
