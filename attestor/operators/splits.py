"""Deterministic dev / calibration / test partition and its guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ProjectError, SplitViolation
from ..functions.hashing import sha_parts

DEV, CALIBRATION, TEST = "dev", "calibration", "test"
#: Items whose global rank one window task computes; more are ranked range by range.
ONE_TASK = 5_000_000


def global_rank(df: DataFrame, key: str, name: str = "rn", *, one_task: int = ONE_TASK, rows: int | None = None) -> DataFrame:
    """Adds the rank (from 1) by `key`, which is unique. Large inputs: range partitions ranked apart, offset by the counts before them."""
    if (df.count() if rows is None else rows) <= one_task:
        return df.withColumn(name, F.row_number().over(Window.orderBy(key)).cast("long"))
    dealt = df.withColumn("_range", F.substring(key, 1, 3))  # keys are uniform hex digests: 4096 even ranges
    before = dealt.groupBy("_range").count()
    before = before.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))
    local = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy("_range").orderBy(key)))
    return local.join(before, "_range").withColumn(name, (F.col("_rn") + F.col("_before")).cast("long")).drop("_range", "_rn", "_before")


def assign_splits(items: DataFrame, *, seed: int = 42, dev: float = 0.10, calibration: float = 0.45, test: float = 0.45, one_task: int = ONE_TASK) -> DataFrame:
    """item_id, split_key, rn, split: exact sizes, in order of a keyed hash, independent of row order."""
    if abs(dev + calibration + test - 1) > 1e-9 or min(dev, calibration, test) < 0:
        raise ProjectError("split fractions must be non-negative and sum to 1")
    ids = items.select("item_id")
    n, distinct = ids.agg(F.count("*"), F.count_distinct("item_id")).first()
    if not n:
        raise ProjectError("cannot partition an empty corpus")
    if n != distinct:
        raise ProjectError("cannot partition a corpus with duplicate item ids")
    n_dev, n_cal = round(dev * n), round(calibration * n)
    keyed = ids.withColumn("split_key", sha_parts(F.lit("split"), F.lit(str(seed)), F.col("item_id")))
    split = F.when(F.col("rn") <= n_dev, DEV).when(F.col("rn") <= n_dev + n_cal, CALIBRATION).otherwise(TEST)
    return global_rank(keyed, "split_key", one_task=one_task, rows=n).withColumn("split", split)


def split_counts(splits: DataFrame) -> DataFrame:
    """A row for each split, empty ones too."""
    domain = splits.sparkSession.createDataFrame([(s,) for s in (DEV, CALIBRATION, TEST)], "split string")
    return F.broadcast(domain).join(splits.groupBy("split").count(), "split", "left").select("split", F.coalesce("count", F.lit(0)).alias("n"))


def of_split(splits: DataFrame, split: str) -> DataFrame:
    return splits.where(F.col("split") == split)


def outside(ids: DataFrame, splits: DataFrame, allowed: str) -> DataFrame:
    """The ids that are not in the allowed split, unknown ones included."""
    return ids.select("item_id").join(splits.select("item_id", "split"), "item_id", "left").where(~F.col("split").eqNullSafe(F.lit(allowed)))


def require_split(ids: DataFrame, splits: DataFrame, allowed: str) -> None:
    bad = outside(ids, splits, allowed).take(1)
    if bad:
        raise SplitViolation(f"{bad[0]['item_id']} is not in the {allowed} split")
