"""Human judgements: keep-last reads, coders, double coding and precedence. Logs carry `seq`, the order of writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import weight_of


def latest(log: DataFrame, *keys: str) -> DataFrame:
    """The last record of each key; `first_seq` tells when the key was first written."""
    whole = F.struct(*[c for c in log.columns if c not in keys])
    made = log.groupBy(*keys).agg(F.max_by(whole, "seq").alias("_r"), F.min("seq").alias("first_seq"))
    return made.select(*keys, "_r.*", "first_seq")


def gold_latest(gold: DataFrame) -> DataFrame:
    return latest(gold, "item_id", "code_id", "coder")


def coders(gold: DataFrame) -> DataFrame:
    return gold.select("coder").distinct()


def primary_coder(gold: DataFrame) -> DataFrame:
    """The coder with most raw records, corrections counted; of equals the last by name. One row."""
    return gold.groupBy("coder").agg(F.count("*").alias("n")).agg(F.max_by("coder", F.struct("n", "coder")).alias("coder"))


def coded_pairs(gold: DataFrame, coder: str | None = None) -> DataFrame:
    rows = gold if coder is None else gold.where(F.col("coder") == coder)
    return rows.select("item_id", "code_id").distinct()


def labels_for(gold: DataFrame, *, split: str | None = None, coder: str | None = None) -> DataFrame:
    """code_id, item_id, split, g, w of the latest judgements, w the inverse inclusion probability."""
    rows = gold_latest(gold)
    rows = rows if split is None else rows.where(F.col("split") == split)
    rows = rows if coder is None else rows.where(F.col("coder") == coder)
    return rows.select("code_id", "item_id", "split", F.col("label").alias("g"), weight_of(F.col("inclusion_probability")).alias("w"))


def double_coded(gold: DataFrame) -> DataFrame:
    """code_id, item_id, first, second: judgements of the first two coders by name among those who share items, where both judged."""
    rows = gold_latest(gold)
    shared = rows.groupBy("code_id", "item_id").agg(F.collect_set("coder").alias("who")).where(F.size("who") > 1)
    pair = shared.select("code_id", F.explode("who").alias("coder")).groupBy("code_id").agg(F.array_sort(F.collect_set("coder")).alias("who"))
    met = rows.join(F.broadcast(pair), "code_id")
    of = lambda k: F.max(F.when(F.col("coder") == F.element_at("who", k), F.col("label")))
    return met.groupBy("code_id", "item_id").agg(of(1).alias("first"), of(2).alias("second")).where("first IS NOT NULL AND second IS NOT NULL")


def human_labels(gold: DataFrame, review: DataFrame | None = None) -> DataFrame:
    """item_id, code_id, label: reviews override gold; within gold the coder whose key was first written last wins."""
    from_gold = gold_latest(gold).select("item_id", "code_id", "label", F.struct(F.lit(0).alias("rank"), F.col("first_seq").alias("seq")).alias("prio"))
    if review is not None:
        last = latest(review, "item_id", "code_id")
        from_gold = from_gold.unionByName(last.select("item_id", "code_id", "label", F.struct(F.lit(1).alias("rank"), F.col("seq").alias("seq")).alias("prio")))
    return from_gold.groupBy("item_id", "code_id").agg(F.max_by("label", "prio").alias("label"))


def open_tasks(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks(item_id, code_id, ...) that nobody judged yet, so that sessions resume."""
    return tasks.join(done, ["item_id", "code_id"], "left_anti")


def with_seq(rows: DataFrame, after: int = 0) -> DataFrame:
    """Numbers the rows of an append by time, then content."""
    order = Window.orderBy("timestamp", "item_id", "code_id", "coder")
    return rows.withColumn("seq", F.row_number().over(order) + after)
