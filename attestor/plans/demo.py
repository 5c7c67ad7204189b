"""The driver's tables in the roles of the engine: documents as items, labels as gold, hash draws as a scorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..operators.splits import assign_splits

CODE_IDS = ("toxic", "high_quality")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("item_id"), "text", "lang", "source")


def ids(spark: SparkSession, sf: str) -> DataFrame:
    """Only the id column is read."""
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("item_id"))


def codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CODE_IDS], "code_id string")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("item_id"), F.expr("stack(2, 'toxic', toxic, 'high_quality', quality) AS (code_id, g)"))
    return rows.withColumn("g", F.col("g").cast("int"))


def _u(tag: str) -> Column:
    return draw(F.lit(tag), F.col("code_id"), F.col("item_id")) / 4294967296.0


def probability(gold: str = "g") -> Column:
    """Replayed answer of a scorer that is mostly right, sometimes torn, and wrong in one of a hundred."""
    torn = F.round(0.30 + 0.40 * _u("u2"), 4)
    yes, no = F.round(0.90 + 0.0995 * _u("u2"), 4), F.round(0.0005 + 0.0995 * _u("u2"), 4)
    return F.when(_u("u3") < 0.08, torn).when((F.coalesce(F.col(gold), F.lit(0)) == 1) != (_u("u1") < 0.01), yes).otherwise(no)


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """A probability for every (item, code); unlabelled items count as negatives of the scorer."""
    cells = ids(spark, sf).crossJoin(F.broadcast(codes(spark))).join(labels(spark, sf), ["item_id", "code_id"], "left")
    return cells.select("item_id", "code_id", probability().alias("probability"))


def splits(spark: SparkSession, sf: str) -> DataFrame:
    return assign_splits(ids(spark, sf))


def gold_log(spark: SparkSession, sf: str) -> DataFrame:
    """Gold records of two coders with corrections: coder_1 on all labels, coder_2 on a quarter of items and wrong in a tenth,
    and for every twentieth draw an earlier, opposite record of coder_1."""
    base = labels(spark, sf).join(splits(spark, sf).select("item_id", "split"), "item_id").withColumnRenamed("g", "label")
    pi = F.when(_u("pi") < 0.5, 1.0).otherwise(0.5)
    number = F.col("item_id").cast("long") * 10
    one = base.select("item_id", "code_id", "split", "label", F.lit("coder_1").alias("coder"), (number + 1).alias("seq"), pi.alias("inclusion_probability"))
    second = F.when(_u("flip") < 0.10, 1 - F.col("label")).otherwise(F.col("label"))
    two = base.where(_u("overlap") < 0.25).select("item_id", "code_id", "split", second.alias("label"), F.lit("coder_2").alias("coder"), (number + 2).alias("seq"), pi.alias("inclusion_probability"))
    old = base.where(_u("old") < 0.05).select("item_id", "code_id", "split", (1 - F.col("label")).alias("label"), F.lit("coder_1").alias("coder"), number.alias("seq"), pi.alias("inclusion_probability"))
    return one.unionByName(two).unionByName(old)


def weighted(spark: SparkSession, sf: str) -> DataFrame:
    """gs with uneven weights."""
    w = F.when(_u("pi") < 0.5, 1.0).otherwise(2.0)
    return _gs(spark, sf, w)


def even(spark: SparkSession, sf: str) -> DataFrame:
    return _gs(spark, sf, F.lit(1.0))


def _gs(spark: SparkSession, sf: str, w: Column) -> DataFrame:
    rows = labels(spark, sf).join(splits(spark, sf).select("item_id", "split"), "item_id")
    return rows.select("code_id", "item_id", "split", probability().alias("p"), "g", w.alias("w"))
