"""Deciding every (item, code), and the tables that are delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .thresholds import decide

AUTO, HUMAN, ABSTAINED, UNCERTIFIED = "auto", "human", "abstain_unreviewed", "not_automatable"
SOURCES = (AUTO, HUMAN, ABSTAINED, UNCERTIFIED)


def apply_bands(items: DataFrame, codes: DataFrame, calibration: DataFrame, scores: DataFrame, human: DataFrame | None = None) -> DataFrame:
    """item_id, code_id, label, probability, source of every cell.

    A human label wins; then a code without a certified band gets no label; then a missing probability abstains; then the
    band decides. calibration(code_id, t_lo, t_hi, verdict); scores(item_id, code_id, probability); human(item_id, code_id, label).
    """
    cells = items.select("item_id").crossJoin(F.broadcast(codes.select("code_id")))
    cells = cells.join(scores.select("item_id", "code_id", "probability"), ["item_id", "code_id"], "left")
    if human is not None:
        cells = cells.join(human.select("item_id", "code_id", F.col("label").alias("human")), ["item_id", "code_id"], "left")
    else:
        cells = cells.withColumn("human", F.lit(None).cast("int"))
    usable = F.col("verdict").isin("ok", "weak") & F.col("t_hi").isNotNull()
    certified = calibration.where(usable).select("code_id", "t_lo", "t_hi")
    met = cells.join(F.broadcast(certified), "code_id", "left")
    banded = F.when(F.col("t_hi").isNotNull() & F.col("probability").isNotNull(), decide("probability"))
    label = F.coalesce(F.col("human").cast("int"), banded)
    source = F.when(F.col("human").isNotNull(), HUMAN).when(F.col("t_hi").isNull(), UNCERTIFIED).when(banded.isNull(), ABSTAINED).otherwise(AUTO)
    return met.select("item_id", "code_id", label.alias("label"), "probability", source.alias("source"))


def counts_by_source(decisions: DataFrame) -> DataFrame:
    """All four sources, also those with no cell."""
    domain = decisions.sparkSession.createDataFrame([(s,) for s in SOURCES], "source string")
    return F.broadcast(domain).join(decisions.groupBy("source").count(), "source", "left").select("source", F.coalesce("count", F.lit(0)).alias("n"))


def coverage(decisions: DataFrame) -> DataFrame:
    """Share of cells with a label from any source, by code."""
    return decisions.groupBy("code_id").agg(F.avg(F.col("label").isNotNull().cast("double")).alias("coverage"))


def coded_table(items: DataFrame, decisions: DataFrame, code_ids: list[str]) -> DataFrame:
    """The original columns and, by code, label, <code>_p and <code>_src; one shuffle on item_id, a conditional aggregate a column."""
    of = lambda c, x: F.max(F.when(F.col("code_id") == c, F.col(x)))
    columns = [e for c in code_ids for e in (of(c, "label").alias(c), of(c, "probability").alias(f"{c}_p"), of(c, "source").alias(f"{c}_src"))]
    return items.join(decisions.groupBy("item_id").agg(*columns), "item_id", "left")


def abstentions(decisions: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, code_id, probability, text of unreviewed abstentions, the most decided first."""
    rows = decisions.where(F.col("source") == ABSTAINED).join(items.select("item_id", "text"), "item_id", "left")
    far = F.abs(F.coalesce("probability", F.lit(0.5)) - 0.5)
    return rows.orderBy(far.desc(), "item_id", "code_id").select("item_id", "code_id", "probability", F.coalesce("text", F.lit("")).alias("text"))


def review_queue(decisions: DataFrame, done: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Abstentions to judge next; a probability of 0 ranks with the unknown ones, as 0.5."""
    rows = decisions.where(F.col("source") == ABSTAINED).select("item_id", "code_id", "probability")
    rows = rows if done is None else rows.join(done, ["item_id", "code_id"], "left_anti")
    p = F.when(F.coalesce("probability", F.lit(0.0)) == 0, 0.5).otherwise(F.col("probability"))
    rows = rows.orderBy(F.abs(p - 0.5).desc(), "item_id", "code_id")
    return rows if limit is None else rows.limit(limit)
