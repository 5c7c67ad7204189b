"""Coding of a stream of scored items against a fixed calibration; the last of streamed judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.thresholds import decide


def coded_stream(scored: DataFrame, calibration: DataFrame) -> DataFrame:
    """item_id, code_id, probability, label, source; row by row, so no state is held."""
    bands = F.broadcast(calibration.where("verdict in ('ok', 'weak') and t_hi is not null").select("code_id", "t_lo", "t_hi"))
    met = scored.join(bands, "code_id", "left")
    label = F.when(F.col("t_hi").isNotNull() & F.col("probability").isNotNull(), decide("probability"))
    source = F.when(F.col("t_hi").isNull(), "not_automatable").when(label.isNull(), "abstain_unreviewed").otherwise("auto")
    return met.select("item_id", "code_id", "probability", label.alias("label"), source.alias("source"))


def latest_judgements(log: DataFrame, event_time: str = "timestamp", late: str = "1 hour", every: str = "1 day") -> DataFrame:
    """item_id, code_id, coder, label, at: the last judgement of each coder in each window of event time.

    State is one row a key and window, dropped `late` after the window's end. Repeated deliveries change nothing. A
    judgement of a later window comes as a later row; `gold.latest` over what was written gives the last of all.
    """
    held = log.withWatermark(event_time, late).groupBy(F.window(event_time, every), "item_id", "code_id", "coder")
    made = held.agg(F.max(F.struct(F.col(event_time).alias("at"), "label")).alias("last"))
    return made.select("item_id", "code_id", "coder", "last.label", "last.at")


def drained(stream: DataFrame, target: str, checkpoint: str, *, mode: str = "append") -> None:
    """Write all that the source holds now as Parquet, exactly once however often it is started again."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
