"""Passages of long items, and the pooling of passage scores."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import item_hash

_PER_TOKEN = 4


def _wrapped(sentence: str, room: int) -> Iterator[str]:
    while len(sentence) > room:
        at = sentence.rfind(" ", 0, room)
        at = at if at > 0 else room
        yield sentence[:at].strip()
        sentence = sentence[at:].strip()
    if sentence:
        yield sentence


def _pieces(text: str, room: int) -> Iterator[str]:
    """Paragraphs; oversized ones as runs of sentences, oversized sentences wrapped at spaces."""
    for paragraph in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
        if len(paragraph) <= room:
            yield paragraph
            continue
        run = ""
        for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
            longer = f"{run} {sentence}".strip() if run else sentence
            if run and len(longer) > room:
                yield from _wrapped(run, room)
                longer = sentence
            run = longer
        yield from _wrapped(run, room)


def chunk_text(text: str, *, max_tokens: int, overlap_tokens: int = 0) -> list[str]:
    """Chunks of at most `max_tokens` (four characters each) at paragraph bounds, each opening with the last one's tail."""
    if max_tokens < 1 or not 0 <= overlap_tokens < max_tokens:
        raise ValueError("max_tokens >= 1 and 0 <= overlap_tokens < max_tokens")
    text = text.strip()
    if not text:
        return []
    if len(text) // _PER_TOKEN + 1 <= max_tokens:
        return [text]
    room, overlap, chunks = max_tokens * _PER_TOKEN, overlap_tokens * _PER_TOKEN, [""]
    for piece in _pieces(text, room):
        last = chunks[-1]
        if not last:
            chunks[-1] = piece
        elif len(last) + 2 + len(piece) <= room:
            chunks[-1] = f"{last}\n\n{piece}"
        else:
            tail = last[-overlap:].lstrip() if overlap else ""
            chunks.append(f"{tail}\n\n{piece}" if tail else piece)
    return [c for c in chunks if c]


def build_units(items: DataFrame, *, max_tokens: int = 28_000, overlap_tokens: int = 200) -> DataFrame:
    """item_id, unit_index, text, text_hash; an item that fits stays whole and never visits Python."""
    fits = F.floor(F.length("text") / float(_PER_TOKEN)) + 1 <= max_tokens
    whole = items.where(fits & (F.col("text") != "")).select("item_id", F.lit(0).alias("unit_index"), "text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [(i, k, c) for i, t in zip(frame["item_id"], frame["text"], strict=True) for k, c in enumerate(chunk_text(t, max_tokens=max_tokens, overlap_tokens=overlap_tokens))]
            yield pd.DataFrame(rows, columns=["item_id", "unit_index", "text"])

    long = items.where(~fits).select("item_id", "text").mapInPandas(cut, "item_id string, unit_index int, text string")
    return whole.unionByName(long).withColumn("text_hash", item_hash(F.col("text")))


def pool_scores(passages: DataFrame, rule: str = "max") -> DataFrame:
    """item_id, code_id, probability: the largest or mean passage score; failed passages are passed over, all failed stays null."""
    if rule not in ("max", "mean"):
        raise ValueError(f"unknown rule {rule!r}")
    return passages.groupBy("item_id", "code_id").agg((F.max if rule == "max" else F.avg)("probability").alias("probability"))


def distinct_texts(units: DataFrame) -> DataFrame:
    """One row a distinct text: the first unit's, and how many units share it."""
    return units.groupBy("text_hash").agg(F.min_by("text", F.struct("item_id", "unit_index")).alias("text"), F.count("*").alias("n_units"))
