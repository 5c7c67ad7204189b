"""Text normalisation and length-prefixed hashing as columns."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([None if t is None else unicodedata.normalize("NFC", t) for t in s], dtype=object)


def beyond_nfc(text: Column) -> Column:
    """Whether a text may change under NFC; false if all of its characters are below U+0300, or null."""
    return F.coalesce((F.octet_length(text) != F.length(text)) & text.rlike(r"[^\x{0}-\x{2FF}]"), F.lit(False))


def nfc(text: Column) -> Column:
    """Spark has no NFC. A text that it cannot change is sent to the Python worker as null, so only the others travel."""
    return F.coalesce(_nfc(F.when(beyond_nfc(text), text)), text)


def normalise_text(text: Column, *, composed: bool = False) -> Column:
    """NFC, LF line ends, single inline spaces, two line feeds at most in a row, stripped. Without a Python step for texts that are `composed`."""
    t = F.regexp_replace(text if composed else nfc(text), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r" \n", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def normalise_definition(text: str) -> str:
    """One line, single spaces, NFC."""
    return " ".join(unicodedata.normalize("NFC", text).split())


def sha_parts(*parts: Column) -> Column:
    """sha256 over each part with its byte length and a colon before it."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)]), 256)


def sha_of(*parts: str) -> str:
    """The same on the driver."""
    return hashlib.sha256(b"".join(b"%d:%s" % (len(e), e) for e in (p.encode() for p in parts))).hexdigest()


def item_hash(text: Column) -> Column:
    return sha_parts(F.lit("item"), text)


def code_hash(definition: str, yes: Iterable[str], no: Iterable[str]) -> str:
    return sha_of("code", normalise_definition(definition), "yes", *map(normalise_definition, yes), "no", *map(normalise_definition, no))


def cache_key(backend: Column, model_version: Column, item: Column, code_id: Column, code: Column) -> Column:
    return sha_parts(F.lit("cache"), backend, model_version, item, code_id, code)


def corpus_hash(hashes: DataFrame, column: str = "item_hash") -> DataFrame:
    """One row: sha256 over the sorted hashes, repeats kept.

    The hash runs over one stream, as the format asks. The rows are sorted by ranges on the executors, each range joined
    to lines there, and the driver takes in one range after another, so that no task and no row holds them all.
    """
    spark = hashes.sparkSession
    of = F.concat(F.octet_length(column).cast("string"), F.lit(":"), F.col(column))
    digest = hashlib.sha256(b"6:corpus")
    for row in hashes.where(F.col(column).isNotNull()).orderBy(column).select(of.alias("h")).toLocalIterator(prefetchPartitions=True):
        digest.update(row["h"].encode())
    return spark.createDataFrame([(digest.hexdigest(),)], "corpus_hash string")


def estimate_tokens(text: Column) -> Column:
    return (F.floor(F.length(text) / 4.0) + 1).cast("long")


def draw(*parts: Column) -> Column:
    """A reproducible 32-bit draw from the parts, colon-joined."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 8), 16, 10).cast("long")


def strip_volatile(report: str, marks: Iterable[str] = ("Generated:", "Run:")) -> str:
    """Report lines without those that name a run or a time."""
    return "\n".join(x for x in report.splitlines() if not any(m in x for m in marks))


IDENTIFIER = re.compile(r"^[a-z][a-z0-9_]{2,40}$")
