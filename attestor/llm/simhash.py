"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits form segments of 22, 21 and 21 bits. If two fingerprints differ in at most three
bits, at most one segment holds two or more of the differences, so two segments differ in at most one bit each.
Zero-padded to 23 bits, those segments share a codeword (see `golay`): for every pair of segments, the
nearest codewords of one fingerprint are looked up among the near keys of the other, 24 bits of key in
all. A join on key verifies the distance and keeps each link once. Work is on distinct fingerprints, so
copies cost one row; components are formed on the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import components, golay, runtime

SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits over the XXH64 of word shingles, repeats included; zero without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    grams = map(b" ".join, zip(*(words[i : n + i] for i in range(shingle)), strict=True))
    hashes = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runtime.slices(batches, "text"):
            made = np.fromiter((fingerprint(t, shingle) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            fps = batch.column("fp").to_numpy().view(np.uint64)
            parts = [((fps >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
            probe = [golay.nearest_key(p) for p in parts]
            index = [golay.near_keys(p) for p in parts]
            probes, found = [], []
            for k, (i, j) in enumerate(PAIRS):
                probes.append(k << 24 | probe[i] << 12 | probe[j])
                a, b = index[i][:, :, None], index[j][:, None, :]
                found.append(np.where((a < 0) | (b < 0), -1, k << 24 | a << 12 | b).reshape(len(fps), 36))
            keys = np.concatenate(found, axis=1)
            held = keys >= 0
            ends = np.concatenate(([0], np.cumsum(held.sum(axis=1))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("fp"), pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(fps) + 1, 3), pa.int32()), pa.array(np.stack(probes, axis=1).ravel().astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[held].astype(np.int32)))], ["fp", "probes", "near"]
            )


def links(fingerprints: DataFrame, distance: int = 3) -> DataFrame:
    """a < b for every two of the distinct fingerprints(fp) at `distance` (3 at most) or fewer bits, each link once."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments within one bit are certain up to distance 3 only")
    keyed = fingerprints.mapInArrow(runtime.tidied(_keys), "fp long, probes array<int>, near array<int>")
    probes = keyed.select(F.col("fp").alias("a"), F.explode("probes").alias("key"))
    index = keyed.select(F.col("fp").alias("b"), F.explode("near").alias("key"))
    far = F.col("a").bitwiseXOR(F.col("b"))
    near = [F.bit_count(far.bitwiseAND(F.lit(_signed(((1 << n) - 1) << s)))) <= 1 for s, n in SEGMENTS]
    fits = [near[i] & near[j] for i, j in PAIRS]
    pair = F.shiftright("key", 24)
    # a link is reported under the first pair of segments that it fits
    first = ((pair == 0) & fits[0]) | ((pair == 1) & fits[1] & ~fits[0]) | ((pair == 2) & fits[2] & ~fits[0] & ~fits[1])
    # the packed input looks small enough to broadcast, its exploded keys are not
    met = probes.hint("merge").join(index.hint("merge"), "key").where((F.col("a") < F.col("b")) & (F.bit_count(far) <= distance) & first)
    return met.select("a", "b")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_duplicates(docs: DataFrame, *, shingle: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links, for every row.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows give a row each. A
    null doc_id keeps its row but never names a component with other ids. No rows give none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = runtime.written(rows.mapInArrow(runtime.tidied(_fingerprints(shingle)), "doc_id long, fp long"), "fingerprints")
    distinct = runtime.written(made.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components.roots(links(distinct.select("fp"), distance))
    grouped = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.select("fp", "root").join(names, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return made.join(named, "fp").select("doc_id", hexed, "component_id")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(runtime.table(spark, sf_dir, "documents"))
