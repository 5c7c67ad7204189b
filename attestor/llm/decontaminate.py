"""Benchmark decontamination by greedy string tiling.

Words (lower case, ASCII punctuation apart) give seeds: running Karp-Rabin hashes of `shortest` words. The
test items' seeds are a table; a Bloom filter of bounded size made from it spares the documents' other
seeds the shuffle, and a join on the seed finds the pairs of a document and an item. Equal seeds in a row along
one diagonal are a common run; of all free runs the longest is marked, again and again, until none of `shortest`
words is left. An item is leaked if its tiles cover `threshold` of it, in whatever order they stand; an item of
fewer words, if it stands in the document whole. Nothing of the items reaches the driver but the filter.
"""

from __future__ import annotations

import heapq
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .anchors import range_hashes, sums

SHORTEST, THRESHOLD = 5, 0.8
#: Bits of the filter by seed, at least and at most (8 MB); beyond that it lets more pass, and the join decides all the same.
BITS_A_SEED, LEAST_BITS, MOST_BITS = 64, 1 << 20, 1 << 26
LEAKS = "doc_id long, item_id long, covered long, item_words long, coverage double, tiles long, tkey long"
HITS = "doc_id long, tkey long, seed long, at int"
_APART = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_APART).split()


def _coded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and how many words there are up to the end of each."""
    data = [(t or "").lower().encode().translate(_APART) for t in texts]
    flat = np.frombuffer(b" ".join([*data, b""]), np.uint8)
    apart = np.ones(len(flat) + 2, bool)
    apart[1:-1] = (flat == 32) | ((flat >= 9) & (flat <= 13))
    first, past = np.flatnonzero(~apart[1:-1] & apart[:-2]), np.flatnonzero(~apart[1:-1] & apart[2:]) + 1
    ends = np.cumsum([len(d) + 1 for d in data])
    return range_hashes(sums(flat), first, past), np.searchsorted(first, ends)


def _seeds(codes: np.ndarray, length: int) -> np.ndarray:
    """Running hashes of `length` codes, from each place that has so many after it."""
    n = len(codes) - length + 1
    if n < 1:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    return (range_hashes(sums(codes), at, at + length) + np.uint64(length)).view(np.int64)


def runs(item: np.ndarray, doc: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Longest common runs (item place, document place, length) of `shortest` codes or more, by equal seeds in a row."""
    own, other = _seeds(item.astype(np.uint64), shortest), _seeds(doc.astype(np.uint64), shortest)
    order = np.argsort(own, kind="stable")
    lo, hi = np.searchsorted(own[order], other, "left"), np.searchsorted(own[order], other, "right")
    j = np.repeat(np.arange(len(other)), hi - lo)
    if not len(j):
        return []
    i = order[np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo) + np.arange(len(j))]
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    new = np.concatenate(([True], (np.diff(j - i) != 0) | (np.diff(i) != 1)))
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(i))) + shortest - 1
    return list(zip(i[at].tolist(), j[at].tolist(), size.tolist(), strict=True))


def tile(item: np.ndarray, doc: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """Greedy tiles (item place, document place, length), longest first; ties by item, then document place.

    A run that an earlier tile cut goes back with each of its free stretches at its own length.
    """
    item_free, doc_free, tiles = np.ones(len(item), bool), np.ones(len(doc), bool), []
    heap = [(-n, i, j) for i, j, n in runs(item, doc, shortest)]
    heapq.heapify(heap)
    while heap:
        n, i, j = heapq.heappop(heap)
        free = item_free[i : i - n] & doc_free[j : j - n]
        if free.all():
            item_free[i : i - n] = doc_free[j : j - n] = False
            tiles.append((i, j, -n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= shortest:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return tiles


def _items(shortest: int):
    """item, item_id, length of its seeds, codes and seeds of every test item that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, name, text in zip(*(batch.column(c).to_pylist() for c in ("item", "item_id", "text")), strict=True):
                codes, _ = _coded([text])
                if len(codes):
                    length = min(shortest, len(codes))
                    rows.append({"item": item, "item_id": name, "length": length, "codes": codes.view(np.int64).tolist(), "seeds": _seeds(codes, length).tolist()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("length", pa.int32()), ("codes", pa.list_(pa.int64())), ("seeds", pa.list_(pa.int64()))]))

    return run


def _hits(lengths: list[int], bits: np.ndarray):
    """The seeds of documents that pass the filter, with their places."""
    size = np.uint64(64 * len(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runtime.slices(batches, "text", 1_500_000):
            codes, ends = _coded(batch.column("text").to_pylist())
            for length in lengths:
                seeds = _seeds(codes, length)
                bit = seeds.view(np.uint64) % size
                at = np.flatnonzero(bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
                of = np.searchsorted(ends, at, side="right")
                whole = at + length <= ends[of]
                at, of = at[whole], of[whole]
                row, start = pa.array(of), np.concatenate(([0], ends[:-1]))[of]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("tkey").take(row), pa.array(seeds[at]), pa.array((at - start).astype(np.int32))], ["doc_id", "tkey", "seed", "at"])

    return run


def _tiled(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "covered", "item_words", "coverage", "tiles", "tkey"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        for batch in batches:
            out = []
            for doc, key, name, length, codes, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tkey", "item_id", "length", "codes", "places")), strict=True):
                own = np.array(codes, np.int64)
                # a document's words under a shared seed are the item's; what lies between stretches keeps them apart
                at, near = -1, []
                for p in sorted((x["at"], x["held"]) for x in places):
                    if p[0] > at:
                        near.append(0)
                        at = p[0]
                    near.extend(codes[p[1] + at - p[0] : p[1] + length])
                    at = p[0] + length
                tiles = tile(own, np.array(near, np.int64), length)
                covered = sum(t[2] for t in tiles)
                if covered >= threshold * len(own):
                    out.append((doc, name, covered, len(own), covered / len(own), len(tiles), key))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _filter(seeds: DataFrame, n: int) -> np.ndarray:
    """The words of a Bloom filter of one hash; MOST_BITS / 64 of them at most reach the driver."""
    bits = max(LEAST_BITS, min(MOST_BITS, 1 << max(0, (n * BITS_A_SEED).bit_length())))
    made = np.zeros(bits // 64, np.uint64)
    place = F.col("seed").bitwiseAND(F.lit(bits - 1))  # a power of two: the remainder of the unsigned number too
    for r in seeds.groupBy(F.shiftright(place, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, CAST((seed & {bits - 1}) % 64 AS INT)))").alias("bits")).toLocalIterator():
        made[r["word"]] = np.int64(r["bits"]).view(np.uint64)
    return made


def _leaking(docs: DataFrame, benchmark: DataFrame, shortest: int, threshold: float) -> DataFrame:
    """The columns of `leaks` and tkey, the hash of the document's text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tkey"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    items = items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").mapInArrow(runtime.tidied(_items(shortest)), "item long, item_id long, length int, codes array<long>, seeds array<long>")
    items = runtime.written(items, "items")
    seeds = items.select("item", "length", F.posexplode("seeds").alias("held", "seed")).groupBy("seed", "item").agg(F.min("held").alias("held"))
    seeds = runtime.written(seeds, "seeds")
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())  # `shortest` values at most
    hits = rows.mapInArrow(runtime.tidied(_hits(lengths, _filter(seeds, seeds.count()))), HITS)
    met = hits.distinct().join(seeds, "seed")
    pairs = met.groupBy("doc_id", "tkey", "item").agg(F.collect_list(F.struct("at", "held")).alias("places"))
    return pairs.join(items.drop("seeds"), "item").mapInArrow(runtime.tidied(_tiled(threshold)), LEAKS)


def leaks(docs: DataFrame, benchmark: DataFrame, *, shortest: int = SHORTEST, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and test item that it leaks: doc_id, item_id, covered, item_words, coverage, tiles.

    Clean documents have no row. Items of fewer than `shortest` words leak where they stand whole, with their
    own length as that of seed and tile. Items without words and null texts match nothing. Ids may be null
    or repeated: documents, and items, of one id are told apart by their texts, and equal rows count once. Words are
    compared by 64-bit hashes.
    """
    return _leaking(docs, benchmark, shortest, threshold).drop("tkey")


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, shortest: int = SHORTEST, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that leak no item, each judged by itself: rows that share an id are told apart by their texts."""
    found = _leaking(docs, benchmark, shortest, threshold).select(F.col("doc_id").alias("bad_doc"), "tkey").distinct()
    bad = runtime.written(found, "leaking")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_doc"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["tkey"]), "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(runtime.table(spark, sf_dir, "documents"), runtime.table(spark, sf_dir, "benchmark"))
