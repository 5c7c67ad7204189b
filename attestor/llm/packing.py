"""Best-fit decreasing packing of token sequences.

Lengths are whole numbers up to the capacity, so pieces of one length are interchangeable and the
best-fit decreasing assignment is a function of the histogram of lengths alone. The driver gathers that
histogram (as many rows as the capacity, whatever the input) and runs best-fit decreasing over it with a
segment tree over remaining capacities: each descent finds the tightest open bin in logarithmic time, and
a run of equal bins is filled at once. The resulting plan maps rank ranges of each length to bins; pieces
get their rank by salted windows and look their bin up. The result equals document-at-a-time best fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime, tokens

CAPACITY = 2048
#: Pieces of one length that one window task ranks, at least, and how many such parts there are in all, about.
RANKED_TOGETHER, PARTS = 1_000, 500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = ("length", "first", "past", "bin", "per_bin", "at")


class CapacityTree:
    """Open bins by remaining capacity: a segment tree of counts over 0..capacity."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += n
            node >>= 1

    def tightest(self, least: int) -> int | None:
        """Smallest capacity of at least `least` that has an open bin."""
        node = self.leaves + least
        if self.count[node]:
            return least
        while node > 1 and (node & 1 or not self.count[node + 1]):
            node >>= 1
        if node <= 1:
            return None
        node += 1
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.leaves


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over {length: pieces}. Rows (length, first rank, past rank, bin, pieces a bin, offset) and the number of bins.

    Rank k of a row lies in bin `bin + (k - first) // per_bin` at `at + (k - first) % per_bin * length`.
    """
    tree, open_bins, rows, bins = CapacityTree(capacity), {}, [], 0

    def put(room: int, lo: int, hi: int) -> None:
        if room and hi > lo:
            open_bins.setdefault(room, []).append((lo, hi))
            tree.add(room, hi - lo)

    for length in sorted(histogram, reverse=True):
        rank, n = 0, histogram[length]
        while rank < n:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                lo, hi = bins, bins + -(-(n - rank) // each)
                bins = hi
            else:
                lo, hi = open_bins[room].pop()
                tree.add(room, lo - hi)
            each = room // length
            full = min(hi - lo, (n - rank) // each)
            if full:
                rows.append((length, rank, rank + full * each, lo, each, capacity - room))
                rank += full * each
                put(room - each * length, lo, lo + full)
                lo += full
            if lo < hi and rank < n:  # fewer pieces are left than fit in one bin
                rows.append((length, rank, n, lo, each, capacity - room))
                put(room - (n - rank) * length, lo, lo + 1)
                lo, rank = lo + 1, n
            put(room, lo, hi)
    return rows, bins


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = tokens.encoder(path), end_id.to_bytes(4, "little")
        for batch in runtime.slices(batches, "text"):
            out: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
                data = ids.tobytes() + end
                n, at = len(data) // 4, 0
                take = n if n <= capacity else n % capacity or capacity
                for piece in range(1 + (n - take) // capacity):
                    out.append((doc, piece, at, take, zlib.crc32(data[4 * at : 4 * (at + take)])))
                    at, take = at + take, capacity
            cols = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut_pieces(docs: DataFrame, *, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most `capacity` ids; a longer document's first piece takes the remainder. Null text: the end id alone."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(runtime.tidied(_cut(path or tokens.vocabulary_path(), end_id, capacity), encodes=True), PIECES)


def _numbers(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """Rows of whole numbers as a table. From an Arrow table the JVM makes it by itself; lists would start further Python workers on every executor."""
    return spark.createDataFrame(pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(names)}))


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces(doc_id, piece, start, length, ids_crc32).

    Every piece is placed once; equal rows take separate places. No pieces give no rows.
    """
    spark = pieces.sparkSession
    # grows with the capacity alone: one row a length
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan, _ = plan_bins(histogram, capacity)
    together = max(RANKED_TOGETHER, sum(histogram.values()) // PARTS)
    dealt = _numbers(spark, [(length, 1 + n // together) for length, n in histogram.items()], ("of_length", "salts"))  # a row a length
    salted = pieces.join(F.broadcast(dealt), F.col("length") == F.col("of_length")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))).drop("of_length", "salts")
    per = salted.groupBy("length", "salt").count()
    before = per.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    ranked = salted.withColumn("rn", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rn") - 1 + F.col("before"))
    steps = _numbers(spark, plan, PLAN).withColumnRenamed("length", "of")
    steps = F.broadcast(steps) if len(plan) <= 200_000 else steps  # 6 numbers a row: 10 MB at most
    k = F.col("rank") - F.col("first")
    placed = ranked.join(steps, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("bin") + F.floor(k / F.col("per_bin"))).alias("sequence_id"),
        (F.col("at") + F.pmod(k, F.col("per_bin")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Cut, write the narrow pieces once (encoding is the costly part), then pack."""
    return pack(runtime.written(cut_pieces(docs, **options), "pieces"), capacity=options.get("capacity", CAPACITY))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(runtime.table(spark, sf_dir, "documents"))
