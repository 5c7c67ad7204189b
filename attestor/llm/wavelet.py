"""Token ids as wavelet matrices.

A shard's ids are kept as bit planes, most significant first; after each plane the ids are stably
partitioned by its bit. Cumulative counts of ones every 512 bits give rank, and binary search over them
select, so one stored block answers access, count and occurrence queries without being expanded.

Container, little-endian: b"WMX1", u32 ids, u32 planes, u32 documents, then for the documents u32 lengths
and i64 doc_ids (a null id as the minimum), then for each plane u32 zeros, u32 counts, bytes of bits.
Blocks are rows of a Parquet table (zstd), committed by Spark's writer, so retried tasks leave no halves.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime, tokens

BLOCK_TOKENS = 2_000_000
#: Block starts are broadcast up to so many blocks (some 100 bytes each), joined by shuffle beyond.
BROADCAST_BLOCKS = 200_000
_NULL = np.iinfo(np.int64).min
STORED = "first_doc long, seq long, n_tokens long, content binary"


class WaveletMatrix:
    """Rank/select structure over unsigned ids."""

    def __init__(self, n: int, planes: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        self.n, self.planes = n, planes

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        depth = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        left, planes = ids.astype(np.uint16 if depth <= 16 else np.uint32), []
        for level in range(depth - 1, -1, -1):
            ones = left & left.dtype.type(1 << level) != 0
            bits = np.packbits(ones, bitorder="little")
            # positions first: a mask of random bits is slow to index with
            zeros = np.flatnonzero(~ones)
            planes.append((len(zeros), cls._directory(bits), bits))
            left = np.concatenate((left.take(zeros), left.take(np.flatnonzero(ones))))
        return cls(len(ids), planes)

    @staticmethod
    def _directory(bits: np.ndarray) -> np.ndarray:
        padded = np.zeros(-(-len(bits) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, 8).sum(axis=1)
        return np.concatenate(([0], np.cumsum(ones))).astype(np.uint32)

    @staticmethod
    def _rank(plane: tuple[int, np.ndarray, np.ndarray], i: int) -> int:
        """Ones among the first i bits."""
        _, counts, bits = plane
        block = i >> 9
        part = np.unpackbits(bits[block * 64 : (i + 7) >> 3], bitorder="little")[: i - block * 512]
        return int(counts[block]) + int(part.sum())

    def _select(self, plane: tuple[int, np.ndarray, np.ndarray], bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit."""
        _, counts, bits = plane
        held = counts.astype(np.int64) if bit else np.arange(len(counts), dtype=np.int64) * 512 - counts
        block = int(np.searchsorted(held, k, side="right")) - 1
        part = np.unpackbits(bits[block * 64 : block * 64 + 64], bitorder="little")
        return block * 512 + int(np.flatnonzero(part == bit)[k - int(held[block])])

    def access(self, i: int) -> int:
        value = 0
        for plane in self.planes:
            ones = self._rank(plane, i)
            bit = int(plane[2][i >> 3] >> (i & 7) & 1)
            value, i = value * 2 + bit, plane[0] + ones if bit else i - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        depth = len(self.planes)
        if token >> depth:
            return 0, 0
        for level, plane in enumerate(self.planes):
            a, b = self._rank(plane, lo), self._rank(plane, hi)
            lo, hi = (plane[0] + a, plane[0] + b) if token >> (depth - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of the token at positions lo to hi."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def locate(self, token: int, k: int) -> int:
        """Position of the token's k-th occurrence (from 0)."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            plane, bit = self.planes[level], token >> (len(self.planes) - 1 - level) & 1
            i = self._select(plane, bit, i - plane[0] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All ids, by undoing the partitions from the last plane up."""
        value = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for shift, (zeros, _, bits) in enumerate(reversed(self.planes)):
            ones = np.unpackbits(bits, count=self.n, bitorder="little").astype(bool)
            above = np.empty_like(value)
            above[np.flatnonzero(~ones)] = value[:zeros]
            above[np.flatnonzero(ones)] = value[zeros:] | value.dtype.type(1 << shift)
            value = above
        return value.astype(np.uint32)

    def dump(self, lengths: np.ndarray, doc_ids: np.ndarray) -> bytes:
        parts = [b"WMX1", struct.pack("<III", self.n, len(self.planes), len(lengths)), lengths.astype("<u4").tobytes(), doc_ids.astype("<i8").tobytes()]
        for zeros, counts, bits in self.planes:
            parts += [struct.pack("<I", zeros), counts.astype("<u4").tobytes(), bits.tobytes()]
        return b"".join(parts)

    @classmethod
    def load(cls, data: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray]:
        """The matrix, its documents' lengths and doc_ids."""
        if data[:4] != b"WMX1":
            raise ValueError("not a wavelet-matrix block")
        n, depth, docs = struct.unpack_from("<III", data, 4)
        at = 16

        def take(kind: str, size: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, size, at)
            at += got.nbytes
            return got

        lengths, doc_ids = take("<u4", docs), take("<i8", docs)
        n_bytes = (n + 7) // 8
        planes = [(int(take("<u4", 1)[0]), take("<u4", 1 + -(-n_bytes // 64)), take("u1", n_bytes)) for _ in range(depth)]
        return cls(n, planes), lengths, doc_ids


def _blocks(path: str, end_id: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, held, docs, size, seq = tokens.encoder(path), [], [], 0, 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in held], np.int64)
            matrix = WaveletMatrix.build(np.concatenate(held))
            content = matrix.dump(lengths, np.array([_NULL if d is None else d for d in docs], np.int64))
            return pa.RecordBatch.from_arrays([pa.array([docs[0]], pa.int64()), pa.array([seq], pa.int64()), pa.array([matrix.n], pa.int64()), pa.array([content], pa.binary())], ["first_doc", "seq", "n_tokens", "content"])

        end = np.array([end_id], np.uint32)
        for batch in runtime.slices(batches, "text"):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
                if held and size + len(ids) >= block_tokens:
                    yield flush()
                    held.clear(), docs.clear()
                    size, seq = 0, seq + 1
                held.append(np.concatenate((ids, end)))
                docs.append(doc)
                size += len(ids) + 1
        if held:
            yield flush()

    return run


def write_tokens(docs: DataFrame, target: str, *, path: str | None = None, end_id: int = 0, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode docs(doc_id, text), append the end id to each, and write blocks in ascending doc_id order (null ids first; null text as empty)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_blocks(path or tokens.vocabulary_path(), end_id, block_tokens), STORED).write.option("compression", "zstd").parquet(target)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for before, content in zip(batch.column("before").to_pylist(), batch.column("content"), strict=True):
            matrix, lengths, doc_ids = WaveletMatrix.load(content.as_py())
            data, ends = memoryview(matrix.tokens().tobytes()), np.cumsum(lengths, dtype=np.int64)
            starts = ends - lengths
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=doc_ids == _NULL), pa.array(before + starts, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, source: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the files alone."""
    stored = spark.read.schema(STORED).parquet(source)
    file = F.col("_metadata.file_name").alias("file")
    # a few numbers a block of two million ids: one task orders them
    order = Window.orderBy(F.col("first_doc").asc_nulls_first(), "file", "seq").rowsBetween(Window.unboundedPreceding, 0)
    totals = stored.select("first_doc", file, "seq", "n_tokens")
    starts = totals.select("file", "seq", (F.sum("n_tokens").over(order) - F.col("n_tokens")).alias("before"))
    small = totals.count() <= BROADCAST_BLOCKS
    blocks = stored.select(file, "seq", "content").join(F.broadcast(starts) if small else starts, ["file", "seq"])
    return blocks.select("before", "content").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = runtime.scratch_path(spark, "token-ids")
    write_tokens(runtime.table(spark, sf_dir, "documents"), target)
    return read_documents(spark, target)
