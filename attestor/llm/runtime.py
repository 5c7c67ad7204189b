"""Shared plumbing of the corpus operators: scratch tables, batch slicing, table access, memory of Python workers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from ..sources import scratch
from . import anchors, tokens


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path below the shared folder."""
    return f"{scratch.root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so that a lost executor costs one stage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._scratch = path
    return made


def dropped(*tables: DataFrame) -> None:
    """Delete scratch tables made by `written` that no later step reads."""
    for df in tables:
        drop_path(df.sparkSession, df._scratch)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like `names` that no column of df has."""
    held = {c.lower() for c in df.columns}
    made = []
    for name in names:
        while name.lower() in held:
            name += "_"
        made.append(name)
    return made


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """Re-cut Arrow batches so that each holds about `limit` bytes of `text` (one row at least)."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def give_back() -> None:
    """Return this process's free memory to the system; Arrow and the C library would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidied(run: Callable, *, encodes: bool = False) -> Callable:
    """`run` for mapInArrow, with little left in the worker afterwards.

    Spark keeps idle workers, and what they hold is missing in the steps that follow. Encoders are costly to
    make, so they stay between tasks that encode.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes:
            tokens.release()
        yield from run(batches)
        anchors.release()
        give_back()

    return whole
