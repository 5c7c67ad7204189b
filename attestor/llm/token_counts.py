"""Token counts behind a digest cache.

A text's content digest (sha-256 of its UTF-8 bytes; null counts as the empty text) and the digest of
the tokenizer file key a stored count. Normalisation is the identity besides null -> '', as any other
would change counts. Only distinct digests that the cache lacks are encoded, and their counts appended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime, tokens

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
#: A digest of more than one in HOT_SHARE rows (so fewer than HOT_SHARE digests) is dealt into SALTS parts.
HOT_SHARE, SALTS = 1000, 256
#: Digests that a task remembers at most.
REMEMBERED = 2_000_000


def _first_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map-side combine: a task forwards each digest's text once while it remembers the digest."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, d in enumerate(batch.column("digest").to_pylist()):
            if d not in seen:
                seen.add(d)
                keep.append(i)
        if len(seen) > REMEMBERED:
            seen.clear()
        if keep:
            yield batch.take(pa.array(keep))


def _counter(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, done = tokens.encoder(path), set()
        for batch in runtime.slices(batches, "text"):
            digests, texts = batch.column("digest").to_pylist(), batch.column("text").to_pylist()
            fresh = {d: t for d, t in zip(digests, texts, strict=True) if d not in done}
            if len(done) > REMEMBERED:  # a digest that comes again is counted again, and read once from the cache
                done.clear()
            done.update(fresh)
            if fresh:
                n = enc.count(list(fresh.values()))
                yield pa.RecordBatch.from_arrays([pa.array(list(fresh), pa.binary()), pa.array([version] * len(n)), pa.array(n, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    return run


def _stored(spark: SparkSession, cache_path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The stored counts; an absent cache is an empty one."""
    if not _stored(spark, cache_path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)


def _with_counts(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows(doc_id, n_bytes, digest) with n_tokens of known(digest, n_tokens); rows of a large group of copies go to many tasks."""
    copies = rows.groupBy("digest").agg(F.count("*").alias("n"))
    least = rows.count() // HOT_SHARE
    hot = copies.where(F.col("n") > max(least, 1)).select("digest", F.lit(True).alias("hot"))
    rows = rows.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(0))
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    known = known.join(F.broadcast(hot), "digest", "left").select("digest", "n_tokens", F.explode(parts).alias("salt"))
    return rows.join(known, ["digest", "salt"], "left").select("doc_id", "n_bytes", "n_tokens")


def count_tokens(docs: DataFrame, cache_path: str, *, path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs(doc_id, text), via the cache at `cache_path`.

    Null and empty texts count 0. Repeated rows and null ids give a row each. A digest appended twice
    (two writers, a retried append) is read once. Extra columns are ignored.
    """
    spark, path = docs.sparkSession, path or tokens.vocabulary_path()
    version = tokens.vocabulary_digest(path)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digest = F.unhex(F.sha2(F.col("text"), 256)).alias("digest")
    # one text a digest and map task crosses the shuffle, however large a group of copies is
    dealt = keyed.select(digest, "text").mapInArrow(_first_of_batch, "digest binary, text string").repartition("digest")
    if _stored(spark, cache_path):  # the join keeps the partitions by digest: text is shuffled once
        stored = read_cache(spark, cache_path).where(F.col("tokenizer") == version)
        dealt = dealt.join(stored.select("digest").distinct(), "digest", "left_anti")
    dealt.mapInArrow(_counter(path, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    known = read_cache(spark, cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = runtime.written(keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest), "digests")
    return _with_counts(rows, known).withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cold start: the query's own, empty cache, so that every distinct text is encoded."""
    return count_tokens(runtime.table(spark, sf_dir, "documents"), runtime.scratch_path(spark, "token-cache"))
