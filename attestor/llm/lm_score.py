"""Stupid-backoff scores of documents against the n-gram counts of the whole corpus.

Trigrams over token ids (a bounded vocabulary, so keys are exact) are exploded and packed by map task and
hash bucket of their context. A bucket counts its trigrams and contexts, sums log(c3/c2) per document for
trigrams seen `least` times or more, and passes the others on, bucketed by their last two ids, to the table
of bigram counts; what is rare there falls back to the unigrams. Each back-off multiplies by `factor`.
Packed rows are vectors of (key, document), a few bytes a token; a bucket's size is fixed, their number grows
with the corpus. Contexts that would fill a bucket alone, found in a sample of the texts, are dealt out by whole
trigram instead; their counts are added up over all buckets, and what waits for them is settled last.

A text's own n-grams are among the counts. With `least` at 2, an n-gram that the corpus holds only once, in the
very text that is scored, is not taken for known.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime, tokens

FACTOR, LEAST = 0.4, 2
#: Characters of text that fill one bucket.
BUCKET_CHARS = 8_000_000
_BITS = 21
_ID = (1 << _BITS) - 1
BEGIN, END = _ID, _ID - 1
#: A context of more tokens than this many buckets hold is dealt out; it is looked for in one text in SAMPLED. At most so many are.
HOT_SHARE, SAMPLED, MOST_HOT = 1.0, 256, 2_000_000
CHARS_A_TOKEN = 4
_SUMS, _REST, _BIGRAMS, _UNIGRAMS, _HOT, _WAITING, _REST_HOT = range(7)
PACKED = "kind int, bucket int, batch long, payload binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("batch", pa.int64()), ("payload", pa.binary())])


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte-plane by byte-plane (sorted keys as steps), compressed."""
    planes = [(a.dtype.str, len(a), np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()) for a in arrays]
    raw = pickle.dumps(planes, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    return [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, n).T).view(kind).ravel() if n else np.zeros(0, kind) for kind, n, b in pickle.loads(raw)]


def _bucket(pair: np.ndarray, buckets: int) -> np.ndarray:
    mixed = pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def _by_bucket(kind: int, keys: np.ndarray, pair: np.ndarray, docs: np.ndarray, ids: np.ndarray, batches: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int, bytes]]:
    order = np.argsort(keys, kind="stable")
    keys, docs, of = keys[order], docs[order], _bucket(pair, buckets)[order]
    order = np.argsort(of, kind="stable")
    met, cuts = np.unique(of[order], return_index=True)
    for b, part in zip(met.tolist(), np.split(order, cuts)[1:], strict=True):
        yield kind, b, 0, _packed(keys[part], docs[part], ids, batches)


def _packed(keys: np.ndarray, docs: np.ndarray, ids: np.ndarray, batches: np.ndarray) -> bytes:
    """Sorted keys with the documents that they stand in."""
    held, local = np.unique(docs, return_inverse=True)
    return _pack(np.diff(keys, prepend=0), local.astype(np.uint16 if len(held) < 1 << 16 else np.uint32), np.diff(ids[held], prepend=0), batches[held])


def _among(pairs: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Whether each pair is one of the sorted `hot`."""
    if not len(hot):
        return np.zeros(len(pairs), bool)
    return hot[np.minimum(np.searchsorted(hot, pairs), len(hot) - 1)] == pairs


def _load(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and document numbers of all payloads; by number the documents' ids and map batches."""
    keys, docs, ids, batches, base = [], [], [], [], 0
    for p in payloads:
        steps, local, held, batch = _unpack(p)
        keys.append(np.cumsum(steps))
        docs.append(local.astype(np.int32) + np.int32(base))
        ids.append(np.cumsum(held))
        batches.append(batch)
        base += len(held)
    if not keys:
        return (np.zeros(0, np.int64),) * 4
    return _joined(keys), _joined(docs), _joined(ids), _joined(batches)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts end to end; the list is emptied, so that both are not held for long."""
    whole = np.concatenate(parts)
    parts.clear()
    return whole


def _counts(sorted_keys: np.ndarray) -> np.ndarray:
    """For each of the sorted keys, how often it occurs."""
    starts = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate((starts, [len(sorted_keys)])))
    return np.repeat(sizes.astype(np.int32), sizes)


_NULL = np.iinfo(np.int64).min


def _trigrams_of(enc: tokens.Encoder, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram keys of begin, begin, ids, end, end; the number of the text that each stands in; ids and marks of each text."""
    encoded = enc.encode(texts)
    sizes = np.array([len(e) for e in encoded]) + 4
    flat = np.full(int(sizes.sum()), END, np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    flat[starts] = flat[starts + 1] = BEGIN
    inner = np.ones(len(flat), bool)
    inner[starts] = inner[starts + 1] = inner[ends - 1] = inner[ends - 2] = False
    flat[inner] = np.concatenate(encoded) if len(encoded) else []
    number = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    keep = number[2:] == number[:-2]
    keys = flat[:-2] << 2 * _BITS
    keys |= flat[1:-1] << _BITS
    keys |= flat[2:]
    return keys[keep], number[:-2][keep], sizes


def _explode(path: str, buckets: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for batch in runtime.slices(batches, "text", 5_000_000):
            keys, number, sizes = _trigrams_of(enc, batch.column("text").to_pylist())
            ids = np.array([_NULL if d is None else d for d in batch.column("doc_id").to_pylist()], np.int64)
            # names the batch by its content, so that a task that runs again says the same
            name = int.from_bytes(hashlib.sha256(ids.tobytes() + sizes.tobytes()).digest()[:8], "little", signed=True)
            place = keys >> _BITS
            if len(hot):
                place = np.where(_among(place, hot), keys, place)
            rows = list(_by_bucket(0, keys, place, number, ids, np.full(len(ids), name), buckets))
            for at in range(0, len(rows), 16):
                yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in rows[at : at + 16]], _SCHEMA)

    return run


def _contexts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for batch in runtime.slices(batches, "text", 5_000_000):
            keys, _, _ = _trigrams_of(enc, batch.column("text").to_pylist())
            pairs, n = np.unique(keys >> _BITS, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["token", "n"])

    return run


def _sums(kind: int, bucket: int, docs: np.ndarray, ids: np.ndarray, batches: np.ndarray, logs: np.ndarray, backed: bool) -> Iterator[tuple[int, int, int, bytes]]:
    """A packed row of document sums for each map batch: rows grow with buckets and batches, not with documents times buckets."""
    n, total = np.bincount(docs, minlength=len(ids)), np.bincount(docs, logs, len(ids))
    order = np.argsort(batches, kind="stable")
    order = order[n[order] > 0]
    names, starts = np.unique(batches[order], return_index=True)
    for name, part in zip(names.tolist(), np.split(order, starts)[1:], strict=True):
        yield kind, bucket, name, _pack(np.diff(ids[part], prepend=0), total[part], n[part].astype(np.int32), (n[part] * backed).astype(np.int32))


def _trigrams(buckets: int, least: int, hot: np.ndarray):
    def run(group: pa.Table) -> pa.Table:
        tokens.release()
        bucket = group.column("bucket")[0].as_py()
        keys, docs, ids, batches = _load(group.column("payload").to_pylist())
        order = np.argsort(keys)
        keys, docs = keys[order], docs[order]
        del order
        context = keys >> _BITS
        c3, c2 = _counts(keys), _counts(context)
        new = np.concatenate(([True], context[1:] != context[:-1]))
        dealt = _among(context, hot)  # of these the bucket has a part only
        whole = new & ~dealt
        out = [(_BIGRAMS, bucket, 0, _pack(np.diff(context[whole], prepend=0), c2[whole].astype(np.int64)))]
        if dealt.any():
            out.append((_HOT, bucket, 0, _pack(context[new & dealt], c2[new & dealt].astype(np.int64))))
        last = context[new] & _ID
        found, where = np.unique(last, return_inverse=True)
        out.append((_UNIGRAMS, bucket, 0, _pack(found, np.bincount(where, c2[new]).astype(np.int64))))
        scored = context & _ID != END  # the row after the end only counts its context
        seen = scored & (c3 >= least)
        logs = np.log(c3[seen])
        del c3
        c2[dealt] = 1  # known last
        logs -= np.log(c2[seen])
        del c2
        out += _sums(_SUMS, bucket, docs[seen], ids, batches, logs, False)
        del logs
        waits = seen & dealt
        if waits.any():
            out.append((_WAITING, bucket, 0, _packed(context[waits], docs[waits], ids, batches)))
        rest = scored & ~seen
        pair = keys[rest] & ((1 << 2 * _BITS) - 1)
        known = _among(pair, hot)
        out += _by_bucket(_REST, pair[~known], pair[~known], docs[rest][~known], ids, batches, buckets)
        if known.any():
            by = np.argsort(pair[known], kind="stable")
            out.append((_REST_HOT, bucket, 0, _packed(pair[known][by], docs[rest][known][by], ids, batches)))
        return pa.Table.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in out], _SCHEMA)

    return run


def _settle(hot: tuple[np.ndarray, np.ndarray], unigrams: tuple[np.ndarray, np.ndarray], factor: float):
    """Sums of what waited for the counts of contexts that were dealt out."""
    pairs, times = hot
    c2 = lambda k: times[np.searchsorted(pairs, k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, bucket, payload in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "payload")), strict=True):
                keys, docs, ids, names = _load([payload])
                if kind == _WAITING:  # counted with the trigrams already
                    for k, b, name, data in _sums(_SUMS, bucket, docs, ids, names, -np.log(c2(keys)), False):
                        held, total, n, _ = _unpack(data)
                        rows.append((k, b, name, _pack(held, total, n * 0, n * 0)))
                else:
                    words, n1 = unigrams
                    logs = math.log(factor) + np.log(c2(keys)) - np.log(n1[np.searchsorted(words, keys >> _BITS)])
                    rows += _sums(_SUMS, bucket, docs, ids, names, logs, True)
            yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in rows], _SCHEMA)

    return run


_SCORED = pa.schema([("doc_id", pa.int64()), ("log_sum", pa.float64()), ("n", pa.int64()), ("backed", pa.int64())])


def _reduce(group: pa.Table) -> pa.Table:
    """The documents of one map batch, their sums over all buckets added up."""
    parts = [_unpack(p) for p in group.column("payload").to_pylist()]
    ids, number = np.unique(np.concatenate([np.cumsum(p[0]) for p in parts]), return_inverse=True)
    total = np.bincount(number, np.concatenate([p[1] for p in parts]), len(ids))
    n, backed = (np.bincount(number, np.concatenate([p[k] for p in parts]), len(ids)).astype(np.int64) for k in (2, 3))
    return pa.table([pa.array(ids, pa.int64(), mask=ids == _NULL), total, n, backed], schema=_SCORED)


def _bigrams(unigrams: tuple[np.ndarray, np.ndarray], factor: float, least: int):
    def run(group: pa.Table) -> pa.Table:
        of = lambda kind: [p for k, p in zip(group.column("kind").to_pylist(), group.column("payload").to_pylist(), strict=True) if k == kind]
        keys, docs, ids, batches = _load(of(_REST))
        if not len(keys):
            return _SCHEMA.empty_table()
        tables = [_unpack(p) for p in of(_BIGRAMS)]
        pairs, n = np.concatenate([np.cumsum(t[0]) for t in tables]), np.concatenate([t[1] for t in tables])
        order = np.argsort(pairs)
        c2 = n[order][np.searchsorted(pairs[order], keys)]
        words, times = unigrams
        c1 = lambda w: times[np.searchsorted(words, w)]
        # a text's first id has the begin mark before it, which stands once in each text
        logs = np.where(c2 >= least, math.log(factor) + np.log(c2) - np.log(c1(keys >> _BITS)), 2 * math.log(factor) + np.log(c1(keys & _ID)) - math.log(times[words < BEGIN].sum()))
        rows = _sums(_SUMS, group.column("bucket")[0].as_py(), docs, ids, batches, logs, True)
        return pa.Table.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in rows], _SCHEMA)

    return run


def _open_unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in batch.column("payload").to_pylist():
            words, n = _unpack(p)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n)], ["token", "n"])


def _hot_contexts(rows: DataFrame, path: str, tokens_a_bucket: float, total: int) -> np.ndarray:
    """The contexts, sorted, that hold more than a share of a bucket, by a sample of the texts; which these are decides only where they are counted."""
    least = max(HOT_SHARE * tokens_a_bucket, total / MOST_HOT) / SAMPLED
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).mapInArrow(_contexts(path), "token long, n long")
    return np.sort(some.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > least).select("token").toPandas()["token"].to_numpy(np.int64))


def score(docs: DataFrame, *, path: str | None = None, factor: float = FACTOR, least: int = LEAST) -> DataFrame:
    """doc_id, n_scored (ids and the end of text), n_backed_off (those whose trigram was not known), log_score (natural logs summed) and mean_log for each doc_id.

    Null text counts as empty: only its end is scored. Rows that share a doc_id, null included (and -2^63, which
    stands for it), are scored as one document. Extra columns are ignored. No rows give none.
    """
    spark, path = docs.sparkSession, path or tokens.vocabulary_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chars = int(rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0])
    buckets = 1 + chars // BUCKET_CHARS
    hot = _hot_contexts(rows, path, BUCKET_CHARS / CHARS_A_TOKEN, chars // CHARS_A_TOKEN)
    exploded = rows.mapInArrow(_explode(path, buckets, hot), PACKED)
    level3 = runtime.written(exploded.groupBy("bucket").applyInArrow(_trigrams(buckets, least, hot), PACKED), "trigrams")

    def counted(kind: int) -> tuple[np.ndarray, np.ndarray]:
        """One row for each id of the vocabulary, or each hot context, at most."""
        got = level3.where(F.col("kind") == kind).mapInArrow(_open_unigrams, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas().sort_values("token")
        return got["token"].to_numpy(np.int64), got["n"].to_numpy(np.int64)

    unigrams = counted(_UNIGRAMS)
    level2 = level3.where(F.col("kind").isin(_REST, _BIGRAMS)).groupBy("bucket").applyInArrow(_bigrams(unigrams, factor, least), PACKED)
    sums = level3.where(F.col("kind") == _SUMS).unionByName(level2)
    if len(hot):
        sums = sums.unionByName(level3.where(F.col("kind").isin(_WAITING, _REST_HOT)).mapInArrow(_settle(counted(_HOT), unigrams, factor), PACKED))
    # a batch's sums are never more than its tokens
    by_batch = sums.groupBy("batch").applyInArrow(_reduce, "doc_id long, log_sum double, n long, backed long")
    total = by_batch.groupBy("doc_id").agg(F.sum("n").alias("n_scored"), F.sum("backed").alias("n_backed_off"), F.sum("log_sum").alias("log_sum"))
    return total.select("doc_id", "n_scored", "n_backed_off", F.round("log_sum", 6).alias("log_score"), F.round(F.col("log_sum") / F.col("n_scored"), 6).alias("mean_log"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(runtime.table(spark, sf_dir, "documents"))
