"""Near copies by Golay-code fuzzy hashing, verified by exact Jaccard similarity; prefix filtering finds what that misses.

Two texts are near copies if their sets of `shingle`-word shingles have a Jaccard similarity of at least
`percent`. Work is on distinct sets, so copies cost one row each, in three steps:

* A set's SimHash fingerprint has four segments of 23 bits. For every pair of segments the near keys of both (see
  `golay`) are crossed; two segments that differ in two bits or fewer share one, of those that differ in more many
  do. A key is narrowed by a min-hash, one for each pair of segments, as 24 bits alone would meet by chance. The sets
  under a key are paired with two of them; of its pairs a set is compared by its texts in two at most, the second
  with a set of another component than the first has left it in. Such keys also meet far below the similarity, so
  in a large loose group most further comparisons would find nothing.
* A fingerprint can only make it likely that near copies meet. In any fixed order of shingles, two similar sets
  share one among the first n - ceil(percent * n) + 1 of each, so a join on these few keys loses no pair (up to
  64-bit hashes). Shingles of many texts stand last in the order; which ones these are decides only how many
  candidates there are. Where a key stands in two sets bounds what they can share from there on. The texts under a
  key are compared with two of them, where fuzzy hashing has left these in different components.
* Only texts that this still leaves in different components are compared with each other, so large groups need no
  square of comparisons.

Only keys are kept of a text; the few that are compared are read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import components, golay, runtime

SHINGLE, PERCENT = 5, 80
#: A shingle of more texts stands last in the order; of these the most frequent, at most so many.
COMMON, MOST_COMMON = 20, 500_000
#: Counting for that order reads one text in so many; the order need only be the same for all sets.
COUNTED = 16
#: Up to so many pairs (16 bytes each) are broadcast to the texts that they compare, beyond that texts are shuffled.
BROADCAST_PAIRS = 500_000
SEED = 42
SEGMENTS = 4
PAIRS = tuple(combinations(range(SEGMENTS), 2))
_PLACES = 1 << np.arange(golay.LENGTH)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted set of XXH64 hashes of word shingles; a text of fewer words is one shingle, none or null one of no words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64).view(np.int64)
    n = len(words) - shingle + 1
    grams = map(b" ".join, zip(*(words[i : n + i] for i in range(shingle)), strict=True))
    return np.unique(np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64, n).view(np.int64))


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Further hashes made of unsigned 64-bit ones."""
    z = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fuzzy(grams: np.ndarray) -> np.ndarray:
    """The segments of the set's SimHash, majority bits of its shingles' hashes, and a 32-bit min-hash for each pair of segments."""
    hashes, bits = grams.view(np.uint64), SEGMENTS * golay.LENGTH
    ones = np.zeros(bits, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.stack((hashes[at : at + (1 << 16)], _mixed(hashes[at : at + (1 << 16)], 1)), axis=1)
        ones += np.unpackbits(part.view(np.uint8), axis=1, count=bits, bitorder="little").sum(axis=0, dtype=np.int64)
    segments = (2 * ones > len(hashes)).reshape(SEGMENTS, golay.LENGTH) @ _PLACES
    return np.concatenate((segments, [int(_mixed(hashes, 2 + k).min() >> np.uint64(32)) for k in range(len(PAIRS))]))


def _golay_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sid, fkey: pair of segments, near keys of both, min-hash of the pair."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            held = batch.column("fuzzy").flatten().to_numpy().reshape(batch.num_rows, SEGMENTS + len(PAIRS))
            near, made = [golay.near_keys(held[:, s]) for s in range(SEGMENTS)], []
            for k, (i, j) in enumerate(PAIRS):
                a, b, tag = near[i][:, :, None], near[j][:, None, :], held[:, SEGMENTS + k][:, None, None]
                made.append(np.where((a < 0) | (b < 0), -1, (k << 24 | a << 12 | b) << 32 | tag).reshape(batch.num_rows, 36))
            keys = np.concatenate(made, axis=1)
            sids = np.broadcast_to(batch.column("sid").to_numpy()[:, None], keys.shape)
            yield pa.RecordBatch.from_arrays([pa.array(sids[keys >= 0]), pa.array(keys[keys >= 0])], ["sid", "fkey"])


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays])))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _made(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in runtime.slices(batches, "text"):
        yield batch, [shingles(t, shingle) for t in batch.column("text").to_pylist()]


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, made in _made(batches, shingle):
            yield pa.RecordBatch.from_arrays([batch.column("sid"), _lists(made)], ["sid", "grams"])

    return run


def _prefixes(shingle: int, percent: int, common: np.ndarray):
    """The keys of every text: the first shingles of its set, those of `common` (sorted) last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch, made in _made(batches, shingle):
            keys, ends = [], np.cumsum([len(g) for g in made])
            every = np.concatenate(made) if made else np.zeros(0, np.int64)
            found = np.minimum(np.searchsorted(common, every), max(len(common) - 1, 0))
            late = common[found] == every if len(common) else np.zeros(len(every), bool)
            for grams, end in zip(made, ends, strict=True):
                last = late[end - len(grams) : end]
                first = len(grams) - -(-percent * len(grams) // 100) + 1
                keys.append(np.concatenate((grams[~last], grams[last]))[:first])
            ids = np.fromiter((xxh64_intdigest(g.tobytes(), SEED) for g in made), np.uint64, len(made)).view(np.int64)
            sizes = pa.array([len(g) for g in made], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tkey"), pa.array(ids), sizes, _lists(keys), _lists([fuzzy(g) for g in made])], ["doc_id", "tkey", "sid", "n", "keys", "fuzzy"])

    return run


def _open(n: str, at: str, m: str, past: str, percent: int):
    """Whether sets of n and m shingles, with the key `at` and `past` in their orders, can be similar and have it as the first they share."""
    least = percent * (F.col(n) + F.col(m)).cast("long")
    return ((100 + percent) * (F.col(n) - F.col(at)) >= least) & ((100 + percent) * (F.col(m) - F.col(past)) >= least)


def _compared(pairs: DataFrame, docs: DataFrame, sets: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs(a, b) of sets(sid, doc_id, tkey) whose texts in docs(doc_id, tkey, text) are similar enough."""
    n = pairs.count()
    if not n:
        return pairs.select("a", "b")
    held = F.broadcast if n <= BROADCAST_PAIRS else lambda x: x
    sides = pairs.select("a", "b", F.col("a").alias("sid")).union(pairs.select("a", "b", F.col("b").alias("sid")))
    one = sets.join(held(sides.select("sid").distinct()), "sid", "left_semi").groupBy("sid").agg(F.min(F.struct("doc_id", "tkey")).alias("of")).select("sid", F.col("of.doc_id").alias("d"), F.col("of.tkey").alias("t"))
    texts = docs.join(held(one), docs["doc_id"].eqNullSafe(F.col("d")) & (docs["tkey"] == F.col("t"))).select("sid", "text")
    grams = texts.mapInArrow(runtime.tidied(_sets(shingle)), "sid long, grams array<long>")
    of = lambda c: F.max(F.when(F.col("sid") == F.col(c), F.col("grams"))).alias(f"{c}_grams")  # noqa: E731  repeated rows have equal sets
    both = grams.join(held(sides), "sid").groupBy("a", "b").agg(of("a"), of("b"))
    shared = F.expr("CAST(size(array_intersect(a_grams, b_grams)) AS LONG)")
    return both.where(shared * (100 + percent) >= (F.size("a_grams") + F.size("b_grams")) * percent).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, shingle: int, percent: int, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """Links among the pairs(a, b) that `_compared` has, and the pairs that need not be asked for again.

    A set is compared with the first it is paired with, then only with those that this has left in other
    components, so a large group of near copies needs about one comparison a set. The links leave no two of the
    components of all pairs apart, unless `whole` is false: then a set is compared with one of those others only,
    and just the pairs compared are done with.
    """
    one = lambda e: e.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    first = runtime.written(one(pairs), "pairs")
    near = runtime.written(_compared(first, docs, sets, shingle, percent), "links")
    found = components.roots(near)
    rest = _apart(pairs.join(first, ["a", "b"], "left_anti"), found)
    rest = runtime.written(rest if whole else one(rest), "pairs")
    more = runtime.written(_compared(rest, docs, sets, shingle, percent), "links")
    runtime.dropped(found)
    if not whole:
        return near.union(more), first.union(rest)
    runtime.dropped(first, rest)
    return near.union(more), pairs


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs(a, b) that lie in different components of found(node, root)."""
    root = lambda c: found.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    return pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").where("coalesce(a_root, a) <> coalesce(b_root, b)").select("a", "b")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _common(docs: DataFrame, shingle: int) -> np.ndarray:
    some = docs.where(F.pmod("tkey", F.lit(COUNTED)) == 0).select(F.lit(0).cast("long").alias("sid"), "text")
    counts = some.mapInArrow(runtime.tidied(_sets(shingle)), "sid long, grams array<long>").select(F.explode("grams").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * COUNTED > COMMON)
    return np.sort(np.array([r["key"] for r in counts.orderBy(F.desc("n"), "key").limit(MOST_COMMON).select("key").collect()], np.int64))


def golay_pairs(sets: DataFrame) -> DataFrame:
    """a < b for sets(sid, fuzzy) that meet under a key: every set there with the smallest and the largest sid of the key."""
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few bytes become many rows, so tasks are not to be merged by size
    single = sets.select("sid", "fuzzy").repartition(tasks, "sid").dropDuplicates(["sid"])
    keyed = single.mapInArrow(runtime.tidied(_golay_keys), "sid long, fkey long")
    block = Window.partitionBy("fkey")
    met = keyed.select("sid", F.min("sid").over(block).alias("low"), F.max("sid").over(block).alias("high")).where("low < high")
    ends = met.select("sid", F.explode(F.array("low", "high")).alias("end")).where("sid <> end")
    return ends.select(*_ordered("sid", "end")).distinct()


def _components(docs: DataFrame, sets: DataFrame, shingle: int, percent: int) -> DataFrame:
    """sid, root for every set of sets(doc_id, tkey, sid, n, keys, fuzzy) that has a near copy of another sid."""
    keyed = sets.select("sid", "n", F.posexplode("keys").alias("at", "key")).select("key", "sid", "n", "at").repartition("key").distinct()
    # the set with the fewest rare shingles before the key is most likely what the others were copied from
    block = Window.partitionBy("key")
    ends = {"first": F.min(F.struct("at", "sid", "n")), "last": F.min(F.struct("sid", "n", "at")), "m": F.count("*")}
    shared = runtime.written(keyed.select("*", *[e.over(block).alias(c) for c, e in ends.items()]).where("m > 1").drop("m"), "shared")

    met = runtime.written(golay_pairs(sets), "pairs")
    near, fuzz = _verified(met, docs, sets, shingle, percent, False)
    near, fuzz = runtime.written(near, "links"), runtime.written(fuzz, "pairs")
    found = components.roots(near)

    star = [shared.where((F.col("sid") != F.col(f"{e}.sid")) & _open("n", "at", f"{e}.n", f"{e}.at", percent)).select(*_ordered("sid", f"{e}.sid")) for e in ("first", "last")]
    star = star[0].union(star[1]).distinct().join(fuzz, ["a", "b"], "left_anti")
    star = _apart(star, found)
    star = runtime.written(star, "pairs")
    links = runtime.written(near.union(_verified(star, docs, sets, shingle, percent)[0]), "links")
    runtime.dropped(met, near, found)
    found = components.roots(links)

    marked = shared.join(found, F.col("sid") == F.col("node"), "left").select("key", "sid", "n", "at", F.coalesce("root", "sid").alias("root"))
    marked = runtime.written(marked, "marked")
    runtime.dropped(shared, found)
    mixed = marked.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    mixed = marked.join(mixed, "key", "left_semi")
    left, right = (mixed.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("sid", "n", "at", "root")]) for side in "ab")
    apart = (F.col("sid_a") < F.col("sid_b")) & (F.col("root_a") != F.col("root_b")) & _open("n_a", "at_a", "n_b", "at_b", percent)
    rest = left.hint("merge").join(right.hint("merge"), (left["key"] == right["key"]) & apart).select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b")).distinct()
    rest = runtime.written(rest.join(star.union(fuzz), ["a", "b"], "left_anti"), "pairs")
    more = runtime.written(_verified(rest, docs, sets, shingle, percent)[0], "links")
    roots = components.roots(links.union(more))
    runtime.dropped(fuzz, star, marked, rest, links, more)
    return roots.withColumnRenamed("node", "sid")


def near_copies(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, tkey (hash of the text) and root, equal for the rows of one component, for every row."""
    if not 0 < percent <= 100:
        raise ValueError("the similarity is a percentage above 0")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tkey"), "text")
    made = rows.mapInArrow(runtime.tidied(_prefixes(shingle, percent, _common(rows, shingle))), "doc_id long, tkey long, sid long, n int, keys array<long>, fuzzy array<long>")
    made = runtime.written(made, "prefixes")
    found = _components(rows, made, shingle, percent)
    named = runtime.written(made.select("doc_id", "tkey", "sid").join(found, "sid", "left").select("doc_id", "tkey", F.coalesce("root", "sid").alias("root")), "named")
    runtime.dropped(made)
    return named


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of docs for each component: that of the smallest doc_id, of equal ids one text; rows with a null doc_id stay, as none can be preferred.

    Rows that share an id but are no near copies of each other are told apart by their texts.
    """
    found = near_copies(docs.select("doc_id", "text"), **options).where("doc_id is not null")
    key, leader = runtime.fresh(docs, "text_key", "leader_id")
    leaders = found.groupBy("root").agg(F.min(F.struct("doc_id", "tkey")).alias("x")).select(F.col("x.doc_id").alias(leader), F.col("x.tkey").alias(f"{leader}_key")).distinct()
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = keyed.join(leaders, (F.col("doc_id") == F.col(leader)) & (F.col(key) == F.col(f"{leader}_key")), "left_semi").dropDuplicates(["doc_id", key])
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))
