"""Repeated byte strings of the corpus, found in merged Burrows-Wheeler transforms, and their removal.

Content anchors (see `anchors`) leave the windows that may occur twice. Stretches of text under one
repeated anchor that are equal as a whole are repeated without further search. What is left, stretches of
a common anchor that differ somewhere, is dealt to buckets by anchor, and read as symbols of eight bytes laid
out from the anchor. A bucket sorts the suffixes of shards of bounded size, keeps their transforms, and
merges these by interleave refinement: the order of all suffixes by their first k symbols gives, through the
transforms alone, the order by k + 1, while the boundaries found on the way are the common-prefix
intervals; nothing is sorted again. A window holds at least 49 whole symbols; where an interval of that
depth has two suffixes or more, the eight remaining bytes of its windows decide, so the result is exact.

The same pass reads every text as words too: a symbol is a word there, and a window of 51 of them that
another document holds as well marks a shared passage, however few bytes it has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .anchors import anchors, range_hashes, sums

WINDOW = 400
#: Words of a shared passage, at least.
PASSAGE = 51
#: Words of a gram in texts read as words.
WORD_GRAM = 8
#: Bytes of a symbol; symbols in one shard; bytes of stretches that make one bucket.
SYMBOL, SHARD_SYMBOLS, BUCKET_BYTES = 8, 1 << 16, 6_000_000
#: Bytes of text whose anchors are sought at once; longer texts are read in such parts.
PART_BYTES = 1 << 20
_COLUMNS = {"doc_id": pa.int64(), "tkey": pa.int64(), "anchor": pa.int64(), "whole": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "off": pa.int32(), "at": pa.int32(), "size": pa.int32()}
ANCHORS = "doc_id long, tkey long, anchor long, whole long, lo int, hi int, off int, at int, size int"


def _rows(window: int, passage: int = PASSAGE):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runtime.slices(batches, "text", 1_500_000):
            whole_texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            texts, row_of, base_of = [], [], []
            for row, t in enumerate(whole_texts):
                # a very long text is read in parts that share a window less one byte: each start once
                for base in range(0, max(len(t) - window + 1, 1), PART_BYTES):
                    texts.append(t[base : base + PART_BYTES + window - 1])
                    row_of.append(row)
                    base_of.append(base)
            made = [_of_texts(texts[some], np.array(row_of[some]), np.array(base_of[some]), window) for some in _parts([len(t) for t in texts])]
            for some in _parts([len(t) for t in whole_texts]):
                made += _of_words(whole_texts[some], some.start, passage)
            for rows, *columns in (m for m in made if len(m[0])):
                named = [batch.column("doc_id").take(pa.array(rows)), batch.column("tkey").take(pa.array(rows)), *columns]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(named, _COLUMNS.values(), strict=True)], list(_COLUMNS))

    return run


def _parts(sizes: list[int]) -> Iterator[slice]:
    """Runs of texts that are held at once."""
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > 2 * PART_BYTES:
            yield slice(start, i)
            start, held = i, 0
        held += size
    yield slice(start, len(sizes))


def _marked(hashes: np.ndarray, kind: int) -> np.ndarray:
    """The low bit of an anchor tells bytes (0) from words (1)."""
    return ((hashes & ~np.uint64(1)) | np.uint64(kind)).view(np.int64)


def _of_texts(texts: list[bytes], row_of: np.ndarray, base_of: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Row, anchor, whole, lo, hi, off, at and size of each stretch of bytes."""
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    prefix = sums(data)
    at, hashes, lo, hi = anchors(data, ends, window, prefix=prefix)
    # equal hashes: the same bytes, and the anchor at the same place in them
    whole = range_hashes(prefix, lo, hi + window) * np.uint64(2 * 1023 + 1) + (at - lo).astype(np.uint64)
    of = np.searchsorted(ends, lo, side="right")
    moved = base_of[of] - np.concatenate(([0], ends[:-1]))[of]
    return row_of[of], _marked(hashes, 0), whole.view(np.int64), lo + moved, hi + moved, at - lo, lo + moved, hi - lo + window


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and past byte of each word of the texts laid end to end."""
    apart = np.ones(len(data) + 2, bool)
    apart[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    opens, closes = ~apart[1:-1] & apart[:-2], ~apart[1:-1] & apart[2:]
    edges = ends[(ends > 0) & (ends < len(data))]
    opens[edges] = ~apart[1:-1][edges]
    closes[edges - 1] = ~apart[1:-1][edges - 1]
    first, past = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return range_hashes(sums(data), first, past), first, past


def _of_words(texts: list[bytes], row: int, passage: int) -> list[tuple[np.ndarray, ...]]:
    """The same for stretches of words: lo and hi count words, at and size bytes."""
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    cuts = [0]  # a very long text is split into words in parts that end at white space
    while cuts[-1] < len(data):
        cut = min(cuts[-1] + 2 * PART_BYTES, len(data))
        while cut < len(data) and len(texts) == 1 and data[cut] > 32:
            cut += 1
        cuts.append(cut if len(texts) == 1 else len(data))
    split = [_words(data[a:b], ends if len(texts) > 1 else np.array([b - a])) for a, b in zip(cuts, cuts[1:])]
    if not split:
        return []
    codes = np.concatenate([s[0] for s in split])
    first, past = (np.concatenate([s[k] + a for s, a in zip(split, cuts)]) for k in (1, 2))
    word_ends = np.searchsorted(first, ends)  # words of all texts so far
    made = []
    for base in range(0, max(len(codes) - passage + 1, 1), PART_BYTES):
        part = codes[base : base + PART_BYTES + passage - 1]
        part_ends = np.clip(word_ends - base, 0, len(part))
        prefix = sums(part)
        at, hashes, lo, hi = anchors(part, part_ends, passage, WORD_GRAM, prefix)
        if not len(at):
            continue
        whole = range_hashes(prefix, lo, hi + passage) * np.uint64(2 * 1023 + 1) + (at - lo).astype(np.uint64)
        lo, hi, at = lo + base, hi + base, at + base
        of = np.searchsorted(word_ends, lo, side="right")
        words_before, bytes_before = np.concatenate(([0], word_ends[:-1]))[of], np.concatenate(([0], ends[:-1]))[of]
        made.append((row + of, _marked(hashes, 1), whole.view(np.int64), lo - words_before, hi - words_before, at - lo, first[lo] - bytes_before, past[hi + passage - 1] - first[lo]))
    return made


class Shard:
    """Symbol strings (symbols from 1) with the starts of their sorted suffixes and the transform; 0 ends a string."""

    def __init__(self, strings: list[np.ndarray], depth: int) -> None:
        sizes = np.array([len(s) + 1 for s in strings])
        self.ends = np.cumsum(sizes) - 1
        self.starts = np.concatenate(([0], self.ends[:-1] + 1))
        n, self.n_strings = int(sizes.sum()), len(strings)
        text = np.zeros(n, np.int64)
        inner = np.ones(n, bool)
        inner[self.ends] = False
        text[inner] = np.concatenate(strings)
        # terminators are ordered by string
        first = text + self.n_strings
        first[self.ends] = np.arange(self.n_strings)
        order = np.argsort(first, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], (np.diff(first[order]) != 0).cumsum()))
        left = self.ends[np.repeat(np.arange(self.n_strings), sizes)] - np.arange(n)
        step = 1
        while step < depth and rank.max() < n - 1:
            later = np.zeros(n, np.int64)
            later[: n - step] = rank[step:] + 1
            later[left < step] = 0
            key = rank * (n + 1) + later
            order = np.argsort(key, kind="stable")
            rank[order] = np.concatenate(([0], (np.diff(key[order]) != 0).cumsum()))
            step *= 2
        self.suffixes = order
        previous = text[order - 1]
        previous[np.isin(order, self.starts)] = 0
        self.transform = previous


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Which shard each place of the common order belongs to, and the first place of its interval of equal `depth`-symbol prefixes.

    Terminators of all shards come first, in order; they never share an interval. A round looks only at the
    suffixes whose successors' intervals were split in the round before: no others can be told apart.
    """
    sizes = [len(s.transform) for s in shards]
    n, base = sum(sizes), np.cumsum([0, *sizes])
    ends = sum(s.n_strings for s in shards)
    # the stable order of a transform's symbols leads from each suffix to the one that follows it in the text
    follows, first = np.empty(n, np.int64), np.empty(n, np.int64)
    terminal = np.zeros(n, bool)
    for s, lo in zip(shards, base, strict=False):
        by_symbol = np.argsort(s.transform, kind="stable")
        follows[lo : lo + len(by_symbol)] = by_symbol + lo
        first[lo : lo + len(by_symbol)] = s.transform[by_symbol]
        terminal[lo : lo + s.n_strings] = True
    leads = np.empty(n, np.int64)
    leads[follows] = np.arange(n)
    order = np.concatenate((np.flatnonzero(terminal), (inner := np.flatnonzero(~terminal))[np.argsort(first[inner], kind="stable")]))
    place, interval = np.empty(n, np.int64), np.empty(n, np.int64)
    place[order] = np.arange(n)
    new = np.ones(n, bool)
    new[ends + 1 :] = np.diff(first[order[ends:]]) != 0
    interval[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = np.zeros(n, bool)  # by suffix: no other has its interval
    alone[order] = new & np.append(new[1:], True)
    active = order[ends:][~alone[order[ends:]]]
    for _ in range(depth - 1):
        if not len(active):
            break
        mine, after = interval[active], interval[follows[active]]
        by = np.argsort(mine * n + after, kind="stable")
        active, mine, after = active[by], mine[by], after[by]
        head = np.concatenate(([True], mine[1:] != mine[:-1]))
        new = head.copy()
        new[1:] |= after[1:] != after[:-1]
        groups = np.cumsum(head) - 1
        opening = np.flatnonzero(head)
        at = mine + np.arange(len(active)) - opening[groups]
        order[at], place[active] = active, at
        interval[active] = np.maximum.accumulate(np.where(new, at, 0))
        alone[active] = new & np.append(new[1:], True)
        split = np.bincount(groups, new)[groups] > 1
        # suffixes before those that were split, by whole intervals
        moved = leads[active[split]]
        moved = moved[~terminal[moved] & ~alone[moved]]
        active = order[np.sort(place[moved])]
    owner = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)[order]
    return owner, interval[order]


def _repeated(*keys: np.ndarray) -> np.ndarray:
    """Whether each row of the key columns occurs twice or more."""
    order = np.lexsort(keys)
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    out = np.zeros(len(order), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _intervals(strings: list[np.ndarray], depth: int, shard_symbols: int = SHARD_SYMBOLS) -> np.ndarray:
    """For every symbol (1 and up) of the strings laid end to end, the interval of its suffix; -1 where no other suffix has it."""
    shards, part, size = [], [], 0
    for c in strings:
        if part and size + len(c) > shard_symbols:
            shards.append(Shard(part, depth))
            part, size = [], 0
        part.append(c)
        size += len(c) + 1
    shards.append(Shard(part, depth))
    owner, block = merge(shards, depth)
    often = np.bincount(block)[block] > 1
    interval, at = np.full(sum(map(len, strings)), -1, np.int64), 0
    for j, shard in enumerate(shards):
        mine = owner == j
        n = len(shard.transform)
        by_text = np.empty(n, np.int64)
        by_text[shard.suffixes] = np.where(often[mine], block[mine], -1)
        inner = np.ones(n, bool)
        inner[shard.ends] = False
        interval[at : at + n - shard.n_strings] = by_text[inner]
        at += n - shard.n_strings
    return interval


def repeated_starts(strings: list[bytes], offsets: list[int], window: int, shard_symbols: int = SHARD_SYMBOLS) -> list[np.ndarray]:
    """For each string the starts whose `window` bytes occur elsewhere among the strings. `offsets` place the anchors."""
    if not strings:
        return []
    phases = np.array(offsets) % SYMBOL
    depth = (window - SYMBOL + 1) // SYMBOL
    room = window - depth * SYMBOL  # bytes of a window besides its whole symbols: eight to fifteen
    held, lefts, rights, counts = [], [], [], []
    for s, phase in zip(strings, phases, strict=True):
        n = (len(s) - int(phase)) // SYMBOL
        padded = bytes(SYMBOL - int(phase)) + s + bytes(SYMBOL * (depth + 3))
        words = np.frombuffer(padded, "<u8", len(padded) // SYMBOL)
        held.append(words[1 : n + 1])
        lefts.append(words[:n])
        rights.append(words[depth + 1 : depth + 1 + n])
        counts.append(n)
    _, symbol = np.unique(np.concatenate(held), return_inverse=True)
    cuts = np.concatenate(([0], np.cumsum(counts)))
    interval = _intervals([symbol[a:b] + 1 for a, b in zip(cuts[:-1], cuts[1:], strict=True)], depth, shard_symbols)
    number = np.repeat(np.arange(len(strings)), counts)
    places = np.arange(len(number)) - cuts[number]
    starts = places * SYMBOL + phases[number]
    last = np.array([len(s) - window for s in strings])[number]
    cand = np.flatnonzero(interval >= 0)
    left, right = np.concatenate(lefts)[cand], np.concatenate(rights)[cand]
    found_at, found_of = [], []
    for j in range(room):
        s = starts[cand] - j
        ok = (s >= 0) & (s <= last[cand])
        if room == SYMBOL:  # the two fringes are eight bytes together
            mask = (1 << 8 * (SYMBOL - j)) - 1
            key = (left & np.uint64(((1 << 64) - 1) ^ mask)) | (right & np.uint64(mask))
            hit = _repeated(interval[cand][ok], key[ok])
        else:
            texts = [strings[i] for i in number[cand][ok]]
            fringe = [(t[a : a + j], t[a + j + depth * SYMBOL : a + window]) for t, a in zip(texts, s[ok].tolist(), strict=True)]
            codes: dict = {}
            key = np.array([codes.setdefault(f, len(codes)) for f in fringe], np.int64)
            hit = _repeated(interval[cand][ok], key)
        found_at.append(s[ok][hit])
        found_of.append(number[cand][ok][hit])
    return _by_string(np.concatenate(found_of), np.concatenate(found_at), len(strings))


def _by_string(of: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.lexsort((at, of))
    of, at = of[order], at[order]
    edge = np.searchsorted(of, np.arange(n + 1))
    return [np.unique(at[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def shared_starts(strings: list[bytes], owners: list[int], passage: int, shard_symbols: int = SHARD_SYMBOLS) -> list[np.ndarray]:
    """For each string the words (from 0) at which `passage` words begin that a string of another owner holds too; owner -1 is several."""
    codes: dict[bytes, int] = {}
    coded = [np.array([codes.setdefault(w, len(codes) + 1) for w in s.split()], np.int64) for s in strings]
    interval = _intervals(coded, passage, shard_symbols)
    counts = [len(c) for c in coded]
    number = np.repeat(np.arange(len(strings)), counts)
    owner = np.array(owners)[number]
    cand = np.flatnonzero(interval >= 0)
    cand = cand[np.argsort(interval[cand], kind="stable")]
    if not len(cand):
        return [np.zeros(0, np.int64)] * len(strings)
    new = np.concatenate(([True], np.diff(interval[cand]) != 0))
    low, high = (f.reduceat(owner[cand], np.flatnonzero(new)) for f in (np.minimum, np.maximum))
    hit = cand[((low != high) | (low < 0))[np.cumsum(new) - 1]]
    return _by_string(number[hit], hit - np.concatenate(([0], np.cumsum(counts)))[number[hit]], len(strings))


def _search(window: int, passage: int):
    def run(group: pa.Table) -> pa.Table:
        strings = group.column("stretch").to_pylist()
        if group.column("of_words")[0].as_py():
            owners: dict = {}
            docs = zip(*(group.column(c).to_pylist() for c in ("doc_id", "tkey", "many")), strict=True)
            found, size = shared_starts(strings, [-1 if many else owners.setdefault((d, t), len(owners)) for d, t, many in docs], passage), passage
        else:
            found, size = repeated_starts(strings, group.column("off").to_pylist(), window), window
        out: tuple[list, list, list, list] = ([], [], [], [])
        for anchor, whole, starts in zip(group.column("anchor").to_pylist(), group.column("whole").to_pylist(), found, strict=True):
            if len(starts):
                edge = np.flatnonzero(np.concatenate(([True], np.diff(starts) > size)))
                last = np.concatenate((edge[1:], [len(starts)])) - 1
                out[0].extend([anchor] * len(edge))
                out[1].extend([whole] * len(edge))
                out[2].extend(starts[edge].tolist())
                out[3].extend((starts[last] + size).tolist())
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["anchor", "whole", "s", "e"])

    return run


def _united(spans: list[dict] | None) -> list[list[int]]:
    merged: list[list[int]] = []
    for x in sorted((x["s"], x["e"]) for x in spans or ()):
        if merged and x[0] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], x[1])
        else:
            merged.append(list(x))
    return merged


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, spans, passages in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans", "passages")), strict=True):
            data = (text or "").encode()
            merged = _united(spans)
            digest, at = hashlib.sha256(), 0
            for s, e in [*merged, [len(data), len(data)]]:
                digest.update(data[at:s])
                at = e
            out.append((doc, len(data), sum(e - s for s, e in merged), len(merged), digest.hexdigest(), sum(e - s for s, e in _united(passages))))
        if out:
            kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "n_shared_words": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))


def repeated_spans(docs: DataFrame, window: int = WINDOW, passage: int = PASSAGE) -> DataFrame:
    """doc_id, tkey (hash of the text) and two lists for the rows of docs(doc_id, tkey, text) that have any.

    spans: byte ranges covered by strings of `window` bytes that occur twice or more. passages: ranges of words
    covered by `passage` words that another document (one of another id or text) holds too. Ranges may overlap.
    """
    spark = docs.sparkSession
    found = runtime.written(docs.mapInArrow(_rows(window, passage), ANCHORS), "anchors")
    stretch = F.struct("doc_id", "tkey", "lo", "hi", "off", "at", "size")
    # distinct stretches first, so that groups of copies are one row each
    kinds = found.groupBy("anchor", "whole").agg(F.count("*").alias("n"), F.min(stretch).alias("one"), F.max(F.struct("doc_id", "tkey")).alias("last"))
    kinds = kinds.withColumn("first", F.struct("one.doc_id", "one.tkey"))
    sizes = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("all"), F.min("first").alias("low"), F.max("last").alias("high"))
    of_words = F.col("anchor").bitwiseAND(F.lit(1)) == 1
    often = sizes.where(F.when(of_words, ~F.col("low").eqNullSafe(F.col("high"))).otherwise(F.col("all") > 1)).select("anchor", "kinds")
    many = ~F.col("first").eqNullSafe(F.col("last"))
    kinds = runtime.written(kinds.join(often, "anchor").select("anchor", "whole", "n", "one", "kinds", many.alias("many")), "stretches")
    contested = kinds.where("kinds > 1").select("anchor", "whole", "many", "one.*")
    size = contested.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = 1 + int(size) // BUCKET_BYTES
    wanted = contested.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("anchor", "whole", "many", "off", "at", "size")).alias("want"))
    wanted = wanted.withColumnsRenamed({"doc_id": "d", "tkey": "t"})
    once = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["d"]) & (docs["tkey"] == wanted["t"])).dropDuplicates(["d", "t"])
    rows = once.select("doc_id", "tkey", F.encode("text", "UTF-8").alias("data"), F.explode("want").alias("w")).select(
        "doc_id", "tkey", "w.anchor", "w.whole", "w.many", "w.off", F.expr("substring(data, w.at + 1, w.size)").alias("stretch")
    )
    bucket = F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("bucket")
    parts = rows.select("*", of_words.alias("of_words"), bucket).groupBy("of_words", "bucket").applyInArrow(_search(window, passage), "anchor long, whole long, s int, e int")
    parts = runtime.written(parts, "repeats")
    width = F.when(of_words, passage).otherwise(window)
    whole = F.when(of_words, F.col("many")).otherwise(F.col("n") > 1)
    fully = found.join(kinds.where(whole).select("anchor", "whole"), ["anchor", "whole"]).select("doc_id", "tkey", of_words.alias("of_words"), F.col("lo").alias("s"), (F.col("hi") + width).alias("e"))
    single = found.join(parts, ["anchor", "whole"]).select("doc_id", "tkey", of_words.alias("of_words"), (F.col("lo") + F.col("s")).alias("s"), (F.col("lo") + F.col("e")).alias("e"))
    held = F.struct("s", "e")
    both = fully.unionByName(single).groupBy("doc_id", "tkey").agg(F.collect_set(F.when(~F.col("of_words"), held)).alias("spans"), F.collect_set(F.when(F.col("of_words"), held)).alias("passages"))
    both = runtime.written(both, "spans")
    runtime.dropped(found, kinds, parts)
    return both


def remove_repeats(docs: DataFrame, window: int = WINDOW, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_shared_words for every row of docs(doc_id, text).

    Every byte under a `window`-byte string that also starts elsewhere (same row included) goes. Null text
    is empty; texts under `window` bytes keep all. Rows equal in id and text repeat each other wholly.
    n_shared_words counts the words under runs of `passage` words that also stand in another document, one of
    another id or text; words are divided by ASCII white space. It marks shared passages of fewer bytes
    than the window, and takes no part in the removal.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tkey", F.xxhash64("text"))
    spans = repeated_spans(rows, window, passage).withColumnsRenamed({"doc_id": "d", "tkey": "t"})
    joined = rows.join(spans, rows["doc_id"].eqNullSafe(spans["d"]) & (rows["tkey"] == spans["t"]), "left")
    return joined.select("doc_id", "text", "spans", "passages").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(runtime.table(spark, sf_dir, "documents"))
