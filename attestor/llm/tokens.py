"""Exact, memoised encoding with the tokenizers library.

Byte-level BPE never merges across a single space or newline that stands between two visible
characters: such a separator always opens the next piece. A regular text (words divided by one space
or newline each) is therefore cut there, and before punctuation that ends a word; every distinct unit is
encoded once by the library, and the ids of a text are gathered from the memo. Unknown units go to the
library many at a time, each with its separator; the bytes that every id stands for tell whose ids they
are. Any other text, and one that holds an added token's string, goes to the library whole. Both ways
give the library's own ids.
"""

from __future__ import annotations

import hashlib
import os
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Units that one Python worker remembers (about 50 bytes each, as Arrow arrays); beyond it only those used again stay.
MEMO_UNITS = 500_000
#: Unknown units that are encoded as one text; the library takes longer over a unit of longer texts.
JOINED = 200
#: White space besides the two separators, and separators that stand together.
_IRREGULAR = (*(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"), "  ", " \n", "\n ", "\n\n")
#: Punctuation that is cut from a word's end has so many bytes at most.
_TAIL = 16
#: Kinds of last bytes: ASCII punctuation, ASCII letters and digits, letters from U+00C0 to U+00FF after 0xC3.
_PUNCTUATION, _ALNUM, _LATIN = 1, 2, 3
_KINDS = np.array([_ALNUM if chr(b).isalnum() and b < 128 else _PUNCTUATION if 32 < b < 127 else _LATIN if 128 <= b < 192 and b not in (0x97, 0xB7) else 0 for b in range(256)], np.uint8)
DEFAULT_VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_digest(path: str) -> str:
    """Names the tokenizer version: any change of the file changes it."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


class Encoder:
    """Ids of whole texts; `add_special_tokens` is off and special strings follow the library's default."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_unit = self._separable()
        self.token_bytes = self._token_bytes()
        self._reset()

    def _separable(self) -> bool:
        """Only plain byte-level BPE (no normaliser, no prefix space) allows cutting at separators."""
        import json

        conf = json.loads(self.tokenizer.to_str())
        pre = conf.get("pre_tokenizer") or {}
        return conf["model"]["type"] == "BPE" and not conf.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)

    def _token_bytes(self) -> np.ndarray:
        """Bytes that each id stands for: a byte-level token has one character a byte."""
        vocabulary = self.tokenizer.get_vocab()
        sizes = np.zeros(1 + max(vocabulary.values(), default=0), np.int64)
        sizes[list(vocabulary.values())] = list(map(len, vocabulary))
        return sizes

    def _reset(self) -> None:
        self.units = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.large_list(pa.uint32()))
        self.uses = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Drop the units that were used once; all, if the others leave no room."""
        kept = pa.array(np.flatnonzero(self.uses > 1))
        units, ids = self.units.take(kept), self.ids.take(kept)
        self._reset()
        if len(kept) <= MEMO_UNITS // 2:
            self.units, self.ids, self.uses = units, ids, np.ones(len(kept), np.int64)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _one_by_one(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each part, and the ids of all."""
        got = self._library(parts)
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return sizes, np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum()))

    def _joined(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for parts that each open with a separator, fewer texts for the library."""
        if not len(parts) or any(a.split() != [a] for a in self.added):  # joined parts could make up such a token
            return self._one_by_one(parts.to_pylist())
        places, data = _bytes_of(parts)
        _, flat = self._one_by_one([str(data[a:b], "utf-8") for a, b in pairwise([*places[:-1:JOINED].tolist(), len(data)])])
        upto, ends = np.cumsum(self.token_bytes[flat]), places[1:]
        last = np.searchsorted(upto, ends)
        if last[-1] != len(flat) - 1 or (upto[last] != ends).any():  # an id of unknown width
            return self._one_by_one(parts.to_pylist())
        return np.diff(last, prepend=-1), flat

    def _learn(self, fresh: pa.Array) -> np.ndarray:
        """Add units to the memo; the numbers that they get."""
        places, data = _bytes_of(fresh)
        heads = data[places[:-1]]
        # \r marks a text's first word and cut punctuation, which have no separator before them
        inner, opening = np.flatnonzero(heads != 13), np.flatnonzero(heads == 13)
        order = np.concatenate((inner, opening))
        separators = pa.array(np.where(heads[inner] == 10, "", " ").tolist(), pa.large_string())
        inner_sizes, inner_ids = self._joined(pa.compute.binary_join_element_wise(separators, fresh.take(pa.array(inner)), pa.scalar("", pa.large_string())))
        first_sizes, first_ids = self._one_by_one([u[1:] for u in fresh.take(pa.array(opening)).to_pylist()])
        ends = np.cumsum(np.concatenate(([0], inner_sizes, first_sizes)))
        ids = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.concatenate((inner_ids, first_ids))))
        numbers = np.empty(len(order), np.int64)
        numbers[order] = np.arange(len(self.units), len(self.units) + len(order))
        self.units, self.ids = pa.concat_arrays([self.units, fresh.take(pa.array(order))]), pa.concat_arrays([self.ids, ids])
        return numbers

    def _regular(self, text: str) -> str | None:
        """The text with one space between its units, and the mark of the first."""
        if not self.by_unit or not text or text[0] in " \n" or text[-1] in " \n" or any(map(text.__contains__, _IRREGULAR)) or any(a in text for a in self.added):
            return None
        return "\r" + text.replace("\n", " \n")

    def _numbers(self, names: pa.Array) -> np.ndarray:
        """Numbers of different units, after the memo has learned the unknown ones."""
        # the memo is looked up among the names, whose table is smaller, not the other way round
        met = pa.compute.fill_null(pa.compute.index_in(self.units, value_set=names), -1).to_numpy()
        known = np.flatnonzero(met >= 0)
        numbers = np.full(len(names), -1, np.int64)
        numbers[met[known]] = known
        fresh = np.flatnonzero(numbers < 0)
        if len(fresh):
            numbers[fresh] = self._learn(names.take(pa.array(fresh)))
        return numbers

    def _ids_of(self, words: pa.Array, times: np.ndarray) -> pa.Array:
        """Lists of ids of different words, which stand so many times in the texts."""
        cores, tails, cut = _without_tails(words)
        ends = tails.dictionary_encode()
        marked = pa.compute.binary_join_element_wise(pa.scalar("\r", pa.large_string()), ends.dictionary, pa.scalar("", pa.large_string()))
        coded = pa.concat_arrays([cores, marked]).dictionary_encode()
        numbers = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        at = np.arange(len(words) + 1) + np.concatenate(([0], np.cumsum(cut)))
        parts = np.empty(at[-1], np.int64)
        parts[at[:-1]] = numbers[: len(words)]
        parts[at[:-1][cut] + 1] = numbers[len(words) :][ends.indices.to_numpy()]
        uses = np.bincount(parts, np.repeat(times, np.diff(at)), len(self.units)).astype(np.int64)
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        got = self.ids.take(pa.array(parts))
        return pa.LargeListArray.from_arrays(got.offsets.take(pa.array(at)), got.values)

    def _plan(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """Ids of the different words of the regular texts, which of these each word is, end of each text's words, ids of the other texts."""
        if len(self.units) > MEMO_UNITS:
            self._forget()
        made, odd, held = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            spaced = self._regular(text)
            if spaced is not None:
                made.append(spaced)
                held[i] = 1
            elif text:
                odd.append(i)
        ids, which = self.ids[:0], np.zeros(0, np.int32)
        if made:
            split = pa.compute.split_pattern(pa.array(made, pa.large_string()), " ")
            coded = split.values.dictionary_encode()
            which, held[held > 0] = coded.indices.to_numpy(), np.diff(split.offsets.to_numpy())
            ids = self._ids_of(coded.dictionary, np.bincount(which))
        whole = dict(zip(odd, (np.array(x, np.uint32) for x in self._library([texts[i] for i in odd])), strict=True)) if odd else {}
        return ids, which, np.cumsum(held), whole

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, which, ends, whole = self._plan(texts)
        got = ids.take(pa.array(which))
        flat, cut = got.values.to_numpy(), got.offsets.to_numpy()[ends].tolist()
        return [whole[i] if i in whole else flat[cut[i - 1] if i else 0 : cut[i]] for i in range(len(texts))]

    def count(self, texts: list[str]) -> np.ndarray:
        ids, which, ends, whole = self._plan(texts)
        sizes = np.diff(ids.offsets.to_numpy())
        n = np.diff(np.concatenate(([0], np.cumsum(sizes[which])))[ends], prepend=0)
        for i, odd in whole.items():
            n[i] = len(odd)
        return n


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the large strings (one at least) begins, with the end of the last, and the bytes of all."""
    _, places, data = strings.buffers()
    places = np.frombuffer(places, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return places - places[0], np.frombuffer(data, np.uint8)[places[0] : places[-1]]


def _strings(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(np.concatenate(([0], np.cumsum(sizes)))), pa.py_buffer(data))


def _without_tails(words: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Words less ASCII punctuation after a last letter or digit, that punctuation, and of which words it was cut.

    Byte-level BPE opens a piece there. Only letters up to U+00FF count, and `_TAIL` bytes of punctuation at most.
    """
    places, data = _bytes_of(words)
    starts, ends = places[:-1], places[1:]
    first = ends.copy()
    rows = np.flatnonzero(_KINDS[data[ends - 1]] == _PUNCTUATION)
    at = ends[rows] - 1
    for _ in range(_TAIL):
        inside = at > starts[rows]
        rows, at = rows[inside], at[inside]
        before = _KINDS[data[at - 1]]
        found = (before == _ALNUM) | (before == _LATIN) & (data[at - 2] == 0xC3)
        first[rows[found]] = at[found]
        more = before == _PUNCTUATION
        rows, at = rows[more], at[more] - 1
    cut = first < ends
    turns = np.zeros(len(data) + 1, np.int8)
    turns[first[cut]] = 1
    turns[ends[cut]] -= 1
    tail = np.cumsum(turns[:-1], dtype=np.int8).view(bool)
    return _strings(first - starts, data[~tail]), _strings((ends - first)[cut], data[tail]), cut


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def release() -> None:
    """Let go of the encoders of this worker, in steps that encode no more."""
    _ENCODERS.clear()
