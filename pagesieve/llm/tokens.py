"""Token ids of whole texts by a public tokenizer, at the speed of its distinct words.

Both supported vocabularies cut a text into words before they merge pairs, and the
merges of a word do not depend on its neighbours. So each distinct word of a batch is
merged once by the tokenizer's model (and kept for the next batches of the worker) and the
ids of a text are gathered with numpy. The cut is done here, with numpy on one byte a character, for plain
texts, on which all libraries agree; other texts, those that spell out an added token, and all texts of other vocabularies, are given to the tokenizer whole.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# How the two kinds of vocabulary cut a plain text into words.
_SPACE, _NEWLINE, _OTHER, _DIGIT, _LETTER, _QUOTE = 1, 2, 3, 4, 5, ord("'")
_LETTERS = [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]
_CLASS = bytes(
    _SPACE if c == 32 else _NEWLINE if c == 10 else _DIGIT if 48 <= c < 58 else _LETTER if c in _LETTERS else _OTHER for c in range(256)
)
# Letters that make a word of their own with the quote before them.
_SHORT, _LONG = b"stmd", (b"re", b"ve", b"ll")
# Plain: only characters on whose classes, case and composition all libraries agree, and for
# the byte-level cut no run of white space that it would keep together.
_NOT_PLAIN = {"byte": r"[^ -~\nÀ-ÖØ-öø-ÿ]|\s\s\s|\s\s$", "word": r"[^ -~\nÀ-ÖØ-öø-ÿ]"}
#: A worker forgets its words when they are so many or have so many ids.
KEPT_WORDS = 400_000
KEPT_IDS = 4_000_000
#: Characters that are worked on at once.
AT_ONCE = 1 << 20


def public_path(name: str) -> str:
    """The file of a public tokenizer that is installed on the machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _shown() -> dict[int, int]:
    """The letter by which byte-level vocabularies show each byte: itself, or one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


_SHOWN = _shown()


def word_starts(data: bytes, kind: str) -> np.ndarray:
    """Where the words of plain Latin-1 texts begin; each goes to the next one's begin, and white space makes words too.

    ``byte``: one space belongs to the word behind it; ``word``: each digit is a word.
    """
    raw, kinds = np.frombuffer(data, np.uint8), np.frombuffer(data.translate(_CLASS), np.uint8)
    starts = np.ones(len(raw), bool)
    here, before = kinds[1:], kinds[:-1]
    starts[1:] = here != before
    if kind == "byte":
        starts[1:] &= before != _SPACE
        starts |= kinds <= _NEWLINE
    else:
        starts |= (kinds <= _NEWLINE) | (kinds == _DIGIT)
    quotes = np.flatnonzero((raw == _QUOTE) & starts)
    end = len(raw) - 1  # texts end in a line break, so nothing follows it
    one, two = raw[np.minimum(quotes + 1, end)], raw[np.minimum(quotes + 2, end)]
    size = np.where(np.isin(one, np.frombuffer(_SHORT, np.uint8)), 1, 0)
    for a, b in _LONG:
        size[(one == a) & (two == b)] = 2
    starts[quotes[size > 0] + 1] = False
    starts[quotes[size > 0] + size[size > 0] + 1] = True
    return np.flatnonzero(starts)


class _Words(dict):
    """Words by number, and their ids."""

    def __init__(self, merge):
        self._merge, self._ids, self._ends = merge, array("I"), array("q", [0])

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each of some distinct words; those that are asked for the first time are merged."""
        new = [w for w in words if w not in self]
        for word, ids in zip(new, self._merge(new)):
            self._ids.extend(ids)
            self._ends.append(len(self._ids))
            self[word] = len(self)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    @property
    def n_ids(self) -> int:
        return len(self._ids)

    def store(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and where those of each begin and end."""
        return np.array(self._ids, np.uint32), np.array(self._ends, np.int64)


class Encoder:
    """Ids of texts; equal to ``Tokenizer.encode(text, add_special_tokens=False)`` of the file as it is.

    So a special token that is spelled out in a text is that token, as the tokenizer has it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self._kind = _kind(json.load(f))
        self.size = self._tokenizer.get_vocab_size()
        self._words = _Words(self._merge)

    def _merge(self, words: list[bytes]) -> Iterator[list[int]]:
        """Ids of words in Latin-1; white space is no word where the vocabulary drops it."""
        tokenize, dropped = self._tokenizer.model.tokenize, (b" ", b"\n") if self._kind == "word" else ()
        shown = b"\0".join(words).decode("latin-1").encode().decode("latin-1").translate(_SHOWN | {0: 0}).split("\0")
        return ([] if word in dropped else [t.id for t in tokenize(text)] for word, text in zip(words, shown))

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self._words) > KEPT_WORDS or self._words.n_ids > KEPT_IDS:
            self._words = _Words(self._merge)
        parts = texts.to_pylist()
        joined = "\n".join([*parts, ""])
        data = (joined if self._kind == "byte" else joined.lower()).encode("latin-1")
        starts = word_starts(data, self._kind)
        buffers = [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)]
        words = pa.Array.from_buffers(pa.binary(), len(starts), buffers).dictionary_encode()
        place = self._words.numbers(words.dictionary.to_numpy(zero_copy_only=False).tolist())[np.asarray(words.indices)]
        store, start = self._words.store()
        length = np.diff(start)[place]
        # The line break behind each text is none of its words.
        behind = np.searchsorted(starts, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1)
        length[behind] = 0
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = store[np.repeat(start[place] - ends[:-1], length) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends[behind]])

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = np.ones(len(texts), bool)
        if self._kind != "whole":
            odd = np.array(pc.match_substring_regex(texts, _NOT_PLAIN[self._kind]))
            for content in self._added:
                odd |= np.asarray(pc.match_substring(texts, content))
        if not odd.any():
            return self._by_words(texts)
        some, bounds = self._by_words(texts.filter(pa.array(~odd))) if not odd.all() else (np.zeros(0, np.uint32), np.zeros(1, int))
        plain = iter(range(len(bounds) - 1))
        whole = iter(self._whole(texts.filter(pa.array(odd)).to_pylist()))
        each = []
        for is_odd in odd:
            if is_odd:
                each.append(np.asarray(next(whole), np.uint32))
            else:
                i = next(plain)
                each.append(some[bounds[i] : bounds[i + 1]])
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])

    def parts(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For some texts at a time, from and to which: all ids, and where each text begins and ends.

        Ids are unsigned 32-bit; null is an empty text.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.string())
        size = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
        first = 0
        while first < len(texts):
            done = size[first - 1] if first else 0
            end = max(first + 1, int(np.searchsorted(size, done + AT_ONCE)))
            yield first, end, *self._some(texts[first:end])
            first = end

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and where each text begins and ends."""
        ids, bounds = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for _, _, some, ends in self.parts(texts):
            bounds.append(ends[1:] + bounds[-1][-1])
            ids.append(some)
        return np.concatenate(ids), np.concatenate(bounds)


def _kind(spec: dict) -> str:
    """``byte``: byte-level words with their space; ``word``: words without white space."""
    cut, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if cut.get("type") == "ByteLevel" and norm is None and cut.get("use_regex") and not cut.get("add_prefix_space"):
        return "byte"
    steps = cut.get("pretokenizers", [])
    if steps and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert"):
        return "word"
    return "whole"


def portions(texts: pa.Array, size: int) -> Iterator[tuple[int, list[str]]]:
    """Some texts at a time, of about ``size`` characters, and the number of the first; null is empty."""
    some: list[str] = []
    first = held = 0
    for i, text in enumerate(texts):
        some.append(text.as_py() or "")
        held += len(some[-1])
        if held >= size or i == len(texts) - 1:
            yield first, some
            some, first, held = [], i + 1, 0


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    return Encoder(path)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with ``end_id`` behind each."""
    n = len(bounds) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    place = np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))
    out[place] = ids
    return out, bounds + np.arange(n + 1)


def binary_column(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices of ``ids`` as their bytes."""
    data, offsets = np.ascontiguousarray(ids), np.ascontiguousarray(bounds * ids.itemsize, np.int64)
    return pa.Array.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    ).cast(pa.binary())
