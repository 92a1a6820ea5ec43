"""Whole-text tokenization with a byte-level BPE of the tokenizers library, with a cache of words.

A byte-level BPE never merges across a single space between two words, so a text without two
adjacent white-space characters is the sequence of its words, each with the space before it, and
each can be encoded once and kept.  Any other text is encoded in one piece.
"""

from __future__ import annotations

import ctypes
import functools
import itertools
import json
import operator
import os
import re

import numpy as np
import pyarrow as pa

_DOUBLE_SPACE = re.compile(r"\s\s")
#: A full stop or comma that other marks may stand together with; after a letter or digit it is by itself.
_JOINED_STOP = re.compile(r"(?:^|[^\w]|_)[.,] ")
_ENCODERS: dict[tuple[str, int], "WordEncoder"] = {}


class WordEncoder:
    """Encodes texts to little-endian ids of ``dtype``; ``keep`` bounds the words that are remembered."""

    def __init__(self, path: str, keep: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.lengths = np.zeros(size, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)  # a byte-level token has a character for each byte
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.keep, self.words = keep, {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, missing: list[str]) -> None:
        """Encode unseen words, those with a leading space many to a text, cut at the words' ends again."""
        spaced = [w for w in missing if w[:1] == " "]
        first = [w for w in missing if w[:1] != " "]  # of a text
        for w, x in zip(first, self.tokenizer.encode_batch_fast(first, add_special_tokens=False), strict=True):
            self.words[w] = np.array(x.ids, self.dtype).tobytes()
        parts = [spaced[at : at + 64] for at in range(0, len(spaced), 64)]
        encoded = [x.ids for x in self.tokenizer.encode_batch_fast(["".join(p) for p in parts], add_special_tokens=False)]
        ids = np.fromiter(itertools.chain.from_iterable(encoded), np.int64, sum(map(len, encoded)))
        ends, wanted = np.cumsum(self.lengths[ids]), np.cumsum([len(w.encode()) for w in spaced])
        cuts = np.minimum(np.searchsorted(ends, wanted) + 1, len(ids))
        if spaced and (cuts[-1] != len(ids) or not np.array_equal(ends[cuts - 1], wanted)):
            for w in spaced:  # some word isn't a run of tokens by itself
                self.words[w] = self._whole(w)
            return
        raw, width = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
        stops = (cuts * width).tolist()
        self.words.update(zip(spaced, map(raw.__getitem__, map(slice, [0, *stops[:-1]], stops)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for a, b in slices(texts, 1 << 18):  # what is in hand at once stays near the processor
            out += self._encode(texts[a:b])
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        open_: list[tuple[int, list[str], list[bytes | None], list[int]]] = []
        missing: set[str] = set()
        if len(self.words) > self.keep:
            self.words = {}
        get = self.words.get
        for i, text in enumerate(texts):
            if not text:
                out[i] = b""
            elif not self.by_word or "\0" in text or _DOUBLE_SPACE.search(text):
                out[i] = self._whole(text)
            else:
                marked = text.replace(" ", "\0 ")  # each word with the space before it
                if not _JOINED_STOP.search(text):
                    marked = marked.replace(".\0 ", "\0.\0 ").replace(",\0 ", "\0,\0 ")
                words = marked.split("\0")
                if not words[0]:
                    del words[0]
                found = list(map(get, words))
                if None in found:
                    gaps = list(itertools.compress(range(len(found)), map(operator.not_, found)))
                    missing.update([words[k] for k in gaps])
                    open_.append((i, words, found, gaps))
                else:
                    out[i] = b"".join(found)
        if missing:
            self._learn(list(missing))
        known = self.words
        for i, words, found, gaps in open_:
            for k in gaps:
                found[k] = known[words[k]]
            out[i] = b"".join(found)
        return out  # type: ignore[return-value]


def encoder(path: str) -> WordEncoder:
    """One encoder for each file and process."""
    key = (path, os.getpid())
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path)
    return _ENCODERS[key]


def release() -> None:
    """Forget the encoders of this process: other operators' tasks call it, so that a worker holds one kind of cache."""
    _ENCODERS.clear()
    give_back()


@functools.cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)  # glibc has it


def give_back() -> None:
    """Return memory that is free to the system: workers outlive their tasks, and what they keep is lost to the next stage."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(texts: list[str], characters: int = 1 << 22):
    """Ranges of texts of bounded total length, so that the ids of a batch stay small in memory."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= characters:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
