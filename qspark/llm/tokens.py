"""Whole texts to token ids with a byte-level tokenizer file, with a cache of what stands between single spaces and line ends.

The byte-level pattern never lets a token reach over a space that stands between two other characters, except as that token's
first character, nor over a line end between two other characters. Texts are therefore cut there, all of a step at once on their
bytes, and each piece (its space or line end in front) is encoded by the library once. A step's pieces are first made distinct by
Arrow, so that the cache is asked once for each. New pieces without white space go to the library many at a time, a line end after
each, whose id tells them apart again; letters and the punctuation after them are the letters' ids and the punctuation's, as the
pattern parts them, too. A text that has the string of a special token goes to the library as a whole.
"""

from __future__ import annotations

import os
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa

from .common import caches, new_task

#: Marks that the pattern parts from letters before them, whatever follows; the apostrophe may begin a contraction.
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_blank = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
#: First two bytes of white space outside ASCII, by the number of its bytes; others that begin so count as white space, too.
_wide = {2: [(0xC2, 0x85), (0xC2, 0xA0)], 3: [(0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80)]}


def _cuts(body: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin: at each text's start (`starts`, ascending, of texts that aren't empty), and at single spaces and line ends between two other characters."""
    blank = _blank[body]
    cut = (body == 32) | (body == 10)
    cut[1:] &= ~blank[:-1]
    cut[:-1] &= ~blank[1:]
    for size, pairs in _wide.items():
        for x, y in pairs:
            lead = np.flatnonzero(body[:-1] == x)
            lead = lead[body[lead + 1] == y]
            cut[lead[lead > 0] - 1] = False
            cut[np.minimum(lead + size, len(body) - 1)] = False
    cut[starts[1:] - 1] = cut[-1] = False  # a text's last character is not between two
    cut[starts] = True
    return np.flatnonzero(cut)


class _Numbers(dict):
    """Piece → number, in order of first sight; the new ones wait in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def of(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of distinct pieces."""
        out = np.fromiter(map(self.get, pieces, repeat(-1)), np.int64, len(pieces))
        at = np.flatnonzero(out < 0)
        new = [pieces[i] for i in at.tolist()]
        out[at] = np.arange(len(self), len(self) + len(new))
        self.update(zip(new, range(len(self), len(self) + len(new))))
        self.new += new
        return out


class _Store:
    """Id lists by number, in growing arrays."""

    def __init__(self):
        self.flat, self.starts, self.sizes = np.empty(1 << 16, np.uint32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.n_flat = self.n = 0

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.empty(max(n, 2 * len(x)) - len(x), x.dtype)])

    def put(self, numbers: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        if not len(numbers):
            return
        self.flat = self._room(self.flat, self.n_flat + len(flat))
        top = max(self.n, int(numbers.max()) + 1)
        self.starts, self.sizes = self._room(self.starts, top), self._room(self.sizes, top)
        self.flat[self.n_flat : self.n_flat + len(flat)] = flat
        self.starts[numbers] = self.n_flat + np.cumsum(sizes) - sizes
        self.sizes[numbers] = sizes
        self.n_flat += len(flat)
        self.n = top

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[numbers] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.flat[at], sizes


class Coder:
    #: Pieces kept before those of a single step are given up: the bound of a worker's memory (some 150 MB). A step's new ones come on top.
    MOST = 500_000
    #: Pieces in one text for the library.
    LINE = 200

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.library.get_added_tokens_decoder().values()]
        self.line_end = self._ids("\n")
        self.clear()

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        self.numbers, self.store = _Numbers(), _Store()
        self.uses = np.zeros(1 << 14, np.uint32)  # steps that had each piece
        self.marks: dict[str, list[int]] = {}

    def _shrink(self) -> None:
        """Keep the pieces that two steps had, or of too many those of the most steps."""
        own = self.uses[: len(self.numbers)]
        least = 2
        while (keep := np.flatnonzero(own >= least)).size > self.MOST // 2:
            least *= 2
        flat, sizes = self.store.get(keep)
        pieces = list(compress(self.numbers, (own >= least).tolist()))
        self.clear()
        self.numbers.update(zip(pieces, range(len(pieces))))
        self.store.put(np.arange(len(pieces)), flat, sizes)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(y) for y in ids], np.int64)
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def _learn(self) -> None:
        """Ids of the new pieces."""
        numbers, store, new = self.numbers, self.store, self.numbers.new
        known = len(new)
        base = len(numbers) - known
        solid, others, ended, cores, tails = [], [], [], [], []
        for i, x in enumerate(map(bytes.decode, new)):
            word = x[1:]
            if x[0] != " ":
                others.append(i)
            elif word.isalpha():
                solid.append(i)
            else:
                core = word.rstrip(_MARKS)
                if core.isalpha() and (core.isascii() or max(core) < "\u0530"):
                    ended.append(i)
                    cores.append(b" " + core.encode())
                    tails.append(word[len(core) :])
                else:
                    (solid if word.split() == [word] else others).append(i)
        numbers.of(list(dict.fromkeys(cores)))
        of_core = np.fromiter(map(numbers.__getitem__, cores), np.int64, len(cores))
        solid += range(known, len(new))
        if len(self.line_end) > 1:
            others += solid
        elif solid:
            lines = [b"\n".join([*(new[i] for i in solid[k : k + self.LINE]), b""]).decode() for k in range(0, len(solid), self.LINE)]
            flat, _ = self._each(lines)
            ends = np.flatnonzero(flat == self.line_end[0])
            if len(ends) != len(solid):
                raise ValueError("this tokenizer file joins words and line ends")
            store.put(base + np.array(solid), np.delete(flat, ends), np.diff(ends, prepend=-1) - 1)
        if others:
            store.put(base + np.array(others), *self._each([new[i].decode() for i in others]))
        if ended:
            for x in set(tails) - self.marks.keys():
                self.marks[x] = self._ids(x)
            flat, sizes = store.get(of_core)
            own = [self.marks[x] for x in tails]
            more = np.array([len(x) for x in own], np.int64)
            flat = np.insert(flat, np.repeat(np.cumsum(sizes), more), np.array([i for x in own for i in x], np.uint32))
            store.put(base + np.array(ended), flat, sizes + more)
        numbers.new = []

    def encode(self, texts: list[str] | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (uint32), and the number of ids of each text; bytes that aren't UTF-8 are replaced."""
        raw = [t.encode() if isinstance(t, str) else t for t in texts]
        body = b"".join(raw)
        try:  # checked without a copy
            pa.Array.from_buffers(pa.large_binary(), 1, [None, pa.py_buffer(np.array([0, len(body)])), pa.py_buffer(body)]).cast(pa.large_string())
        except pa.ArrowInvalid:
            raw = [t.decode("utf-8", "replace").encode() for t in raw]
            body = b"".join(raw)
        whole = [k for k, t in enumerate(raw) if any(x in t for x in self.special)] if any(x in body for x in self.special) else []
        if not whole:
            return self._encode(raw, body)
        direct = [self._ids(raw[k].decode()) for k in whole]
        for k in whole:
            raw[k] = b""
        flat, counts = self._encode(raw, b"".join(raw))
        at = np.repeat((np.cumsum(counts) - counts)[whole], [len(x) for x in direct])
        counts[whole] = [len(x) for x in direct]
        return np.insert(flat, at, np.array([i for x in direct for i in x], np.uint32)), counts

    def _encode(self, raw: list[bytes], body: bytes) -> tuple[np.ndarray, np.ndarray]:
        if len(self.numbers) > self.MOST:
            self._shrink()
        sizes = np.array([len(t) for t in raw], np.int64)
        if not sizes.any():
            return np.empty(0, np.uint32), np.zeros(len(raw), np.int64)
        ends = np.cumsum(sizes)
        at = _cuts(np.frombuffer(body, np.uint8), (ends - sizes)[sizes > 0])
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(body))), pa.py_buffer(body)]).dictionary_encode()
        numbers = self.numbers.of(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        if self.numbers.new:
            self._learn()
        if len(self.numbers) > len(self.uses):
            self.uses = np.concatenate([self.uses, np.zeros(len(self.numbers), np.uint32)])
        self.uses[numbers] += 1
        flat, sizes = self.store.get(numbers[pieces.indices.to_numpy()])
        total = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(at, np.concatenate([[0], ends]))]
        return flat, np.diff(total)


_coders: dict[str, Coder] = {}
caches["coder"] = _coders.clear


def coder(path: str) -> Coder:
    """One for each tokenizer file and Python worker, kept while its stages use it."""
    new_task("coder")
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def with_end(flat: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each text."""
    upto = np.cumsum(counts)
    return np.insert(flat, upto, end) if len(counts) else flat, counts + 1
