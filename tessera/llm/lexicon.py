"""Column-at-a-time splitting of texts into words, shared by the operators on words.

A batch of texts becomes the distinct words of the batch, one code per word
occurrence and one offset per text. What an operator needs of a word is worked
out once per distinct word and kept in a bounded cache; occurrences are then
served by numpy gathers, with no Python object for each of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts of at most so many bytes are taken at once; a longer text goes alone.
SLICE_BYTES = 4_000_000
#: Length of a word that a memo keeps.
KEPT = 160


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows holding at most ``most`` bytes of text (one row at least), each with the index of its first row."""
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield start, texts.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()  # workers are kept, and other stages need the memory


def split_words(texts: pa.Array, lower: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, codes, offsets): text ``i`` has the words ``codes[offsets[i]:offsets[i + 1]]``.

    Words are the runs of bytes other than space, tab, newline, vertical tab,
    form feed and carriage return. ``lower`` turns A-Z into a-z and leaves all
    else. A null text has no words.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    coded = flat.dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    if b"" in words:  # what stands before leading and after trailing white space
        keep = codes != words.index(b"")
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return words, codes, offsets


def _bytes(x: Any) -> int:
    """About how many bytes a key or value of a memo takes."""
    return 56 + (x.nbytes if isinstance(x, np.ndarray) else len(x) if isinstance(x, (bytes, str)) else 8 * len(x) if isinstance(x, (tuple, list)) else 0)


class Memo:
    """A bounded map from words to values in two generations: when the young one is full, it becomes the old one.

    It is full at ``most`` words or ``size`` bytes of keys and values. Words longer than
    ``KEPT`` are worked out anew each time, so that memory is bounded by words of usual length.
    """

    def __init__(self, most: int = 250_000, size: int = 48_000_000):
        self.most, self.size, self.young, self.old, self.held = most, size, {}, {}, 0

    def look_up(self, keys: list, make: Callable[[list], list]) -> list[Any]:
        """The keys' values; ``make`` gets those not known, once each."""
        young, old = self.young, self.old
        out = list(map(young.get, keys))
        unknown = []
        for i, v in enumerate(out):
            if v is None:
                if (w := old.get(keys[i])) is None:
                    unknown.append(i)
                else:
                    out[i] = young[keys[i]] = w
                    self.held += _bytes(keys[i]) + _bytes(w)
        if unknown:
            names = list(dict.fromkeys(keys[i] for i in unknown))
            found = dict(zip(names, make(names), strict=True))
            for i in unknown:
                out[i] = found[keys[i]]
            kept = found if max(map(len, names)) <= KEPT else {k: v for k, v in found.items() if len(k) <= KEPT}
            young.update(kept)
            self.held += sum(map(_bytes, kept)) + sum(map(_bytes, kept.values()))
        if len(young) > self.most or self.held > self.size:
            self.old, self.young, self.held = young, {}, 0
        return out


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each run of ``values``, 0 for empty runs; one row per run."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]


def ragged_take(blocks: list[bytes], codes: np.ndarray, offsets: np.ndarray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Join ``blocks[code]`` for each code: (all values, offsets of the runs in them)."""
    sizes = np.fromiter(map(len, blocks), np.int64, len(blocks)) // np.dtype(dtype).itemsize
    starts = np.cumsum(sizes) - sizes
    pool = np.frombuffer(b"".join(blocks), dtype)
    lengths = sizes[codes]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total) + np.repeat(starts[codes] - (ends - lengths), lengths)
    return pool[index], np.concatenate([[0], ends])[offsets]


#: Byte classes for :func:`runs`.
ASCII_LETTERS = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))
LETTERS_DIGITS_OTHERS = ASCII_LETTERS | np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8)) | (np.arange(256) >= 128)
_LOWER = np.arange(256, dtype=np.uint8) + np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), 32, 0).astype(np.uint8)


def runs(texts: pa.Array, inside: np.ndarray, latin: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, codes, offsets) as :func:`split_words`: maximal runs of bytes that ``inside`` marks, A-Z lower-cased.

    ``latin`` adds the code points U+00C0 to U+00FF, which are the byte 0xC3 and one more.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds -= bounds[0]
    mask = inside[data]
    if latin:
        lead = data == 0xC3
        mask |= lead
        mask[1:] |= lead[:-1]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    at = bounds[:-1][bounds[:-1] < len(data)]
    first[at] = mask[at]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    at = bounds[1:][bounds[1:] > 0] - 1
    last[at] = mask[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    cuts = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(_LOWER[data[mask]])).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False), np.searchsorted(starts, bounds)
