"""The ids that a white-space dropping BPE of the ``tokenizers`` library gives, from a cache of words.

White space is dropped by the tokenizer and no rule of it looks across white
space, so a text's ids are the ids of its white-space separated chunks one
after another. Chunks made of common Latin characters are merged in numpy,
equal-length words in step; all others are given to the library.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

from tessera.llm.lexicon import Memo, ragged_take, split_words

#: Characters whose class, lower case and normal form are plain: ASCII and precomposed Latin letters.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The word pattern of the tokenizer, for plain characters.
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")
#: Single bytes that stand alone after letters.
MARKS = frozenset(b".,;:!?")
SPECIAL = re.compile(r"<\|.*\|>")
#: Keys and values that a generation of a cache of words holds, in bytes: workers are kept, and several share an executor.
MEMO_BYTES = 16_000_000


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordBPE:
    """Encoder of a tokenizers file; one for each process and path, see :func:`encoder`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.forget()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.numpy = self._is_known_kind(spec)
        if self.numpy:
            vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
            letters = byte_letters()
            self.first = np.array([vocab[letters[b]] for b in range(256)], np.int64)
            self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int64)
            merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
            left = np.array([vocab[a] for a, _ in merges], np.int64)
            right = np.array([vocab[b] for _, b in merges], np.int64)
            made = np.array([vocab[a + b] for a, b in merges], np.int64)
            self._index(left << 17 | right, made)
        if self.library.encode("a b", add_special_tokens=False).offsets != [(0, 1), (2, 3)]:
            raise ValueError(f"{path}: this tokenizer keeps white space; words can't be encoded one by one")

    def forget(self) -> None:
        """Empty the caches. Tasks do so at their end: workers are kept for other stages, which need the memory."""
        self.memo, self.words = Memo(size=MEMO_BYTES), Memo(size=MEMO_BYTES)

    @staticmethod
    def _is_known_kind(spec: dict) -> bool:
        """Whether normaliser, splitter and model are those that :data:`PLAIN` and :data:`WORD` were written for."""
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        pattern = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
        model = spec["model"]
        return kinds == ["NFC", "Replace", "Lowercase"] and len(splits) == 2 and splits[0].get("pattern") == {"Regex": pattern} and model["type"] == "BPE" and bool(model["end_of_word_suffix"]) and not model["ignore_merges"] and model["dropout"] is None

    def _index(self, keys: np.ndarray, made: np.ndarray) -> None:
        """An open table from pairs to (rank, id): by the key's hash, with few steps on collision."""
        self.bits = 20
        size = 1 << self.bits
        self.key, self.rank, self.made = np.full(size, -1, np.int64), np.full(size, 1 << 30, np.int64), np.zeros(size, np.int64)
        self.steps = 1
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        step = 0
        while len(todo):
            at = (slot[todo] + step) & (size - 1)
            free = self.key[at] < 0
            _, first = np.unique(at, return_index=True)
            placed = np.zeros(len(todo), bool)
            placed[first] = True
            placed &= free
            self.key[at[placed]], self.rank[at[placed]], self.made[at[placed]] = keys[todo[placed]], todo[placed], made[todo[placed]]
            todo, step = todo[~placed], step + 1
            self.steps = step

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot, mask = self._slot(keys), (1 << self.bits) - 1
        hit = self.key[slot] == keys
        rank = np.where(hit, self.rank[slot], 1 << 30)
        made = self.made[slot]
        for step in range(1, self.steps):
            miss = np.flatnonzero(~hit)
            if not len(miss):
                break
            at = (slot[miss] + step) & mask
            good = self.key[at] == keys[miss]
            rank[miss[good]], made[miss[good]], hit[miss[good]] = self.rank[at[good]], self.made[at[good]], True
        return rank, made

    def _merge(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian uint32) of words as byte strings: words of one length take their merges in step."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, rows in by_length.items():
            raw = np.frombuffer(b"".join(words[i] for i in rows), np.uint8).reshape(-1, length)
            ids = self.first[raw]
            ids[:, -1] = self.last[raw[:, -1]]
            self._merge_equal(ids, np.array(rows), out)
        return out

    def _merge_equal(self, ids: np.ndarray, rows: np.ndarray, out: list[bytes]) -> None:
        """Apply to every row its lowest-ranked pair, at all its places from the left, until none is left.

        Each pass makes one merge a row, the leftmost of its lowest rank, so a
        rank with several places takes several passes, as in the library.
        """
        groups = [(ids, rows)]
        while groups:
            nxt: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for a, r in groups:
                if a.shape[1] == 1:
                    done = np.ones(len(a), bool)
                else:
                    rank, made = self._find((a[:, :-1] << 17 | a[:, 1:]).ravel())
                    rank, made = rank.reshape(len(a), -1), made.reshape(len(a), -1)
                    best = rank.argmin(1)
                    every = np.arange(len(a))
                    done = rank[every, best] >= 1 << 30
                for i in np.flatnonzero(done):
                    out[r[i]] = a[i].astype("<u4").tobytes()
                go = np.flatnonzero(~done)
                if len(go):
                    at = best[go]
                    b = a[go]
                    b[np.arange(len(go)), at] = made[go, at]
                    column = np.arange(a.shape[1] - 1)
                    b = np.take_along_axis(b, column + (column > at[:, None]), 1)
                    nxt.setdefault(b.shape[1], []).append((b, r[go]))
            groups = [(np.concatenate([x for x, _ in g]), np.concatenate([y for _, y in g])) for g in nxt.values()]

    def chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Ids (little-endian uint32) of chunks without white space."""
        out: list[bytes | None] = [None] * len(chunks)
        parts: list[list[bytes]] = []
        at: list[int] = []
        other: list[int] = []
        for i, c in enumerate(chunks):
            if self.numpy and len(c) <= 64:  # most are letters, maybe with a mark after them: no pattern needs to be tried
                if c.isalpha():
                    parts.append([c.lower()])
                    at.append(i)
                    continue
                if c[:-1].isalpha() and c[-1] in MARKS:
                    parts.append([c[:-1].lower(), c[-1:]])
                    at.append(i)
                    continue
            s = c.decode("utf-8", "replace")
            if self.numpy and len(s) <= 64 and PLAIN.fullmatch(s) and not ("<|" in s and SPECIAL.search(s)):
                parts.append([w.encode() for w in WORD.findall(s.lower())])
                at.append(i)
            else:
                other.append(i)
        if at:
            words = list({w for p in parts for w in p})
            ids = dict(zip(words, self.words.look_up(words, self._merge), strict=True))
            for i, p in zip(at, parts, strict=True):
                out[i] = ids[p[0]] if len(p) == 1 else b"".join([ids[w] for w in p])
        if other:
            said = self.library.encode_batch([chunks[i].decode("utf-8", "replace") for i in other], add_special_tokens=False)
            for i, e in zip(other, said, strict=True):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, offsets): as ``encode_batch(texts, add_special_tokens=False)``; null as empty."""
        words, codes, offsets = split_words(texts)
        return ragged_take(self.memo.look_up(words, self.chunks), codes, offsets, "<u4")

    def count(self, texts: pa.Array) -> np.ndarray:
        words, codes, offsets = split_words(texts)
        sizes = np.fromiter(map(len, self.memo.look_up(words, self.chunks)), np.int64, len(words)) // 4
        return np.diff(np.concatenate([[0], np.cumsum(sizes[codes])])[offsets])


_made: dict[str, WordBPE] = {}


def encoder(path: str) -> WordBPE:
    """The encoder of a file, made once in a process and kept for later tasks of a reused worker."""
    if path not in _made:
        _made[path] = WordBPE(path)
    return _made[path]
