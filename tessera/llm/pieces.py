"""Operator 2: SentencePiece encoding and decoding by batched numpy Viterbi.

A text is cut into units, each a run of space marks with what follows up to
the next; no piece crosses from other characters into a space mark, so units
are encoded one by one and kept in a cache. Units of one length advance
together: at each place, hashes of the substrings that end there probe the
sorted keys of the pieces, hits are verified by their characters, and
vectorised maxima over the lengths store the back pointers. A unit of more than
``LONG`` characters (text without spaces) is first cut at all places that no
occurrence of a piece crosses, so its parts join the batches; lengths of fewer
than ``FEW`` units, which a batch would not speed up, take the same steps one
by one.

What a path may hold depends on the kind of model:

* unigram: the path of the largest sum of scores, as usual.
* BPE: scores are merge ranks, whose sum says nothing. Merging gives exactly
  the path in which every two neighbours are *compatible*, that is, merging
  their joint text alone gives these two pieces. So a piece may only follow
  the last piece of the best path before it if the two are compatible (worked
  out once a pair and kept); among those that may, the longest wins.

Characters without a piece become byte pieces where the model has them. The kind
of the model and how it normalises texts are read from its file; one that maps
characters, drops white space, puts no mark before a text or has user-defined
symbols is refused.

Defined cases: a null or empty text has no pieces and decodes to an empty one;
repeated rows are encoded each; an empty table gives an empty one; columns
that are not asked for are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from tessera.llm.common import ship, text_bytes, tokenizer_path
from tessera.llm.lexicon import Memo, slices

MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
BASE = 0x9E3779B97F4A7C15
#: Characters of a unit that is cut before it is encoded; units of one length that are encoded one by one.
LONG, FEW = 48, 24


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of an encoded protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


def checked_kind(data: bytes) -> str:
    """``bpe`` or ``unigram``, from a model file's content; other models are refused."""
    trainer, normaliser, user = {}, {}, False
    for field, value in fields(data):
        if field == 1:
            user |= dict(fields(value)).get(3) == 4
        elif field == 2:
            trainer = dict(fields(value))
        elif field == 3:
            normaliser = dict(fields(value))
    if user or normaliser.get(2) or not normaliser.get(3, 1) or normaliser.get(4, 1) or not normaliser.get(5, 1) or trainer.get(24) or trainer.get(3, 1) not in (1, 2):
        raise ValueError("a model with user-defined symbols, a normaliser of its own or of another kind is not supported")
    return {1: "unigram", 2: "bpe"}[trainer.get(3, 1)]


class Pieces:
    """Pieces of a model file, and the encoder and decoder on them."""

    def __init__(self, path: str, kind: str | None = None):
        import sentencepiece

        with open(path, "rb") as f:
            self.kind = kind or checked_kind(f.read())
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.size = n
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i) or self.library.is_byte(i) for i in range(n)]
        self.text = [self.library.id_to_piece(i) for i in range(n)]
        self.score = np.array([self.library.get_score(i) for i in range(n)])
        self.id = {self.text[i]: i for i in range(n) if not special[i]}
        self.ranks = {t: float(self.score[i]) for t, i in self.id.items()}
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if self.library.is_byte(i)}
        self.unknown = self.library.unk_id()
        self.longest = max(map(len, self.id))
        names = list(self.id)
        keys = np.array([self._key(s) for s in names], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array([self.id[s] for s in names])[order]
        if (np.diff(self.keys) == 0).any():
            raise ValueError("two pieces have one hash")
        self.first_bits = np.zeros(1 << 20, bool)
        self.first_bits[self.keys >> np.uint64(44)] = True
        self.chars = np.zeros((n, self.longest), np.uint32)
        for s, i in self.id.items():
            self.chars[i, : len(s)] = list(map(ord, s))
        self.memo, self.pairs = Memo(400_000), {}
        bytes_of = {v: bytes([k]) for k, v in self.byte.items()}
        self.raw = [bytes_of.get(i, b"" if self.library.is_control(i) else self.text[i].encode()) for i in range(n)]

    @staticmethod
    def _key(s: str) -> int:
        h = 0
        for c in s:
            h = (h * BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def merged(self, s: str) -> list[str]:
        """Pieces by merging neighbours, the best score first, from the left on ties."""
        parts, ranks = list(s), self.ranks
        while len(parts) > 1:
            best, at = -np.inf, -1
            for k in range(len(parts) - 1):
                rank = ranks.get(parts[k] + parts[k + 1])
                if rank is not None and rank > best:
                    best, at = rank, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: int, right: int) -> bool:
        """Whether two ids stand side by side after merging their joint text; ids of ``size`` (no piece) go with all."""
        pair = left * (self.size + 1) + right
        if (ok := self.pairs.get(pair)) is None:
            ok = left == self.size or right == self.size or self.merged(self.text[left] + self.text[right]) == [self.text[left], self.text[right]]
            if len(self.pairs) < 1_000_000:
                self.pairs[pair] = ok
        return ok

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        kinds, back = np.unique(left * (self.size + 1) + right, return_inverse=True)
        known = list(map(self.pairs.get, kinds.tolist()))
        return np.array([self._fits(*divmod(int(pair), self.size + 1)) if ok is None else ok for pair, ok in zip(kinds, known, strict=True)], bool)[back]

    def _found(self, key: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether the substrings with these hashes and characters are pieces, their ids or ``size``)."""
        ids = np.full(len(key), self.size)
        some = np.flatnonzero(self.first_bits[key >> np.uint64(44)])  # rules most out before the search
        at = np.minimum(np.searchsorted(self.keys, key[some]), len(self.keys) - 1)
        same = self.keys[at] == key[some]
        rows, who = some[same], self.key_ids[at[same]]
        good = (self.chars[who, : chars.shape[1]] == chars[rows]).all(1)
        ids[rows[good]] = who[good]
        return ids < self.size, ids

    def parts(self, unit: str) -> list[str]:
        """A long unit, cut wherever no occurrence of a piece crosses."""
        chars = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32)
        step = np.zeros(len(chars) + 1, np.int64)
        key = chars.astype(np.uint64) + np.uint64(1)
        for size in range(2, min(self.longest, len(chars)) + 1):
            key = key[:-1] * np.uint64(BASE) + chars[size - 1 :] + np.uint64(1)
            found, _ = self._found(key, np.lib.stride_tricks.sliding_window_view(chars, size))
            begin = np.flatnonzero(found)
            step[begin + 1] += 1  # each begins at a place of its own for a given size
            step[begin + size] -= 1
        cuts = [0, *(np.flatnonzero(np.cumsum(step)[1:-1] == 0) + 1).tolist(), len(unit)]
        return [unit[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _single(self, unit: str) -> list[int]:
        """The path of :meth:`_viterbi` for one unit, one place at a time."""
        worst, bpe = float(self.score.min()) - 10, self.kind == "bpe"
        best, last, step = [0.0], [-1], [0]
        for j in range(1, len(unit) + 1):
            top, who, size = -np.inf, -1, 0
            for k in range(1, min(j, self.longest) + 1):
                i = self.id.get(unit[j - k : j])
                if i is None:
                    if k > 1:
                        continue
                    i = self.size
                if best[j - k] == -np.inf or bpe and j > k and not self._fits(last[j - k], i):
                    continue
                value = float(k) if bpe else best[j - k] + (worst if i == self.size else self.score[i])
                if value > top:
                    top, who, size = value, i, k
            best.append(top)
            last.append(who)
            step.append(size)
        out, at = [], len(unit)
        while at > 0:
            out.append(last[at])
            at -= step[at]
        return out[::-1]

    def _viterbi(self, chars: np.ndarray) -> np.ndarray:
        """Ids of units of one length, given as rows of code points: a row each, back to front, then -1; ``size`` stands for a character without a piece."""
        n, length = chars.shape
        prefix = np.zeros((n, length + 1), np.uint64)
        power = np.cumprod(np.array([1, *[BASE] * length], np.uint64))
        for j in range(length):
            prefix[:, j + 1] = prefix[:, j] * np.uint64(BASE) + chars[:, j] + np.uint64(1)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        last = np.full((n, length + 1), -1)
        step = np.zeros((n, length + 1), np.int64)
        unknown = self.score.min() - 10
        for j in range(1, length + 1):
            for size in range(1, min(j, self.longest) + 1):
                found, ids = self._found(prefix[:, j] - prefix[:, j - size] * power[size], chars[:, j - size : j])
                if size == 1:
                    found = np.ones(n, bool)
                rows = np.flatnonzero(found & (best[:, j - size] > -np.inf))
                if not len(rows):
                    continue
                ids = ids[rows]
                if self.kind == "bpe":
                    if j > size:
                        ok = self._compatible(last[rows, j - size], ids)
                        rows, ids = rows[ok], ids[ok]
                    value = np.full(len(rows), float(size))
                else:
                    value = best[rows, j - size] + np.where(ids == self.size, unknown, self.score[np.minimum(ids, self.size - 1)])
                better = value > best[rows, j]
                rows, ids, value = rows[better], ids[better], value[better]
                best[rows, j], last[rows, j], step[rows, j] = value, ids, size
        at, rows = np.full(n, length), np.arange(n)
        path = np.full((n, length), -1)
        for k in range(length):
            go = at > 0
            if not go.any():
                break
            path[go, k] = last[rows[go], at[go]]
            at[go] -= step[rows[go], at[go]]
        return path

    def units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit as little-endian int32."""
        cut = {u: self.parts(u) for u in units if len(u) > LONG}
        kinds = [u for u in units if len(u) <= LONG]
        if cut:
            kinds = list(dict.fromkeys([*kinds, *(p for parts in cut.values() for p in parts)]))
        by_length: dict[int, list[str]] = {}
        for p in kinds:
            by_length.setdefault(len(p), []).append(p)
        done: dict[str, bytes] = {}
        for length, same in by_length.items():
            if len(same) < FEW:
                for p in same:
                    done[p] = np.array(self._with_bytes(p, self._single(p)), "<i4").tobytes()
                continue
            chars = np.frombuffer("".join(same).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length)
            path = self._viterbi(chars)[:, ::-1]
            blob, ends = path[path >= 0].astype("<i4").tobytes(), np.cumsum((path >= 0).sum(1) * 4).tolist()
            for p, begin, end, odd in zip(same, [0, *ends[:-1]], ends, (path == self.size).any(1).tolist(), strict=True):
                done[p] = np.array(self._with_bytes(p, np.frombuffer(blob[begin:end], "<i4").tolist()), "<i4").tobytes() if odd else blob[begin:end]
        return [done[u] if u in done else b"".join([done[p] for p in cut[u]]) for u in units]

    def _with_bytes(self, unit: str, ids: list[int]) -> list[int]:
        out, at = [], 0
        for i in ids:
            if i == self.size:
                out += [self.byte.get(b, self.unknown) for b in unit[at].encode()] if self.byte else [self.unknown]
                at += 1
            else:
                out.append(i)
                at += len(self.text[i])
        return out

    @staticmethod
    def _units(t: str) -> list[str]:
        if not t:
            return []
        if t[0] == " " or "  " in t or MARK in t:
            return UNIT.findall(MARK + t.replace(" ", MARK))
        return [MARK + w for w in t.split(" ")]  # the same, where single blanks part the words

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, as little-endian int32."""
        units = [self._units(t) for t in texts]
        kinds = list({u for x in units for u in x})
        known = dict(zip(kinds, self.memo.look_up(kinds, self.units), strict=True))
        return [b"".join(map(known.__getitem__, x)) for x in units]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text.removeprefix(" ")


_made: dict[tuple[str, str | None], Pieces] = {}


def model(path: str, kind: str | None = None) -> Pieces:
    """The model of a file, made once in a process."""
    if (path, kind) not in _made:
        _made[path, kind] = Pieces(path, kind)
    return _made[path, kind]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "piece_bpe_32k.model", keep_text: bool = False) -> DataFrame:
    """(id, ids) for each row, with the text if asked for; one pass, no shuffle."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, *[text_col] * keep_text, "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(tokenizer_path(tokenizer))
        for b in batches:
            texts = text_bytes(b.column(1))
            for start, part in slices(texts):
                ids = m.encode(part.to_pylist())
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(part)), *[part] * keep_text, lists], names=names)

    schema = f"`{id_col}` {kind}, " + f"`{text_col}` string, " * keep_text + "ids array<int>"
    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "ids", out: str = "decoded", tokenizer: str = "piece_bpe_32k.model") -> DataFrame:
    """``df`` with the text of its ids as one more column; one pass, no shuffle.

    A null list is decoded as an empty text; a column of the name ``out`` is replaced.
    """
    ship(df.sparkSession)
    df = df.drop(out)
    schema = StructType([*df.schema.fields, StructField(out, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(tokenizer_path(tokenizer))
        for b in batches:
            ids = b.column(b.schema.get_field_index(ids_col))
            texts = [m.decode(x.values.to_numpy()) if x.is_valid else "" for x in ids]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)
