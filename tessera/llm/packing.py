"""Operator 9: harmonic packing of tokenised documents into training sequences.

Each worker packs the documents of its partition alone, in one pass:

* A document longer than a sequence gives full sequences and a rest.
* A document (or rest) of ``n`` tokens is of class ``k = capacity // n``, that
  is, its length lies between ``capacity / (k + 1)`` and ``capacity / k``. The
  bins of class ``k`` take ``k`` documents each, so any ``k`` of the class fit.
* What a closed bin has left over is a gap. A document goes whole into the
  smallest open gap that holds it; only where none does and the open gaps of
  ``useful`` tokens or more together hold two sequences (eight, if it would be
  cut often) is it cut over the largest of them, so harmonic classes keep most
  documents whole and gaps cost hardly any padding. Smaller gaps take whole
  documents till the end, and those under ``least`` tokens stay padding.
* At the end, documents of bins that are still open go whole into gaps that
  hold them, the longest first; the others give a piece to a smaller gap for
  each two times ``useful`` tokens they have, and are cut over the gaps of
  ``useful`` tokens or more and then over full sequences; the last, partial one
  is cut at powers of two, which need no padding. So what is placed at the end
  lies in no more pieces than two for each ``useful`` tokens and a dozen more.

A worker holds one open bin a class and the open gaps (of useful size: nine
sequences together at most; in all, 2048 gaps). Sequence numbers carry the partition's number in
their upper bits, so workers need not agree on anything; a task that is run
again for a lost executor packs the same rows in the same way.

Defined cases: a null text counts as empty; an empty text is the end token
alone; repeated rows are packed each; an empty table gives an empty one; other
columns of the input are left out, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.common import ship, text_bytes, tokenizer_path
from tessera.llm.lexicon import slices
from tessera.llm.word_bpe import encoder


class HarmonicPacker:
    """Pieces (doc, start, length, doc_tokens, sequence, offset) of documents given one by one; ``doc`` is any key."""

    def __init__(self, capacity: int = 4096, classes: int = 64, least: int = 16, useful: int = 64):
        self.capacity, self.classes, self.least, self.useful = capacity, classes, least, useful
        self.bins: dict[int, list] = {}  # class -> [(doc, start, length, doc_tokens)]
        self.gaps: list[tuple[int, int, int]] = []  # (free tokens, sequence, offset), ascending
        self.free = 0  # tokens of the gaps of useful size
        self.most = 2048  # gaps
        self.sequences = 0

    def _new(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    def add(self, doc, n: int) -> Iterator[tuple]:
        """The pieces that can be placed for good once this document has come."""
        start = 0
        while n - start >= self.capacity:
            yield doc, start, self.capacity, n, self._new(), 0
            start += self.capacity
        if start < n:
            yield from self._rest(doc, start, n)

    def _rest(self, doc, start: int, n: int) -> Iterator[tuple]:
        at = bisect_left(self.gaps, (n - start,))
        if at < len(self.gaps):
            left, sequence, offset = self._take(at)
            yield doc, start, n - start, n, sequence, offset
            self._gap(left - (n - start), sequence, offset + n - start)
            return
        few = self.gaps and n - start <= 4 * self.gaps[-1][0]
        if self.free >= max(n - start, (2 if few else 8) * self.capacity):
            yield from self._fill(doc, start, n)
            return
        k = min(self.capacity // (n - start), self.classes)
        held = self.bins.setdefault(k, [])
        held.append((doc, start, n - start, n))
        if len(held) == k:
            yield from self._close(self.bins.pop(k))

    def _close(self, held: list) -> Iterator[tuple]:
        sequence, offset = self._new(), 0
        for doc, start, length, n in held:
            yield doc, start, length, n, sequence, offset
            offset += length
        self._gap(self.capacity - offset, sequence, offset)

    def _gap(self, left: int, sequence: int, offset: int) -> None:
        if left >= self.least:
            insort(self.gaps, (left, sequence, offset))
            self.free += left * (left >= self.useful)
            if len(self.gaps) > self.most:
                self._take(0)  # the smallest one stays padding

    def _take(self, at: int) -> tuple[int, int, int]:
        gap = self.gaps.pop(at)
        self.free -= gap[0] * (gap[0] >= self.useful)
        return gap

    def _fill(self, doc, start: int, n: int) -> Iterator[tuple]:
        """Cut ``doc[start:n]`` over the gaps."""
        while start < n:
            left, sequence, offset = self._take(-1)
            take = min(left, n - start)
            yield doc, start, take, n, sequence, offset
            start += take
            self._gap(left - take, sequence, offset + take)

    def finish(self) -> Iterator[tuple]:
        """Place what the open bins hold: whole into gaps, then over gaps, then over full sequences, then over powers of two."""
        rest = deque()
        for _, held in sorted(self.bins.items()):
            for doc, start, length, n in sorted(held, key=lambda x: -x[2]):
                at = bisect_left(self.gaps, (length,))
                if at == len(self.gaps):
                    rest.append((doc, start, start + length, n))
                    continue
                left, sequence, offset = self._take(at)
                yield doc, start, length, n, sequence, offset
                self._gap(left - length, sequence, offset + length)
        self.bins = {}
        # long documents give a piece to a small gap for each two times ``useful`` tokens they have
        for _ in range(len(rest)):
            doc, start, stop, n = rest.popleft()
            for _ in range((stop - start) // (2 * self.useful)):
                at = bisect_left(self.gaps, (self.useful,)) - 1
                if at < 0:
                    break
                left, sequence, offset = self._take(at)
                yield doc, start, left, n, sequence, offset
                start += left
            rest.append((doc, start, stop, n))
        total = sum(stop - start for _, start, stop, _ in rest)
        places = [(s, o, left) for left, s, o in reversed(self.gaps) if left >= self.useful]
        total -= sum(left for _, _, left in places)
        while total >= self.capacity:
            places.append((self._new(), 0, self.capacity))
            total -= self.capacity
        bit = 1 << max(0, self.capacity.bit_length() - 1)
        while total > 0:
            if total >= bit:
                places.append((self._new(), 0, bit))
                total -= bit
            bit >>= 1
        for sequence, offset, left in places:
            while left and rest:
                doc, start, stop, n = rest.popleft()
                take = min(left, stop - start)
                yield doc, start, take, n, sequence, offset
                left, offset = left - take, offset + take
                if start + take < stop:
                    rest.appendleft((doc, start + take, stop, n))
        self.gaps, self.free = [], 0


SCHEMA = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 2, capacity: int = 4096, classes: int = 64, least: int = 16) -> DataFrame:
    """One row per piece: (id, start, length, doc_tokens, sequence_id, offset, ids), ids as little-endian uint32; no shuffle."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, *(x.split()[0] for x in SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path(tokenizer))
        packer, first = HarmonicPacker(capacity, classes, least), TaskContext.get().partitionId() << 40
        kept: dict[int, tuple] = {}  # row number -> (id, ids) of documents with pieces still to place
        end = np.uint32(end_id).tobytes()
        id_type = None

        def batch(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*[(kept[d][0], s, n, t, first + q, o, kept[d][1][4 * s : 4 * (s + n)]) for d, s, n, t, q, o in pieces], strict=True))
            types = [id_type, *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        row = 0
        for b in batches:
            id_type, keys = b.column(0).type, b.column(0).to_pylist()
            texts = text_bytes(b.column(1))
            for begin, part in slices(texts):
                ids, offsets = enc.encode(part)
                raw, pieces = memoryview(ids.astype("<u4").tobytes()), []
                for i in range(len(part)):
                    kept[row] = keys[begin + i], bytes(raw[4 * offsets[i] : 4 * offsets[i + 1]]) + end
                    pieces += packer.add(row, len(kept[row][1]) // 4)
                    row += 1
                if pieces:
                    yield batch(pieces)
                waiting = {held[0] for group in packer.bins.values() for held in group}
                kept = {d: x for d, x in kept.items() if d in waiting}
        enc.forget()
        if pieces := list(packer.finish()):
            yield batch(pieces)

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
