"""Operator 5: token counts of whole texts.

Texts of more than ``huge`` bytes, four chunks by default, are encoded by the
library in overlapping chunks with offsets, and neighbouring chunks are spliced
by *overlap resynchronisation*; shorter ones, which no chunk would cut, are
counted word by word (:mod:`tessera.llm.word_bpe`). Both give the library's
counts, so ``huge`` changes memory and time, not results.

* A place is a proven stable boundary if the character before it is white
  space of a kind that the tokenizer drops, and both chunks have a token that
  starts there. No rule of such a tokenizer looks across that white space, so
  all ids from there on are those of the whole text.
* As a guard, the ids that follow it in both chunks must agree up to the last
  white space of the overlap.
* If an overlap holds no such place, it is widened fourfold, up to the rest of
  the text, which is then encoded whole.

So memory is bounded by a chunk, not by the text, wherever white space occurs.

Defined cases: a null text counts as empty; empty text and white space alone
have 0 tokens; repeated rows are counted row by row; an empty table gives an
empty one; other columns of the input are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm.common import ship, text_bytes, tokenizer_path
from tessera.llm.lexicon import slices
from tessera.llm.word_bpe import encoder

#: Texts over so many bytes count as huge; characters in a chunk and in the first overlap.
HUGE, CHUNK, OVERLAP = 16_384, 4_096, 256
WHITE = " \t\n\r\x0b\x0c"


def _tokens(library, text: str, at: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, starts in the whole text) of a chunk that begins at ``at``."""
    e = library.encode(text, add_special_tokens=False)
    return np.array(e.ids, np.int64), np.array([a for a, _ in e.offsets], np.int64) + at


def stable_boundary(text: str, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], begin: int, end: int) -> tuple[int, int] | None:
    """The first proven boundary in ``text[begin:end]``, as (tokens of the left chunk before it, of the right chunk)."""
    (ids_a, at_a), (ids_b, at_b) = left, right
    last = max(text.rfind(c, begin, end) for c in WHITE)
    common = np.intersect1d(at_a[at_a > begin], at_b)
    for p in common:
        if p >= last:
            return None
        if text[p - 1] in WHITE:
            a, b = int(np.searchsorted(at_a, p)), int(np.searchsorted(at_b, p))
            x, y = ids_a[a : np.searchsorted(at_a, last)], ids_b[b : np.searchsorted(at_b, last)]
            if np.array_equal(x, y):
                return a, b
    return None


def spliced_ids(library, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[np.ndarray]:
    """The ids of a huge text, in runs, from overlapping chunks."""
    at, skip, size = 0, 0, chunk  # the present chunk's start, and how many of its tokens are already given
    here = _tokens(library, text[:size], 0)
    while at + size < len(text):
        wide = overlap
        while True:
            begin = max(at + 1, at + size - wide)
            next_size = max(chunk, 2 * wide)
            there = _tokens(library, text[begin : begin + next_size], begin)
            if found := stable_boundary(text, here, there, begin, at + size):
                break
            if at + size >= len(text):
                break
            wide *= 4  # alignment failed: widen the overlap, to the right as well
            size = min(len(text) - at, size + wide)
            here = _tokens(library, text[at : at + size], at)
        if not found:
            break
        cut, start = found
        yield here[0][skip:cut]
        at, skip, size, here = begin, start, next_size, there
    yield here[0][skip:]


def count_batch(path: str, texts: pa.Array, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Tokens of each text of a batch."""
    enc = encoder(path)
    out = np.zeros(len(texts), np.int64)
    for start, part in slices(texts):
        long = pc.greater(pc.binary_length(part), huge).to_numpy(zero_copy_only=False)
        out[start : start + len(part)] = enc.count(pc.if_else(pa.array(~long), part, pa.scalar("")))
        for i in np.flatnonzero(long):
            out[start + i] = sum(len(x) for x in spliced_ids(enc.library, part[i].as_py(), chunk, overlap))
    return out


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", limit: int = 2048, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row; no shuffle, one pass over the id and the text.

    ``huge``: bytes beyond which a text is cut into chunks of ``chunk`` characters with overlaps of ``overlap`` at first.
    """
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path(tokenizer)
        try:
            for b in batches:
                texts = text_bytes(b.column(1))
                n = count_batch(path, texts, huge, chunk, overlap)
                yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])
        finally:
            encoder(path).forget()

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
