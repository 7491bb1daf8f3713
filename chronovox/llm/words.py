"""Per-task encoding of repeated words: each distinct word is worked on once, in Arrow and numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from chronovox.llm.common import ragged

#: Words that a task remembers at most; the memory is emptied when full, which changes no result.
CACHE_WORDS = 150_000


class WordTable:
    """word -> ids, kept as one flat array with a start and a length for each word.

    encode takes a list of words that it has not seen since the last clearing and returns
    (lengths, flat ids).
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = CACHE_WORDS):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int64)

    def lookup(self, words: pa.Array) -> np.ndarray:
        """Row numbers of the words in the table; the words are distinct."""
        if len(self.known) > self.limit:
            self.clear()
        words = words.cast(pa.large_string())
        rows = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.known), -1)).astype(np.int64)
        new = rows < 0
        if new.any():
            fresh = words.filter(pa.array(new))
            lengths, flat = self.encode(fresh.to_pylist())
            rows[new] = np.arange(len(self.known), len(self.known) + len(fresh))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, flat])
            self.known = pa.concat_arrays([self.known, fresh])
        return rows

    def expand(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids in order) for words with repeats."""
        coded = words.dictionary_encode()
        codes = self.lookup(coded.dictionary)[np.asarray(coded.indices)] if len(words) else np.zeros(0, np.int64)
        lengths = self.lengths[codes]
        return lengths, self.flat[ragged(self.starts[codes], lengths)]


def ascii_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of words of each text, the words): split at runs of ASCII white space."""
    parts = pc.ascii_split_whitespace(texts)
    words = parts.flatten()
    counts = np.asarray(pc.list_value_length(parts)).astype(np.int64)
    real = np.asarray(pc.greater(pc.binary_length(words), 0)) if len(words) else np.zeros(0, bool)
    if not real.all():
        total = np.concatenate([[0], np.cumsum(real)])
        ends = np.cumsum(counts)
        counts = total[ends] - total[ends - counts]
        words = words.filter(pa.array(real))
    return counts, words


def text_slices(batch: pa.RecordBatch, most: int, column: str = "text"):
    """(first row, texts) for runs of rows of about `most` bytes; null texts are empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.offset:
        col = col.take(pa.array(np.arange(len(col))))  # the cast of a slice keeps offsets that others take to begin at 0
    col = col.cast(pa.large_string())
    col = pc.fill_null(col, "")
    size = np.cumsum(np.asarray(pc.binary_length(col)).astype(np.int64))
    first = 0
    while first < len(col):
        done = size[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(size, done + most, "right")))
        yield first, col.slice(first, end - first)
        first = end
