"""Arrow batches cut to a bounded amount of text, and helpers on flat arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task holds as Python objects at a time.
TEXT_BYTES = 2_000_000

#: The words of the contracts: runs of anything but the six ASCII white-space characters.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
#: White space for str.split() that those six characters aren't.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_WORD = re.compile(WORD_PATTERN)
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SPACE = re.compile(r"[\x20\x09-\x0D]")


def cut(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def texts(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The column's strings, null as the empty text."""
    return [x or "" for x in batch.column(text).to_pylist()]


def words(text: str) -> list[str]:
    """The words of a text."""
    return _WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def lower_ascii(text: str) -> str:
    """A-Z to lower case, all else as it is."""
    return text.lower() if text.isascii() else text.translate(_UPPER)


def pieces(text: str, most: int = TEXT_BYTES) -> Iterator[str]:
    """A long text in parts of about ``most`` characters that end after a white-space character."""
    at = 0
    while len(text) - at > most:
        found = _SPACE.search(text, at + most)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text


def starts(lengths: np.ndarray) -> np.ndarray:
    """Where each run begins in the flat array of all runs."""
    out = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=out[1:])
    return out


def spans(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Flat indices of the runs begin[i] .. begin[i] + lengths[i] - 1."""
    return np.repeat(begin - starts(lengths), lengths) + np.arange(int(lengths.sum()))


def run_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; an empty run sums to 0."""
    out = np.zeros((len(lengths), *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    full = lengths > 0
    if full.any():
        out[full] = np.add.reduceat(values, starts(lengths)[full], axis=0, dtype=out.dtype)
    return out


class WordTable:
    """Numbers for words, with a bound on words and on their characters: when it is full it starts again.

    ``fill(new_words, first)`` is called with words that get the numbers from ``first`` on,
    so that the owner keeps what it derives from a word in arrays by number.
    """

    def __init__(self, fill, most: int = 300_000, most_chars: int = 32_000_000):
        self.fill, self.most, self.most_chars, self.number, self.chars = fill, most, most_chars, {}, 0

    def numbers(self, found: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.number.get, found, repeat(-1)), np.int64, len(found))
        at = np.flatnonzero(out < 0)
        if len(at):
            new = list(dict.fromkeys(map(found.__getitem__, at.tolist())))
            chars = sum(map(len, new))
            if len(new) + len(self.number) > self.most or chars + self.chars > self.most_chars:
                self.number, self.chars, at = {}, 0, np.arange(len(found))
                new = list(dict.fromkeys(found))
                chars = sum(map(len, new))
            self.chars += chars
            first = len(self.number)
            self.fill(new, first)
            self.number.update(zip(new, range(first, first + len(new))))
            out[at] = np.fromiter(map(self.number.__getitem__, map(found.__getitem__, at.tolist())), np.int64, len(at))
        return out


def put(array: np.ndarray, first: int, values: np.ndarray) -> np.ndarray:
    """``array`` with ``values`` from place ``first`` on, grown where needed."""
    need = first + len(values)
    if need > len(array):
        grown = np.zeros((max(need, 2 * len(array), 1024), *array.shape[1:]), array.dtype)
        grown[:first] = array[:first]
        array = grown
    array[first:need] = values
    return array
