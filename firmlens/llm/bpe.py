"""Byte-pair encoding and decoding with batched merge rounds in numpy.

The vocabulary file names its merges in order of rank. Symbols of many distinct words lie in
one flat array; a round looks every neighbouring pair up by binary search over the sorted pair
keys, finds the lowest rank of each word and merges its pairs of that rank, until no word has
a pair left. A task keeps the ids of the words it has met in a bounded table, so a word that
recurs costs a look-up.

Results (the library's for this file: normal form C, white space dropped, lower case, then
letters, single digits and runs of symbols apart):

* a null or empty text, or one of white space, has no ids; it decodes to the empty text;
* the two special tokens' strings in a text give their ids;
* decoding joins the tokens' strings by spaces and leaves out ids that the file doesn't have;
* rows are handled one by one, so repeated rows give repeated results; an input column with the
  name of a new one gives way to it.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from . import batches as B

#: White space of the file's pattern \s.
_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Characters that str.split() takes for white space and the file's pattern doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A BPE file of the tokenizers library with word ends, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model["end_of_word_suffix"] or ""
        ids = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_id = {i: t for t, i in [*ids.items(), *self.special.items()]}
        self.tokens = [by_id.get(i) for i in range(max(by_id) + 1)]
        self.size = len(self.tokens)
        letters = byte_letters()
        self.inner = np.array([ids[x] for x in letters], np.int64)
        self.last = np.array([ids[x + end] for x in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)  # by rank
        self.cut = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.special_cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _NONE where there is no such merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their words after all merges; ``word`` ascends."""
        done_symbols, done_words = [], []
        rank = np.full(len(symbols), _NONE)
        if len(symbols) > 1:
            near = np.flatnonzero(word[1:] == word[:-1])
            rank[near] = self.rank(symbols[near], symbols[near + 1])
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[first, len(word)])
            low = np.repeat(np.minimum.reduceat(rank, first), lengths)
            over = low == _NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                on = ~over
                symbols, word, rank, low = symbols[on], word[on], rank[on], low[on]
                if not len(symbols):
                    break
            at = rank == low
            both = at[1:] & at[:-1]  # equal symbols in a row: every second pair, from the left
            if both.any():
                place = np.arange(len(at))
                run = np.maximum.accumulate(np.where(at & np.r_[True, ~at[:-1]], place, 0))
                at &= (place - run) % 2 == 0
            symbols[at] = self.made[rank[at]]
            stay = np.r_[True, ~at[:-1]]
            symbols, word, rank, fresh = symbols[stay], word[stay], rank[stay], at[stay]
            fresh = np.flatnonzero(fresh | np.r_[fresh[1:], False])
            rank[fresh] = _NONE
            fresh = fresh[fresh < len(word) - 1]
            fresh = fresh[word[fresh] == word[fresh + 1]]
            rank[fresh] = self.rank(symbols[fresh], symbols[fresh + 1])
        if not done_symbols:
            return symbols, word
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def encode_words(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and how many each chunk (a string without white space) has."""
        parts: list[bytes] = []  # of text; a special token is an empty part
        owner: list[int] = []
        special: list[tuple[int, int]] = []
        for i, chunk in enumerate(chunks):
            segments = [chunk]
            if self.special_cut and "<" in chunk:
                segments = re.split(f"({self.special_cut.pattern})", chunk)
            for segment in segments:
                if segment in self.special:
                    special.append((len(parts), self.special[segment]))
                    parts.append(b"")
                    owner.append(i)
                    continue
                if not segment.isascii():
                    segment = unicodedata.normalize("NFC", segment).replace("Σ", "σ")
                found = self.cut.findall(segment.lower())
                parts += [x.encode() for x in found]
                owner += [i] * len(found)
        if not parts:
            return np.zeros(0, np.int64), np.zeros(len(chunks), np.int64)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        data = np.frombuffer(b"".join(parts), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(lengths)[lengths > 0] - 1
        symbols[ends] = self.last[data[ends]]
        symbols, word = self.merge(symbols, np.repeat(np.arange(len(parts)), lengths))
        if special:
            at, ids = np.array(special).T
            symbols, word = np.r_[symbols, ids], np.r_[word, at]
            order = np.argsort(word, kind="stable")
            symbols, word = symbols[order], word[order]
        return symbols, np.bincount(np.asarray(owner)[word], minlength=len(chunks))


def chunks_of(text: str) -> list[str]:
    """The parts of a text between white space, as the file's pattern sees it."""
    return [x for x in _WHITE.split(text) if x] if _SEPARATORS.search(text) else text.split()


class Encoder:
    """Encodes texts, keeping the ids of words in a bounded table."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.flat, self.used = np.zeros(1024, np.uint32), 0
        self.begin, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.table = B.WordTable(self._fill, 600_000)
        self.token_bytes = np.array([(t or "").encode() for t in self.vocabulary.tokens], object)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.vocabulary.encode_words(words)

    def _fill(self, words: list[str], first: int) -> None:
        if first == 0:
            self.used = 0
        ids, lengths = self._ids(words)
        self.flat = B.put(self.flat, self.used, ids)
        self.begin = B.put(self.begin, first, self.used + B.starts(lengths))
        self.length = B.put(self.length, first, lengths)
        self.used += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and how many each has."""
        flat: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        held: list[str] = []
        held_by: list[tuple[int, int]] = []

        def flush() -> None:
            if held:
                number = self.table.numbers(held)
                lengths = self.length[number]
                flat.append(self.flat[B.spans(self.begin[number], lengths)])
                at = 0
                for i, n in held_by:
                    counts[i] += lengths[at : at + n].sum()
                    at += n
                held.clear()
                held_by.clear()

        for i, text in enumerate(texts):
            for piece in B.pieces(text):
                found = chunks_of(piece)
                held += found
                held_by.append((i, len(found)))
                if len(held) > 400_000:
                    flush()
        flush()
        return (np.concatenate(flat) if flat else np.zeros(0, np.uint32)), counts

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings joined by spaces, in UTF-8."""
        ids = ids[ids < self.vocabulary.size]
        return b" ".join(self.token_bytes[ids].tolist())


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for a Python worker."""
    return Encoder(path)


def room(columns: list[str], *names: str) -> list[str]:
    """The columns without those of a result's names (in any case): an input column gives way to a new one of its name."""
    new = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in new]


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", count: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (by default all columns but the text) with ids as little-endian 32-bit integers in a binary, and their number."""
    return _mapped(df, vocabulary, text, ids, count, None, keep)


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", count: str = "n_tokens", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """As ``encode``, with the text that the ids decode to."""
    return _mapped(df, vocabulary, text, ids, count, decoded, keep)


def _mapped(df: DataFrame, vocabulary: str, text: str, ids: str, count: str, decoded: str | None, keep: list[str] | None) -> DataFrame:
    new = [ids, count] + ([decoded] if decoded else [])
    keep = room([c for c in df.columns if c != text] if keep is None else keep, *new)
    schema = T.StructType([f for f in df.schema if f.name in keep] + [T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType())] + ([T.StructField(decoded, T.StringType())] if decoded else []))
    kept = [f.name for f in schema][: len(keep)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = encoder(vocabulary)
        for batch in B.cut(it, text):
            flat, counts = worker.encode(B.texts(batch, text))
            edges = np.r_[0, np.cumsum(counts)]
            found = [flat[a:b] for a, b in zip(edges[:-1], edges[1:])]
            columns = [batch.column(c) for c in kept] + [pa.array([x.astype("<u4").tobytes() for x in found], pa.binary()), pa.array(counts, pa.int64())]
            if decoded:
                columns.append(pa.array([str(worker.decode(x), "utf-8") for x in found], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    return df.select(*kept, text).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids (binary as ``encode`` makes; null: the empty text)."""
    df = df.select(*room(df.columns, decoded))
    schema = T.StructType([*df.schema.fields, T.StructField(decoded, T.StringType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = encoder(vocabulary)
        for batch in B.cut(it, ids):
            found = [str(worker.decode(np.frombuffer(x or b"", "<u4")), "utf-8") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, decoded])

    return df.mapInArrow(run, schema)
