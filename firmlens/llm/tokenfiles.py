"""Token files: ids of whole documents in shards, each document compressed under one shared dictionary.

Ids come from the tokenizers library, each document's followed by an end id. A shard is one row of
a Parquet table: ids of the documents, offsets of their parts in the shard's payload, token
counts, and the payload, in which every document is a zstandard frame of its own, so that a
document is read by its offset without its neighbours. The dictionary is trained on serialized id
arrays of at most ``DICTIONARY_DOCUMENTS`` documents, kept beside the shards and named in each of
them by its SHA-256. Shards are in ascending order of document id; a small index has the number
of ids before each part of the range.

A null or empty text has the end id only. Null document ids come first. Rows that share an id are
all written, in order of a hash of their text. A reader refuses a dictionary with another hash.
"""

from __future__ import annotations

import functools
import hashlib
import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import batches as B
from .bpe import Encoder

#: Documents that the dictionary is trained on at most, ids of each, and bytes of the dictionary.
DICTIONARY_DOCUMENTS, DICTIONARY_IDS, DICTIONARY_BYTES = 2000, 16_384, 65_536
LEVEL = 3
#: A shard ends at so many bytes of payload or documents.
SHARD_BYTES, SHARD_DOCUMENTS = 1 << 20, 4096

_SHARD = "part int, shard int, dictionary string, width int, before long, n_tokens long, doc_ids array<bigint>, counts binary, offsets binary, payload binary"


class LibraryEncoder(Encoder):
    """The encoder with the ids of new words from the tokenizers library.

    The file drops white space before its merges and normalises no further than a run between
    white space, so a text's ids are those of its runs one after another.
    """

    def __init__(self, path: str):
        super().__init__(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()

        self.ends = np.array([bool(t) and t.endswith("</w>") for t in self.vocabulary.tokens])

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths.sum())), lengths

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As one by one, in one text with a line for each word; words are told apart by the ids that end one of their parts."""
        lower = [(w if w.isascii() else unicodedata.normalize("NFC", w)).lower() for w in words]
        parts = np.fromiter((1 if w.isalpha() else len(self.vocabulary.cut.findall(w)) for w in lower), np.int64, len(words))  # letters alone are one part
        ids = np.array(self.library.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != parts.sum():  # the library parts some word in another way
            return self._one_by_one(words)
        edges = np.r_[0, ends + 1][np.r_[0, np.cumsum(parts)]]
        return ids, np.diff(edges)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        runs = [words[a : a + 500] for a in range(0, len(words), 500)]
        found = [self._one_by_one(run) if any("<|" in w for w in run) else self._together(run) for run in runs]
        if not found:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))


@functools.cache
def library_encoder(path: str) -> LibraryEncoder:
    """One encoder for a Python worker."""
    return LibraryEncoder(path)


def encoded(batch: pa.RecordBatch, text: str, vocabulary: str, end: int) -> list[np.ndarray]:
    """The ids of each row of a batch, with the end id."""
    flat, counts = library_encoder(vocabulary).encode(B.texts(batch, text))
    edges = np.r_[0, np.cumsum(counts)]
    return [np.append(flat[a:b], np.uint32(end)) for a, b in zip(edges[:-1], edges[1:])]


def train_dictionary(docs: DataFrame, vocabulary: str, end: int, width: int, doc_id: str, text: str) -> bytes:
    """A dictionary from the serialized ids of a bounded sample, chosen by a hash of the id; of a repeated id one row counts."""
    chosen = docs.select(doc_id).orderBy(F.xxhash64(doc_id), doc_id).limit(DICTIONARY_DOCUMENTS).distinct()
    found = docs.select(doc_id, text).join(F.broadcast(chosen), doc_id, "left_semi")  # a bounded side
    sample = found.groupBy(doc_id).agg(F.min_by(text, F.xxhash64(text)).alias(text))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.cut(it, text):
            found = [x[:DICTIONARY_IDS].astype(f"<u{width}").tobytes() for x in encoded(batch, text, vocabulary, end)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["ids"])

    samples = sorted(bytes(r.ids) for r in sample.mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their own bytes serve
        return b"".join(samples)[:DICTIONARY_BYTES] or b"\0" * 8


@functools.cache
def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data), write_checksum=True)


@functools.cache
def _decompressor(data: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))


@dataclass
class TokenFiles:
    """A written set of token files."""

    path: str

    def shards(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_SHARD).parquet(f"{self.path}/shards")

    def dictionary(self, spark: SparkSession) -> bytes:
        row = spark.read.parquet(f"{self.path}/dictionary").first()
        if hashlib.sha256(row.data).hexdigest() != row.sha256:
            raise ValueError("the dictionary is not the one of its name")
        return bytes(row.data)

    def read(self, spark: SparkSession, doc_ids: list[int] | None = None) -> DataFrame:
        """(doc_id, start, n_tokens, ids) of all documents or of some; ids are little-endian 32-bit integers."""
        data = spark.sparkContext.broadcast(self.dictionary(spark))  # DICTIONARY_BYTES at most
        name = hashlib.sha256(data.value).hexdigest()
        wanted = None if doc_ids is None else frozenset(doc_ids)
        shards = self.shards(spark)
        if wanted is not None:
            shards = shards.filter(F.arrays_overlap("doc_ids", F.array(*map(F.lit, sorted(wanted)))))
        index = spark.read.parquet(f"{self.path}/index").withColumnRenamed("part", "part_")  # a row for each part
        placed = shards.join(index, F.col("part") == F.col("part_")).select(*(c for c in shards.columns if c not in ("before", "part", "shard")), (F.col("before") + F.col("base")).alias("before"))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for shard in range(batch.num_rows):
                    row = batch.slice(shard, 1).to_pylist()[0]
                    if row["dictionary"] != name:
                        raise ValueError("the shard was written with another dictionary")
                    counts, offsets = np.frombuffer(row["counts"], "<u8"), np.frombuffer(row["offsets"], "<u8")
                    start = row["before"] + B.starts(counts.astype(np.int64))
                    some = [i for i, d in enumerate(row["doc_ids"]) if wanted is None or d in wanted]
                    payload, open_ = row["payload"], _decompressor(data.value)
                    for a in range(0, len(some), 512):
                        part = some[a : a + 512]
                        ids = [np.frombuffer(open_.decompress(payload[offsets[i] : offsets[i + 1]]), f"<u{row['width']}").astype("<u4") for i in part]
                        columns = [pa.array([row["doc_ids"][i] for i in part], pa.int64()), pa.array(start[part], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

        return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def write(docs: DataFrame, path: str, vocabulary: str, end: int = 2, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> TokenFiles:
    """Write the token files of all rows below ``path``, a folder that all executors share."""
    spark = docs.sparkSession
    size = len(library_encoder(vocabulary).vocabulary.tokens)
    width = 2 if max(size, end + 1) <= 1 << 16 else 4
    docs = docs.select(F.col(doc_id).cast("long").alias(doc_id), text)
    trained = train_dictionary(docs, vocabulary, end, width, doc_id, text)
    name = hashlib.sha256(trained).hexdigest()
    data = spark.sparkContext.broadcast(trained)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        counts: list[int] = []
        frames: list[bytes] = []
        held = 0

        def full() -> pa.RecordBatch:
            offsets = np.r_[0, np.cumsum([len(f) for f in frames])]
            values = [part, shard, name, width, before, sum(counts), ids, np.array(counts, "<u8").tobytes(), offsets.astype("<u8").tobytes(), b"".join(frames)]
            types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=[c.split()[0] for c in _SHARD.split(", ")])

        for batch in B.cut(it, text):
            found = encoded(batch, text, vocabulary, end)
            for doc, x in zip(batch.column(doc_id).to_pylist(), found):
                ids.append(doc)
                counts.append(len(x))
                frames.append(_compressor(data.value).compress(x.astype(f"<u{width}").tobytes()))
                held += len(frames[-1])
                if held >= SHARD_BYTES or len(ids) >= SHARD_DOCUMENTS:
                    yield full()
                    shard, before = shard + 1, before + sum(counts)
                    ids, counts, frames, held = [], [], [], 0
        if ids:
            yield full()

    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # only the ids are sampled for the ranges before the texts move, once
    ordered = docs.repartitionByRange(n, F.col(doc_id).asc_nulls_first()).sortWithinPartitions(F.col(doc_id).asc_nulls_first(), F.xxhash64(text))
    ordered.mapInArrow(run, _SHARD).write.parquet(f"{path}/shards")
    spark.createDataFrame([(name, bytearray(trained), width)], "sha256 string, data binary, width int").coalesce(1).write.parquet(f"{path}/dictionary")
    files = TokenFiles(path)
    by_part = files.shards(spark).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    by_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).write.parquet(f"{path}/index")
    return files
