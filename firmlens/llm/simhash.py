"""SimHash near-duplicates by anchor-point covering.

The fingerprint of a text has a bit for each of 64 positions, 1 where over half of the hashes of
its word shingles have it. Different fingerprints are linked when few bits differ. To find links,
46 of the bits are read as two words of the perfect binary Golay code of length 23 (covering
radius 3): the anchors are the pairs of code words. Every fingerprint has one home anchor, the
pair of code words nearest to it, and is sent to every anchor that is the home of some word
within the threshold of its own bits, which are anchors within covering radius plus threshold.
Two fingerprints within the threshold therefore meet at the home of either; they are compared
there by all 64 bits. Links are joined to components.

* Null and empty texts, and texts of white space, have fingerprint zero, linked like any other.
* Texts with equal fingerprints are one node, so a group of copies costs one row, whatever its size.
* A component is named by its smallest id. Rows with a null id share the class of their
  fingerprint but name it only if it has no other id.
* Extra columns pass through; one with the name of a new column gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..core.scratch import Scratch
from . import batches as B
from .bpe import room
from .components import components

#: Hash seed of the shingles and words of a shingle.
SEED, SHINGLE = 42, 3
#: Generator polynomial of the binary Golay code, its length and its covering radius.
GOLAY, LENGTH, RADIUS = 0b101011100011, 23, 3


def shingle_bits(found: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, int]:
    """How many shingle hashes have each bit, and the number of shingles, for words in UTF-8."""
    hashed, seed = xxhash.xxh64_intdigest, SEED
    if not found:
        return np.zeros(64, np.int64), 0
    if len(found) < width:
        values = [hashed(b" ".join(found), seed)]
    else:
        joined = b" ".join(found)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(lengths + 1) - 1
        begins = (ends - lengths)[: len(found) - width + 1].tolist()
        values = [hashed(joined[a:b], seed) for a, b in zip(begins, ends[width - 1 :].tolist())]
    bits = np.unpackbits(np.array(values, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(0, dtype=np.int64), len(values)


def fingerprint(text: str) -> int:
    """The fingerprint of a whole text as a signed 64-bit integer."""
    ones, n, tail = np.zeros(64, np.int64), 0, []
    for piece in B.pieces(text):
        found = tail + [w.encode() for w in B.words(B.lower_ascii(piece))]
        if len(found) < SHINGLE:
            tail = found
            continue
        more, count = shingle_bits(found)
        ones, n, tail = ones + more, n + count, found[len(found) - SHINGLE + 1 :]
    if not n and tail:
        ones, n = shingle_bits(tail)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (by default all columns) with the text's fingerprint as a long."""
    keep = room(df.columns if keep is None else keep, out)
    schema = T.StructType([f for f in df.schema if f.name in keep] + [T.StructField(out, T.LongType())])
    kept = [f.name for f in schema][:-1]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.cut(it, text):
            found = pa.array([fingerprint(x) for x in B.texts(batch, text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), found], names=[*kept, out])

    return df.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """The remainder of every word of LENGTH bits by the generator is its syndrome; (leader of each syndrome, syndrome of each single bit)."""
    single = []
    for k in range(LENGTH):
        value = 1 << k
        for bit in range(LENGTH - 1, 10, -1):
            if value >> bit & 1:
                value ^= GOLAY << (bit - 11)
        single.append(value)
    leader = np.zeros(1 << 11, np.int64)
    for weight in range(RADIUS + 1):
        for places in combinations(range(LENGTH), weight):
            syndrome = 0
            for k in places:
                syndrome ^= single[k]
            leader[syndrome] = sum(1 << k for k in places)
    return leader, np.array(single, np.int64)


def syndromes(words: np.ndarray) -> np.ndarray:
    """The syndrome of each word of LENGTH bits."""
    _, single = golay()
    out = np.zeros(len(words), np.int64)
    for k in range(LENGTH):
        out ^= np.where(words >> k & 1, single[k], 0)
    return out


def homes(words: np.ndarray) -> np.ndarray:
    """The code word nearest to each word of LENGTH bits."""
    return words ^ golay()[0][syndromes(words)]


@cache
def changes(weight: int) -> tuple[np.ndarray, np.ndarray]:
    """All words of LENGTH bits with so many ones, and their syndromes."""
    words = np.array([sum(1 << k for k in places) for places in combinations(range(LENGTH), weight)], np.int64)
    return words, syndromes(words)


def anchors(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) of all anchors at which a fingerprint has to appear."""
    leader, _ = golay()
    mask = (1 << LENGTH) - 1
    near: dict[tuple[int, int], np.ndarray] = {}  # by half and changed bits: homes, a column for each change
    for half in (0, 1):
        value = fps >> (half * LENGTH) & mask
        syndrome = syndromes(value)[:, None]
        for weight in range(threshold + 1):
            words, own = changes(weight)
            near[half, weight] = (value[:, None] ^ words ^ leader[syndrome ^ own]) << (half * LENGTH)
    rows = len(fps)
    found = np.concatenate([(near[0, a][:, :, None] | near[1, b][:, None, :]).reshape(rows, -1) for a in range(threshold + 1) for b in range(threshold + 1 - a)], axis=1)
    home = found[:, 0].copy()  # no bit changed
    found.sort(axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    row, column = np.nonzero(first)
    anchor = found[row, column]
    return row, anchor, anchor == home[row]


def links(fps: DataFrame, scratch: Scratch, threshold: int = 2, fp: str = "fp") -> DataFrame:
    """(a, b), a < b, of the distinct fingerprints in ``fps`` that differ in at most ``threshold`` bits."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 500):
                values = batch.column(0).slice(at, 500).to_numpy(zero_copy_only=False)
                row, anchor, home = anchors(values, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(values[row]), pa.array(home)], names=["anchor", "fp", "home"])

    spread = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the rows are narrow, the work on each isn't
    sent = scratch.save(fps.select(F.col(fp).cast("long").alias("fp")).distinct().repartition(spread, "fp").mapInArrow(run, "anchor long, fp long, home boolean"), "anchors")
    at_home = sent.filter("home").select(F.col("anchor").alias("at"), F.col("fp").alias("a"))
    met = sent.select("anchor", F.col("fp").alias("b")).join(at_home, (F.col("anchor") == F.col("at")) & (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _grouped(nodes: DataFrame, scratch: Scratch, threshold: int) -> DataFrame:
    """``nodes`` (node, a fingerprint, and least) with c, the least fingerprint of the node's component."""
    found = components(links(nodes, scratch, threshold, "node"), scratch).select(F.col("node").alias("n"), F.col("component").alias("c"))
    return nodes.join(found, F.col("node") == F.col("n"), "left").select("node", "least", F.coalesce("c", "node").alias("c"))


def near_duplicates(df: DataFrame, scratch: Scratch, threshold: int = 2, doc_id: str = "doc_id", text: str = "text", fp: str = "fp", component: str = "component_id", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (by default all columns) with the fingerprint and the component's smallest id."""
    keep = room(df.columns if keep is None else keep, fp, component)
    marked = scratch.save(fingerprints(df, text, fp, list(dict.fromkeys([*keep, doc_id]))), "fingerprints")
    least = scratch.save(marked.groupBy(F.col(fp).alias("node")).agg(F.min(doc_id).alias("least")), "nodes")
    grouped = _grouped(least, scratch, threshold)
    named = grouped.groupBy("c").agg(F.min("least").alias(component)).withColumnRenamed("c", "c2")
    of = grouped.join(named, F.col("c") == F.col("c2")).select(F.col("node").alias("_fl_fp"), component)
    return marked.join(of, F.col(fp) == F.col("_fl_fp")).select(*keep, fp, component)


def one_of_each(df: DataFrame, scratch: Scratch, threshold: int = 2, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (by default all columns) of exactly one row of each component: the least by id (null last), hash of the text, and a number of the row."""
    keep = room(df.columns if keep is None else keep, "_fl_fp", "_fl_tag", "_fl_rid")
    tagged = df.withColumn("_fl_tag", F.xxhash64(text))
    marked = fingerprints(tagged, text, "_fl_fp", list(dict.fromkeys([*keep, doc_id, "_fl_tag"]))).withColumn("_fl_rid", F.monotonically_increasing_id())
    marked = scratch.save(marked, "fingerprints")
    before = scratch.made
    order = F.struct(F.col(doc_id).isNull().alias("null"), F.col(doc_id).alias("id"), F.col("_fl_tag").alias("tag"), F.col("_fl_rid").alias("rid"))
    least = scratch.save(marked.groupBy(F.col("_fl_fp").alias("node")).agg(F.min(order).alias("least")), "nodes")
    stays = scratch.save(_grouped(least, scratch, threshold).groupBy("c").agg(F.min("least").alias("least")).select(F.col("least.rid").alias("_fl_stays")), "stays")
    scratch.drop_since(before, stays)
    return marked.join(stays, F.col("_fl_rid") == F.col("_fl_stays"), "left_semi").select(*keep)
