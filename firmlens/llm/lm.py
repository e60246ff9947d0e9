"""LM scoring: a causal self-attention model on subword ids, beside a word-count base.

Learning rows are those for which a condition holds. All of them are read whole, and every one
of their tokens is counted and is a target of training once:

* words (runs of other than the six ASCII white-space characters, A-Z in lower case) are counted,
  with one end for each document;
* subword ids, pairs and triples of ids that follow each other are counted by key; pairs and triples
  that make up at least one in ``KEPT`` of all ids are the model's, so there are ``KEPT`` of each at most;
* overlapping windows train the attention model, which foretells the next id's class. Pieces of texts are
  dealt by a hash to ``ROUNDS`` rounds and to shards of about ``SHARD`` ids. In a round every shard
  trains in an order given by the hashes, from the same weights; the mean of the shards, weighted by their windows, is
  the next round's beginning. Sums are of integers, and the number of shards follows from the number of ids alone.
  So neither the files nor the tasks and cores change the model; scores
  differ by the rounding of their batches at most, some 1e-9 of their size.

The probability of an id is interpolated: from a count the part ``OFF`` is taken; what a triple's context has left
over goes to the attention model, which gives a class; an id has its share of its class after the id before it, by pairs whose left-over
goes to the ids' own shares. All of these sum to one. A document is scored whole in overlapping windows, every token once.

Ids are grouped to ``CLASSES`` by their neighbours in the pairs.

The base sums log10((c + 0.5) / (N + 0.5 (V + 1))) over words and the end. Counts of frequent words
(at most ``FREQUENT``, a share of all tokens) travel with the scorer; those of the other words are
joined by word, so nothing that grows with the vocabulary is broadcast.

A null or empty text is its end only. Repeated rows are scored one by one. With no learning rows
c, N and V are 0 and the model gives every id its even share of a class.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..core.scratch import Scratch
from . import batches as B
from .attention import CLASSES, SPAN, STRIDE, WIDTH, Adam, Attention
from .bpe import encoder, room
from .tables import add_up, blocks

#: A pair or triple is kept from a share of one in KEPT of all ids; OFF is taken from its count.
KEPT, OFF = 1 << 21, 0.75
#: Ids of a shard, rounds, targets of a piece of text, windows of a batch.
SHARD, ROUNDS, PIECE, BATCH = 1 << 22, 3, 1024, 256
#: Keys that a task counts at a time, bytes of ids that it makes keys of at a time, and bits of an id in a key.
COUNTED, KEYED, ID_BITS = 1 << 20, 1 << 18, 18
#: A word is frequent from a share of one in FREQUENT of all tokens; so there are FREQUENT at most.
FREQUENT = 100_000
#: Weights are summed as integers of this many to one.
_FIXED = 1 << 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all rows."""
    bare = F.btrim(F.translate(F.col(text), _UPPER, _LOWER), F.lit(" \t\n\x0b\f\r"))
    found = docs.select(F.explode(F.split(bare, "[\\x20\\x09-\\x0D]+")).alias("word")).filter("word <> ''")
    return found.groupBy("word").agg(F.count("*").alias("n"))


class Keys:
    """Places of keys in a sorted array, by a table of hashes with linear probing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = self._hash(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            more = self.slots[at] != left
            left, at = left[more], (at[more] + 1) & (len(self.slots) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each key, -1 without one."""
        at = self._hash(wanted)
        out = self.slots[at]
        if not len(self.keys):
            return out
        wrong = np.flatnonzero((out >= 0) & (self.keys[out] != wanted))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.slots) - 1)
            out[wrong] = self.slots[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[out[wrong]] != wanted[wrong])]
        return out


@dataclass
class Counts:
    """Interpolated shares by the counts of ids, pairs and triples."""

    own: np.ndarray  # share of each id
    pairs: np.ndarray  # sorted keys: id before and id
    after: np.ndarray  # share of the id after the one before it, less OFF
    left: np.ndarray  # of each id before: what the pairs leave over
    triples: np.ndarray  # sorted keys: place of the pair before, and id
    third: np.ndarray  # share of the id after that pair, less OFF
    rest: np.ndarray  # of each pair: what the triples leave over
    first: int  # place of the pair of two starts, -1 without learning rows

    @classmethod
    def of(cls, size: int, start: int, end: int, keys: np.ndarray, n: np.ndarray) -> Counts:
        """From keys of one, two and three ids, as ``gram_keys`` makes them, and their counts."""
        order = keys >> (3 * ID_BITS)
        ids = np.zeros(size)
        ids[keys[order == 1] & _ID] = n[order == 1]
        begun = ids[end]  # documents
        context = ids.copy()
        context[start], context[end] = begun, 0
        pairs, count = keys[order == 2] & _TWO, n[order == 2].astype(np.float64)
        if begun:
            pairs, count = np.append(pairs, start << ID_BITS | start), np.append(count, begun)
        sort = np.argsort(pairs)
        pairs, count = pairs[sort], count[sort]
        real = pairs != (start << ID_BITS | start)
        before = pairs >> ID_BITS
        after = np.where(real, np.maximum(count - OFF, 0) / np.maximum(context[before], 1), 0)
        left = np.clip(1 - np.bincount(before, weights=after, minlength=size), 0, 1)
        three, triple = keys[order == 3] & ((1 << 3 * ID_BITS) - 1), n[order == 3]
        place = np.searchsorted(pairs, three >> ID_BITS)  # a kept triple's pair is as frequent, so it's kept
        third = np.maximum(triple - OFF, 0) / np.maximum(count[place], 1) if len(three) else np.zeros(0)
        rest = np.clip(1 - np.bincount(place, weights=third, minlength=len(pairs)), 0, 1)
        triples = place << ID_BITS | (three & _ID)
        sort = np.argsort(triples)
        first = int(np.searchsorted(pairs, start << ID_BITS | start)) if begun else -1
        return cls(((ids + 0.05) / (ids + 0.05).sum()).astype(np.float32), pairs, after.astype(np.float32), left.astype(np.float32), triples[sort], third[sort].astype(np.float32), rest.astype(np.float32), first)

    def of_classes(self, class_of: np.ndarray) -> np.ndarray:
        """Share of every class after every id."""
        size = len(self.own)
        mass = np.bincount(class_of, weights=self.own, minlength=CLASSES)
        found = np.bincount((self.pairs >> ID_BITS) * CLASSES + class_of[self.pairs & _ID], weights=self.after, minlength=size * CLASSES).reshape(size, CLASSES)
        return (found + self.left[:, None] * mass).astype(np.float32)

    @functools.cached_property
    def _keys(self) -> tuple[Keys, Keys]:
        return Keys(self.pairs), Keys(self.triples)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_keys"}

    def shares(self, inputs: np.ndarray, targets: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every place: the share by pairs, the share by triples alone, and what these leave over; runs begin at ``begins``."""
        pairs, triples = self._keys
        pair = pairs.places(inputs << ID_BITS | targets)
        context = np.empty_like(pair)
        context[1:] = pair[:-1]
        context[begins] = self.first
        two = self.left[inputs] * self.own[targets]
        met = pair >= 0
        two[met] += self.after[pair[met]]
        three, rest = np.zeros(len(inputs), np.float32), np.ones(len(inputs), np.float32)
        known = np.flatnonzero(context >= 0)
        rest[known] = self.rest[context[known]]
        place = triples.places(context[known].astype(np.int64) << ID_BITS | targets[known])
        met = place >= 0
        three[known[met]] = self.third[place[met]]
        return two, three, rest


_ID, _TWO = (1 << ID_BITS) - 1, (1 << 2 * ID_BITS) - 1


def gram_keys(inputs: np.ndarray, targets: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Keys of the ids, of the pairs and of the triples that end at every place; the number of ids is above them."""
    before = np.empty_like(inputs)
    before[1:] = inputs[:-1]
    before[begins] = inputs[begins]
    two = inputs << ID_BITS | targets
    return np.concatenate([1 << 3 * ID_BITS | targets, 2 << 3 * ID_BITS | two, 3 << 3 * ID_BITS | before << 2 * ID_BITS | two])


@dataclass
class LanguageModel:
    vocabulary: str
    attention: Attention
    class_of: np.ndarray  # of each id
    counts: Counts
    classes: np.ndarray  # share of each class after an id, ids x CLASSES
    start: int
    end: int

    @functools.cached_property
    def _tables(self) -> dict[str, np.ndarray]:
        return self.attention.tables()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}

    def log10(self, texts: list[str]) -> np.ndarray:
        """log10 probability of each whole text (A-Z in lower case) with its end."""
        return self.log10_of_ids(*encoder(self.vocabulary).encode(texts))

    def logs(self, inputs: np.ndarray, targets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log P(target) at every place of runs laid end to end."""
        kinds = self.class_of[targets]
        two, three, rest = self.counts.shares(inputs, targets, B.starts(lengths))
        own = np.exp(self.attention.class_logs(inputs, kinds, lengths, self._tables)) * two / self.classes[inputs, kinds]
        return np.log(np.maximum(three + rest * own, 1e-30))

    def log10_of_ids(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The same from the texts' ids, laid end to end."""
        inputs, targets, lengths = sequences(flat, counts, self.start, self.end)
        out = np.zeros(len(counts))
        ends = np.cumsum(lengths)
        a = 0
        while a < len(counts):  # runs of texts, to bound what is held; a longer text is one run
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 400_000, side="right")))
            low, high = (ends[a - 1] if a else 0), ends[b - 1]
            out[a:b] = B.run_sums(self.logs(inputs[low:high], targets[low:high], lengths[a:b]).astype(np.float64), lengths[a:b])
            a = b
        return out / math.log(10)


class FrequentWords:
    """Sums over the frequent words of texts, and the words that are left."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.logs = np.zeros(1024)
        self.table = B.WordTable(self._fill)

    def _fill(self, words: list[str], first: int) -> None:
        self.logs = B.put(self.logs, first, np.array([math.log10(self.counts[w] + 0.5) if w in self.counts else np.nan for w in words]))

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Words of each text, frequent ones, the sum of log10(count + 0.5) over these; the other words of all texts, and how many of each."""
        n, hits, per = (np.zeros(len(texts), np.int64) for _ in range(3))
        sums, rare = np.zeros(len(texts)), []
        for i, text in enumerate(texts):
            for piece in B.pieces(text):
                found = B.words(piece)
                number = self.table.numbers(found)
                logs = self.logs[number]
                other = np.flatnonzero(np.isnan(logs))
                n[i] += len(found)
                hits[i] += len(found) - len(other)
                per[i] += len(other)
                sums[i] += np.nansum(logs)
                rare += [found[k] for k in other.tolist()]
        return n, hits, sums, rare, per


def sequences(flat: np.ndarray, counts: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (start and ids), targets (ids and end) and lengths of texts, laid end to end."""
    flat = flat.astype(np.int64)
    at = np.cumsum(counts)
    return np.insert(flat, at - counts, start), np.insert(flat, at, end), counts + 1


def _ids(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a batch's texts laid end to end, and their numbers."""
    held = [np.frombuffer(x, stored(size)) for x in batch.column("_fl_ids").to_pylist()]
    return np.concatenate(held) if held else np.zeros(0, stored(size)), np.fromiter(map(len, held), np.int64, len(held))


def stored(size: int) -> str:
    """How ids are kept."""
    return "<u2" if size <= 1 << 16 else "<u4"


def counted_keys(batches: Iterator[pa.RecordBatch], size: int, start: int, end: int) -> Iterator[pa.RecordBatch]:
    """(key, n) of all ids, pairs and triples of the texts, COUNTED keys at a time; a key can come more than once."""
    held: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        keys = np.concatenate(held)
        held.clear()
        keys.sort()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return pa.RecordBatch.from_arrays([pa.array(keys[first], pa.int64()), pa.array(np.diff(np.r_[first, len(keys)]), pa.int64())], names=["key", "n"])

    for batch in B.cut(batches, "_fl_ids", KEYED):
        inputs, targets, lengths = sequences(*_ids(batch, size), start, end)
        held.append(gram_keys(inputs, targets, B.starts(lengths)))
        if sum(map(len, held)) > COUNTED:
            yield counted()
    if held:
        yield counted()


def grams(learn: DataFrame, size: int, start: int, end: int) -> DataFrame:
    """(key, n) of all ids, pairs and triples of the texts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()  # texts are encoded by now; a worker that did so would hold its words through all later stages
        return counted_keys(it, size, start, end)

    return learn.select("_fl_ids").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def neighbours(counts: Counts, ids: np.ndarray) -> np.ndarray:
    """For each id the sums of random signs of the ids before and after it over the pairs' shares, and how often it is a target."""
    size = len(ids)
    sign = np.random.default_rng(5).integers(0, 2, (size, WIDTH)) * 2.0 - 1
    before, after = counts.pairs >> ID_BITS, counts.pairs & _ID
    weight = counts.after * ids[before]
    out = np.zeros((size, 2 * WIDTH + 1))
    for k in range(WIDTH):
        out[:, k] = np.bincount(after, weights=weight * sign[before, k], minlength=size)
        out[:, WIDTH + k] = np.bincount(before, weights=weight * sign[after, k], minlength=size)
    out[:, -1] = ids
    return out


def group_ids(sums: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(class of each id, vector of each id): k-means of the neighbours' vectors; ids hardly met share the last class."""
    rng = np.random.default_rng(seed)
    vectors, met = sums[:, :-1].astype(np.float64), sums[:, -1]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    class_of = np.full(len(sums), CLASSES - 1)
    ids = np.flatnonzero(met >= 3)
    if len(ids) > CLASSES:
        x, weight = vectors[ids], np.sqrt(met[ids])
        centers = x[rng.choice(len(ids), CLASSES - 1, replace=False, p=weight / weight.sum())]
        for _ in range(12):
            nearest = np.argmax(x @ centers.T, 1)
            for k in range(CLASSES - 1):
                mine = nearest == k
                if mine.any():
                    c = (x[mine] * weight[mine, None]).sum(0)
                    centers[k] = c / max(np.linalg.norm(c), 1e-9)
        class_of[ids] = nearest
    else:
        class_of[ids] = np.arange(len(ids)) % (CLASSES - 1)
    return class_of, (vectors[:, :WIDTH] + vectors[:, WIDTH:]) / 2


def pieces(learn: DataFrame, size: int, start: int, end: int, shards: int) -> DataFrame:
    """(turn, shard, place, seen, ids) of the texts' pieces: ids of at most PIECE targets, after ``seen`` ids that only are keys and the id before."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.cut(it, "_fl_ids"):
            rows = []
            for key, x in zip(batch.column("_fl_key").to_pylist(), batch.column("_fl_ids").to_pylist()):
                ids = np.r_[start, np.frombuffer(x, stored(size)), end].astype(stored(size))
                for k, at in enumerate(range(0, len(ids) - 1, PIECE)):
                    seen = min(at, SPAN - STRIDE)
                    h = (key * 0x9E3779B97F4A7C15 + (k + 1) * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
                    h = ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) ^ h >> 32
                    rows.append((h % ROUNDS, h // ROUNDS % shards, h >> 1, seen, ids[at - seen : at + PIECE + 1].tobytes()))
            columns = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["turn", "shard", "place", "seen", "ids"])

    return learn.select("_fl_key", "_fl_ids").mapInArrow(run, "turn int, shard long, place long, seen int, ids binary")


def piece_windows(ids: np.ndarray, seen: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets, which inputs aren't there and which targets are, for each window of a piece."""
    n = len(ids) - 1 - seen
    place = seen + np.arange(0, n, STRIDE)[:, None] + np.arange(STRIDE - SPAN, STRIDE)
    query = place[:, SPAN - STRIDE :]
    return ids[np.clip(place, 0, len(ids) - 1)], ids[np.clip(query + 1, 0, len(ids) - 1)], place < 0, query < seen + n


def train_apart(model: Attention, class_of: np.ndarray, parts: DataFrame, scratch: Scratch) -> Attention:
    """The mean of what the shards make of the model, each from its own windows in their order, weighted by their number."""
    shared = parts.sparkSession.sparkContext.broadcast((model, class_of))
    sizes = [getattr(model, k).size for k in model.NAMES]
    kind = stored(len(class_of))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, of = shared.value
        total = np.zeros(sum(sizes) + 1, np.int64)
        own, held, shard, n = None, [], None, 0

        def step(most: int) -> None:
            while held and sum(len(h[0]) for h in held) >= most:
                whole = [np.concatenate(x) for x in zip(*held)]
                own.step(whole[0][:BATCH], of[whole[1][:BATCH]], whole[2][:BATCH], whole[3][:BATCH])
                held[:] = [tuple(x[BATCH:] for x in whole)] if len(whole[0]) > BATCH else []

        def close() -> None:
            if own is not None:
                step(1)
                flat = np.concatenate([getattr(own.model, k).ravel() for k in own.model.NAMES]).astype(np.float64)
                total[:] += np.r_[np.rint(flat * _FIXED).astype(np.int64) * n, n]

        for batch in it:
            for number, seen, x in zip(batch.column("shard").to_pylist(), batch.column("seen").to_pylist(), batch.column("ids").to_pylist()):
                if number != shard:
                    close()
                    own, shard, n = Adam(replace(begun, **{k: getattr(begun, k).copy() for k in begun.NAMES})), number, 0
                held.append(piece_windows(np.frombuffer(x, kind).astype(np.int64), seen))
                n += len(held[-1][0])
                step(BATCH)
        close()
        if total[-1]:
            for at, packed in blocks(total):
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([packed], pa.binary())], names=["block", "cells"])

    ordered = parts.repartition("shard").sortWithinPartitions("shard", "place", "ids").select("shard", "seen", "ids")
    total = add_up(ordered.mapInArrow(run, "block int, cells binary"), sum(sizes) + 1, scratch)
    shared.unpersist()
    if not total[-1]:
        return model
    found = np.split(total[:-1] / (total[-1] * float(_FIXED)), np.cumsum(sizes)[:-1])
    return Attention(*(x.reshape(getattr(model, k).shape).astype(np.float32) for k, x in zip(model.NAMES, found)))


def special_ids(vocabulary: str) -> tuple[int, int, int]:
    """Number of ids, the id before a text, the id at its end."""
    of = encoder(vocabulary).vocabulary
    return of.size, of.special["<|startoftext|>"], of.special["<|endoftext|>"]


def fit(learn: DataFrame, vocabulary: str, scratch: Scratch) -> LanguageModel:
    """A model from learning rows (_fl_key, _fl_ids), as ``read`` gives them."""
    size, start, end = special_ids(vocabulary)
    found = scratch.save(grams(learn, size, start, end), "grams")
    single = F.col("key") < 2 << 3 * ID_BITS
    total = found.filter(single).agg(F.sum("n")).first()[0] or 0
    kept = found.filter(single | (F.col("n") * KEPT >= total)).toArrow()  # the vocabulary and KEPT pairs and triples at most
    scratch.drop(found)
    counts = Counts.of(size, start, end, kept["key"].to_numpy(), kept["n"].to_numpy())
    ids = counts.own * total
    class_of, vectors = group_ids(neighbours(counts, ids))
    mass = np.bincount(class_of, weights=counts.own, minlength=CLASSES)
    attention = Attention.fresh(vectors + np.random.default_rng(2).normal(0, 0.1, vectors.shape), np.log(np.maximum(mass, 1e-9)))
    shards = 1 << max(0, (total - 1) // SHARD).bit_length()
    for turn in range(ROUNDS):
        attention = train_apart(attention, class_of, pieces(learn, size, start, end, shards).filter(F.col("turn") == turn), scratch)
    return LanguageModel(vocabulary, attention, class_of, counts, np.maximum(counts.of_classes(class_of), 1e-30), start, end)


def read(docs: DataFrame, learns: Column, vocabulary: str, frequent: dict[str, int], scratch: Scratch, text: str, held: list[str]) -> DataFrame:
    """Every row of ``docs`` once, with its ids, its sums over frequent words, whether the model learns from it, and a hash of it.

    Texts are encoded in this pass alone.
    """
    size = special_ids(vocabulary)[0]
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    fields = [docs.schema[c] for c in held]
    passed = [T.StructField("_fl_learns", T.BooleanType()), T.StructField("_fl_key", T.LongType())]
    added = {"_fl_rid": T.LongType(), "n_tokens": T.LongType(), "_fl_known": T.LongType(), "_fl_logs": T.DoubleType(), "_fl_ids": T.BinaryType(), "_fl_tail": T.ArrayType(T.StringType())}
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in [*fields, *passed]), *(T.StructField(k, v) for k, v in added.items())])
    arrow = to_arrow_schema(schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = FrequentWords(shared.value)
        rid = TaskContext.get().partitionId() << 33
        for batch in B.cut(it, text):
            values = [B.lower_ascii(x) for x in B.texts(batch, text)]
            flat, counts = encoder(vocabulary).encode(values)
            n, hits, logs, rare, per = own.read(values)
            tails = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)].astype(np.int32)), pa.array(rare, pa.string()))
            edges = np.r_[0, np.cumsum(counts)]
            ids = pa.array([flat[a:b].astype(stored(size)).tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())
            m = len(values)
            columns = [pa.array(range(rid, rid + m), pa.int64()), pa.array(n + 1), pa.array(hits), pa.array(logs), ids, tails]
            rid += m
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*(batch.column(f.name) for f in [*fields, *passed]), *columns], arrow)], schema=arrow)

    known = [c for c in ("doc_id",) if c in docs.columns]
    source = docs.withColumns({"_fl_learns": F.coalesce(learns, F.lit(False)), "_fl_key": F.xxhash64(*known, text)})
    return scratch.save(source.select(*dict.fromkeys([*held, text, "_fl_learns", "_fl_key"])).mapInArrow(run, schema), "read")


def score(docs: DataFrame, train_on: Column, vocabulary: str, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (by default all columns) with n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    docs = docs.select(*room(docs.columns, "_fl_learns", "_fl_key"))
    keep = room(docs.columns if keep is None else keep, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    learn = docs.filter(train_on)
    counts = scratch.save(word_counts(learn, text), "words")
    n_docs = learn.count()
    totals = counts.agg(F.sum("n"), F.count("*")).first()
    tokens, kinds = (totals[0] or 0) + n_docs, totals[1] + (n_docs > 0)
    unit = math.log10(tokens + 0.5 * (kinds + 1))
    frequent = {r.word: r.n for r in counts.filter(F.col("n") * FREQUENT >= tokens).collect()}  # FREQUENT rows at most
    held = list(dict.fromkeys(keep))
    table = read(docs, train_on, vocabulary, frequent, scratch, text, held)
    shared = spark.sparkContext.broadcast(fit(table.filter("_fl_learns"), vocabulary, scratch))

    passed = [f for f in table.schema if f.name in (*held, "_fl_rid", "n_tokens", "_fl_known", "_fl_logs")]
    schema = T.StructType([*passed, T.StructField("score", T.DoubleType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in B.cut(it, "_fl_ids"):
            found = model.log10_of_ids(*_ids(batch, len(model.class_of)))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in passed), pa.array(found, pa.float64())], names=schema.names)

    scored = table.select(*(f.name for f in passed), "_fl_ids").mapInArrow(run, schema)
    rare = table.select("_fl_rid", F.explode("_fl_tail").alias("word")).join(counts.filter(F.col("n") * FREQUENT < tokens).withColumnRenamed("word", "word_"), F.col("word") == F.col("word_"), "left")
    c = F.coalesce("n", F.lit(0))
    rest = rare.groupBy("_fl_rid").agg(F.count_if(c > 0).alias("_fl_more"), F.sum(F.log10(c + 0.5)).alias("_fl_more_logs")).withColumnRenamed("_fl_rid", "_fl_rid_")
    joined = scored.join(rest, F.col("_fl_rid") == F.col("_fl_rid_"), "left")
    end_known, end_log = int(n_docs > 0), math.log10(n_docs + 0.5)
    return joined.select(
        *held,
        "n_tokens",
        (F.col("_fl_known") + F.coalesce("_fl_more", F.lit(0)) + end_known).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("_fl_logs") + F.coalesce("_fl_more_logs", F.lit(0.0)) + end_log - F.col("n_tokens") * unit).alias("base_score"),
        "score",
    )
