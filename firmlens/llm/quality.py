"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

1. Every word of the corpus adds the sparse random index vectors of its neighbours to the
   context vector of its word class (case, outer symbols and last letters of the word, hashed to
   ``CLASSES`` rows). The table has a fixed size and covers all documents.
2. A document is the mean and the spread of its words' vectors with a few pooled numbers
   (length, share of different words, word length).
3. A two-layer network in numpy learns the label from at most ``TRAIN_ROWS`` labelled rows; a
   temperature fitted on a part kept aside calibrates its probabilities.

Null and empty texts count as texts without words and get the score of such a text. Rows are
scored one by one: repeated rows get equal scores. A text is taken whole; long ones are read in
pieces. With no labelled rows, or labels of one kind only, every score is that kind's smoothed
share. Labels with a null id or value are left out; of several for one id the least counts.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import batches as B
from .bpe import room
from .tables import corpus_table

#: Rows and width of the table of word vectors.
CLASSES, WIDTH = 1 << 15, 32
#: Neighbours to either side, and places of an index vector that aren't zero.
WINDOW, PLACES = 2, 2
#: Pooled features of a text: mean, spread, four numbers.
FEATURES = 2 * WIDTH + 4
#: The most labelled rows that the network learns from.
TRAIN_ROWS = 20_000


@functools.cache
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each class's index vector."""
    rng = np.random.default_rng(20240611)
    return rng.integers(0, WIDTH, (CLASSES, PLACES)), rng.choice([-1, 1], (CLASSES, PLACES))


def word_class(word: str) -> int:
    """A row for a word by its case, outer symbols and last letters."""
    core = word.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    tail, bare = word[len(core) :][:3], core.lstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    kind = "u" if bare.isupper() and len(bare) > 1 else "t" if bare[:1].isupper() else "l" if bare.isalpha() else "d" if bare.isdigit() else "m" if bare else ""
    return zlib.crc32(f"{core[: len(core) - len(bare)][:2]} {kind} {bare[-3:].lower()} {tail}".encode()) % CLASSES


class _Words:
    """Word classes and lengths by number, kept by a Python worker."""

    def __init__(self):
        self.kind, self.letters = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.table = B.WordTable(self._fill)

    def _fill(self, words: list[str], first: int) -> None:
        self.kind = B.put(self.kind, first, np.fromiter(map(word_class, words), np.int64, len(words)))
        self.letters = B.put(self.letters, first, np.fromiter(map(len, words), np.int64, len(words)))

    def read(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For texts, some at a time: the text's place, how many words are new in it, and classes and lengths of all words; long texts come in several parts."""
        for i, text in enumerate(texts):
            seen: set[str] = set()
            for piece in B.pieces(text):
                found = B.words(piece)
                number = self.table.numbers(found)
                before = len(seen)
                seen.update(found)
                yield i, len(seen) - before, self.kind[number], self.letters[number]


@functools.cache
def _words() -> _Words:
    return _Words()


def _add_contexts(texts: list[str], table: np.ndarray) -> None:
    """Table rows of WIDTH context cells and one count for each class."""
    places, signs = index_vectors()
    size = CLASSES * (WIDTH + 1)
    parts = [(i, kind) for i, _, kind, _ in _words().read(texts)]
    if not parts:
        return
    kind = np.concatenate([k for _, k in parts])
    text = np.repeat([i for i, _ in parts], [len(k) for _, k in parts])
    for away in range(1, WINDOW + 1):
        near = text[away:] == text[:-away]
        left, right = kind[:-away][near], kind[away:][near]
        for here, other in ((left, right), (right, left)):
            for k in range(PLACES):
                table[:size] += np.bincount(here * (WIDTH + 1) + places[other, k], weights=signs[other, k], minlength=size)[:size].astype(np.int64)
    table[:size] += np.bincount(kind * (WIDTH + 1) + WIDTH, minlength=size)


def word_vectors(table: np.ndarray) -> np.ndarray:
    """Unit context vectors of the classes, less their mean over the corpus."""
    rows = table.reshape(CLASSES, WIDTH + 1).astype(np.float64)
    context, count = rows[:, :WIDTH], rows[:, WIDTH:]
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    return (context - (context * count).sum(0) / max(count.sum(), 1)).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """A row of features for each text: mean, spread and pooled numbers."""
    n, distinct, letters = (np.zeros(len(texts)) for _ in range(3))
    first, second = np.zeros((len(texts), WIDTH)), np.zeros((len(texts), WIDTH))
    for i, different, kind, length in _words().read(texts):
        got = vectors[kind]
        n[i] += len(kind)
        distinct[i] += different
        letters[i] += length.sum()
        first[i] += got.sum(0, dtype=np.float64)
        second[i] += np.einsum("ij,ij->j", got, got, dtype=np.float64)
    some = np.maximum(n, 1)[:, None]
    mean = first / some
    spread = np.sqrt(np.maximum(second / some - mean**2, 0))
    return np.column_stack([mean, spread, np.log1p(n), distinct / some[:, 0], letters / some[:, 0] / 10, np.linalg.norm(mean, axis=1)]).astype(np.float32)


@dataclass
class Network:
    """Two layers over standardised features, with a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.hidden + self.hidden_bias) @ self.out + self.out_bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, units: int = 24, epochs: int = 40, seed: int = 7) -> Network:
    """Adam on cross-entropy with weight decay; every fifth row is kept for the temperature."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    width = x.shape[1] if x.size else FEATURES
    share = (y.sum() + 0.5) / (len(y) + 1)
    if len(y) < 2 or y.min() == y.max():
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    kept = np.arange(len(y)) % 5 == 4
    if len(y) < 50 or y[kept].min() == y[kept].max():
        kept[:] = False
    train = np.flatnonzero(~kept)
    p = [rng.normal(0, width**-0.5, (width, units)), np.zeros(units), rng.normal(0, units**-0.5, units), np.array(np.log(share / (1 - share)))]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    size = int(np.clip(len(train) // 20, 16, 256))
    for epoch in range(epochs):
        order = rng.permutation(train)
        for a in range(0, len(order), size):
            rows = order[a : a + size]
            h = np.tanh(z[rows] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[rows]) / len(rows)
            back = np.outer(d, p[2]) * (1 - h * h)
            grads = [z[rows].T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], d.sum()]
            step += 1
            rate = 0.01 * (1 - epoch / epochs)
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3]), 1.0)
    aside = kept if kept.any() else ~kept
    logits = net.logits(x[aside])
    options = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, logits / t) - y[aside] * logits / t) for t in options]
    net.temperature = float(options[int(np.argmin(loss))])
    return net


def held_out(doc_id: str, mod: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == remainder, F.lit(False))


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network

    def score(self, df: DataFrame, text: str = "text", score: str = "score", keep: list[str] | None = None) -> DataFrame:
        """``keep`` (by default all columns) with the probability of a good text."""
        keep = room(df.columns if keep is None else keep, score)
        model = df.sparkSession.sparkContext.broadcast(self)  # CLASSES x WIDTH floats: a fixed size
        schema = T.StructType([f for f in df.schema if f.name in keep] + [T.StructField(score, T.DoubleType())])
        kept = [f.name for f in schema][:-1]

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = model.value
            for batch in B.cut(it, text):
                found = own.network.probabilities(pooled(B.texts(batch, text), own.vectors))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.float64())], names=[*kept, score])

        return df.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, y) of at most ``most`` labelled ids for which ``train`` holds, chosen by a hash of the id.

    Of several rows of one id the one with the least hash of its text counts, so there are ``most`` rows at most.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & train).groupBy(doc_id).agg(F.min(label).alias("y"))
    chosen = chosen.orderBy(F.xxhash64(doc_id), doc_id).limit(most)
    # at most ``most`` rows of two numbers: a bounded side
    found = docs.select(doc_id, text).join(F.broadcast(chosen), doc_id)
    return found.groupBy(doc_id).agg(F.min_by(text, F.xxhash64(text)).alias(text), F.min("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, train: Column, corpus: DataFrame | None = None, label: str = "quality", doc_id: str = "doc_id", text: str = "text", most: int = TRAIN_ROWS) -> QualityModel:
    """Word vectors from all of ``corpus`` (by default ``docs``), the network from at most ``most`` labelled rows."""
    vectors = word_vectors(corpus_table(docs if corpus is None else corpus, CLASSES * (WIDTH + 1), _add_contexts, text))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vectors)

    def features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.cut(it, text):
            x = pooled(B.texts(batch, text), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    rows = labelled(docs, labels, label, train, most, doc_id, text).select(F.col(doc_id).cast("long").alias(doc_id), F.col("y").cast("int").alias("y"), text).mapInArrow(features, "doc_id long, y int, x binary").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.x))
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows]).reshape(len(rows), FEATURES)
    return QualityModel(vectors, fit_network(x, np.array([r.y for r in rows], float)))
