"""Toxicity by noisy-channel deobfuscation.

1. A trigram model of letters is counted over all documents (a table of fixed size).
2. A word that looks disguised (digits or symbols for letters, separators between letters, letters
   repeated three times or more), or a run of short words with three single letters in a row, is a
   lattice of characters: each place may be the letter itself, a letter that its symbol stands for, a
   word end, or nothing (a space, a separator, a repeated letter). Viterbi decoding finds the
   restoration of least cost under the letter model plus the channel's costs; every word in it is read.
3. Features of restored words (the word and its beginnings) get log odds from labelled rows, at
   most ``TRAIN_ROWS`` of them; a logistic curve over a document's strongest features, fitted on
   labelled rows that chose no features, gives the score.

Null and empty texts have no features and get the score of such a text. Long texts are read in
pieces. Every row is scored by itself. With labels of one kind only, every score is that kind's
smoothed share. Labels with a null id or value are left out; of several for one id the least
counts.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import batches as B
from .bpe import room
from .quality import labelled
from .tables import corpus_table

TRAIN_ROWS = 20_000
#: Features kept at most, the strongest first.
FEATURES = 20_000
#: The letters of the model; every other character is its last symbol, a space its first.
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåçèéêëìíîïñòóôöõùúûüýßæœø"
SYMBOLS = 64
#: Letters that a character may stand for. Fixed values.
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = ".-_*~'`^,:;"
#: Costs (natural logarithm) of reading a symbol as a letter, dropping a separator, dropping a repeated letter.
READ, DROP, REPEAT = 1.0, 0.3, 0.4
#: Restorations kept at each place, by cost, for each pair of last letters.
_CODE = np.full(0x2100, SYMBOLS - 1, np.int64)
_CODE[[ord(c) for c in LETTERS]] = np.arange(1, len(LETTERS) + 1)
_CODE[[ord(c) for c in " \t\n\x0b\f\r"]] = 0
_STANDS = "".join(map(re.escape, STANDS_FOR))
#: A word is worth decoding if a symbol or separator stands between or next to letters, or a letter three times in a row.
_DISGUISED = re.compile(rf"[^\W\d_][{_STANDS}{re.escape(SEPARATORS)}]+[^\W\d_]|^[{_STANDS}]{{1,2}}[^\W\d_]{{2}}|[^\W\d_]{{2}}[{_STANDS}]{{1,2}}$|([^\W\d_])\1\1")
_EDGE = ".,;:?!\"'()[]{}<>*~`^_-…«»“”„&%#"


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    return _CODE[np.minimum(points, len(_CODE) - 1)]


def _add_letters(texts: list[str], table: np.ndarray) -> None:
    """Counts of letter trigrams; texts are apart by two spaces."""
    for text in texts:
        for piece in B.pieces(text):
            c = np.r_[0, 0, _codes(piece), 0]
            table[: SYMBOLS**3] += np.bincount(c[:-2] * SYMBOLS**2 + c[1:-1] * SYMBOLS + c[2:], minlength=SYMBOLS**3)


def letter_costs(table: np.ndarray) -> np.ndarray:
    """-log P(letter | two letters before), smoothed by shorter contexts."""
    n3 = table.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
    n2, n1 = n3.sum(0), n3.sum((0, 1))
    p1 = (n1 + 0.5) / (n1.sum() + 0.5 * SYMBOLS)
    p2 = (n2 + 20 * p1) / (n2.sum(1, keepdims=True) + 20)
    p3 = (n3 + 20 * p2[None]) / (n3.sum(2, keepdims=True) + 20)
    return -np.log(p3).astype(np.float32)


def restore(run: str, costs: np.ndarray) -> str:
    """The least-cost reading of a disguised word or of a run of short ones, in lower case; word ends are spaces.

    A state is the last two letters and holds its cost and a chain of what was read, so the work is in
    proportion to the length.
    """
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    before = ""
    for c in run.lower():
        options = [(c, 0.0)] if c.isalpha() or c == " " else [(x, READ) for x in STANDS_FOR.get(c, "")]
        if not c.isalpha() and not options and c not in SEPARATORS:
            options = [(c, 0.0)]
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}

        def offer(state: tuple[int, int], cost: float, read: tuple | None) -> None:
            if state not in after or cost < after[state][0]:
                after[state] = (cost, read)

        for (a, b), (cost, read) in states.items():
            for letter, more in options:
                k = int(_CODE[min(ord(letter), len(_CODE) - 1)])
                offer((b, k), cost + more + float(costs[a, b, k]), (read, letter))
            if c in SEPARATORS or c == " " or not options:
                offer((a, b), cost + DROP, read)
            if read and (c == before or c in STANDS_FOR) and read[1] in (c, *STANDS_FOR.get(c, "")):
                offer((a, b), cost + REPEAT, read)
        states, before = after, c
    # a word ends before a space
    read = min(((cost + float(costs[a, b, 0]), (a, b), read) for (a, b), (cost, read) in states.items()), key=lambda x: x[:2])[2]
    out = []
    while read:
        read, letter = read
        out.append(letter)
    return "".join(reversed(out))


def readings(word: str, costs: np.ndarray) -> list[str]:
    """The word without outer symbols, and its restoration where it looks disguised; of a run of words those that it spells."""
    lower = word.lower()
    if " " in lower:
        return [w for w in restore(lower, costs).split(" ") if w]
    core = lower.strip(_EDGE)
    found = [core] if core else []
    if _DISGUISED.search(lower) and any(c.isalpha() for c in core):
        found.append(restore(core if not _DISGUISED.search(lower[-3:]) else lower.lstrip(_EDGE), costs))
    return found


def features(reading: str) -> list[str]:
    """The word and its beginnings of four to seven letters."""
    return ["=" + reading, *(reading[:n] for n in range(4, 8) if len(reading) >= n)]


def spaced(found: list[str], run: list[str] | None = None, last: bool = True) -> list[str]:
    """Runs of words of one or two characters with three single ones in a row, each as one string with its spaces.

    ``run`` holds an unfinished run of the words before and takes that of these, unless they are the ``last``.
    """
    run = [] if run is None else run
    if not run and not any(len(w) == 1 for w in found):
        return []
    out = []

    def close() -> None:
        if any(len(a) == len(b) == len(c) == 1 for a, b, c in zip(run, run[1:], run[2:])):
            out.append(" ".join(run))
        run.clear()

    for w in found:
        if len(w) <= 2:
            run.append(w)
        else:
            close()
    if last:
        close()
    return out


def _parts(text: str) -> Iterator[tuple[list[str], bool]]:
    """The words of a text piece by piece, and whether they are its last."""
    at = 0
    for piece in B.pieces(text):
        at += len(piece)
        yield B.words(piece), at >= len(text)


class _Readings:
    """Readings of words, kept by a Python worker."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs
        self.held: dict[str, list[str]] = {}
        self.chars = 0

    def of(self, word: str) -> list[str]:
        got = self.held.get(word)
        if got is None:
            self.chars += len(word)
            if len(self.held) > 200_000 or self.chars > 8_000_000:
                self.held, self.chars = {}, len(word)
            got = self.held[word] = list(dict.fromkeys(f for r in readings(word, self.costs) for f in features(r)))
        return got


@dataclass
class ToxicityModel:
    """Letter costs, feature weights and the curve from a document's evidence to a probability."""

    costs: np.ndarray
    weights: dict[str, float]
    curve: np.ndarray  # of strongest, sum of the next, log of words, constant
    _own: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {"costs": self.costs, "weights": self.weights, "curve": self.curve, "_own": None}

    def weight(self, word: str) -> float:
        """The weight of a word's strongest feature."""
        return max((self.weights.get(f, 0.0) for r in readings(word, self.costs) for f in features(r)), default=0.0)

    def _fill(self, words: list[str], first: int) -> None:
        self._own[1] = B.put(self._own[1], first, np.array([self.weight(w) for w in words]))

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Strongest weight, the sum of the next four, and log of the number of words, for each text."""
        if self._own is None:
            self._own = [B.WordTable(self._fill), np.zeros(1024)]
        out = np.zeros((len(texts), 3))
        for i, text in enumerate(texts):
            met: dict[str, float] = {}  # words that weigh anything; each counts once, wherever pieces end
            n, run = 0, []
            for found, last in _parts(text):
                words = found + spaced(found, run, last)
                number = self._own[0].numbers(words)
                weights = self._own[1][number]
                met.update((words[k], weights[k]) for k in np.flatnonzero(weights > 0).tolist())
                n += len(found)
            top = np.sort(np.fromiter(met.values(), float, len(met)))[::-1][:5]
            out[i] = top[:1].sum(), top[1:].sum(), math.log1p(n)
        return out

    def probabilities(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.column_stack([evidence, np.ones(len(evidence))]) @ self.curve, -40, 40)))

    def score(self, df: DataFrame, text: str = "text", score: str = "score", keep: list[str] | None = None) -> DataFrame:
        """``keep`` (by default all columns) with the probability that the text is toxic."""
        keep = room(df.columns if keep is None else keep, score)
        model = df.sparkSession.sparkContext.broadcast(self)  # SYMBOLS^3 costs and FEATURES weights at most
        schema = T.StructType([f for f in df.schema if f.name in keep] + [T.StructField(score, T.DoubleType())])
        kept = [f.name for f in schema][:-1]

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = model.value
            for batch in B.cut(it, text):
                found = own.probabilities(own.evidence(B.texts(batch, text)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.float64())], names=[*kept, score])

        return df.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


def fit_curve(evidence: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge; a rising text length never adds evidence."""
    x = np.column_stack([evidence, np.ones(len(evidence))])
    share = (y.sum() + 0.5) / (len(y) + 1)
    w = np.array([0, 0, 0, math.log(share / (1 - share))])
    if not len(y) or y.min() == y.max():
        return w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.array([0.05, 0.05, 0.5, 1e-6])
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", most: int = TRAIN_ROWS) -> ToxicityModel:
    """Letter model from all of ``docs``, weights and curve from at most ``most`` labelled rows."""
    spark = docs.sparkSession
    costs = letter_costs(corpus_table(docs, SYMBOLS**3, _add_letters, text))
    rows = labelled(docs, labels, label, train, most, doc_id, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"), text)
    chooses = (F.pmod(F.xxhash64("doc_id", F.lit("features")), F.lit(10)) < 7).alias("chooses")
    shared = spark.sparkContext.broadcast(costs)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Readings(shared.value)
        for batch in B.cut(it, text):
            toxic: Counter[str] = Counter()
            clean: Counter[str] = Counter()
            for value, y in zip(B.texts(batch, text), batch.column("y").to_pylist()):
                found = B.words(value)
                (toxic if y else clean).update({f for w in {*found, *spaced(found)} for f in own.of(w)})
            names = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[k] for k in names], pa.int64()), pa.array([clean[k] for k in names], pa.int64())], names=["feature", "toxic", "clean"])

    chosen = rows.withColumn("chooses", chooses).filter("chooses").drop("chooses")
    totals = chosen.agg(F.count(F.when(F.col("y") == 1, 1)), F.count(F.when(F.col("y") != 1, 1))).first()
    with_label, without = int(totals[0]), int(totals[1])
    share = (with_label + 0.5) / (with_label + without + 1)
    counts = chosen.mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    weight = F.log((F.col("t") + 0.5) / (with_label + 1)) - F.log((F.col("c") + 0.5) / (without + 1))
    # a feature needs more toxic documents than chance gives to one of many features
    sure = F.col("t") * (-math.log(share)) - F.col("c") * 3 >= 9
    kept = counts.filter(sure).select("feature", weight.alias("w")).filter("w > 1").orderBy(F.desc("w"), "feature").limit(FEATURES).collect()
    model = ToxicityModel(costs, {r.feature: float(r.w) for r in kept}, np.zeros(4))
    shared_model = spark.sparkContext.broadcast(model)

    def weigh(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.cut(it, text):
            x = shared_model.value.evidence(B.texts(batch, text))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *(pa.array(x[:, k], pa.float64()) for k in range(3))], names=["doc_id", "y", "a", "b", "n"])

    found = rows.withColumn("chooses", chooses).filter("not chooses").drop("chooses").mapInArrow(weigh, "doc_id long, y int, a double, b double, n double").collect()
    found.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.a, r.b, r.n))
    model.curve = fit_curve(np.array([(r.a, r.b, r.n) for r in found]).reshape(-1, 3), np.array([r.y for r in found], float))
    return model
