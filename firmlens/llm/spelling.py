"""Spelling variants: words of a corpus and the more frequent words that differ from them by one character.

Words are counted over all texts. Which words are near is found by a bidirectional FM-index over
the vocabulary, delimited as ``$word$word$``. One edit leaves the first or the second half of a
word as it is, so there are two schemes: match the first half exactly and extend to the right
across the other with one error, or match the second half and extend to the left. A match is an interval of
suffix ranks in the index of the text and one in that of the reversed text, kept in step: the half
is matched in one direction and extended in the other. What a scheme finds that the other has found too is left out.

The vocabulary is sorted and cut into blocks of bounded size, each with an index of its own: once
by words, so that words with the same first half are neighbours, and once by reversed words, which
turns the second scheme into the first. A word is looked up in its own block and in those neighbours over which its half
extends. Only the blocks' limits come to the driver (two short texts for ``BLOCK`` characters of
vocabulary). Look-ups of a block that many words share are dealt to several tasks, each with the
block's index.

Contracted noise: where the crc32 of ``<id>:<word>`` is divisible by ``noise``, one character of
this occurrence is left out before counting.

Results:

* a null text has no words; a null id counts as the text ``null``; equal rows count as often as they are there;
* a word's form is the near word with most occurrences (ties: the first in code-point order), if it has at least ``ratio`` times as many;
* forms have ever more occurrences, so the way to the root ends; a word without form is its own root;
* a long run of letters is one word, whatever its length; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..core.frames import cumulative
from ..core.scratch import Scratch
from . import batches as B

#: Characters of the words of a block, and look-ups that one task has with it, on average.
BLOCK, LOOKUPS = 1 << 18, 100_000
#: Characters of a block's limits.
_LIMIT = 64
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Words of more bytes than this have their crc32 computed one by one.
_SHORT = 64
_STEP = 32
_FOREIGN = 255


# --- occurrences -------------------------------------------------------------------------------


def _crc_table() -> np.ndarray:
    """What a byte does to a reflected crc32."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


class _Counts:
    """Occurrences of words by their number in a bounded table; full tables are put aside as batches."""

    def __init__(self, noise: int, least: int):
        self.noise, self.least, self.ready = noise, least, []
        self.table, self.crc_step = B.WordTable(self._fill), _crc_table()
        self.words: list[str] = []
        self.crc, self.width, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.shortened: Counter[str] = Counter()

    def _fill(self, new: list[str], first: int) -> None:
        if first == 0:
            self.flush()
        data = [w.encode() for w in new]
        self.words += new
        self.crc = B.put(self.crc, first, np.fromiter(map(zlib.crc32, data), np.uint32, len(new)))
        self.width = B.put(self.width, first, np.fromiter(map(len, data), np.int64, len(new)))
        self.n = B.put(self.n, first, np.zeros(len(new), np.int64))

    def flush(self) -> None:
        k = len(self.words)
        seen = [(w, n) for w, n in zip(self.words, self.n[:k].tolist()) if n and len(w) >= self.least] + [(w, n) for w, n in self.shortened.items() if len(w) >= self.least]
        for at in range(0, len(seen), 20_000):
            part = seen[at : at + 20_000]
            self.ready.append(pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["word", "n"]))
        self.words, self.shortened = [], Counter()
        self.n[:] = 0

    def add(self, ids: list[str], runs: list[list[str]]) -> None:
        """Count the runs of each text; all lower case."""
        found = [w for r in runs for w in r]
        if not found:
            return
        no = self.table.numbers(found)
        doc = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        # crc32 of "<id>:<word>": that of the id, carried over the word's length, xor that of the word
        prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
        width = self.width[no]
        carried = np.zeros((_SHORT + 1, len(ids)), np.uint32)
        for k in range(1, min(_SHORT, int(width.max())) + 1):
            prefix = (prefix >> np.uint32(8)) ^ self.crc_step[prefix & np.uint32(0xFF)]
            carried[k] = prefix
        h = carried[np.minimum(width, _SHORT), doc] ^ self.crc[no]
        for i in np.flatnonzero(width > _SHORT).tolist():
            h[i] = zlib.crc32(f"{ids[doc[i]]}:{found[i]}".encode())
        hit = h % np.uint32(self.noise) == 0
        for i in np.flatnonzero(hit).tolist():
            w, at = found[i], int(h[i]) % len(found[i])
            self.shortened[w[:at] + w[at + 1 :]] += 1
        self.n[: len(self.words)] += np.bincount(no[~hit], minlength=len(self.words))
        if len(self.shortened) > 200_000:
            self.flush_shortened()

    def flush_shortened(self) -> None:
        kept, self.n, words, self.words = self.n, np.zeros(0, np.int64), self.words, []
        self.flush()
        self.n, self.words = kept, words


def occurrences(df: DataFrame, doc_id: str = "doc_id", text: str = "text", noise: int = 199, least: int = 6, most_rare: int = 5) -> DataFrame:
    """(word, n) of the words of at least ``least`` characters and ``most_rare`` occurrences."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(noise, least)
        for batch in B.cut(it, "t"):
            ids, runs = [], []
            for i, t in zip(batch.column(0).to_pylist(), B.texts(batch, "t")):
                for piece in B.pieces(t):
                    ids.append(i)
                    runs.append(_RUN.findall(B.lower_ascii(piece)))
                    if len(piece) >= B.TEXT_BYTES:
                        counts.add(ids, runs)
                        ids, runs = [], []
            counts.add(ids, runs)
            while counts.ready:
                yield counts.ready.pop()
        counts.flush()
        yield from counts.ready

    rows = df.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).alias("i"), F.col(text).alias("t"))
    parts = rows.mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= most_rare)


# --- the index ---------------------------------------------------------------------------------


def suffixes(codes: np.ndarray, sigma: int) -> np.ndarray:
    """Starts of the suffixes in their order, by doubling; nothing comes before 0."""
    n, bits = len(codes), max(1, (sigma - 1).bit_length())
    k = max(1, 62 // bits)
    key, padded = np.zeros(n, np.int64), np.concatenate([codes.astype(np.int64), np.zeros(k, np.int64)])
    for j in range(k):
        key = key << bits | padded[j : j + n]
    while True:
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if rank[order[-1]] == n - 1 or k >= n:
            return order
        following = np.zeros(n, np.int64)
        following[: n - k] = rank[k:] + 1
        key, k = rank * (n + 1) + following, 2 * k


class Ranks:
    """The Burrows-Wheeler transform of a text with counts of characters up to any rank."""

    def __init__(self, codes: np.ndarray, sigma: int):
        self.order = suffixes(codes, sigma)
        n = len(codes)
        self.bwt = np.zeros(-(-(n + 1) // _STEP) * _STEP, np.uint8)
        self.bwt[:n] = codes[self.order - 1]
        self.windows = self.bwt.reshape(-1, _STEP)
        blocks = len(self.windows)
        there = np.bincount(np.arange(n) // _STEP * sigma + self.bwt[:n], minlength=blocks * sigma).reshape(blocks, sigma)
        upto = np.zeros((blocks, sigma + 1), np.int32)  # characters below c before the block
        upto[1:, 1:] = np.cumsum(np.cumsum(there[:-1], axis=0), axis=1)
        self.upto = upto
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=sigma))])  # where suffixes with a first character begin

    def counts(self, c: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters equal to c and below c in the first ``at`` places."""
        block, inside = at // _STEP, np.arange(_STEP)[None, :] < (at % _STEP)[:, None]
        window = self.windows[block]
        below = self.upto[block, c] + ((window < c[:, None]) & inside).sum(axis=1)
        equal = self.upto[block, c + 1] - self.upto[block, c] + ((window == c[:, None]) & inside).sum(axis=1)
        return equal, below


class BiIndex:
    """A bidirectional FM-index of distinct words."""

    def __init__(self, words: list[str]):
        raw = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(raw)
        codes = np.searchsorted(self.alphabet, raw).astype(np.uint8)
        self.sigma, self.n = len(self.alphabet), len(codes)
        if self.sigma >= _FOREIGN:
            raise ValueError("an index has at most 254 different characters")
        self.forward, self.reverse = Ranks(codes, self.sigma), Ranks(codes[::-1].copy(), self.sigma)
        self.number = np.cumsum(codes == 0) - 2  # of the word that a delimiter ends

    def code(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A matrix of codes, and lengths; characters that the index doesn't have are _FOREIGN."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, raw), self.sigma - 1)
        out = np.full((len(words), int(length.max(initial=0)) + 1), _FOREIGN, np.int64)
        out[np.arange(out.shape[1])[None, :] < length[:, None]] = np.where(self.alphabet[at] == raw, at, _FOREIGN)
        return out, length

    def left(self, lo: np.ndarray, lo_r: np.ndarray, size: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both intervals of c and what stood before; 0 wide if there is no such place."""
        known = np.minimum(c, self.sigma - 1)
        e0, b0 = self.forward.counts(known, lo)
        e1, b1 = self.forward.counts(known, lo + size)
        return self.forward.first[known] + e0, lo_r + b1 - b0, np.where(c == _FOREIGN, 0, e1 - e0)

    def right(self, lo_r: np.ndarray, size: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval, in the reversed text's ranks, of what stood before and c."""
        known = np.minimum(c, self.sigma - 1)
        e0, _ = self.reverse.counts(known, lo_r)
        e1, _ = self.reverse.counts(known, lo_r + size)
        return self.reverse.first[known] + e0, np.where(c == _FOREIGN, 0, e1 - e0)

    def children(self, lo_r: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(state, c, interval) of every character that follows within a state's interval, delimiters left out."""
        wide = size > self.sigma
        slim = np.flatnonzero(~wide)
        state = np.repeat(slim, size[slim])
        pair = np.unique(state * 256 + self.reverse.bwt[B.spans(lo_r[slim], size[slim])])
        row = np.concatenate([pair >> 8, np.repeat(np.flatnonzero(wide), self.sigma)])
        c = np.concatenate([pair & 255, np.tile(np.arange(self.sigma), int(wide.sum()))])
        row, c = row[c > 0], c[c > 0]
        lo, n = self.right(lo_r[row], size[row], c)
        there = n > 0
        return row[there], c[there], lo[there], n[there]

    def near(self, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, indexed word) of all words that begin with the query's first ``exact`` characters and differ from it by one edit thereafter."""
        code, length = self.code(words)
        q = np.arange(len(words))
        lo, lo_r, size = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), self.n)
        for t in range(int(exact.max(initial=-1)) + 1):  # to the left, the delimiter last
            on = np.flatnonzero((t <= exact[q]) & (size > 0))
            at = exact[q[on]] - 1 - t
            lo[on], lo_r[on], size[on] = self.left(lo[on], lo_r[on], size[on], np.where(at >= 0, code[q[on], np.maximum(at, 0)], 0))
        alive = size > 0
        q, lo, n = q[alive], lo_r[alive], size[alive]
        none = np.zeros(0, np.int64)
        eq, elo, en = none, none, none  # with an error behind them
        found_q, found_w = [], []
        j = 0
        while len(q) or len(eq):
            end = exact[q] + j == length[q]
            want = code[q, exact[q] + j]  # _FOREIGN past the end
            row, c, clo, cn = self.children(lo, n)
            same = c == want[row]
            other = ~same & ~end[row]
            # one more character in the other word: this place is still to come
            eq, elo, en = np.concatenate([eq, q[row]]), np.concatenate([elo, clo]), np.concatenate([en, cn])
            done = exact[eq] + j == length[eq]
            lo2, n2 = self.right(elo, en, np.where(done, 0, code[eq, exact[eq] + j]))
            hit, on = done & (n2 > 0), ~done & (n2 > 0)
            found_q.append(eq[hit])
            found_w.append(self.number[self.n - 1 - self.reverse.order[lo2[hit]]])
            # another character in this place, or none
            eq = np.concatenate([eq[on], q[row[other]], q[~end]])
            elo = np.concatenate([lo2[on], clo[other], lo[~end]])
            en = np.concatenate([n2[on], cn[other], n[~end]])
            q, lo, n = q[row[same]], clo[same], cn[same]
            j += 1
        if not found_q:
            return none, none
        pair = np.unique(np.concatenate(found_q) * len(self.number) + np.concatenate(found_w))
        return pair // len(self.number), pair % len(self.number)


def _look_up(side: int, words: list[str], n: np.ndarray, asked: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, list[str]]]:
    """(queries, near words, n of the best, the best) of the queries with a near word, by scheme ``side``; all texts as their side has them."""
    index = BiIndex(words)
    plain = words if side == 0 else [w[::-1] for w in words]
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=plain.__getitem__)] = np.arange(len(words))
    asked = sorted(asked, key=len)
    at = 0
    while at < len(asked):
        most = max(1, min(4096, (1 << 20) // len(asked[min(at + 4095, len(asked) - 1)])))
        part = asked[at : at + most]
        at += most
        length = np.fromiter(map(len, part), np.int64, len(part))
        exact = length // 2 if side == 0 else length - length // 2
        q, w = index.near(part, exact)
        if side == 1:  # words with the same first half are found by the other scheme
            fresh = np.fromiter((not words[b].endswith(part[a][exact[a] :]) for a, b in zip(q.tolist(), w.tolist())), bool, len(q))
            q, w = q[fresh], w[fresh]
        if not len(q):
            continue
        order = np.lexsort((place[w], -n[w], q))
        q, w = q[order], w[order]
        start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        yield [part[i] for i in q[start].tolist()], np.diff(np.append(start, len(q))), n[w[start]], [plain[i] for i in w[start].tolist()]


def near_words(vocabulary: DataFrame, scratch: Scratch, block: int = BLOCK, lookups: int = LOOKUPS) -> DataFrame:
    """(word, n_near, best_n, best) of the words of ``vocabulary`` (word, n) with at least one near word."""
    sides = vocabulary.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("key")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("key")))).alias("s"), "n").select("s.*", "n").withColumn("chars", F.char_length("key").cast("long"))
    upto = cumulative(sides, ["side"], [F.asc("key")], "chars", "upto")
    blocked = scratch.save(upto.select("side", F.expr(f"(upto - chars) div {block}").alias("block"), "key", "n"), "blocks")
    short = lambda c: F.substring(c, 1, _LIMIT)
    limits = blocked.groupBy("side", "block").agg(short(F.min("key")).alias("low"), short(F.max("key")).alias("high")).orderBy("side", "block").collect()
    tables = [[[r[c] for r in limits if r["side"] == s] for c in ("block", "low", "high")] for s in (0, 1)]

    def route(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            side, key, n = (batch.column(c).to_pylist() for c in ("side", "key", "n"))
            out = []
            for s, k, m in zip(side, key, n):
                half = k[: len(k) // 2 if s == 0 else len(k) - len(k) // 2][:_LIMIT]
                blocks, low, high = tables[s]
                out += [(s, blocks[b], k, m) for b in range(bisect_left(high, half), bisect_right(low, half + "\U0010ffff"))]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.string(), pa.int64()))], names=["side", "block", "key", "n"])

    asked = scratch.save(blocked.mapInArrow(route, "side int, block long, key string, n long"), "asked")
    tasks = asked.groupBy("side", "block").agg(F.ceil(F.count("*") / lookups).cast("int").alias("tasks")).withColumnsRenamed({"side": "_s", "block": "_b"})
    with_tasks = lambda df: df.join(tasks, (F.col("side") == F.col("_s")) & (F.col("block") == F.col("_b")))
    queries = with_tasks(asked).select("side", "block", F.pmod(F.xxhash64("key"), F.col("tasks")).cast("int").alias("task"), "key", "n", F.lit(True).alias("asks"))
    indexed = with_tasks(blocked).select("side", "block", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "key", "n", F.lit(False).alias("asks"))

    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def find(table: pa.Table) -> pa.Table:
        side, asks = table["side"][0].as_py(), table["asks"]
        held, own = table.filter(pc.invert(asks)), table.filter(asks)
        out = []
        if held.num_rows and own.num_rows:
            for words, near, best_n, best in _look_up(side, held["key"].to_pylist(), held["n"].to_numpy(), own["key"].to_pylist()):
                out.append(pa.table([pa.array(words if side == 0 else [w[::-1] for w in words]), near, best_n, pa.array(best)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    parts = indexed.union(queries).groupBy("side", "block", "task").applyInArrow(find, "word string, n_near long, best_n long, best string")
    met = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b"))
    return met.select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) from (word, form): the end of each way along the forms, found by doubling."""
    now = scratch.save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        after = scratch.save(now.join(further, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        scratch.drop(now)
        now = after
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def variants(df: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", noise: int = 199, least: int = 6, most_rare: int = 5, ratio: int = 5, block: int = BLOCK, lookups: int = LOOKUPS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = scratch.save(occurrences(df, doc_id, text, noise, least, most_rare), "words")
    near = near_words(words, scratch, block, lookups).withColumnRenamed("word", "_w")
    takes = F.col("best_n") >= ratio * F.col("n")
    joined = words.join(near, F.col("word") == F.col("_w"), "left")
    found = scratch.save(joined.select("word", F.when(takes, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, F.col("best_n")).alias("form_n")), "forms")
    ends = roots(found.filter("form is not null").select("word", "form"), scratch).withColumnRenamed("word", "_w")
    return found.join(ends, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
