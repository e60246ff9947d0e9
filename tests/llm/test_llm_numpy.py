"""Numpy parts of the training-data operators against brute force."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from firmlens.llm import attention as A, batches as B, bpe, lm, media, quality, simhash, tables, tokenfiles, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoding_equals_the_library(library):
    rnd, encoder = random.Random(3), bpe.Encoder(PATH)
    letters = "abcdefghijklmnop'sdXZÉé é ñßΣς Ĳİŀ0123 \t\n\x0b\x1c\x85\xa0　<|endoftext|>.,!!_́中日🙂"
    texts = ["", " ", "<|endoftext|>x<|startoftext|>", "aaaa aaaaaaa", "I'LL don't"] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(600)]
    flat, counts = encoder.encode(texts)
    edges = np.r_[0, np.cumsum(counts)]
    for text, a, b in zip(texts, edges[:-1], edges[1:]):
        want = library.encode(text, add_special_tokens=False).ids
        assert flat[a:b].tolist() == want, text
        assert str(encoder.decode(flat[a:b]), "utf-8") == library.decode(want, skip_special_tokens=False)
    other, n = tokenfiles.LibraryEncoder(PATH).encode(texts)
    assert other.tolist() == flat.tolist() and n.tolist() == counts.tolist()


def test_long_texts_and_full_tables(library, monkeypatch):
    text = " ".join(f"word{i % 977} x{i}" for i in range(3000))
    encoder = bpe.Encoder(PATH)
    encoder.table.most = 100
    monkeypatch.setattr(B, "TEXT_BYTES", 500)
    assert encoder.encode([text, text[:50]])[0].tolist() == library.encode(text, add_special_tokens=False).ids + library.encode(text[:50], add_special_tokens=False).ids
    assert "".join(B.pieces(text, 500)) == text and len(list(B.pieces(text, 500))) > 10


def brute_fingerprint(text: str) -> int:
    words = B._WORD.findall(B.lower_ascii(text))
    found = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in found]
    value = sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64)) if hashes else 0
    return value - (1 << 64) if value >> 63 else value


def test_simhash_fingerprints(monkeypatch):
    texts = ["", " \n", "a", "a B", "One two  three four", "É é x Y z   w"] + [" ".join(f"w{i * k % 17}" for i in range(60)) for k in range(5)]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]
    pieces = B.pieces
    monkeypatch.setattr(B, "pieces", lambda t: pieces(t, 7))
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_anchors_cover_all_close_pairs():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**63), 2**63 - 1, 400)
    low = x & ((1 << simhash.LENGTH) - 1)
    assert max(int(v).bit_count() for v in low ^ simhash.homes(low)) <= simhash.RADIUS
    assert (simhash.syndromes(simhash.homes(low)) == 0).all()
    for bits in (0, 1, 2):
        y = x.copy()
        for row in range(len(y)):
            for k in rng.choice(64, bits, replace=False):
                y[row] ^= np.int64(1) << np.int64(k)
        row, anchor, _ = simhash.anchors(x, 2)
        sent = {}
        for r, a in zip(row, anchor):
            sent.setdefault(r, set()).add(a)
        row, anchor, home = simhash.anchors(y, 2)
        assert home.sum() == len(y)
        assert all(a in sent[r] for r, a, h in zip(row, anchor, home) if h)


def test_media_round_trip_and_tone():
    for text in ("", "a", "é" * 96, "x" * 1000):
        data = media.payload(text)
        assert len(data) % media.PAD == 0 and len(data) >= media.PAD and data.rstrip(b" ") == text.encode().rstrip(b" ")
        assert media.load(media.store(data)) == data
    t = np.arange(8000)
    tone = (128 + 60 * np.sin(2 * np.pi * 40 * t / media.FRAME) * (t // 1000 % 2)).astype(np.uint8)
    found = media.peaks(tone)
    assert 40 in found[:, 1]
    a, b = media.peaks(tone), media.peaks(tone.copy())
    assert (a == b).all()
    assert len(media.pairs(media.peaks(np.full(3000, 32, np.uint8)))[0]) == 0


def feature(text):
    time, code = media.pairs(media.peaks(np.frombuffer(media.payload(text), np.uint8)))
    return time.tolist(), code.tolist()


def test_media_fingerprint_covers_the_whole_payload():
    short = ["One short text of a few words.", "Quite another one: 1234567890!", "zebra"]
    assert all(feature(t)[0] for t in short) and len({str(feature(t)) for t in short}) == len(short)
    assert feature("") == ([], [])
    rng = np.random.default_rng(8)
    text = "".join(map(chr, rng.integers(97, 123, 192 * 5)))
    ends = [text, text[:-128] + "~ " * 64, text[:-128] + "~~~   " * 21 + "~~", text[:-128] + "zzzz    " * 16]
    assert len({str(feature(t)) for t in ends}) == len(ends)
    # a change at any place reaches the spectrum, the first and the last byte's too
    window = np.hanning(media.FRAME)
    edge = (media.FRAME - media.HOP) // 2
    assert window[edge : edge + media.HOP].min() > 0.1


def test_gradients():
    rng = np.random.default_rng(0)
    m = A.Attention.fresh(rng.normal(0, 1, (40, A.WIDTH)), np.zeros(A.CLASSES))
    for k in m.NAMES:
        setattr(m, k, getattr(m, k).astype(np.float64))
    ids, targets = rng.integers(0, 40, (3, A.SPAN)), rng.integers(0, A.CLASSES, (3, A.STRIDE))
    outside, inside = np.arange(A.SPAN) < np.array([16, 0, 5])[:, None], np.arange(A.STRIDE) < np.array([16, 7, 16])[:, None]
    _, g = m.loss_and_gradients(ids, targets, outside, inside)
    for k in m.NAMES:
        p = getattr(m, k)
        at = (int(ids[1, 20]), 3) if k == "embed" else tuple(int(rng.integers(0, s)) for s in p.shape)
        kept, e = p[at], 1e-5
        p[at] = kept + e
        up, _ = m.loss_and_gradients(ids, targets, outside, inside)
        p[at] = kept - e
        down, _ = m.loss_and_gradients(ids, targets, outside, inside)
        p[at] = kept
        assert abs((up - down) / (2 * e) - g[k][at]) < 1e-6


def test_windows_score_each_token_once_and_causally():
    lengths = np.array([1, 16, 17, 50])
    first, queries, before = A.windows(lengths)
    assert queries.sum() == lengths.sum() and before.max() <= A.SPAN - A.STRIDE
    assert sorted(i for f, q in zip(first, queries) for i in range(f, f + q)) == list(range(lengths.sum()))
    rng = np.random.default_rng(0)
    m = A.Attention.fresh(rng.normal(0, 1, (40, A.WIDTH)), np.zeros(A.CLASSES))
    ids, targets = rng.integers(0, 40, 50), rng.integers(0, A.CLASSES, 50)
    a = m.class_logs(ids, targets, np.array([50]), m.tables())
    ids[30:] = 0
    b = m.class_logs(ids, targets, np.array([50]), m.tables())
    assert np.allclose(a[:30], b[:30]) and not np.allclose(a[30:], b[30:])


def test_scores_never_overflow():
    m = A.Attention.fresh(np.full((40, A.WIDTH), 300.0), np.zeros(A.CLASSES))
    rng = np.random.default_rng(0)
    logs = m.class_logs(rng.integers(0, 40, 50), rng.integers(0, A.CLASSES, 50), np.array([50]), m.tables())
    assert np.isfinite(logs).all() and (logs <= 0).all()


def test_word_table_bounds():
    filled = []
    t = B.WordTable(lambda words, first: filled.append((len(words), first)), most=10, most_chars=100)
    assert t.numbers(["a", "b", "a"]).tolist() in ([0, 1, 0], [1, 0, 1])
    t.numbers(["x" * 60, "y" * 60])  # more characters than the bound: it starts again
    assert filled[-1] == (2, 0) and set(t.number) == {"x" * 60, "y" * 60}
    t.numbers([str(i) for i in range(9)])
    assert filled[-1] == (9, 0)


def test_deobfuscation():
    table = np.zeros(toxicity.SYMBOLS**3, np.int64)
    toxicity._add_letters(["the loser was an idiot and a moron with trash and a clown so stupid " * 50], table)
    costs = toxicity.letter_costs(table)
    assert np.allclose(np.exp(-costs).sum(2), 1, atol=1e-3)
    for word, want in (("l0ser", "loser"), ("i.d.i.o.t", "idiot"), ("looooser", "loser"), ("$tupid", "stupid"), ("tr@sh", "trash"), ("m-o-r-o-n", "moron")):
        assert want in toxicity.readings(word, costs)
    assert toxicity.readings("Plain,", costs) == ["plain"]
    assert toxicity.spaced("so x i d i o t y was".split()) == ["so x i d i o t y"] and toxicity.spaced(["a", "b"]) == []
    assert toxicity.readings("a n i d i o t", costs) == ["an", "idiot"] and toxicity.readings("m 0 r o n", costs) == ["moron"]
    run: list[str] = []
    assert toxicity.spaced(["the", "i", "d", "i"], run, last=False) == [] and toxicity.spaced(["o", "t", "then"], run) == ["i d i o t"]
    assert len(toxicity.restore("a." * 5000 + "b", costs)) >= 1


def test_network_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (2000, 6)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    p = quality.fit_network(x, y).probabilities(x)
    assert ((p > 0.5) == y).mean() > 0.9 and abs(p.mean() - y.mean()) < 0.05
    assert np.allclose(quality.fit_network(x, np.ones(2000)).probabilities(x), 2000.5 / 2001)
    assert quality.fit_network(np.zeros((0, 0)), np.zeros(0)).probabilities(np.zeros((1, quality.FEATURES)))[0] == 0.5


def test_packed_cells():
    for most in (0, 100, 1000, 10**6, 10**12):
        cells = np.array([0, -most, most])
        assert (tables._unpacked(tables._packed(cells)) == cells).all()


def test_lm_counts_keys_in_bounded_memory():
    """A task that counts ids, pairs and triples of a batch of 4 million ids holds little of it at a time, and counts all of them."""
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 300, 20_000).astype("<u2") for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in texts], pa.binary())], names=["_fl_ids"])
    found = Counter()
    tracemalloc.start()
    for part in lm.counted_keys(iter([batch]), 1000, 998, 999):
        at = np.flatnonzero(part["key"].to_numpy() < 2 << 3 * lm.ID_BITS)
        found.update(dict(zip((part["key"].to_numpy()[at] & lm._ID).tolist(), part["n"].to_numpy()[at].tolist())))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == Counter(np.concatenate(texts).tolist()) + Counter({999: len(texts)})
    assert peak < 80e6, peak
