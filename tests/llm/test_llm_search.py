"""Sharding, spelling variants and hard negatives against brute force on small tables."""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmlens.core.scratch import Scratch
from firmlens.llm import negatives, queries, shards, spelling
from oracle import assert_same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- sharding ----------------------------------------------------------------------------------


def by_hand(rows, dims, leaves, whole, first=0):
    """Shard of each row (size, dims, h) by the definition: sort, sum up, cut at the nearest row."""
    if leaves == 1 or not rows:
        return {r: first for r in rows}
    spread = [(max(r[1][k] for r in rows) - min(r[1][k] for r in rows)) / whole[k] if whole[k] else 0.0 for k in range(dims)]
    d = max(range(dims), key=lambda k: (spread[k], -k))
    ordered = sorted(rows, key=lambda r: (r[1][d], r[2]))
    target, below, cut = sum(r[0] for r in rows) * (leaves // 2) / leaves, 0, 0
    for k, r in enumerate(ordered):
        if below + r[0] >= target:
            cut = k + 1 if below + r[0] - target <= target - below else k
            break
        below += r[0]
    left = leaves // 2
    return by_hand(ordered[:cut], dims, left, whole, first) | by_hand(ordered[cut:], dims, leaves - left, whole, first + left)


@pytest.mark.parametrize("leaves", [1, 5, 16, 37])
def test_tree_is_the_weighted_median_tree(spark, leaves):
    rng = np.random.default_rng(leaves)
    rows = [(int(s), (float(a), float(b), 3.0), float(h)) for s, a, b, h in zip(rng.integers(1, 500, 400), rng.choice([1, 1, 1, 2, 7], 400), rng.normal(0, 1e6, 400).round(), rng.random(400))]
    df = spark.createDataFrame([(s, *d, h) for s, d, h in rows], "_size long, _d0 double, _d1 double, _d2 double, _h double")
    placed, shard = shards._tree(df, 3, leaves, Scratch(spark, "t"))
    got = {(r._size, (r._d0, r._d1, r._d2), r._h): r.s for r in placed.withColumn("s", shard).collect()}
    whole = [max(r[1][k] for r in rows) - min(r[1][k] for r in rows) for k in range(3)]
    assert got == by_hand(rows, 3, leaves, whole)


def sound(got, n, largest, total, leaves):
    assert len(got) == n
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(leaves))
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    for k in range(leaves):
        assert abs(sum(r["size"] for r in by[k]) - total / leaves) <= 2 * largest


def test_op11(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = queries.op11_sharding(spark, sf).collect()
    want = {r.doc_id: (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == want
    sizes = [s for s, _ in want.values()]
    sound(got, len(docs), max(sizes), sum(sizes), 16)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_sharding_edges(spark):
    rows = [(None, None, None, "x")] * 300 + [(7, "aa", "s", "x")] * 200 + [(k, "l", None, "y" * (k % 9)) for k in range(100)] + [(None, "l", "t", "z" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string")
    dims = {"source": shards.order_of("source"), "id": shards.number("doc_id")}
    runs = []
    for parts in (1, 5):
        out = shards.kd_shards(df.repartition(parts), Scratch(spark, "t"), dims, shards=6)
        assert out.columns == ["doc_id", "source", "size", "shard", "slot"]
        runs.append(sorted(map(str, out.collect())))
        sound([r.asDict() for r in out.collect()], len(rows), 3, sum(len(r[1] or "") + 1 for r in rows), 6)
    assert runs[0] == runs[1]
    one = shards.kd_shards(df, Scratch(spark, "t"), dims, target_bytes=10**9).collect()
    assert {r.shard for r in one} == {0} and len(one) == len(rows)
    assert shards.kd_shards(df.limit(0), Scratch(spark, "t"), dims, shards=6).collect() == []
    assert {r.shard for r in shards.kd_shards(df.filter("doc_id = 3"), Scratch(spark, "t"), dims, shards=6).collect()} <= set(range(6))


# --- spelling variants -------------------------------------------------------------------------


def words_by_hand(docs, least=6, rare=5):
    seen = collections.Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            seen[w] += 1
    return {w: n for w, n in seen.items() if len(w) >= least and n >= rare}


def near_by_hand(w, words, letters):
    out = set()
    for i in range(len(w) + 1):
        out |= {w[:i] + a + w[i:] for a in letters} | {w[:i] + a + w[i + 1 :] for a in letters if i < len(w)} | ({w[:i] + w[i + 1 :]} if i < len(w) else set())
    return [x for x in out if x in words and x != w]


def check_variants(got, words):
    letters = sorted({a for w in words for a in w})
    assert {r.word: r.n for r in got} == words
    form = {}
    for r in got:
        near = near_by_hand(r.word, words, letters)
        best = min(near, key=lambda w: (-words[w], w), default=None)
        form[r.word] = best if best is not None and words[best] >= 5 * r.n else None
        assert (r.n_near, r.form, r.form_n) == (len(near), form[r.word], words.get(form[r.word])), r
    for r in got:
        end = r.word
        while form[end]:
            end = form[end]
        assert r.root == end


def test_op12(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op12_spelling(spark, sf).collect()
    check_variants(got, words_by_hand(docs))
    assert sum(r.form is not None for r in got) > 3


def test_spelling_over_many_blocks(spark):
    """A hot first half, a hot second half, repeated letters, chains of forms, ties, very long runs, nulls and repeated rows."""
    rng = np.random.default_rng(3)
    tail = lambda n: "".join(rng.choice(list("abc"), n))
    texts = [(k, " ".join(f"stemstem{tail(5)} {tail(5)}endendé {tail(6)}" for _ in range(60))) for k in range(60)]
    texts += [(None, "aaaaaa aaaaaaa aaaaaaaa " * 40), (None, "bananas " * 5 + "banana " * 30 + "bananna " * 160 + "Bananna! bannana " * 6), (5, None), (6, ""), (7, "x" * 5000 + " "), (7, ("y" * 300 + "z " + "y" * 300 + " ") * 6)]
    texts += [(8, "repeat repeats repeated"), (8, "repeat repeats repeated")] * 5
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n", F.lit("clash"))
    words = words_by_hand(texts)
    for block, lookups in ((1500, 40), (1 << 18, 100_000)):
        got = spelling.variants(df.repartition(3), Scratch(spark, "t"), block=block, lookups=lookups).collect()
        check_variants(got, words)
    assert spelling.variants(df.limit(0), Scratch(spark, "t")).collect() == []


def test_counts_survive_full_tables():
    counts = spelling._Counts(199, 1)
    counts.table.most = 50
    rng = np.random.default_rng(1)
    docs = [(str(k), " ".join(f"w{chr(97 + a)}{chr(97 + b)}" for a, b in rng.integers(0, 20, (30, 2)))) for k in range(40)]
    for i, t in docs:
        counts.add([i], [t.split()])
    counts.flush()
    got = collections.Counter()
    for batch in counts.ready:
        for w, n in zip(*(c.to_pylist() for c in batch.columns)):
            got[w] += n
    assert got == collections.Counter(words_by_hand(docs, 1, 1))


# --- hard negatives ----------------------------------------------------------------------------


def test_op13(spark, sf):
    assert assert_same(queries.op13_negatives(spark, sf), sf, negatives.ORACLE_SQL) > 10


def negatives_by_hand(rows, every=50):
    ok = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    whole = lambda v: [int(np.floor(256 * x)) for x in v]
    anchors = {}
    for r in ok:
        if r[0] is not None and r[0] % every == 0:
            anchors[r[0]] = min([r, anchors[r[0]]] if r[0] in anchors else [r], key=lambda x: x[1:])
    last = lambda i: (i is None, i)
    out = []
    for a, (_, label, v) in anchors.items():
        scored = sorted(((sum(x * y for x, y in zip(whole(v), whole(r[2]))), r[0], r[1]) for r in ok if r[0] != a), key=lambda x: (-x[0], *last(x[1])))
        for p, other, _ in [x for x in scored if x[2] == label][:5]:
            got = [x for x in scored if x[2] != label and 50 * p <= 100 * x[0] <= 95 * p][:3]
            out += [(a, other, k + 1, x[1], p, x[0]) for k, x in enumerate(got)]
    return sorted(map(str, out))


@pytest.mark.parametrize("groups", [65_536, 60])
def test_hard_negatives_edges(spark, monkeypatch, groups):
    monkeypatch.setattr(negatives, "ROWS", groups)
    monkeypatch.setattr(negatives, "ANCHORS", max(1, groups // 20))
    rng = np.random.default_rng(9)
    rows = [(int(k), int(rng.choice([0, 0, 0, 1, 2])), [float(x) for x in rng.integers(0, 4, 5) / 16]) for k in range(400)]
    rows += [rows[50], rows[50], rows[51], rows[51], (100, 0, [0.5, 0.1]), (1000, 2, []), (1050, None, [1.0]), (1100, 1, None), (1150, 1, [1.0, None]), (1200, 1, [float("nan")]), (1250, 1, [float("inf")])]
    rows += [(None, 1, [0.25, 0.25, 0.25, 0.25, 0.1]), (1300, 1, [-0.2] * 5), (1301, 1, [0.2, 0.3]), (1302, 7, [0.2] * 9), (1350, 9, [4000.0, 3.0, 1e7, 0.1, 2.0]), (1351, 9, [3e6, 3.0, 2e6, 0.1, 7.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, score string")
    got = sorted(str(tuple(r)) for r in negatives.mine(df.repartition(4), Scratch(spark, "t")).collect())
    assert got == negatives_by_hand(rows) and len(got) > 20
    assert negatives.mine(df.limit(0), Scratch(spark, "t")).collect() == []


def test_scores_are_exact():
    rng = np.random.default_rng(2)
    for size in (10, 10**5, 10**8):
        a, b = rng.integers(-size, size, (7, 12)).astype(float), rng.integers(-size, size, (9, 12)).astype(float)
        assert negatives.scores(a, b).astype(object).tolist() == (a.astype(int).astype(object) @ b.astype(int).astype(object).T).tolist()
    with pytest.raises(ArithmeticError):
        negatives.scores(np.full((1, 4), 2.0**60), np.full((1, 4), 2.0**60))
