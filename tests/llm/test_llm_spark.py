"""The training-data operators on Spark: brute force, edge rows and clashing names."""

from __future__ import annotations

import hashlib
import math
import os
import re
import struct
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import corpus_pipeline  # noqa: E402
from firmlens.core.scratch import Scratch  # noqa: E402
from firmlens.llm import bpe, components, imatch, linededup, lm, media, mixing, quality, queries as Q, simhash, tokenfiles, toxicity  # noqa: E402
from oracle import assert_same  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Held-out accuracy needs more than the few dozen labels of the smallest tables.
LEARN = "/root/testdata/sf0.01"
LONG = " ".join(f"wort{i % 313} and{i % 7}" for i in range(4000))
ROWS = [
    (1, "One two three four five six seven eight nine ten eleven twelve.\nA second line that is long enough.", "en", "a", 1),
    (2, "One two three four five six seven eight nine ten eleven twelve!\nA second line that is long enough.", "en", "b", 1),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \n ", "en", None, 3),
    (6, LONG, "de", "c", None),
    (7, "x", "en", "c", 1),
    (7, "x", "en", "c", 1),
    (None, "a null id and a text of some words", "en", "a", 1),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_bpe(spark, sf, texts, edge, empty):
    library = Tokenizer.from_file(Q.vocabulary())
    rows = Q.op1_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    got = bpe.decode(bpe.encode(edge, Q.vocabulary()), Q.vocabulary()).collect()
    assert len(got) == len(ROWS) and {r.decoded for r in got if r.doc_id in (3, 4, 5)} == {""}
    assert bpe.round_trip(empty, Q.vocabulary()).count() == 0
    assert bpe.encode(edge.withColumn("IDS", F.lit(1)), Q.vocabulary()).columns == [c for c in edge.columns if c != "text"] + ["ids", "n_tokens"]


def test_quality(spark, edge, empty):
    docs, labels = (spark.read.parquet(f"{LEARN}/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.op2_quality(spark, LEARN).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows if r.held_out]) >= 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    model = quality.fit(docs, labels, F.lit(True))
    assert all(0 <= r.score <= 1 for r in model.score(edge).collect())
    assert model.score(empty).count() == 0
    assert quality.fit(empty, labels.limit(0), F.lit(True)).score(edge).count() == len(ROWS)


def test_media(spark, sf, texts, edge, empty):
    for r in Q.op3_media(spark, sf).collect():
        data = texts[r.doc_id].encode()
        padded = data + b" " * ((-len(data)) % 192 if data else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-16:]) and r.media_sha256 == hashlib.sha256(media.store(padded)).hexdigest()
    assert media.media_columns(edge).count() == len(ROWS) and media.media_columns(empty).count() == 0


def brute_components(pairs, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000, 1000 + i) for i in range(60)] + [(2000 + i, 2001 + i) for i in range(70)] + [(5, 5)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(df, Scratch(spark, "t")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == brute_components([p for p in links if p[0] != p[1]], linked)
    assert components.components(df.limit(0), Scratch(spark, "t")).count() == 0


def test_simhash(spark, sf, texts, edge, empty):
    rows = Q.op4_simhash(spark, sf).collect()
    fps = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    ids = sorted(fps)
    assert all(fps[i] == simhash.fingerprint(texts[i]) % (1 << 64) for i in ids)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 2]
    assert {r.doc_id: r.component_id for r in rows} == brute_components(pairs, ids)
    got = simhash.near_duplicates(edge, Scratch(spark, "t")).collect()
    assert len(got) == len(ROWS) and {r.component_id for r in got if r.doc_id in (3, 4, 5)} == {3}
    assert simhash.near_duplicates(empty, Scratch(spark, "t")).count() == 0


def test_pipeline_keeps_one_row_of_each_group(spark):
    other, third = "another text of quite different words without any copy at all", "a third text, seen twice and never with an id of its own"
    rows = [
        (None, "a null id and a text of some words", "en", "a", 1),  # alone in its group
        (None, third, "en", "a", 1), (None, third, "en", "a", 1),  # a group without ids
        (7, LONG, "de", "c", 1), (7, LONG, "de", "c", 1), (8, LONG, "de", "c", 1), (None, LONG, "de", "c", 1),  # repeated rows
        (9, other, "en", "a", 1), (9, other.upper(), "en", "a", 1),  # two texts of one id
    ]
    got = corpus_pipeline.one_of_near_copies(spark, spark.createDataFrame(rows, SCHEMA), LEARN).collect()
    found = sorted((r.text.lower(), r.doc_id) for r in got)
    assert found == sorted([(rows[0][1], None), (third, None), (LONG, 7), (other, 9)])


def spark_hash(value, seed=42):
    return xxhash.xxh64(value if isinstance(value, bytes) else struct.pack("<q", value), seed=seed).intdigest()


def brute_imatch(texts):
    """A function that gives the fingerprint of a text, by the lexicon of these texts: hash of its sorted terms in every subset, None without terms."""
    def terms(t):
        bare = t.lower().strip(" \t\n\x0b\f\r")
        return {spark_hash(w.encode()) >> (64 - imatch.BITS) for w in re.split("[\\x20\\x09-\\x0D]+", bare)} if bare else set()

    df = Counter(t for x in texts for t in terms(x))
    inside = [t for t, n in df.items() if imatch.BAND[0] <= math.log(len(texts) / n) <= imatch.BAND[1]]
    size = imatch.LEAST_CODES
    while size < imatch.ROOM * len(inside):
        size *= 2
    codes = {t % size for t in inside}

    def fingerprint(text):
        found = sorted(terms(text))
        kept = [t for t in found if t % size in codes]
        subsets = [found, kept, *([] for _ in range(imatch.SERIES * imatch.DEPTH))]
        for t in kept:
            for series in range(imatch.SERIES):
                for depth in range(imatch.DEPTH):
                    if t >> 2 * (series * imatch.DEPTH + depth) & 3:
                        break
                    subsets[2 + depth * imatch.SERIES + series].append(t)
        out = []
        for s in subsets:
            seed = 42
            for t in s:
                seed = spark_hash(t, seed)
            out.append(seed if s else None)
        return out

    return fingerprint


def brute_likeness(a, b):
    some = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
    return sum(x == y for x, y in some) / len(some) if some else 1.0


def test_imatch(spark, sf, texts, edge, empty):
    rows = {r.doc_id: r for r in Q.op5_imatch(spark, sf).collect()}
    ids = sorted(texts)
    for a, b in zip(ids, ids[1:] + ids[:1]):
        n = len(texts[a]) // 4
        want = texts[a][: len(texts[a]) - n] + texts[b][:n]
        assert rows[a].n_chars == len(texts[a]) and rows[a].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
    equal = {}
    for i in ids:
        assert equal.setdefault(texts[i], rows[i].fingerprint) == rows[i].fingerprint
    fingerprint = brute_imatch(list(texts.values()))
    shown = lambda f: ".".join("" if h is None else f"{h:x}" for h in f)
    for a, b in zip(ids, ids[1:] + ids[:1]):
        n = len(texts[a]) // 4
        own, other, after = fingerprint(texts[a]), fingerprint(texts[a][: len(texts[a]) - n] + texts[b][:n]), fingerprint(texts[b])
        assert (rows[a].fingerprint, rows[a].edited_fingerprint) == (shown(own), shown(other))
        assert rows[a].near_edited == pytest.approx(brute_likeness(own, other)) and rows[a].near_next == pytest.approx(brute_likeness(own, after))
    near, far = (np.mean([getattr(r, c) for r in rows.values()]) for c in ("near_edited", "near_next"))
    print("likeness to the edited text and to the next", near, far)
    assert near > 0.1 and near > 10 * far
    flags = imatch.lexicon(edge)
    marked = imatch.with_next(imatch.with_fingerprint(edge, "text", flags, "fp"), ["doc_id"], tie="text", blocks=3).orderBy(F.asc_nulls_last("doc_id")).collect()
    assert [r.next_doc_id for r in marked] == [2, 3, 4, 5, 6, 7, 7, None, 1]
    assert imatch.with_next(empty, ["text"]).count() == 0


def test_imatch_reads_every_term(spark):
    base = [f"w{i}" for i in range(1000)]
    texts = [" ".join(base), *(" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in range(0, 1000, 50))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = imatch.with_fingerprint(df, "text", imatch.lexicon(df), "fp").select("doc_id", "fp", imatch.as_text(F.col("fp")).alias("shown")).collect()
    assert len({r.shown for r in rows}) == len(texts)  # any one term of a thousand shows
    whole, other = [next(r.fp for r in rows if r.doc_id == i) for i in (0, 1)]
    assert whole[0] != other[0] and len(whole) == 2 + imatch.SERIES * imatch.DEPTH
    few = spark.createDataFrame([(1, "a b"), (2, "b  A"), (3, "a c"), (4, ""), (5, None)], "doc_id long, text string")
    found = {r.doc_id: r.fp for r in imatch.with_fingerprint(few, "text", imatch.lexicon(few), "fp").collect()}  # no term is in the band
    assert found[1] == found[2] and found[4] == found[5] and found[4][0] is None
    pair = lambda i, j: spark.createDataFrame([(found[i], found[j])], "a array<bigint>, b array<bigint>").select(imatch.likeness(F.col("a"), F.col("b")).alias("x")).first().x
    assert (pair(1, 2), pair(1, 3), pair(4, 5), pair(1, 4)) == (1.0, 0.0, 1.0, 0.0)


def test_toxicity(spark, edge, empty):
    docs, labels = (spark.read.parquet(f"{LEARN}/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.op6_toxicity(spark, LEARN).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in rows if r.held_out]) >= 0.8
    model = toxicity.fit(docs, labels, F.lit(True))
    assert all(0 <= r.score <= 1 for r in model.score(edge).collect()) and model.score(empty).count() == 0
    assert toxicity.fit(empty, labels.limit(0), F.lit(True)).score(edge).count() == len(ROWS)
    assert pytest.approx(model.weight("idiot")) == model.weight("1d10t")
    # a word after a long run of symbols, and one that is cut by a piece's end, count as elsewhere
    plain, long_ = "an idiot in a text of some words", "a1" * 70 + ".i.d.i.o.t" + " of some words"
    assert model.evidence(["x y z i d i o t and so on"])[0, 0] > 0
    whole = model.evidence([plain])[0]
    kept, lm.B.TEXT_BYTES = lm.B.TEXT_BYTES, 8
    try:
        assert model.evidence([plain])[0] == pytest.approx(whole)
    finally:
        lm.B.TEXT_BYTES = kept
    assert len(toxicity.restore(long_, model.costs)) > 64


def test_lm(spark, sf, texts, edge):
    rows = {r.doc_id: r for r in Q.op7_lm(spark, sf).collect()}
    found = {i: [*words(lm.B.lower_ascii(t)), "</end>"] for i, t in texts.items()}
    count = Counter(w for i, ws in found.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in found.items():
        r = rows[i]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert abs(r.base_score - base) < 1e-6 * len(ws) and r.score < 0
    got = lm.score(edge, F.lit(False), Q.vocabulary(), Scratch(spark, "t")).collect()
    assert len(got) == len(ROWS) and {r.train_tokens for r in got} == {0}
    size = len(lm.encoder(Q.vocabulary()).vocabulary.tokens)
    assert all(r.score < 0 for r in got)
    assert lm.score(edge.limit(0), F.lit(True), Q.vocabulary(), Scratch(spark, "t")).count() == 0 and size > 49_000


def fitted(spark, docs, learns):
    table = lm.read(docs, learns, Q.vocabulary(), {}, Scratch(spark, "t"), "text", ["doc_id"])
    return lm.fit(table.filter("_fl_learns"), Q.vocabulary(), Scratch(spark, "t"))


def test_lm_model(spark):
    """Shares sum to one, scores are the sums of their parts, and held-out texts are foretold better than by the contract's own base."""
    docs = spark.read.parquet(f"{LEARN}/documents.parquet")
    model = fitted(spark, docs, ~quality.held_out("doc_id", 5, 1))
    size = len(model.class_of)
    library = Tokenizer.from_file(Q.vocabulary())
    rows = spark.createDataFrame(Q.op7_lm(spark, LEARN).toPandas()).cache()
    held = docs.filter(quality.held_out("doc_id", 5, 1) & F.col("text").isNotNull()).orderBy("doc_id").limit(1).first()
    text = lm.B.lower_ascii(held.text)
    ids = np.array([model.start, *library.encode(text, add_special_tokens=False).ids, model.end])
    for upto in (1, 2, 3, 40):  # every id of the vocabulary as the next one
        inputs = np.tile(ids[:upto], size)
        targets = np.tile(ids[1 : upto + 1], size)
        targets[upto - 1 :: upto] = np.arange(size)
        logs = model.logs(inputs, targets, np.full(size, upto))[upto - 1 :: upto]
        assert np.exp(logs.astype(np.float64)).sum() == pytest.approx(1, abs=2e-3)
    own = model.logs(ids[:-1], ids[1:], np.array([len(ids) - 1])).sum() / math.log(10)
    assert model.log10([text])[0] == pytest.approx(own, rel=1e-5)
    assert rows.filter(F.col("doc_id") == held.doc_id).first().score == pytest.approx(own, rel=1e-4)
    sums = {r.held_out: r for r in rows.groupBy("held_out").agg((F.sum("score") / F.sum("n_tokens")).alias("score"), (F.sum("base_score") / F.sum("n_tokens")).alias("base")).collect()}
    print("log10 a token, learning rows and held out:", sums[False], sums[True])
    assert sums[True].score > sums[True].base and sums[False].score > sums[False].base


def test_lm_counts_against_brute_force(spark):
    texts = ["a b a b c", "a b", "", None, "b a"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    size, start, end = lm.special_ids(Q.vocabulary())
    table = lm.read(docs, F.lit(True), Q.vocabulary(), {}, Scratch(spark, "t"), "text", ["doc_id"])
    library, want = Tokenizer.from_file(Q.vocabulary()), Counter()
    for t in texts:
        ids = [start, start, *library.encode(t or "", add_special_tokens=False).ids, end]
        for x, y, z in zip(ids, ids[1:], ids[2:]):
            want.update([1 << 54 | z, 2 << 54 | y << 18 | z, 3 << 54 | x << 36 | y << 18 | z])
    assert {r.key: r.n for r in lm.grams(table, size, start, end).collect()} == want


def test_lm_scores_do_not_depend_on_the_split(spark, monkeypatch):
    """Any split of the table gives the same scores but for the rounding of sums, with several shards."""
    monkeypatch.setattr(lm, "SHARD", 1 << 14)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = [{r.doc_id: r.score for r in lm.score(docs.repartition(n), F.lit(True), Q.vocabulary(), Scratch(spark, "t"), keep=["doc_id"]).collect()} for n in (1, 4)]
    assert found[0].keys() == found[1].keys() and all(found[1][i] == pytest.approx(x, rel=1e-6) for i, x in found[0].items())


def test_lm_leaves_no_tables_behind(spark, sf):
    """What a model was made of, and the sums of its training, are gone before texts are scored."""
    scratch = Scratch(spark, "t")
    lm.score(spark.read.parquet(f"{sf}/documents.parquet"), F.lit(True), Q.vocabulary(), scratch)
    assert sorted(x.split("-", 1)[1] for x in os.listdir(scratch.path.removeprefix("file:"))) == ["read", "words"]


def test_lm_keys():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 40, 5000))
    table = lm.Keys(keys)
    assert (table.places(keys) == np.arange(len(keys))).all() and (table.places(keys[:-1] + 1)[keys[:-1] + 1 != keys[1:]] == -1).all()
    assert (lm.Keys(keys[:0]).places(keys) == -1).all()
    for n in (1, 16, 17, 1100):
        ids, seen = np.arange(n + 1), 0
        x, y, outside, inside = lm.piece_windows(ids, seen)
        assert sorted(y[inside]) == list(range(1, n + 1)) and (x[:, lm.SPAN - lm.STRIDE :][inside] + 1 == y[inside]).all()


def test_token_files(spark, sf, texts, edge, empty):
    library, at = Tokenizer.from_file(Q.vocabulary()), 0
    for r in sorted(Q.op8_tokenfiles(spark, sf).collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    files = tokenfiles.write(edge, Scratch(spark, "t").where("files"), Q.vocabulary(), parts=3)
    assert files.read(spark).count() == len(ROWS)
    one = files.read(spark, [6]).collect()
    assert [r.doc_id for r in one] == [6] and np.frombuffer(one[0].ids, "<u4").tolist() == [*library.encode(LONG, add_special_tokens=False).ids, 2]
    assert tokenfiles.write(empty, Scratch(spark, "t").where("files"), Q.vocabulary()).read(spark).count() == 0


def test_mixing(spark, sf, edge, empty):
    assert_same(Q.op9_mixing(spark, sf), sf, mixing.ORACLE_SQL)
    rows = Q.op9_mixing(spark, sf).collect()
    assert all(r.taken <= 2 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    by = {}
    for r in rows:
        taken, _, largest = by.get(source[r.doc_id], (0, 0, 0))
        by[source[r.doc_id]] = taken + r.taken, r.target, max(largest, r["size"])
    assert all(abs(taken - target) <= 3 * largest + 0.1 * target for taken, target, largest in by.values())
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 10), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got[None] == 0 and sum(got.values()) == pytest.approx(180) and got["b"] == got["c"] == 20
    mixed = mixing.mix(edge)
    assert mixed.count() == len(ROWS) and mixing.mix(empty).count() == 0
    assert mixing.emit(mixed).columns == edge.columns and total > 0


def test_line_dedup(spark, edge, empty):
    out = {(r.doc_id, r.text): r for r in linededup.line_dedup(edge, Scratch(spark, "t")).collect()}
    assert out[1, ROWS[0][1]].n_dropped == 0
    assert (out[2, ROWS[1][1]].n_dropped, out[2, ROWS[1][1]].kept_text) == (2, "")
    assert out[3, None].kept_text is None and out[4, ""].kept_text == "" and out[5, " \n "].kept_text == " \n "
    assert out[7, "x"].n_dropped == 0  # repeated rows count as one
    assert linededup.line_dedup(empty, Scratch(spark, "t")).count() == 0
    short = spark.createDataFrame([(1, "ab\n\nab"), (2, "AB "), (2, "a longer line, twice under one id"), (2, "a longer line, twice under one id"), (3, "a longer line, twice under one id")], "doc_id long, text string")
    got = linededup.line_dedup(short, Scratch(spark, "t")).collect()
    assert sorted((r.doc_id, r.kept_text, r.n_dropped) for r in got) == [(1, "ab\n", 1), (2, "", 1), (2, short.collect()[2].text, 0), (2, short.collect()[2].text, 0), (3, "", 1)]


def line_norm(x):
    return re.sub(r"[\t\n\x0b\f\r ]+", " ", x.lower()).strip(" ")


def line_shingles(x):
    return {x[i : i + linededup.EXACT] for i in range(len(x) - linededup.EXACT + 1)}


def jaccard(x, y):
    return len(x & y) / max(1, len(x | y))


def brute_lines(texts):
    """Kept text of each document, by comparing every pair of different lines."""
    spots = {}
    for i in sorted(texts):
        for place, line in enumerate(texts[i].split("\n")):
            if line_norm(line):
                spots.setdefault(line_norm(line), []).append((i, place))
    lines = sorted(spots)
    sets = [line_shingles(x) for x in lines]
    pairs = []
    for a in range(len(lines)):
        for b in range(a + 1, len(lines)):
            if min(len(sets[a]), len(sets[b])) >= linededup.SIMILAR * max(len(sets[a]), len(sets[b])) > 0 and jaccard(sets[a], sets[b]) >= linededup.SIMILAR:
                pairs.append((a, b))
    group = brute_components(pairs, range(len(lines)))
    members = {}
    for k, line in enumerate(lines):
        members.setdefault(group[k], []).extend(spots[line])
    gone = {s for m in members.values() for s in sorted(m)[1:]}
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in texts.items()}


def test_line_dedup_against_brute_force(spark, sf, texts):
    want = brute_lines(texts)
    got = {r.doc_id: r.kept_sha256 for r in Q.op10_linededup(spark, sf).collect()}
    same = sum(got[i] == hashlib.sha256(t.encode()).hexdigest() for i, t in want.items())
    assert same >= 0.98 * len(want)  # banding finds nearly all pairs at the threshold


def edited_line(rng, line):
    """A copy with a similarity from 0.8 to 0.85, by changed characters or words."""
    for _ in range(200):
        x, by_word = list(line), rng.random() < 0.5
        base = line_shingles(line)
        while jaccard(base, line_shingles("".join(x))) > 0.85:
            at = rng.integers(len(x))
            if by_word:
                end = next((k for k in range(at, len(x)) if x[k] == " "), len(x))
                x[at:end] = list("qxzjv"[rng.integers(5)] * max(1, end - at))
            else:
                x[at] = "qxzjv"[rng.integers(5)]
        if jaccard(base, line_shingles("".join(x))) >= 0.8:
            return "".join(x)
    return None


def test_line_dedup_recall(spark):
    """Of edited lines at the threshold, by length, the share whose copy goes."""
    rng = np.random.default_rng(3)
    docs = spark.read.parquet(f"{LEARN}/documents.parquet").select("text").collect()
    lines = sorted({line_norm(x) for r in docs for x in (r.text or "").split("\n")})
    rows, classes = [], {}
    for low, high in ((25, 80), (80, 160), (160, 500), (500, 2000)):
        found = [x for x in lines if low <= len(x) < high]
        for x in [found[i] for i in rng.choice(len(found), 250, replace=False)]:
            if y := edited_line(rng, x):
                classes[len(rows) + 1] = low
                rows += [(len(rows), x), (len(rows) + 1, y)]
    out = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), keep=["doc_id"]).collect()
    gone = {r.doc_id for r in out if r.n_dropped}
    recall = {low: np.mean([i in gone for i, c in classes.items() if c == low]) for low in set(classes.values())}
    print(recall)
    assert all(r >= 0.93 for r in recall.values()), recall


def test_line_dedup_has_no_gap(spark):
    """Recall of edited pairs over the plane of lengths and spaces, the borders of the kinds of signature included; edits add and take spaces too."""
    rng = np.random.default_rng(12)
    letters = list("abcdefghijklmnopqrstuvwxyz")

    def line(length, word):
        x = ""
        while len(x) < length:
            x += "".join(rng.choice(letters, max(1, int(rng.integers(word // 2 + 1, word * 3 // 2 + 2))))) + " "
        return x[:length].strip()

    def edited(x):
        base, out = line_shingles(x), None
        for _ in range(200):
            y = list(out or x)
            at, kind = int(rng.integers(len(y))), rng.integers(4)
            if kind == 0:
                y[at] = rng.choice(letters)
            elif kind == 1:
                del y[at]
            elif kind == 2:
                y.insert(at, rng.choice(letters))
            elif 0 < at < len(y) - 1:
                y[at] = rng.choice(letters) if y[at] == " " else " "
            y = " ".join("".join(y).split())
            if jaccard(base, line_shingles(y)) < 0.8:
                break
            out = y
        return out

    rows, cells = [], {}
    for length in (12, 30, 70, 100, 108, 112, 130, 153, 176, 192, 240, 400, 900):
        for word in (2, 4, 6, 9, 13, 20, 60):
            for _ in range(16):
                x = line(length, word)
                if y := edited(x):
                    cells[len(rows) + 1] = length, word
                    rows += [(len(rows), x), (len(rows) + 1, y)]
    out = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), keep=["doc_id"]).collect()
    gone = {r.doc_id for r in out if r.n_dropped}
    found = {c: np.mean([i in gone for i, d in cells.items() if d == c]) for c in set(cells.values())}
    everything = np.mean([i in gone for i in cells])
    print(everything, sorted(found.items(), key=lambda x: x[1])[:8])
    assert everything >= 0.95 and min(found.values()) >= 0.75


def test_line_dedup_finds_lone_pairs_in_mixed_buckets(spark):
    """Lone pairs among many lines that are all somewhat alike, not next to each other in any order: none is left out."""
    rng = np.random.default_rng(21)
    base = [f"word{i}" for i in range(40)]

    def other(words, n):
        out = list(words)
        for k in rng.choice(40, n, replace=False):
            out[k] = f"x{rng.integers(10**6)}"
        return out

    lines = [other(base, 3) for _ in range(800)]
    lines += [other(x, 1) for x in lines[:200]]
    rows = [(i, " ".join(x)) for i, x in enumerate(lines)]
    sets = [line_shingles(x) for _, x in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if jaccard(sets[a], sets[b]) >= linededup.SIMILAR]
    group = brute_components(pairs, range(len(rows)))
    assert len(set(group.values())) == 800
    out = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), keep=["doc_id"]).collect()
    assert {r.doc_id for r in out if r.n_dropped} == {i for i in range(len(rows)) if group[i] != i}


def test_line_dedup_hot_bucket(spark):
    """Thousands of alike lines: comparisons stay in proportion, and all copies go but one."""
    rng = np.random.default_rng(8)
    base = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(3000):
        w = list(base)
        for k in rng.choice(40, rng.integers(1, 7), replace=False):
            w[k] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(w)))
    made = []

    class Counting(Scratch):
        def save(self, df, name):
            out = super().save(df, name)
            made.append((name, out.count()))
            return out

    out = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), Counting(spark, "t"), keep=["doc_id"]).collect()
    sets = [line_shingles(t) for _, t in rows]
    lonely = sum(1 for i in range(0, 3000, 60) if not any(jaccard(sets[i], sets[j]) >= 0.8 for j in range(3000) if i != j))
    assert dict(made)["second-likely"] < 60 * len(rows) and dict(made)["first-likely"] < 12 * len(rows)
    kept = sum(r.n_dropped == 0 for r in out)
    assert kept <= 1 + 3000 * (lonely / 50 + 0.12)


def test_line_dedup_meets_all_components_of_large_buckets(spark, monkeypatch):
    """Every pair of different components that agrees in AGREE minima is met from signatures alone, in buckets of more than CROWD lines too."""
    monkeypatch.setattr(linededup, "MOST", 16)
    rng = np.random.default_rng(4)
    minima = rng.integers(0, 3, (60, linededup.MINIMA))
    minima[:, :4] = 1 << linededup.LANE - 2  # one band holds all of them
    packed = [[sum(int(x) << linededup.LANE * r for r, x in enumerate(row[4 * k : 4 * k + 4])) for k in range(linededup.MINIMA // 4)] for row in minima]
    signed = spark.createDataFrame([(i, 0, *row) for i, row in enumerate(packed)], "key long, kind int, " + ", ".join(f"s{k} long" for k in range(linededup.MINIMA // 4)))
    met = spark.createDataFrame([(0, 7, i, 0, 60) for i in range(60)], "kind int, bucket long, key long, lead long, n long")
    label = {i: 0 if i < 45 else i - i % 2 for i in range(60)}
    mixed = linededup.labelled(met, spark.createDataFrame(list(label.items()), "node long, label long"))
    assert {(r.most, r.outside) for r in mixed.collect()} == {(0, 15)}
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if label[a] != label[b] and (minima[a] == minima[b]).sum() >= linededup.AGREE}
    assert want and {(r.a, r.b) for r in linededup.apart(mixed, signed).collect()} == want


def test_line_dedup_pairs_stay_in_proportion(spark):
    """Many lines near one text but not similar to each other: few pairs are read, and no link is lost."""
    rng = np.random.default_rng(17)
    base = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(900):
        w = list(base)
        for k in rng.choice(40, rng.integers(3, 8), replace=False):
            w[k] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(w)))
    for i in range(60):
        w = rows[5 * i][1].split()
        w[int(rng.integers(40))] = f"x{rng.integers(10**6)}"
        rows.append((900 + i, " ".join(w)))
    made = {}

    class Counting(Scratch):
        def save(self, df, name):
            out = super().save(df, name)
            made[name] = out.count()
            return out

    scratch = Counting(spark, "t")
    out = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), scratch, keep=["doc_id"])
    gone = {r.doc_id for r in out.collect() if r.n_dropped}
    sets = [line_shingles(t) for _, t in rows]
    every = range(len(rows))
    group = brute_components([(a, b) for a in every for b in every[a + 1 :] if jaccard(sets[a], sets[b]) >= linededup.SIMILAR], every)
    assert gone == {i for i in every if group[i] != i} and len(gone) >= 50
    assert made["third-likely"] + made.get("rest-likely", 0) < 20 * len(rows)


def test_line_dedup_makes_a_pair_once(spark):
    """Lines that share all bands are one pair of the first band."""
    s = ", ".join(f"s{k} long" for k in range(linededup.MINIMA // 4))
    signed = spark.createDataFrame([(i, 0, *([7] * (linededup.MINIMA // 4))) for i in range(4)], f"key long, kind int, {s}")
    rows = signed.select("kind", "key", F.explode(F.array(*linededup.bands())).alias("bucket"))
    met = rows.select("kind", "bucket", "key", F.lit(0).cast("long").alias("lead"), F.lit(4).cast("long").alias("n"))
    mixed = linededup.labelled(met, spark.createDataFrame([(0, 0)], "node long, label long"))
    found = linededup.apart(mixed, signed)
    assert sorted((r.a, r.b) for r in found.collect()) == [(a, b) for a in range(4) for b in range(a + 1, 4)]
    band = F.array_position(F.array(*linededup.bands()), F.col("bucket")).cast("int") - 1
    lanes = [F.lit(7).cast("long").alias(f"{x}{k}") for x in "ab" for k in range(linededup.MINIMA // 4)]
    seen = signed.limit(1).select(F.explode(F.array(*linededup.bands())).alias("bucket"), "*").select(band.alias("band"), *lanes)
    assert sorted(r.band for r in seen.filter(~linededup.met_before(F.col("band"))).collect()) == [0]


def test_line_dedup_reads_similar_pairs_only(spark):
    """Of lines that share a bucket all similar ones of different components are met, also those that agree in its band alone, and hardly any others."""
    rng = np.random.default_rng(31)
    syllables = ["the", "er", "an", "on", "in", "re", "st", "ou", "ti", "ed"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    lines = [" ".join(word() for _ in range(rng.integers(20, 90))) for _ in range(240)]
    for x in lines[:60]:
        words = x.split()
        words[int(rng.integers(len(words)))] = word()
        lines.append(" ".join(words))
    minima = rng.integers(0, 1 << linededup.LANE - 1, (len(lines), linededup.MINIMA))
    minima[:, [i % linededup.MINIMA for i in linededup.BAND]] = 1
    packed = [[sum(int(x) << linededup.LANE * r for r, x in enumerate(row[4 * k : 4 * k + 4])) for k in range(linededup.MINIMA // 4)] for row in minima]
    signed = spark.createDataFrame([(i, 1, *row) for i, row in enumerate(packed)], "key long, kind int, " + ", ".join(f"s{k} long" for k in range(linededup.MINIMA // 4)))
    met = signed.select("kind", linededup.bands()[0].alias("bucket"), "key", F.lit(0).cast("long").alias("lead"), F.lit(len(lines)).cast("long").alias("n"))
    mixed = linededup.labelled(met, spark.createDataFrame([(0, 0), (1, 0)], "node long, label long"))
    sketched = linededup.sketches(spark.createDataFrame(list(enumerate(lines)), "key long, line string"))
    got = {(r.a, r.b) for r in linededup.apart(mixed, signed, sketched).collect()}
    sets = [line_shingles(x) for x in lines]
    want = {(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if jaccard(sets[a], sets[b]) >= linededup.SIMILAR and (a, b) != (0, 1)}
    assert len(want) > 50 and want <= got and len(got) < 2 * len(want)
    assert {r.key: r.size for r in sketched.collect()} == dict(enumerate(map(len, sets)))


def test_stages_leave_no_tables_behind(spark, sf):
    """Of the tables that line dedup and near-dedup write only those stay that their results read."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lines, copies = Scratch(spark, "t"), Scratch(spark, "t")
    kept, one = linededup.line_dedup(docs, lines), simhash.one_of_each(docs, copies)
    assert [x.split("-", 1)[1] for x in os.listdir(lines.path.removeprefix("file:"))] == ["gone"]
    assert sorted(x.split("-", 1)[1] for x in os.listdir(copies.path.removeprefix("file:"))) == ["fingerprints", "stays"]
    assert kept.count() == docs.count() and one.count() <= docs.count()


def test_clashing_columns(spark, edge):
    names = ["ids", "decoded", "score", "fp", "component_id", "media", "size", "rate", "copies", "kept_text", "doc", "tag", "places", "fingerprint", "n_tokens", "tail", "rid", "next_text"]
    odd = edge.withColumns({n: F.lit("x") for n in names})
    assert media.media_columns(odd).count() == len(ROWS)
    assert simhash.near_duplicates(odd, Scratch(spark, "t")).filter("fp is not null and rate = 'x'").count() == len(ROWS)
    assert mixing.mix(odd).filter("size >= 0 and rate = 'x'").count() == len(ROWS)
    assert linededup.line_dedup(odd, Scratch(spark, "t")).filter("doc = 'x' and places = 'x'").count() == len(ROWS)
    marked = imatch.with_fingerprint(odd, "text", imatch.lexicon(odd), "fp")
    assert imatch.with_next(marked, ["text"], tie="text").count() == len(ROWS)
    assert lm.score(odd, F.lit(True), Q.vocabulary(), Scratch(spark, "t")).filter("tail = 'x' and score < 0").count() == len(ROWS)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, odd, LEARN).count() > 0


def test_clashing_columns_of_models_and_files(spark, edge):
    odd = edge.withColumns({n: F.lit("x") for n in ("score", "ids", "n_tokens", "start", "part", "shard", "counts", "y", "features")})
    docs, labels = (spark.read.parquet(f"{LEARN}/{t}.parquet") for t in ("documents", "labels"))
    good, toxic = quality.fit(docs, labels, F.lit(True)), toxicity.fit(docs, labels, F.lit(True))
    for model in (good, toxic):
        got = model.score(odd).collect()
        assert len(got) == len(ROWS) and all(isinstance(r.score, float) and r.ids == "x" for r in got)
    want = [round(r.score, 9) for r in good.score(edge).collect()]
    assert [round(r.score, 9) for r in good.score(odd).collect()] == want
    assert tokenfiles.write(odd, Scratch(spark, "t").where("files"), Q.vocabulary()).read(spark).count() == len(ROWS)
    assert corpus_pipeline.good(spark, odd, LEARN).columns == edge.columns


def test_stages_of_an_empty_table(spark, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, LEARN).count() == 0, name


def test_long_texts_are_read_in_pieces_alike(spark, monkeypatch):
    """A text that is cut into many pieces gives what it gives in one."""
    docs, labels = (spark.read.parquet(f"{LEARN}/{t}.parquet") for t in ("documents", "labels"))
    long_ = [LONG + " so stupid an 1d10t", "many different words " * 300, "eins zwei " * 999]
    good = quality.fit(docs, labels, F.lit(True))
    bad = toxicity.fit(docs, labels, F.lit(True))
    model = fitted(spark, docs.limit(50), F.lit(True))
    own = lm.FrequentWords({"words": 5, "and1": 2})
    whole = quality.pooled(long_, good.vectors), bad.evidence(long_), model.log10(long_), own.read(long_)
    monkeypatch.setattr(lm.B.pieces, "__defaults__", (500,))
    assert len(list(lm.B.pieces(long_[0]))) > 20
    parts = quality.pooled(long_, good.vectors), bad.evidence(long_), model.log10(long_), own.read(long_)
    for a, b in zip(whole[:3], parts[:3]):
        assert np.allclose(a, b, rtol=1e-4, atol=1e-3)
    assert all(np.allclose(a, b) if isinstance(a, np.ndarray) else a == b for a, b in zip(whole[3], parts[3]))


def test_repeated_ids_bring_one_row_to_the_driver(spark):
    docs = spark.createDataFrame([(1, "one text of it"), (1, "another text"), (1, "another text"), (2, "a third")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    rows = quality.labelled(docs, labels, "quality", F.lit(True), 10).collect()
    assert sorted((r.doc_id, r.y) for r in rows) == [(1, 0), (2, 1)]


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scratch, columns, before = Scratch(spark, "t"), docs.columns, docs
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = scratch.save(stage(spark, docs, sf), f"s{k}")
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LEARN}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.good(spark, spark.read.parquet(f"{LEARN}/documents.parquet"), LEARN).select("doc_id").collect()}
    assert np.mean([(i in kept) == bool(q) for i, q in labels.items()]) > 0.95
    assert counts[4] == counts[3] == before.count() and counts[0] >= counts[1] >= counts[2] > 0
    assert corpus_pipeline.run(spark, sf).count() == counts[4]
