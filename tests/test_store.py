"""The bucketed store: late and repeated batches, shared files, races, null keys."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from firmlens.operators import incremental as N
from firmlens.sources.store import Conflict, KeyedStore
from firmlens.streaming import jobs as S

SCHEMA = "entity string, day int, snapshot_id long, value string"


def rows_of(store, number=None):
    return sorted(map(tuple, store.read(number).collect()), key=repr)


def newest(rows):
    out = {}
    for r in rows:
        if (k := r[:2]) not in out or (r[2], r[3]) > (out[k][2], out[k][3]):
            out[k] = r
    return sorted(out.values(), key=repr)


def test_replay_in_any_order_equals_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"e{rng.randrange(9)}", rng.randrange(5), rng.randrange(40), f"v{rng.randrange(6)}") for _ in range(300)] + [(None, None, 3, "x"), (None, None, 7, "y")]
    for turn in range(2):
        rng.shuffle(rows)
        batches = [rows[i : i + 75] for i in range(0, len(rows), 75)]
        store = KeyedStore(spark, str(tmp_path / f"s{turn}"))
        store.create(spark.createDataFrame([], SCHEMA), ["entity", "day"], 8)
        for number, batch in enumerate(batches):
            store.merge(spark.createDataFrame(batch, SCHEMA), ["snapshot_id"], "feed", number)
        assert rows_of(store) == newest(rows)
        before = store.version()
        # a batch that is run again: by its number nothing, under another number the same rows
        assert store.merge(spark.createDataFrame(batches[1], SCHEMA), ["snapshot_id"], "feed", 1) == before
        store.merge(spark.createDataFrame(batches[0], SCHEMA), ["snapshot_id"], "feed", 99)
        assert rows_of(store) == newest(rows) and store.version().applied == {"feed": 99}


def test_stream_upsert_takes_up_where_it_stopped(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "store"))
    store.create(spark.createDataFrame([], SCHEMA), ["entity", "day"], 4)
    folder, seen = str(tmp_path / "in"), []
    for k, batch in enumerate(([("a", 1, 5, "new"), ("b", 1, 5, "b")], [("a", 1, 2, "late"), ("c", 9, 1, "c")], [("b", 1, 8, "newer"), ("a", 1, 5, "new")])):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        seen += batch
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        S.stream_upsert(stream, store, ["snapshot_id"], str(tmp_path / "check"), "feed").awaitTermination()
        assert rows_of(store) == newest(seen)
        assert store.version().applied == {"feed": k}


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"))
    build = lambda ids, add: ids.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), (F.col("id") * 10 + add).alias("v"))
    store.create(build(spark.range(1000), 0), ["id"], 64)
    one = store.version()
    assert len(one.folders) == 64 and len(set(one.folders.values())) == 1
    dirty = spark.createDataFrame([(5,), (6,), (5,), (4000,), (7,)], "id long")
    two = store.refresh(dirty, lambda keys: build(keys.filter("id <> 7"), 3))
    fresh = {b for b, f in two.folders.items() if f != one.folders.get(b)}
    touched = {r[0] for r in dirty.select(store.bucket(one)).distinct().collect()}
    assert fresh == touched and len(touched) <= 4
    want = [(i, k, 10 * i + (3 if i in (5, 6, 4000) else 0)) for i in [*range(1000), 4000] for k in (0, 1) if i != 7]
    assert rows_of(store) == sorted(want, key=repr)
    assert rows_of(store, 1) == sorted([(i, k, 10 * i) for i in range(1000) for k in (0, 1)], key=repr)  # the old version is whole
    assert sorted(map(tuple, store.lookup([(5,), (7,), (12,)]).collect())) == [(5, 0, 53), (5, 1, 53), (12, 0, 120), (12, 1, 120)]
    files = {f.split("/_bucket=")[1].split("/")[0] for f in store.lookup([(12,)]).inputFiles()}
    assert len(files) == 1
    assert store.vacuum() == 0  # both folders are named by the last version
    for k in range(64):
        store.refresh(spark.range(k * 16, k * 16 + 16), lambda keys: build(keys, 1)) if k < 2 else None
    assert store.vacuum(1) >= 0 and len(store.numbers()) == 1 and store.read().count() > 0


def test_of_two_writers_one_fails(spark, tmp_path):
    store, other = KeyedStore(spark, str(tmp_path / "s")), KeyedStore(spark, str(tmp_path / "s"))
    store.create(spark.range(10).withColumn("v", F.lit(1)), ["id"], 4)
    slow = other.version()
    store.refresh(spark.range(1), lambda keys: keys.withColumn("v", F.lit(2)))
    with pytest.raises(Conflict):
        other._change(slow, spark.range(1), lambda old: old.withColumn("v", F.lit(3)), {})
    assert store.read().filter("v = 2").count() == 1 and store.read().count() == 10
    with pytest.raises(Conflict):
        other.create(spark.range(1), ["id"], 4)
    with pytest.raises(LookupError):
        KeyedStore(spark, str(tmp_path / "none")).read()


def test_delta_write_takes_nulls_as_keys(spark):
    schema = "a string, b int, v int"
    old = spark.createDataFrame([(None, 1, 1), ("x", None, 2), ("y", 2, None), ("z", 3, 3)], schema)
    new = spark.createDataFrame([(None, 1, 1), ("x", None, 5), ("y", 2, None), (None, 7, 7)], schema)
    got = {(r.a, r.b): r.change for r in N.delta_write(old, new, ["a", "b"], ["v"]).collect()}
    assert got == {(None, 1): "unchanged", ("x", None): "updated", ("y", 2): "unchanged", ("z", 3): "removed", (None, 7): "added"}
