"""Nearest, interval and latest-before joins against brute force, and their pairs on one hot key."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from firmlens.operators import joins as J

DAY = dt.date(2020, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


@pytest.mark.parametrize("other_than", [None, "org"])
@pytest.mark.parametrize("lo, hi", [(-10, 3), (0, 0), (-700, 90), (5, 9)])
def test_nearest_join_is_the_brute_force(spark, lo, hi, other_than):
    rng = random.Random(lo * 7 + hi)
    left = [(rng.choice(["a", "b", None]), day(rng.choice([None, *range(0, 300, 3)])), rng.choice(["x", "y", None])) for _ in range(120)]
    right = [(rng.choice(["a", "b", None]), day(rng.randrange(-50, 350)), rng.choice(["x", "y", "z", None]), rng.choice([None, 1, 2]), rng.randrange(4)) for _ in range(150)]
    l = spark.createDataFrame(left, "k string, at date, org string").withColumn("extra", F.lit(1))
    r = spark.createDataFrame(right, "k string, on date, org string, w int, c int")
    out = J.nearest_join(l, r, "k", "at", "on", lo, hi, ["c", "org"], ["w"], other_than, "n_")
    want = []
    for k, at, org in left:
        met = [x for x in right if k is not None and at is not None and x[0] == k and lo <= (x[1] - at).days <= hi and (other_than is None or (x[2] is not None and org is not None and x[2] != org))]
        best = min(met, key=lambda x: (abs((x[1] - at).days), x[3] is None, -(x[3] or 0), x[4], x[2] is None, x[2] or ""), default=None)
        want.append((k, at, org, best and best[4], best and best[2]))
    assert sorted(map(str, want)) == sorted(str((r.k, r["at"], r.org, r.n_c, r.n_org)) for r in out.collect())


def test_nearest_pairs_on_a_hot_key(spark):
    """Pairs for each date are bounded by the days of the tolerance, whatever the rows of the key."""
    n = 4000
    l = spark.range(n).select(F.lit("hot").alias("k"), F.date_add(F.lit(DAY), (F.col("id") % 2000).cast("int")).alias("at"), F.lit("x").alias("org"))
    r = spark.range(n).select(F.lit("hot").alias("k"), F.date_add(F.lit(DAY), (F.col("id") % 2000).cast("int")).alias("on"), (F.col("id") % 3).cast("string").alias("org"))
    assert J._near_pairs(l, r, "k", "at", "on", -2, 2, ["org"], [], "org").count() <= 2000 * 5 * 2  # n * n would be 16 million


KINDS = {"date": lambda n: day(n), "long": lambda n: n, "timestamp": lambda n: None if n is None else dt.datetime(2020, 1, 1) + dt.timedelta(seconds=977 * n)}


@pytest.mark.parametrize("kind", KINDS)
def test_within_is_the_brute_force(spark, kind):
    rng, make = random.Random(kind), KINDS[kind]
    points = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-20, 400)]), i) for i in range(150)]
    spans = [(rng.choice(["a", "b", None]), s := rng.choice([None, *range(-500, 500)]), rng.choice([None, (s or 0) + rng.choice([-3, 0, 1, 2, 40, 300, 9000])]), i) for i in range(80)]
    p = spark.createDataFrame([(k, make(t), i) for k, t, i in points], f"k string, at {kind}, i int")
    s = spark.createDataFrame([(k, make(a), make(b), j) for k, a, b, j in spans], f"k string, s {kind}, e {kind}, j int")
    got = J.within(p, s, "k", "at", "s", "e")
    assert got.columns == ["k", "at", "i", "s", "e", "j"]
    want = [(i, j) for k, t, i in points for h, a, b, j in spans if k is not None and k == h and t is not None and a is not None and a <= t and (b is None or t < b)]
    assert sorted((r.i, r.j) for r in got.collect()) == sorted(want) and want
    assert J.within(p.limit(0), s, "k", "at", "s", "e").count() == 0 and J.within(p, s.limit(0), "k", "at", "s", "e").count() == 0


def test_interval_pairs_on_a_hot_key(spark):
    n = 3000
    points = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 100 + 50).alias("at"))
    spans = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 100).alias("s"), (F.col("id") * 100 + 100 + (F.col("id") % 5) * 60).alias("e"))
    spans = spans.union(spark.createDataFrame([(1, 0, None), (1, 5, 200_000)], spans.schema))
    met, found = J._pieces(points, spans, "k", "at", "s", "e").count(), J.within(points, spans, "k", "at", "s", "e").count()
    assert found > n and met <= 3 * found + 2 * n  # n * n would be 9 million


def test_latest_before_keeps_equal_rows_apart(spark):
    rng = random.Random(8)
    left = [(rng.choice(["a", "b", None]), day(rng.choice([None, *range(60)])), rng.randrange(2)) for _ in range(120)]
    right = [(rng.choice(["a", "b", None]), day(rng.choice([None, *range(60)])), rng.choice([None, 1, 2, 3])) for _ in range(60)]
    l, r = spark.createDataFrame(left, "k string, at date, v int"), spark.createDataFrame(right, "k string, on date, c int")
    want = []
    for k, at, v in left:
        met = [x for x in right if k is not None and x[0] == k and at is not None and x[1] is not None and x[1] < at]
        best = max(met, key=lambda x: (x[1], x[2] is not None, x[2] or 0), default=None)
        want.append((k, at, v, best and best[2]))
    got = [tuple(x) for x in J.latest_before(l, r, "k", "at", "on", ["c"]).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
