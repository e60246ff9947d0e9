"""Scores, levels, gates and merges on hand-made rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmlens.operators import classify as C, incremental as N, scoring as K


def _score(spark, product, rows, schema, **kw):
    return {r.id: r for r in K.score(spark.createDataFrame(rows, schema), "id", product, **kw).collect()}


def test_unknown_weight_stays_in_the_denominator(spark):
    df = spark.createDataFrame([("a",)], "id string").select("id", K.factor(F.lit(100.0)).alias("x"), K.factor(F.lit(None).cast("double")).alias("y"))
    r = K.score(df, "id", K.Product("p", {"x": 40, "y": 60})).first()
    assert (r.score, r.coverage, r.potential, r.missing) == (40.0, 40.0, 100.0, ["y"])


def test_edited_levels(spark):
    at = lambda p, edited: spark.range(1).select(F.round(K.rescale(F.lit(float(p)), [100, 75, 50, 25], edited), 6)).first()[0]
    assert at(75, [85, 60, 40, 10]) == 60 and at(100, [85, 60, 40, 10]) == 85
    assert at(100, [60, 80, 40, 10]) == 60 and at(75, [60, 80, 40, 10]) == 80
    assert all(at(p, [100, 75, 50, 25]) == p for p in (0, 10, 25, 60, 100))


def test_gate_override_penalty_and_floor(spark):
    df = spark.createDataFrame([("in", 1, 50.0), ("out", 0, 90.0), ("low", 1, 5.0)], "id string, ok int, v double").withColumn("x", K.factor(F.col("v")))
    product = K.Product("p", {"x": 100}, gates=[("ok", F.col("ok") == 1)], disqualifiers=[("v", F.col("v") == 50)], penalties=[("always", F.lit(True), 10)])
    manual = spark.createDataFrame([("in", "x", 80.0)], "id string, criterion string, points double")
    got = {r.id: r for r in K.score(df, "id", product, manual).collect()}
    assert set(got) == {"in", "low"}  # gated rows aren't stored
    assert (got["in"].score, got["in"].status, got["in"].reason) == (70.0, "disqualified", "v")
    assert got["low"].score == 0.0  # clamped from below
    ranks = {r.id: r["rank"] for r in K.rank_lists(K.score(df, "id", product, manual), "id").collect()}
    assert ranks == {"in": None, "low": 1}


def test_negative_only_once_read(spark):
    df = spark.createDataFrame([(3, True), (None, True), (None, None)], "hits int, read boolean")
    got = [tuple(r.f) for r in df.select(K.tag_factor(F.col("hits"), F.col("read"), [(1, 50), (3, 100)], 10).alias("f")).collect()]
    assert [(p, k) for p, _, k in got] == [(100.0, True), (10.0, True), (0.0, False)]


def test_merge_verdict(spark):
    old = spark.createDataFrame([("m", "bank", 70, "manual"), ("a", "bank", 60, "model"), ("r", "bank", 60, "rules")], "id string, category string, confidence int, source string")
    new = spark.createDataFrame([("m", "fund", 90), ("a", "fund", 40), ("r", "fund", 55), ("n", "fund", 20)], "id string, category string, confidence int")
    got = {r.id: (r.category, r.confidence, r.source, r.changed) for r in C.merge_verdict(old, new, "id").collect()}
    assert got == {"m": ("bank", 100, "manual", True), "a": ("bank", 60, "model", False), "r": ("fund", 55, "rules", True), "n": ("fund", 20, "rules", True)}


def test_delta_equals_full_rewrite(spark):
    old = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "k int, v int")
    new = spark.createDataFrame([(1, 5), (2, 7), (4, None)], "k int, v int")
    d = N.delta_write(old, new, ["k"], ["v"])
    assert {r.k: r.change for r in d.collect()} == {1: "unchanged", 2: "updated", 3: "removed", 4: "added"}
    kept = old.join(d.filter("change <> 'unchanged'").select("k"), "k", "left_anti").union(d.filter("change in ('added', 'updated')").select("k", "v"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, new.collect()), key=str)


def test_segments_and_titles(spark):
    rows = [(None, 10.0, True), (0.0, None, False), (0.0, 5.0, False), (6.0, 10.0, False), (1.0, 10.0, False), (2e9, 1e11, False), (3.0, 10.0, False), (2e8, None, False)]
    df = spark.createDataFrame(rows, "v double, w double, s boolean")
    got = [r[0].segment for r in df.select(C.segment(F.col("v"), F.col("w"), F.col("s"))).collect()]
    assert got == ["sponsor", "ambiguous", "unraised", "competitor", "prospect", "ambiguous", "ambiguous", "competitor"]
    t = spark.createDataFrame([("Chief Compliance Officer",), ("SENIOR VICE PRESIDENT",), ("Vice Chair",)], "t string")
    assert [r[0] for r in t.select(C.title_matches(F.col("t"), "comp off, vice pres")).collect()] == [True, True, False]
    assert t.select(C.clean_title(F.col("t"), 12)).collect()[1][0] == "Senior Vice"
    tagged = C.designations(t, "t", [("exec", ["chief", "vice president"], ["compliance"])], {"svp": "senior vice president"})
    assert {r.t: r.tags for r in tagged.collect()}["SENIOR VICE PRESIDENT"] == ["exec"]
    assert {r.t: r.tags for r in tagged.collect()}["Chief Compliance Officer"] == []
