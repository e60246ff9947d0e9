"""Stints, movement, growth, decay and joins on hand-made rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from firmlens.operators import joins as J, signals as S, timeline as L

D = dt.date.fromisoformat


def test_stints_gap_open_and_undated(spark):
    rows = [("p", "o", D("2020-01-01"), D("2020-02-01"), False), ("p", "o", D("2020-05-01"), D("2020-06-01"), False), ("p", "o", D("2020-08-31"), None, True), ("q", "o", D("2020-01-01"), None, False), ("r", "o", None, None, False)]
    got = {(r.p, r.start_date, r.end_date, r.n) for r in L.stints(spark.createDataFrame(rows, "p string, o string, start_date date, end_date date, cur boolean"), ["p", "o"], current="cur").collect()}
    # 90 days on 2020-05-01, 91 days later: a new stint
    assert got == {("p", D("2020-01-01"), D("2020-06-01"), 2), ("p", D("2020-08-31"), None, 1), ("q", D("2020-01-01"), D("2020-01-01"), 1), ("r", None, None, 1)}


def test_order_of_rows_never_matters(spark):
    rows = [("p", "o", D("2020-01-01"), D("2020-02-01")), ("p", "o", D("2020-03-01"), D("2020-03-05")), ("p", "b", D("2020-02-10"), D("2020-02-20")), ("p", "c", D("2020-02-10"), D("2020-02-20"))]
    schema = "p string, o string, s date, e date"
    a, b = (sorted(map(str, L.came_from(spark.createDataFrame(x, schema), "p", "o", "s", "e").collect())) for x in (rows, rows[::-1]))
    assert a == b


def test_growth_edges(spark):
    df = spark.createDataFrame([(0.0, 100.0, 500), (50.0, 0.0, 300), (-1.0, 5.0, 300), (121.0, 100.0, 730), (110.0, 100.0, 365)], "now double, before double, days int")
    got = [r[0] for r in df.select(L.growth_rate(F.col("now"), F.col("before"), F.col("days"))).collect()]
    assert got == [-1.0, None, None, 0.1, 0.1]


def test_decay_clamps_future_dates(spark):
    df = spark.createDataFrame([(D("2030-01-01"),), (D("2020-01-01"),), (D("2000-01-01"),)], "d date")
    got = [round(r[0], 4) for r in df.select(S.decay("d", F.lit("2020-01-31").cast("date"), 30, 0.1)).collect()]
    assert got == [1.0, 0.5, 0.1]


def test_dominant_ties_by_id(spark):
    df = spark.createDataFrame([("e", "d", "b", 5), ("e", "d", "a", 5)], "e string, d string, c string, v int")
    assert S.dominant(df, ["e", "d"], "c", "v").first().c == "a"


def test_multi_scope_and_nulls(spark):
    df = spark.createDataFrame([(1, "f", None), (2, "g", "x"), (3, None, None)], "id int, firm string, email string")
    listed = spark.createDataFrame([("firm", "f"), ("email", "x"), ("firm", "x")], "scope string, value string")
    got = {r.id: r.scopes_hit for r in J.multi_scope_join(df, {"firm": "firm", "email": "email"}, listed, "id").collect()}
    assert got == {1: ["firm"], 2: ["email"], 3: None}


def test_latest_before_is_strict(spark):
    left = spark.createDataFrame([("k", 5), ("k", 1)], "k string, t int")
    right = spark.createDataFrame([("k", 5, "same"), ("k", 3, "three"), ("k", 2, "two")], "k string, u int, v string")
    got = {r.t: r.before_v for r in J.latest_before(left, right, "k", "t", "u", ["v"]).collect()}
    assert got == {5: "three", 1: None}


def test_active_and_last_start(spark):
    spans = spark.createDataFrame([("p", D("2019-01-01"), D("2020-06-01")), ("p", D("2020-03-01"), None)], "p string, s date, e date")
    got = sorted((r.s, str(r.day)) for r in J.active_at(spans, ["2019-12-31", "2020-12-31"], "s", "e", "day").collect())
    assert got == [(D("2019-01-01"), "2019-12-31"), (D("2020-03-01"), "2020-12-31")]
    events = spark.createDataFrame([("p", D("2018-01-01")), ("p", D("2020-03-01")), ("p", D("2020-03-01")), ("q", D("2020-01-01"))], "p string, at date")
    found = sorted((r.p, r.at, str(r.span_start)) for r in J.last_start_before(events, spans, ["p"], "at", "s").collect())
    assert found == [("p", D("2018-01-01"), "None"), ("p", D("2020-03-01"), "2020-03-01"), ("p", D("2020-03-01"), "2020-03-01"), ("q", D("2020-01-01"), "None")]
