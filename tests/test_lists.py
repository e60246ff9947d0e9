"""List filters, growth rows, officer titles and ranks on hand-made rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from firmlens.core.frames import cumulative, peer_median
from firmlens.operators import classify as C, resolve as R, scoring as K, search as S, timeline as L

D = dt.date.fromisoformat


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_firm_and_list_filters(spark):
    firms = spark.createDataFrame(
        [
            ("1", False, "SEC", "Acme Capital", None, "Troy", "NY", 100.0, "new", "me", 3),
            ("2", False, "STATE", "Beta", "Acme two", "Rome", "GA", 200.0, "customer", None, 0),
            ("3", True, "SEC", "Gamma", None, "Troy", "NY", None, None, "Ann Ray", None),
        ],
        "id string, is_exempt boolean, regulator string, legal_name string, business_name string, city string, state string, raum double, status string, owner string, hires_12m int",
    )
    scores = spark.createDataFrame([("1", "a", "scored"), ("2", "a", "disqualified")], "id string, product string, status string")
    members = spark.createDataFrame([("2", 7), ("2", 7)], "id string, list_id int")
    events = spark.createDataFrame([("e1", "1", D("2024-01-05"), None), ("e2", "2", D("2024-01-05"), True), ("e3", "3", D("2020-01-01"), False), ("e4", "2", D("2024-02-01"), False)], "event_id string, id string, date date, suppressed boolean")
    actions = spark.createDataFrame([("e4", "done"), ("e1", None)], "event_id string, state string")
    signals = S.open_signals(events, actions, "id", "2024-01-01")
    assert ids(signals) == ["1"]
    contacts = spark.createDataFrame(
        [("1", "email", "p", False, "pattern", "valid", None), ("2", "email", "p", False, "web", None, None), ("2", "phone", "p", False, "web", None, "direct"), ("3", "email", "", True, "web", None, None), ("3", "linkedin", "q", False, "web", None, None)],
        "id string, kind string, person string, is_role boolean, source string, verify_status string, label string",
    )
    classes = spark.createDataFrame([("3", "fund")], "id string, category string")
    filters = S.firm_filters("id", scores, members, signals, contacts, classes, me="me")
    find = lambda **spec: ids(S.search(firms, filters, spec)[0])
    assert find(q="acme") == ["1", "2"] and find(q="3") == ["3"] and find(q="troy") == ["1", "3"]
    assert find(register="ERA") == ["3"] and find(register="SEC") == ["1"] and find(register="all") == ["1", "2", "3"] and find(register="") == ["1", "2"]
    assert find(size=(100, 200)) == ["1"] and find(size=(100, None)) == ["1", "2"] and find(state="NY") == ["1", "3"]
    assert find(list="a") == ["1"] and find(list="any") == ["1"] and find(list="none") == ["2", "3"] and find(member_of=7) == ["2"]
    assert find(owner="none") == ["2"] and find(owner="me") == ["1"] and find(owner="ray") == ["3"]
    assert find(signal="open") == ["1"] and find(hires=1) == ["1"] and find(category="fund") == ["3"] and find(status="customer") == ["2"]
    assert [find(reach=r) for r in ("email", "verified", "phone", "linkedin", "none", "other")] == [["2"], ["1"], ["2"], ["3"], ["3"], ["1", "2", "3"]]
    rows = firms.join(spark.createDataFrame([("1", 95.0), ("2", 75.0), ("3", 10.0)], "id string, coverage double"), "id").withColumns({"product": F.lit("a"), "state_of_score": F.lit("scored")})
    postings = spark.createDataFrame([("2", True), ("1", False)], "id string, active boolean")
    listed = S.list_filters("id", signals, contacts, classes, postings)
    find = lambda **spec: ids(S.search(rows, listed, spec)[0])
    assert [find(coverage=c) for c in ("full", "most", "gaps", "")] == [["1"], ["1", "2"], ["3"], ["1", "2", "3"]]
    assert find(hiring=True) == ["2"] and find(hiring=False) == ["1", "2", "3"] and find(status="open") == ["1", "3"] and find(signal=True) == ["1"] and find(size=150) == ["2"] and find(product="b") == []


def test_people_filters(spark):
    people = spark.createDataFrame(
        [("1", "Ann Ray", "Acme", "NY", 5.0, True, False, D("2024-01-20"), True, False, False, 9.0, "ria", "roster", ["cfo"], "Chief Compliance Officer"), ("2", "Bob", "Beta", "GA", None, False, True, D("2020-01-01"), False, True, True, 1.0, "fund", "web", [], "Clerk")],
        "id string, name string, firm string, state string, priority double, is_leader boolean, is_officer boolean, start_date date, cfp boolean, cfa boolean, has_disclosure boolean, raum double, category string, src string, desig array<string>, title string",
    )
    scores = spark.createDataFrame([("2", "a", "scored")], "id string, product string, status string")
    filters = S.people_filters("id", scores, "2024-02-01", C.title_matches)
    find = lambda **spec: ids(S.search(people, filters, spec)[0])
    assert find(q="ray") == ["1"] and find(q="BETA") == ["2"] and find(on="any") == ["1"] and find(on="a") == ["2"]
    assert find(role="leader") == ["1"] and find(role="officer") == ["2"] and find(joined=30) == ["1"] and find(credential="cfa") == ["2"]
    assert find(disclosure=True) == ["2"] and find(size=5) == ["1"] and find(category="fund") == ["2"] and find(src="web") == ["2"]
    assert find(designations=["cfo", "ceo"]) == ["1"] and find(title="comp off") == ["1"]


def test_officer_titles(spark):
    roster = spark.createDataFrame([("o", "Annabel", "O'Neil"), ("o", "Bob", "Lee"), ("o", None, "Lee"), ("p", "Annabel", "O'Neil")], "org string, first string, last string")
    officers = spark.createDataFrame([("o", "ONEIL, ANN, B", "CFO"), ("o", "ONEIL, ANNA", "CEO"), ("o", "LEE", "X")], "org string, name string, title string")
    got = sorted(((r.org, r["first"], r.officer_title) for r in R.officer_titles(roster, officers, "org").collect()), key=str)
    assert got == [("o", "Annabel", "CEO"), ("o", "Bob", None), ("o", None, None), ("p", "Annabel", None)]


def test_known_entity(spark):
    df = spark.createDataFrame([("First Blue Bank",), ("First Blue",), ("Bluebank",), (None,), ("Fund 12",)], "name string")
    got = {r.name: (r.known_entity, r.known_strength) for r in R.known_entity(df, "name", [("b", "first blue"), ("a", "blue bank"), ("c", "first blue bank")], [("d", "fund [0-9]+")]).collect()}
    assert got == {"First Blue Bank": ("c", 1015), "First Blue": ("b", 1010), "Bluebank": (None, None), None: (None, None), "Fund 12": ("d", 11)}


def test_ranks_and_medians_over_ranges(spark):
    rows = [(f"e{i % 7}", float(i * 37 % 101), i) for i in range(500)] + [(None, 1.0, 1000)]
    df = spark.createDataFrame(rows, "k string, v double, id int").withColumn("n", F.lit(1).cast("long"))
    got = {r.id: r.at for r in cumulative(df, ["k"], [F.asc("v"), F.asc("id")], "n", "at").collect()}
    for key in {r[0] for r in rows}:
        for place, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])), 1):
            assert got[i] == place
    import statistics

    medians = {r.band: (r.n, r.peer_median) for r in peer_median(df, F.col("k"), "v", 2).collect()}
    for key in {r[0] for r in rows}:
        values = [r[1] for r in rows if r[0] == key]
        assert medians[key] == (len(values), statistics.median(values) if len(values) >= 2 else None)
    scores = spark.createDataFrame([("p", "scored", 5.0, 1.0, "a"), ("p", "scored", 5.0, None, "b"), ("p", "scored", 9.0, 0.0, "c"), ("q", "scored", 1.0, 1.0, "a"), ("q", "disqualified", 99.0, 1.0, "b")], "product string, status string, score double, coverage double, id string")
    ranks = {(r.product, r.id): r["rank"] for r in K.rank_lists(scores, "id").collect()}
    assert ranks == {("p", "c"): 1, ("p", "a"): 2, ("p", "b"): 3, ("q", "a"): 1, ("q", "b"): None}


def test_firm_growth(spark):
    firms = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    pairs = spark.createDataFrame([("a", 120.0, 100.0, 50.0, 50.0, 10.0, 8.0, 365)], "entity_id string, raum_now double, raum_before double, clients_now double, clients_before double, advisors_now double, advisors_before double, days int")
    team = spark.createDataFrame([("a", "p", "joined", D("2024-01-01")), ("a", "p", "joined", D("2024-01-02")), ("a", "q", "left", D("2022-06-01"))], "entity_id string, person string, kind string, date date")
    departed = spark.createDataFrame([("a", "x", 3.0, False), ("a", "y", None, True)], "entity_id string, name string, tenure double, senior boolean")
    veterans = spark.createDataFrame([("a", 1, 4)], "entity_id string, n30 int, people int")
    places = spark.createDataFrame([("a", "Troy", "NY")], "entity_id string, city string, state string")
    lifts = spark.createDataFrame([("a", "o", 3), ("a", "n", 3), ("a", "m", 5)], "entity_id string, org string, n int")
    events = spark.createDataFrame([("a", "aum_jump", D("2024-01-01")), ("a", "old", D("2010-01-01"))], "entity_id string, type string, date date")
    got = {r.entity_id: r for r in L.firm_growth(firms, pairs, team, departed, veterans, places, lifts, events, F.lit("2024-02-01").cast("date")).collect()}
    a, b = got["a"], got["b"]
    assert (a.raum_change, a.clients_rate, a.capacity_change) == (0.2, 0.0, -0.04)
    assert (a.joined_12m, a.left_12m, a.left_prior_12m, a.net_12m) == (1, 0, 1, 1)
    assert [x.name for x in a.departures] == ["y", "x"] and (a.n_departures, a.departures_senior, a.veteran_share) == (2, 1, 0.25)
    assert [x.org for x in a.lift_outs] == ["m", "n", "o"] and a.n_events == 1 and [x.city for x in a.locations] == ["Troy"]
    assert (b.raum_change, b.departures, b.n_departures, b.net_12m) == (None, None, 0, 0)
