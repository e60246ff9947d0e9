"""Names, people, conventions and contacts on hand-made rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmlens.functions import names as N
from firmlens.operators import contacts as P, resolve as R


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


def test_org_key(spark):
    key = lambda s: one(spark, N.org_key(F.col("n")), n=s)
    assert key("The Acme, Inc.") == "ACME" and key("Acme Co. LLC") == "ACME" and key("INC") == "INC" and key("A.B.C. Corp") == "ABC"


def test_parse_name(spark):
    parse = lambda s: tuple(one(spark, N.parse_name(F.col("n")), n=s))
    assert parse("SMITH, JOHN, Q") == ("JOHN", "Q", "SMITH")
    assert parse('John "Jack" Smith, CFA') == ("JOHN", None, "SMITH")
    assert parse("Dr. María del Río Jr.") == ("MARIA", "DEL", "RIO")
    assert [one(spark, N.double_surname(F.col("n")), n=x) for x in ("Ana Garcia Lopez", "Ann Ray")] == ["GARCIALOPEZ", None]


def test_dates_places_hosts(spark):
    date = lambda s: str(one(spark, N.parse_date(F.col("d")), d=s))
    assert [date(x) for x in ("2020-03-04", "3/4/2020", "3-4-2020", "03/2020", "x")] == ["2020-03-04"] * 3 + ["2020-03-01", "None"]
    assert one(spark, N.place_key(F.col("c"), F.col("s")), c="St. Louis", s="mo") == "SAINT LOUIS|MO"
    assert one(spark, N.place_key(F.col("c"), F.col("s")), c="Paris", s="France") is None
    assert one(spark, N.host(F.col("u")), u="WWW.Example.com/x") == "example.com"
    show = lambda n: one(spark, N.display_name(F.col("n")), n=n)
    assert show("BANK OF O'NEIL MCDONALD LLC") == "Bank of O'Neil McDonald LLC"
    assert [show(x) for x in ("eBay", "PGIM", "CONSULTING,LLC", "UBS SUN CAPITAL, INC.", "A.B.C. TRUST")] == ["eBay", "PGIM", "Consulting, LLC", "UBS Sun Capital, Inc.", "A.B.C. Trust"]
    assert show(None) is None
    shown = {"AIM ADVISORS": "Aim Advisors", "GEM CAPITAL": "Gem Capital", "ÉLAN MÜLLER": "Élan Müller", "THE BANK OF THE WEST": "The Bank of the West", "ST. LOUIS TRUST CO.": "St. Louis Trust Co.", "L.L.C. XZQW PLLC": "L.L.C. XZQW PLLC", "": "", "3M 42": "3M 42", "AEGON USA": "AEGON USA", "(OF) LEE": "(Of) Lee"}
    assert {x: show(x) for x in shown} == shown
    assert one(spark, N.name_key(F.col("n")), n=" 田中 ") == "田中"
    assert [one(spark, N.name_key(F.col("n")), n=x) for x in ("RAY, ANN", "Ray", "", None)] == ["ann ray", None, None, None]


def test_match_people(spark):
    roster = spark.createDataFrame([("1", "o", "robert", "q", "lee", True), ("2", "o", "roberta", None, "lee", False), ("3", "o", "ann", None, "ray", True)], "person string, org string, first string, middle string, last string, current boolean")
    names = spark.createDataFrame([("a", "o", "Bob", None, "Lee"), ("b", "o", "R", None, "Lee"), ("c", "o", "Ann", None, "Ray"), ("d", "x", "Ann", None, "Ray")], "name_id string, org string, first string, middle string, last string")
    got = {r.name_id: r.person for r in R.match_people(names, roster, "org", [("bob", "robert")]).collect()}
    assert got == {"a": "1", "b": "1", "c": "3"}


def test_match_people_rules(spark):
    schema = "person string, org string, first string, middle string, last string, current boolean, other_names array<string>"
    roster = spark.createDataFrame(
        [
            ("1", "o", "James", None, "Smith", True, None),
            ("2", "o", "J", "Michael", "Stone", False, None),
            ("3", "o", "Ann", "Q", "de la Cruz-Lopez", True, None),
            ("4", "o", "Maria", None, "Novak", False, ["Mary Jones"]),
            ("5", "p", "Tom", "A", "Reed", True, None),
            ("6", "p", "Tom", "B", "Reed", True, None),
            ("7", "p", "Tom", None, None, True, None),
        ],
        schema,
    )
    names = spark.createDataFrame(
        [
            ("a", "o", "John", None, "Smith"),  # another first name of the same initial is nobody
            ("b", "o", "Michael", None, "Stone"),  # by the middle name
            ("c", "o", "Ann", None, "Lopez"),  # a shared word of the surname
            ("d", "o", "Mary", None, "Jones"),  # an alias
            ("e", "p", "Tom", None, "Reed"),  # two of the name
            ("f", "p", "Tom", "A", "Reed"),
            ("g", "p", "Tom", "C", "Reed"),  # another middle name
            ("h", "p", None, None, None),
        ],
        "name_id string, org string, first string, middle string, last string",
    )
    got = {r.name_id: (r.person, r.score) for r in R.match_people(names, roster, "org").collect()}
    assert got == {"b": ("2", 4.0), "c": ("3", 5.5), "d": ("4", 5.75), "f": ("5", 7.5)}


def test_eligibility_nulls(spark):
    people = spark.createDataFrame([(1, None, "x@a", None), (2, None, "y@a", None), (3, "i", "z@a", None), (4, "i", "w@a", None), (5, "j", "x@a", None), (6, "k", None, None)], "row int, ind string, addr string, suppressed_by string")
    history = spark.createDataFrame([], "ind string, sent_on date")
    got = {r.row: r.reason for r in P.eligibility(people, "row", "ind", "addr", [F.asc("row")], history, 30, F.lit("2024-01-01").cast("date")).collect()}
    assert got == {1: "eligible", 2: "eligible", 3: "eligible", 4: "individual already in this batch", 5: "address already in this batch", 6: "no address"}


def test_learn_pattern_and_ambiguity(spark):
    pairs = spark.createDataFrame([("o", "Ann", "Ray", "aray@x.com"), ("o", "Bob", "Lee", "blee@x.com"), ("o", "Cy", "Fox", "cy@x.com")], "org string, f string, l string, a string")
    assert tuple(R.learn_pattern(pairs, "org", "f", "l", "a").first()) == ("o", "flast", 2)


def test_contacts(spark):
    raw = spark.createDataFrame([("e", "p", "email", " Mailto:Ann@X.com "), ("e", None, "phone", "+1 (212) 555-0100 ext 4"), ("e", None, "email", "info@x.com"), ("e", "p", "phone", "12")], "entity string, person string, kind string, value string")
    got = {(r.kind, r.value, r.is_role) for r in P.normalise_contacts(raw).collect()}
    assert got == {("email", "ann@x.com", False), ("phone", "2125550100", False), ("email", "info@x.com", True)}
    cols = "entity string, person string, kind string, value string, confidence int, source string, label string, title string, seen int"
    a = spark.createDataFrame([("e", "p", "email", "a", 50, "web", None, "CFO", 1)], cols)
    b = spark.createDataFrame([("e", "p", "email", "a", 80, "feed", "work", None, 2), ("e", None, "email", "a", 90, "web", None, None, 3)], cols)
    rows = P.drop_firm_copies(P.merge_contacts(a, b)).collect()
    assert [(r.confidence, r.source, r.sources, r.label, r.title) for r in rows] == [(80, "feed", ["feed", "web"], "work", "CFO")]


def test_suppress_order(spark):
    people = spark.createDataFrame([(1, "f", "p"), (2, "f", None)], "row int, firm string, person string")
    listed = spark.createDataFrame([("person", "p", None), ("firm", "f", "2020-01-01")], "scope string, value string, lifted_at string")
    got = {r.row: r.suppressed_by for r in P.suppress(people, listed, {"firm": "firm", "person": "person"}, "row").collect()}
    assert got == {1: "person", 2: None}


def test_officer_titles_in_all_scripts(spark):
    roster = spark.createDataFrame([(1, "o", "Núñez", "Ana"), (2, "o", "Nuñez", "Ana"), (3, "o", "Иванов", "Пётр"), (4, "o", None, "Ana"), (5, "o", "Lee", "")], "i int, org string, last string, first string")
    officers = spark.createDataFrame([("o", "NÚÑEZ, ANABEL, M", "CFO"), ("o", "ИВАНОВ, ПЁТР", "CEO"), ("o", "LEE", "x"), ("o", None, "y")], "org string, name string, title string")
    assert {r.i: r.officer_title for r in R.officer_titles(roster, officers, "org").collect()} == {1: "CFO", 2: None, 3: "CEO", 4: None, 5: None}
