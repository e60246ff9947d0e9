"""Deep pages, cursors and the index of parts of names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from firmlens.operators import search as C


@pytest.fixture(scope="module")
def firms(spark):
    rng = random.Random(11)
    some = lambda *xs: rng.choice([None, *xs])
    rows = [(i, some(*range(5)), some(*range(30)), some(1, 2), some(-1, 0, 3), some(7, 8), some("2024-01-01", "2024-02-01"), some("Ab", "ab", "Cy Émile", "Zed")) for i in range(700)]
    return spark.createDataFrame(rows, "crd int, score int, raum int, hires_12m int, net_12m int, iar_count int, last_signal string, legal_name string"), rows


def in_order(rows, names, sort):
    def place(r):
        out = []
        for c, down in sort:
            v = r[names.index(c)]
            out.append((v is None, 0 if v is None else v if not down else [-ord(x) for x in v] if isinstance(v, str) else -v))
        return (*out, r[0])

    return sorted(rows, key=place)


@pytest.mark.parametrize("name", [*C.SORTS, "no such order"])
def test_pages_and_cursors_are_the_sorted_rows(spark, firms, name):
    df, rows = firms
    sort = C.sort_spec(name)
    want = [r[0] for r in in_order(rows, df.columns, sort)]
    pages = C.Pages(df, sort, "crd", ranges=6)
    for number, per in ((1, 50), (7, 90), (8, 90), (9, 90), (2, 350), (1, 1000)):
        got = pages.page(number, per)
        assert [r.crd for r in got.collect()] == want[(number - 1) * per : number * per] and got.columns == df.columns
    last, seen = None, []
    for _ in range(4):
        part = C.after(df, sort, "crd", last, 220).collect()
        seen += [r.crd for r in part]
        last = part[-1].asDict() if part else last
    assert seen == want
    assert pages.total == 700 and len(pages.begins) > 1


def test_a_deep_page_has_no_limit_of_all_rows_before_it(spark, firms):
    df, _ = firms
    deep = C.page(df, C.SORTS["aum"], "crd", 12, 50, shallow=100)
    plan = deep._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "Offset" not in plan
    assert [r.crd for r in deep.collect()] == [r.crd for r in C.page(df, C.SORTS["aum"], "crd", 12, 50).collect()]
    pages = C.Pages(df, C.SORTS["aum"], "crd", ranges=6)
    read = {f.split("_range=")[1].split("/")[0] for f in pages.page(12, 50).inputFiles()}
    assert 1 <= len(read) <= 6
    scan = pages.page(12, 50)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_range" in scan


def test_index_gives_what_a_scan_gives(spark, tmp_path):
    rng = random.Random(5)
    words = ["Acme", "capital", "CAPITAL", "Ñandú", "first", "x", "of", "Zz", "ana", "banana", "%_[", "日本語名"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 5)))) for i in range(400)] + [(900, None), (901, "ab"), (902, "Only Quizzical here")]
    df = spark.createDataFrame(rows, "id long, title string")
    index = C.TextIndex.build(df, "id", "title", str(tmp_path / "i"), buckets=8)
    for q in ("acme", "CAP", "ital fi", "na Ña", "banana banana", "ab", "", "x", "quizzical", "nowhere", "%_[", "本語名", "e c", "acme nowhere"):
        want = sorted(i for i, t in rows if t is not None and q.lower() in t.lower())
        assert sorted(r.key for r in index.search(q).collect()) == want, q
    assert index.rarest("Quizzical here") == " he" and index.rarest("acme nowhere") is None
    got, said = C.search(df, {"q": index.filter_by("id")}, {"q": "Banana"})
    assert sorted(r.id for r in got.collect()) == sorted(i for i, t in rows if t and "banana" in t.lower()) and said == ["q: Banana"]
    # one bucket of eight is read, and only the piece's rows pass the scan
    plan = index.search("quizzical")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "EqualTo(piece" in plan or "In(piece" in plan
    empty = C.TextIndex.build(df.limit(0), "id", "title", str(tmp_path / "e"), buckets=2)
    assert empty.search("acme").count() == 0


def test_every_filter_of_the_universe(spark):
    """Each of the filters alone and all pairs at random against plain conditions."""
    rng = random.Random(17)
    some = lambda *xs: rng.choice([None, *xs])
    firms = [(i, some("Acme", "Beta Co", "gamma"), some("ACME x", "Delta"), some("Austin", "Boston"), some("TX", "NY"), some(0, 10, 100, 1000), some(0, 5, 90), some(1, 5, 9), some("SEC", "STATE"), some(True, False), some(0, 2, 4), some(0, 1, 3), some("", "ann", "bob"), some("lead", "customer")) for i in range(160)]
    base = spark.createDataFrame(firms, "crd int, legal_name string, business_name string, city string, state string, raum int, hnw_aum int, iar_count int, regulator string, private_funds boolean, hires_12m int, departures_12m int, owner string, status string")
    cell = lambda n, *choices: [(rng.randrange(160), *(rng.choice(c) for c in choices)) for _ in range(n)]
    data = {
        "scores": (cell(150, ["a", "b"], ["scored", "gated"], [None, 10, 60, 90], [None, 50, 95]), "product string, status string, score int, coverage int"),
        "scope": ([(i,) for i in range(0, 160, 3)], ""),
        "mail": (cell(90, ["m365", "google"]), "platform string"),
        "tags": (cell(150, ["platform_orion", "x", "y"], [True, False, None]), "tag string, present boolean"),
        "site": (cell(60, ["platform_orion", "x", "z"]), "signal string"),
        "custodians": (cell(90, ["Schwab One", "fidelity", None]), "custodian string"),
        "contacts": (cell(200, ["email", "phone"], [None, "", "p"], [None, True, False], [50, 60, 90], [None, "valid", "invalid"]), "kind string, person string, is_role boolean, confidence int, verify_status string"),
        "triggers": (cell(120, ["hire", "move"], ["2024-01-05", "2024-05-20", "2024-05-31"], [None, True, False]), "trigger_type string, date string, suppressed boolean"),
        "filers": (cell(60, ["auto", "confirmed", "rejected"]), "status string"),
    }
    tables = {name: spark.createDataFrame(rows, "crd int" + (", " + kind if kind else "")) for name, (rows, kind) in data.items()}
    tables["triggers"] = tables["triggers"].withColumn("date", F.to_date("date"))
    filters = C.universe_filters("crd", tables, F.lit("2024-06-01").cast("date"), "ann")
    has = lambda name, test: {r[0] for r in data[name][0] if test(*r[1:])}
    low = lambda x: (x or "").lower()
    col = {c: k for k, c in enumerate(base.columns)}
    on = lambda c, test: {r[0] for r in firms if r[col[c]] is not None and test(r[col[c]])}
    everyone = {r[0] for r in firms}
    uses = lambda names: has("tags", lambda t, p: t in names and p) | has("site", lambda s: s in names)
    cases = [
        ({"product": "a"}, has("scores", lambda p, s, x, c: p == "a" and s == "scored")),
        ({"product": "a", "min_score": 60, "min_coverage": 90, "on_lists": True}, has("scores", lambda p, s, x, c: p == "a" and s == "scored" and (x or 0) >= 60 and (c or 0) >= 90)),
        ({"on_lists": True}, has("scope", lambda: True)), ({"min_score": 50}, everyone), ({"states": [" texas ", "", "ny"]}, on("state", lambda v: v in ("TE", "NY"))), ({"states": [" "]}, everyone),
        ({"city": "bos"}, on("city", lambda v: "bos" in v.lower())), ({"name": "acme"}, {r[0] for r in firms if "acme" in low(r[1]) or "acme" in low(r[2])}), ({"min_aum": 100}, on("raum", lambda v: v >= 100)), ({"max_aum": 100}, on("raum", lambda v: v <= 100)),
        ({"min_hnw_share": 50}, {r[0] for r in firms if (r[5] or 0) > 0 and (r[6] or 0) / r[5] >= 0.5}), ({"min_hnw_share": 0.05}, {r[0] for r in firms if (r[5] or 0) > 0 and (r[6] or 0) / r[5] >= 0.05}),
        ({"min_advisors": 5}, on("iar_count", lambda v: v >= 5)), ({"max_advisors": 5}, on("iar_count", lambda v: v <= 5)), ({"mail_platform": "google"}, has("mail", lambda p: p == "google")),
        ({"reporting_platform": "Orion"}, uses(["platform_orion"])), ({"reporting_platform": "None"}, everyone), ({"custodian": "SCHWAB"}, has("custodians", lambda c: "schwab" in low(c))), ({"platforms_any": ["x", "z"]}, uses(["x", "z"])),
        ({"brochure_tags": ["x", "y"]}, has("tags", lambda t, p: t == "x" and p) & has("tags", lambda t, p: t == "y" and p)),
        ({"has_personal_email": True}, has("contacts", lambda k, p, r, c, v: k == "email" and p and not r and c >= 60 and v != "invalid")), ({"has_personal_email": False}, everyone), ({"has_verified_email": True}, has("contacts", lambda k, p, r, c, v: k == "email" and v == "valid")),
        ({"min_hires_12m": 2}, on("hires_12m", lambda v: v >= 2)), ({"min_departures_12m": 3}, on("departures_12m", lambda v: v >= 3)),
        ({"signal_types": ["hire"]}, has("triggers", lambda t, d, s: t == "hire" and not s and d >= "2024-03-03")), ({"signal_days": 5}, has("triggers", lambda t, d, s: not s and d >= "2024-05-27")), ({"signal_days": 5, "signal_types": ["move"]}, has("triggers", lambda t, d, s: t == "move" and not s and d >= "2024-05-27")),
        ({"registration": "SEC"}, on("regulator", lambda v: v == "SEC")), ({"registration": "other"}, everyone), ({"private_funds": False}, on("private_funds", lambda v: not v)), ({"private_funds": True}, on("private_funds", lambda v: v)),
        ({"files_13f": True}, has("filers", lambda s: s != "rejected")), ({"files_13f": False}, everyone - has("filers", lambda s: s != "rejected")),
        ({"owner": "me"}, on("owner", lambda v: v == "ann")), ({"owner": "Nobody"}, {r[0] for r in firms if not r[12]}), ({"owner": "BO"}, on("owner", lambda v: "bo" in v)), ({"status": "lead"}, on("status", lambda v: v == "lead")), ({"status": None, "city": "", "states": []}, everyone),
    ]
    names = {k for spec, _ in cases for k in spec}
    assert len(names) == 28
    out, plain = None, list(cases)
    for k, (spec, want) in enumerate(cases):
        other, more = rng.choice(plain)
        both = C.settled(spec | other) if not set(spec) & set(other) and "product" not in other | spec else C.settled(spec)
        if both != C.settled(spec):
            want = want & more
        found, _ = C.search(base, filters, both)
        part = found.select(F.lit(k).alias("case"), "crd")
        out = part if out is None else out.union(part)
        cases[k] = spec, want, both
    got = {}
    for r in out.collect():
        got.setdefault(r.case, []).append(r.crd)
    for k, (spec, want, both) in enumerate(cases):
        assert sorted(got.get(k, [])) == sorted(want), both
