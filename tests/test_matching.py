"""Class rows of matches, beginnings of names and one-to-one assignment against brute force."""

from __future__ import annotations

import collections
import random

from pyspark.sql import functions as F

from firmlens.operators import joins as J, resolve as R
from firmlens.sources import feeds as A


def test_classes_hold_the_pairs_of_the_match(spark):
    rng = random.Random(6)
    schema = "id long, exact_key string, generic_key string, state string"
    side = lambda n: [(i, rng.choice(["", None, *(f"e{k}" for k in range(25))]), rng.choice(["", None, "hot", "hot", *(f"g{k}" for k in range(12))]), rng.choice([None, "NY", "CA", "TX"])) for i in range(n)]
    for n_left, n_right in ((60, 50), (8, 90), (90, 8)):
        left, right = spark.createDataFrame(side(n_left), schema).withColumnRenamed("id", "a"), spark.createDataFrame(side(n_right), schema).withColumnRenamed("id", "b")
        pairs = R.match_entities(left, right, "a", "b").collect()
        rows = R.match_classes(left, right, "a", "b").collect()
        got, want = collections.Counter(), collections.Counter()
        for r in rows:
            got[r.method, r.confidence, r.status] += r.n_left * r.n_right
        for r in pairs:
            want[r.method, r.confidence, r.status] += 1
        assert got == want
        ids = {(r.a, r.b): (r.method, r.confidence, r.status) for r in pairs}
        for r in rows:
            assert (r.left_id is None) == (r.right_id is None) and (r.left_id is None or ids[r.left_id, r.right_id] == (r.method, r.confidence, r.status))
        # members of a class: the rows of its key and state, by relation
        states = {r.b: r.state for r in right.collect()}
        own = {r.a: r.state for r in left.collect()}
        keys = {"exact": {r.a: r.exact_key for r in left.collect()}, "generic": {r.a: r.generic_key for r in left.collect()}}
        seen = collections.Counter()
        for r in pairs:
            relation = "unknown" if own[r.a] is None or states[r.b] is None else "agree" if own[r.a] == states[r.b] else "conflict"
            seen[r.method, keys[r.method][r.a], own[r.a], relation] += 1
        have = collections.Counter()
        for r in rows:
            have[r.method, r.key, r.left_state, r.relation] += r.n_left * r.n_right
        assert have == seen


def test_class_rows_with_a_key_that_a_tenth_shares(spark):
    n = 5000
    side = lambda name: spark.range(n).select(F.col("id").alias(name), F.lit("").alias("exact_key"), F.when(F.col("id") % 10 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id").cast("string"))).alias("generic_key"), (F.col("id") % 7).cast("string").alias("state"))
    out = R.match_classes(side("a"), side("b"), "a", "b").cache()
    assert out.count() == n * 9 // 10 + 14  # seven states agree and conflict; the product would have 250,000 rows of the key
    assert out.filter("key = 'hot'").agg(F.sum(F.col("n_left") * F.col("n_right"))).first()[0] == 500 * 500


def test_offerings_by_every_beginning(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["FIRST", "CAPITAL", "FUND", "II", "STREET"])
    notices = [(i, " ".join(word() for _ in range(rng.randrange(1, 6))), f"20{rng.randrange(10, 20)}-01-01") for i in range(120)] + [(900, "", "2030-01-01"), (901, None, "2030-01-01")]
    queries = [(i, " ".join(word() for _ in range(rng.randrange(1, 4)))) for i in range(60)] + [(70, ""), (71, None), (72, "NOBODY")]
    got = {r.query_id: (r.notice_id, r.exact, r.filed) for r in A.match_offerings(spark.createDataFrame(queries, "query_id int, name string"), spark.createDataFrame(notices, "notice_id int, name string, filed string")).collect()}
    want = {}
    for q, name in queries:
        met = [(n != name, [-ord(c) for c in d], i, d) for i, n, d in notices if name and n and (n == name or n.startswith(name + " "))]
        if met:
            best = min(met)
            want[q] = (best[2], not best[0], best[3])
    assert got == want and len(want) > 30


def test_prefix_rows_are_in_proportion(spark):
    n = 2000
    names = spark.range(n).select("id", F.concat(F.lit("FIRST CAPITAL "), F.col("id").cast("string")).alias("name"))
    assert J.prefix_table(names, "name", [F.asc("id")]).count() == n + 2


def test_history_orgs_by_prefix(spark):
    regs = spark.createDataFrame([("p", "alpha beta gamma", "1"), ("p", "alpha beta", "2"), ("p", "delta", "3"), ("q", "delta one two", "4"), ("q", "delta one three", "5"), (None, "delta", "6")], "person string, name string, org string")
    rows = [("p", "alpha beta"), ("p", "alpha"), ("p", "alpha beta gamma"), ("p", "delta"), ("q", "delta"), ("q", "delta one"), ("q", "delta one t"), ("q", None), (None, "delta")]
    out = R.resolve_history_org(spark.createDataFrame([(*r, None) for r in rows], "person string, name string, org string"), regs, "person", "name", "org").collect()
    assert {(r.person, r.name): r.org for r in out} == dict(zip(rows, ["2", None, "1", "3", None, "4", None, None, None]))


def one_to_one(edges):
    """Rounds of mutual only-best over {(a, b): score}."""
    edges, out = dict(edges), {}
    while True:
        best = {}
        for side in (0, 1):
            for e, s in edges.items():
                top, who = best.get((side, e[side]), (None, []))
                best[side, e[side]] = (s, [e]) if top is None or s > top else (top, [*who, e]) if s == top else (top, who)
        agreed = [e for e in edges if best[0, e[0]][1] == [e] and best[1, e[1]][1] == [e]]
        if not agreed:
            return out
        for e in agreed:
            out[e] = edges[e]
        a, b = {e[0] for e in agreed}, {e[1] for e in agreed}
        edges = {e: s for e, s in edges.items() if e[0] not in a and e[1] not in b}


def fits(slug, first, last, middle=None, nick=(("john", "jack"),)):
    import re
    import unicodedata

    plain = lambda x: "".join(c for c in unicodedata.normalize("NFD", (x or "").lower()) if not unicodedata.combining(c))
    only = lambda x: re.sub("[^a-z]", "", plain(x))
    words = [re.sub("[0-9]", "", w) for w in re.split("[^a-z0-9]+", plain(slug)) if not re.fullmatch("[0-9a-f]*[0-9][0-9a-f]*", w)]
    words = [w for w in words if w and w != "cfp"]
    f = only(first)
    givens = [g for g in {f, *(b for a, b in nick if a == f), *(a for a, b in nick if b == f)} if len(g) > 1]
    lasts = {x for x in (only(last), *(only(p) for p in (last or "").split("-") if len(only(p)) > 1)) if x}
    middles = [only(m) for m in (middle or "").split() if only(m)]
    faint = {x for x in (f[:1], *middles, *(m[0] for m in middles)) if x}
    best = 0
    for la in lasts:
        if len(words) > 1:
            spots = [({i}, w) for i, w in enumerate(words)] + [({i, i + 1}, words[i] + words[i + 1]) for i in range(len(words) - 1)]
            others = {words[i] for at, w in spots if w == la for i in range(len(words)) if i not in at}
            best = max(best, 2 if others & set(givens) else 1 if others & faint else 0)
        elif words:
            one = words[0]
            if any(one == la + g or (one.startswith(g) and one.endswith(la) and len(g) + len(la) <= len(one) <= len(g) + len(la) + 12) for g in givens):
                best = 2
            elif any(one in (m + la, la + m) for m in faint):
                best = max(best, 1)
    return best


def test_profiles_go_to_people_one_to_one(spark, tmp_path):
    from firmlens.core.scratch import Scratch

    rng = random.Random(23)
    orgs = [f"o{k}" for k in range(12)]
    firsts, lasts, middles = ["John", "Jack", "Jane", "José", "Al", "Smith", "J", None], ["Smith", "Lee", "van Dyke", "Núñez", "John", "Lee-Poe", "D'Arc", ""], [None, "Q", "Mary Lou"]
    people = [(rng.choice(orgs), i, rng.choice(firsts), rng.choice(lasts), rng.choice(middles)) for i in range(90)]
    people += [("x", 900 + i, "Ann", "Poe", None) for i in range(3)] + [("x", 950, "Amy", "Poe", None), (None, 960, "Ann", "Poe", None)]
    slugs = {(rng.choice(orgs), rng.choice([f"{a}-{b}", f"{b}-{a}-9a1", f"{a}{b}", f"{a[:1]}{b}", f"{b}{a[:1]}77", f"{a}-q-{b}-cfp", f"{a}quinn{b}", f"{a[:1]}-{b}-77", f"mary-{b}", f"james-{b}"])) for a in ("john", "jane", "jose", "al", "smith") for b in ("smith", "lee", "vandyke", "van-dyke", "nunez", "john", "d-arc") for _ in range(6)}
    slugs |= {("x", "ann-poe"), ("x", "amypoe"), ("x", "a-poe"), ("x", None), (None, "ann-poe"), ("x", ""), ("x", "123")}
    got = R.assign_profiles(spark.createDataFrame(sorted(slugs, key=str), "org string, slug string"), spark.createDataFrame(people, "org string, person int, first string, last string, middle string"), "org", Scratch(spark, "t"), middle="middle", nicknames=[("John", "Jack")]).collect()
    edges = {((o, s), (q, i)): n for o, s in slugs for q, i, f, l, m in people if o is not None and s is not None and o == q and (n := fits(s, f, l, m))}
    want = one_to_one(edges)
    assert {((r.org, r.slug), (r.org, r.person)): 2 if r.status == "matched" else 1 for r in got} == want
    assert len(want) > 15 and set(want.values()) == {1, 2}
    assert len({r.person for r in got}) == len(got) == len({(r.org, r.slug) for r in got})


def test_results_are_judged_and_no_url_serves_two(spark):
    from firmlens.core.scratch import Scratch

    people = spark.createDataFrame([(1, "Ann", "Lee", "Acorn Ridge Capital LLC", "acornridge.com"), (2, "Amy", "Lee", "Acorn Ridge Capital LLC", "acornridge.com"), (3, "Joel", "Stone", "Joel Stone & Co", None), (4, "Bo", "Ek", "Oak", "oak.com"), (5, None, "Ray", "Birchwood", "x.com")], "person int, first string, last string, firm string, domain string")
    results = spark.createDataFrame(
        [
            (1, "u1", "Ann Lee - Acorn Ridge", ""), (1, "u2", "Ann Lee", "partner at Acorn"), (2, "u1", "A. Lee - Acorn Ridge Capital", None), (2, "u3", "Amy Lee | Boston", "acornridge.com"), (3, "u4", "Joel Stone", "Joel Stone"),
            (4, "u5", "Bo Ek - Oak", None), (4, "u6", "Bo Ek", "nothing"), (5, "u7", "Ray at Birchwood", None), (1, "u8", "Ann Lee - Acorn Ridge", "taken"), (9, "u9", "Who", None), (1, None, "Ann Lee - Acorn Ridge", None),
        ],
        "person int, url string, title string, snippet string",
    )
    taken = spark.createDataFrame([("u8",)], "url string")
    got = {(r.person, r.url, r.status) for r in R.judge_results(results, people, taken, Scratch(spark, "t")).collect()}
    assert got == {(1, "u1", "matched"), (2, "u3", "probable"), (4, "u5", "probable")}


def test_mutual_best_against_rounds_by_hand(spark):
    from firmlens.core.scratch import Scratch

    rng = random.Random(31)
    rows = [(rng.randrange(25), rng.randrange(25), rng.randrange(60)) for _ in range(140)] + [(None, 1, 99), (1, None, 99)]
    edges = {}
    for a, b, s in rows:
        if a is not None and b is not None:
            edges[a, b] = max(s, edges.get((a, b), -1))
    got = {(r.a, r.b): r.score for r in R.mutual_best(spark.createDataFrame(rows, "a int, b int, score int"), Scratch(spark, "t")).collect()}
    assert got == one_to_one(edges) and len(got) > 8
    assert R.mutual_best(spark.createDataFrame([], "a int, b int, score int"), Scratch(spark, "t")).collect() == []
