"""Every registered query of the library against its SQL."""

from __future__ import annotations

import re
import struct

import pytest
import xxhash

from firmlens import plans
from firmlens.operators import text
from oracle import assert_same
from test_matching import fits, one_to_one

QUERIES, SQL = plans.queries(), plans.oracle_sql()


def test_sql_names_a_query():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) == sum(len(family.QUERIES) for family in plans._FAMILIES)  # no name twice


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), sf, SQL[name])


def test_queries_without_sql(spark):
    assert set(QUERIES) - set(SQL) == {"page_cards", "page_phones", "profile_choice", "sampled_keys"}  # each is tested below


def test_sampled_keys(spark, sf):
    got = sorted(r.o_custkey for r in QUERIES["sampled_keys"](spark, sf).collect())
    keys = {r.o_custkey for r in spark.read.parquet(f"{sf}/orders.parquet").collect()}

    def order(key):
        value = xxhash.xxh64(struct.pack("<i", 7), seed=xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()).intdigest()
        return value - (1 << 64 if value >> 63 else 0), key

    assert got == sorted(sorted(keys, key=order)[:50])


def test_page_cards(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    want = set()
    for r in pages:
        parser = text._Cards()
        parser.feed(r.html or "")
        groups = [(k, es) for k, es in parser.closed.items() if sum(bool(e["text"]) for e in es) >= 3]
        if groups:
            kind, found = max(groups, key=lambda g: (sum(len(" ".join(e["text"])) for e in g[1]), g[0]))
            want |= {(r.page_id, kind, " | ".join(e["text"]), e["href"]) for e in found if e["text"]}
    got = QUERIES["page_cards"](spark, sf).collect()
    low = lambda row: tuple(x.lower() if isinstance(x, str) else x for x in row)
    assert {low((r.page_id, r.kind, r.text, r.href)) for r in got} == {low(w) for w in want}
    assert len({(r.page_id, r.key) for r in got}) == len(got)


def test_page_phones(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        plain = re.sub(r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ", r.html or "")
        plain = re.sub("<[^>]*>", " ", re.sub("(?i)href=[\"']tel:([^\"']+)[\"']", r"> tel \1 <", plain))
        for m in re.finditer(f".{{0,24}}{text._PHONE}", plain):
            place = next((i for i, (_, p) in enumerate(text.PHONE_LABELS) if re.search(p, m.group(0).lower())), len(text.PHONE_LABELS))
            key = r.page_id, "".join(m.groups())
            want[key] = min(want.get(key, 99), place)
    names = [*(name for name, _ in text.PHONE_LABELS), "plain"]
    got = {(r.page_id, r.phone): r.label for r in QUERIES["page_phones"](spark, sf).collect()}
    assert got == {k: names[v] for k, v in want.items() if names[v] != "fax"}


def test_profile_choice(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet").collect()
    named = [(r.p_brand, r.p_partkey, r.p_name.split(" ")) for r in parts]
    slugs = {(b, f"{w[0]}-{w[-1]}" if k % 2 == 0 else w[0][0] + w[-1]) for b, k, w in named}
    edges = {((b, s), (b, k)): n for b, s in slugs for c, k, w in named if b == c and (n := fits(s, w[0], w[-1]))}
    got = {((r.org, r.slug), (r.org, r.person)): 2 if r.status == "matched" else 1 for r in QUERIES["profile_choice"](spark, sf).collect()}
    assert got == one_to_one(edges) and got


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
