"""Frames of sites, phones and titles outside of them, against hand-made pages and brute force over the given ones."""

from __future__ import annotations

import collections
import re

import pytest
from pyspark.sql import functions as F

from firmlens.operators import sites as S


def page(body, top="<nav><a href='/'>Home</a> Call 212-555-0100</nav>", bottom="<footer>&copy; Acme <a href='tel:1-800-555-0111'>line</a></footer>"):
    return f"<html><head><script>var x = '<p>415-555-0000</p>';</script></head><body>{top}<div class='ad'>Now {len(body)}</div><div>Our   office:\n617-555-0142</div>{body}{bottom}</body></html>"


PAGES = [
    (1, "http://www.acme.com/a", page("<p>Direct: 415-555-0101 or fax 415-555-0102.</p><p>Mobile (415) 555-0103, ext. 12</p><p>415-555-0103</p>")),
    (2, "http://acme.com/b", page("<p>d: 415-555-0101 c. 415-555-0104</p><li>212-555-0100 x77</li><p>800.555.0199</p><p>Cell 415-555-0102 f: 415-555-0102</p>")),
    (3, "http://acme.com/c", page("<h3>Client Service Associate</h3><td>415-555-0105 (direct)</td><td>Tel 415-555-0106 Mobile 415-555-0107</td>")),
    (4, "http://other.com/", "<p>Call 617-555-0142</p><p>main 617-555-0142</p>"), (5, None, "<p>617-555-0142</p>"), (6, "http://acme.com/d", None), (7, "http://other.com/x", ""),
]


@pytest.fixture(scope="module")
def cut(spark):
    pages = spark.createDataFrame(PAGES, "page_id int, url string, html string")
    whole = S.cut_pages(pages)
    return S.split_frame(whole, S.site_frames(whole)), pages


def test_frame_is_what_pages_share(spark, cut):
    rows = {r.page_id: r for r in cut[0].collect()}
    assert len(rows) == 7 and rows[6].body == [] and rows[7].body == [] and rows[5].site is None
    assert rows[1].body[0].startswith("Now") and "Our office: 617-555-0142" in rows[1].framing and rows[1].framing[-1].startswith("&copy;")
    assert rows[1].body[1] == "Direct: 415-555-0101 or fax 415-555-0102."
    assert rows[4].body == ["Call 617-555-0142", "main 617-555-0142"]  # two pages are no site of a frame
    assert not any("415-555-0000" in x for r in rows.values() for x in r.body + r.framing)


def test_phones_outside_the_frame(spark, cut):
    got = {(r.page_id, r.number, r.extension): r.label for r in S.site_phones(cut[0]).collect()}
    assert got == {
        (1, "4155550101", None): "direct", (1, "4155550103", "12"): "mobile",  # the bare number is behind the extension; the fax is out
        (2, "4155550101", None): "direct", (2, "4155550104", None): "mobile", (2, "2125550100", "77"): None, (2, "8005550199", None): "toll_free",
        (3, "4155550105", None): "direct", (3, "4155550106", None): "office", (3, "4155550107", None): "mobile",
        (4, "6175550142", None): "office", (5, "6175550142", None): None,
    }


def test_titles(spark):
    good = ["Client Service Associate", "Chief Compliance Officer", "Senior Vice President", "Paraplanner", "Head of Tax & Trust", "Lead Advisor, Boston", "Operations Associate, Trading"]
    bad = ["Tax Planning", "Meet our advisors", "Independent Advisors", "Internships", "Become a Financial Advisor", "Gregg JohnsonNational Sales Director", "Jane Smith, Client Service Associate", "We hire an analyst.", "If you are an analyst", "Guide and inspire clients as planners do daily", "analyst@acme.com", "See www.acme.com analyst", "CSA", "Advisor " + "x" * 90, "Associate a b c d e f g h i j k", "Contact an advisor", "401 assistance Advisor", ""]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", S.is_title(F.col("t")).alias("ok"))
    assert {r.t: r.ok for r in df.collect()} == {**dict.fromkeys(good, True), **dict.fromkeys(bad, False)}


def test_roles_of_pages(spark, cut):
    data = '<script>window.x = {"jobs": [{"jobTitle": "Tax \\u0026 Trust Associate"}, {"PostingTitle" : "Senior \\"Quant\\" Analyst"}, {"jobTitle":"About us"}, {"title": "Wealth Advisor"}, {"jobTitle": "client service ASSOCIATE"}]}</script>'
    rows = [(10, "http://jobs.com/", data + "<nav><a>Office Manager</a></nav><h2>Now hiring: Client Service Associate</h2><a href='/x'><b>Lead Planner</b></a><p>Benefits manager bonus</p>"), (11, "http://jobs.com/2", None)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    whole = S.cut_pages(pages)
    got = {(r.title, r.carried) for r in S.site_roles(pages, S.split_frame(whole, S.site_frames(whole))).collect()}
    assert got == {("Client Service Associate", False), ("Lead Planner", False), ("Tax & Trust Associate", True), ('Senior "Quant" Analyst', True)}


def test_numbers_as_the_query_takes_them(spark):
    """Area codes give no label and more digits may follow, as in the query's SQL; both are the operator's otherwise."""
    lines = ["at +1 (877) 555-5242 insh", "27.204.213.132 4116106959541135", "fax 800-555-0100", "Mobile 617-555-2001 ext. 12"]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    rows = df.select(F.flatten(F.collect_list(S.numbers_in(F.col("x"), (), False))).alias("a"), F.flatten(F.collect_list(S.numbers_in(F.col("x")))).alias("b")).first()
    got = [{(p.number, p.extension, p.label) for p in c} for c in rows]
    both = {("8005550100", None, "fax"), ("6175552001", "12", "mobile")}
    assert got == [both | {("8775555242", None, None), ("2131324116", None, None)}, both | {("8775555242", None, "toll_free")}]


def test_a_cut_word_is_no_label(spark):
    """Words that the 30 characters before a number or the 20 after it cut say nothing; whole ones at the limits do."""
    tags = "<i></i>" * 8  # a blank each
    lines = [
        "estiat that. Annd aned the from. Thshhe +1 (464) 555-4443 in and.", "llislnbt.52@mail0.example.com ie. Zu +1 (366) 555-6376 beheit", "asue domi co ciónasco. Ciónarque ciezco comies íí +1 (904) 555-8577 rrllque",
        "the hotel of an inn and some more +1 (464) 555-4444", "étel of an inn and so more words +1 (464) 555-4445", "of t. Annd aned the from. Thshhe +1 (464) 555-4446", "a tel of an inn and so more wor +1 (464) 555-4447",
        f"415-555-0101 {tags}mobility", f"415-555-0102 {tags}mob of", "(t) 415-555-0103",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    got = {p.number: p.label for r in df.select(S.numbers_in(F.col("x")).alias("p")).collect() for p in r.p}
    assert got == {
        "4645554443": None, "3665556376": None, "9045558577": None, "4645554444": None, "4645554445": None, "4645554446": "office", "4645554447": "office",
        "4155550101": None, "4155550102": "mobile", "4155550103": "office",
    }


def test_shouted_text_is_no_title(spark):
    bad = ["TA!! ESCIÓNÍ!! DOGAAS!! ÑJA!! EZAR!! OSBO!! COOS!! BO!! MENT", "SU!! ÍMICI.!! CIOS!! DE!! ASUECO,!! LA,!! LA!! RAÍ!! JA", "Coos Bo Ment", "CIOS De Asueco", "Analyst? Yes"]
    good = ["Deputy COO, Boston", "CTO of Research", "Analysts and Associate"]
    df = spark.createDataFrame([(t,) for t in bad + good], "t string").select("t", S.is_title(F.col("t")).alias("ok"))
    assert {r.t: r.ok for r in df.collect()} == {**dict.fromkeys(bad, False), **dict.fromkeys(good, True)}


def fragments(html):
    return [y for x in re.split(S.BLOCKS, html) if (y := re.sub(r"\s+", " ", x).strip(" "))]


def test_frames_of_the_given_pages(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    seen = {r.page_id: re.sub(S.HIDDEN, " ", r.html or "") for r in rows}
    site = {r.page_id: re.sub(r"^www\.", "", re.match(r"https?://([^/:?#]+)", r.url)[1].lower()) for r in rows}
    body = {i: fragments(re.sub(S.FRAMING, "<br>", h)) for i, h in seen.items()}
    n_pages, often = collections.Counter(site.values()), collections.Counter((site[i], x) for i, b in body.items() for x in set(b))
    frame = {k for k, n in often.items() if n_pages[k[0]] >= 3 and n >= 0.5 * n_pages[k[0]]}
    inside = {i: [x for m in re.finditer(S.FRAMING, h) for x in fragments(m[0])] for i, h in seen.items()}
    cut = S.cut_pages(spark.read.parquet(f"{sf}/pages.parquet"))
    got = {r.page_id: (r.body, r.framing) for r in S.split_frame(cut, S.site_frames(cut)).collect()}
    assert got == {i: ([x for x in b if (site[i], x) not in frame], [x for x in b if (site[i], x) in frame] + inside[i]) for i, b in body.items()}
