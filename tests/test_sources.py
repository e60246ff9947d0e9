"""Feeds, archives, texts, registers, publishing, gates and streams on files that the tests write."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from firmlens.operators import gates as G
from firmlens.sources import feeds as A
from firmlens.streaming import jobs as S


def test_firm_feed(spark, tmp_path):
    (tmp_path / "firms.xml").write_text(
        '<Firms><Firm><Info FirmCrdNb="7" LegalNm="Acme LLC" BusNm="Acme"/><MainAddr City="Troy" State="NY" PhNb="1"/><Rgstn FirmType="Registered" St="APPROVED" Dt="2010-01-02"/>'
        '<StateRgstn><Rgltrs><Rgltr Cd="NY" St="APPROVED" Dt="2011-01-01"/><Rgltr Cd="NY" St="TERMINATED" Dt="2012-01-01"/></Rgltrs></StateRgstn><Filing Dt="2020-05-06"/>'
        '<FormInfo><Part1A><Item1><WebAddrs><WebAddr>https://www.linkedin.com/company/acme/</WebAddr><WebAddr>https://acme.com</WebAddr></WebAddrs></Item1><Item5A TtlEmp="9"/><Item5D Q5DA1="3" Q5DB1="4"/></Part1A></FormInfo></Firm>'
        '<Firm><Info FirmCrdNb="8" LegalNm="Era LP"/><Rgstn FirmType="ERA" St="ACTIVE"/><FormInfo><Part1A><Item5D Q5DA1="0"/></Part1A></FormInfo></Firm></Firms>'
    )
    got = {r.entity_id: r for r in A.read_firm_feed(spark, str(tmp_path / "firms.xml"), "sec", 5).collect()}
    assert (got["7"].website, got["7"].clients_total, got["7"].total_employees, str(got["7"].registered_date), str(got["7"].filing_date)) == ("https://acme.com", 7, 9, "2010-01-02", "2020-05-06")
    assert (got["8"].is_exempt, got["8"].clients_total, got["8"].website) == (True, None, None)
    assert [(r.state, r.status) for r in A.feed_states(spark, str(tmp_path / "firms.xml")).collect()] == [("NY", "TERMINATED")]
    archive = spark.createDataFrame([("7", "http://twitter.com/acme"), ("7", "linkedin.com/company/old")], "entity_id string, url string")
    assert {(r.platform, r.url, r.source) for r in A.feed_social(spark, str(tmp_path / "firms.xml"), archive).collect()} == {("linkedin", "linkedin.com/company/acme", "feed"), ("twitter", "twitter.com/acme", "archive")}


def test_individual_feed(spark, tmp_path):
    (tmp_path / "i.xml").write_text(
        '<Indvls><Indvl><Info indvlPK="1" firstNm="Ann" lastNm="Ray" actvAGReg="Y"/><CrntEmps><CrntEmp orgPK="7" orgNm="Acme" city="Troy" state="NY"><CrntRgstns><CrntRgstn stDt="2015-02-01"/><CrntRgstn stDt="2014-02-01"/></CrntRgstns></CrntEmp></CrntEmps>'
        '<PrevRgstns><PrevRgstn orgPK="9" orgNm="Old" regBeginDt="2010-01-01" regEndDt="2013-01-01"/></PrevRgstns><EmpHss><EmpHs orgNm="Old Inc" fromDt="01/2010" toDt="01/2013"/></EmpHss><DRPs><DRP hasX="Y"/></DRPs></Indvl>'
        '<Indvl><Info indvlPK="1" firstNm="Dup" lastNm="Ray"/></Indvl><Indvl><Info indvlPK="2" firstNm="Bob" lastNm="Lee"/><PrevRgstns><PrevRgstn orgPK="8" orgNm="Else" regBeginDt="2010-01-01"/></PrevRgstns></Indvl></Indvls>'
    )
    out = A.read_individual_feed(spark, str(tmp_path / "i.xml"), spark.createDataFrame([("7",)], "org_id string"))
    assert [(r.person_id, r.first_name, r.active, r.has_disclosure) for r in out["person"].collect()] == [("1", "Ann", True, True)]
    assert {(r.org_id, r.kind, str(r.start_date)) for r in out["registrations"].collect()} == {("7", "current", "2014-02-01"), ("9", "previous", "2010-01-01")}
    reps = A.current_reps(out, spark.createDataFrame([("7",)], "org_id string")).collect()
    assert [(r.person_id, str(r.since), r.city) for r in reps] == [("1", "2014-02-01", "Troy")]
    regs = out["registrations"].withColumn("name_key", A.org_key(F.col("org_name")))
    assert [r.org_id for r in __import__("firmlens.operators.resolve", fromlist=["x"]).resolve_history_org(out["history"], regs, "person_id", "name_key", "org_id").collect()] == ["9"]


def test_archive_texts_and_offerings(spark, tmp_path):
    (tmp_path / "a.csv").write_text("FilingID,Name,Assets\n1,Acme,12.0\n2,,x\n")
    walk = spark.createDataFrame([("1", "7")], "filing_id string, entity_id string")
    rows = A.load_archive_table(spark, str(tmp_path / "a.csv"), {"FilingID": "filing_id", "Name": "name", "Assets": "assets"}, ["assets"], walk, "filing_id").orderBy("filing_id").collect()
    assert [(r.entity_id, r.name, r.assets) for r in rows] == [("7", "Acme", 12), (None, None, None)] and '"Name"' not in rows[1].raw
    lines = spark.createDataFrame([("13F-HR      A VERY LONG NAME THAT OVERFLOWS CO  1234567  2024-02-01  edgar/data/1.txt",), ("10-K  X  1  2024-01-01  y",)], "value string")
    assert [(r.company, r.cik, str(r.filed)) for r in A.parse_form_index(lines, "2024Q1").collect()] == [("A VERY LONG NAME THAT OVERFLOWS CO", "0001234567", "2024-02-01")]
    doc = "<ns1:infoTable><ns1:nameOfIssuer>A</ns1:nameOfIssuer><ns1:cusip>123456789</ns1:cusip><ns1:value>1,000</ns1:value></ns1:infoTable><infoTable><cusip>12</cusip><value>5</value></infoTable><infoTable id='1'><cusip x='2'>987654321</cusip><value>3000</value></infoTable>"
    held, totals = A.parse_holdings(spark.createDataFrame([("f", doc)], "filing string, text string"), spark.createDataFrame([("123456789", "T")], "security_id string, target string"))
    assert [(r.target, r.value) for r in held.collect()] == [("T", 1000)]
    assert tuple(totals.first()) == ("f", 2, 4000, 0.75)
    q = spark.createDataFrame([(1, "Acme Fund LLC")], "query_id int, name string")
    n = spark.createDataFrame([(1, "Acme Fund II LP", "2024-01-01"), (2, "ACME FUND", "2020-01-01")], "notice_id int, name string, filed string")
    assert [(r.notice_id, r.exact) for r in A.match_offerings(q, n).collect()] == [(2, True)]


def test_history_and_precedence(spark):
    a = spark.createDataFrame([("1", "2020-01-01", 5)], "entity_id string, filing_date string, raum int")
    f = spark.createDataFrame([("1", "2020-01-01", 6, 1), ("1", "2020-01-01", 7, 2)], "entity_id string, filing_date string, raum int, snapshot_id int")
    assert [r.raum for r in A.build_history(a, f).collect()] == [7]
    extra = spark.createDataFrame([("1", "2020-01-01", 9)], "entity_id string, filing_date string, raum int")
    assert [(r.raum, r.changed) for r in A.backfill_history(a, extra, ["entity_id", "filing_date"], ["raum"]).collect()] == [(9, True)]
    assert A.union_with_precedence([a, extra], "entity_id").count() == 1


def test_register_publish_export(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"x")
    for _ in range(2):
        S.stream_snapshots(spark, str(tmp_path / "in"), str(tmp_path / "reg"), str(tmp_path / "cp"), "s").awaitTermination()
    (tmp_path / "in" / "b.bin").write_bytes(b"y")
    S.stream_snapshots(spark, str(tmp_path / "in"), str(tmp_path / "reg"), str(tmp_path / "cp"), "s").awaitTermination()
    assert sorted(r.filename for r in spark.read.parquet(str(tmp_path / "reg")).collect()) == ["a.bin", "b.bin"]
    A.publish(spark.range(3).toDF("x"), str(tmp_path / "t"))
    A.publish(spark.range(5).toDF("x"), str(tmp_path / "t"))
    assert A.published(spark, str(tmp_path / "t")).count() == 5
    A.export_csv(spark.range(2).toDF("x"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_gates(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    with pytest.raises(G.GateError):
        G.require_columns(df, ["z"])
    with pytest.raises(G.GateError):
        G.require_all(df, F.col("x") > 1, "x is small")
    with pytest.raises(G.GateError):
        G.require_paths(df, ["x.y"])
    layouts = spark.createDataFrame([("s", ["a", "b"]), ("s", ["a", "b"])], "source string, columns array<string>")
    new = G.record_layout(layouts, spark.createDataFrame([], "source string, fingerprint string"))
    assert new.count() == 1 and G.record_layout(layouts, new).count() == 0
    drift = spark.createDataFrame([(["a", "b"], ["b", "c"])], "p array<string>, q array<string>").select(G.layout_drift(F.col("p"), F.col("q"))).first()[0]
    assert (drift.added, drift.dropped) == (["c"], ["a"])


def test_registered_history_and_flags(spark):
    history = spark.createDataFrame([("p", "ACME", "2010-01-01"), ("p", "OLD", "2009-01-01"), ("p", None, "2010-01-01")], "person_id string, name_key string, start_date string")
    regs = spark.createDataFrame([("p", "ACME", "2010-01-01"), ("p", "ACME", "2010-01-01"), ("p", None, "2010-01-01")], "person_id string, name_key string, start_date string")
    kept, left = A.drop_registered(history, regs)
    assert sorted(str(r.name_key) for r in kept.collect()) == ["None", "OLD"] and left.first().n_dropped == 1
    answers = spark.createDataFrame([({"a": "Y", "b": "0"}, ["https://www.linkedin.com/company/x", "http://linkedin.com/y", "https://x.example"], ["one"]), ({}, None, None)], "answers map<string,string>, urls array<string>, addresses array<string>")
    got = [(r.ads, r.fees, r.other, r.platforms, r.n_addresses) for r in A.feed_flags(answers, {"ads": "a", "fees": "b", "other": "c"}).collect()]
    assert got == [(True, False, None, ["linkedin"], 1), (None, None, None, [], 0)]
