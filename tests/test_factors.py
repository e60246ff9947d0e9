"""The factor library, gates and feature assembly, rule by rule on hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from firmlens.operators import factors as X

READ = {"brochure_read": True}


def tag(hits=1, phrases=1, sections=(1,), present=True):
    return {"present": present, "hits": hits, "phrases": phrases, "sections": list(sections)}


#: (factor, features, points, known)
CASES = [
    ("hnw_fit", {"raum": 1e8, "hnw_aum": 7e7, "hnw_clients": 10}, 100, True),
    ("hnw_fit", {"raum": 1e8, "hnw_aum": 7e7, "hnw_clients": 100}, 75, True),
    ("hnw_fit", {"raum": 1e8, "hnw_aum": 3e7}, 50, True),
    ("hnw_fit", {"raum": 1e8, "hnw_aum": 0}, 25, True),
    ("hnw_fit", {"raum": 0, "hnw_aum": 1}, 0, False),
    ("hnw_fit", {"raum": 1e8}, 0, False),
    ("alts_use", {"fund_count": 2}, 100, True),
    ("alts_use", {"fund_count": 3, "fund_answer": "N"} | READ, 0, True),
    ("alts_use", {"fund_answer": "Y"}, 75, True),
    ("alts_use", {"tags": {"private_markets": tag()}}, 75, True),
    ("alts_use", {"tags": {"alternatives": tag(2)}}, 45, True),
    ("alts_use", {"tags": {"alternatives": tag(1)}}, 20, True),
    ("alts_use", {}, 0, False),
    ("central_process", {"tags": {"model_portfolios": tag(), "investment_committee": tag()}}, 100, True),
    ("central_process", {"tags": {"approved_managers": tag()}, "flags": {"committee_officer": True}}, 80, True),
    ("central_process", {"tags": {"approved_managers": tag()}}, 55, True),
    ("central_process", READ, 25, True),
    ("central_process", {}, 0, False),
    ("portfolio_need", {"tags": {"income": tag(), "tax": tag()}}, 80, True),
    ("portfolio_need", {"tags": {"income": tag()}}, 55, True),
    ("portfolio_need", READ, 25, True),
    ("re_familiarity", {"segment": "prospect"}, 100, True),
    ("re_familiarity", {"segment": "competitor", "target_holdings": 3}, 60, True),
    ("re_familiarity", {"target_value": 600_000}, 60, True),
    ("re_familiarity", {"target_holdings": 1}, 30, True),
    ("re_familiarity", {}, 0, False),
    ("ops_fit", {"custodian_kind": "major", "is_private": True}, 100, True),
    ("ops_fit", {"custodian_kind": "major"}, 60, True),
    ("ops_fit", {"custodian_kind": "other"}, 30, True),
    ("ops_fit", {}, 0, False),
    ("relationship", {"status": "customer"}, 100, True),
    ("relationship", {"recent_leads": 2, "lead_decay": 0.5}, 25, True),
    ("relationship", {"recent_leads": 1, "lead_decay": 0.5}, 10, True),
    ("relationship", {}, 0, True),
    ("repeat_potential", {"iar_count": 10}, 100, True),
    ("repeat_potential", {"hnw_clients": 50}, 40, True),
    ("repeat_potential", {"iar_count": 1}, 0, True),
    ("repeat_potential", {}, 0, False),
    ("exchange_frequency", {"tags": {"exchange_1031": tag(5)}}, 60, True),
    ("exchange_frequency", {"tags": {"exchange_1031": tag(1, 3)}}, 60, True),
    ("exchange_frequency", {"tags": {"exchange_1031": tag()}}, 28, True),
    ("exchange_frequency", {"tags": {"exchange_1031": tag(present=False)}}, 0, False),
    ("owner_client_fit", {"raum": 1e9, "hnw_aum": 5e7, "hnw_clients": 10}, 100, True),
    ("owner_client_fit", {"raum": 1e9, "hnw_aum": 4e8, "hnw_clients": 1000}, 75, True),
    ("owner_client_fit", {"raum": 1e9, "hnw_aum": 1e7, "hnw_clients": 10}, 25, True),
    ("intro_timing", {"flags": {"financial_planning": True}}, 67, True),
    ("intro_timing", {"flags": {"other": True}}, 33, True),
    ("intro_timing", {}, 0, False),
    ("specialization", {"tags": {"specialization": tag(sections=(3, 8))}}, 67, True),
    ("specialization", {"tags": {"specialization": tag(sections=(3,))}} | READ, 33, True),
    ("specialization", {}, 0, False),
    ("relationship_strength", {"status": "qualified"}, 70, True),
    ("referral_potential", {"tags": {"referrals": tag()}, "clients_total": 50}, 100, True),
    ("referral_potential", {"tags": {"referrals": tag()}}, 50, True),
    ("overlap_1031", {"in_focus": False}, 0, True),
    ("geography_fit", {}, 0, False),
    ("geography_fit", {"in_focus": True}, 100, True),
    ("check_size", {"raum": 2e9}, 100, True),
    ("check_size", {"raum": 5e8}, 75, True),
    ("check_size", {}, 40, True),
    ("direct_re", {"segment": "competitor"}, 100, True),
    ("direct_re", {"tags": {"direct_real_estate": tag()}}, 67, True),
    ("direct_re", {"target_holdings": 1}, 33, True),
    ("property_type", {"tags": {"net_lease": tag()}}, 100, True),
    ("property_type", {"tags": {"real_estate": tag()}}, 33, True),
    ("capability_gap", {}, 0, False),
    ("governance_fit", {}, 0, False),
    ("decision_speed", {"fund_count": 1}, 100, True),
    ("decision_speed", {}, 0, False),
    ("jv_relationship", {"status": "meeting set"}, 70, True),
    ("hnw_assets", {"hnw_aum": 5}, 60, True),
    ("hnw_assets", {}, 0, False),
    ("hnw_clients", {"hnw_clients": 0}, 0, True),
    ("advisors", {"iar_count": 10}, 100, True),
    ("schwab_share", {"custodian_share": 0.4567}, 45.7, True),
    ("schwab_share", {}, 0, False),
    ("clients_per_advisor", {"hnw_clients": 20, "iar_count": 2, "hnw_aum": 100}, 50, True),
    ("clients_per_advisor", {"hnw_clients": 20, "iar_count": 2}, 25, True),
    ("clients_per_advisor", {"hnw_clients": 20}, 0, False),
    ("m365", {"systems": ["Microsoft"]}, 100, True),
    ("m365", {"mail": "google"}, 0, True),
    ("m365", {"mail": "unclear"}, 0, False),
    ("black_diamond", {"systems": ["Black Diamond"]}, 100, True),
    ("black_diamond", {"systems": ["x"]}, 0, False),
    ("best_trigger", {"trigger_points": 52.04}, 52, True),
    ("best_trigger", {}, 0, True),
    ("advisor_count", {"iar_count": 24}, 70, True),
    ("advisor_count", {}, 10, True),
    ("assets_band", {"raum": 7}, 60, True),
    ("marketing", {"flags": {"ad_ratings": True, "ad_testimonials": True, "ad_endorsements": True}}, 40, True),
    ("marketing", {"flags": {"x": False}}, 0, True),
    ("marketing", {}, 0, False),
    ("portfolio_complexity", {"files_holdings": True, "tags": {"strategies": tag(1, 3)}, "filings_12m": 2}, 100, True),
    ("portfolio_complexity", {"filings_12m": 2}, 30, True),
    ("compliance_owner", {"officers_loaded": True}, 0, True),
    ("compliance_owner", {"officers_loaded": True, "compliance_named": True, "compliance_dual": True, "iar_count": 10}, 100, True),
    ("compliance_owner", {"officers_loaded": True, "compliance_named": True}, 60, True),
    ("compliance_owner", {}, 0, False),
    ("providers", {"provider_count": 3}, 60, True),
    ("providers", {"provider_count": 0}, 0, True),
    ("providers", {}, 0, False),
    ("team_growth", {"team_now": 10, "team_before": 0}, 100, True),
    ("team_growth", {"team_now": 105, "team_before": 100}, 85, True),
    ("team_growth", {"team_now": 54, "team_before": 50}, 65, True),
    ("team_growth", {"team_now": 52, "team_before": 50}, 45, True),
    ("team_growth", {"team_now": 101, "team_before": 100}, 30, True),
    ("team_growth", {"team_now": 5, "team_before": 5}, 10, True),
    ("team_growth", {"team_now": 4, "team_before": 5}, 0, True),
    ("team_growth", {"team_now": 4}, 0, False),
    ("asset_growth", {"aum_rate": 0.2}, 85, True),
    ("asset_growth", {"aum_rate": 0.01}, 25, True),
    ("asset_growth", {"aum_rate": -0.1}, 0, True),
    ("asset_growth", {}, 0, False),
    ("client_growth", {"clients_rate": 0.08}, 65, True),
    ("capacity_strain", {"capacity_rate": 0.05}, 50, True),
    ("support_gap", {"advisory_staff": 1}, 0, True),
    ("support_gap", {"advisory_staff": 4, "support_per_advisor": 0.4, "peer_support": 1}, 100, True),
    ("support_gap", {"advisory_staff": 4, "support_per_advisor": 0.9, "peer_support": 1}, 45, True),
    ("support_gap", {"advisory_staff": 4, "support_per_advisor": 2, "peer_support": 1}, 15, True),
    ("support_gap", {"advisory_staff": 4, "support_per_advisor": 2}, 0, False),
    ("support_gap", {}, 0, False),
    ("backfill", {"people_loaded": True, "senior_left": 2}, 100, True),
    ("backfill", {"people_loaded": True, "left_12m": 3}, 50, True),
    ("backfill", {"people_loaded": True, "left_12m": 1}, 30, True),
    ("backfill", {"left_12m": 1}, 0, False),
    ("succession", {"veterans": 4, "people": 10}, 100, True),
    ("succession", {"veterans": 1, "people": 10}, 25, True),
    ("succession", {"veterans": 1}, 0, False),
    ("expansion", {"growth_loaded": True, "new_offices": 1, "new_states": 2, "lift_outs": 1, "years_registered": 2, "first_fund": True}, 100, True),
    ("expansion", {"growth_loaded": True, "new_states": 1, "custodian_changed": True}, 35, True),
    ("expansion", {"new_states": 1}, 0, False),
    ("open_roles", {"postings": 3}, 100, True),
    ("open_roles", {"postings": 1, "careers": "unreachable"}, 80, True),
    ("open_roles", {"careers": "page"}, 20, True),
    ("open_roles", {"careers": "no_openings"}, 10, True),
    ("open_roles", {"careers": "unreachable"}, 0, False),
    ("open_roles", {"careers": "unreachable", "flags": {"jobs_searched": True}}, 0, True),
    ("open_roles", {}, 0, False),
]
BANDS = {"hnw_assets": {"bands": [(5, 60), (9, 100)]}, "hnw_clients": {"bands": [(1, 50)]}, "advisors": {"bands": [(10, 100)]}, "assets_band": {"bands": [(7, 60)]}, "clients_per_advisor": {"bands": [(10, 100)], "damping": [(5, 0.5)]}}


def frame(spark, rows):
    kinds = X.COLUMNS | {"tags": "map<string,struct<present:boolean,hits:int,phrases:int,sections:array<int>>>", "flags": "map<string,boolean>", "systems": "array<string>"}
    value = lambda c, v: float(v) if kinds[c] == "double" and v is not None else v
    return spark.createDataFrame([(i, *(value(c, r.get(c, {} if c == "tags" else None)) for c in kinds)) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{c} {t}" for c, t in kinds.items()))


def test_every_factor(spark):
    assert {k for k, *_ in CASES} == set(X.FACTORS) and len(X.FACTORS) == 46
    rated = X.with_factors(frame(spark, [r for _, r, _, _ in CASES]), {k: BANDS.get(k, {}) for k in X.FACTORS})
    got = {r.id: r for r in rated.collect()}
    for i, (key, row, points, known) in enumerate(CASES):
        f = got[i][f"f_{key}"]
        assert (round(f.points, 6), f.known) == (points, known), (key, row)


def test_gates_and_disqualifiers(spark):
    rows = [
        {"regulator": "SEC", "raum": 100, "hnw_aum": 60, "retail_aum": 0},
        {"regulator": "SEC", "raum": 200, "country": "Canada"},
        {"regulator": "SEC", "raum": 200},
        {"regulator": "SEC", "raum": 100, "fund_answer": "Y"},
        {"regulator": "SEC", "raum": 100, "hnw_aum": 10},
        {"regulator": "SEC", "raum": 100, "hnw_aum": 60, "related_bank": True},
        {"regulator": "STATE"},
    ]
    gates = [X.gate("registered"), X.gate("raum_range", low=100, high=200), X.gate("no_private_funds"), X.gate("individual_share", least=0.5), X.gate("independent"), X.gate("supported_system")]
    got = [r.failed_gate for r in X.apply_gates(frame(spark, rows), gates).orderBy("id").collect()]
    assert got == [None, "registered", "raum_range", "no_private_funds", "individual_share", "independent", "registered"]
    more = [{"raum": 10, "hnw_aum": 6, "hnw_clients": 1}, {"raum": 10, "hnw_aum": 4, "hnw_clients": 1}, {"tags": {"cpa": tag()}}, {"flags": {"property_phrase": True}}, {}]
    marked = frame(spark, more).select("id", *(X.gate(k, **of)[1].alias(k) for k, of in (("family_office", {"least": 5}), ("partner_type", {"tags": ["cpa"]}), ("investment_property", {"tags": ["x"]}), ("min_raum", {"low": 10}), ("check_capacity", {"low": 11})))).orderBy("id")
    assert [tuple(r)[1:] for r in marked.collect()] == [(True, False, False, True, False), (False, False, False, True, False), (False, True, False, False, False), (False, False, True, False, False), (False, False, False, False, False)]
    out = [{"tags": {"illiquid": tag(present=False)}}, {"segment": "competitor"}, {"last_custodian_move": "custodian_change_from_platform"}, {"is_exempt": True}, {"category": "bank", "category_confidence": 90}, {"category": "bank", "category_confidence": 10}, {"category": "bank", "category_manual": True}, {}]
    rules = [X.disqualifier(k) for k in ("bans_illiquid", "re_competitor", "left_schwab", "exempt_reporting")] + [X.disqualifier("firm_type", remove=["bank"], threshold=80)]
    assert [r.removed_by for r in X.apply_gates(frame(spark, out), [], rules).orderBy("id").collect()] == ["bans_illiquid", "re_competitor", "left_schwab", "exempt_reporting", "firm_type", None, "firm_type", None]


def test_assemble_features(spark):
    firms = spark.createDataFrame([("a",), ("b",)], "id string")
    sums = spark.createDataFrame([("a", 5.0)], "id string, raum double")
    tags = spark.createDataFrame([("a", "tax", True, 2, 1, [4]), ("a", "tax", True, 3, 1, [8]), ("a", "income", False, 1, 1, [1])], "id string, tag string, present boolean, hits int, phrases int, sections array<int>")
    flags = spark.createDataFrame([("a", "f", False), ("a", "f", True)], "id string, flag string, value boolean")
    systems = spark.createDataFrame([("b", "y"), ("b", "x"), ("b", "x")], "id string, system string")
    got = {r.id: r for r in X.assemble_features(firms, "id", [sums], tags, flags, systems).collect()}
    assert (got["a"].raum, got["b"].raum, got["a"].tags["tax"].hits, got["b"].tags, got["a"].flags, got["b"].flags, got["b"].systems) == (5.0, None, 3, {}, {"f": True}, None, ["x", "y"])
    assert set(X.COLUMNS) <= set(got["a"].asDict())
    assert X.with_factors(X.assemble_features(firms.limit(0), "id"), list(X.FACTORS)).count() == 0
    events = spark.createDataFrame([("a", "aum_jump", 0.5), ("a", "new_registration", 1.0), ("a", "other", 1.0), ("b", "other", 1.0)], "id string, kind string, decay double")
    assert {r.id: r.trigger_points for r in X.trigger_points(events, "id", "kind", "decay").collect()} == {"a": 55.0, "b": 0.0}


@pytest.mark.parametrize("value", [None, "x"])
def test_unknown_status_has_no_points(spark, value):
    row = X.with_factors(frame(spark, [{"status": value}]), ["relationship_strength"]).first()
    assert row.f_relationship_strength.points == 0
    assert F.col("x") is not None
