"""Firm types and signals, rule by rule on hand-made rows."""

from __future__ import annotations

from firmlens.operators import firmtypes as T

PEOPLE = {"share_individuals": 0.8, "share_hnw": 0.2}
POOLED = {"share_individuals": 0.1, "share_pooled": 0.8}
INST = {"share_individuals": 0.1, "share_institutions": 0.6}


def yes(*names):
    return {"answers": dict.fromkeys(names, True)}


#: (features, category, confidence)
CASES = [
    ({"is_exempt": True, "known_category": "robo"}, "era", 99),
    ({"state_exempt": True}, "era", 95),
    ({"known_category": "wirehouse", "known_confidence": 97} | PEOPLE, "wirehouse", 97),
    ({"known_category": "wirehouse", "known_confidence": 97, "share_individuals": 0.05, "share_pooled": 0.9}, "private_fund", 70),
    ({"known_category": "custodian", "known_confidence": 97, "share_individuals": 0.05, "share_pooled": 0.9}, "custodian", 97),
    (yes("pension_consultant"), "consultant_ocio", 60),
    (POOLED | {"fund_answer": "N"}, "asset_manager", 75),
    (POOLED | {"fund_assets": 1, "raum": 10}, "asset_manager", 70),
    (POOLED | {"fund_assets": 9, "raum": 10}, "private_fund", 90),
    (POOLED | {"fund_assets": 9, "raum": 10, "share_pooled": 0.6}, "private_fund", 80),
    (POOLED | {"by_assets": False}, "private_fund", 60),
    ({"share_individuals": 0.1, "share_funds": 0.5}, "asset_manager", 90),
    ({"share_individuals": 0.1, "share_funds": 0.3}, "asset_manager", 80),
    (INST | {"share_plans": 0.5} | yes("pension_consultant"), "consultant_ocio", 75),
    (INST | {"name_key": "ACME OCIO"}, "consultant_ocio", 75),
    (INST | {"share_plans": 0.5, "raum": 10, "raum_without_discretion": 6} | yes("pension_consulting", "selects_managers"), "consultant_ocio", 75),
    (INST | yes("pension_consultant"), "asset_manager", 75),
    ({"share_individuals": 0.1, "share_advisers": 0.4}, "asset_manager", 65),
    ({"share_individuals": 0.1, "share_pooled": 0.3, "share_institutions": 0.2, "fund_answer": "Y"}, "private_fund", 60),
    ({"share_individuals": 0.1, "share_pooled": 0.2, "share_institutions": 0.3, "fund_answer": "Y"}, "asset_manager", 60),
    (PEOPLE | yes("is_bank"), "bank_trust", 92),
    (PEOPLE | yes("is_trust_company"), "independent_ria", 90),
    (yes("is_trust_company"), "bank_trust", 92),
    (PEOPLE | yes("is_broker_dealer"), "independent_bd", 85),
    (PEOPLE | {"parent_category": "insurance", "parent_code": "E"} | yes("is_broker_dealer"), "insurance", 85),
    (PEOPLE | {"parent_category": "insurance", "parent_code": "E"}, "insurance", 85),
    (PEOPLE | {"parent_category": "insurance", "parent_code": "D", "parent_generic": True}, "insurance", 65),
    (PEOPLE | {"parent_category": "holding", "parent_code": "E"}, "independent_ria", 90),
    (yes("planning"), "independent_ria", 55),
    ({"fund_answer": "Y"}, "private_fund", 55),
    (yes("fund_portfolios"), "asset_manager", 55),
    (yes("pension_consulting"), "consultant_ocio", 50),
    (yes("institutional_portfolios"), "asset_manager", 45),
    (yes("publishes"), "unknown", 25),
    ({}, "unknown", 10),
    ({"registered": True}, "unknown", 15),
    ({"share_individuals": 0.2, "fund_count": 1}, "private_fund", 55),
    ({"share_individuals": 0.2} | yes("planning"), "independent_ria", 40),
    ({"share_individuals": 0.2}, "asset_manager", 50),
    (PEOPLE | yes("internet_adviser"), "robo", 85),
    (PEOPLE | {"clients_total": 6000, "staff": 2, "raum": 6e7}, "robo", 65),
    (PEOPLE | {"clients_total": 6000, "staff": 2, "raum": 6e9, "wrap_assets": 4e9}, "tamp", 75),
    (PEOPLE | {"clients_total": 6000, "staff": 2, "raum": 6e9} | yes("selects_managers"), "tamp", 65),
    (PEOPLE | {"share_hnw": 0.3, "name_key": "ACME FAMILY OFFICE"}, "multi_family_office", 85),
    (PEOPLE | {"share_hnw": 0.6, "hnw_clients": 5, "hnw_aum": 1e8}, "multi_family_office", 65),
    (PEOPLE | {"staff": 10, "registered_staff": 2}, "hybrid_ria", 85),
    (PEOPLE | {"staff": 10, "registered_staff": 1}, "hybrid_ria", 65),
    (PEOPLE | yes("is_representative"), "hybrid_ria", 80),
    (PEOPLE | yes("related_broker_dealer"), "hybrid_ria", 65),
    (PEOPLE | {"share_individuals": 0.5, "by_assets": False}, "independent_ria", 70),
    (PEOPLE | {"share_individuals": 0.4}, "independent_ria", 60),
]

SIGNALS = [
    (PEOPLE | {"share_hnw": 0.4}, ["serves_hnw"]),
    ({"hnw_clients": 30}, []),
    (PEOPLE | {"share_retail": 0.5, "share_institutions": 0.25, "share_funds": 0.1}, ["mass_affluent", "institutional", "registered_funds"]),
    (PEOPLE | yes("adviser_to_funds", "planning", "related_broker_dealer", "commissions", "performance_fees"), ["registered_funds", "planning", "affiliated_bd", "commissions", "performance_fees"]),
    ({"staff": 4, "insurance_staff": 2, "registered_staff": 1, "fund_count": 1, "wrap_assets": 1, "files_holdings": True, "parent_category": "x"} | yes("related_bank", "related_trust_company", "holds_cash", "internet_adviser"), ["dual_registered", "insurance_licensed", "private_funds", "wrap", "files_13f", "bank_affiliate", "trust_affiliate", "qualified_custodian", "internet_adviser", "in_group"]),
]


def frame(spark, rows):
    value = lambda c, v: float(v) if T.COLUMNS[c] == "double" and v is not None else v
    return spark.createDataFrame([(i, *(value(c, r.get(c)) for c in T.COLUMNS)) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{c} {t}" for c, t in T.COLUMNS.items()))


def test_firm_type(spark):
    got = {r.id: (r.category, r.category_confidence, r.category_evidence) for r in T.firm_type(frame(spark, [c[0] for c in CASES])).collect()}
    for i, (row, category, confidence) in enumerate(CASES):
        assert got[i][:2] == (category, confidence), row
        assert got[i][2]
    assert T.firm_type(frame(spark, [])).count() == 0


def test_type_signals(spark):
    got = {r.id: r.type_signals for r in T.firm_type(frame(spark, [s[0] for s in SIGNALS])).collect()}
    assert [got[i] for i in range(len(SIGNALS))] == [s[1] for s in SIGNALS]
