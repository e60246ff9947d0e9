"""What kind of firm an adviser is: signals, and an ordered decision with confidence and evidence.

One row per firm holds what the decision reads. Shares of clients (``share_*``, of assets or, where those
are missing, of client counts) are null together if the filing has neither:

* share_individuals, share_hnw, share_retail, share_institutions, share_plans, share_pooled, share_funds
  (registered funds), share_advisers, and by_assets (false: the shares are of counts);
* numbers: raum, raum_without_discretion, wrap_assets, fund_count, fund_assets, hnw_clients, hnw_aum,
  clients_total, staff, registered_staff, insurance_staff;
* flags: is_exempt, state_exempt, registered, fund_answer (Y or N), files_holdings;
* answers: map of the filing's answers to booleans, by the names in ``ANSWERS``;
* name_key: the normalised names; known_category, known_confidence, known_generic: the entity known by
  name; parent_category, parent_code (E or D), parent_generic: the strongest controlling owner that is known.

All is one expression over the row; a missing answer is a no, a missing number 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .classify import multi_label

#: Names of the answers. Fixed values.
ANSWERS = (
    "adviser_to_funds", "pension_consultant", "internet_adviser", "planning", "individual_portfolios", "fund_portfolios", "pooled_portfolios", "institutional_portfolios",
    "pension_consulting", "selects_managers", "publishes", "commissions", "performance_fees", "is_broker_dealer", "is_representative", "is_bank", "is_trust_company",
    "related_broker_dealer", "related_bank", "related_trust_company", "holds_cash", "holds_securities",
)
INSTITUTIONAL = ("private_fund", "asset_manager", "consultant_ocio")
#: Owners that decide what a firm is. Fixed values.
DECIDING = ("wirehouse", "custodian", "bank_trust", "insurance", "independent_bd", "private_fund", "asset_manager", "robo", "tamp")
FAMILY_OFFICE = r"\bFAMILY OFFICES?\b|\bMULTI FAMILY\b|\bFAMILY WEALTH OFFICE\b"
CONSULTING = r"\bOCIO\b|\bCONSULT|\bOUTSOURCED CHIEF\b"


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("double")


def _a(name: str) -> Column:
    if name not in ANSWERS:
        raise ValueError(f"there is no answer {name}")
    return F.coalesce(F.col("answers")[name], F.lit(False))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0.0)), F.lit(0.0))


def _share(name: str) -> Column:
    return F.coalesce(F.col(f"share_{name}"), F.lit(0.0))


def _mixed() -> Column:
    return F.col("share_individuals").isNotNull()


def _has_funds() -> Column:
    return (F.coalesce(F.col("fund_answer"), F.lit("")) == "Y") | (_n("fund_count") > 0)


def type_signals() -> Column:
    """The names of the 18 signals that hold, in their order."""
    mixed = _mixed()
    return multi_label(
        {
            "serves_hnw": mixed & ((_share("hnw") >= 0.4) | (_n("hnw_clients") >= 25)),
            "mass_affluent": mixed & (_share("retail") >= 0.5),
            "institutional": mixed & (_share("institutions") >= 0.25),
            "registered_funds": mixed & ((_share("funds") > 0.05) | _a("adviser_to_funds")),
            "planning": _a("planning"),
            "dual_registered": _n("registered_staff") >= 1,
            "affiliated_bd": _a("related_broker_dealer"),
            "commissions": _a("commissions"),
            "insurance_licensed": (_n("staff") > 0) & (_ratio(_n("insurance_staff"), _n("staff")) >= 0.5),
            "performance_fees": _a("performance_fees"),
            "private_funds": _has_funds(),
            "wrap": _n("wrap_assets") > 0,
            "files_13f": _flag("files_holdings"),
            "bank_affiliate": _a("related_bank"),
            "trust_affiliate": _a("related_trust_company"),
            "qualified_custodian": _a("holds_cash") | _a("holds_securities"),
            "internet_adviser": _a("internet_adviser"),
            "in_group": F.col("parent_category").isNotNull(),
        }
    )


#: (condition, category, confidence, evidence)
Step = tuple[Column, Column | str, Column | int, str]


def _first(steps: Sequence[Step]) -> Column:
    """struct(category, confidence, evidence) of the first step that holds, null without one."""
    out = F.lit(None).cast("struct<category:string,confidence:int,evidence:string>")
    for condition, category, confidence, evidence in reversed(list(steps)):
        own = F.struct((F.lit(category) if isinstance(category, str) else category).alias("category"), (F.lit(confidence) if isinstance(confidence, int) else confidence).cast("int").alias("confidence"), F.lit(evidence).alias("evidence"))
        out = F.when(F.coalesce(condition, F.lit(False)), own).otherwise(out)
    return out


def _less() -> Column:
    """Shares of counts are less sure than shares of assets."""
    return F.when(F.coalesce(F.col("by_assets"), F.lit(True)), 0).otherwise(-10)


def business() -> Column:
    """The type of firms whose clients are funds or institutions rather than people; null for others."""
    people, pooled, funds, institutions, advisers, plans = (_share(x) for x in ("individuals", "pooled", "funds", "institutions", "advisers", "plans"))
    mixed, less = _mixed(), _less()
    few = mixed & (people < 0.5)
    known_funds = (_n("fund_assets") > 0) & (_n("raum") > 0)
    private = _ratio(_n("fund_assets"), _n("raum"))
    names = F.coalesce(F.col("name_key"), F.lit(""))
    talk = names.rlike(CONSULTING)
    advice = _ratio(_n("raum_without_discretion"), _n("raum"))
    consults = ((plans >= 0.4) | talk) & (_a("pension_consultant") | talk | (_a("pension_consulting") & _a("selects_managers") & (advice >= 0.5)))
    mostly = few & (pooled + funds + institutions + advisers >= 0.5)
    largest = F.greatest(pooled, funds, institutions, advisers)
    own_funds = F.coalesce(F.col("fund_answer"), F.lit("")) == "Y"
    return _first(
        [
            (~mixed & _a("pension_consultant"), "consultant_ocio", 60, "registers as a pension consultant and reports no clients by type"),
            (few & (pooled >= 0.5) & (F.col("fund_answer") == "N"), "asset_manager", 75 + less, "clients are pooled vehicles but no private funds"),
            (few & (pooled >= 0.5) & known_funds & (private < 0.3), "asset_manager", 70 + less, "private funds hold little of the assets"),
            (few & (pooled >= 0.5), "private_fund", F.when(known_funds, F.when(pooled >= 0.7, 90).otherwise(80)).otherwise(70) + less, "clients are pooled vehicles"),
            (few & (funds >= 0.3) & (people < 0.35), "asset_manager", F.when(funds >= 0.5, 90).otherwise(80) + less, "clients are registered funds"),
            (few & (institutions >= 0.5) & (people < 0.35) & consults, "consultant_ocio", 75 + less, "clients are institutions that it consults"),
            (few & (institutions >= 0.5) & (people < 0.35), "asset_manager", 75 + less, "clients are institutions"),
            (few & (advisers >= 0.4) & (people < 0.35), "asset_manager", 65 + less, "clients are other advisers"),
            (mostly & (people < 0.35), F.when((pooled == largest) & own_funds, "private_fund").otherwise("asset_manager"), 60 + less, "clients are mostly funds and institutions"),
        ]
    )


def _services() -> list[Step]:
    """What the firm says it does, where it reports no clients by type."""
    return [
        (_a("planning") | _a("individual_portfolios"), "independent_ria", 55, "offers planning or portfolios for individuals"),
        ((F.coalesce(F.col("fund_answer"), F.lit("")) == "Y") | _a("pooled_portfolios"), "private_fund", 55, "advises private funds or pooled vehicles"),
        (_a("fund_portfolios"), "asset_manager", 55, "manages registered funds"),
        (_a("pension_consulting") | _a("pension_consultant"), "consultant_ocio", 50, "consults on pension plans"),
        (_a("institutional_portfolios"), "asset_manager", 45, "manages portfolios for institutions"),
        (_a("publishes"), "unknown", 25, "publishes newsletters, ratings or seminars"),
        (~_flag("registered"), "unknown", 10, "no approved registration"),
        (F.lit(True), "unknown", 15, "no assets or clients by type"),
    ]


def _wealth() -> list[Step]:
    """Which kind of wealth manager a firm with mostly people as clients is."""
    people, hnw, less = _share("individuals"), _share("hnw"), _less()
    clients, staff, raum = _n("clients_total"), _n("staff"), _n("raum")
    each, account = _ratio(clients, staff), _ratio(raum, clients)
    wrap = _ratio(_n("wrap_assets"), raum)
    rich = _ratio(_n("hnw_aum"), _n("hnw_clients"))
    reps = _n("registered_staff")
    return [
        (_a("internet_adviser"), "robo", 85, "registers as an internet adviser"),
        ((each >= 3000) & (account > 0) & (account < 150_000), "robo", 65, "very many small clients for its staff"),
        ((each >= 1000) & ((wrap >= 0.5) | _a("selects_managers") | (_share("advisers") >= 0.15)), "tamp", F.when(wrap >= 0.5, 75).otherwise(65), "clients on a platform's scale"),
        (F.coalesce(F.col("name_key"), F.lit("")).rlike(FAMILY_OFFICE) & (hnw >= 0.3), "multi_family_office", 85 + less, "calls itself a family office"),
        ((hnw >= 0.6) & (rich >= 20e6) & _n("hnw_clients").between(5, 600), "multi_family_office", 65, "few clients of very large wealth"),
        ((reps >= 1) & (_ratio(reps, staff) >= 0.2), "hybrid_ria", 85 + less, "much of its staff represents a broker-dealer"),
        (_a("is_representative"), "hybrid_ria", 80 + less, "represents a broker-dealer"),
        (reps >= 1, "hybrid_ria", 65 + less, "some of its staff represents a broker-dealer"),
        (_a("related_broker_dealer"), "hybrid_ria", 65 + less, "has a related broker-dealer"),
        (F.lit(True), "independent_ria", F.when(people >= 0.7, 90).when(people >= 0.5, 80).otherwise(60) + less, "clients are individuals and families"),
    ]


def firm_type(df: DataFrame) -> DataFrame:
    """The table with category, category_confidence (0 to 100), category_evidence and type_signals.

    In order: exempt advisers; a known name, unless its clients are institutions and the name's type isn't;
    clients that are funds or institutions; what the firm itself is; who controls it; the kind of wealth
    manager, or what it offers where nothing is known of its clients.
    """
    df = df.withColumn("_business", business())
    people, mixed = _share("individuals"), _mixed()
    biz = F.col("_business.category")
    own = F.col("known_category").isNotNull()
    overruled = own & (F.col("known_category") != "custodian") & ~F.col("known_category").isin(*INSTITUTIONAL) & biz.isin(*INSTITUTIONAL) & mixed & (people < 0.1)
    trust_only = _a("is_trust_company") & ~_a("is_bank") & mixed & (people >= 0.5)
    owner = F.col("parent_category").isin("wirehouse", "custodian", "bank_trust", "insurance")
    steps: list[Step] = [
        (_flag("is_exempt"), "era", 99, "files as an exempt reporting adviser"),
        (_flag("state_exempt"), "era", 95, "exempt reporting adviser with a state"),
        (overruled, biz, F.col("_business.confidence"), "part of a known name, its clients are institutions"),
        (own, F.col("known_category"), F.coalesce(F.col("known_confidence"), F.lit(0)), "known by name"),
        (biz.isNotNull(), biz, F.col("_business.confidence"), ""),
        ((_a("is_bank") | _a("is_trust_company")) & ~trust_only, "bank_trust", 92, "is itself a bank or trust company"),
        (_a("is_broker_dealer") & owner, F.col("parent_category"), 85, "is a broker-dealer with a known parent"),
        (_a("is_broker_dealer"), "independent_bd", 85, "is itself a broker-dealer"),
        (F.col("parent_category").isin(*DECIDING) & (~mixed | (people >= 0.35)), F.col("parent_category"), F.when(F.col("parent_code") == "E", 85).otherwise(75) - F.when(_flag("parent_generic"), 10).otherwise(0), "controlled by a known parent"),
        *((~mixed & c, k, p, e) for c, k, p, e in _services()),
        (mixed & (people < 0.35) & _has_funds(), "private_fund", 55, "clients are of other kinds, advises private funds"),
        (mixed & (people < 0.35) & (_a("planning") | _a("individual_portfolios")), "independent_ria", 40, "clients are of other kinds, offers planning"),
        (mixed & (people < 0.35), "asset_manager", 50, "clients are of other kinds"),
        *((mixed & c, k, p, e) for c, k, p, e in _wealth()),
    ]
    verdict = df.withColumn("_v", _first(steps))
    said = F.when(F.col("_v.evidence") == "", F.col("_business.evidence")).otherwise(F.col("_v.evidence"))
    sure = F.greatest(F.lit(0), F.least(F.lit(100), F.col("_v.confidence")))
    return verdict.withColumns({"category": F.col("_v.category"), "category_confidence": sure, "category_evidence": said, "type_signals": type_signals()}).drop("_v", "_business")


#: Columns that the decision reads, with their types.
COLUMNS = {
    **dict.fromkeys("share_individuals share_hnw share_retail share_institutions share_plans share_pooled share_funds share_advisers raum raum_without_discretion wrap_assets fund_count fund_assets hnw_clients hnw_aum clients_total staff registered_staff insurance_staff".split(), "double"),
    **dict.fromkeys("by_assets is_exempt state_exempt registered files_holdings known_generic parent_generic".split(), "boolean"),
    **dict.fromkeys("fund_answer name_key known_category parent_category parent_code".split(), "string"),
    "known_confidence": "int",
    "answers": "map<string,boolean>",
}
