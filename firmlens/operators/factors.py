"""The built-in library of scoring factors, gates and disqualifiers over one row of features per entity.

Each factor is a Column of struct(points, evidence, known), see ``scoring.factor``. A value that isn't
known earns nothing and leaves coverage; a negative finding about a document counts only once it was
read. ``FACTORS`` names them all; those with bands take them as a parameter. Columns that they read:

* numbers: raum, hnw_aum, hnw_clients, retail_aum, clients_total, iar_count, fund_count, custodian_share,
  target_holdings, target_value, filings_12m, provider_count, recent_leads, lead_decay, trigger_points,
  team_now, team_before, aum_rate, clients_rate, capacity_rate, advisory_staff, support_per_advisor,
  peer_support, left_12m, senior_left, veterans, people, new_offices, new_states, lift_outs,
  years_registered, postings;
* flags, null where nobody looked: is_exempt, captive, is_private, files_holdings, brochure_read,
  people_loaded, growth_loaded, first_fund, custodian_changed, in_focus, related_bank, owned_by_bank,
  officers_loaded, compliance_named, compliance_dual;
* words: regulator, country, segment, custodian_kind, status, mail, careers, fund_answer, last_custodian_move;
* tags: map of tag to struct(present, hits, phrases, sections); flags: map of registration answers to
  booleans, null if unread; systems: array of systems seen.

A sum of parts is rounded to one decimal. All orders are fixed, nothing is joined or shuffled here.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .scoring import band, factor, first_reason

Bands = Sequence[tuple[float, float]]

#: Levels and steps of the built-in rules. Fixed values.
STATUS = {"customer": 100, "qualified": 70, "meeting set": 70}
TRIGGERS = {"aum_jump": 80, "iar_growth": 65, "custodian_change_to_platform": 65, "custodian_change_other": 65, "custodian_change_from_platform": 65, "new_registration": 55}
TEAM = ((0.25, 10, 100), (0.15, 5, 85), (0.08, None, 65), (0.03, None, 45))
ASSETS = ((0.30, 100), (0.20, 85), (0.10, 65), (0.05, 45))
CLIENTS = ((0.25, 100), (0.15, 85), (0.08, 65), (0.03, 45))
CAPACITY = ((0.20, 100), (0.10, 75), (0.05, 50))
ADVISORS = ((25, 100), (10, 70), (5, 40))
MARKETING = (("ad_testimonials", "ad_endorsements"), ("ad_performance", "ad_hypothetical", "ad_predecessor"), ("ad_ratings",), ("publishes",), ("social",))


def _c(name: str) -> Column:
    return F.col(name)


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _pick(*rules: tuple[Column, float], otherwise: float | None = 0.0) -> Column:
    """Points of the first rule that holds."""
    chain = F.lit(otherwise).cast("double")
    for condition, points in reversed(rules):
        chain = F.when(_yes(condition), F.lit(float(points))).otherwise(chain)
    return chain


def _tag(name: str) -> Column:
    return _yes(F.col("tags")[name]["present"])


def _hits(name: str, part: str = "hits") -> Column:
    return F.coalesce(F.col("tags")[name][part], F.lit(0))


def _read(points: Column, negative: float = 0.0) -> Column:
    """Points above the negative are findings; the negative one only once the document was read."""
    return factor(F.when(points > negative, points).when(_yes(F.col("brochure_read")), points))


def _status(otherwise: Column) -> Column:
    chain = otherwise
    for name, points in STATUS.items():
        chain = F.when(F.col("status") == name, F.lit(float(points))).otherwise(chain)
    return chain


def hnw_share() -> Column:
    return F.col("hnw_aum") / F.nullif(F.col("raum"), F.lit(0))


def average_client() -> Column:
    """Assets of a wealthy client; 0 without such clients."""
    return F.coalesce(F.col("hnw_aum") / F.nullif(F.col("hnw_clients"), F.lit(0)), F.lit(0.0))


def _mix(points: Column) -> Column:
    return factor(F.when((_n("raum") > 0) & _c("hnw_aum").isNotNull(), points), F.round(hnw_share(), 4))


def _banded(name: str) -> Callable[[Bands], Column]:
    return lambda bands=(): factor(F.when(_c(name).isNotNull(), band(_c(name), bands, 0.0)), _c(name))


def _load(bands: Bands = (), damping: Bands = ()) -> Column:
    load = _n("hnw_clients") / F.nullif(_c("iar_count"), F.lit(0))
    return factor(F.when(load.isNotNull(), F.round(band(load, bands, 0.0) * band(average_client(), damping, 0.25), 1)), F.round(load, 4))


def _rate(name: str, levels: Bands) -> Callable[[], Column]:
    rate = lambda: _c(name)
    return lambda: factor(F.when(rate().isNotNull(), F.coalesce(band(rate(), levels), F.when(rate() > 0, 25.0).otherwise(0.0))), rate())


def _relationship() -> Column:
    base = F.when(_n("recent_leads") >= 2, 50.0).otherwise(20.0)
    return factor(_status(F.when(_c("lead_decay").isNull(), 0.0).otherwise(F.round(base * _c("lead_decay"), 1))), _c("status"))


def _process() -> Column:
    models, committee, managers = _tag("model_portfolios"), _tag("investment_committee") | _yes(F.col("flags")["committee_officer"]), _tag("approved_managers")
    return _read(_pick((models & committee, 100), (managers & committee, 80), (models | committee | managers, 55), otherwise=25), 25)


def _team() -> Column:
    net = _c("team_now") - _c("team_before")
    growth = F.when(_c("team_before") > 0, net / _c("team_before")).otherwise(F.when(net > 0, 1.0).otherwise(0.0))
    rules = [((growth >= g) | (net >= n) if n else growth >= g, points) for g, n, points in TEAM]
    return factor(F.when(net.isNotNull(), _pick(*rules, (net > 0, 30), (net == 0, 10))), net)


def _support() -> Column:
    ratio = _c("support_per_advisor") / F.nullif(_c("peer_support"), F.lit(0))
    rated = F.when(ratio.isNotNull(), _pick((ratio <= 0.5, 100), (ratio <= 0.75, 75), (ratio < 1, 45), otherwise=15))
    return factor(F.when(_n("advisory_staff") == 0, None).when(_c("advisory_staff") < 2, 0.0).otherwise(rated), F.round(ratio, 4))


def _expansion() -> Column:
    parts = [(_n("new_offices") > 0, 40), (_n("new_states") >= 2, 30), (_n("new_states") == 1, 20), (_n("lift_outs") > 0, 30), (_c("years_registered") <= 3, 30), (_c("first_fund"), 20), (_c("custodian_changed"), 15)]
    total = sum((F.when(_yes(c), float(p)).otherwise(0.0) for c, p in parts), F.lit(0.0))
    return factor(F.when(_yes(_c("growth_loaded")), F.least(total, F.lit(100.0))))


def _marketing() -> Column:
    found = sum((F.when(_yes(F.exists(F.array(*(F.col("flags")[k] for k in kinds)), lambda x: x)), 1).otherwise(0) for kinds in MARKETING), F.lit(0))
    return factor(F.when((found > 0) | _c("flags").isNotNull(), found * 20.0), found)


def _mail() -> Column:
    return factor(F.when(_yes(F.array_contains("systems", "Microsoft")), 100.0).when(_c("mail") == "microsoft", 100.0).when(_c("mail").isin("google", "other", "none"), 0.0), _c("mail"))


def _roles() -> Column:
    n = _c("postings")
    known = n.isNotNull() | _c("careers").isNotNull()
    lost = _yes(_c("careers").isin("unreachable", "no_website") & ~_yes(F.col("flags")["jobs_searched"]))
    return factor(F.when(known & ~((_n("postings") == 0) & lost), _pick((n >= 3, 100), (n >= 1, 80), (_c("careers") == "page", 20), (_c("careers") == "no_openings", 10))), n)


def _fund_count() -> Column:
    """The number of private funds; an answer N forces none, Y at least one."""
    return F.when(_c("fund_answer") == "N", 0).when(_c("fund_answer") == "Y", F.greatest(_n("fund_count"), F.lit(1))).otherwise(_n("fund_count"))


FACTORS: Mapping[str, Callable[..., Column]] = {
    "hnw_fit": lambda: _mix(_pick(((hnw_share() >= 0.6) & (average_client() >= 2e6), 100), (hnw_share() >= 0.4, 75), (hnw_share() >= 0.2, 50), otherwise=25)),
    "alts_use": lambda: _read(_pick((_fund_count() >= 2, 100), (_fund_count() == 1, 75), (_tag("private_markets"), 75), (_tag("alternatives") & (_hits("alternatives") >= 2), 45), (_tag("alternatives"), 20))),
    "central_process": _process,
    "portfolio_need": lambda: _read(_pick((_tag("income") & (_tag("tax") | _tag("private_markets")), 80), (_tag("income"), 55), otherwise=25), 25),
    "re_familiarity": lambda: _read(_pick((_c("segment").isNotNull() & (_c("segment") != "competitor"), 100), (_tag("real_estate"), 100), ((_n("target_holdings") >= 3) | (_n("target_value") >= 500_000), 60), (_n("target_holdings") > 0, 30), (_tag("direct_real_estate"), 30))),
    "ops_fit": lambda: factor(F.when(_c("custodian_kind").isNotNull(), _pick(((_c("custodian_kind") == "major") & _c("is_private"), 100), (_c("custodian_kind") == "major", 60), otherwise=30)), _c("custodian_kind")),
    "relationship": _relationship,
    "repeat_potential": lambda: factor(F.when(_c("iar_count").isNotNull() | _c("hnw_clients").isNotNull(), _pick(((_n("iar_count") >= 10) | (_n("hnw_clients") >= 200), 100), ((_n("iar_count") >= 3) | (_n("hnw_clients") >= 50), 40)))),
    "exchange_frequency": lambda: _read(_pick((_tag("exchange_1031") & ((_hits("exchange_1031") >= 5) | (_hits("exchange_1031", "phrases") >= 3)), 60), (_tag("exchange_1031"), 28))),
    "owner_client_fit": lambda: _mix(_pick((average_client() >= 5e6, 100), (hnw_share() >= 0.4, 75), (hnw_share() >= 0.2, 50), (_n("hnw_clients") > 0, 25))),
    "intro_timing": lambda: factor(F.when(_c("flags").isNotNull(), _pick((F.col("flags")["financial_planning"], 67), otherwise=33))),
    "specialization": lambda: _read(_pick((_tag("specialization") & F.arrays_overlap(F.col("tags")["specialization"]["sections"], F.array(F.lit(4), F.lit(8))), 67), otherwise=33), 33),
    "relationship_strength": lambda: factor(_status(F.lit(0.0)), _c("status")),
    "referral_potential": lambda: _read(_pick((_tag("referrals") & (_n("clients_total") >= 50), 100), (_tag("referrals"), 50))),
    "overlap_1031": lambda: factor(F.when(_c("in_focus").isNotNull(), _pick((_c("in_focus"), 100)))),
    "geography_fit": lambda: factor(F.when(_c("in_focus").isNotNull(), _pick((_c("in_focus"), 100)))),
    "check_size": lambda: factor(_pick(((_n("raum") >= 2e9) | (average_client() >= 5e7), 100), (_n("raum") >= 5e8, 75), otherwise=40), _c("raum")),
    "direct_re": lambda: _read(_pick((_c("segment").isNotNull(), 100), (_tag("real_estate") | _tag("direct_real_estate"), 67), ((_n("target_holdings") > 0) | _tag("alternatives"), 33))),
    "property_type": lambda: _read(_pick((_tag("net_lease"), 100), (_tag("real_estate") | _tag("direct_real_estate"), 33))),
    "capability_gap": lambda: factor(F.lit(None).cast("double")),
    "governance_fit": lambda: factor(F.lit(None).cast("double")),
    "decision_speed": lambda: factor(F.when(_fund_count() > 0, 100.0)),
    "jv_relationship": lambda: factor(_status(F.lit(0.0)), _c("status")),
    "hnw_assets": _banded("hnw_aum"),
    "hnw_clients": _banded("hnw_clients"),
    "advisors": _banded("iar_count"),
    "schwab_share": lambda: factor(F.round(_c("custodian_share") * 100, 1), _c("custodian_share")),
    "clients_per_advisor": _load,
    "m365": _mail,
    "black_diamond": lambda: factor(F.when(_yes(F.array_contains("systems", "Black Diamond")), 100.0)),
    "best_trigger": lambda: factor(F.round(_n("trigger_points"), 1).cast("double")),
    "advisor_count": lambda: factor(band(_n("iar_count"), ADVISORS, 10.0), _c("iar_count")),
    "assets_band": lambda bands=(): factor(band(_n("raum"), bands, 0.0), _c("raum")),
    "marketing": _marketing,
    "portfolio_complexity": lambda: factor(F.when(_yes(_c("files_holdings")), 40.0).otherwise(0.0) + F.when(_hits("strategies", "phrases") >= 3, 30.0).otherwise(0.0) + F.when(_n("filings_12m") >= 2, 30.0).otherwise(0.0)),
    "compliance_owner": lambda: factor(F.when(_yes(_c("officers_loaded")), _pick((~_yes(_c("compliance_named")), 0), (_c("compliance_dual") & (_n("iar_count") >= 10), 100), otherwise=60))),
    "providers": lambda: factor(F.when(_c("provider_count").isNotNull(), band(_c("provider_count"), ((5, 100), (3, 60), (1, 20)), 0.0)), _c("provider_count")),
    "team_growth": _team,
    "asset_growth": _rate("aum_rate", ASSETS),
    "client_growth": _rate("clients_rate", CLIENTS),
    "capacity_strain": _rate("capacity_rate", CAPACITY),
    "support_gap": _support,
    "backfill": lambda: factor(F.when(_yes(_c("people_loaded")), _pick((_n("senior_left") >= 2, 100), (_n("senior_left") == 1, 70), (_n("left_12m") >= 3, 50), (_n("left_12m") > 0, 30))), _c("left_12m")),
    "succession": lambda: factor(F.when(_n("people") > 0, _pick((_n("veterans") / F.nullif(_c("people"), F.lit(0)) >= 0.4, 100), (_n("veterans") / F.nullif(_c("people"), F.lit(0)) >= 0.25, 70), (_n("veterans") / F.nullif(_c("people"), F.lit(0)) >= 0.15, 45), (_n("veterans") > 0, 25))), _c("veterans")),
    "expansion": _expansion,
    "open_roles": _roles,
}


def with_factors(features: DataFrame, keys: Mapping[str, dict] | Sequence[str]) -> DataFrame:
    """Features with a column for each factor; a mapping gives the parameters of those with bands."""
    given = keys if isinstance(keys, Mapping) else {k: {} for k in keys}
    return features.select("*", *(FACTORS[k](**of).alias(f"f_{k}") for k, of in given.items()))


def trigger_points(events: DataFrame, entity: str, kind: str, decay: str) -> DataFrame:
    """(entity, trigger_points): the most that an event of the entity is worth, its type's points by its decay."""
    base = F.lit(0.0)
    for name, points in TRIGGERS.items():
        base = F.when(F.col(kind) == name, F.lit(float(points))).otherwise(base)
    return events.groupBy(entity).agg(F.max(base * F.col(decay)).alias("trigger_points"))


#: A rule of a gate: its name and the condition that must hold.
Rule = tuple[str, Column]


def gate(kind: str, **of: object) -> Rule:
    """A gate by its kind: what must hold for an entity to be scored at all. Missing numbers count as 0."""
    raum = _n("raum")
    rules: dict[str, Callable[[], Column]] = {
        "registered": lambda: ~_yes(_c("is_exempt")) & _yes(_c("regulator") == "SEC") & F.coalesce(_c("country"), F.lit("United States")).isin("United States", "US", "USA") & (~_yes(_c("captive")) if of.get("not_captive") else F.lit(True)),
        "raum_range": lambda: (raum >= of["low"]) & (raum < of["high"]),
        "min_raum": lambda: raum >= of["low"],
        "check_capacity": lambda: raum >= of["low"],
        "individual_share": lambda: _yes((_n("hnw_aum") + _n("retail_aum")) / F.nullif(raum, F.lit(0)) >= of["least"]),
        "independent": lambda: ~_yes(_c("related_bank")) & ~_yes(_c("owned_by_bank")),
        "supported_system": lambda: F.lit(True),
        "no_private_funds": lambda: _fund_count() == 0,
        "partner_type": lambda: _any_tag(of["tags"]),
        "investment_property": lambda: _any_tag(of["tags"]) | _yes(F.col("flags")["property_phrase"]),
        "family_office": lambda: (average_client() >= of["least"]) & _yes(hnw_share() >= 0.5),
    }
    return kind, rules[kind]()


def disqualifier(kind: str, **of: object) -> Rule:
    """A disqualifier by its kind: what removes a scored entity from the ranks."""
    rules: dict[str, Callable[[], Column]] = {
        "bans_illiquid": lambda: _yes(~F.col("tags")["illiquid"]["present"]),
        "re_competitor": lambda: _yes(_c("segment") == "competitor"),
        "left_schwab": lambda: _yes(_c("last_custodian_move") == "custodian_change_from_platform"),
        "exempt_reporting": lambda: _yes(_c("is_exempt")),
        "firm_type": lambda: _yes(_c("category").isin(*of["remove"])) & (_yes(_c("category_confidence") >= of["threshold"]) | _yes(_c("category_manual"))),
    }
    return kind, rules[kind]()


def _any_tag(names: Sequence[str]) -> Column:
    out = F.lit(False)
    for name in names:
        out = out | _tag(name)
    return out


def apply_gates(features: DataFrame, gates: Sequence[Rule], disqualifiers: Sequence[Rule] = ()) -> DataFrame:
    """Features with failed_gate (the first that doesn't hold) and removed_by (the first disqualifier that does)."""
    return features.select("*", first_reason(gates, False).alias("failed_gate"), first_reason(disqualifiers, True).alias("removed_by"))


def assemble_features(firms: DataFrame, entity: str, parts: Sequence[DataFrame] = (), tags: DataFrame | None = None, flags: DataFrame | None = None, systems: DataFrame | None = None) -> DataFrame:
    """One row of features for each firm: ``parts`` have one row for each entity with columns of their own;
    ``tags`` (entity, tag, present, hits, phrases, sections), ``flags`` (entity, flag, value) and ``systems``
    (entity, system) have many and become a map, a map and a sorted array.

    An entity without rows in ``flags`` has null there, which is unread; without tags it has an empty map.
    Of repeated tags the one with most hits counts, of repeated flags a true one.
    """
    out = firms
    for part in parts:
        out = out.join(part.withColumnRenamed(entity, "_e"), F.col(entity) == F.col("_e"), "left").drop("_e")
    tag_type = "map<string,struct<present:boolean,hits:int,phrases:int,sections:array<int>>>"
    held: list[tuple[DataFrame | None, str, str]] = []
    if tags is not None:
        value = F.struct(F.col("present").cast("boolean").alias("present"), F.col("hits").cast("int").alias("hits"), F.col("phrases").cast("int").alias("phrases"), F.col("sections").cast("array<int>").alias("sections"))
        one = tags.groupBy(entity, "tag").agg(F.max_by(value, F.struct("present", "hits", "phrases", "sections")).alias("v"))
        held.append((one.groupBy(F.col(entity).alias("_e")).agg(F.map_from_entries(F.collect_list(F.struct("tag", "v"))).alias("tags")), "tags", tag_type))
    else:
        held.append((None, "tags", tag_type))
    if flags is not None:
        one = flags.groupBy(entity, "flag").agg(F.max("value").alias("v"))
        held.append((one.groupBy(F.col(entity).alias("_e")).agg(F.map_from_entries(F.collect_list(F.struct("flag", "v"))).alias("flags")), "flags", "map<string,boolean>"))
    else:
        held.append((None, "flags", "map<string,boolean>"))
    if systems is not None:
        held.append((systems.groupBy(F.col(entity).alias("_e")).agg(F.array_sort(F.collect_set("system")).alias("systems")), "systems", "array<string>"))
    else:
        held.append((None, "systems", "array<string>"))
    for frame, name, kind in held:
        out = out.join(frame, F.col(entity) == F.col("_e"), "left").drop("_e") if frame is not None else out.withColumn(name, F.lit(None).cast(kind))
    empty = F.create_map().cast(tag_type)
    out = out.withColumn("tags", F.coalesce("tags", empty))
    have = set(out.columns)
    missing = {c: t for c, t in COLUMNS.items() if c not in have}
    return out.withColumns({c: F.lit(None).cast(t) for c, t in missing.items()}) if missing else out


#: Columns that factors and gates read, with their types; ``assemble_features`` adds those that no part has, as null.
COLUMNS = {
    **dict.fromkeys("raum hnw_aum hnw_clients retail_aum clients_total iar_count fund_count custodian_share target_holdings target_value filings_12m provider_count recent_leads lead_decay trigger_points team_now team_before aum_rate clients_rate capacity_rate advisory_staff support_per_advisor peer_support left_12m senior_left veterans people new_offices new_states lift_outs years_registered postings category_confidence".split(), "double"),
    **dict.fromkeys("is_exempt captive is_private files_holdings brochure_read people_loaded growth_loaded first_fund custodian_changed in_focus related_bank owned_by_bank officers_loaded compliance_named compliance_dual category_manual".split(), "boolean"),
    **dict.fromkeys("regulator country segment custodian_kind status mail careers fund_answer last_custodian_move category".split(), "string"),
}
