"""Timelines: stints, movement, head counts, growth against as-of history, peers, veterans and departures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core.frames import first_per_key, islands, peer_median, top_n_per_key
from .joins import asof_join, last_start_before, nearest_join


def stints(regs: DataFrame, key: Sequence[str], start: str = "start_date", end: str = "end_date", current: str | None = None, gap_days: int = 90) -> DataFrame:
    """(key, start, end, n) with the spans of a key chained where the gap is at most ``gap_days``.

    A missing end is open if the span is current, else it is its start. An open end wins its stint.
    Rows without a start pass through as stints of their own.
    """
    open_end = F.lit("9999-12-31").cast("date")
    is_open = F.col(end).isNull() & (F.coalesce(F.col(current), F.lit(False)) if current else F.lit(False))
    dated = regs.filter(F.col(start).isNotNull()).withColumn("_end", F.when(is_open, open_end).otherwise(F.coalesce(F.col(end), F.col(start))))
    runs = islands(dated, list(key), start, "_end", gap_days)
    chained = runs.groupBy(*key, "island").agg(F.min(start).alias(start), F.max("_end").alias("_end"), F.count("*").alias("n"))
    out = chained.select(*key, start, F.when(F.col("_end") != open_end, F.col("_end")).alias(end), "n")
    undated = regs.filter(F.col(start).isNull()).select(*key, start, end, F.lit(1).cast("long").alias("n"))
    return out.unionByName(undated)


def movement_events(spans: DataFrame, tracked: DataFrame, person: str, org: str, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """(org, person, kind, date), different, of joining and leaving tracked organisations."""
    events = F.array(F.struct(F.lit("joined").alias("kind"), F.col(start).alias("date")), F.struct(F.lit("left").alias("kind"), F.col(end).alias("date")))
    return spans.join(tracked, org, "left_semi").select(org, person, F.inline(events)).filter(F.col("date").isNotNull()).distinct()


def came_from(spans: DataFrame, person: str, org: str, start: str, end: str, lo: int = -730, hi: int = 90) -> DataFrame:
    """Each stint with from_<org>: the person's other stint whose end is nearest its start, from 730 days before to 90 after."""
    other = spans.filter(F.col(end).isNotNull()).select(person, F.col(end).alias("_end"), org).distinct()
    return nearest_join(spans, other, person, start, "_end", lo, hi, [org], ["_end"], other_than=org, prefix="from_")


def went_to(spans: DataFrame, person: str, org: str, start: str, end: str, lo: int = -90, hi: int = 730) -> DataFrame:
    """Each ended stint with to_<org>: the other stint with the nearest start, a current one first on ties; else the open stint that started last."""
    other = spans.select(person, F.col(start).alias("_start"), F.col(end).isNull().alias("_open"), org).distinct()
    best = nearest_join(spans.filter(F.col(end).isNotNull()), other, person, end, "_start", lo, hi, [org], ["_open", "_start"], other_than=org, prefix="_to_")
    latest = first_per_key(other.filter("_open"), [person], [F.col("_start").desc_nulls_last(), F.col(org)]).select(F.col(person).alias("_p"), F.col(org).alias("_latest"))
    out = best.join(latest, F.col(person) == F.col("_p"), "left")
    return out.select(*spans.columns, F.coalesce(f"_to_{org}", F.when(F.col("_latest") != F.col(org), F.col("_latest"))).alias(f"to_{org}"))


def windows_12m(events: DataFrame, group: str, date: str, as_of: Column, who: str | None = None) -> DataFrame:
    """(group, last_12m, prior_12m, net): different people (or rows) of the half-open windows (365 days back, as_of] and the year before."""
    age = F.datediff(as_of, F.col(date))
    of = (lambda c: F.countDistinct(F.when(c, F.col(who)))) if who else F.count_if
    last, prior = of((age >= 0) & (age < 365)), of((age >= 365) & (age < 730))
    return events.groupBy(group).agg(last.alias("last_12m"), prior.alias("prior_12m")).withColumn("net", F.col("last_12m") - F.col("prior_12m"))


def top_flows(events: DataFrame, group: str, other: str, who: str, n: int = 5, out: str = "flows") -> DataFrame:
    """(group, flows): the top ``n`` others by different people, as 'other:count' in order."""
    counted = events.filter(F.col(other).isNotNull()).groupBy(group, other).agg(F.countDistinct(who).alias("n"))
    ranked = top_n_per_key(counted, group, [F.desc("n"), F.asc(other)], n, "rank")
    row = F.struct("rank", F.concat_ws(":", F.col(other).cast("string"), F.col("n").cast("string")).alias("v"))
    return ranked.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["v"]), ",").alias(out))


def people_stats(emp: DataFrame, events: DataFrame, as_of: Column, org: str = "org", person: str = "person", start: str = "start_date", end: str = "end_date") -> DataFrame:
    """(org, headcount, hires, departures, net, mean_tenure, top_sources, top_destinations), every org of any part.

    ``events`` has org, person, kind (joined, left), date and other (the organisation before or after).
    Flows look back 1,096 days.
    """
    now = emp.filter((F.col(start) <= as_of) & (F.col(end).isNull() | (F.col(end) > as_of)))
    staff = now.groupBy(org).agg(F.countDistinct(person).alias("headcount"), F.round(F.avg(F.datediff(as_of, F.col(start)) / 365.25), 2).alias("mean_tenure"))
    age = F.datediff(as_of, F.col("date"))
    year = events.filter((age >= 0) & (age < 365))
    moves = year.groupBy(org).agg(F.countDistinct(F.when(F.col("kind") == "joined", F.col(person))).alias("hires"), F.countDistinct(F.when(F.col("kind") == "left", F.col(person))).alias("departures"))
    flows = events.filter((age >= 0) & (age <= 1096))
    sources = top_flows(flows.filter("kind = 'joined'"), org, "other", person, out="top_sources")
    goals = top_flows(flows.filter("kind = 'left'"), org, "other", person, out="top_destinations")
    out = staff.join(moves, org, "full").join(sources, org, "full").join(goals, org, "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(org, zero("headcount"), zero("hires"), zero("departures"), (F.coalesce("hires", F.lit(0)) - F.coalesce("departures", F.lit(0))).alias("net"), "mean_tenure", "top_sources", "top_destinations")


def headcount_series(spans: DataFrame, years: Sequence[int], as_of: str, group: str | None, person: str, start: str, end: str) -> DataFrame:
    """(group, year, headcount) of different people on each year's last day, or on ``as_of`` in its year.

    Each span makes the list of years whose last day it holds; no join on a range.
    """
    last = as_of[:4]
    day = lambda y: F.when(y == int(last), F.lit(as_of).cast("date")).otherwise(F.make_date(y, F.lit(12), F.lit(31)))
    inside = F.filter(F.sequence(F.lit(min(years)), F.lit(max(years))), lambda y: (F.col(start) <= day(y)) & (F.col(end).isNull() | (F.col(end) >= day(y))))
    keys = [group] if group else []
    return spans.select(*keys, person, F.explode(inside).alias("year")).groupBy(*keys, "year").agg(F.countDistinct(person).alias("headcount"))


def moves_by_year(events: DataFrame, years: Sequence[int], group: str | None, person: str = "person", date: str = "date", kind: str = "kind") -> DataFrame:
    """(group, year, joined, left): different people who joined and left in each year."""
    keys = [group] if group else []
    of = lambda k: F.countDistinct(F.when(F.col(kind) == k, F.col(person))).alias(k)
    return events.filter(F.year(date).isin(*years)).groupBy(*keys, F.year(date).alias("year")).agg(of("joined"), of("left"))


def people_flags(emp: DataFrame, people: DataFrame, events: DataFrame, as_of: Column, org: str = "org", person: str = "person", start: str = "start_date", end: str = "end_date") -> DataFrame:
    """(org, cfp, cfa, dual, disclosure, hires_prior, departures_prior): current people with credentials and flags, and moves of the year before the last.

    ``people`` has person, designations (array), dual and has_disclosure, one row each; ``events`` org, person, kind and date.
    """
    now = emp.filter((F.col(start) <= as_of) & (F.col(end).isNull() | (F.col(end) > as_of))).select(org, person).distinct()
    known = now.join(people.withColumnRenamed(person, "_p"), F.col(person) == F.col("_p"))
    has = lambda word: F.count_if(F.exists("designations", lambda d: F.upper(d).contains(word)))
    staff = known.groupBy(org).agg(has("CFP").alias("cfp"), has("CFA").alias("cfa"), F.count_if("dual").alias("dual"), F.count_if("has_disclosure").alias("disclosure"))
    age = F.datediff(as_of, F.col("date"))
    prior = events.filter((age >= 365) & (age < 730))
    moved = prior.groupBy(F.col(org).alias("_o")).agg(F.countDistinct(F.when(F.col("kind") == "joined", F.col(person))).alias("hires_prior"), F.countDistinct(F.when(F.col("kind") == "left", F.col(person))).alias("departures_prior"))
    out = staff.join(moved, F.col(org) == F.col("_o"), "full")
    return out.select(F.coalesce(org, "_o").alias(org), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("cfp", "cfa", "dual", "disclosure", "hires_prior", "departures_prior")))


def growth_rate(now: Column, before: Column, days: Column) -> Column:
    """Change over the period, by the year if it is longer than 456 days; null for before <= 0, now < 0 or no days."""
    ratio = now / before
    yearly = F.pow(ratio, F.lit(365.0) / days) - 1
    return F.when((before > 0) & (now >= 0) & (days > 0), F.round(F.when(days > 456, yearly).otherwise(ratio - 1), 4))


def growth(history: DataFrame, key: str, date: str, measures: Sequence[str], min_gap_days: int = 300) -> DataFrame:
    """Each filing beside the latest at least ``min_gap_days`` earlier, with <measure>_growth."""
    paired = asof_join(history, key, date, [date, *measures], min_gap_days)
    days = F.datediff(F.col(date), F.col(f"prev_{date}"))
    return paired.select("*", days.alias("gap_days"), *(growth_rate(F.col(m), F.col(f"prev_{m}"), days).alias(f"{m}_growth") for m in measures))


def peer_gap(df: DataFrame, band: Column, value: str, min_n: int = 20) -> DataFrame:
    """Each row with its band, the band's median and the ratio to it."""
    medians = peer_median(df, band, value, min_n).withColumnRenamed("band", "_band")
    joined = df.withColumn("band", band).join(medians.select("_band", "peer_median"), F.col("band") == F.col("_band"), "left").drop("_band")
    return joined.withColumn("peer_ratio", F.round(F.col(value) / F.nullif(F.col("peer_median"), F.lit(0.0)), 6))


def veterans(people: DataFrame, org: str, person: str, first: str, as_of: Column, years: float, n: int = 6) -> DataFrame:
    """(org, staff, veterans, share, names): people whose first registration is ``years`` old, the longest first."""
    old = F.datediff(as_of, F.col(first)) >= years * 365.25
    shares = people.groupBy(org).agg(F.countDistinct(person).alias("staff"), F.countDistinct(F.when(old, F.col(person))).alias("veterans"))
    top = top_n_per_key(people.filter(old), org, [F.asc(first), F.asc(person)], n, "rank")
    names = top.groupBy(org).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(person).cast("string").alias("p")))), lambda r: r["p"]), ",").alias("names"))
    return shares.join(names, org, "left").withColumn("share", F.round(F.col("veterans") / F.col("staff"), 4))


def departures(events: DataFrame, spans: DataFrame, firsts: DataFrame, org: str, person: str, date: str, start: str, first: str) -> DataFrame:
    """Departures with years at the firm and in the industry; senior from 5 or 15 years."""
    placed = last_start_before(events, spans, [org, person], date, start, "since")
    joined = placed.join(firsts.withColumnRenamed(person, "_p"), F.col(person) == F.col("_p"), "left").drop("_p")
    tenure = F.round(F.datediff(F.col(date), F.col("since")) / 365.25, 2)
    industry = F.round(F.datediff(F.col(date), F.col(first)) / 365.25, 2)
    return joined.withColumns({"tenure_years": tenure, "industry_years": industry}).withColumn("senior", F.coalesce((F.col("tenure_years") >= 5) | (F.col("industry_years") >= 15), F.lit(False)))


def lift_outs(joins: DataFrame, org: str, other: str, person: str, date: str, as_of: Column, least: int = 3, days: int = 365) -> DataFrame:
    """(org, other, people): at least ``least`` different people from one place within ``days``."""
    return joins.filter(F.datediff(as_of, F.col(date)).between(0, days)).groupBy(org, other).agg(F.countDistinct(person).alias("people")).filter(F.col("people") >= least)


def new_places(df: DataFrame, entity: str, place: Sequence[str], date: str, as_of: Column, days: int = 365) -> DataFrame:
    """Places first seen within ``days`` at entities that have an older one."""
    first = df.groupBy(entity, *place).agg(F.min(date).alias("first_seen"))
    older = F.datediff(as_of, F.col("first_seen")) > days
    marked = first.withColumn("_older", F.max(older).over(Window.partitionBy(entity)))
    return marked.filter(F.col("_older") & ~older & (F.col("first_seen") <= as_of)).drop("_older")


def new_states(df: DataFrame, entity: str, state: str, status: str, date: str, as_of: Column, ended: Sequence[str], days: int = 365) -> DataFrame:
    """(entity, states, new_states): active states, and those that began within ``days``."""
    active = df.filter(~F.col(status).isin(*ended))
    return active.groupBy(entity).agg(F.countDistinct(state).alias("states"), F.countDistinct(F.when(F.datediff(as_of, F.col(date)).between(0, days), F.col(state))).alias("new_states"))


def team_growth(net: Column, headcount: Column) -> Column:
    """net / (headcount - net) where that is positive."""
    base = headcount - net
    return F.when(base > 0, F.round(net / base, 4))


def filings_12m(df: DataFrame, entity: str, date: str, as_of: Column) -> DataFrame:
    """Different filing dates of the last 365 days."""
    return df.filter(F.datediff(as_of, F.col(date)).between(0, 365)).groupBy(entity).agg(F.countDistinct(date).alias("filings_12m"))


def open_postings(df: DataFrame, entity: str, title: str, source: str, function: str, precedence: Sequence[str]) -> DataFrame:
    """(entity, postings, by_function): one posting a title, the first source wins; counts by function as a sorted map."""
    rank = F.array_position(F.array(*map(F.lit, precedence)), F.col(source))
    one = first_per_key(df.withColumn("_title", F.lower(F.trim(title))), [entity, "_title"], [F.when(rank == 0, 99).otherwise(rank), F.asc(title)])
    by = one.groupBy(entity, function).agg(F.count("*").alias("n"))
    return by.groupBy(entity).agg(F.sum("n").alias("postings"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(function), F.lit("other")), "n")))).alias("by_function"))


def roster(emp: DataFrame, officers: DataFrame, prior: DataFrame, as_of: Column, org: str, person: str, start: str, end: str) -> DataFrame:
    """Current people of each org with tenure, title and prior org; officers first, then by tenure.

    ``officers`` has org, person, title; ``prior`` has person, prior_org, one row per person.
    """
    now = emp.filter((F.col(start) <= as_of) & (F.col(end).isNull() | (F.col(end) > as_of)))
    one = now.groupBy(org, person).agg(F.min(start).alias(start))
    titled = one.join(officers, [org, person], "left").join(prior, person, "left")
    tenure = F.round(F.datediff(as_of, F.col(start)) / 365.25, 2)
    order = Window.partitionBy(org).orderBy(F.col("title").isNull(), F.asc(start), F.asc(person))
    return titled.withColumn("tenure_years", tenure).withColumn("place", F.row_number().over(order))


def officers_unmatched(officers: DataFrame, matched: DataFrame, left: DataFrame, org: str, name: str) -> DataFrame:
    """Officers without a person on the roster, their titles merged; former with the date on which they left."""
    lone = officers.join(matched, [org, name], "left_anti")
    merged = lone.groupBy(org, name).agg(F.array_join(F.array_sort(F.collect_set("title")), "; ").alias("titles"))
    return merged.join(left, [org, name], "left").withColumn("former", F.col("left_date").isNotNull())


def recent_moves(events: DataFrame, as_of: Column, days: int, limit: int, date: str = "date") -> DataFrame:
    """The newest events of the last ``days``; a report of ``limit`` rows."""
    return events.filter(F.datediff(as_of, F.col(date)).between(0, days)).orderBy(F.desc(date), *sorted(c for c in events.columns if c != date)).limit(limit)


def flows(events: DataFrame, source: str, target: str, person: str) -> DataFrame:
    """(source, target, people) between organisations."""
    return events.filter(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(source, target).agg(F.countDistinct(person).alias("people"))


def capacity_growth(assets_now: Column, assets_before: Column, advisors_now: Column, advisors_before: Column) -> Column:
    """Growth of assets per advisor: the ratio of the two ratios less one; null without a part or with a zero below."""
    ratio = lambda a, b: a / F.nullif(b, F.lit(0))
    return ratio(ratio(assets_now, advisors_now), ratio(assets_before, advisors_before)) - 1


def firm_growth(firms: DataFrame, pairs: DataFrame, team: DataFrame, departed: DataFrame, veterans: DataFrame, places: DataFrame, lifts: DataFrame, events: DataFrame, as_of: Column, entity: str = "entity_id") -> DataFrame:
    """The growth row of every firm, with its nested detail.

    ``pairs`` has one row for each entity with now and before of raum, clients and advisors and the days
    between; ``team`` entity, person, kind (joined, left) and date; ``departed`` entity, name, tenure and
    senior; ``veterans`` entity, n30 and people; ``places`` entity, city, state of new offices; ``lifts``
    entity, org and n; ``events`` entity, type and date. A rate over more than 456 days is a yearly one.
    A firm without rows of a part has null or 0 there. Lists hold at most the 20 first rows by their order,
    which is the report's size; the counts beside them cover all.
    """
    e = F.col(entity)
    days = F.col("days")
    annual = lambda now, before: growth_rate(F.col(now), F.col(before), days)
    change = lambda now, before: F.col(now) / F.nullif(F.col(before), F.lit(0)) - 1
    capacity = lambda: capacity_growth(F.col("raum_now"), F.col("raum_before"), F.col("advisors_now"), F.col("advisors_before"))
    rates = pairs.select(
        e.alias("_pairs"),
        "days",
        *(F.round(change(f"{m}_now", f"{m}_before"), 6).alias(f"{m}_change") for m in ("raum", "clients", "advisors")),
        *(F.round(annual(f"{m}_now", f"{m}_before"), 6).alias(f"{m}_rate") for m in ("raum", "clients", "advisors")),
        F.round(capacity(), 6).alias("capacity_change"),
    )
    age = F.datediff(as_of, F.col("date"))
    moves = team.groupBy(e.alias("_team")).agg(*(F.countDistinct(F.when((F.col("kind") == k) & (age >= lo) & (age < lo + 365), F.col("person"))).alias(f"{k}_{w}") for k in ("joined", "left") for w, lo in (("12m", 0), ("prior_12m", 365))))

    def nested(df: DataFrame, order: Sequence[str], cols: Sequence[str], name: str, *counts: Column) -> DataFrame:
        ranked = top_n_per_key(df, entity, [*(F.desc_nulls_last(o) for o in order), *(F.asc_nulls_last(c) for c in cols)], 20, "_at")
        rows = ranked.groupBy(e.alias(f"_{name}")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", *cols))), lambda r: F.struct(*(r[c].alias(c) for c in cols))).alias(name))
        return rows.join(df.groupBy(e.alias("_of")).agg(F.count("*").alias(f"n_{name}"), *counts), F.col(f"_{name}") == F.col("_of")).drop("_of")

    recent = events.filter((age >= 0) & (age < 365))
    parts = [
        (rates, "_pairs"),
        (moves, "_team"),
        (nested(departed, ["senior", "tenure"], ["name", "tenure", "senior"], "departures", F.count_if("senior").alias("departures_senior")), "_departures"),
        (veterans.select(e.alias("_veterans"), "n30", "people", F.round(F.col("n30") / F.nullif(F.col("people"), F.lit(0)), 6).alias("veteran_share")), "_veterans"),
        (nested(places, [], ["state", "city"], "locations"), "_locations"),
        (nested(lifts, ["n"], ["org", "n"], "lift_outs"), "_lift_outs"),
        (nested(recent, ["date"], ["type", "date"], "events"), "_events"),
    ]
    out = firms
    for frame, key in parts:
        out = out.join(frame, e == F.col(key), "left").drop(key)
    zero = [c for c in out.columns if c.startswith(("n_", "joined_", "left_")) or c == "departures_senior"]
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero} | {"net_12m": F.coalesce("joined_12m", F.lit(0)) - F.coalesce("left_12m", F.lit(0))})
