"""Weighted scoring that keeps missing evidence apart from findings, with gates, penalties, ranks and scope.

A factor is a column of struct(points double, evidence string, known boolean). An unknown factor
earns nothing and leaves coverage; a negative finding earns its low level and counts as known.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..core.frames import cumulative


def factor(points: Column, evidence: Column | None = None, known: Column | None = None) -> Column:
    """struct(points, evidence, known); null points are unknown."""
    is_known = points.isNotNull() if known is None else F.coalesce(known, F.lit(False)) & points.isNotNull()
    text = F.lit(None).cast("string") if evidence is None else evidence.cast("string")
    return F.struct(F.when(is_known, points.cast("double")).otherwise(0.0).alias("points"), text.alias("evidence"), is_known.alias("known"))


def band(value: Column, bands: Sequence[tuple[float, float]], default: float | None = None) -> Column:
    """Points of the first threshold, from high to low, that the value reaches; below all and null the default."""
    chain = F.lit(default).cast("double")
    for threshold, points in sorted(bands):
        chain = F.when(value >= threshold, F.lit(float(points))).otherwise(chain)
    return chain


def field_factor(value: Column, bands: Sequence[tuple[float, float]], below: float = 0.0) -> Column:
    """A numeric field by bands; null is unknown."""
    return factor(F.when(value.isNotNull(), band(value, bands, below)), value)


def flag_factor(flag: Column, yes: float, no: float) -> Column:
    """A flag of three states by two levels; null is unknown."""
    return factor(F.when(flag, F.lit(float(yes))).when(~flag, F.lit(float(no))), flag)


def tag_factor(hits: Column, read: Column, levels: Sequence[tuple[int, float]], negative: float) -> Column:
    """Hits of a tag by levels; no hit is a finding only once the document was read."""
    found = F.coalesce(hits, F.lit(0))
    return factor(F.when(found > 0, band(found, levels, negative)).when(F.coalesce(read, F.lit(False)), F.lit(float(negative))), found)


def steps(value: Column, thresholds: Sequence[tuple[float, float]], positive: float, otherwise: float = 0.0) -> Column:
    """Growth steps: the first rate reached, else ``positive`` if above zero; null is unknown."""
    return factor(F.when(value.isNotNull(), F.coalesce(band(value, thresholds, None), F.when(value > 0, F.lit(float(positive))).otherwise(otherwise))), value)


def damped_load(clients: Column, reps: Column, average: Column, bands: Sequence[tuple[float, float]], damping: Sequence[tuple[float, float]], default: float = 0.25) -> Column:
    """Clients a representative, damped by average account size; no representatives is unknown."""
    load = clients / F.nullif(reps, F.lit(0))
    return factor(F.when(load.isNotNull(), band(load, bands, 0.0) * band(average, damping, default)), load)


def rescale(points: Column, levels: Sequence[float], edited: Sequence[float]) -> Column:
    """Piecewise linear map of built-in levels to edited ones, fixed at 0 and 100.

    Levels are matched in order, so levels edited out of order keep their own points.
    """
    inner = {float(a): float(b) for a, b in zip(levels, edited)}
    known = {0.0: 0.0, 100.0: 100.0} | inner
    at = sorted(known)
    chain = F.lit(known[at[-1]])
    for a, b in reversed(list(zip(at[:-1], at[1:]))):
        chain = F.when(points <= b, F.lit(known[a]) + (points - a) * ((known[b] - known[a]) / (b - a))).otherwise(chain)
    return F.when(points <= at[0], F.lit(known[at[0]])).otherwise(chain)


def capped_sum(parts: Sequence[tuple[Column, float]], cap: float = 100.0) -> Column:
    """The sum of the points of the parts that hold, at most ``cap``; unknown if all are null."""
    total, some = F.lit(0.0), F.lit(False)
    for condition, points in parts:
        total = total + F.when(F.coalesce(condition, F.lit(False)), float(points)).otherwise(0.0)
        some = some | condition.isNotNull()
    return factor(F.when(some, F.least(total, F.lit(float(cap)))))


def best_trigger(events: DataFrame, entity: str, kind: str, weight: str, base: Mapping[str, float]) -> DataFrame:
    """(entity, trigger): the event with the most points, base of its type by its decayed weight."""
    points = F.lit(0.0)
    for name, value in base.items():
        points = F.when(F.col(kind) == name, float(value) * F.col(weight)).otherwise(points)
    best = F.max_by(F.struct(points.alias("points"), F.col(kind).alias("evidence"), F.lit(True).alias("known")), F.struct(points, F.col(kind)))
    return events.groupBy(entity).agg(best.alias("trigger"))


@dataclass
class Product:
    """A product's factors with weights, gates, disqualifiers, penalties and the version of its rules."""

    key: str
    weights: Mapping[str, float]
    gates: Sequence[tuple[str, Column]] = field(default_factory=list)  # must hold, else not stored
    disqualifiers: Sequence[tuple[str, Column]] = field(default_factory=list)  # remove from the ranks
    penalties: Sequence[tuple[str, Column, float]] = field(default_factory=list)
    version: str = "1"


def first_reason(rules: Sequence[tuple[str, Column]], when: bool) -> Column:
    """The name of the first rule that is (or isn't) true."""
    chain = F.lit(None).cast("string")
    for name, condition in reversed(list(rules)):
        holds = F.coalesce(condition, F.lit(False))
        chain = F.when(holds if when else ~holds, F.lit(name)).otherwise(chain)
    return chain


def score(features: DataFrame, entity: str, product: Product, overrides: DataFrame | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """(entity, product, status, reason, score, coverage, potential, missing, factors) for each row that passes the gates.

    ``overrides`` has entity, criterion and points, one row each: they replace a factor's points and
    make it known. The score is the weighted mean over all weights less penalties, not below 0;
    coverage is the share of known weights; potential adds the unknown weights, at most 100.
    """
    kept = features.filter(first_reason(product.gates, False).isNull())
    keys = list(product.weights)
    if overrides is not None:
        manual = overrides.groupBy(F.col(entity).alias("_e")).agg(F.map_from_entries(F.collect_list(F.struct("criterion", "points"))).alias("_manual"))
        kept = kept.join(manual, F.col(entity) == F.col("_e"), "left")
        value = lambda k: F.when(F.col("_manual")[k].isNotNull(), F.struct(F.col("_manual")[k].cast("double").alias("points"), F.lit("override").alias("evidence"), F.lit(True).alias("known"))).otherwise(F.col(k))
    else:
        value = F.col
    total = float(sum(product.weights.values())) or 1.0
    row = lambda k: F.struct(F.lit(k).alias("key"), F.lit(float(product.weights[k])).alias("weight"), value(k)["points"].alias("points"), value(k)["evidence"].alias("evidence"), value(k)["known"].alias("known"), (value(k)["points"] * product.weights[k] / total).alias("contrib"))
    listed = kept.withColumn("factors", F.array(*map(row, keys)))
    zero = F.lit(0.0)
    earned = F.aggregate("factors", zero, lambda a, f: a + F.when(f["known"], f["contrib"]).otherwise(0.0))
    known = F.aggregate("factors", zero, lambda a, f: a + F.when(f["known"], f["weight"]).otherwise(0.0)) * (100.0 / total)
    off = F.lit(0.0)
    for _, condition, points in product.penalties:
        off = off + F.when(F.coalesce(condition, F.lit(False)), float(points)).otherwise(0.0)
    net = F.greatest(zero, earned - off)
    reason = first_reason(product.disqualifiers, True)
    missing = F.transform(F.filter("factors", lambda f: ~f["known"]), lambda f: f["key"])
    return listed.select(
        entity,
        *carry,
        F.lit(product.key).alias("product"),
        F.when(reason.isNull(), "scored").otherwise("disqualified").alias("status"),
        reason.alias("reason"),
        F.round(net, 1).alias("score"),
        F.round(known, 1).alias("coverage"),
        F.round(F.least(F.lit(100.0), net + 100.0 - known), 1).alias("potential"),
        missing.alias("missing"),
        "factors",
        F.lit(product.version).alias("config_stamp"),
    )


def rank_lists(scores: DataFrame, entity: str, size: str | None = None) -> DataFrame:
    """Scores with the place in each product's list; rows that aren't scored have none.

    Places are counted over ranges of the order, so a product's list is no single task.
    """
    order = [F.desc("score"), F.col("coverage").desc_nulls_last(), *([F.col(size).desc_nulls_last()] if size else []), F.asc(entity)]
    placed = cumulative(scores.filter("status = 'scored'").withColumn("_one", F.lit(1).cast("long")), ["product"], order, "_one", "rank").drop("_one")
    rest = scores.filter("status is null or status <> 'scored'").withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest)


def scope(scores: DataFrame, entity: str, floors: Mapping[str, float] | None = None) -> DataFrame:
    """(entity, best_product, best_score, products, priority) over scored rows; a product's floor leaves lower scores out."""
    rows = scores.filter("status = 'scored'")
    for product, least in (floors or {}).items():
        rows = rows.filter((F.col("product") != product) | (F.col("score") >= least))
    best = F.max(F.struct("score", "coverage", "product"))
    found = rows.groupBy(entity).agg(best.alias("_b"), F.array_sort(F.collect_set("product")).alias("products"))
    return found.select(entity, F.col("_b.product").alias("best_product"), F.col("_b.score").alias("best_score"), "products", F.round(F.col("_b.score") + F.col("_b.coverage") / 1000, 4).alias("priority"))


def top_reasons(scores: DataFrame, n: int = 3) -> DataFrame:
    """Scores with the keys of the ``n`` factors that contribute most, ties by key."""
    known = F.filter("factors", lambda f: f["known"] & (f["contrib"] > 0))
    ordered = F.array_sort(F.transform(known, lambda f: F.struct((-f["contrib"]).alias("less"), f["key"].alias("key"))))
    return scores.withColumn("top_reasons", F.transform(F.slice(ordered, 1, n), lambda f: f["key"]))


def choose_text(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The text of the first rule that holds: lead lines and talking points."""
    chain = F.lit(otherwise)
    for condition, text in reversed(list(rules)):
        chain = F.when(F.coalesce(condition, F.lit(False)), F.lit(text)).otherwise(chain)
    return chain


def type_policy(category: Column, confidence: Column, manual: Column, remove: Sequence[str], threshold: float, soft: float) -> tuple[Column, Column]:
    """(removed, penalty) of a firm's type: removed if listed and sure or set by hand, else a penalty; unknown types have neither."""
    listed = F.coalesce(category.isin(*remove), F.lit(False))
    sure = F.coalesce(confidence >= threshold, F.lit(False)) | F.coalesce(manual, F.lit(False))
    return listed & sure, F.when(listed & ~sure, float(soft)).otherwise(0.0)


def list_kpis(scores: DataFrame, fresh: DataFrame, reachable: DataFrame, entity: str) -> DataFrame:
    """(product, n, mean_coverage, sixty_plus, full, disqualified, fresh, reachable) of each list."""
    marked = scores.join(fresh.select(F.col(entity).alias("_f")).distinct(), F.col(entity) == F.col("_f"), "left").join(reachable.select(F.col(entity).alias("_r")).distinct(), F.col(entity) == F.col("_r"), "left")
    live = F.col("status") == "scored"
    return marked.groupBy("product").agg(
        F.count_if(live).alias("n"),
        F.round(F.avg(F.when(live, F.col("coverage"))), 2).alias("mean_coverage"),
        F.count_if(live & (F.col("score") >= 60)).alias("sixty_plus"),
        F.count_if(live & (F.col("coverage") >= 100)).alias("full"),
        F.count_if(~live).alias("disqualified"),
        F.count_if(live & F.col("_f").isNotNull()).alias("fresh"),
        F.count_if(live & F.col("_r").isNotNull()).alias("reachable"),
    )


def score_summary(scores: DataFrame) -> DataFrame:
    """(product, status, reason, tens, n): distribution of scores and counts of removal reasons."""
    return scores.groupBy("product", "status", "reason", (F.floor(F.col("score") / 10) * 10).cast("int").alias("tens")).agg(F.count("*").alias("n"))
