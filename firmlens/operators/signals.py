"""Change detection: typed events from snapshots and histories, suppression, decay, base rates, routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..core.frames import consecutive, first_per_key


def diff_snapshots(old: DataFrame, new: DataFrame, archive: DataFrame, as_of: Column, key: str = "entity_id", amount: str = "amount", heads: str = "heads", exempt: str = "exempt", registered: str = "registered", jump: float = 0.2, drop: float = -0.25, grown: int = 2, recent_days: int = 90) -> DataFrame:
    """(key, event, before, after) of two snapshots of one source.

    A key that wasn't there is new_registration if it registered within ``recent_days`` and the archive
    doesn't have it, else reregistration_or_gap. Amounts are compared only if both sides are neither null
    nor zero, head counts if both aren't null. Exempt entities make no events.
    """
    o = old.select(F.col(key).alias("_k"), F.col(amount).alias("_amount"), F.col(heads).alias("_heads"))
    a = archive.select(F.col(key).alias("_a")).distinct()
    both = new.filter(~F.coalesce(F.col(exempt), F.lit(False))).join(o, F.col(key) == F.col("_k"), "left").join(a, F.col(key) == F.col("_a"), "left")
    fresh = F.col("_k").isNull()
    age = F.datediff(as_of, F.col(registered))
    first = F.col("_a").isNull() & (age <= recent_days)
    change = F.when((F.col("_amount") != 0) & (F.col(amount) != 0), F.col(amount) / F.col("_amount") - 1)
    text = lambda c: F.col(c).cast("double")

    def event(name: str | Column, before: Column, after: Column, when: Column) -> Column:
        return F.when(when, F.struct(name if isinstance(name, Column) else F.lit(name).alias("event"), before.alias("before"), after.alias("after")))

    none = F.lit(None).cast("double")
    events = F.array(
        event(F.when(F.coalesce(first, F.lit(False)), "new_registration").otherwise("reregistration_or_gap").alias("event"), none, text(amount), fresh),
        event("amount_jump", text("_amount"), text(amount), ~fresh & (change >= jump)),
        event("amount_drop", text("_amount"), text(amount), ~fresh & (change <= drop)),
        event("heads_growth", text("_heads"), text(heads), ~fresh & (F.col(heads) - F.col("_heads") >= grown)),
    )
    return both.select(key, F.inline(F.filter(events, lambda e: e.isNotNull())))


def dominant(df: DataFrame, key: Sequence[str], category: str, amount: str) -> DataFrame:
    """The category with the largest summed amount of each key; the least category wins a tie."""
    summed = df.groupBy(*key, category).agg(F.sum(amount).alias("total"))
    return first_per_key(summed, key, [F.desc("total"), F.asc(category)])


def category_changes(df: DataFrame, entity: str, date: str, category: str, amount: str, platform: str, weights: Mapping[str, float]) -> DataFrame:
    """(entity, date, before, after, event, direction) where the dominant category changes between consecutive dates."""
    top = dominant(df, [entity, date], category, amount)
    pairs = consecutive(top, entity, [date], [category, "total"]).filter(F.col(f"prev_{category}").isNotNull() & (F.col(f"prev_{category}") != F.col(category)))
    kind = F.when(F.col(category) == platform, "to_platform").when(F.col(f"prev_{category}") == platform, "from_platform").otherwise("other")
    direction = F.lit(0.0)
    for name, weight in weights.items():
        direction = F.when(F.col("event") == name, F.lit(float(weight))).otherwise(direction)
    return pairs.select(entity, date, F.col(f"prev_{category}").alias("before"), F.col(category).alias("after"), kind.alias("event"), "total").withColumn("direction", direction)


def suppress_transitions(events: DataFrame, rules: Sequence[tuple[str, str, str, str, str]], date: str = "date", before: str = "before", after: str = "after") -> DataFrame:
    """Events with suppressed_by, the id of the first rule (id, from, to, first day, last day) that explains the change; '*' stands for any."""
    found = F.lit(None).cast("string")
    for rule, a, b, first, last in reversed(list(rules)):
        hit = F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
        hit = hit & (F.lit(True) if a == "*" else F.col(before) == a) & (F.lit(True) if b == "*" else F.col(after) == b)
        found = F.when(hit, F.lit(rule)).otherwise(found)
    return events.withColumn("suppressed_by", found)


def first_occurrence(df: DataFrame, entity: str, date: str, name: str, condition: Column | None = None, prefix: str = "first") -> DataFrame:
    """(entity, <prefix>_date, <prefix>_name) of each entity's earliest row; the least name wins a tie."""
    rows = df if condition is None else df.filter(condition)
    return rows.groupBy(entity).agg(F.min(F.struct(F.col(date).alias("d"), F.col(name).alias("n"))).alias("_f")).select(entity, F.col("_f.d").alias(f"{prefix}_date"), F.col("_f.n").alias(f"{prefix}_name"))


def decay(date: str, as_of: Column, half_life_days: float, floor: float, direction: Column | None = None) -> Column:
    """greatest(floor, half ^ (age / half life)) times the direction; future dates count as of today."""
    age = F.greatest(F.datediff(as_of, F.col(date)), F.lit(0))
    weight = F.greatest(F.lit(float(floor)), F.pow(F.lit(0.5), age / float(half_life_days)))
    return weight if direction is None else weight * F.coalesce(direction, F.lit(1.0))


def base_rates(events: DataFrame, pool: DataFrame, entity: str = "entity_id", date: str = "date", suppressed: str = "suppressed_by", pool_date: str = "date") -> DataFrame:
    """(year, live, suppressed, pool, live_rate): events by year over the entities seen that year."""
    counted = events.groupBy(F.year(date).alias("year")).agg(F.count_if(F.col(suppressed).isNull()).alias("live"), F.count_if(F.col(suppressed).isNotNull()).alias("suppressed"))
    seen = pool.groupBy(F.year(pool_date).alias("year")).agg(F.countDistinct(entity).alias("pool"))
    joined = seen.join(counted, "year", "left").select("year", F.coalesce("live", F.lit(0)).alias("live"), F.coalesce("suppressed", F.lit(0)).alias("suppressed"), "pool")
    return joined.withColumn("live_rate", F.round(F.col("live") / F.col("pool"), 6))


def suppressed_by_rule(events: DataFrame, date: str = "date", rule: str = "suppressed_by") -> DataFrame:
    """(year, rule, n): how many events of a year each rule has suppressed."""
    return events.filter(F.col(rule).isNotNull()).groupBy(F.year(date).alias("year"), F.col(rule).alias("rule")).agg(F.count("*").alias("n"))


def live_queue(events: DataFrame, windows: Mapping[str, Column], entity: str = "entity_id", kind: str = "event", date: str = "date") -> DataFrame:
    """Different entities of each type since each of some dates."""
    return events.groupBy(kind).agg(*(F.countDistinct(F.when(F.col(date) >= since, F.col(entity))).alias(name) for name, since in windows.items()))


def route(events: DataFrame, routes: Sequence[tuple[str, str, str]], kind: str = "event") -> DataFrame:
    """Events with the products they are for: ``routes`` are (type, product, role), a fixed list."""
    spark = events.sparkSession
    table = spark.createDataFrame(list(routes), f"{kind} string, product string, role string")
    return events.join(table, kind)


def replace_by_stamp(stored: DataFrame, new: DataFrame, stamp: str, kind: str) -> DataFrame:
    """Stored events without those of the new ones' stamps and types, and the new ones."""
    return stored.join(new.select(stamp, kind).distinct(), [stamp, kind], "left_anti").unionByName(new)


def open_signals(events: DataFrame, actions: DataFrame, as_of: Column, days: int, key: str = "event_id", date: str = "date") -> DataFrame:
    """Events of the last ``days`` that nobody has acted on."""
    return events.filter(F.datediff(as_of, F.col(date)).between(0, days)).join(actions.select(key).distinct(), key, "left_anti")


def feed(events: DataFrame, firms: DataFrame, scope: DataFrame, scores: DataFrame, actions: DataFrame, entity: str = "entity_id", product: str | None = None, kind: str | None = None, q: str | None = None, state: str | None = "open", since: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, counts by kind) of the signals feed: events that aren't suppressed of entities on a list.

    ``product`` keeps entities scored on that list, ``q`` those whose name holds a text or whose id it is, ``state`` events of that
    state of action (open: none; None: all), ``since`` newer ones. Rows carry the firm's and the scope's columns
    and the state; ``feed_order`` tells their order. Counts are over all of the filters, so they add up to the rows.
    """
    live = events.filter(~F.coalesce("suppressed", F.lit(False)))
    live = live if kind is None else live.filter(F.col("event") == kind)
    live = live if since is None else live.filter(F.col("date") >= since)
    named = firms if q is None else firms.filter(F.coalesce(F.lower("name").contains(q.lower()), F.lit(False)) | (F.col(entity).cast("string") == q))
    rows = live.join(named, entity).join(scope, entity)
    if product is not None:
        rows = rows.join(scores.filter((F.col("product") == product) & (F.col("status") == "scored")).select(entity).distinct(), entity, "left_semi")
    acted = rows.join(actions.select(F.col("event_id").alias("_id"), F.col("state").alias("action")), F.col("event_id") == F.col("_id"), "left").drop("_id")
    if state is not None:
        acted = acted.filter(F.col("action").isNull() if state == "open" else F.col("action") == state)
    return acted, acted.groupBy("event").agg(F.count("*").alias("n"))


def feed_order() -> list[tuple[str, bool]]:
    """The feed's order for ``search.page``: newest first, then by the size of the priority."""
    return [("date", True), ("weight", True)]


def position_conviction(holdings: DataFrame, entity: str, value: str, many: int = 3, large: float = 500_000, small: float = 100_000) -> DataFrame:
    """(entity, positions, largest, conviction): deliberate with many or a large position, possible_legacy with one small one."""
    found = holdings.groupBy(entity).agg(F.count("*").alias("positions"), F.max(value).alias("largest"))
    kind = F.when((F.col("positions") >= many) | (F.col("largest") >= large), "deliberate").when((F.col("positions") == 1) & (F.col("largest") < small), "possible_legacy").otherwise("holding")
    return found.withColumn("conviction", kind)


def latest_holding(holdings: DataFrame, entity: str, ticker: str, quarter: str, value: str) -> DataFrame:
    """The value of each (entity, ticker) in its latest quarter."""
    return holdings.groupBy(entity, ticker).agg(F.max_by(value, F.struct(quarter, value)).alias(value), F.max(quarter).alias(quarter))
