"""Incremental maintenance: refresh plans, keyed refresh, delta writes, work queues, shards, retention."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..core.frames import top_n_per_key


def plan_refresh(old: DataFrame, new: DataFrame, key: str, mark: str, inputs_changed: bool = False, daily: bool = False, full_share: float = 0.2) -> DataFrame:
    """One row (decision, changed, total): unchanged, refresh, or full if inputs changed, daily, or over ``full_share`` of keys changed."""
    from .joins import fingerprint_diff

    changes = fingerprint_diff(old, new, key, mark)
    counted = changes.agg(F.count_if(F.col("change") != "unchanged").alias("changed"), F.count("*").alias("total"))
    full = F.lit(inputs_changed or daily) | (F.col("changed") > full_share * F.col("total"))
    return counted.select(F.when(full, "full").when(F.col("changed") == 0, "unchanged").otherwise("refresh").alias("decision"), "changed", "total")


def refresh_keys(table: DataFrame, keys: DataFrame, key: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table with the rows of some keys made anew: equal to a full build."""
    return table.join(keys.select(key).distinct(), key, "left_anti").unionByName(build(keys))


def delta_write(old: DataFrame, new: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The new rows and the removed keys with change: added, updated, removed or unchanged in ``cols``. A null in a key is a value."""
    o = old.select(*(F.col(k).alias(f"_{k}") for k in key), F.struct(*cols).alias("_old"))
    n = new.withColumn("_new", F.struct(*cols))
    joined = n.join(o, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], "full")  # the structs are never null on their own side
    change = F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "added").when(F.col("_new").eqNullSafe(F.col("_old")), "unchanged").otherwise("updated")
    return joined.withColumn("change", change).withColumns({k: F.coalesce(k, f"_{k}") for k in key}).drop(*(f"_{k}" for k in key), "_old", "_new")


def delta_counts(changes: DataFrame) -> DataFrame:
    """(change, n)."""
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def dirty_lists(changes: DataFrame, group: str) -> DataFrame:
    """Groups with a changed row: the only ones to rank anew."""
    return changes.filter("change <> 'unchanged'").select(group).distinct()


#: Days to wait after the first, second and every later failure. Fixed values.
BACKOFF = (1, 7, 30)


def due(items: DataFrame, as_of: Column, done: str, failures: str, newest: str, stale_days: int) -> DataFrame:
    """Items with why they are due: never done, newer input, retry time reached after failures, or stale; the rest are left out."""
    wait = F.element_at(F.array(*map(F.lit, BACKOFF)), F.least(F.greatest(F.col(failures), F.lit(1)), F.lit(len(BACKOFF))).cast("int"))
    age = F.datediff(as_of, F.col(done))
    why = (
        F.when(F.col(done).isNull(), "never")
        .when(F.col(failures) > 0, F.when(age >= wait, "retry"))
        .when(F.col(newest) > F.col(done), "newer")
        .when(age >= stale_days, "stale")
    )
    return items.withColumn("why", why).filter(F.col("why").isNotNull())


def due_order(items: DataFrame, date: str, value: str, bands: Sequence[float], band_days: int, out: str = "due_on") -> DataFrame:
    """Items with the day on which they are due, later by ``band_days`` for each value band they are below."""
    below = sum((F.when(F.coalesce(F.col(value), F.lit(0)) < b, 1).otherwise(0) for b in bands), F.lit(0))
    return items.withColumn(out, F.date_add(F.col(date), (below * band_days).cast("int")))


def gap_candidates(entities: DataFrame, people: DataFrame, contacts: DataFrame, entity: str, person: str) -> DataFrame:
    """Entities with a current person who has no email or no phone."""
    has = contacts.groupBy(person).agg(F.max(F.col("kind") == "email").alias("email"), F.max(F.col("kind") == "phone").alias("phone")).withColumnRenamed(person, "_p")
    lacking = people.join(has, F.col(person) == F.col("_p"), "left").filter(~(F.coalesce("email", F.lit(False)) & F.coalesce("phone", F.lit(False))))
    return entities.join(lacking.select(entity), entity, "left_semi")


def search_queue(people: DataFrame, tried: DataFrame, as_of: Column, entity: str, person: str, order: Sequence[Column], n: int, ttl: dict[str, int]) -> DataFrame:
    """The first ``n`` people of each entity by ``order`` who weren't tried within their status's days."""
    days = F.lit(0)
    for status, k in ttl.items():
        days = F.when(F.col("status") == status, k).otherwise(days)
    held = tried.filter(F.datediff(as_of, F.col("tried_on")) < days).select(person).distinct()
    return top_n_per_key(people.join(held, person, "left_anti"), entity, order, n, "place")


def shard(key: Column, n: int) -> Column:
    """The shard of a key among ``n``."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def prunable(artefacts: DataFrame, derived: DataFrame, yields: DataFrame, key: str) -> DataFrame:
    """Artefacts whose rows were derived, or that were read and yielded nothing."""
    done = artefacts.join(derived.select(key).distinct(), key, "left_semi").withColumn("why", F.lit("derived"))
    empty = artefacts.join(yields.filter("n = 0").select(key).distinct(), key, "left_semi").join(derived.select(key).distinct(), key, "left_anti").withColumn("why", F.lit("empty"))
    return done.unionByName(empty)
