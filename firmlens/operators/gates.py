"""Data-quality gates: layouts, required rows and values, identifier types, run deltas, freshness, consistency."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


class GateError(ValueError):
    """A feed that must not go on."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table, or an error that names the columns it lacks."""
    if lacking := [c for c in columns if c not in df.columns]:
        raise GateError(f"columns are missing: {', '.join(lacking)}")
    return df


def layout_of(df: DataFrame) -> str:
    """The column names in order."""
    return "\u0001".join(df.columns)


def record_layout(layouts: DataFrame, registry: DataFrame) -> DataFrame:
    """(source, fingerprint, columns) of layouts (source, columns array) that the registry doesn't have."""
    marked = layouts.withColumn("fingerprint", F.sha2(F.array_join("columns", "\u0001").cast("binary"), 256))
    return marked.dropDuplicates(["source", "fingerprint"]).join(registry.select("source", "fingerprint"), ["source", "fingerprint"], "left_anti")


def layout_drift(before: Column, after: Column) -> Column:
    """struct(added, dropped) of two layouts; dropped columns are fatal."""
    return F.struct(F.array_except(after, before).alias("added"), F.array_except(before, after).alias("dropped"))


def require_rows(documents: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Documents that yielded no row."""
    return documents.join(rows.select(key).distinct(), key, "left_anti")


def require_all(df: DataFrame, predicate: Column, what: str, examples: int = 5) -> DataFrame:
    """The table, or an error with a few rows for which the predicate doesn't hold."""
    bad = df.filter(~F.coalesce(predicate, F.lit(False))).limit(examples).collect()  # a few examples for the message
    if bad:
        raise GateError(f"{what}: {bad}")
    return df


def has_path(schema: T.DataType, path: str) -> bool:
    """Whether a nested schema has a dotted path."""
    for part in path.split("."):
        while isinstance(schema, T.ArrayType):
            schema = schema.elementType
        if not isinstance(schema, T.StructType) or part not in schema.names:
            return False
        schema = schema[part].dataType
    return True


def require_paths(df: DataFrame, paths: Sequence[str]) -> DataFrame:
    """One row with the share of rows in which each path is null; an error for a path that the schema lacks."""
    if lacking := [p for p in paths if not has_path(df.schema, p)]:
        raise GateError(f"the records lack {', '.join(lacking)}")
    return df.agg(*(F.round(F.avg(F.col(p).isNull().cast("double")), 6).alias(p.replace(".", "_")) for p in paths))


def audit_identifiers(frames: Mapping[str, tuple[DataFrame, str]], joins: Sequence[tuple[str, str]]) -> DataFrame:
    """(name, declared, n, not_text, agrees): identifier columns must be strings, their values without spaces or a decimal point, and both sides of a join of one type."""
    spark = next(iter(frames.values()))[0].sparkSession
    rows = None
    for name, (df, column) in frames.items():
        declared = df.schema[column].dataType.simpleString()
        partners = [b if a == name else a for a, b in joins if name in (a, b)]
        agrees = all(frames[p][0].schema[frames[p][1]].dataType.simpleString() == declared for p in partners)
        odd = F.col(column).cast("string").rlike(r"^\s|\s$|^[0-9]+\.[0-9]+$")
        part = df.agg(F.count("*").alias("n"), F.count_if(odd).alias("odd_values")).select(F.lit(name).alias("name"), F.lit(declared).alias("declared"), "n", "odd_values", F.lit(declared != "string").alias("not_text"), F.lit(agrees).alias("agrees"))
        rows = part if rows is None else rows.unionByName(part)
    return rows if rows is not None else spark.createDataFrame([], "name string, declared string, n long, odd_values long, not_text boolean, agrees boolean")


def row_delta(runs: DataFrame, key: Sequence[str], at: str, rows: str, warn: float, floor: int) -> DataFrame:
    """Runs with the rows of the run before, the change and a flag: below the floor, or changed by more than ``warn`` either way."""
    w = Window.partitionBy(*key).orderBy(at)
    prev = F.lag(rows).over(w)
    change = (F.col(rows) - prev) / F.nullif(prev, F.lit(0))
    flag = F.when(F.col(rows) < floor, "below floor").when(F.abs(change) > warn, "changed").otherwise("ok")
    return runs.select("*", prev.alias("prev_rows"), F.round(change, 6).alias("change"), flag.alias("flag"))


def failure_rate(outcomes: DataFrame, group: str, failed: Column, most: float = 0.05) -> DataFrame:
    """(group, rate, flagged): the share of failures by group."""
    return outcomes.groupBy(group).agg(F.round(F.avg(failed.cast("double")), 6).alias("rate")).withColumn("flagged", F.col("rate") > most)


def coverage_review(df: DataFrame, name: str, mapped: Column, least: int) -> DataFrame:
    """(name, n) of names that aren't mapped and have at least ``least`` rows."""
    return df.filter(~F.coalesce(mapped, F.lit(False))).groupBy(name).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def run_rollup(runs: DataFrame, source: str, status: str, seconds: str) -> DataFrame:
    """Runs of each source: ok, failed, other, average, longest and busy seconds, rows in and out."""
    ok, failed = F.col(status) == "ok", F.col(status) == "failed"
    return runs.groupBy(source).agg(
        F.count_if(ok).alias("ok"), F.count_if(failed).alias("failed"), F.count_if(~ok & ~failed).alias("other"),
        F.round(F.avg(seconds), 3).alias("avg_s"), F.max(seconds).alias("max_s"), F.sum(seconds).alias("busy_s"), F.sum("rows_in").alias("rows_in"), F.sum("rows_out").alias("rows_out"),
    )


def stall_alerts(progress: DataFrame, feeds: DataFrame, as_of: Column, key: str, at: str, done: str, hours: int = 23, stale_days: int = 9) -> DataFrame:
    """(key, alert): progress no further than the reading about ``hours`` before, or a feed older than ``stale_days``."""
    seconds = F.unix_timestamp(at)
    before = F.max_by(done, seconds).over(Window.partitionBy(key).orderBy(seconds).rangeBetween(Window.unboundedPreceding, -hours * 3600))
    latest = progress.withColumn("_before", before).groupBy(key).agg(F.max_by(F.struct(done, "_before"), at).alias("_r"))
    stalled = latest.filter(F.col(f"_r.{done}") <= F.col("_r._before")).select(key, F.lit("stalled").alias("alert"))
    old = feeds.groupBy(key).agg(F.max("published").alias("_p")).filter(F.datediff(as_of, F.col("_p")) > stale_days).select(key, F.lit("old feed").alias("alert"))
    return stalled.unionByName(old)


def last_runs(runs: DataFrame, source: str, at: str, columns: Sequence[str]) -> DataFrame:
    """The latest run of each source."""
    return runs.groupBy(source).agg(F.max(F.struct(at, *columns)).alias("_r")).select(source, "_r.*")


def consistency(frames: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(name, n) of the different keys counted from several tables, side by side."""
    rows = None
    for name, (df, key) in frames.items():
        part = df.agg(F.countDistinct(key).alias("n")).select(F.lit(name).alias("name"), "n")
        rows = part if rows is None else rows.unionByName(part)
    return rows
