"""Small DataFrame helpers with total orders: first and top rows per key, runs, votes, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch


def _cols(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def first_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order, which must be total."""
    return top_n_per_key(df, key, order, 1)


def top_n_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key, with their place in ``rank`` if given."""
    at = rank or "_at"
    out = df.withColumn(at, F.row_number().over(Window.partitionBy(*_cols(key)).orderBy(*order))).filter(F.col(at) <= n)
    return out if rank else out.drop(at)


def latest_per_key(df: DataFrame, key: str | Sequence[str], by: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest ``by``; one aggregation, no sort."""
    rest = [c for c in df.columns if c not in _cols(key)]
    return df.groupBy(*_cols(key)).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_row")).select(*_cols(key), "_row.*")


def consecutive(df: DataFrame, key: str | Sequence[str], order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Each row with prev_<column> of the row before it in its key."""
    w = Window.partitionBy(*_cols(key)).orderBy(*order)
    return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in carry})


def islands(df: DataFrame, key: str | Sequence[str], start: str, end: str, gap_days: int, island: str = "island") -> DataFrame:
    """Rows numbered by runs: a row joins the run before it if it starts at most ``gap_days`` after the latest end so far.

    Both windows have range frames over the day of the start, so rows of one day get one number in any order.
    """
    order = Window.partitionBy(*_cols(key)).orderBy(F.datediff(start, F.lit("1970-01-01").cast("date")))
    reach = F.max(end).over(order.rangeBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.datediff(start, reach) > gap_days), 1).otherwise(0)
    marked = df.withColumn("_fresh", fresh)
    return marked.withColumn(island, F.sum("_fresh").over(order.rangeBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def count_where(condition: Column, name: str) -> Column:
    """Rows for which the condition holds."""
    return F.count_if(condition).alias(name)


def distinct_where(column: str, condition: Column, name: str) -> Column:
    """Different values of the rows for which the condition holds."""
    return F.countDistinct(F.when(condition, F.col(column))).alias(name)


def safe_ratio(part: Column, whole: Column) -> Column:
    """The share, null for a total of 0."""
    return part / F.nullif(whole, F.lit(0))


def mode_by(df: DataFrame, key: str | Sequence[str], value: str, n: str = "n") -> DataFrame:
    """The most frequent value of each key and its count; the least value wins a tie."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*_cols(key), value).agg(F.count("*").alias(n))
    return first_per_key(counted, key, [F.desc(n), F.asc(value)])


def group_fingerprint(df: DataFrame, key: str | Sequence[str], cols: Sequence[str], out: str = "fingerprint") -> DataFrame:
    """One order-independent fingerprint per key: the sum of row hashes and the number of rows."""
    rows = df.groupBy(*_cols(key)).agg(F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("_sum"), F.count("*").alias("n_rows"))
    return rows.withColumn(out, F.md5(F.concat_ws(":", F.col("_sum").cast("string"), F.col("n_rows").cast("string")).cast("binary"))).drop("_sum")


def peer_median(df: DataFrame, band: Column, value: str, min_n: int = 20, out: str = "peer_median") -> DataFrame:
    """Exact median of each band with at least ``min_n`` members, else null.

    Equal values are counted first; then the values are dealt by ranges and the counts before each
    range added to it, so a band that holds all rows is no single task and no state of all its values.
    """
    banded = df.select(band.alias("band"), F.col(value).cast("double").alias("v")).filter("v is not null")
    counted = banded.groupBy("band", "v").agg(F.count("*").alias("n"))
    placed = cumulative(counted, ["band"], [F.asc("v")], "n", "upto")
    whole = placed.groupBy("band").agg(F.max("upto").alias("n")).withColumnsRenamed({"band": "_band", "n": "_n"})
    met = placed.join(whole, F.col("band").eqNullSafe(F.col("_band")))
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    first = F.col("upto") - F.col("n") + 1
    middle = lambda at: F.max(F.when((first <= at) & (F.col("upto") >= at), F.col("v")))
    return met.groupBy("band").agg(F.max("_n").alias("n"), middle(low).alias("_a"), middle(high).alias("_b")).select("band", "n", F.when(F.col("n") >= min_n, (F.col("_a") + F.col("_b")) / 2).alias(out))


def cumulative(df: DataFrame, key: Sequence[str], order: Sequence[Column], amount: str, out: str) -> DataFrame:
    """Rows with the sum of ``amount`` over the rows of their key up to them, in an order that must be total.

    The rows are sorted over all tasks by ranges of key and order; each range adds the sums of the ranges
    before it, of which there is one row for each key and range. So a key that holds all rows is spread
    over all tasks. The ranges are written once to the shared folder: they come from a sample, and a
    second reading must not find others.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(parts, *key, *order).withColumn("_part", F.spark_partition_id())
    here = Window.partitionBy("_part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = Scratch(spark, "cumulative").save(dealt.withColumn("_here", F.sum(amount).over(here)), "rows")
    sums = rows.groupBy("_part", *key).agg(F.max("_here").alias("_sum"))
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k_{k}") for k in key), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    same = [F.col("_part") == F.col("_p"), *(F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key)]
    joined = rows.join(before, same, "left")
    return joined.select(*df.columns, (F.col("_here") + F.col("_before")).alias(out))


def sample_keys(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """One row for each of ``n`` keys chosen by a hash; the same for any order of rows."""
    return df.select(key).distinct().orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def stamp(df: DataFrame, version: str, out: str = "config_stamp") -> DataFrame:
    """The version of the rules on every derived row."""
    return df.withColumn(out, F.lit(version))


def sum_nonnull(*cols: str) -> Column:
    """The sum of the columns that aren't null; null if none is."""
    some = F.filter(F.array(*cols), lambda x: x.isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0).cast("double"), lambda a, x: a + x))


def ratio_bands(df: DataFrame, ratio: str, edges: Sequence[float], out: str = "band") -> DataFrame:
    """Rows counted by the band of a ratio: below the first edge, between edges, from the last on; null apart."""
    chain = F.when(F.col(ratio).isNull(), F.lit(None).cast("int"))
    ordered = sorted(edges, reverse=True)
    for i, e in enumerate(ordered):
        chain = chain.when(F.col(ratio) >= e, F.lit(len(ordered) - i))
    return df.groupBy(chain.otherwise(F.lit(0)).alias(out)).agg(F.count("*").alias("n"))
