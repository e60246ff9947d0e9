"""Mixing sources to target weights: whole copies and one hash-seeded Bernoulli copy.

The size of a document is its number of words. Sources in order of code point, a null source
last, weigh 5, 2, 1, 5, 2, 1 ...; they share ``share`` times the sum of all sizes by weight. No
target exceeds ``most`` times its source's size: what is above goes to the other sources by
weight, again and again until none is above. A source's rate is its target by its size. Each
document is taken floor(rate) times, and once more where a hash of its id falls below the rate's
fraction, so reruns agree and no document is taken more than ``most`` times if that is whole.

Null and empty texts have size 0 and are never taken; a source of no words has target 0 and rate
0. Rows with the same id fall together; a null id hashes like the text "null". An input
column with the name of a new one gives way to it. Only DataFrame functions are used. Sizes are summed before any shuffle, so a hot source is one small row; the
table that is ranked has one row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .bpe import room

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: As text before the id that is hashed.
SALT = "mix"


def size_of(text: str = "text") -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: str = "doc_id", salt: str = SALT) -> Column:
    """A number from 0 to under 1 that only the id decides."""
    digest = F.md5(F.concat(F.lit(salt + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target, rate) from (source, source_size).

    The level of the fill is found by rank: a source is capped if, with every source filled to
    this one's cap by weight, the words still don't exceed the total.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), place + 1)
    ranked = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    filled = ranked.select(
        "*",
        F.sum("cap").over(up).alias("cap_upto"),
        F.sum("weight").over(up).alias("weight_upto"),
        F.sum("weight").over(every).alias("weight_all"),
        (F.sum("source_size").over(every) * share).alias("total"),
    )
    level = F.col("cap") / F.col("weight")
    capped = F.col("cap_upto") + level * (F.col("weight_all") - F.col("weight_upto")) <= F.col("total")
    marked = filled.withColumn("capped", capped)
    rest = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    open_weight = F.col("weight_all") - F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0.0)).over(every)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(rest * F.col("weight") / open_weight)
    out = marked.select("source", "source_size", target.cast("double").alias("target"))
    return out.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``keep`` (by default all columns) with size, source_size, target and copies of every document."""
    keep = room(df.columns if keep is None else keep, "size", "source_size", "target", "copies")
    held = list(dict.fromkeys([*keep, doc_id, source]))
    sized = df.select(*held, size_of(text).alias("size"))
    by_source = sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))
    rates = targets(by_source, share, most).select(F.col("source").alias("_fl_source"), "source_size", "target", F.col("rate").alias("_fl_rate"))
    joined = sized.join(rates, F.col(source).eqNullSafe(F.col("_fl_source")))
    whole = F.floor("_fl_rate")
    copies = (whole + (draw(doc_id) < F.col("_fl_rate") - whole).cast("long")).cast("long")
    return joined.select(*keep, "size", "source_size", "target", copies.alias("copies"))


def emit(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """The mix itself: each row as often as it is taken."""
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))).drop("_copy", "size", "source_size", "target", copies)


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INT) + 1] AS weight
  FROM sized GROUP BY source
), caps AS (SELECT *, source_size * 2.0::DOUBLE AS cap, (source_size * 2.0::DOUBLE) / weight AS level FROM sources
), filled AS (
  SELECT *, sum(cap) OVER up AS cap_upto, sum(weight) OVER up AS weight_upto, sum(weight) OVER () AS weight_all, sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM caps WINDOW up AS (ORDER BY level, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), marked AS (SELECT *, cap_upto + level * (weight_all - weight_upto) <= total AS capped FROM filled
), rates AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap ELSE (total - sum(CASE WHEN capped THEN cap ELSE 0.0 END) OVER ()) * weight / (weight_all - sum(CASE WHEN capped THEN weight ELSE 0.0 END) OVER ()) END AS target
  FROM marked
), priced AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM rates)
SELECT s.doc_id, s.size, p.source_size, CAST(p.target AS DOUBLE) AS target,
       CAST(s.size * (floor(p.rate) + CASE WHEN CAST(('0x' || substr(md5('mix:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < p.rate - floor(p.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN priced p ON s.source IS NOT DISTINCT FROM p.source
"""
