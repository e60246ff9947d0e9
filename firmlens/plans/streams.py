"""Queries that replay ``events`` as a stream and return what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..core.scratch import Scratch
from ..sources.store import KeyedStore
from ..streaming import jobs as S
from .signals import _STINTS
from .tables import orders

SQL: dict[str, str] = {}


#: The type of the mark that closes a replay.
END = "(end)"


def _stream(spark: SparkSession, d: str, scratch: Scratch, closed: bool = False) -> DataFrame:
    """The events as files that arrive in a folder; a closed replay ends with a mark a year after the last
    event, so that the watermark passes every window and append mode gives each of them once."""
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch.where("arrived")
    events.write.parquet(path)
    if closed:
        mark = events.agg((F.max("ts") + F.expr("interval 365 days")).alias("ts")).withColumn("event_type", F.lit(END))
        mark.select(*(F.col(f.name) if f.name in mark.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema)).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).parquet(path)


def stream_rates(spark: SparkSession, d: str) -> DataFrame:
    s = Scratch(spark, "rates")
    out = S.stream_rates(_stream(spark, d, s, closed=True), "ts", "1 day", "60 days", "event_type", F.col("value") > 100)
    return S.run_to_table(out, s.where("out"), s.where("checkpoint")).filter(F.col("event_type") != END).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "live", "suppressed")


SQL["stream_rates"] = "SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) FILTER (NOT value > 100) AS live, count(*) FILTER (value > 100) AS suppressed FROM events GROUP BY ALL"


def stream_changes(spark: SparkSession, d: str) -> DataFrame:
    S.use_rocksdb(spark)
    s = Scratch(spark, "changes")
    out = S.run_to_table(S.stream_changes(_stream(spark, d, s), "user_id", "ts", "event_type"), s.where("out"), s.where("checkpoint"))
    return out.groupBy("before", "after").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


SQL["stream_changes"] = """WITH p AS (SELECT user_id, event_type AS after, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS before FROM events)
SELECT before, after, count(*) AS n, count(DISTINCT user_id) AS keys FROM p WHERE before <> after GROUP BY ALL"""


def stream_stints(spark: SparkSession, d: str) -> DataFrame:
    s = Scratch(spark, "stints")
    days = _stream(spark, d, s, closed=True).withColumn("day", F.date_trunc("day", "ts"))
    out = S.run_to_table(S.stream_stints(days, ["user_id", "event_type"], "day", 2, "60 days"), s.where("out"), s.where("checkpoint"))
    return out.filter(F.col("event_type") != END).select("user_id", "event_type", F.date_format("start", "yyyy-MM-dd").alias("start_date"), F.date_format("end", "yyyy-MM-dd").alias("end_date"), "n")


def stream_first(spark: SparkSession, d: str) -> DataFrame:
    s = Scratch(spark, "first")
    out = S.run_to_table(S.first_evidence(_stream(spark, d, s), ["user_id", "event_type"], "ts", "60 days"), s.where("out"), s.where("checkpoint"))
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


SQL["stream_first"] = "SELECT event_type, count(DISTINCT user_id) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1"


SQL["stream_stints"] = f"WITH {_STINTS} SELECT user_id, event_type, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, n FROM st"

def history_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of each user and day, from files that arrive in the order of a hash: old days after new ones, and a part of the files twice."""
    s = Scratch(spark, "upsert")
    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.to_date("ts").alias("day"), "event_id", "event_type", F.col("value").cast("double").alias("value"))
    path = s.where("arrived")
    events.repartition(4, F.xxhash64("event_id") % 8).write.parquet(path)
    events.filter("event_id % 10 = 0").coalesce(1).write.mode("append").parquet(path)
    store = KeyedStore(spark, s.where("store"))
    store.create(events.limit(0), ["user_id", "day"], 16)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(path)
    S.stream_upsert(stream, store, ["event_id"], s.where("checkpoint"), "events").awaitTermination()
    return store.read().select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "event_id", "event_type", F.round("value", 4).alias("value"))


SQL["history_upsert"] = """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 4) AS value
FROM events GROUP BY ALL"""


def refresh_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Totals of customers kept in a store: made from the orders before a day, then made anew for the customers with later ones."""
    o = orders(spark, d)
    build = lambda df: df.groupBy("o_custkey").agg(F.sum("price").cast("double").alias("total"), F.count("*").alias("n"))
    store = KeyedStore(spark, Scratch(spark, "refresh").where("store"))
    store.create(build(o.filter("odate < '2001-01-01'")), ["o_custkey"], 32)
    dirty = o.filter("odate >= '2001-01-01'").select("o_custkey")
    store.refresh(dirty, lambda keys: build(o.join(keys, "o_custkey", "left_semi")))
    return store.read()


SQL["refresh_buckets"] = "SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n FROM orders GROUP BY 1"

QUERIES = {f.__name__: f for f in (stream_rates, stream_changes, stream_stints, stream_first, history_upsert, refresh_buckets)}
