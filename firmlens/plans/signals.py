"""Queries on change detection and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..core.frames import latest_per_key
from ..operators import signals as S, timeline as L
from .tables import AS_OF, as_of, lineitem, orders, read

_PLATFORM = "Brand#11"
_WEIGHTS = {"to_platform": 1.0, "from_platform": -1.0, "other": 0.25}
_RULES = [("merged-12-13", "Brand#12", "Brand#13", "1996-01-01", "1997-12-31"), ("any-to-21", "*", "Brand#21", "1998-01-01", "1998-06-30")]


def _brand_quarters(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select("p_partkey", "p_brand")
    return lineitem(spark, d).join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", F.trunc("sdate", "quarter").alias("date"), "p_brand", "price")


def category_changes(spark: SparkSession, d: str) -> DataFrame:
    events = S.category_changes(_brand_quarters(spark, d), "l_suppkey", "date", "p_brand", "price", _PLATFORM, _WEIGHTS)
    marked = S.suppress_transitions(events, _RULES)
    weight = F.round(S.decay("date", as_of(), 365, 0.05, F.col("direction")), 6)
    return marked.select("l_suppkey", F.col("date").cast("string").alias("date"), "before", "after", "event", "direction", "suppressed_by", weight.alias("weight"))


_DOMINANT = """
bq AS (SELECT l_suppkey, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS date, p_brand, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, date ORDER BY total DESC, p_brand) AS rn FROM bq) WHERE rn = 1),
pairs AS (SELECT l_suppkey, date, lag(p_brand) OVER (PARTITION BY l_suppkey ORDER BY date) AS before, p_brand AS after FROM top),
ev AS (SELECT *, CASE WHEN after = 'Brand#11' THEN 'to_platform' WHEN before = 'Brand#11' THEN 'from_platform' ELSE 'other' END AS event FROM pairs WHERE before IS NOT NULL AND before <> after),
dir AS (SELECT *, CASE event WHEN 'to_platform' THEN 1.0::DOUBLE WHEN 'from_platform' THEN -1.0::DOUBLE ELSE 0.25::DOUBLE END AS direction,
        CASE WHEN before = 'Brand#12' AND after = 'Brand#13' AND date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' THEN 'merged-12-13'
             WHEN after = 'Brand#21' AND date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30' THEN 'any-to-21' END AS suppressed_by FROM ev)
"""

SQL = {
    "category_changes": f"""WITH {_DOMINANT}
SELECT l_suppkey, CAST(date AS VARCHAR) AS date, before, after, event, direction, suppressed_by,
  round(greatest(0.05, pow(0.5, greatest(date_diff('day', date, DATE '{AS_OF}'), 0) / 365.0)) * direction, 6) AS weight FROM dir"""
}


def base_rates(spark: SparkSession, d: str) -> DataFrame:
    quarters = _brand_quarters(spark, d)
    events = S.suppress_transitions(S.category_changes(quarters, "l_suppkey", "date", "p_brand", "price", _PLATFORM, _WEIGHTS), _RULES)
    return S.base_rates(events, quarters, "l_suppkey")


SQL["base_rates"] = f"""WITH {_DOMINANT},
pool AS (SELECT year(date) AS year, count(DISTINCT l_suppkey) AS pool FROM bq GROUP BY 1),
e AS (SELECT year(date) AS year, count(*) FILTER (suppressed_by IS NULL) AS live, count(*) FILTER (suppressed_by IS NOT NULL) AS suppressed FROM dir GROUP BY 1)
SELECT CAST(p.year AS INT) AS year, coalesce(live, 0) AS live, coalesce(suppressed, 0) AS suppressed, pool, round(coalesce(live, 0) / pool::DOUBLE, 6) AS live_rate FROM pool p LEFT JOIN e USING (year)"""


def live_queue(spark: SparkSession, d: str) -> DataFrame:
    events = S.category_changes(_brand_quarters(spark, d), "l_suppkey", "date", "p_brand", "price", _PLATFORM, _WEIGHTS)
    day = lambda x: F.lit(x).cast("date")
    return S.live_queue(events, {"since_1999": day("1999-01-01"), "since_2001": day("2001-01-01")}, "l_suppkey")


SQL["live_queue"] = f"""WITH {_DOMINANT}
SELECT event, count(DISTINCT l_suppkey) FILTER (date >= DATE '1999-01-01') AS since_1999, count(DISTINCT l_suppkey) FILTER (date >= DATE '2001-01-01') AS since_2001 FROM dir GROUP BY event"""


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    yearly = o.groupBy(F.col("o_custkey").alias("entity_id"), F.year("odate").alias("y")).agg(F.sum("price").cast("double").alias("amount"), F.count("*").alias("heads"), F.min("odate").alias("registered"))
    old, new = yearly.filter("y = 1999"), yearly.filter("y = 2000")
    exempt = read(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), (F.col("c_acctbal") < 0).alias("exempt"))
    archive = yearly.filter("y < 1999").select("entity_id")
    return S.diff_snapshots(old, new.join(exempt, "entity_id", "left"), archive, F.lit("2000-12-31").cast("date"), recent_days=180).select("entity_id", "event", F.round("before", 2).alias("before"), F.round("after", 2).alias("after"))


SQL["snapshot_diff"] = """WITH y AS (SELECT o_custkey AS entity_id, year(o_orderdate) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, count(*) AS heads, CAST(min(o_orderdate) AS DATE) AS registered FROM orders GROUP BY ALL),
n AS (SELECT y.*, o.entity_id IS NULL AS fresh, o.amount AS old_amount, o.heads AS old_heads, a.entity_id IS NULL AS unknown
 FROM y LEFT JOIN customer ON c_custkey = y.entity_id LEFT JOIN (SELECT * FROM y WHERE y = 1999) o ON o.entity_id = y.entity_id
 LEFT JOIN (SELECT DISTINCT entity_id FROM y WHERE y < 1999) a ON a.entity_id = y.entity_id WHERE y.y = 2000 AND NOT coalesce(c_acctbal < 0, false)),
e AS (SELECT entity_id, CASE WHEN unknown AND date_diff('day', registered, DATE '2000-12-31') <= 180 THEN 'new_registration' ELSE 'reregistration_or_gap' END AS event, NULL::DOUBLE AS before, amount AS after FROM n WHERE fresh
UNION ALL SELECT entity_id, 'amount_jump', old_amount, amount FROM n WHERE NOT fresh AND old_amount <> 0 AND amount <> 0 AND amount / old_amount - 1 >= 0.2
UNION ALL SELECT entity_id, 'amount_drop', old_amount, amount FROM n WHERE NOT fresh AND old_amount <> 0 AND amount <> 0 AND amount / old_amount - 1 <= -0.25
UNION ALL SELECT entity_id, 'heads_growth', old_heads::DOUBLE, heads::DOUBLE FROM n WHERE NOT fresh AND heads - old_heads >= 2)
SELECT entity_id, event, round(before, 2) AS before, round(after, 2) AS after FROM e"""


def first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    every = S.first_occurrence(o, "o_custkey", "odate", "o_orderpriority")
    urgent = S.first_occurrence(o, "o_custkey", "odate", "o_orderpriority", F.col("o_orderpriority") == "1-URGENT", "urgent")
    return every.join(urgent, "o_custkey", "left").select("o_custkey", F.col("first_date").cast("string").alias("first_date"), "first_name", F.col("urgent_date").cast("string").alias("urgent_date"))


SQL["first_occurrence"] = """WITH a AS (SELECT o_custkey, min((CAST(o_orderdate AS DATE), o_orderpriority)) AS f FROM orders GROUP BY 1),
u AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS d FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT a.o_custkey, CAST(f[1] AS VARCHAR) AS first_date, f[2] AS first_name, CAST(u.d AS VARCHAR) AS urgent_date FROM a LEFT JOIN u USING (o_custkey)"""


def recency_decay(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).withColumn("w", S.decay("odate", as_of(), 180, 0.01, F.when(F.col("o_orderstatus") == "F", -1.0)))
    return o.groupBy("o_custkey").agg(F.round(F.sum("w"), 6).alias("weight"), F.count("*").alias("n"))


SQL["recency_decay"] = f"""SELECT o_custkey, round(sum(greatest(0.01, pow(0.5, greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}'), 0) / 180.0)) * coalesce(CASE WHEN o_orderstatus = 'F' THEN -1.0 END, 1.0)), 6) AS weight, count(*) AS n FROM orders GROUP BY 1"""


def signals_feed(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("date", F.to_date("ts"))
    routed = S.route(e, [("purchase", "sales", "lead"), ("signup", "sales", "lead"), ("signup", "onboarding", "lead"), ("error", "support", "lead"), ("error", "sales", "disqualifier")], "event_type")
    acted = e.filter("event_id % 7 = 0").select("event_id")
    return S.open_signals(routed, acted, F.lit("2024-01-30").cast("date"), 14).groupBy("product", "role", "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.max("date").cast("string").alias("newest"))


SQL["signals_feed"] = """WITH r(event_type, product, role) AS (VALUES ('purchase','sales','lead'),('signup','sales','lead'),('signup','onboarding','lead'),('error','support','lead'),('error','sales','disqualifier'))
SELECT product, role, event_type, count(*) AS n, count(DISTINCT user_id) AS users, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS newest FROM events JOIN r USING (event_type)
WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') BETWEEN 0 AND 14 AND event_id % 7 <> 0 GROUP BY ALL"""


def replace_by_stamp(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "event_type", F.to_date("ts").cast("string").alias("stamp"), "value")
    new = e.filter("stamp >= '2024-01-20' and event_type = 'click'").withColumn("value", F.col("value") * 2)
    out = S.replace_by_stamp(e, new, "stamp", "event_type")
    return out.groupBy("stamp", "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(20,4)")).cast("double"), 2).alias("total"))


SQL["replace_by_stamp"] = """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS stamp, event_type, count(*) AS n,
round(CAST(sum(CAST(CASE WHEN CAST(ts AS DATE) >= DATE '2024-01-20' AND event_type = 'click' THEN value * 2 ELSE value END AS DECIMAL(20,4))) AS DOUBLE), 2) AS total FROM events GROUP BY ALL"""


def position_conviction(spark: SparkSession, d: str) -> DataFrame:
    h = lineitem(spark, d).groupBy("l_suppkey", "l_partkey").agg(F.sum("price").alias("value"))
    return S.position_conviction(h, "l_suppkey", "value", 605, 400_000, 1_000).select("l_suppkey", "positions", F.col("largest").cast("double").alias("largest"), "conviction")


SQL["position_conviction"] = """WITH h AS (SELECT l_suppkey, l_partkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY ALL)
SELECT l_suppkey, count(*) AS positions, CAST(max(v) AS DOUBLE) AS largest, CASE WHEN count(*) >= 605 OR max(v) >= 400000 THEN 'deliberate' WHEN count(*) = 1 AND max(v) < 1000 THEN 'possible_legacy' ELSE 'holding' END AS conviction FROM h GROUP BY 1"""


def latest_holding(spark: SparkSession, d: str) -> DataFrame:
    h = lineitem(spark, d).groupBy("l_suppkey", "l_partkey", F.trunc("sdate", "quarter").cast("string").alias("quarter")).agg(F.sum("price").cast("double").alias("value"))
    return S.latest_holding(h, "l_suppkey", "l_partkey", "quarter", "value")


SQL["latest_holding"] = """WITH h AS (SELECT l_suppkey, l_partkey, CAST(CAST(date_trunc('quarter', l_shipdate) AS DATE) AS VARCHAR) AS quarter, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_partkey, quarter, value FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY quarter DESC) AS rn FROM h) WHERE rn = 1"""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("start_date"))
    return e.withColumn("end_date", F.col("start_date"))


def stints(spark: SparkSession, d: str) -> DataFrame:
    out = L.stints(_spans(spark, d), ["user_id", "event_type"], gap_days=2)
    return out.select("user_id", "event_type", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"), "n")


_STINTS = """d AS (SELECT user_id, event_type, CAST(ts AS DATE) AS s, count(*) AS k FROM events GROUP BY ALL),
m AS (SELECT *, CASE WHEN max(s) OVER w IS NULL OR date_diff('day', max(s) OVER w, s) > 2 THEN 1 ELSE 0 END AS fresh FROM d WINDOW w AS (PARTITION BY user_id, event_type ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM m),
st AS (SELECT user_id, event_type, min(s) AS start_date, max(s) AS end_date, CAST(sum(k) AS BIGINT) AS n FROM i GROUP BY user_id, event_type, island)"""
SQL["stints"] = f"WITH {_STINTS} SELECT user_id, event_type, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, n FROM st"


def movement_events(spark: SparkSession, d: str) -> DataFrame:
    spans = L.stints(_spans(spark, d), ["user_id", "event_type"], gap_days=2)
    moved = L.came_from(spans, "user_id", "event_type", "start_date", "end_date", -10, 3)
    tracked = spark.createDataFrame([("purchase",), ("signup",)], "event_type string")
    events = L.movement_events(spans, tracked, "user_id", "event_type")
    joined = moved.select("user_id", "event_type", F.col("start_date").alias("date"), F.lit("joined").alias("kind"), "from_event_type")
    return events.join(joined, ["user_id", "event_type", "date", "kind"], "left").select("user_id", "event_type", "kind", F.col("date").cast("string").alias("date"), "from_event_type")


SQL["movement_events"] = f"""WITH {_STINTS},
c AS (SELECT a.user_id, a.event_type, a.start_date, b.event_type AS other, row_number() OVER (PARTITION BY a.user_id, a.event_type, a.start_date ORDER BY abs(date_diff('day', a.start_date, b.end_date)) NULLS LAST, b.end_date DESC, b.event_type) AS rn
 FROM st a LEFT JOIN st b ON a.user_id = b.user_id AND b.event_type <> a.event_type AND date_diff('day', a.start_date, b.end_date) BETWEEN -10 AND 3),
ev AS (SELECT DISTINCT user_id, event_type, 'joined' AS kind, start_date AS date FROM st WHERE event_type IN ('purchase','signup') UNION SELECT DISTINCT user_id, event_type, 'left', end_date FROM st WHERE event_type IN ('purchase','signup'))
SELECT ev.user_id, ev.event_type, kind, CAST(date AS VARCHAR) AS date, CASE WHEN kind = 'joined' THEN c.other END AS from_event_type FROM ev LEFT JOIN c ON c.rn = 1 AND c.user_id = ev.user_id AND c.event_type = ev.event_type AND c.start_date = ev.date"""


def went_to(spark: SparkSession, d: str) -> DataFrame:
    spans = L.stints(_spans(spark, d), ["user_id", "event_type"], gap_days=2)
    last = F.when(F.col("end_date") < "2024-01-29", F.col("end_date"))
    out = L.went_to(spans.withColumn("end_date", last), "user_id", "event_type", "start_date", "end_date", -3, 10)
    return out.groupBy("event_type", "to_event_type").agg(F.count("*").alias("n"))


SQL["went_to"] = f"""WITH {_STINTS}, sp AS (SELECT user_id, event_type, start_date, CASE WHEN end_date < DATE '2024-01-29' THEN end_date END AS end_date FROM st),
c AS (SELECT a.user_id, a.event_type, a.start_date, b.event_type AS other, row_number() OVER (PARTITION BY a.user_id, a.event_type, a.start_date ORDER BY abs(date_diff('day', a.end_date, b.start_date)) NULLS LAST, b.end_date IS NULL DESC, b.start_date DESC, b.event_type) AS rn
 FROM sp a LEFT JOIN sp b ON a.user_id = b.user_id AND b.event_type <> a.event_type AND date_diff('day', a.end_date, b.start_date) BETWEEN -3 AND 10 WHERE a.end_date IS NOT NULL),
l AS (SELECT user_id, event_type AS latest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_date DESC, event_type) AS rn FROM sp WHERE end_date IS NULL) WHERE rn = 1)
SELECT c.event_type, coalesce(other, CASE WHEN latest <> c.event_type THEN latest END) AS to_event_type, count(*) AS n FROM c LEFT JOIN l USING (user_id) WHERE rn = 1 GROUP BY 1, 2"""


def people_stats(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).select("o_custkey", "odate", "o_orderpriority")
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("org"), "c_mktsegment")
    spans = o.groupBy("o_custkey").agg(F.min("odate").alias("start_date"), F.max("odate").alias("last")).join(c, "o_custkey")
    emp = spans.select("org", F.col("o_custkey").alias("person"), "start_date", F.when(F.col("last") < "2001-03-01", F.col("last")).alias("end_date"))
    placed = o.join(c, "o_custkey")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "left").otherwise("joined")
    events = placed.select("org", F.col("o_custkey").alias("person"), kind.alias("kind"), F.col("odate").alias("date"), F.col("c_mktsegment").alias("other"))
    return L.people_stats(emp, events, as_of())


SQL["people_stats"] = f"""WITH sp AS (SELECT c_nationkey AS org, o_custkey AS person, CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS l FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
now AS (SELECT org, person, s FROM sp WHERE s <= DATE '{AS_OF}' AND l >= DATE '2001-03-01'),
staff AS (SELECT org, count(DISTINCT person) AS headcount, round(avg(date_diff('day', s, DATE '{AS_OF}') / 365.25), 2) AS mean_tenure FROM now GROUP BY 1),
ev AS (SELECT c_nationkey AS org, o_custkey AS person, CASE WHEN o_orderpriority = '1-URGENT' THEN 'left' ELSE 'joined' END AS kind, c_mktsegment AS other, date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') AS age FROM orders JOIN customer ON c_custkey = o_custkey),
mv AS (SELECT org, count(DISTINCT person) FILTER (kind = 'joined') AS hires, count(DISTINCT person) FILTER (kind = 'left') AS departures FROM ev WHERE age >= 0 AND age < 365 GROUP BY 1),
fl AS (SELECT org, kind, other, count(DISTINCT person) AS n FROM ev WHERE age BETWEEN 0 AND 1096 GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY org, kind ORDER BY n DESC, other) AS rank FROM fl),
ag AS (SELECT org, string_agg(other || ':' || n, ',' ORDER BY rank) FILTER (kind = 'joined') AS top_sources, string_agg(other || ':' || n, ',' ORDER BY rank) FILTER (kind = 'left') AS top_destinations FROM rk WHERE rank <= 5 GROUP BY 1)
SELECT coalesce(staff.org, mv.org, ag.org) AS org, coalesce(headcount, 0) AS headcount, coalesce(hires, 0) AS hires, coalesce(departures, 0) AS departures, coalesce(hires, 0) - coalesce(departures, 0) AS net, mean_tenure, top_sources, top_destinations
FROM staff FULL JOIN mv ON staff.org = mv.org FULL JOIN ag ON ag.org = coalesce(staff.org, mv.org)"""


def headcount_series(spark: SparkSession, d: str) -> DataFrame:
    spans = orders(spark, d).groupBy("o_custkey").agg(F.min("odate").alias("s"), F.max("odate").alias("e"))
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return L.headcount_series(spans.join(c, F.col("o_custkey") == F.col("c_custkey")), range(1995, 2002), "2001-06-30", "c_mktsegment", "o_custkey", "s", "e")


SQL["headcount_series"] = """WITH sp AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS e FROM orders GROUP BY 1),
y AS (SELECT CAST(y AS INT) AS year, CASE WHEN y = 2001 THEN DATE '2001-06-30' ELSE make_date(y, 12, 31) END AS day FROM range(1995, 2002) t(y))
SELECT c_mktsegment, year, count(DISTINCT o_custkey) AS headcount FROM sp JOIN customer ON c_custkey = o_custkey JOIN y ON s <= day AND e >= day GROUP BY ALL"""


def growth_asof(spark: SparkSession, d: str) -> DataFrame:
    h = orders(spark, d).groupBy("o_custkey", F.trunc("odate", "quarter").alias("date")).agg(F.sum("price").cast("double").alias("value"), F.count("*").cast("double").alias("n"))
    out = L.growth(h, "o_custkey", "date", ["value", "n"])
    return out.select("o_custkey", F.col("date").cast("string").alias("date"), "value", F.col("prev_date").cast("string").alias("prev_date"), "prev_value", "gap_days", "value_growth", "n_growth")


SQL["growth_asof"] = """WITH h AS (SELECT o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value, count(*)::DOUBLE AS n FROM orders GROUP BY ALL),
p AS (SELECT a.*, b.date AS prev_date, b.value AS prev_value, b.n AS prev_n, row_number() OVER (PARTITION BY a.o_custkey, a.date ORDER BY b.date DESC NULLS LAST) AS rn FROM h a LEFT JOIN h b ON a.o_custkey = b.o_custkey AND date_diff('day', b.date, a.date) >= 300),
g AS (SELECT *, date_diff('day', prev_date, date) AS gap_days FROM p WHERE rn = 1)
SELECT o_custkey, CAST(date AS VARCHAR) AS date, value, CAST(prev_date AS VARCHAR) AS prev_date, prev_value, gap_days,
CASE WHEN prev_value > 0 THEN round(CASE WHEN gap_days > 456 THEN pow(value / prev_value, 365.0 / gap_days) - 1 ELSE value / prev_value - 1 END, 4) END AS value_growth,
CASE WHEN prev_n > 0 THEN round(CASE WHEN gap_days > 456 THEN pow(n / prev_n, 365.0 / gap_days) - 1 ELSE n / prev_n - 1 END, 4) END AS n_growth FROM g"""


def peer_median(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "n", F.round("c_acctbal", 2).alias("bal"))
    band = F.when(F.col("n") >= 14, "large").when(F.col("n") >= 8, "middle").when(F.col("n") >= 2, "small").otherwise("single")
    return L.peer_gap(c, band, "bal").select("c_custkey", "band", F.round("peer_median", 4).alias("peer_median"), "peer_ratio")


SQL["peer_median"] = """WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
c AS (SELECT c_custkey, n, round(c_acctbal, 2) AS bal, CASE WHEN n >= 14 THEN 'large' WHEN n >= 8 THEN 'middle' WHEN n >= 2 THEN 'small' ELSE 'single' END AS band FROM customer JOIN o ON c_custkey = o_custkey),
m AS (SELECT band, CASE WHEN count(*) >= 20 THEN median(bal) END AS peer_median FROM c GROUP BY 1)
SELECT c_custkey, c.band, round(peer_median, 4) AS peer_median, round(bal / nullif(peer_median, 0), 6) AS peer_ratio FROM c LEFT JOIN m USING (band)"""


def veterans(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).groupBy("o_custkey").agg(F.min("odate").alias("first"))
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    return L.veterans(o.join(c, F.col("o_custkey") == F.col("c_custkey")), "c_nationkey", "o_custkey", "first", as_of(), 6)


SQL["veterans"] = f"""WITH p AS (SELECT o_custkey, c_nationkey, CAST(min(o_orderdate) AS DATE) AS f FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
m AS (SELECT *, date_diff('day', f, DATE '{AS_OF}') >= 6 * 365.25 AS old FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY f, o_custkey) AS rank FROM m WHERE old),
n AS (SELECT c_nationkey, string_agg(CAST(o_custkey AS VARCHAR), ',' ORDER BY rank) AS names FROM r WHERE rank <= 6 GROUP BY 1), s AS (SELECT c_nationkey, count(DISTINCT o_custkey) AS staff, count(DISTINCT o_custkey) FILTER (old) AS veterans FROM m GROUP BY 1)
SELECT c_nationkey, staff, veterans, names, round(veterans / staff::DOUBLE, 4) AS share FROM s LEFT JOIN n USING (c_nationkey)"""


def departures(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).select("o_custkey", "o_orderpriority", "odate")
    events = o.groupBy("o_custkey", "o_orderpriority").agg(F.max("odate").alias("date"))
    earlier = o.groupBy("o_custkey", "o_orderpriority", F.year("odate").alias("y")).agg(F.min("odate").alias("start")).drop("y")
    firsts = o.groupBy("o_custkey").agg(F.min("odate").alias("first"))
    out = L.departures(events, earlier, firsts, "o_orderpriority", "o_custkey", "date", "start", "first")
    return out.select("o_custkey", "o_orderpriority", F.col("date").cast("string").alias("date"), F.col("since").cast("string").alias("since"), "tenure_years", "industry_years", "senior")


SQL["departures"] = """WITH o AS (SELECT o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS d FROM orders), e AS (SELECT o_custkey, o_orderpriority, max(d) AS date FROM o GROUP BY ALL),
s AS (SELECT o_custkey, o_orderpriority, min(d) AS start FROM o GROUP BY o_custkey, o_orderpriority, year(d)), f AS (SELECT o_custkey, min(d) AS first FROM o GROUP BY 1),
j AS (SELECT e.*, (SELECT max(start) FROM s WHERE s.o_custkey = e.o_custkey AND s.o_orderpriority = e.o_orderpriority AND s.start <= e.date) AS since FROM e),
t AS (SELECT j.*, round(date_diff('day', since, date) / 365.25, 2) AS tenure_years, round(date_diff('day', first, date) / 365.25, 2) AS industry_years FROM j JOIN f USING (o_custkey))
SELECT o_custkey, o_orderpriority, CAST(date AS VARCHAR) AS date, CAST(since AS VARCHAR) AS since, tenure_years, industry_years, coalesce(tenure_years >= 5 OR industry_years >= 15, false) AS senior FROM t"""


def lift_outs(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    o = orders(spark, d).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return L.lift_outs(o, "o_orderpriority", "c_nationkey", "o_custkey", "odate", as_of())


SQL["lift_outs"] = f"""SELECT o_orderpriority, c_nationkey, count(DISTINCT o_custkey) AS people FROM orders JOIN customer ON c_custkey = o_custkey WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') BETWEEN 0 AND 365 GROUP BY ALL HAVING count(DISTINCT o_custkey) >= 3"""


def new_locations(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    o = orders(spark, d).select("o_orderkey", "o_custkey", "odate")
    li = lineitem(spark, d).select("l_orderkey", "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    visits = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    out = L.new_places(visits, "o_custkey", ["s_nationkey"], "odate", as_of())
    return out.select("o_custkey", "s_nationkey", F.col("first_seen").cast("string").alias("first_seen"))


SQL["new_locations"] = f"""WITH f AS (SELECT o_custkey, s_nationkey, CAST(min(o_orderdate) AS DATE) AS first_seen FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
m AS (SELECT *, date_diff('day', first_seen, DATE '{AS_OF}') > 365 AS older FROM f), w AS (SELECT *, bool_or(older) OVER (PARTITION BY o_custkey) AS has FROM m)
SELECT o_custkey, s_nationkey, CAST(first_seen AS VARCHAR) AS first_seen FROM w WHERE has AND NOT older AND first_seen <= DATE '{AS_OF}'"""


def filings_12m(spark: SparkSession, d: str) -> DataFrame:
    return L.filings_12m(orders(spark, d), "o_custkey", "odate", as_of())


SQL["filings_12m"] = f"SELECT o_custkey, count(DISTINCT CAST(o_orderdate AS DATE)) AS filings_12m FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') BETWEEN 0 AND 365 GROUP BY 1"


def flows(spark: SparkSession, d: str) -> DataFrame:
    spans = L.stints(_spans(spark, d), ["user_id", "event_type"], gap_days=2)
    return L.flows(L.came_from(spans, "user_id", "event_type", "start_date", "end_date", -10, 3), "from_event_type", "event_type", "user_id")


SQL["flows"] = f"""WITH {_STINTS},
c AS (SELECT a.user_id, a.event_type, b.event_type AS other, row_number() OVER (PARTITION BY a.user_id, a.event_type, a.start_date ORDER BY abs(date_diff('day', a.start_date, b.end_date)), b.end_date DESC, b.event_type) AS rn
 FROM st a JOIN st b ON a.user_id = b.user_id AND b.event_type <> a.event_type AND date_diff('day', a.start_date, b.end_date) BETWEEN -10 AND 3)
SELECT other AS from_event_type, event_type, count(DISTINCT user_id) AS people FROM c WHERE rn = 1 GROUP BY ALL"""


def history_dedupe(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).select("o_custkey", F.trunc("odate", "month").cast("string").alias("month"), F.col("odate").cast("string").alias("odate"), "o_orderkey", F.col("price").cast("double").alias("price"))
    return latest_per_key(o, ["o_custkey", "month"], ["odate", "o_orderkey"])


SQL["history_dedupe"] = """SELECT o_custkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS odate, o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"""

QUERIES = {f.__name__: f for f in (category_changes, base_rates, live_queue, snapshot_diff, first_occurrence, recency_decay, signals_feed, replace_by_stamp, position_conviction, latest_holding, stints, movement_events, went_to, people_stats, headcount_series, growth_asof, peer_median, veterans, departures, lift_outs, new_locations, filings_12m, flows, history_dedupe)}
