"""Queries on entity resolution, classification and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..core.frames import mode_by
from ..core.scratch import Scratch
from ..operators import classify as C, factors as X, incremental as N, joins as J, resolve as R, scoring as K
from .tables import AS_OF, as_of, lineitem, orders, read

SQL: dict[str, str] = {}


def name_match(spark: SparkSession, d: str) -> DataFrame:
    digits = lambda c: F.regexp_replace(F.regexp_extract(F.col(c), "([0-9]+)$", 1), "^0+", "")
    c = read(spark, d, "customer").select("c_custkey", digits("c_name").alias("exact_key"), F.concat(F.lit("g"), (F.col("c_custkey") % 211).cast("string")).alias("generic_key"), F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("state"))
    s = read(spark, d, "supplier").select("s_suppkey", digits("s_name").alias("exact_key"), F.concat(F.lit("g"), (F.col("s_suppkey") % 150).cast("string")).alias("generic_key"), F.col("s_nationkey").alias("state"))
    return R.match_entities(s, c, "s_suppkey", "c_custkey")


SQL["name_match"] = """WITH c AS (SELECT c_custkey, ltrim(regexp_extract(c_name, '([0-9]+)$', 1), '0') AS e, 'g' || (c_custkey % 211) AS g, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS cs FROM customer),
s AS (SELECT s_suppkey, ltrim(regexp_extract(s_name, '([0-9]+)$', 1), '0') AS e, 'g' || (s_suppkey % 150) AS g, s_nationkey AS ss FROM supplier),
ex AS (SELECT s_suppkey, c_custkey, ss, cs, 'exact' AS method FROM s JOIN c ON s.e = c.e WHERE s.e <> ''),
ge AS (SELECT s_suppkey, c_custkey, ss, cs, 'generic' AS method FROM s JOIN c ON s.g = c.g WHERE s_suppkey NOT IN (SELECT s_suppkey FROM ex)),
m AS (SELECT *, greatest(count(*) OVER (PARTITION BY s_suppkey), count(*) OVER (PARTITION BY c_custkey)) AS n FROM (SELECT * FROM ex UNION ALL SELECT * FROM ge)),
k AS (SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN method = 'exact' THEN CASE WHEN ss IS NULL OR cs IS NULL THEN 0.78::DOUBLE WHEN ss = cs THEN 0.95::DOUBLE ELSE 0.45::DOUBLE END ELSE CASE WHEN ss IS NULL OR cs IS NULL THEN 0.55::DOUBLE WHEN ss = cs THEN 0.72::DOUBLE ELSE 0.25::DOUBLE END END - CASE WHEN n > 1 THEN 0.20::DOUBLE ELSE 0.0 END)), 3) AS confidence FROM m)
SELECT s_suppkey, c_custkey, method, confidence, CASE WHEN confidence >= 0.85 THEN 'auto' WHEN confidence >= 0.5 THEN 'review' ELSE 'rejected' END AS status FROM k"""


_ALIASES = [("one", "Brand#1"), ("eleven", "Brand#11"), ("twelve", "Brand#12"), ("two", "Brand#2"), ("three", "Brand#3")]


def alias_match(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", "p_brand")
    return J.phrase_join(p, "p_brand", _ALIASES, "alias_id", whole_words=False).groupBy("p_brand", "alias_id").agg(F.count("*").alias("n"))


SQL["alias_match"] = """SELECT p_brand, CASE WHEN starts_with(p_brand, 'Brand#12') THEN 'twelve' WHEN starts_with(p_brand, 'Brand#11') THEN 'eleven' WHEN starts_with(p_brand, 'Brand#3') THEN 'three' WHEN starts_with(p_brand, 'Brand#2') THEN 'two' WHEN starts_with(p_brand, 'Brand#1') THEN 'one' END AS alias_id, count(*) AS n FROM part GROUP BY ALL"""


def concentration(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select("p_partkey", "p_brand")
    rows = lineitem(spark, d).join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", F.trunc("sdate", "year").alias("date"), "p_brand", "price")
    out = R.concentration(rows, "l_suppkey", "date", "p_brand", "price", "Brand#13", [("Brand#12", "Brand#13", "1997-01-01"), ("Brand#31", "Brand#32", "2030-01-01")])
    return out.select("l_suppkey", F.col("total").cast("double").alias("total"), F.col("platform_amount").cast("double").alias("platform_amount"), "share", "primary", "n")


SQL["concentration"] = """WITH r AS (SELECT l_suppkey, CAST(date_trunc('year', l_shipdate) AS DATE) AS date, p_brand, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT l_suppkey, max(date) AS date FROM r GROUP BY 1),
b AS (SELECT l_suppkey, p_brand, date, sum(price) AS amount, count(*) AS n FROM r JOIN m USING (l_suppkey, date) GROUP BY ALL),
e AS (SELECT *, CASE WHEN p_brand = 'Brand#12' AND date >= DATE '1997-01-01' THEN 'Brand#13' ELSE p_brand END AS eff, row_number() OVER (PARTITION BY l_suppkey ORDER BY amount DESC, p_brand) AS rn FROM b)
SELECT l_suppkey, CAST(sum(amount) AS DOUBLE) AS total, CAST(sum(CASE WHEN eff = 'Brand#13' THEN amount ELSE 0 END) AS DOUBLE) AS platform_amount,
 round(CAST(sum(CASE WHEN eff = 'Brand#13' THEN amount ELSE 0 END) AS DOUBLE) / CAST(sum(amount) AS DOUBLE), 6) AS share, max(CASE WHEN rn = 1 THEN eff END) AS primary, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY 1"""


def cascade_match(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").withColumn("price", F.round("p_retailprice", 2))
    records = part.select("p_partkey", "p_name", "p_brand", "p_size", "p_type")
    a = R.unique_only(part.filter("p_partkey % 3 = 0"), ["p_name", "p_brand"], "p_partkey").withColumnRenamed("p_partkey", "target")
    b = R.unique_only(part.filter("p_partkey % 2 = 0"), ["p_brand", "p_size", "p_type"], "p_partkey").withColumnRenamed("p_partkey", "target")
    c = part.groupBy("p_name").agg(F.min("p_partkey").alias("target")).filter("target % 5 <> 0")
    return R.cascade_match(records, "p_partkey", [("name_brand", ["p_name", "p_brand"], a, 0.95), ("brand_size", ["p_brand", "p_size", "p_type"], b, 0.8), ("name", ["p_name"], c, 0.65)], "target").select("p_partkey", "target", "method", "confidence")


SQL["cascade_match"] = """WITH a AS (SELECT p_name, p_brand, min(p_partkey) AS target FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL HAVING count(DISTINCT p_partkey) = 1),
b AS (SELECT p_brand, p_size, p_type, min(p_partkey) AS target FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL HAVING count(DISTINCT p_partkey) = 1),
c AS (SELECT p_name, min(p_partkey) AS target FROM part GROUP BY 1 HAVING min(p_partkey) % 5 <> 0)
SELECT p_partkey, coalesce(a.target, b.target, c.target) AS target, CASE WHEN a.target IS NOT NULL THEN 'name_brand' WHEN b.target IS NOT NULL THEN 'brand_size' WHEN c.target IS NOT NULL THEN 'name' END AS method,
CASE WHEN a.target IS NOT NULL THEN 0.95::DOUBLE WHEN b.target IS NOT NULL THEN 0.8::DOUBLE WHEN c.target IS NOT NULL THEN 0.65::DOUBLE END AS confidence
FROM part LEFT JOIN a USING (p_name, p_brand) LEFT JOIN b ON b.p_brand = part.p_brand AND b.p_size = part.p_size AND b.p_type = part.p_type LEFT JOIN c ON c.p_name = part.p_name"""


def pattern_vote(spark: SparkSession, d: str) -> DataFrame:
    return mode_by(read(spark, d, "events"), "user_id", "event_type")


SQL["pattern_vote"] = """SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE rn = 1"""


def ambiguous_keys(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").withColumn("key", F.concat_ws("-", "c_mktsegment", (F.col("c_custkey") % 17).cast("string")))
    return R.ambiguous_keys(c, "c_nationkey", "key", "c_custkey")


SQL["ambiguous_keys"] = "SELECT c_nationkey, c_mktsegment || '-' || (c_custkey % 17) AS key, count(DISTINCT c_custkey) AS people FROM customer GROUP BY ALL HAVING count(DISTINCT c_custkey) > 1"


def segment(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).withColumn("urgent", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("price")).otherwise(F.lit(0).cast("decimal(18,2)")))
    by = o.groupBy("o_custkey").agg(F.sum("urgent").cast("double").alias("value"), F.sum("price").cast("double").alias("whole"), F.count("*").alias("n"))
    kind = C.segment(F.col("value"), F.col("whole"), F.col("n") >= 18, {"competitor": 0.5, "prospect": 0.15, "very_large": 150_000.0, "absolute": 1e8})
    return by.withColumn("s", kind).select("o_custkey", "s.segment", F.round(F.col("value") / F.col("whole"), 6).alias("ratio"))


SQL["segment"] = """WITH b AS (SELECT o_custkey, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS value, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS whole, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN n >= 18 THEN 'sponsor' WHEN value = 0 THEN 'unraised' WHEN value / whole >= 0.5 THEN 'competitor' WHEN value / whole < 0.15 THEN CASE WHEN value >= 150000 THEN 'ambiguous' ELSE 'prospect' END ELSE 'ambiguous' END AS segment, round(value / whole, 6) AS ratio FROM b"""


def decision_list(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    c = read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    rules = [
        (F.col("c_acctbal") < -500, "exempt", 90, [(F.col("n") > 5, "orders"), (F.col("urgent") > 2, "urgent")]),
        (F.col("c_mktsegment") == "BUILDING", "builder", 80, [(F.col("n") > 10, "many orders")]),
        (F.col("n") >= 15, "wholesale", 70, [(F.col("urgent") > 3, "urgent"), (F.col("c_acctbal") > 5000, "rich")]),
        (F.col("c_acctbal") > 7000, "rich", 60, []),
    ]
    labels = C.multi_label({"urgent": F.col("urgent") > 3, "broke": F.col("c_acctbal") < 0, "silent": F.col("n").isNull()})
    return c.withColumn("v", C.decision_list(rules)).select("c_custkey", "v.category", "v.confidence", F.array_join("v.evidence", "|").alias("evidence"), F.array_join(labels, "|").alias("labels"))


SQL["decision_list"] = """WITH o AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1), j AS (SELECT * FROM customer LEFT JOIN o ON c_custkey = o_custkey),
v AS (SELECT *, CASE WHEN c_acctbal < -500 THEN 'exempt' WHEN c_mktsegment = 'BUILDING' THEN 'builder' WHEN n >= 15 THEN 'wholesale' WHEN c_acctbal > 7000 THEN 'rich' ELSE 'unknown' END AS category FROM j)
SELECT c_custkey, category, CASE category WHEN 'exempt' THEN 90 WHEN 'builder' THEN 80 WHEN 'wholesale' THEN 70 WHEN 'rich' THEN 60 ELSE 0 END AS confidence,
CASE category WHEN 'exempt' THEN concat_ws('|', CASE WHEN n > 5 THEN 'orders' END, CASE WHEN urgent > 2 THEN 'urgent' END) WHEN 'builder' THEN CASE WHEN n > 10 THEN 'many orders' ELSE '' END WHEN 'wholesale' THEN concat_ws('|', CASE WHEN urgent > 3 THEN 'urgent' END, CASE WHEN c_acctbal > 5000 THEN 'rich' END) ELSE '' END AS evidence,
concat_ws('|', CASE WHEN urgent > 3 THEN 'urgent' END, CASE WHEN c_acctbal < 0 THEN 'broke' END, CASE WHEN n IS NULL THEN 'silent' END) AS labels FROM v"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("odate").alias("last"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    c = read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(
        "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal", "n",
        K.field_factor(F.col("n"), [(14, 100), (8, 60), (2, 20)]).alias("orders"),
        K.field_factor(F.when(F.col("c_acctbal") > -300, F.col("c_acctbal")), [(8000, 100), (4000, 75), (0, 25)]).alias("balance"),
        K.flag_factor(F.when(F.col("n").isNotNull(), F.col("urgent") > 2), 100, 25).alias("urgent"),
        K.flag_factor(F.when(F.col("c_nationkey") % 5 != 0, F.datediff(as_of(), F.col("last")) < 120), 80, 0).alias("recent"),
    )


def _products() -> list[K.Product]:
    a = K.Product("alpha", {"orders": 40, "balance": 30, "urgent": 20, "recent": 10}, gates=[("segment", F.col("c_mktsegment") != "MACHINERY")], disqualifiers=[("broke", F.col("c_acctbal") < -900)], penalties=[("small", F.col("n") < 3, 15)])
    b = K.Product("beta", {"balance": 60, "recent": 40}, disqualifiers=[("nation", F.col("c_nationkey") == 7)])
    return [a, b]


def _scores(spark: SparkSession, d: str, overridden: bool = True, features: DataFrame | None = None) -> DataFrame:
    # every product reads the features, and the ranking reads the scores twice: they are made once
    f = Scratch(spark, "features").save(_features(spark, d), "features") if features is None else features
    manual = read(spark, d, "customer").filter("c_custkey % 50 = 0").select("c_custkey", F.lit("balance").alias("criterion"), F.lit(90.0).alias("points")) if overridden else None
    a, b = (K.score(f, "c_custkey", p, manual, ["c_acctbal"]) for p in _products())
    return a.unionByName(b)


def score_products(spark: SparkSession, d: str) -> DataFrame:
    ranked = K.rank_lists(K.top_reasons(_scores(spark, d), 2), "c_custkey", "c_acctbal")
    return ranked.select("c_custkey", "product", "status", "reason", "score", "coverage", "potential", F.array_join("missing", "|").alias("missing"), F.array_join("top_reasons", "|").alias("top_reasons"), "rank")


_SCORES = """o AS (SELECT o_custkey, count(*) AS n, CAST(max(o_orderdate) AS DATE) AS last, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1),
f AS (SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal, n,
 CASE WHEN n >= 14 THEN 100 WHEN n >= 8 THEN 60 WHEN n >= 2 THEN 20 WHEN n IS NOT NULL THEN 0 END::DOUBLE AS p_orders,
 CASE WHEN {override} THEN 90 WHEN c_acctbal <= -300 THEN NULL WHEN c_acctbal >= 8000 THEN 100 WHEN c_acctbal >= 4000 THEN 75 WHEN c_acctbal >= 0 THEN 25 ELSE 0 END::DOUBLE AS p_balance,
 CASE WHEN n IS NULL THEN NULL WHEN urgent > 2 THEN 100 ELSE 25 END::DOUBLE AS p_urgent,
 CASE WHEN c_nationkey % 5 = 0 OR last IS NULL THEN NULL WHEN date_diff('day', last, DATE '2001-08-02') < 120 THEN 80 ELSE 0 END::DOUBLE AS p_recent FROM customer LEFT JOIN o ON c_custkey = o_custkey),
l AS (SELECT c_custkey, c_acctbal, c_nationkey, n, 'alpha' AS product, key, w::DOUBLE AS w, p FROM f, LATERAL (VALUES ('orders', 40, p_orders, 1), ('balance', 30, p_balance, 2), ('urgent', 20, p_urgent, 3), ('recent', 10, p_recent, 4)) t(key, w, p, i) WHERE c_mktsegment <> 'MACHINERY'
 UNION ALL SELECT c_custkey, c_acctbal, c_nationkey, n, 'beta', key, w::DOUBLE, p FROM f, LATERAL (VALUES ('balance', 60, p_balance, 1), ('recent', 40, p_recent, 2)) t(key, w, p, i)),
g AS (SELECT c_custkey, any_value(c_acctbal) AS c_acctbal, any_value(c_nationkey) AS c_nationkey, any_value(n) AS n, product, sum(coalesce(p, 0) * w / 100) AS earned, sum(CASE WHEN p IS NOT NULL THEN w ELSE 0 END) AS known,
 coalesce(string_agg(key, '|' ORDER BY CASE key WHEN 'orders' THEN 1 WHEN 'balance' THEN 2 WHEN 'urgent' THEN 3 ELSE 4 END) FILTER (p IS NULL), '') AS missing,
 coalesce(array_to_string(list_slice(list(key ORDER BY p * w DESC, key) FILTER (p > 0), 1, 2), '|'), '') AS top_reasons FROM l GROUP BY c_custkey, product),
s AS (SELECT *, greatest(0, earned - CASE WHEN product = 'alpha' AND n < 3 THEN 15 ELSE 0 END) AS net, CASE WHEN product = 'alpha' AND c_acctbal < -900 THEN 'broke' WHEN product = 'beta' AND c_nationkey = 7 THEN 'nation' END AS reason FROM g),
t AS (SELECT c_custkey, c_acctbal, product, CASE WHEN reason IS NULL THEN 'scored' ELSE 'disqualified' END AS status, reason, round(net, 1) AS score, round(known, 1) AS coverage, round(least(100, net + 100 - known), 1) AS potential, missing, top_reasons FROM s)"""
_WITH = _SCORES.replace("{override}", "c_custkey % 50 = 0")
_RANK = "CASE WHEN status = 'scored' THEN row_number() OVER (PARTITION BY product, status ORDER BY score DESC, coverage DESC, c_acctbal DESC, c_custkey) END"
SQL["score_products"] = f"WITH {_WITH} SELECT c_custkey, product, status, reason, score, coverage, potential, missing, top_reasons, {_RANK} AS rank FROM t"


def scope(spark: SparkSession, d: str) -> DataFrame:
    out = K.scope(_scores(spark, d), "c_custkey", {"beta": 50.0})
    return out.withColumn("products", F.array_join("products", "|"))


SQL["scope"] = f"""WITH {_WITH}, r AS (SELECT * FROM t WHERE status = 'scored' AND (product <> 'beta' OR score >= 50)), x AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, coverage DESC, product DESC) AS rn FROM r)
SELECT c_custkey, max(CASE WHEN rn = 1 THEN product END) AS best_product, max(CASE WHEN rn = 1 THEN score END) AS best_score, string_agg(product, '|' ORDER BY product) AS products, max(CASE WHEN rn = 1 THEN round(score + coverage / 1000, 4) END) AS priority FROM x GROUP BY 1"""


def list_kpis(spark: SparkSession, d: str) -> DataFrame:
    fresh = orders(spark, d).filter("odate >= '2001-06-01'").select(F.col("o_custkey").alias("c_custkey"))
    return K.list_kpis(_scores(spark, d), fresh, read(spark, d, "customer").filter("c_custkey % 4 <> 0").select("c_custkey"), "c_custkey")


SQL["list_kpis"] = f"""WITH {_WITH}, fr AS (SELECT DISTINCT o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2001-06-01')
SELECT product, count(*) FILTER (status = 'scored') AS n, round(avg(coverage) FILTER (status = 'scored'), 2) AS mean_coverage, count(*) FILTER (status = 'scored' AND score >= 60) AS sixty_plus, count(*) FILTER (status = 'scored' AND coverage >= 100) AS "full", count(*) FILTER (status <> 'scored') AS disqualified,
count(*) FILTER (status = 'scored' AND o_custkey IS NOT NULL) AS fresh, count(*) FILTER (status = 'scored' AND c_custkey % 4 <> 0) AS reachable FROM t LEFT JOIN fr ON c_custkey = o_custkey GROUP BY 1"""


def score_summary(spark: SparkSession, d: str) -> DataFrame:
    return K.score_summary(_scores(spark, d))


SQL["score_summary"] = f"WITH {_WITH} SELECT product, status, reason, CAST(floor(score / 10) * 10 AS INT) AS tens, count(*) AS n FROM t GROUP BY ALL"


def pivot_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).groupBy("c_custkey").pivot("product", ["alpha", "beta"]).agg(F.max("score"))


SQL["pivot_scores"] = f"WITH {_WITH} SELECT c_custkey, max(score) FILTER (product = 'alpha') AS alpha, max(score) FILTER (product = 'beta') AS beta FROM t GROUP BY 1"


def rerank_delta(spark: SparkSession, d: str) -> DataFrame:
    features = Scratch(spark, "features").save(_features(spark, d), "features")
    old, new = _scores(spark, d, False, features), _scores(spark, d, True, features).filter("c_custkey % 97 <> 0")
    cols = ["status", "reason", "score", "coverage"]
    return N.delta_write(old, new, ["c_custkey", "product"], cols).filter("change <> 'unchanged'").select("c_custkey", "product", "change", "score")


_OLD = _SCORES.replace("{override}", "false")
SQL["rerank_delta"] = f"""WITH a AS (WITH {_OLD} SELECT * FROM t), b AS (WITH {_WITH} SELECT * FROM t WHERE c_custkey % 97 <> 0)
SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, coalesce(b.product, a.product) AS product, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'removed' ELSE 'updated' END AS change, b.score FROM a FULL JOIN b ON a.c_custkey = b.c_custkey AND a.product = b.product
WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.status IS DISTINCT FROM b.status OR a.reason IS DISTINCT FROM b.reason OR a.score IS DISTINCT FROM b.score OR a.coverage IS DISTINCT FROM b.coverage"""


def title_search(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    tagged = C.designations(p, "p_name", [("a_words", ["a"], []), ("s_not_b", ["s"], ["b"])], {})
    return tagged.filter(C.title_matches(F.col("p_name"), "a s, b b, c")).groupBy("p_name", F.array_join("tags", "|").alias("tags")).agg(F.count("*").alias("n"))


SQL["title_search"] = """WITH w AS (SELECT p_name, lower(split_part(p_name, ' ', 1)) AS a, lower(split_part(p_name, ' ', 2)) AS b FROM part),
m AS (SELECT *, (starts_with(a,'a') OR starts_with(b,'a')) AS ha, (starts_with(a,'s') OR starts_with(b,'s')) AS hs, (starts_with(a,'b') OR starts_with(b,'b')) AS hb, (starts_with(a,'c') OR starts_with(b,'c')) AS hc FROM w)
SELECT p_name, concat_ws('|', CASE WHEN ha THEN 'a_words' END, CASE WHEN hs AND NOT hb THEN 's_not_b' END) AS tags, count(*) AS n FROM m WHERE (ha AND hs) OR hb OR hc GROUP BY ALL"""


def suppression(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("firm"), F.concat(F.lower("c_mktsegment"), F.lit(".example")).alias("domain"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 4, "0").alias("phone"))
    s = read(spark, d, "supplier")
    listed = s.filter("s_suppkey % 20 = 0").select(F.lit("firm").alias("scope"), F.col("s_nationkey").cast("string").alias("value")).union(s.filter("s_acctbal < 500").select(F.lit("phone"), F.lpad((F.col("s_suppkey") % 1000).cast("string"), 4, "0"))).union(s.filter("s_suppkey = 3").select(F.lit("domain"), F.lit("building.example")))
    out = J.multi_scope_join(c, {"firm": "firm", "domain": "domain", "phone": "phone"}, listed, "c_custkey")
    return out.select("c_custkey", F.coalesce(F.array_join("scopes_hit", "|"), F.lit("")).alias("scopes_hit"))


SQL["suppression"] = """WITH l AS (SELECT DISTINCT 'firm' AS scope, CAST(s_nationkey AS VARCHAR) AS value FROM supplier WHERE s_suppkey % 20 = 0 UNION SELECT 'phone', lpad(CAST(s_suppkey % 1000 AS VARCHAR), 4, '0') FROM supplier WHERE s_acctbal < 500 UNION SELECT 'domain', 'building.example' FROM supplier WHERE s_suppkey = 3)
SELECT c_custkey, concat_ws('|', CASE WHEN lower(c_mktsegment) || '.example' IN (SELECT value FROM l WHERE scope = 'domain') THEN 'domain' END, CASE WHEN CAST(c_nationkey AS VARCHAR) IN (SELECT value FROM l WHERE scope = 'firm') THEN 'firm' END, CASE WHEN lpad(CAST(c_custkey % 1000 AS VARCHAR), 4, '0') IN (SELECT value FROM l WHERE scope = 'phone') THEN 'phone' END) AS scopes_hit FROM customer"""



def _factor_features(spark: SparkSession, d: str) -> DataFrame:
    """Customers in the part of firms: orders stand for assets, urgent ones for wealthy clients, priorities for tags."""
    o = orders(spark, d).withColumn("urgent", F.col("o_orderpriority") == "1-URGENT")
    year = F.datediff(as_of(), F.col("odate"))
    sums = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum("price").cast("double").alias("raum"), F.sum(F.when(F.col("urgent"), F.col("price")).otherwise(F.lit(0).cast("decimal(18,2)"))).cast("double").alias("hnw_aum"), F.count_if("urgent").cast("double").alias("hnw_clients"), F.count("*").cast("double").alias("clients_total"),
        F.count_if((year >= 0) & (year < 365)).cast("double").alias("team_now"), F.count_if((year >= 365) & (year < 730)).cast("double").alias("team_before"),
    )
    c = read(spark, d, "customer")
    k = F.col("c_custkey")
    firms = c.select(
        "c_custkey", (k % 30).cast("double").alias("iar_count"), (k % 3).cast("double").alias("fund_count"), F.when(k % 4 > 0, k % 2 == 0).alias("brochure_read"), F.when(k % 7 < 4, F.element_at(F.array(*map(F.lit, ("customer", "qualified", "meeting set", "new"))), (k % 7 + 1).cast("int"))).alias("status"),
        F.when(k % 6 > 0, (k % 6 - 1).cast("double")).alias("postings"), F.when(k % 5 > 0, F.element_at(F.array(*map(F.lit, ("page", "no_openings", "unreachable", "none"))), (k % 5).cast("int"))).alias("careers"), (F.col("c_acctbal") / 10000).alias("aum_rate"), (k % 9).cast("double").alias("new_states"), (k % 11 == 0).alias("first_fund"), (k % 8 > 0).alias("growth_loaded"),
        (k % 13 == 0).alias("is_exempt"), F.when(k % 10 > 0, F.lit("SEC")).otherwise(F.lit("STATE")).alias("regulator"), F.when(k % 12 == 0, F.lit("competitor")).alias("segment"),
    )
    tag = F.element_at(F.create_map(*(F.lit(x) for pair in (("1-URGENT", "income"), ("2-HIGH", "tax"), ("3-MEDIUM", "exchange_1031"), ("4-NOT SPECIFIED", "illiquid"), ("5-LOW", "referrals")) for x in pair)), F.col("o_orderpriority"))
    tags = o.groupBy(F.col("o_custkey").alias("c_custkey"), tag.alias("tag")).agg((F.count("*") > 1).alias("present"), F.count("*").alias("hits"), F.countDistinct(F.year("odate")).alias("phrases")).withColumn("sections", F.array(F.lit(4)))
    return X.assemble_features(firms, "c_custkey", [sums], tags)


#: Factors of the query with the parameters of those with bands.
_FACTORS = {
    **{k: {} for k in ("hnw_fit", "portfolio_need", "exchange_frequency", "repeat_potential", "relationship_strength", "referral_potential", "check_size", "decision_speed", "advisor_count", "team_growth", "asset_growth", "expansion", "open_roles")},
    "clients_per_advisor": {"bands": [(0.5, 100), (0.1, 60)], "damping": [(150000, 1.0), (100000, 0.5)]},
}


def factor_points(spark: SparkSession, d: str) -> DataFrame:
    rated = X.with_factors(_factor_features(spark, d), _FACTORS)
    rows = F.array(*(F.struct(F.lit(k).alias("factor"), F.col(f"f_{k}.points").alias("points"), F.col(f"f_{k}.known").alias("known")) for k in _FACTORS))
    return rated.select("c_custkey", F.inline(rows))


_FEATURES = f"""o AS (SELECT o_custkey AS c_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS raum, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS hnw, count(*) FILTER (o_orderpriority = '1-URGENT') AS hn, count(*) AS n,
 count(*) FILTER (date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') BETWEEN 0 AND 364) AS now, count(*) FILTER (date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') BETWEEN 365 AND 729) AS before FROM orders GROUP BY 1),
t AS (SELECT o_custkey, o_orderpriority AS p, count(*) AS hits, count(DISTINCT year(o_orderdate)) AS phrases FROM orders GROUP BY ALL),
g AS (SELECT o_custkey, max(CASE WHEN p = '1-URGENT' THEN hits ELSE 0 END) AS income, max(CASE WHEN p = '2-HIGH' THEN hits ELSE 0 END) AS tax, max(CASE WHEN p = '3-MEDIUM' THEN hits ELSE 0 END) AS ex, max(CASE WHEN p = '3-MEDIUM' THEN phrases ELSE 0 END) AS exp, max(CASE WHEN p = '4-NOT SPECIFIED' THEN hits ELSE 0 END) AS ill, max(CASE WHEN p = '5-LOW' THEN hits ELSE 0 END) AS ref FROM t GROUP BY 1),
f AS (SELECT c.c_custkey, c.c_custkey AS k, c_acctbal / 10000 AS rate, o.*, coalesce(income, 0) AS income, coalesce(tax, 0) AS tax, coalesce(ex, 0) AS ex, coalesce(exp, 0) AS exp, coalesce(ill, 0) AS ill, coalesce(ref, 0) AS ref, coalesce(c.c_custkey % 4 > 0 AND c.c_custkey % 2 = 0, false) AS isread, coalesce(hnw / nullif(hn, 0), 0) AS av, hnw / nullif(raum, 0) AS share FROM customer c LEFT JOIN o ON o.c_custkey = c.c_custkey LEFT JOIN g ON g.o_custkey = c.c_custkey)"""
_POINTS = {
    "hnw_fit": "CASE WHEN coalesce(raum, 0) > 0 THEN CASE WHEN share >= 0.6 AND av >= 2e6 THEN 100 WHEN share >= 0.4 THEN 75 WHEN share >= 0.2 THEN 50 ELSE 25 END END",
    "portfolio_need": "CASE WHEN income > 1 AND tax > 1 THEN 80 WHEN income > 1 THEN 55 WHEN isread THEN 25 END",
    "exchange_frequency": "CASE WHEN ex > 1 AND (ex >= 5 OR exp >= 3) THEN 60 WHEN ex > 1 THEN 28 WHEN isread THEN 0 END",
    "repeat_potential": "CASE WHEN k % 30 >= 10 OR coalesce(hn, 0) >= 200 THEN 100 WHEN k % 30 >= 3 OR coalesce(hn, 0) >= 50 THEN 40 ELSE 0 END",
    "relationship_strength": "CASE k % 7 WHEN 0 THEN 100 WHEN 1 THEN 70 WHEN 2 THEN 70 ELSE 0 END",
    "referral_potential": "CASE WHEN ref > 1 AND coalesce(n, 0) >= 50 THEN 100 WHEN ref > 1 THEN 50 WHEN isread THEN 0 END",
    "check_size": "CASE WHEN coalesce(raum, 0) >= 2e9 OR av >= 5e7 THEN 100 WHEN coalesce(raum, 0) >= 5e8 THEN 75 ELSE 40 END",
    "decision_speed": "CASE WHEN k % 3 > 0 THEN 100 END",
    "advisor_count": "CASE WHEN k % 30 >= 25 THEN 100 WHEN k % 30 >= 10 THEN 70 WHEN k % 30 >= 5 THEN 40 ELSE 10 END",
    "team_growth": "CASE WHEN now IS NOT NULL THEN CASE WHEN gr >= 0.25 OR now - before >= 10 THEN 100 WHEN gr >= 0.15 OR now - before >= 5 THEN 85 WHEN gr >= 0.08 THEN 65 WHEN gr >= 0.03 THEN 45 WHEN now > before THEN 30 WHEN now = before THEN 10 ELSE 0 END END",
    "asset_growth": "CASE WHEN rate >= 0.3 THEN 100 WHEN rate >= 0.2 THEN 85 WHEN rate >= 0.1 THEN 65 WHEN rate >= 0.05 THEN 45 WHEN rate > 0 THEN 25 WHEN rate IS NOT NULL THEN 0 END",
    "expansion": "CASE WHEN k % 8 > 0 THEN (CASE WHEN k % 9 >= 2 THEN 30 WHEN k % 9 = 1 THEN 20 ELSE 0 END) + (CASE WHEN k % 11 = 0 THEN 20 ELSE 0 END) END",
    "open_roles": "CASE WHEN k % 6 > 0 AND k % 6 - 1 >= 3 THEN 100 WHEN k % 6 > 0 AND k % 6 - 1 >= 1 THEN 80 WHEN k % 6 = 0 AND k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 20 WHEN k % 5 = 2 THEN 10 WHEN k % 5 = 3 THEN NULL ELSE 0 END",
    "clients_per_advisor": "CASE WHEN k % 30 > 0 THEN round((CASE WHEN coalesce(hn, 0) / (k % 30) >= 0.5 THEN 100 WHEN coalesce(hn, 0) / (k % 30) >= 0.1 THEN 60 ELSE 0 END) * (CASE WHEN av >= 150000 THEN 1 WHEN av >= 100000 THEN 0.5 ELSE 0.25 END), 1) END",
}
SQL["factor_points"] = f"WITH {_FEATURES}, r AS (SELECT *, CASE WHEN before > 0 THEN (now - before) / before WHEN now > before THEN 1 ELSE 0 END AS gr FROM f), p AS (" + " UNION ALL ".join(f"SELECT k AS c_custkey, '{k}' AS factor, CAST({e} AS DOUBLE) AS points FROM r" for k, e in _POINTS.items()) + ") SELECT c_custkey, factor, coalesce(points, 0) AS points, points IS NOT NULL AS known FROM p"


def gate_verdicts(spark: SparkSession, d: str) -> DataFrame:
    gates = [X.gate("registered"), X.gate("raum_range", low=200_000, high=3_000_000), X.gate("no_private_funds"), X.gate("partner_type", tags=["income", "tax"])]
    out = X.apply_gates(_factor_features(spark, d), gates, [X.disqualifier("bans_illiquid"), X.disqualifier("re_competitor"), X.disqualifier("exempt_reporting")])
    return out.select("c_custkey", "failed_gate", "removed_by")


SQL["gate_verdicts"] = f"""WITH {_FEATURES} SELECT k AS c_custkey, CASE WHEN k % 13 = 0 OR k % 10 = 0 THEN 'registered' WHEN coalesce(raum, 0) < 200000 OR coalesce(raum, 0) >= 3000000 THEN 'raum_range' WHEN k % 3 > 0 THEN 'no_private_funds' WHEN income <= 1 AND tax <= 1 THEN 'partner_type' END AS failed_gate,
CASE WHEN ill = 1 THEN 'bans_illiquid' WHEN k % 12 = 0 THEN 're_competitor' WHEN k % 13 = 0 THEN 'exempt_reporting' END AS removed_by FROM f"""


def known_entity(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_name", "p_brand", "p_type")
    words = p.select(F.explode(F.split("p_name", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    found = R.known_entity(words, "w", [("first", "blue"), ("second", "green"), ("third", "red")], [("vowel", "^[aeiou]"), ("ends in k", "k$")])
    return found.select("w", "n", "known_entity", F.col("known_strength").cast("long").alias("known_strength"))


SQL["known_entity"] = """WITH w AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1)
SELECT w, n, CASE WHEN lower(w) = 'blue' THEN 'first' WHEN lower(w) = 'green' THEN 'second' WHEN lower(w) = 'red' THEN 'third' WHEN regexp_matches(lower(w), '^[aeiou]') THEN 'vowel' WHEN regexp_matches(lower(w), 'k$') THEN 'ends in k' END AS known_entity,
CAST(CASE WHEN lower(w) IN ('blue', 'green', 'red') THEN 1000 + length(w) WHEN regexp_matches(lower(w), '^[aeiou]') THEN 8 WHEN regexp_matches(lower(w), 'k$') THEN 2 END AS BIGINT) AS known_strength FROM w"""


def officer_titles(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a roster (segment as surname) and suppliers as officers of the same nation."""
    seg = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD")
    roster = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("org"), F.col("c_mktsegment").alias("last"), F.element_at(F.array(*map(F.lit, ("Annabel", "Robert", "Maria"))), (F.col("c_custkey") % 3 + 1).cast("int")).alias("first"))
    who = F.concat(F.element_at(F.array(*map(F.lit, seg)), (F.col("s_suppkey") % 5 + 1).cast("int")), F.lit(", "), F.element_at(F.array(*map(F.lit, ("ANN", "ROB", "JO", "MARY"))), (F.col("s_suppkey") % 4 + 1).cast("int")))
    officers = read(spark, d, "supplier").select(F.col("s_nationkey").alias("org"), who.alias("name"), F.concat(F.lit("officer "), F.col("s_suppkey").cast("string")).alias("title"))
    return R.officer_titles(roster, officers, "org").select("c_custkey", "officer_title")


SQL["officer_titles"] = """WITH s AS (SELECT s_nationkey, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY', 'HOUSEHOLD'][s_suppkey % 5 + 1] AS l, ['ANN', 'ROB', 'JO', 'MAR'][s_suppkey % 4 + 1] AS f, min('officer ' || s_suppkey) AS t FROM supplier GROUP BY ALL)
SELECT c_custkey, t AS officer_title FROM customer LEFT JOIN s ON s_nationkey = c_nationkey AND l = c_mktsegment AND f = ['ANN', 'ROB', 'MAR'][c_custkey % 3 + 1]"""

QUERIES = {f.__name__: f for f in (name_match, alias_match, concentration, cascade_match, pattern_vote, ambiguous_keys, segment, decision_list, score_products, scope, list_kpis, score_summary, pivot_scores, rerank_delta, title_search, suppression, factor_points, gate_verdicts, known_entity, officer_titles)}
