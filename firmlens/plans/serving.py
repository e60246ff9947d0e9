"""Queries on gates, search, text, pages, contacts and incremental maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..core.frames import group_fingerprint, sample_keys
from ..operators import contacts as P, gates as B, incremental as N, joins as J, search as C, text as X
from ..sources import feeds as A
from .tables import AS_OF, as_of, lineitem, orders, read

SQL: dict[str, str] = {}


def current_view(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).select("o_orderkey", (F.col("o_orderkey") % 2).cast("string").alias("source_key"), (F.year("odate") * 2 - F.col("o_orderkey") % 2).alias("snapshot_id"))
    registry = o.select("source_key").distinct()
    return C.current(o, registry).groupBy("source_key", "snapshot_id").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


SQL["current_view"] = """WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 2 AS VARCHAR) AS source_key, year(o_orderdate) * 2 - o_orderkey % 2 AS snapshot_id FROM orders), m AS (SELECT source_key, max(snapshot_id) AS snapshot_id FROM o GROUP BY 1)
SELECT source_key, snapshot_id, count(*) AS n, min(o_orderkey) AS first FROM o JOIN m USING (source_key, snapshot_id) GROUP BY ALL"""


def latest_filing_rows(spark: SparkSession, d: str) -> DataFrame:
    li = lineitem(spark, d).select("l_suppkey", F.col("l_orderkey").cast("string").alias("filing"), F.col("price").cast("double").alias("price"))
    return A.latest_filing_rows(li, "l_suppkey", "filing").groupBy("l_suppkey", "filing").agg(F.count("*").alias("n"), F.max("price").alias("top"))


SQL["latest_filing_rows"] = """WITH m AS (SELECT l_suppkey, max(l_orderkey) AS f FROM lineitem GROUP BY 1)
SELECT l_suppkey, CAST(l_orderkey AS VARCHAR) AS filing, count(*) AS n, CAST(max(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS top FROM lineitem JOIN m USING (l_suppkey) WHERE l_orderkey = f GROUP BY ALL"""


def crosswalk_resolve(spark: SparkSession, d: str) -> DataFrame:
    li = lineitem(spark, d).select(F.col("l_orderkey").alias("filing_id"), "sdate")
    walk = A.read_crosswalk(orders(spark, d).filter("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("filing_id"), F.col("o_custkey").alias("entity_id"), F.col("odate").alias("filed_on")), "filing_id", "entity_id", ["filed_on"])
    out = A.resolve_with(li, walk, "filing_id")
    return out.groupBy(F.year("sdate").alias("year")).agg(F.count("*").alias("n"), F.count("entity_id").alias("resolved"), F.round(F.avg(F.col("entity_id").isNotNull().cast("double")), 6).alias("rate"))


SQL["crosswalk_resolve"] = """WITH w AS (SELECT o_orderkey, max_by(o_custkey, o_orderdate) AS e FROM orders WHERE o_orderkey % 10 <> 3 GROUP BY 1)
SELECT CAST(year(l_shipdate) AS INT) AS year, count(*) AS n, count(e) AS resolved, round(avg(CASE WHEN e IS NULL THEN 0.0 ELSE 1.0 END), 6) AS rate FROM lineitem LEFT JOIN w ON o_orderkey = l_orderkey GROUP BY 1"""


def parse_props(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    by = e.groupBy("user_id").agg(F.sum("k").alias("total"), F.max("k").alias("largest"), F.count("k").alias("n"))
    return by.withColumn("share", F.round(F.col("largest") / F.nullif(F.col("total"), F.lit(0)), 6))


SQL["parse_props"] = """WITH e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT user_id, CAST(sum(k) AS BIGINT) AS total, max(k) AS largest, count(k) AS n, round(max(k) / nullif(CAST(sum(k) AS DOUBLE), 0), 6) AS share FROM e GROUP BY 1"""


def row_delta_gate(spark: SparkSession, d: str) -> DataFrame:
    runs = orders(spark, d).groupBy("o_orderstatus", F.year("odate").alias("year")).agg(F.count("*").alias("rows"))
    return B.row_delta(runs, ["o_orderstatus"], "year", "rows", 0.05, 400)


SQL["row_delta_gate"] = """WITH r AS (SELECT o_orderstatus, CAST(year(o_orderdate) AS INT) AS year, count(*) AS rows FROM orders GROUP BY ALL), p AS (SELECT *, lag(rows) OVER (PARTITION BY o_orderstatus ORDER BY year) AS prev_rows FROM r)
SELECT *, round((rows - prev_rows) / nullif(prev_rows, 0)::DOUBLE, 6) AS change, CASE WHEN rows < 400 THEN 'below floor' WHEN abs((rows - prev_rows) / nullif(prev_rows, 0)::DOUBLE) > 0.05 THEN 'changed' ELSE 'ok' END AS flag FROM p"""


def layout_audit(spark: SparkSession, d: str) -> DataFrame:
    c, o = read(spark, d, "customer"), orders(spark, d)
    return B.audit_identifiers({"customer": (c, "c_name"), "custkey": (c, "c_custkey"), "order_customer": (o, "o_custkey"), "priority": (o, "o_orderpriority")}, [("custkey", "order_customer"), ("customer", "order_customer")])


_TYPE = "CASE typeof(any_value({c})) WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' ELSE lower(typeof(any_value({c}))) END"
_ODD = "count(*) FILTER (regexp_matches(CAST({c} AS VARCHAR), '^\\s|\\s$|^[0-9]+\\.[0-9]+$'))"
SQL["layout_audit"] = (
    "WITH a AS ("
    + " UNION ALL ".join(f"SELECT '{name}' AS name, {_TYPE.format(c=c)} AS declared, count(*) AS n, {_ODD.format(c=c)} AS odd_values FROM {t}" for name, c, t in (("customer", "c_name", "customer"), ("custkey", "c_custkey", "customer"), ("order_customer", "o_custkey", "orders"), ("priority", "o_orderpriority", "orders")))
    + """), j AS (SELECT unnest(['custkey', 'order_customer', 'customer', 'order_customer']) AS x, unnest(['order_customer', 'custkey', 'order_customer', 'customer']) AS y)
SELECT name, declared, n, odd_values, declared <> 'string' AS not_text, NOT EXISTS (SELECT 1 FROM j JOIN a AS o ON o.name = j.y WHERE j.x = a.name AND o.declared <> a.declared) AS agrees FROM a"""
)


def _filters(spark: SparkSession, d: str) -> dict[str, C.Filter]:
    o = orders(spark, d).withColumnRenamed("o_custkey", "c_custkey")
    return {
        "segment": C.one_of("c_mktsegment"), "least": C.at_least("c_acctbal"), "most": C.at_most("c_acctbal"), "name": C.contains("c_name"), "nation": C.equals("c_nationkey"),
        "urgent_since": C.exists(o, "c_custkey", lambda v: (F.col("o_orderpriority") == "1-URGENT") & (F.col("odate") >= v)), "has_big_order": C.exists(o.filter("price > 470000"), "c_custkey"),
    }


def firm_search(spark: SparkSession, d: str) -> DataFrame:
    spec = {"segment": ["BUILDING", "MACHINERY", "HOUSEHOLD"], "least": 0.0, "most": 9000.0, "name": "customer#", "urgent_since": "1999-01-01", "has_big_order": False}
    found, _ = C.search(read(spark, d, "customer"), _filters(spark, d), spec)
    return C.page(found, [("c_acctbal", True), ("c_name", False)], "c_custkey", 2, 40).select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))


SQL["firm_search"] = """SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING','MACHINERY','HOUSEHOLD') AND c_acctbal BETWEEN 0 AND 9000
AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND CAST(o_orderdate AS DATE) >= DATE '1999-01-01') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND CAST(o_totalprice AS DECIMAL(18,2)) > 470000)
ORDER BY customer.c_acctbal DESC, c_name, c_custkey LIMIT 40 OFFSET 40"""


def facets(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return C.facet_counts(c, {"rich": F.col("c_acctbal") > 5000, "broke": F.col("c_acctbal") < 0, "building": F.col("c_mktsegment") == "BUILDING"})


SQL["facets"] = "SELECT count(*) AS total, count(*) FILTER (c_acctbal > 5000) AS rich, count(*) FILTER (c_acctbal < 0) AS broke, count(*) FILTER (c_mktsegment = 'BUILDING') AS building FROM customer"


def array_facets(spark: SparkSession, d: str) -> DataFrame:
    return C.array_facets(read(spark, d, "part").withColumn("words", F.split("p_name", " ")), "words")


SQL["array_facets"] = "SELECT tag, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS tag FROM part) GROUP BY 1"


def find_any(spark: SparkSession, d: str) -> DataFrame:
    return C.find_any([("customer", read(spark, d, "customer"), "c_custkey", "c_name"), ("supplier", read(spark, d, "supplier"), "s_suppkey", "s_name"), ("part", read(spark, d, "part").dropDuplicates(["p_name"]).withColumn("p_partkey", F.lit(0)), "p_partkey", "p_name")], "s", 500)


SQL["find_any"] = """WITH a AS (SELECT 'customer' AS kind, CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier UNION ALL SELECT DISTINCT 'part', '0', p_name FROM part)
SELECT kind, id, name FROM a WHERE contains(lower(name), 's') ORDER BY NOT starts_with(lower(name), 's'), name, kind, id LIMIT 500"""


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("e"), F.when(F.col("c_custkey") % 3 == 0, "review").otherwise("auto").alias("status"))
    s = read(spark, d, "customer").select(F.col("c_custkey").alias("e"), (F.col("c_acctbal") / 100).alias("score"))
    o = orders(spark, d).select(F.col("o_custkey").alias("e"))
    return C.review_queue(c, s, o, "e", 50)


SQL["review_queue"] = "SELECT c_custkey AS e, 'review' AS status, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_evidence FROM customer WHERE c_custkey % 3 = 0 AND c_acctbal / 100 >= 50"


def entity_profile(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "odate", "o_orderpriority")
    n = o.groupBy("c_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    out = C.entity_profile(read(spark, d, "customer").select("c_custkey", "c_name"), {"latest": (o, [F.desc("odate"), F.asc("o_orderkey")], ["o_orderkey"], 3), "kinds": (n, [F.desc("n"), F.asc("o_orderpriority")], ["o_orderpriority", "n"], 2)}, "c_custkey")
    flat = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), "|"), F.lit(""))
    return out.select("c_custkey", "c_name", flat("latest", lambda x: x["o_orderkey"].cast("string")).alias("latest"), flat("kinds", lambda x: F.concat_ws(":", x["o_orderpriority"], x["n"].cast("string"))).alias("kinds"))


SQL["entity_profile"] = """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders), k AS (SELECT o_custkey, o_orderpriority, n, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS rn FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)),
a AS (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY rn) AS latest FROM o WHERE rn <= 3 GROUP BY 1), b AS (SELECT o_custkey, string_agg(o_orderpriority || ':' || n, '|' ORDER BY rn) AS kinds FROM k WHERE rn <= 2 GROUP BY 1)
SELECT c_custkey, c_name, coalesce(latest, '') AS latest, coalesce(kinds, '') AS kinds FROM customer LEFT JOIN a ON a.o_custkey = c_custkey LEFT JOIN b ON b.o_custkey = c_custkey"""


def last_runs(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).select("o_custkey", F.col("odate").cast("string").alias("at"), "o_orderkey", "o_orderstatus")
    return B.last_runs(o, "o_custkey", "at", ["o_orderkey", "o_orderstatus"])


SQL["last_runs"] = "SELECT o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS at, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"


def consistency(spark: SparkSession, d: str) -> DataFrame:
    return B.consistency({"customer": (read(spark, d, "customer"), "c_custkey"), "orders": (orders(spark, d), "o_custkey"), "order_keys": (orders(spark, d), "o_orderkey"), "line_keys": (lineitem(spark, d), "l_orderkey")})


SQL["consistency"] = "SELECT 'customer' AS name, count(DISTINCT c_custkey) AS n FROM customer UNION ALL SELECT 'orders', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'order_keys', count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'line_keys', count(DISTINCT l_orderkey) FROM lineitem"


def run_rollup(spark: SparkSession, d: str) -> DataFrame:
    runs = read(spark, d, "events").select(F.col("event_type").alias("source"), F.when(F.col("user_id") % 10 == 0, "failed").when(F.col("user_id") % 10 == 1, "killed").otherwise("ok").alias("status"), (F.col("event_id") % 97).alias("seconds"), (F.col("event_id") % 50).alias("rows_in"), (F.col("event_id") % 40).alias("rows_out"))
    return B.run_rollup(runs, "source", "status", "seconds")


SQL["run_rollup"] = "SELECT event_type AS source, count(*) FILTER (user_id % 10 > 1) AS ok, count(*) FILTER (user_id % 10 = 0) AS failed, count(*) FILTER (user_id % 10 = 1) AS other, round(avg(event_id % 97), 3) AS avg_s, max(event_id % 97) AS max_s, CAST(sum(event_id % 97) AS BIGINT) AS busy_s, CAST(sum(event_id % 50) AS BIGINT) AS rows_in, CAST(sum(event_id % 40) AS BIGINT) AS rows_out FROM events GROUP BY 1"


def runs_to_slices(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    starts = e.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("s"))
    slices = starts.withColumn("e", F.lead("s").over(Window.partitionBy("user_id").orderBy("s")))
    points = e.filter("event_type <> 'signup'").select("user_id", "ts", "event_type")
    return J.within(points, slices, "user_id", "ts", "s", "e").groupBy("user_id", F.date_format("s", "yyyy-MM-dd HH:mm:ss").alias("slice")).agg(F.count("*").alias("n"))


SQL["runs_to_slices"] = """WITH s AS (SELECT user_id, ts AS s, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS e FROM events WHERE event_type = 'signup')
SELECT p.user_id, strftime(s, '%Y-%m-%d %H:%M:%S') AS slice, count(*) AS n FROM events p JOIN s ON s.user_id = p.user_id AND p.ts >= s AND (e IS NULL OR p.ts < e) WHERE event_type <> 'signup' GROUP BY ALL"""


def refresh_plan(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).withColumn("g", F.col("o_custkey") % 200)
    cols = ["o_orderkey", "o_orderstatus", "o_custkey"]
    old = group_fingerprint(o, "g", cols)
    new = group_fingerprint(o.withColumn("o_orderstatus", F.when(F.col("o_custkey").isin(7, 19, 100, 205), "X").otherwise(F.col("o_orderstatus"))), "g", cols)
    return N.plan_refresh(old, new, "g", "fingerprint")


SQL["refresh_plan"] = """WITH a AS (SELECT o_custkey % 200 AS g, bool_or(o_custkey IN (7,19,100,205) AND o_orderstatus <> 'X') AS changed FROM orders GROUP BY 1), c AS (SELECT count(*) FILTER (changed) AS changed, count(*) AS total FROM a)
SELECT CASE WHEN changed > 0.2 * total THEN 'full' WHEN changed = 0 THEN 'unchanged' ELSE 'refresh' END AS decision, changed, total FROM c"""


def refresh_keys(spark: SparkSession, d: str) -> DataFrame:
    build = lambda df: df.groupBy("o_custkey").agg(F.sum("price").cast("double").alias("total"), F.count("*").alias("n"))
    o = orders(spark, d)
    stale = build(o.filter("odate < '2001-01-01'"))
    dirty = o.filter("odate >= '2001-01-01'").select("o_custkey").distinct()
    return N.refresh_keys(stale, dirty, "o_custkey", lambda keys: build(o.join(keys, "o_custkey", "left_semi")))


SQL["refresh_keys"] = "SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n FROM orders GROUP BY 1"


def work_queue(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).groupBy(F.col("o_custkey").alias("_k")).agg(F.max("odate").alias("newest"), F.min("odate").alias("first"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    c = read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("_k"), "left").withColumns({"done": F.when(F.col("c_custkey") % 4 != 0, F.date_add("first", 900)), "failures": F.when(F.col("c_custkey") % 6 == 0, F.col("urgent")).otherwise(0)})
    out = N.due_order(N.due(c, F.lit("1999-06-30").cast("date"), "done", "failures", "newest", 200), "newest", "c_acctbal", [1000.0, 5000.0], 30)
    return out.select("c_custkey", "why", F.col("due_on").cast("string").alias("due_on"))


SQL["work_queue"] = """WITH o AS (SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS newest, CAST(min(o_orderdate) AS DATE) AS first, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1),
c AS (SELECT *, CASE WHEN c_custkey % 4 <> 0 THEN first + 900 END AS done, CASE WHEN c_custkey % 6 = 0 THEN urgent ELSE 0 END AS failures FROM customer LEFT JOIN o ON o_custkey = c_custkey),
w AS (SELECT *, date_diff('day', done, DATE '1999-06-30') AS age, CASE WHEN coalesce(failures, 1) <= 1 THEN 1 WHEN failures = 2 THEN 7 ELSE 30 END AS wait FROM c),
y AS (SELECT *, CASE WHEN done IS NULL THEN 'never' WHEN failures > 0 THEN CASE WHEN age >= wait THEN 'retry' END WHEN newest > done THEN 'newer' WHEN age >= 200 THEN 'stale' END AS why FROM w)
SELECT c_custkey, why, CAST(CAST(newest + (CASE WHEN c_acctbal < 1000 THEN 30 ELSE 0 END + CASE WHEN c_acctbal < 5000 THEN 30 ELSE 0 END) AS DATE) AS VARCHAR) AS due_on FROM y WHERE why IS NOT NULL"""


def search_queue(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    tried = orders(spark, d).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"), F.col("odate").alias("tried_on"))
    return N.search_queue(c, tried, F.lit("2001-08-01").cast("date"), "c_nationkey", "c_custkey", [F.desc("c_acctbal"), F.asc("c_custkey")], 5, {"F": 300, "O": 60}).select("c_nationkey", "c_custkey", "place")


SQL["search_queue"] = """WITH h AS (SELECT DISTINCT o_custkey FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') < CASE o_orderstatus WHEN 'F' THEN 300 WHEN 'O' THEN 60 ELSE 0 END)
SELECT c_nationkey, c_custkey, place FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM h)) WHERE place <= 5"""


def gap_candidates(spark: SparkSession, d: str) -> DataFrame:
    people = read(spark, d, "customer").select("c_nationkey", "c_custkey")
    contacts = orders(spark, d).select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderpriority") == "1-URGENT", "email").otherwise("phone").alias("kind"))
    return N.gap_candidates(read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), people.filter("c_custkey % 30 = 1"), contacts, "c_nationkey", "c_custkey")


SQL["gap_candidates"] = """WITH h AS (SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS e, bool_or(o_orderpriority <> '1-URGENT') AS p FROM orders GROUP BY 1)
SELECT n_nationkey AS c_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer LEFT JOIN h ON o_custkey = c_custkey WHERE c_custkey % 30 = 1 AND NOT (coalesce(e, false) AND coalesce(p, false)))"""


_VOCABULARY = [("the_pair", ["of the", "in the"]), ("license", ["licensed under", "public license version"]), ("single", ["ation"]), ("long", ["is licensed under the"])]


def tag_documents(spark: SparkSession, d: str) -> DataFrame:
    return X.tag_documents(read(spark, d, "documents"), _VOCABULARY).select("doc", "tag", "hits", "phrases", "negated", "confidence", "section")


SQL["tag_documents"] = r"""WITH v(tag, phrase, spec) AS (VALUES ('the_pair','of the',0.7::DOUBLE),('the_pair','in the',0.7),('license','licensed under',0.7),('license','public license version',0.9),('single','ation',0.5),('long','is licensed under the',0.9)),
s AS (SELECT doc_id AS doc, unnest(string_split(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.!?]) ', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM documents),
h AS (SELECT doc, lower(sentence) AS low, tag, phrase, spec, (length(lower(sentence)) - length(replace(lower(sentence), phrase, ''))) // length(phrase) AS n FROM s, v WHERE contains(lower(sentence), phrase)),
d AS (SELECT *, regexp_matches(low, '(^|[^a-z0-9_])(not|no|never|does not|do not|without|neither)($|[^a-z0-9_])') AS denied FROM h),
g AS (SELECT doc, tag, CAST(sum(n) AS BIGINT) AS hits, count(DISTINCT phrase) AS phrases, CAST(sum(CASE WHEN denied THEN n ELSE 0 END) AS BIGINT) AS negated, max(spec) AS spec FROM d GROUP BY ALL)
SELECT doc, tag, hits, phrases, negated, round(least(1.0, (spec + 0.02 * least(hits, 5)) * CASE WHEN negated = hits THEN 0.6 ELSE 1.0 END), 4) AS confidence, NULL::INT AS section FROM g"""


def page_signals(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages").withColumn("host", F.try_parse_url("url", F.lit("HOST")))
    return X.page_signals(pages, [("article", "^/(the|la|le|der|die|el|un)$"), ("comma", ",$"), ("verb", "^/(is|was|are|ist|es)$"), ("ation", "ation")], "host").select("host", "signal", "page_id", "evidence")


SQL["page_signals"] = r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a>') AS tags FROM pages), t AS (SELECT page_id, host, unnest(tags) AS tag, generate_subscripts(tags, 1) AS place FROM p),
l AS (SELECT page_id, host, place, regexp_extract(tag, '(?is)href\s*=\s*["'']?([^"''\s>]+)', 1) AS href, trim(regexp_replace(regexp_replace(tag, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS label FROM t),
s(signal, pattern) AS (VALUES ('article', '^/(the|la|le|der|die|el|un)$'), ('comma', ',$'), ('verb', '^/(is|was|are|ist|es)$'), ('ation', 'ation')),
h AS (SELECT *, row_number() OVER (PARTITION BY host, signal ORDER BY page_id, place, href) AS rn FROM l, s WHERE regexp_matches(lower(href), pattern) OR regexp_matches(lower(label), pattern))
SELECT host, signal, page_id, href AS evidence FROM h WHERE rn = 1"""


def page_contacts(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return X.document_contacts(docs, lines=None, n=None).filter("kind = 'email'").select("doc", "kind", "value")


SQL["page_contacts"] = r"""WITH e AS (SELECT doc_id AS doc, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}')) AS v FROM documents)
SELECT DISTINCT doc, 'email' AS kind, lower(v) AS value FROM e WHERE NOT regexp_matches(lower(v), '(\.(png|jpg|jpeg|gif|svg|css|js)$)|^(example|test|noreply|no-reply)@|@(example|sentry)\.') AND NOT regexp_matches(lower(v), '@(sec|finra)\.|\.gov$')"""


def page_emails(spark: SparkSession, d: str) -> DataFrame:
    return X.page_emails(read(spark, d, "pages"))


SQL["page_emails"] = r"""WITH v AS (SELECT page_id, html, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') AS host, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS vis FROM pages),
p AS (SELECT *, regexp_replace(regexp_replace(vis, '\\s*[\\[(]\\s*at\\s*[\\])]\\s*', '@', 'gi'), '\\s*[\\[(]\\s*dot\\s*[\\])]\\s*', '.', 'gi') AS plain FROM v),
x AS (SELECT page_id, host, [lower(s) FOR s IN regexp_extract_all(html, '(?i)mailto:([^"''?>\\s]+)', 1)] AS mail, [lower(s) FOR s IN regexp_extract_all(vis, '{m}')] AS seen, [lower(s) FOR s IN regexp_extract_all(plain, '{m}')] AS made, [lower(s) FOR s IN regexp_extract_all(html, '{m}')] AS every FROM p),
e AS (SELECT page_id, host, unnest(mail) AS email, 'mailto' AS method, 85 AS confidence, true AS visible FROM x UNION ALL SELECT page_id, host, unnest(seen), 'plain', 70, true FROM x UNION ALL SELECT page_id, host, unnest([s FOR s IN made IF NOT list_contains(seen, s)]), 'obfuscated', 50, true FROM x UNION ALL SELECT page_id, host, unnest([s FOR s IN every IF NOT list_contains(seen, s)]), 'hidden', 50, false FROM x),
g AS (SELECT *, row_number() OVER (PARTITION BY page_id, email ORDER BY confidence DESC, method) AS rn FROM e WHERE regexp_matches(email, '^{m}$') AND NOT regexp_matches(email, '(\\.(png|jpg|jpeg|gif|svg|css|js)$)|^(example|test|noreply|no-reply)@|@(example|sentry)\\.') AND (visible OR ends_with(email, '@' || host)))
SELECT page_id, email, method, confidence FROM g WHERE rn = 1""".replace("\\\\", "\\").replace("{m}", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")


def page_phones(spark: SparkSession, d: str) -> DataFrame:
    return X.page_phones(read(spark, d, "pages"))


def page_cards(spark: SparkSession, d: str) -> DataFrame:
    return X.page_cards(read(spark, d, "pages"))


def page_settle(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_distinct(F.split(F.trim(F.regexp_replace("text", "\\s+", " ")), " "))
    hits = read(spark, d, "documents").select("source", F.col("doc_id").alias("person"), F.explode(words).alias("value")).filter(F.char_length("value") >= 12)
    main = hits.groupBy("source").agg(F.min("value").alias("value"))
    out = X.settle_shared(hits, "source", "person", "value", main, F.lit(False), F.col("value").startswith("a"))
    return out.groupBy("source", "level").agg(F.count("*").alias("n"), F.countDistinct("value").alias("values"))


SQL["page_settle"] = r"""WITH h AS (SELECT DISTINCT source, doc_id AS person, unnest(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS value FROM documents), k AS (SELECT * FROM h WHERE length(value) >= 12),
s AS (SELECT source, value, count(DISTINCT person) AS n FROM k GROUP BY ALL), m AS (SELECT source, min(value) AS value FROM k GROUP BY 1),
l AS (SELECT k.*, CASE WHEN (s.n >= 2 OR m.value IS NOT NULL) AND NOT starts_with(k.value, 'a') THEN 'org' ELSE 'person' END AS level FROM k JOIN s USING (source, value) LEFT JOIN m ON m.source = k.source AND m.value = k.value)
SELECT source, level, count(*) AS n, count(DISTINCT value) AS values FROM l GROUP BY ALL"""


def posting_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).select(F.col("o_custkey").alias("org"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("source"), "odate")
    old = o.filter("odate < '2000-01-01'").groupBy("org", "title", "source").agg(F.min("odate").alias("first_seen"), F.max("odate").alias("last_seen")).withColumn("closed", F.lit(False))
    seen = o.filter("odate >= '2000-01-01' and odate < '2000-07-01'").select("org", "title", "source").distinct()
    reads = spark.createDataFrame([("F", True), ("O", True), ("P", False)], "source string, ok boolean")
    out = X.posting_lifecycle(old, seen, reads, F.lit("2000-07-01").cast("date"), ["org", "title"], "source")
    return out.select("org", "title", "source", F.col("first_seen").cast("string").alias("first_seen"), F.col("last_seen").cast("string").alias("last_seen"), "closed")


SQL["posting_lifecycle"] = """WITH o AS (SELECT o_custkey AS org, o_orderpriority AS title, o_orderstatus AS source, CAST(o_orderdate AS DATE) AS d FROM orders), a AS (SELECT org, title, source, min(d) AS f, max(d) AS l FROM o WHERE d < DATE '2000-01-01' GROUP BY ALL), b AS (SELECT DISTINCT org, title, source FROM o WHERE d >= DATE '2000-01-01' AND d < DATE '2000-07-01')
SELECT coalesce(a.org, b.org) AS org, coalesce(a.title, b.title) AS title, coalesce(a.source, b.source) AS source, CAST(coalesce(f, DATE '2000-07-01') AS VARCHAR) AS first_seen, CAST(CASE WHEN b.org IS NOT NULL THEN DATE '2000-07-01' ELSE l END AS VARCHAR) AS last_seen, b.org IS NULL AND coalesce(a.source, b.source) <> 'P' AS closed
FROM a FULL JOIN b ON a.org = b.org AND a.title = b.title AND a.source = b.source"""


def _contacts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found = read(spark, d, "documents").select("doc_id", "source", F.explode(X.emails_in(F.col("text"))).alias("value"))
    rows = found.select(F.col("source").alias("entity"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("p"), (F.col("doc_id") % 5).cast("string"))).alias("person"), F.lit("email").alias("kind"), "value", (F.col("doc_id") % 90).cast("int").alias("confidence"), F.when(F.col("doc_id") % 2 == 0, "web").otherwise("feed").alias("source"), F.when(F.col("doc_id") % 4 == 0, F.col("source")).alias("label"), F.lit(None).cast("string").alias("title"), F.col("doc_id").alias("seen"))
    return rows.filter("seen % 2 = 0"), rows.filter("seen % 2 = 1")


def contact_merge(spark: SparkSession, d: str) -> DataFrame:
    old, new = _contacts(spark, d)
    merged = P.drop_firm_copies(P.merge_contacts(old, new))
    return merged.select("entity", "person", "kind", "value", "confidence", "source", F.array_join("sources", "|").alias("sources"), "label", "seen")


_CONTACTS = r"""e AS (SELECT DISTINCT doc_id, source AS entity, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}'))) AS value FROM documents),
r AS (SELECT entity, CASE WHEN doc_id % 3 <> 0 THEN 'p' || (doc_id % 5) END AS person, 'email' AS kind, value, CAST(doc_id % 90 AS INT) AS confidence, CASE WHEN doc_id % 2 = 0 THEN 'web' ELSE 'feed' END AS source, CASE WHEN doc_id % 4 = 0 THEN entity END AS label, doc_id AS seen FROM e WHERE NOT regexp_matches(value, '(\.(png|jpg|jpeg|gif|svg|css|js)$)|^(example|test|noreply|no-reply)@|@(example|sentry)\.')),
m AS (SELECT entity, person, kind, value, max(confidence) AS confidence, arg_max(source, (confidence, -seen, source)) AS source, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, arg_min(label, seen) FILTER (label IS NOT NULL) AS label, min(seen) AS seen FROM r GROUP BY entity, person, kind, value)"""
SQL["contact_merge"] = f"""WITH {_CONTACTS}
SELECT * FROM m WHERE person IS NOT NULL OR NOT EXISTS (SELECT 1 FROM m o WHERE o.person IS NOT NULL AND o.entity = m.entity AND o.kind = m.kind AND o.value = m.value)"""


def best_contact(spark: SparkSession, d: str) -> DataFrame:
    merged = P.merge_contacts(*_contacts(spark, d)).withColumn("is_role", P.is_role(F.col("kind"), F.col("value")))
    return P.best_contacts(merged)


SQL["best_contact"] = f"""WITH {_CONTACTS}, k AS (SELECT *, split_part(value, '@', 1) IN ('info','contact','admin','office','support','sales','hello','help','compliance','hr','jobs','marketing','service','team') AS is_role FROM m WHERE person IS NOT NULL),
x AS (SELECT *, row_number() OVER (PARTITION BY entity, person ORDER BY is_role, confidence DESC, seen, value DESC) AS rn FROM k)
SELECT entity, person, value AS email, NULL::VARCHAR AS phone, NULL::VARCHAR AS profile FROM x WHERE rn = 1"""


def eligibility(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 1100).alias("ind"), F.when(F.col("c_custkey") % 13 != 0, (F.col("c_custkey") % 900).cast("string")).alias("addr"), F.when(F.col("c_acctbal") < -500, "opt_out").alias("suppressed_by"), "c_acctbal")
    h = orders(spark, d).select((F.col("o_custkey") % 1100).alias("ind"), F.col("odate").alias("sent_on"))
    return P.eligibility(c, "c_custkey", "ind", "addr", [F.desc("c_acctbal")], h, 60, as_of()).select("c_custkey", "reason")


SQL["eligibility"] = f"""WITH c AS (SELECT c_custkey, c_custkey % 1100 AS ind, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 900 END AS addr, c_acctbal FROM customer), h AS (SELECT o_custkey % 1100 AS ind, CAST(max(o_orderdate) AS DATE) AS s FROM orders GROUP BY 1),
e AS (SELECT c.*, CASE WHEN c_acctbal < -500 THEN 'suppressed: opt_out' WHEN addr IS NULL THEN 'no address' WHEN date_diff('day', s, DATE '{AS_OF}') < 60 THEN 'sent lately' END AS early FROM c LEFT JOIN h USING (ind)),
n AS (SELECT *, row_number() OVER (PARTITION BY ind, early IS NULL ORDER BY c_acctbal DESC, c_custkey) AS nth FROM e), a AS (SELECT *, row_number() OVER (PARTITION BY addr, early IS NULL AND nth = 1 ORDER BY c_acctbal DESC, c_custkey) AS ath FROM n)
SELECT c_custkey, coalesce(early, CASE WHEN nth > 1 THEN 'individual already in this batch' WHEN ath > 1 THEN 'address already in this batch' ELSE 'eligible' END) AS reason FROM a"""


def sampled_keys(spark: SparkSession, d: str) -> DataFrame:
    return sample_keys(orders(spark, d), "o_custkey", 50, 7)


QUERIES = {f.__name__: f for f in (current_view, latest_filing_rows, crosswalk_resolve, parse_props, row_delta_gate, layout_audit, firm_search, facets, array_facets, find_any, review_queue, entity_profile, last_runs, consistency, run_rollup, runs_to_slices, refresh_plan, refresh_keys, work_queue, search_queue, gap_candidates, tag_documents, page_signals, page_contacts, page_emails, page_phones, page_cards, page_settle, posting_lifecycle, contact_merge, best_contact, eligibility, sampled_keys)}
