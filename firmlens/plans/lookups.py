"""Queries on matching without products, deep pages, the index of parts of names and one-to-one choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..core.scratch import Scratch
from ..operators import joins as J, resolve as R, search as C, signals as G, sites as W
from ..sources import feeds as A
from .tables import orders, read

SQL: dict[str, str] = {}


def match_classes(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and customers by a key that a tenth of both sides shares, as classes and pairs."""
    key = lambda c: F.when(F.col(c) % 10 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col(c) % 600).cast("string")))
    c = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, F.col("c_custkey").cast("string")).otherwise("").alias("exact_key"), key("c_custkey").alias("generic_key"), F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("state"))
    s = read(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("exact_key"), key("s_suppkey").alias("generic_key"), F.col("s_nationkey").alias("state"))
    return R.match_classes(s, c, "s_suppkey", "c_custkey")


SQL["match_classes"] = """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS e, CASE WHEN c_custkey % 10 = 0 THEN 'hot' ELSE 'g' || (c_custkey % 600) END AS g, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS cs FROM customer),
s AS (SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS e, CASE WHEN s_suppkey % 10 = 0 THEN 'hot' ELSE 'g' || (s_suppkey % 600) END AS g, s_nationkey AS ss FROM supplier),
ex AS (SELECT s_suppkey, c_custkey, ss, cs, 'exact' AS method, s.e AS key FROM s JOIN c ON s.e = c.e WHERE s.e <> ''),
ge AS (SELECT s_suppkey, c_custkey, ss, cs, 'generic' AS method, s.g AS key FROM s JOIN c ON s.g = c.g WHERE s_suppkey NOT IN (SELECT s_suppkey FROM ex)),
m AS (SELECT *, CASE WHEN ss IS NULL OR cs IS NULL THEN 'unknown' WHEN ss = cs THEN 'agree' ELSE 'conflict' END AS relation,
  greatest(count(*) OVER (PARTITION BY s_suppkey), count(*) OVER (PARTITION BY c_custkey)) AS n FROM (SELECT * FROM ex UNION ALL SELECT * FROM ge)),
w AS (SELECT method, key, count(DISTINCT s_suppkey) AS nl, count(DISTINCT c_custkey) AS nr FROM m GROUP BY ALL),
k AS (SELECT m.*, nl > 1 AND nr > 1 AS wide, round(greatest(0.0::DOUBLE, CASE WHEN method = 'exact' THEN CASE relation WHEN 'unknown' THEN 0.78::DOUBLE WHEN 'agree' THEN 0.95::DOUBLE ELSE 0.45::DOUBLE END ELSE CASE relation WHEN 'unknown' THEN 0.55::DOUBLE WHEN 'agree' THEN 0.72::DOUBLE ELSE 0.25::DOUBLE END END - CASE WHEN n > 1 THEN 0.20::DOUBLE ELSE 0.0 END), 3) AS confidence FROM m JOIN w USING (method, key)),
o AS (SELECT method, key, ss AS left_state, relation, count(DISTINCT s_suppkey) AS n_left, count(DISTINCT c_custkey) AS n_right, NULL::BIGINT AS left_id, NULL::BIGINT AS right_id, max(confidence) AS confidence FROM k WHERE wide GROUP BY ALL
UNION ALL SELECT method, key, ss, relation, 1, 1, s_suppkey, c_custkey, confidence FROM k WHERE NOT wide)
SELECT *, CASE WHEN confidence >= 0.85 THEN 'auto' WHEN confidence >= 0.5 THEN 'review' ELSE 'rejected' END AS status FROM o"""


def offering_match(spark: SparkSession, d: str) -> DataFrame:
    """For the first words of part names the best part that has the name or begins with it, the latest by size."""
    p = read(spark, d, "part")
    notices = p.select(F.col("p_partkey").alias("notice_id"), F.upper("p_name").alias("name"), F.col("p_size").alias("filed"))
    queries = p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_partkey") % 2 == 0, F.substring_index("p_name", " ", 1)).otherwise(F.col("p_name")).alias("name"))
    return A.match_offerings(queries, notices).select("query_id", "notice_id", "exact", "filed")


SQL["offering_match"] = """WITH q AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 2 = 0 THEN string_split(p_name, ' ')[1] ELSE p_name END AS name FROM part WHERE p_partkey % 3 = 0),
m AS (SELECT query_id, p_partkey AS notice_id, p_name = q.name AS exact, p_size AS filed, row_number() OVER (PARTITION BY query_id ORDER BY p_name = q.name DESC, p_size DESC, p_partkey) AS k FROM q JOIN part ON p_name = q.name OR starts_with(p_name, q.name || ' '))
SELECT query_id, notice_id, exact, filed FROM m WHERE k = 1"""


def order_before(spark: SparkSession, d: str) -> DataFrame:
    """Every order with the customer's latest order of another day before it."""
    o = orders(spark, d).select("o_orderkey", "o_custkey", "odate")
    other = orders(spark, d).select("o_custkey", F.col("odate").alias("day"), F.col("o_orderkey").alias("before"))
    return J.latest_before(o, other, "o_custkey", "odate", "day", ["before"], "").select("o_orderkey", "before")


SQL["order_before"] = """SELECT a.o_orderkey, arg_max(b.o_orderkey, (b.o_orderdate, b.o_orderkey)) AS before FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND CAST(b.o_orderdate AS DATE) < CAST(a.o_orderdate AS DATE) GROUP BY 1"""


def deep_page(spark: SparkSession, d: str) -> DataFrame:
    """A page far down the orders by price, read from the ranges that hold it."""
    o = orders(spark, d).select("o_orderkey", "o_orderstatus", "price")
    return C.page(o, [("o_orderstatus", True), ("price", True)], "o_orderkey", 14, 100, shallow=500).withColumn("price", F.col("price").cast("double"))


SQL["deep_page"] = "SELECT o_orderkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price FROM orders ORDER BY orders.o_orderstatus DESC, CAST(orders.o_totalprice AS DECIMAL(18,2)) DESC, orders.o_orderkey LIMIT 100 OFFSET 1300"


def cursor_page(spark: SparkSession, d: str) -> DataFrame:
    """The customers that follow one in the order of balance."""
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    last = c.filter("c_custkey = 77").first().asDict()
    return C.after(c, [("c_nationkey", False), ("c_acctbal", True)], "c_custkey", last, 30)


SQL["cursor_page"] = """SELECT c_custkey, c_nationkey, c_acctbal FROM customer c, (SELECT c_custkey AS k, c_nationkey AS n, c_acctbal AS a FROM customer WHERE c_custkey = 77)
WHERE c_nationkey > n OR c_nationkey = n AND (c_acctbal < a OR c_acctbal = a AND c_custkey > k) ORDER BY c.c_nationkey, c.c_acctbal DESC, c.c_custkey LIMIT 30"""


def find_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Customers and parts whose names hold a text, by the index of three-letter pieces."""
    names = read(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("name"))
    names = names.union(read(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), "p_name"))
    index = C.TextIndex.build(names, "key", "name", Scratch(spark, "index").where("names"), buckets=16)
    return index.search("Omer#00000000").union(index.search("E GR")).union(index.search("no such name"))


SQL["find_indexed"] = """WITH a AS (SELECT 'c' || c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT 'p' || p_partkey, p_name FROM part)
SELECT key, name FROM a WHERE contains(lower(name), 'omer#00000000') UNION ALL SELECT key, name FROM a WHERE contains(lower(name), 'e gr')"""


def profile_choice(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a brand as people named by their first two words, and slugs of other parts' words given to them one to one."""
    p = read(spark, d, "part").select("p_partkey", "p_brand", F.split("p_name", " ").alias("w"))
    people = p.select(F.col("p_brand").alias("org"), F.col("p_partkey").alias("person"), F.get("w", F.lit(0)).alias("first"), F.element_at("w", -1).alias("last"))
    slug = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("-", F.get("w", F.lit(0)), F.element_at("w", -1))).otherwise(F.concat(F.substring(F.get("w", F.lit(0)), 1, 1), F.element_at("w", -1)))
    return R.assign_profiles(p.select(F.col("p_brand").alias("org"), slug.alias("slug")), people, "org", Scratch(spark, "profiles"))


def site_frames(spark: SparkSession, d: str) -> DataFrame:
    """Of every page the number of fragments of its own, of its site's frame and of framing elements, and its own text's digest."""
    whole = W.cut_pages(read(spark, d, "pages"))
    out = W.split_frame(whole, W.site_frames(whole)).withColumnsRenamed({"body": "own", "framing": "all_framing"})
    framing = whole.select(F.col("page_id").alias("_p"), F.size("framing").alias("n_elements"))
    joined = out.join(framing, F.col("page_id") == F.col("_p"))
    return joined.select("page_id", "site", F.size("own").alias("n_own"), (F.size("all_framing") - F.col("n_elements")).alias("n_frame"), F.md5(F.array_join("own", "\n").cast("binary")).alias("own_md5"))


_FRAGMENTS = "list_filter(list_transform(string_split_regex({}, '" + W.BLOCKS.replace("'", "''") + "'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"
SQL["site_frames"] = f"""WITH s AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '') AS site, regexp_replace(coalesce(html, ''), '{W.HIDDEN}', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, site, {_FRAGMENTS.format("regexp_replace(h, '" + W.FRAMING + "', '<br>', 'g')")} AS body FROM s),
n AS (SELECT site, count(*) AS n_pages FROM b GROUP BY 1 HAVING count(*) >= 3),
f AS (SELECT site, x FROM (SELECT page_id, site, unnest(list_distinct(body)) AS x FROM b) JOIN n USING (site) GROUP BY site, x, n_pages HAVING count(*) >= 0.5 * n_pages),
g AS (SELECT site, list(x) AS frame FROM f GROUP BY 1),
o AS (SELECT page_id, b.site, list_filter(body, lambda x: NOT coalesce(list_contains(frame, x), false)) AS own, body FROM b LEFT JOIN g ON b.site = g.site)
SELECT page_id, site, CAST(len(own) AS INT) AS n_own, CAST(len(body) - len(own) AS INT) AS n_frame, md5(array_to_string(own, chr(10))) AS own_md5 FROM o"""


def _with_contacts(pages: DataFrame) -> DataFrame:
    """The pages with a paragraph of numbers and openings made from their ids: the given ones hold none."""
    i = F.col("page_id")
    more = F.concat(
        F.lit("<p>Direct: 415-555-"), (1000 + i % 900).cast("string"), F.lit("</p><p>Mobile 617-555-"), (2000 + i % 50).cast("string"), F.lit(" ext. "), (i % 7 + 1).cast("string"), F.lit("</p><p>617-555-"), (2000 + i % 50).cast("string"),
        F.lit("</p><p>fax 202-555-"), (3000 + i % 9).cast("string"), F.lit("</p><footer>Call 415-555-"), (1000 + i % 3).cast("string"), F.lit("</footer><h2>"), F.when(i % 2 == 0, "Client Service Associate").otherwise("Tax Planning"), F.lit('</h2><script>{"jobTitle":"Analyst No '), (i % 5).cast("string"), F.lit('"}</script>'),
    )
    return pages.withColumn("html", F.concat(F.coalesce("html", F.lit("")), more))


def site_phones(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of pages outside their site's frame, of the pages with numbers added; labels by words alone, numbers as they stand in longer runs of digits too."""
    whole = W.cut_pages(_with_contacts(read(spark, d, "pages")))
    return W.site_phones(W.split_frame(whole, W.site_frames(whole)), toll_free=(), whole=False)


SQL["site_phones"] = """WITH p AS (SELECT page_id, '415555' || (1000 + page_id % 900) AS direct, '617555' || (2000 + page_id % 50) AS mobile, CAST(page_id % 7 + 1 AS VARCHAR) AS x, '415555' || (1000 + page_id % 3) AS framed FROM pages)
SELECT page_id, direct AS number, NULL AS extension, 'direct' AS label FROM p WHERE direct <> framed UNION ALL SELECT page_id, mobile, x, 'mobile' FROM p
UNION ALL SELECT DISTINCT page_id, right(regexp_replace(n, '[^0-9]', '', 'g'), 10), NULL, NULL FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?:\\+?1[-. ]?)?\\(?[2-9][0-9]{2}\\)?[-. ]{1,2}[0-9]{3}[-. ][0-9]{4}')) AS n FROM pages)"""


def site_roles(spark: SparkSession, d: str) -> DataFrame:
    """Openings shown or carried by pages, of the pages with openings added."""
    pages = _with_contacts(read(spark, d, "pages"))
    whole = W.cut_pages(pages)
    return W.site_roles(pages, W.split_frame(whole, W.site_frames(whole, share=1.1)))


SQL["site_roles"] = """SELECT page_id, 'Client Service Associate' AS title, false AS carried FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'Analyst No ' || (page_id % 5), true FROM pages"""

def _world(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Users of events as firms, with scope, scores, contacts, moves and a team from the same tables."""
    e = read(spark, d, "events").withColumn("date", F.to_date("ts"))
    u = e.groupBy(F.col("user_id").alias("entity_id")).agg(F.count("*").alias("n"), F.round(F.max("value"), 2).alias("raum"))
    k = F.col("entity_id")
    firms = u.select(k, F.concat(F.lit("Firm "), k.cast("string")).alias("name"), (k % 11 == 0).alias("is_exempt"), F.when(k % 2 == 0, "SEC").otherwise("STATE").alias("regulator"), "raum", F.when(k % 5 != 0, F.concat(F.lit("S"), (k % 4).cast("string"))).alias("state"), F.when(k % 3 == 0, "lead").when(k % 3 == 1, "customer").alias("status"))
    scope = u.filter("entity_id % 3 <> 2").select(k, (k % 10).alias("priority"))
    product = lambda name, m: u.select(k, F.lit(name).alias("product"), F.when(k % m == 0, "gated").otherwise("scored").alias("status"), (k % 97).alias("score"), (k % 51 + 50).alias("coverage"), F.when(k < 9, k).otherwise(F.lit(99)).alias("rank"))
    events = e.select("event_id", F.col("user_id").alias("entity_id"), F.col("event_type").alias("event"), "date", (F.col("event_id") % 9 == 0).alias("suppressed"), (F.col("event_id") % 21 - 10).alias("strength"))
    contacts = e.select(F.col("user_id").alias("entity_id"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("p"), (F.col("event_id") % 6).cast("string"))).alias("person"), F.when(F.col("event_id") % 2 == 0, "email").otherwise("phone").alias("kind"), (F.col("event_id") % 13 == 0).alias("is_role"), F.when(F.col("event_id") % 3 == 0, "valid").when(F.col("event_id") % 3 == 1, "unverified").alias("verify_status"), F.when(F.col("event_id") % 5 == 0, "pattern").otherwise("site").alias("source"))
    moves = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("move_id"), F.col("user_id").alias("entity_id"), "date")
    team = u.select(k, F.col("n").alias("headcount"), (k % 8).alias("hires_12m"))
    actions = e.filter("event_id % 6 = 1").select("event_id", F.when(F.col("event_id") % 12 == 1, "done").otherwise("snoozed").alias("state"))
    return {"firms": firms, "scope": scope, "scores": product("alpha", 4).union(product("beta", 7)), "events": events, "contacts": contacts, "moves": moves, "team": team, "actions": actions}


_WORLD = """e AS (SELECT *, CAST(ts AS DATE) AS date FROM events), u AS (SELECT user_id AS k, count(*) AS n, round(max(value), 2) AS raum FROM e GROUP BY 1),
sc AS (SELECT k, k % 10 AS priority FROM u WHERE k % 3 <> 2),
ps AS (SELECT k, 'alpha' AS product, k % 97 AS score, k % 51 + 50 AS coverage, CASE WHEN k < 9 THEN k ELSE 99 END AS rank FROM u WHERE k % 4 <> 0 UNION ALL SELECT k, 'beta', k % 97, k % 51 + 50, CASE WHEN k < 9 THEN k ELSE 99 END FROM u WHERE k % 7 <> 0),
live AS (SELECT event_id, user_id AS k, event_type AS event, date, event_id % 21 - 10 AS strength, CASE WHEN event_id % 12 = 1 THEN 'done' WHEN event_id % 6 = 1 THEN 'snoozed' END AS action FROM e WHERE event_id % 9 <> 0),
ct AS (SELECT user_id AS k, CASE WHEN event_id % 4 <> 0 THEN 'p' || (event_id % 6) END AS person, event_id % 2 = 0 AS mail, event_id % 13 = 0 AS is_role, event_id % 3 AS v, event_id % 5 = 0 AS guess FROM e)"""


def feed_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a list's open signals of a fortnight, newest first."""
    w = _world(spark, d)
    rows, _ = G.feed(w["events"], w["firms"], w["scope"], w["scores"], w["actions"], product="alpha", q="firm", since=F.lit("2024-01-10").cast("date"))
    found = C.page(rows.withColumn("weight", F.abs("strength")), G.feed_order(), "event_id", 2, 40)
    return found.select("event_id", "entity_id", "event", F.col("date").cast("string").alias("date"), "strength", "priority")


SQL["feed_page"] = f"""WITH {_WORLD} SELECT event_id, k AS entity_id, event, CAST(date AS VARCHAR) AS date, strength, priority FROM live JOIN sc USING (k) WHERE k IN (SELECT k FROM ps WHERE product = 'alpha') AND action IS NULL AND date >= DATE '2024-01-10'
ORDER BY live.date DESC, abs(strength) DESC, event_id LIMIT 40 OFFSET 40"""


def feed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Signals by kind for four settings of the feed's filters."""
    w = _world(spark, d)
    cases = [{"state": None}, {"state": "done", "product": "beta"}, {"q": "1"}, {"kind": "error", "q": "irm 2", "state": "snoozed"}]
    out = None
    for i, case in enumerate(cases):
        part = G.feed(w["events"], w["firms"], w["scope"], w["scores"], w["actions"], **case)[1].select(F.lit(i).alias("setting"), "event", "n")
        out = part if out is None else out.union(part)
    return out


SQL["feed_counts"] = f"""WITH {_WORLD}, l AS (SELECT * FROM live JOIN sc USING (k)) SELECT 0 AS setting, event, count(*) AS n FROM l GROUP BY ALL
UNION ALL SELECT 1, event, count(*) FROM l WHERE action = 'done' AND k IN (SELECT k FROM ps WHERE product = 'beta') GROUP BY ALL
UNION ALL SELECT 2, event, count(*) FROM l WHERE action IS NULL AND contains(CAST(k AS VARCHAR), '1') GROUP BY ALL
UNION ALL SELECT 3, event, count(*) FROM l WHERE action = 'snoozed' AND event = 'error' AND starts_with(CAST(k AS VARCHAR), '2') GROUP BY ALL"""


def home(spark: SparkSession, d: str) -> DataFrame:
    """The whole start page."""
    w = _world(spark, d)
    since = F.lit("2024-01-20").cast("date")
    fresh = G.feed(w["events"], w["firms"], w["scope"], w["scores"], w["actions"], since=since)[0]
    return C.home(w["firms"], w["scope"], w["scores"], fresh, w["contacts"], w["moves"], w["events"], w["team"], F.lit("2024-01-31").cast("date"), large=105)


SQL["home"] = f"""WITH {_WORLD}, f AS (SELECT DISTINCT k FROM live JOIN sc USING (k) WHERE action IS NULL AND date >= DATE '2024-01-20'), ok AS (SELECT DISTINCT k FROM ct WHERE mail AND person IS NOT NULL AND NOT is_role AND v = 0)
SELECT 'universe' AS section, 'firms' AS key, count(*) FILTER (k % 11 <> 0) AS n, sum(raum) FILTER (k % 11 <> 0) AS value FROM u UNION ALL SELECT 'universe', 'firms_sec', count(*) FILTER (k % 11 <> 0 AND k % 2 = 0), NULL FROM u UNION ALL SELECT 'universe', 'exempt', count(*) FILTER (k % 11 = 0), NULL FROM u
UNION ALL SELECT 'universe', 'listed', count(*), NULL FROM sc UNION ALL SELECT 'list', product, count(*), round(avg(coverage), 4) FROM ps GROUP BY product UNION ALL SELECT 'strong', product, count(*) FILTER (score >= 60), NULL FROM ps GROUP BY product
UNION ALL SELECT 'fresh', product, count(*), NULL FROM ps WHERE k IN (SELECT k FROM f) GROUP BY product UNION ALL SELECT 'top', product || ':' || rank, k, CASE WHEN k IN (SELECT k FROM ok) THEN 1 ELSE 0 END FROM ps WHERE rank <= 6
UNION ALL SELECT 'reach', 'named_email', count(DISTINCT (k, person)) FILTER (mail AND person IS NOT NULL AND NOT is_role), NULL FROM ct UNION ALL SELECT 'reach', 'verified', count(*) FILTER (mail AND v = 0), NULL FROM ct
UNION ALL SELECT 'reach', 'candidates', count(*) FILTER (mail AND guess AND v = 1), NULL FROM ct UNION ALL SELECT 'reach', 'direct', count(*) FILTER (NOT mail AND person IS NOT NULL), NULL FROM ct UNION ALL SELECT 'reach', 'phones', count(*) FILTER (NOT mail), NULL FROM ct
UNION ALL (SELECT 'moves', CAST(event_id AS VARCHAR), k, NULL FROM e JOIN u ON user_id = k JOIN sc USING (k) WHERE event_type = 'purchase' AND date_diff('day', date, DATE '2024-01-31') BETWEEN 0 AND 60 AND n <= 105 ORDER BY date DESC, priority DESC, event_id LIMIT 14)
UNION ALL (SELECT 'signals', CAST(event_id AS VARCHAR), k, NULL FROM live JOIN sc USING (k) WHERE date_diff('day', date, DATE '2024-01-31') BETWEEN 0 AND 60 ORDER BY date DESC, priority DESC, event_id LIMIT 14)
UNION ALL (SELECT 'hiring', CAST(k AS VARCHAR), k % 8, NULL FROM u JOIN sc USING (k) WHERE k % 8 >= 2 AND n <= 105 ORDER BY k % 8 DESC, priority DESC, k LIMIT 6)
UNION ALL SELECT 'state', 'S' || (k % 4), count(*), NULL FROM sc WHERE k % 5 <> 0 GROUP BY k % 4 UNION ALL SELECT 'pipeline', CASE k % 3 WHEN 0 THEN 'lead' ELSE 'customer' END, count(*), NULL FROM u WHERE k % 3 < 2 GROUP BY k % 3"""

QUERIES = {f.__name__: f for f in (match_classes, offering_match, order_before, deep_page, cursor_page, find_indexed, profile_choice, site_frames, site_phones, site_roles, feed_page, feed_counts, home)}
