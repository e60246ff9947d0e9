"""Queries on list filters, roles, coverage, rosters and the rules around feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..core import frames as B
from ..operators import classify as C, contacts as P, firmtypes as T, gates as G, incremental as N, joins as J, scoring as K, search as S, signals as G_S, timeline as L
from ..sources import feeds as A
from .tables import AS_OF, as_of, lineitem, orders, read

SQL: dict[str, str] = {}


def _firms(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(
        "c_custkey", (k % 9 == 0).alias("is_exempt"), F.when(k % 4 == 0, "STATE").otherwise("SEC").alias("regulator"), F.col("c_name").alias("legal_name"), F.lower("c_mktsegment").alias("business_name"), F.lit(None).cast("string").alias("city"),
        F.col("c_nationkey").cast("string").alias("state"), F.col("c_acctbal").alias("raum"), F.when(k % 3 == 0, "customer").when(k % 3 == 1, "new").alias("status"), F.when(k % 5 == 0, "me").when(k % 5 == 1, "Ann Ray").alias("owner"), (k % 7).alias("hires_12m"),
    )


def _lists(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    o = orders(spark, d)
    key = F.col("o_custkey").alias("c_custkey")
    events = o.select(F.col("o_orderkey").alias("event_id"), key, F.col("odate").alias("date"), (F.col("o_orderkey") % 2 == 0).alias("suppressed"))
    actions = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("event_id"), F.lit("done").alias("state"))
    contacts = o.select(key, F.when(F.col("o_orderkey") % 3 == 0, "phone").when(F.col("o_orderkey") % 3 == 1, "email").otherwise("linkedin").alias("kind"), F.when(F.col("o_orderkey") % 4 > 0, "p").alias("person"), (F.col("o_orderkey") % 5 == 0).alias("is_role"), F.when(F.col("o_orderkey") % 6 == 1, "pattern").otherwise("web").alias("source"), F.when(F.col("o_orderkey") % 7 == 0, "valid").when(F.col("o_orderkey") % 7 == 1, "invalid").alias("verify_status"), F.when(F.col("o_orderkey") % 2 == 0, "direct").alias("label"))
    return {
        "signals": S.open_signals(events, actions, "c_custkey", "2001-01-01"),
        "contacts": contacts.filter("price > 200000"),
        "classes": o.filter("o_orderpriority = '1-URGENT'").select(key, F.lit("urgent").alias("category")),
        "scores": o.groupBy(key).agg(F.count("*").alias("n")).select("c_custkey", F.lit("a").alias("product"), F.when(F.col("n") > 8, "scored").otherwise("disqualified").alias("status")),
        "members": o.filter("o_orderstatus = 'P'").select(key, F.lit(7).alias("list_id")),
        "postings": o.select(key, (F.col("o_orderstatus") == "O").alias("active")),
    }


_C = """o AS (SELECT *, o_orderkey AS k, CAST(o_orderdate AS DATE) AS day FROM orders),
c AS (SELECT *, c_custkey AS k FROM customer),
sig AS (SELECT DISTINCT o_custkey AS id FROM o WHERE k % 2 = 1 AND k % 3 > 0 AND day >= DATE '2001-01-01'),
con AS (SELECT o_custkey AS id, CASE k % 3 WHEN 0 THEN 'phone' WHEN 1 THEN 'email' ELSE 'linkedin' END AS kind, k % 4 > 0 AS named, k % 5 = 0 AS is_role, k % 6 = 1 AS guessed, CASE k % 7 WHEN 0 THEN 'valid' WHEN 1 THEN 'invalid' END AS v, k % 2 = 0 AS direct FROM o WHERE o_totalprice > 200000),
sc AS (SELECT o_custkey AS id FROM o GROUP BY 1 HAVING count(*) > 8)"""


def firm_list(spark: SparkSession, d: str) -> DataFrame:
    t = _lists(spark, d)
    filters = S.firm_filters("c_custkey", t["scores"], t["members"], t["signals"], t["contacts"], t["classes"], "me")
    specs = {"a": {"register": "SEC", "size": (1000, 8000), "list": "a", "signal": "open"}, "b": {"register": "", "q": "build", "owner": "none", "reach": "email"}, "c": {"register": "all", "reach": "none", "hires": 3, "list": "none"}, "d": {"register": "ERA", "category": "urgent", "member_of": 7, "owner": "ray"}}
    out = None
    for name, spec in specs.items():
        part = S.search(_firms(spark, d), filters, spec)[0].select(F.lit(name).alias("search"), "c_custkey")
        out = part if out is None else out.union(part)
    return out


SQL["firm_list"] = f"""WITH {_C}
SELECT 'a' AS search, c_custkey FROM c WHERE k % 9 > 0 AND k % 4 > 0 AND c_acctbal >= 1000 AND c_acctbal < 8000 AND k IN (SELECT id FROM sc) AND k IN (SELECT id FROM sig)
UNION ALL SELECT 'b', c_custkey FROM c WHERE k % 9 > 0 AND (lower(c_name) LIKE '%build%' OR lower(c_mktsegment) LIKE '%build%') AND k % 5 > 1 AND k IN (SELECT id FROM con WHERE kind = 'email' AND named AND NOT is_role AND NOT guessed AND coalesce(v, '') <> 'invalid')
UNION ALL SELECT 'c', c_custkey FROM c WHERE k % 7 >= 3 AND k NOT IN (SELECT id FROM con WHERE kind = 'email' AND named AND NOT is_role) AND k NOT IN (SELECT id FROM sc)
UNION ALL SELECT 'd', c_custkey FROM c WHERE k % 9 = 0 AND k IN (SELECT o_custkey FROM o WHERE o_orderpriority = '1-URGENT') AND k IN (SELECT o_custkey FROM o WHERE o_orderstatus = 'P') AND k % 5 = 1"""


def product_list(spark: SparkSession, d: str) -> DataFrame:
    t = _lists(spark, d)
    rows = _firms(spark, d).withColumns({"product": F.lit("a"), "state_of_score": F.lit("scored"), "coverage": (F.col("c_custkey") % 101).cast("double")})
    filters = S.list_filters("c_custkey", t["signals"], t["contacts"], t["classes"], t["postings"], "me")
    specs = {"a": {"product": "a", "coverage": "most", "hiring": True, "status": "open"}, "b": {"coverage": "gaps", "reach": "phone", "size": 500}, "c": {"coverage": "full", "signal": True, "owner": "me"}, "d": {"reach": "verified", "status": "customer"}, "e": {"reach": "linkedin", "category": "urgent", "state": "7"}}
    out = None
    for name, spec in specs.items():
        part = S.search(rows, filters, spec)[0].select(F.lit(name).alias("search"), "c_custkey")
        out = part if out is None else out.union(part)
    return out


SQL["product_list"] = f"""WITH {_C}
SELECT 'a' AS search, c_custkey FROM c WHERE k % 101 >= 70 AND k IN (SELECT o_custkey FROM o WHERE o_orderstatus = 'O') AND k % 3 <> 0
UNION ALL SELECT 'b', c_custkey FROM c WHERE k % 101 < 70 AND c_acctbal >= 500 AND k IN (SELECT id FROM con WHERE kind = 'phone' AND named AND direct)
UNION ALL SELECT 'c', c_custkey FROM c WHERE k % 101 >= 90 AND k IN (SELECT id FROM sig) AND k % 5 = 0
UNION ALL SELECT 'd', c_custkey FROM c WHERE k % 3 = 0 AND k IN (SELECT id FROM con WHERE kind = 'email' AND v = 'valid')
UNION ALL SELECT 'e', c_custkey FROM c WHERE c_nationkey = 7 AND k IN (SELECT id FROM con WHERE kind = 'linkedin' AND named) AND k IN (SELECT o_custkey FROM o WHERE o_orderpriority = '1-URGENT')"""


def people_list(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    first = orders(spark, d).groupBy("o_custkey").agg(F.min("odate").alias("start_date"))
    people = read(spark, d, "customer").join(first, k == F.col("o_custkey"), "left").select(
        "c_custkey", F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("firm"), F.col("c_nationkey").cast("string").alias("state"), F.when(k % 2 == 0, k).alias("priority"), (k % 3 == 0).alias("is_leader"), (k % 4 == 0).alias("is_officer"), "start_date", (k % 5 == 0).alias("cfp"), (k % 6 == 0).alias("cfa"), (k % 7 == 0).alias("has_disclosure"),
        F.col("c_acctbal").alias("raum"), F.col("c_mktsegment").alias("category"), F.lit("roster").alias("src"), F.array(F.concat(F.lit("t"), (k % 3).cast("string"))).alias("desig"), F.concat(F.initcap("c_mktsegment"), F.lit(" Officer")).alias("title"),
    )
    filters = S.people_filters("c_custkey", _lists(spark, d)["scores"], AS_OF, C.title_matches)
    specs = {"a": {"q": "furn", "on": "a", "credential": "cfp"}, "b": {"joined": 1500, "role": "leader"}, "c": {"title": "build off, mach off", "designations": ["t1", "t2"], "size": 5000}, "d": {"disclosure": True, "on": "any", "role": "officer"}, "e": {"category": "BUILDING", "state": "3", "src": "roster"}}
    out = None
    for name, spec in specs.items():
        part = S.search(people, filters, spec)[0].select(F.lit(name).alias("search"), "c_custkey")
        out = part if out is None else out.union(part)
    return out


SQL["people_list"] = f"""WITH {_C}, f AS (SELECT o_custkey, min(day) AS s FROM o GROUP BY 1), p AS (SELECT c.*, s FROM c LEFT JOIN f ON o_custkey = c_custkey)
SELECT 'a' AS search, c_custkey FROM p WHERE lower(c_mktsegment) LIKE '%furn%' AND k IN (SELECT id FROM sc) AND k % 5 = 0
UNION ALL SELECT 'b', c_custkey FROM p WHERE s >= DATE '{AS_OF}' - INTERVAL 1500 DAY AND k % 3 = 0
UNION ALL SELECT 'c', c_custkey FROM p WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND k % 3 > 0 AND c_acctbal >= 5000
UNION ALL SELECT 'd', c_custkey FROM p WHERE k % 7 = 0 AND k % 2 = 0 AND k % 4 = 0
UNION ALL SELECT 'e', c_custkey FROM p WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3"""


_ROLES = (("first half", "^[a-m]"), ("s words", "^s"))


def title_roles(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_name")
    stored = spark.createDataFrame([("blue", "stored"), ("Blue ", "zz")], "title string, role string")
    words = p.select(F.explode(F.split("p_name", " ")).alias("title"))
    return C.role_of(words, "title", stored, _ROLES).groupBy("title", "role").agg(F.count("*").alias("n"))


SQL["title_roles"] = """WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS title FROM part)
SELECT title, CASE WHEN lower(title) = 'blue' THEN 'stored' WHEN regexp_matches(lower(title), '^[a-m]') THEN 'first half' WHEN starts_with(lower(title), 's') THEN 's words' ELSE 'other' END AS role, count(*) AS n FROM w GROUP BY ALL"""


def priority_mix(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).groupBy("o_custkey").agg(*(F.sum(F.when(F.col("o_orderpriority") == p, F.col("price"))).cast("double").alias(c) for c, p in (("urgent", "1-URGENT"), ("high", "2-HIGH"))), *(F.count_if(F.col("o_orderpriority") == p).alias(c) for c, p in (("n_low", "5-LOW"), ("n_mid", "3-MEDIUM"))))
    m = o.withColumn("mix", C.mix(["urgent", "high"], ["n_low", "n_mid"]))
    share = lambda k: F.col("mix.shares")[k]
    return m.select("o_custkey", "mix.basis", share("urgent").alias("urgent"), share("high").alias("high"), share("n_low").alias("n_low"))


SQL["priority_mix"] = """WITH s AS (SELECT o_custkey, coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderpriority = '1-URGENT') AS DOUBLE), 0) AS u, coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderpriority = '2-HIGH') AS DOUBLE), 0) AS h, count(*) FILTER (o_orderpriority = '5-LOW') AS l, count(*) FILTER (o_orderpriority = '3-MEDIUM') AS m FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN u + h > 0 THEN 'amount' WHEN l + m > 0 THEN 'count' END AS basis, CASE WHEN u + h > 0 THEN round(u / (u + h), 6) END AS urgent, CASE WHEN u + h > 0 THEN round(h / (u + h), 6) END AS high, CASE WHEN u + h = 0 AND l + m > 0 THEN round(l / (l + m), 6) END AS n_low FROM s"""


def type_penalties(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    removed, penalty = K.type_policy(F.col("c_mktsegment"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey") % 100), F.col("c_custkey") % 10 == 0, ["BUILDING", "MACHINERY"], 60, 15)
    return c.select("c_mktsegment", removed.alias("removed"), penalty.alias("penalty")).groupBy("c_mktsegment", "removed", "penalty").agg(F.count("*").alias("n"))


SQL["type_penalties"] = """WITH c AS (SELECT c_mktsegment, c_mktsegment IN ('BUILDING', 'MACHINERY') AS l, (c_custkey % 4 > 0 AND c_custkey % 100 >= 60) OR c_custkey % 10 = 0 AS sure FROM customer)
SELECT c_mktsegment, l AND sure AS removed, CASE WHEN l AND NOT sure THEN 15.0::DOUBLE ELSE 0 END AS penalty, count(*) AS n FROM c GROUP BY ALL"""


def failure_rates(spark: SparkSession, d: str) -> DataFrame:
    return G.failure_rate(read(spark, d, "lineitem"), "l_linenumber", F.col("l_returnflag") == "R", 0.33)


SQL["failure_rates"] = "SELECT l_linenumber, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END), 6) AS rate, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) > 0.33 AS flagged FROM lineitem GROUP BY 1"


def unmapped_names(spark: SparkSession, d: str) -> DataFrame:
    return G.coverage_review(read(spark, d, "part"), "p_brand", F.col("p_type").startswith("S"), 20)


SQL["unmapped_names"] = "SELECT p_brand, count(*) AS n FROM part WHERE NOT starts_with(p_type, 'S') GROUP BY 1 HAVING count(*) >= 20"


def without_rows(spark: SparkSession, d: str) -> DataFrame:
    return G.require_rows(read(spark, d, "customer").select("c_custkey"), orders(spark, d).filter("price > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


SQL["without_rows"] = "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) > 400000)"


def resolution_rate(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).withColumn("filing", F.col("o_orderkey") % 500)
    walk = A.read_crosswalk(o.filter("o_orderkey % 3 = 0").select("filing", F.col("o_custkey").alias("entity"), "odate"), "filing", "entity", ["odate"])
    return A.resolution_rate(A.resolve_with(o.select("filing"), walk, "filing"), "entity")


SQL["resolution_rate"] = "WITH o AS (SELECT o_orderkey % 500 AS f FROM orders), w AS (SELECT DISTINCT o_orderkey % 500 AS f FROM orders WHERE o_orderkey % 3 = 0) SELECT count(*) AS n, count(w.f) AS resolved, round(count(w.f) / count(*), 6) AS rate FROM o LEFT JOIN w USING (f)"


def active_points(spark: SparkSession, d: str) -> DataFrame:
    spans = orders(spark, d).groupBy("o_custkey").agg(F.min("odate").alias("s"), F.max("odate").alias("e"))
    open_ = spans.withColumn("e", F.when(F.col("e") < "2001-01-01", F.col("e")))
    return J.active_at(open_, ["1996-12-31", "1998-12-31", "2000-12-31", "2001-12-31"], "s", "e", "day").groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


SQL["active_points"] = """WITH s AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS e FROM orders GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, count(*) AS n FROM s JOIN (SELECT unnest([DATE '1996-12-31', DATE '1998-12-31', DATE '2000-12-31', DATE '2001-12-31']) AS day) ON s <= day AND (e >= DATE '2001-01-01' OR e >= day) GROUP BY 1"""


def states_active(spark: SparkSession, d: str) -> DataFrame:
    rows = lineitem(spark, d).select("l_suppkey", "l_linenumber", "l_returnflag", "sdate")
    return L.new_states(rows, "l_suppkey", "l_linenumber", "l_returnflag", "sdate", F.lit("2000-06-30").cast("date"), ["R"], 30)


SQL["states_active"] = "SELECT l_suppkey, count(DISTINCT l_linenumber) AS states, count(DISTINCT CASE WHEN date_diff('day', CAST(l_shipdate AS DATE), DATE '2000-06-30') BETWEEN 0 AND 30 THEN l_linenumber END) AS new_states FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1"


def open_postings(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_brand").alias("entity"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 25, "board").otherwise("site").alias("source"), F.when(F.col("p_size") > 25, "b").otherwise("a").alias("function"))
    out = L.open_postings(p, "entity", "title", "source", "function", ["site", "board"])
    return out.select("entity", "postings", F.col("by_function")["a"].alias("a"), F.col("by_function")["b"].alias("b"))


SQL["open_postings"] = """WITH t AS (SELECT p_brand AS entity, p_name, min(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS f FROM part GROUP BY ALL)
SELECT entity, count(*) AS postings, nullif(count(*) FILTER (f = 0), 0) AS a, nullif(count(*) FILTER (f = 1), 0) AS b FROM t GROUP BY 1"""


def current_roster(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    spans = orders(spark, d).groupBy("o_custkey").agg(F.min("odate").alias("s"), F.max("odate").alias("e")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    emp = spans.select(F.col("c_nationkey").alias("org"), F.col("o_custkey").alias("person"), "s", F.when(F.col("e") < "2001-03-01", F.col("e")).alias("e"))
    officers = c.filter("c_custkey % 10 = 0").select(F.col("c_nationkey").alias("org"), F.col("c_custkey").alias("person"), F.col("c_mktsegment").alias("title"))
    prior = c.filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("person"), F.col("c_mktsegment").alias("prior_org"))
    return L.roster(emp, officers, prior, as_of(), "org", "person", "s", "e").select("org", "person", "title", "prior_org", "tenure_years", F.col("place").cast("long").alias("place"))


SQL["current_roster"] = f"""WITH s AS (SELECT c_nationkey AS org, o_custkey AS person, any_value(c_mktsegment) AS m, CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS e FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
n AS (SELECT *, CASE WHEN person % 10 = 0 THEN m END AS title, CASE WHEN person % 4 = 0 THEN m END AS prior_org FROM s WHERE s <= DATE '{AS_OF}' AND e >= DATE '2001-03-01')
SELECT org, person, title, prior_org, round(date_diff('day', s, DATE '{AS_OF}') / 365.25, 2) AS tenure_years, row_number() OVER (PARTITION BY org ORDER BY title IS NULL, s, person) AS place FROM n"""


def contact_coverage(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    people = o.select((F.col("o_custkey") % 100).alias("entity"), F.col("o_custkey").alias("person"))
    rows = o.select((F.col("o_custkey") % 100).alias("entity"), F.col("o_custkey").alias("person"), F.when(F.col("o_orderkey") % 5 == 0, "email").when(F.col("o_orderkey") % 5 == 1, "phone").alias("kind"), F.col("o_orderkey").cast("string").alias("value"), (F.col("o_orderkey") % 97).alias("confidence"), F.col("o_orderkey").alias("seen"), F.lit(False).alias("is_role")).filter("kind is not null and person % 3 > 0")
    return P.coverage(people, P.best_contacts(rows))


SQL["contact_coverage"] = """WITH p AS (SELECT o_custkey, bool_or(o_orderkey % 5 = 0 AND o_custkey % 3 > 0) AS e, bool_or(o_orderkey % 5 = 1 AND o_custkey % 3 > 0) AS f FROM orders GROUP BY 1)
SELECT count(*) AS people, count(*) FILTER (e) AS email, count(*) FILTER (f) AS phone, CAST(0 AS BIGINT) AS profile, count(*) FILTER (e OR f) AS reachable FROM p"""


def due_dates(spark: SparkSession, d: str) -> DataFrame:
    out = N.due_order(orders(spark, d).select("o_orderkey", "odate", F.col("price").cast("double").alias("price")), "odate", "price", [50_000, 150_000, 300_000], 7)
    return out.select("o_orderkey", F.col("due_on").cast("string").alias("due_on"))


SQL["due_dates"] = """SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) + to_days(CAST(7 * ((CASE WHEN o_totalprice < 50000 THEN 1 ELSE 0 END) + (CASE WHEN o_totalprice < 150000 THEN 1 ELSE 0 END) + (CASE WHEN o_totalprice < 300000 THEN 1 ELSE 0 END)) AS INT)) AS DATE) AS VARCHAR) AS due_on FROM orders"""


def row_sums(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("a"), F.when(F.col("p_size") < 40, F.col("p_retailprice")).alias("b"))
    ratio = B.safe_ratio(F.col("a"), F.when(F.col("p_partkey") % 2 == 0, F.lit(0.0)).otherwise(F.lit(2.0)))
    return p.select("p_partkey", F.round(B.sum_nonnull("a", "b"), 6).alias("total"), ratio.alias("ratio"))


SQL["row_sums"] = "SELECT p_partkey, CASE WHEN p_size > 10 OR p_size < 40 THEN round(CASE WHEN p_size > 10 THEN p_size::DOUBLE ELSE 0 END + CASE WHEN p_size < 40 THEN p_retailprice ELSE 0 END, 6) END AS total, CASE WHEN p_size > 10 AND p_partkey % 2 = 1 THEN p_size / 2.0::DOUBLE END AS ratio FROM part"


def first_tables(spark: SparkSession, d: str) -> DataFrame:
    """Customers of three tables by precedence."""
    c = read(spark, d, "customer").select("c_custkey")
    return A.union_with_precedence([c.filter(f"c_custkey % {m} = 0").withColumn("origin", F.lit(name)) for m, name in ((5, "fives"), (3, "threes"), (1, "all"))], "c_custkey")


SQL["first_tables"] = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'fives' WHEN c_custkey % 3 = 0 THEN 'threes' ELSE 'all' END AS origin FROM customer"


def suppressed_by_rule(spark: SparkSession, d: str) -> DataFrame:
    e = orders(spark, d).select(F.col("odate").alias("date"), F.when(F.col("o_orderstatus") == "F", "filled").when(F.col("price") < 50_000, "small").alias("suppressed_by"))
    return G_S.suppressed_by_rule(e)


SQL["suppressed_by_rule"] = "SELECT CAST(year(o_orderdate) AS INT) AS year, CASE WHEN o_orderstatus = 'F' THEN 'filled' ELSE 'small' END AS rule, count(*) AS n FROM orders WHERE o_orderstatus = 'F' OR CAST(o_totalprice AS DECIMAL(18,2)) < 50000 GROUP BY ALL"


def _moves(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("person"), F.col("c_nationkey").alias("org"))
    o = orders(spark, d).select(F.col("o_custkey").alias("person"), F.col("odate").alias("date"), F.when(F.col("o_orderpriority") == "1-URGENT", "left").otherwise("joined").alias("kind"))
    return o.join(c, "person")


def moves_by_year(spark: SparkSession, d: str) -> DataFrame:
    return L.moves_by_year(_moves(spark, d), range(1996, 2001), "org")


SQL["moves_by_year"] = "SELECT c_nationkey AS org, CAST(year(o_orderdate) AS INT) AS year, count(DISTINCT CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END) AS joined, count(DISTINCT CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END) AS \"left\" FROM orders JOIN customer ON c_custkey = o_custkey WHERE year(o_orderdate) BETWEEN 1996 AND 2000 GROUP BY ALL"


def people_flags(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    k = F.col("c_custkey")
    people = c.select(k.alias("person"), F.when(k % 3 == 0, F.array(F.lit("CFP"), F.lit("x"))).when(k % 3 == 1, F.array(F.lit("cfa"))).otherwise(F.array().cast("array<string>")).alias("designations"), (k % 4 == 0).alias("dual"), (k % 5 == 0).alias("has_disclosure"))
    emp = c.select(F.col("c_nationkey").alias("org"), k.alias("person"), F.lit("1990-01-01").cast("date").alias("start_date"), F.when(k % 2 == 0, F.lit("1999-01-01").cast("date")).alias("end_date"))
    return L.people_flags(emp, people, _moves(spark, d), as_of())


SQL["people_flags"] = f"""WITH s AS (SELECT c_nationkey AS org, count(*) FILTER (c_custkey % 3 = 0) AS cfp, count(*) FILTER (c_custkey % 3 = 1) AS cfa, count(*) FILTER (c_custkey % 4 = 0) AS dual, count(*) FILTER (c_custkey % 5 = 0) AS disclosure FROM customer WHERE c_custkey % 2 = 1 GROUP BY 1),
m AS (SELECT c_nationkey AS org, count(DISTINCT CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END) AS h, count(DISTINCT CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END) AS l FROM orders JOIN customer ON c_custkey = o_custkey WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') BETWEEN 365 AND 729 GROUP BY 1)
SELECT coalesce(s.org, m.org) AS org, coalesce(cfp, 0) AS cfp, coalesce(cfa, 0) AS cfa, coalesce(dual, 0) AS dual, coalesce(disclosure, 0) AS disclosure, coalesce(h, 0) AS hires_prior, coalesce(l, 0) AS departures_prior FROM s FULL JOIN m ON s.org = m.org"""


def firm_types(spark: SparkSession, d: str) -> DataFrame:
    """Customers as firms: shares of clients from their orders' priorities, answers and parents from their key."""
    o = orders(spark, d)
    part = lambda p: F.round(F.count_if(F.col("o_orderpriority") == p) / F.count("*"), 6)
    mix = o.groupBy(F.col("o_custkey").alias("_k")).agg(part("1-URGENT").alias("share_pooled"), part("2-HIGH").alias("share_funds"), part("3-MEDIUM").alias("share_institutions"), F.round(F.count_if(F.col("o_orderpriority") >= "4") / F.count("*"), 6).alias("share_individuals"), F.count("*").cast("double").alias("clients_total"))
    k = F.col("c_custkey")
    c = read(spark, d, "customer").select("c_custkey", (k % 17 == 0).alias("is_exempt"), F.when(k % 13 == 0, "robo").alias("known_category"), F.when(k % 13 == 0, 97).alias("known_confidence"), F.when(k % 10 == 0, "insurance").alias("parent_category"), F.when(k % 20 == 0, "E").otherwise("D").alias("parent_code"), F.when(k % 3 == 0, "Y").otherwise("N").alias("fund_answer"), F.create_map(F.lit("is_bank"), k % 19 == 0, F.lit("planning"), k % 2 == 0, F.lit("related_broker_dealer"), k % 7 == 0).alias("answers"))
    rows = c.join(mix, k == F.col("_k"), "left").drop("_k")
    missing = {n: t for n, t in T.COLUMNS.items() if n not in rows.columns}
    out = T.firm_type(rows.withColumns({n: F.lit(None).cast(t) for n, t in missing.items()}))
    return out.select("c_custkey", "category", "category_confidence", F.array_join("type_signals", "|").alias("signals"))


SQL["firm_types"] = """WITH m AS (SELECT o_custkey, round(count(*) FILTER (o_orderpriority = '1-URGENT') / count(*), 6) AS p, round(count(*) FILTER (o_orderpriority = '2-HIGH') / count(*), 6) AS f, round(count(*) FILTER (o_orderpriority = '3-MEDIUM') / count(*), 6) AS t, round(count(*) FILTER (o_orderpriority >= '4') / count(*), 6) AS i FROM orders GROUP BY 1),
x AS (SELECT c_custkey AS k, i, coalesce(p, 0) AS p, coalesce(f, 0) AS f, coalesce(t, 0) AS t, coalesce(i, 0) AS ii FROM customer LEFT JOIN m ON o_custkey = c_custkey),
b AS (SELECT *, CASE WHEN i < 0.5 AND p >= 0.5 THEN CASE WHEN k % 3 > 0 THEN 'asset_manager:75' ELSE 'private_fund:70' END WHEN i < 0.5 AND f >= 0.3 AND i < 0.35 THEN CASE WHEN f >= 0.5 THEN 'asset_manager:90' ELSE 'asset_manager:80' END WHEN i < 0.35 AND t >= 0.5 THEN 'asset_manager:75'
 WHEN i < 0.35 AND p + f + t >= 0.5 THEN CASE WHEN p = greatest(p, f, t) AND k % 3 = 0 THEN 'private_fund:60' ELSE 'asset_manager:60' END END AS biz FROM x),
v AS (SELECT *, CASE WHEN k % 17 = 0 THEN 'era:99' WHEN k % 13 = 0 AND biz IS NOT NULL AND i < 0.1 THEN biz WHEN k % 13 = 0 THEN 'robo:97' WHEN biz IS NOT NULL THEN biz WHEN k % 19 = 0 THEN 'bank_trust:92' WHEN k % 10 = 0 AND (i IS NULL OR i >= 0.35) THEN CASE WHEN k % 20 = 0 THEN 'insurance:85' ELSE 'insurance:75' END
 WHEN i IS NULL THEN CASE WHEN k % 2 = 0 THEN 'independent_ria:55' WHEN k % 3 = 0 THEN 'private_fund:55' ELSE 'unknown:10' END WHEN i < 0.35 THEN CASE WHEN k % 3 = 0 THEN 'private_fund:55' WHEN k % 2 = 0 THEN 'independent_ria:40' ELSE 'asset_manager:50' END
 WHEN k % 7 = 0 THEN 'hybrid_ria:65' WHEN i >= 0.7 THEN 'independent_ria:90' WHEN i >= 0.5 THEN 'independent_ria:80' ELSE 'independent_ria:60' END AS v FROM b)
SELECT k AS c_custkey, split_part(v, ':', 1) AS category, CAST(split_part(v, ':', 2) AS INT) AS category_confidence, concat_ws('|', CASE WHEN i IS NOT NULL AND t >= 0.25 THEN 'institutional' END, CASE WHEN i IS NOT NULL AND f > 0.05 THEN 'registered_funds' END, CASE WHEN k % 2 = 0 THEN 'planning' END, CASE WHEN k % 7 = 0 THEN 'affiliated_bd' END, CASE WHEN k % 3 = 0 THEN 'private_funds' END, CASE WHEN k % 10 = 0 THEN 'in_group' END) AS signals FROM v"""


QUERIES = {f.__name__: f for f in (firm_list, product_list, people_list, title_roles, priority_mix, type_penalties, failure_rates, unmapped_names, without_rows, resolution_rate, active_points, states_active, open_postings, current_roster, contact_coverage, due_dates, row_sums, first_tables, suppressed_by_rule, moves_by_year, people_flags, firm_types)}
