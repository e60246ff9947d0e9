"""Queries on snapshots, alerts, rosters, contacts and upkeep: operators that keep the serving tables right."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import classify as K, contacts as P, gates as B, incremental as N, resolve as R, scoring as S, search as C, text as X, timeline as L
from ..sources import feeds as A
from . import scoring as scored
from .tables import AS_OF, as_of, orders, read

SQL: dict[str, str] = {}
_NOW = "2024-01-30"


def _now():
    return F.lit(_NOW).cast("date")


def latest_across(spark: SparkSession, d: str) -> DataFrame:
    """Orders of three tables by status, each only with customers whose newest order is in it."""
    parts = [orders(spark, d).filter(F.col("o_orderstatus") == s).select("o_custkey", "o_orderkey", F.lit(s).alias("held_in")) for s in "FOP"]
    kept = A.latest_across(parts, "o_custkey", "o_orderkey")
    return kept[0].union(kept[1]).union(kept[2])


SQL["latest_across"] = "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS held_in FROM orders WHERE o_orderstatus IN ('F','O','P') GROUP BY 1"


def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    registry = read(spark, d, "orders").select(F.col("o_orderpriority").alias("source_key"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("filename"))
    return C.latest_snapshot(registry)


SQL["latest_snapshot"] = "SELECT o_orderpriority AS source_key, max(o_orderkey) AS id, arg_max(o_custkey, o_orderkey) AS filename FROM orders GROUP BY 1"


def stall_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Event types whose latest value is no greater than the one a day before, and users that are silent for nine days."""
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    progress = e.select(F.concat("event_type", F.lit(":"), (F.col("user_id") % 5).cast("string")).alias("key"), "ts", "value")
    feeds = e.select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("key"), F.to_date("ts").alias("published"))
    return B.stall_alerts(progress, feeds, F.lit("2024-02-05").cast("date"), "key", "ts", "value")


SQL["stall_alerts"] = """WITH p AS (SELECT event_type || ':' || (user_id % 5) AS key, ts, value, floor(epoch(ts)) AS s FROM events),
l AS (SELECT key, max(ts) AS ts, arg_max(value, ts) AS value, max(s) AS s FROM p GROUP BY 1),
b AS (SELECT l.key, l.value, arg_max(p.value, p.s) AS before FROM l JOIN p ON p.key = l.key AND p.s <= l.s - 82800 GROUP BY ALL)
SELECT key, 'stalled' AS alert FROM b WHERE value <= before
UNION ALL SELECT 'user ' || user_id, 'old feed' FROM events GROUP BY user_id HAVING date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-05') > 9"""


def watch_alerts(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("date"), "event_type")
    out = C.watch_alerts(e, e.filter("user_id % 7 = 0").select("user_id"), e.filter("event_id % 5 = 0").select("event_id"), "user_id")
    return out.select("event_id", "user_id", F.col("date").cast("string").alias("date"), "event_type")


SQL["watch_alerts"] = "SELECT event_id, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, event_type FROM events WHERE user_id % 7 = 0 AND event_id % 5 <> 0 ORDER BY CAST(ts AS DATE) DESC, event_id LIMIT 6"


def officers_unmatched(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_orderstatus").alias("org"), F.col("o_custkey").cast("string").alias("name"), F.col("o_orderpriority").alias("title"))
    matched = o.filter("cast(name as int) % 3 = 0").select("org", "name").distinct()
    left = o.filter("cast(name as int) % 4 = 1").select("org", "name").distinct().withColumn("left_date", F.lit("2001-01-01").cast("date"))
    return L.officers_unmatched(o, matched, left, "org", "name").select("org", "name", "titles", F.col("left_date").cast("string").alias("left_date"), "former")


SQL["officers_unmatched"] = """SELECT o_orderstatus AS org, CAST(o_custkey AS VARCHAR) AS name, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) AS titles,
CASE WHEN o_custkey % 4 = 1 THEN '2001-01-01' END AS left_date, o_custkey % 4 = 1 AS former FROM orders WHERE o_custkey % 3 <> 0 GROUP BY o_orderstatus, o_custkey"""


def recent_moves(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("date"))
    return L.recent_moves(e, F.lit("2024-01-20").cast("date"), 10, 25).withColumn("date", F.col("date").cast("string"))


SQL["recent_moves"] = "SELECT event_id, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-01-20') BETWEEN 0 AND 10 ORDER BY CAST(ts AS DATE) DESC, event_id, user_id LIMIT 25"


def team_growth(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("headcount"), (F.count_if(F.col("c_acctbal") > 4000) - F.count_if(F.col("c_acctbal") < 500)).alias("net"))
    return c.withColumn("growth", L.team_growth(F.col("net"), F.col("headcount")))


SQL["team_growth"] = """WITH c AS (SELECT c_nationkey, count(*) AS headcount, count(*) FILTER (c_acctbal > 4000) - count(*) FILTER (c_acctbal < 500) AS net FROM customer GROUP BY 1)
SELECT *, CASE WHEN headcount - net > 0 THEN round(net::DOUBLE / (headcount - net), 4) END AS growth FROM c"""


def match_overlay(spark: SparkSession, d: str) -> DataFrame:
    return R.overlay(scored.name_match(spark, d), "s_suppkey")


SQL["match_overlay"] = f"SELECT DISTINCT s_suppkey FROM ({scored.SQL['name_match']}) WHERE status = 'auto'"


def controlling_parent(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    owners = p.select("p_brand", F.col("p_type").alias("owner"), F.col("p_size").alias("code"), (F.col("p_partkey") % 2 == 0).alias("control"))
    known = p.groupBy(F.col("p_type").alias("owner")).agg(F.count("*").alias("strength")).withColumn("parent", F.lower("owner"))
    return R.controlling_parent(owners, known, "p_brand", "owner")


SQL["controlling_parent"] = """WITH k AS (SELECT p_type AS owner, count(*) AS strength, lower(p_type) AS parent FROM part GROUP BY 1),
m AS (SELECT p_brand, parent, p_size AS code, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey % 2 = 0 DESC, strength DESC, parent) AS n FROM part JOIN k ON p_type = owner)
SELECT p_brand, parent, code FROM m WHERE n = 1"""


def org_domains(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("org"), F.concat("c_mktsegment", F.lit(".COM")).alias("domain"), F.when(F.col("c_acctbal") > 9000, 2).otherwise(1).alias("trust")).filter("org % 3 <> 0")
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("org"), F.concat(F.lit("site"), (F.col("s_suppkey") % 4).cast("string"), F.lit(".example")).alias("domain"))
    return R.org_domain(c, s, "org", "domain", "trust", ["building.com", "site0.example"])


SQL["org_domains"] = """WITH r AS (SELECT c_nationkey AS org, lower(c_mktsegment) || '.com' AS domain, CASE WHEN c_acctbal > 9000 THEN 2 ELSE 1 END AS rank FROM customer WHERE c_nationkey % 3 <> 0 UNION ALL SELECT s_nationkey, 'site' || (s_suppkey % 4) || '.example', -1 FROM supplier),
g AS (SELECT org, domain, rank, count(*) AS n FROM r WHERE domain NOT IN ('building.com', 'site0.example') GROUP BY ALL)
SELECT org, domain FROM (SELECT *, row_number() OVER (PARTITION BY org ORDER BY rank DESC, n DESC, domain) AS k FROM g) WHERE k = 1"""


def place_sets(spark: SparkSession, d: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, ("tx", "NY", "California", "Ca", ""))), (F.col("k") % 5 + 1).cast("int"))
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("org"), F.col("c_custkey").alias("k")).select("org", code.alias("state"))
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("org"), F.lit("ma").alias("state"))
    return R.place_set([c, s], "org", "state").withColumn("states", F.array_join("states", "|"))


SQL["place_sets"] = """WITH r AS (SELECT c_nationkey AS org, ['TX','NY','CALIFORNIA','CA',''][c_custkey % 5 + 1] AS state FROM customer UNION ALL SELECT s_nationkey, 'MA' FROM supplier)
SELECT org, string_agg(DISTINCT state, '|' ORDER BY state) AS states FROM r WHERE length(state) = 2 GROUP BY 1"""


def attach_phone(spark: SparkSession, d: str) -> DataFrame:
    seg = F.element_at(F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    people = read(spark, d, "customer").select(F.col("c_custkey").alias("person"), F.col("c_nationkey").alias("org"), F.col("c_mktsegment").alias("place"))
    offices = read(spark, d, "supplier").select(F.col("s_nationkey").alias("org"), seg.alias("place"), F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("phone"), (F.col("s_suppkey") % 3).alias("staff"))
    main = read(spark, d, "nation").filter("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("org"), F.lit("BUILDING").alias("place"), F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("phone"))
    return R.attach_phone(people, offices, main, "org", "place")


SQL["attach_phone"] = """WITH o AS (SELECT s_nationkey AS org, ['AUTOMOBILE','BUILDING','FURNITURE','MACHINERY','HOUSEHOLD'][s_suppkey % 5 + 1] AS place, arg_max('s' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0'), (s_suppkey % 3, s_suppkey)) AS phone, count(*) AS n FROM supplier GROUP BY ALL),
m AS (SELECT n_nationkey AS org, 'm' || n_nationkey AS line FROM nation WHERE n_nationkey % 4 <> 0)
SELECT c_custkey AS person, c_nationkey AS org, c_mktsegment AS place,
CASE WHEN c_mktsegment = 'BUILDING' AND line IS NOT NULL THEN line WHEN o.phone IS NOT NULL THEN o.phone ELSE line END AS phone,
CASE WHEN c_mktsegment = 'BUILDING' AND line IS NOT NULL THEN 60 WHEN o.phone IS NOT NULL THEN CASE WHEN n = 1 THEN 70 ELSE 60 END WHEN line IS NOT NULL THEN 55 END AS confidence
FROM customer LEFT JOIN o ON o.org = c_nationkey AND o.place = c_mktsegment LEFT JOIN m ON m.org = c_nationkey"""


def lead_lines(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    said = S.choose_text([(F.col("c_acctbal") > 8000, "large"), (F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") < 0), "owes"), (F.col("c_mktsegment") == "BUILDING", "builds")], "other")
    return c.groupBy(said.alias("line"), "c_mktsegment").agg(F.count("*").alias("n"))


SQL["lead_lines"] = "SELECT CASE WHEN c_acctbal > 8000 THEN 'large' WHEN c_custkey % 3 <> 0 AND c_acctbal < 0 THEN 'owes' WHEN c_mktsegment = 'BUILDING' THEN 'builds' ELSE 'other' END AS line, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL"


def icp_roles(spark: SparkSession, d: str) -> DataFrame:
    return K.icp_roles(read(spark, d, "part"), "p_name", [("a", "^(small|cold)", False), ("b", "bolt", False), ("a", "widget$", True), ("b", "e", True)], "p_partkey")


SQL["icp_roles"] = """WITH r AS (SELECT p_partkey, unnest([{'p': CASE WHEN regexp_matches(lower(p_name), '^(small|cold)') THEN 'a' END, 'm': false, 'i': 0}, {'p': CASE WHEN contains(lower(p_name), 'bolt') THEN 'b' END, 'm': false, 'i': 1},
{'p': CASE WHEN ends_with(lower(p_name), 'widget') THEN 'a' END, 'm': true, 'i': 2}, {'p': CASE WHEN contains(lower(p_name), 'e') THEN 'b' END, 'm': true, 'i': 3}]) AS x FROM part)
SELECT p_partkey, x.p AS product, bool_or(x.m) AS primary FROM r WHERE x.p IS NOT NULL GROUP BY ALL"""


def stale_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "lang")
    tagged = docs.filter("doc_id % 3 <> 0").select("doc_id", (F.col("doc_id") % 4).alias("version"))
    return X.stale_documents(docs, tagged, "doc_id", 2)


SQL["stale_documents"] = "SELECT doc_id, lang FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 < 2"


def source_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return X.source_counts(docs, "source", ("english", F.col("lang") == "en"), ("long", F.col("n_chars") > 2000))


SQL["source_counts"] = "SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS english, count(*) FILTER (n_chars > 2000) AS long FROM documents GROUP BY 1"


def consolidate_pages(spark: SparkSession, d: str) -> DataFrame:
    """The best status and price of each customer and priority, by the order's day."""
    o = read(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice")).alias("price"))
    return X.consolidate_pages(o, "o_custkey", "o_orderpriority", "o_orderkey", ["status", "price"])


SQL["consolidate_pages"] = "SELECT o_custkey, o_orderpriority, arg_max(o_orderstatus, o_orderkey) FILTER (o_orderkey % 3 <> 0) AS status, arg_max(o_totalprice, o_orderkey) FILTER (o_orderkey % 5 = 0) AS price FROM orders GROUP BY ALL"


def org_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The profile of each brand among its part names."""
    p = read(spark, d, "part").filter("p_partkey % 2 = 0").select(F.concat("p_brand", F.lit("/"), (F.col("p_partkey") % 40).cast("string")).alias("org"), F.col("p_name").alias("slug"))
    return X.org_profile(p, "org", "slug", F.col("slug").contains("gear"), F.col("slug").startswith("s"))


SQL["org_profiles"] = """WITH p AS (SELECT DISTINCT p_brand || '/' || (p_partkey % 40) AS org, p_name AS slug FROM part WHERE p_partkey % 2 = 0),
g AS (SELECT org, count(*) AS n, min(slug) AS p, count(*) FILTER (contains(slug, 'gear')) AS nn, min(slug) FILTER (contains(slug, 'gear')) AS pn, count(*) FILTER (starts_with(slug, 's')) AS nf, min(slug) FILTER (starts_with(slug, 's')) AS pf FROM p GROUP BY 1),
r AS (SELECT org, CASE WHEN n = 1 THEN p WHEN nn BETWEEN 1 AND 2 THEN pn WHEN nf = 1 THEN pf END AS profile FROM g) SELECT * FROM r WHERE profile IS NOT NULL"""


def _contacts(spark: SparkSession, d: str) -> DataFrame:
    """Contacts made from customers: an entity for each nation, some persons, mail addresses that a few share, phones and profiles."""
    k = F.col("c_custkey")
    c = read(spark, d, "customer")
    value = F.concat(F.col("kind"), (k % 400).cast("string"))
    return c.select(
        F.col("c_nationkey").alias("entity"), F.when(k % 3 != 0, F.concat(F.lit("p"), (k % 90).cast("string"))).alias("person"),
        F.element_at(F.array(*map(F.lit, ("email", "phone", "profile"))), (k % 7 % 3 + 1).cast("int")).alias("kind"), "c_custkey", "c_acctbal",
    ).select("entity", "person", "kind", value.alias("value"), (k % 100).alias("confidence"), (k % 11 == 0).alias("is_role"), k.alias("seen"),
             F.element_at(F.array(F.lit("valid"), F.lit("invalid"), F.lit(None).cast("string")), (k % 13 % 3 + 1).cast("int")).alias("verify_status"), F.when(k % 4 == 0, F.array(F.lit("guess"))).when(k % 4 == 1, F.array(F.lit("guess"), F.lit("site"))).otherwise(F.array(F.lit("site"))).alias("sources"))


_K = "ct AS (SELECT c_nationkey AS entity, CASE WHEN c_custkey % 3 <> 0 THEN 'p' || (c_custkey % 90) END AS person, ['email','phone','profile'][c_custkey % 7 % 3 + 1] AS kind, ['email','phone','profile'][c_custkey % 7 % 3 + 1] || (c_custkey % 400) AS value, c_custkey % 100 AS confidence, c_custkey % 11 = 0 AS is_role, c_custkey AS seen, ['valid','invalid',NULL][c_custkey % 13 % 3 + 1] AS verify_status, CASE c_custkey % 4 WHEN 0 THEN 'guess' WHEN 1 THEN 'guess|site' ELSE 'site' END AS sources FROM customer)"


def firm_copies(spark: SparkSession, d: str) -> DataFrame:
    return P.drop_firm_copies(_contacts(spark, d), F.col("seen") % 10 == 0).select("entity", "person", "kind", "value", "seen")


SQL["firm_copies"] = f"WITH {_K} SELECT entity, person, kind, value, seen FROM ct WHERE person IS NOT NULL OR seen % 10 = 0 OR NOT EXISTS (SELECT 1 FROM ct o WHERE o.person IS NOT NULL AND o.entity = ct.entity AND o.kind = ct.kind AND o.value = ct.value)"


def best_contacts(spark: SparkSession, d: str) -> DataFrame:
    return P.best_contacts(_contacts(spark, d))


SQL["best_contacts"] = f"""WITH {_K} SELECT entity, person, arg_max(value, (NOT is_role, confidence, -seen, value)) FILTER (kind = 'email') AS email, arg_max(value, (NOT is_role, confidence, -seen, value)) FILTER (kind = 'phone') AS phone,
arg_max(value, (NOT is_role, confidence, -seen, value)) FILTER (kind = 'profile') AS profile FROM ct WHERE person IS NOT NULL GROUP BY ALL"""


def reachability(spark: SparkSession, d: str) -> DataFrame:
    c = _contacts(spark, d)
    people = c.filter("person is not null").select("entity", "person").union(read(spark, d, "nation").select(F.col("n_nationkey"), F.lit("nobody")))
    return P.coverage(people, P.best_contacts(P.usable(c)))


SQL["reachability"] = f"""WITH {_K}, u AS (SELECT * FROM ct WHERE kind <> 'email' OR verify_status = 'valid' OR (sources <> 'guess' AND verify_status IS DISTINCT FROM 'invalid')),
b AS (SELECT entity, person, bool_or(kind = 'email') AS e, bool_or(kind = 'phone') AS p, bool_or(kind = 'profile') AS f FROM u WHERE person IS NOT NULL GROUP BY ALL),
w AS (SELECT DISTINCT entity, person FROM ct WHERE person IS NOT NULL UNION SELECT n_nationkey, 'nobody' FROM nation)
SELECT count(*) AS people, count(*) FILTER (e) AS email, count(*) FILTER (p) AS phone, count(*) FILTER (f) AS profile, count(*) FILTER (e OR p) AS reachable FROM w LEFT JOIN b USING (entity, person)"""


def contact_flags(spark: SparkSession, d: str) -> DataFrame:
    return P.contact_flags(_contacts(spark, d).withColumn("source", F.element_at("sources", 1)))


SQL["contact_flags"] = f"""WITH {_K} SELECT entity, count(DISTINCT value) FILTER (kind = 'email' AND person IS NOT NULL AND NOT is_role) AS personal, count(DISTINCT value) FILTER (kind = 'email' AND verify_status = 'valid') AS verified,
count(DISTINCT value) FILTER (kind = 'email' AND is_role) AS inbox, count(*) FILTER (kind = 'email' AND starts_with(sources, 'guess')) AS guess, count(DISTINCT value) FILTER (kind = 'phone' AND person IS NOT NULL) AS direct, bool_or(kind = 'phone') AS phone FROM ct GROUP BY 1"""


def contact_verdicts(spark: SparkSession, d: str) -> DataFrame:
    c = _contacts(spark, d)
    verdicts = c.filter("kind = 'email'").select("value").distinct().withColumn("n", F.regexp_extract("value", "([0-9]+)$", 1).cast("int")).filter("n % 2 = 0").select("value", F.when(F.col("n") % 3 == 0, "invalid").when(F.col("n") % 3 == 1, "valid").otherwise("unknown").alias("verdict"))
    return P.apply_verdicts(c, verdicts).select("entity", "value", "seen", "confidence", "verify_status")


SQL["contact_verdicts"] = f"""WITH {_K}, v AS (SELECT *, CASE WHEN kind = 'email' AND seen % 400 % 2 = 0 THEN ['invalid','valid','unknown'][seen % 400 % 3 + 1] END AS verdict FROM ct)
SELECT entity, value, seen, CASE verdict WHEN 'valid' THEN greatest(confidence, 95) WHEN 'invalid' THEN 0 ELSE confidence END AS confidence, coalesce(verdict, verify_status) AS verify_status FROM v"""


def contact_retire(spark: SparkSession, d: str) -> DataFrame:
    out = P.retire(_contacts(spark, d), "guess", 700)
    return out.select("seen", F.array_join("sources", "|").alias("sources"))


SQL["contact_retire"] = f"WITH {_K} SELECT seen, CASE WHEN seen < 700 AND starts_with(sources, 'guess') THEN replace(sources, 'guess|', '') ELSE sources END AS sources FROM ct WHERE NOT (seen < 700 AND sources = 'guess')"


def prunable(spark: SparkSession, d: str) -> DataFrame:
    """Orders as artefacts: those with lines, and those that were read and gave none."""
    a = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    derived = read(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    yields = a.select("o_orderkey", (F.col("o_orderkey") % 4).alias("n"))
    return N.prunable(a, derived, yields, "o_orderkey")


SQL["prunable"] = """WITH d AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 45)
SELECT o_orderkey, o_orderstatus, CASE WHEN k IS NOT NULL THEN 'derived' ELSE 'empty' END AS why FROM orders LEFT JOIN d ON k = o_orderkey WHERE k IS NOT NULL OR o_orderkey % 4 = 0"""


def people_queue(spark: SparkSession, d: str) -> DataFrame:
    """The first three customers of each nation by balance who weren't tried lately."""
    c = read(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    o = orders(spark, d)
    tried = o.select(F.col("o_custkey").alias("c_custkey"), F.col("odate").alias("tried_on"), F.col("o_orderstatus").alias("status"))
    out = N.search_queue(c, tried, as_of(), "c_nationkey", "c_custkey", [F.desc("c_acctbal"), F.asc("c_custkey")], 3, {"F": 40, "O": 5})
    return out.select("c_nationkey", "c_custkey", "place")


SQL["people_queue"] = f"""WITH h AS (SELECT DISTINCT o_custkey FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') < CASE o_orderstatus WHEN 'F' THEN 40 WHEN 'O' THEN 5 ELSE 0 END)
SELECT c_nationkey, c_custkey, place FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM h)) WHERE place <= 3"""

QUERIES = {
    f.__name__: f
    for f in (
        latest_across, latest_snapshot, stall_alerts, watch_alerts, officers_unmatched, recent_moves, team_growth, match_overlay, controlling_parent, org_domains, place_sets, attach_phone, lead_lines, icp_roles,
        stale_documents, source_counts, consolidate_pages, org_profiles, firm_copies, best_contacts, reachability, contact_flags, contact_verdicts, contact_retire, prunable, people_queue,
    )
}
