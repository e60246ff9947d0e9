"""Feeds, archives and filings as typed tables: nested XML, CSV with crosswalks, index and holdings texts, snapshots, publishing."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..core.frames import first_per_key, latest_per_key
from ..core.scratch import Scratch
from ..functions.names import host, org_key, parse_date, pick_first_matching

#: Hosts of social pages. Fixed values.
SOCIAL = r"(linkedin|facebook|twitter|x|instagram|youtube)\.com"
#: The schema of a firm record: attributes come as _Name. Only what is read is listed.
FIRM_SCHEMA = (
    "Info struct<_FirmCrdNb:string,_LegalNm:string,_BusNm:string>, MainAddr struct<_City:string,_State:string,_PhNb:string>, Rgstn array<struct<_FirmType:string,_St:string,_Dt:string>>, "
    "StateRgstn struct<Rgltrs:struct<Rgltr:array<struct<_Cd:string,_St:string,_Dt:string>>>>, NoticeFiled struct<States:array<struct<_RgltrCd:string,_St:string,_Dt:string>>>, Filing array<struct<_Dt:string>>, "
    "FormInfo struct<Part1A:struct<Item1:struct<WebAddrs:struct<WebAddr:array<string>>,_Q1F5:string>,Item5A:struct<_TtlEmp:string>,Item5B:struct<_Q5B1:string>,Item5F:struct<_Q5F2C:string>,"
    + "Item5D:struct<"
    + ",".join(f"_Q5D{c}1:string" for c in "ABCDEFGHIJKLMN")
    + ">,Item6A:map<string,string>>>"
)
#: The schema of an individual's record.
INDIVIDUAL_SCHEMA = (
    "Info struct<_indvlPK:string,_firstNm:string,_midNm:string,_lastNm:string,_sufNm:string,_actvAGReg:string>, OthrNms struct<OthrNm:array<struct<_firstNm:string,_lastNm:string>>>, "
    "CrntEmps struct<CrntEmp:array<struct<_orgPK:string,_orgNm:string,_city:string,_state:string,CrntRgstns:struct<CrntRgstn:array<struct<_stDt:string>>>>>>, "
    "PrevRgstns struct<PrevRgstn:array<struct<_orgPK:string,_orgNm:string,_regBeginDt:string,_regEndDt:string>>>, EmpHss struct<EmpHs:array<struct<_orgNm:string,_fromDt:string,_toDt:string,_city:string,_state:string>>>, "
    "Dsgntns struct<Dsgntn:array<struct<_dsgntnNm:string>>>, DRPs struct<DRP:array<map<string,string>>>"
)



def read_xml(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    """Records of a tag with an explicit schema."""
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def read_firm_feed(spark: SparkSession, path: str, regulator: str, snapshot_id: int) -> DataFrame:
    """Firm rows of a feed: the first website that isn't a social page, clients summed over 14 kinds (0 is null), exempt flag, registration date (the earliest state approval if there is no other)."""
    raw = read_xml(spark, path, "Firm", FIRM_SCHEMA)
    form = "FormInfo.Part1A"
    number = lambda c: F.col(c).try_cast("double").cast("long")
    clients = sum((F.coalesce(number(f"{form}.Item5D._Q5D{c}1"), F.lit(0)) for c in "ABCDEFGHIJKLMN"), F.lit(0))
    approvals = F.array_min(F.transform(F.filter("StateRgstn.Rgltrs.Rgltr", lambda r: F.lower(r["_St"]).startswith("approved")), lambda r: parse_date(r["_Dt"])))
    web = pick_first_matching(F.coalesce(f"{form}.Item1.WebAddrs.WebAddr", F.array().cast("array<string>")), SOCIAL)
    return raw.select(
        F.lit(snapshot_id).cast("long").alias("snapshot_id"),
        F.col("Info._FirmCrdNb").alias("entity_id"),
        F.col("Info._LegalNm").alias("legal_name"),
        F.col("Info._BusNm").alias("business_name"),
        F.coalesce(F.exists("Rgstn", lambda r: F.upper(r["_FirmType"]) == "ERA"), F.lit(False)).alias("is_exempt"),
        F.col("MainAddr._State").alias("state"),
        F.col("MainAddr._City").alias("city"),
        web.alias("website"),
        F.col("MainAddr._PhNb").alias("phone"),
        F.lit(regulator).alias("regulator"),
        F.array_max(F.transform("Filing", lambda f: parse_date(f["_Dt"]))).alias("filing_date"),
        F.coalesce(F.array_min(F.transform("Rgstn", lambda r: parse_date(r["_Dt"]))), approvals).alias("registered_date"),
        number(f"{form}.Item5A._TtlEmp").alias("total_employees"),
        number(f"{form}.Item5B._Q5B1").alias("rep_count"),
        number(f"{form}.Item5F._Q5F2C").alias("assets"),
        F.nullif(clients, F.lit(0)).alias("clients_total"),
    )


def feed_states(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id, state, kind, status, date): state registrations and notice filings, the last of each (entity, state, kind)."""
    raw = read_xml(spark, path, "Firm", FIRM_SCHEMA)
    part = lambda arr, code, kind: raw.select(F.col("Info._FirmCrdNb").alias("entity_id"), F.explode(arr).alias("r")).select("entity_id", F.col(f"r.{code}").alias("state"), F.lit(kind).alias("kind"), F.col("r._St").alias("status"), parse_date(F.col("r._Dt")).alias("date"))
    rows = part("StateRgstn.Rgltrs.Rgltr", "_Cd", "registration").unionByName(part("NoticeFiled.States", "_RgltrCd", "notice"))
    return latest_per_key(rows, ["entity_id", "state", "kind"], ["date", "status"])


def feed_social(spark: SparkSession, path: str, archive: DataFrame) -> DataFrame:
    """(entity_id, platform, url, source): social pages of the feed, and of the archive (entity_id, url) where the feed has none for the platform."""
    raw = read_xml(spark, path, "Firm", FIRM_SCHEMA)
    feed = raw.select(F.col("Info._FirmCrdNb").alias("entity_id"), F.explode("FormInfo.Part1A.Item1.WebAddrs.WebAddr").alias("url"), F.lit("feed").alias("source"))
    rows = feed.unionByName(archive.select("entity_id", "url", F.lit("archive").alias("source"))).withColumn("platform", F.nullif(F.regexp_extract(host(F.col("url")), SOCIAL, 1), F.lit("")))
    canonical = F.regexp_replace(F.regexp_replace(F.lower("url"), "^https?://(www\\.)?", ""), "[/?#]+$", "")
    shaped = rows.filter(F.col("platform").isNotNull()).select("entity_id", "platform", canonical.alias("url"), "source")
    return first_per_key(shaped.distinct(), ["entity_id", "platform"], [F.desc("source"), F.asc("url")])


def feed_answers(raw: DataFrame, items: Sequence[str], key: str, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """(key, answers): one map of all attributes of some items, empties left out."""
    parts = [F.from_json(F.to_json(F.col(i)), "map<string,string>") for i in items]
    whole = F.map_concat(*(F.coalesce(p, F.create_map().cast("map<string,string>")) for p in parts), *([F.map_from_arrays(F.array(*map(F.lit, extra)), F.array(*(c.cast("string") for c in extra.values())))] if extra else []))
    return raw.select(key, F.map_filter(whole, lambda _, v: v.isNotNull() & (v != "")).alias("answers"))


def yes_no(c: Column) -> Column:
    """A flag of three states: Y or 1, N or 0, else null."""
    return F.when(F.upper(c).isin("Y", "YES", "1", "TRUE"), True).when(F.upper(c).isin("N", "NO", "0", "FALSE"), False)


def read_individual_feed(spark: SparkSession, path: str, tracked: DataFrame) -> dict[str, DataFrame]:
    """person, registrations and history of people ever at a tracked firm (column org_id); the first listing of a person counts."""
    # written once: a lost task that is run again with other splits would number the listings anew
    raw = Scratch(spark, "individuals").save(read_xml(spark, path, "Indvl", INDIVIDUAL_SCHEMA).withColumn("_order", F.monotonically_increasing_id()), "listed")
    raw = first_per_key(raw.withColumn("person_id", F.col("Info._indvlPK")), "person_id", [F.asc("_order")])
    now = raw.select("person_id", F.explode("CrntEmps.CrntEmp").alias("e")).select("person_id", F.col("e._orgPK").alias("org_id"), F.col("e._orgNm").alias("org_name"), F.lit("current").alias("kind"), F.array_min(F.transform("e.CrntRgstns.CrntRgstn", lambda r: parse_date(r["_stDt"]))).alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.col("e._city").alias("city"), F.col("e._state").alias("state"))
    before = raw.select("person_id", F.explode("PrevRgstns.PrevRgstn").alias("e")).select("person_id", F.col("e._orgPK").alias("org_id"), F.col("e._orgNm").alias("org_name"), F.lit("previous").alias("kind"), parse_date(F.col("e._regBeginDt")).alias("start_date"), parse_date(F.col("e._regEndDt")).alias("end_date"), F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("state"))
    regs = dedupe_employment(now.unionByName(before))
    wanted = regs.join(tracked.select("org_id").distinct(), "org_id", "left_semi").select("person_id").distinct()
    history = raw.select("person_id", F.explode("EmpHss.EmpHs").alias("e")).select("person_id", F.col("e._orgNm").alias("org_name"), org_key(F.col("e._orgNm")).alias("name_key"), parse_date(F.col("e._fromDt")).alias("start_date"), parse_date(F.col("e._toDt")).alias("end_date"), F.col("e._city").alias("city"), F.col("e._state").alias("state"))
    person = raw.select("person_id", F.col("Info._firstNm").alias("first_name"), F.col("Info._midNm").alias("middle_name"), F.col("Info._lastNm").alias("last_name"), F.col("Info._sufNm").alias("suffix"), F.transform("OthrNms.OthrNm", lambda n: F.concat_ws(" ", n["_firstNm"], n["_lastNm"])).alias("other_names"), F.transform("Dsgntns.Dsgntn", lambda n: n["_dsgntnNm"]).alias("designations"), (F.coalesce(F.size("DRPs.DRP"), F.lit(0)) > 0).alias("has_disclosure"), yes_no(F.col("Info._actvAGReg")).alias("active"))
    scoped = lambda df: df.join(wanted, "person_id", "left_semi")
    return {"person": scoped(person), "registrations": scoped(regs), "history": scoped(history)}


def current_reps(people: Mapping[str, DataFrame], targets: DataFrame) -> DataFrame:
    """(org_id, person_id, since, city, state): people now at target firms since their earliest registration there."""
    now = people["registrations"].filter("kind = 'current'").join(targets.select("org_id").distinct(), "org_id", "left_semi")
    return now.groupBy("org_id", "person_id").agg(F.min("start_date").alias("since"), F.min("city").alias("city"), F.min("state").alias("state"))


def dedupe_employment(df: DataFrame, key: Sequence[str] = ("person_id", "org_id", "kind", "start_date")) -> DataFrame:
    """One row for each key: the latest end, an open one last only if there is no other."""
    return first_per_key(df, list(key), [F.col("end_date").desc_nulls_last(), *(F.asc_nulls_last(c) for c in df.columns if c not in (*key, "end_date"))])


def drop_registered(history: DataFrame, registrations: DataFrame, key: Sequence[str] = ("person_id", "name_key", "start_date")) -> tuple[DataFrame, DataFrame]:
    """History rows that no registration of the same key repeats, and one row with how many were left out; nulls in the key repeat nothing."""
    known = registrations.select(*key).distinct()
    left = history.join(known, list(key), "left_semi").agg(F.count("*").alias("n_dropped"))
    return history.join(known, list(key), "left_anti"), left


def feed_flags(answers: DataFrame, flags: Mapping[str, str], urls: str = "urls", addresses: str = "addresses", answer: str = "answers") -> DataFrame:
    """The table with flags (name -> key of the answers map) of three states, the social platforms of its addresses on the web, and its number of offices.

    An answer that isn't there is null, not no. Platforms are sorted and named once.
    """
    platforms = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(urls, F.array().cast("array<string>")), lambda u: F.nullif(F.regexp_extract(host(u), SOCIAL, 1), F.lit(""))), lambda p: p.isNotNull())))
    return answers.select("*", *(yes_no(F.col(answer)[k]).alias(name) for name, k in flags.items()), platforms.alias("platforms"), F.coalesce(F.size(addresses), F.lit(0)).alias("n_addresses"))


def union_with_precedence(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of each table whose key no table before it has."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f.join(out.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
    return out


def read_crosswalk(df: DataFrame, filing: str, entity: str, order: Sequence[str]) -> DataFrame:
    """(filing, entity): the last entity of each filing; rows that lack either side are left out."""
    good = df.filter(F.col(filing).isNotNull() & F.col(entity).isNotNull())
    return good.groupBy(filing).agg(F.max_by(entity, F.struct(*order, entity)).alias(entity))


def resolve_with(df: DataFrame, crosswalk: DataFrame, filing: str) -> DataFrame:
    """Rows with the crosswalk's entity; those without stay, with null."""
    return df.join(crosswalk, filing, "left")


def load_archive_table(spark: SparkSession, path: str, columns: Mapping[str, str], longs: Sequence[str], crosswalk: DataFrame, filing: str) -> DataFrame:
    """Archive CSV rows under new names, counts as longs, the entity of their filing, and the raw record as JSON without empties.

    ``columns`` names the file's columns in order; every one is read as text.
    """
    raw = spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    record = F.to_json(F.map_filter(F.from_json(F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns))), "map<string,string>"), lambda _, v: v.isNotNull() & (v != "")))
    typed = raw.select(*(F.col(f"`{c}`").try_cast("double").cast("long").alias(n) if n in longs else F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(n) for c, n in columns.items()), record.alias("raw"))
    return resolve_with(typed, crosswalk, filing)


def resolution_rate(df: DataFrame, entity: str) -> DataFrame:
    """One row: rows, resolved rows, share."""
    return df.agg(F.count("*").alias("n"), F.count(entity).alias("resolved"), F.round(F.avg(F.col(entity).isNotNull().cast("double")), 6).alias("rate"))


def latest_filing_rows(df: DataFrame, key: str, filing: str) -> DataFrame:
    """Rows of each key's numerically greatest filing."""
    newest = df.groupBy(F.col(key).alias("_k")).agg(F.max(F.col(filing).try_cast("long")).alias("_f"))
    return df.join(newest, (F.col(key) == F.col("_k")) & (F.col(filing).try_cast("long") == F.col("_f"))).drop("_k", "_f")


def latest_across(frames: Sequence[DataFrame], key: str, filing: str) -> list[DataFrame]:
    """The tables with rows only of keys whose newest filing over all tables is in this one."""
    tops = [f.groupBy(F.col(key).alias("_k")).agg(F.max(F.col(filing).try_cast("long")).alias("_f")) for f in frames]
    every = tops[0]
    for t in tops[1:]:
        every = every.union(t)
    newest = every.groupBy("_k").agg(F.max("_f").alias("_f"))
    return [f.join(newest, (F.col(key) == F.col("_k")) & (F.col(filing).try_cast("long") == F.col("_f"))).drop("_k", "_f") for f in frames]


def parse_form_index(lines: DataFrame, quarter: str, form: str = "13F-HR") -> DataFrame:
    """(form, company, cik, filed, path, quarter) of an index's lines, read from the right since names overflow their column."""
    pattern = r"^(\S+)\s+(.*?)\s+(\d{1,10})\s+(\d{4}-\d{2}-\d{2})\s+(\S+)\s*$"
    part = lambda i: F.regexp_extract("value", pattern, i)
    rows = lines.filter(F.col("value").rlike(pattern) & F.col("value").startswith(form))
    return rows.select(part(1).alias("form"), part(2).alias("company"), F.lpad(part(3), 10, "0").alias("cik"), part(4).cast("date").alias("filed"), part(5).alias("path"), F.lit(quarter).alias("quarter"))


def parse_holdings(docs: DataFrame, targets: DataFrame, filing: str = "filing", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(holdings of target ids, totals of each filing) from information tables with or without a name space prefix.

    Ids have nine characters; numbers are digits only. ``targets`` (security_id, target) is joined by id.
    """
    blocks = F.regexp_extract_all(text, F.lit(r"(?is)<(?:\w+:)?infoTable(?:\s[^>]*)?>(.*?)</(?:\w+:)?infoTable>"), F.lit(1))
    rows = docs.select(filing, F.explode(blocks).alias("b"))
    pick = lambda tag: F.trim(F.regexp_extract("b", rf"(?is)<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{tag}>", 1))
    digits = lambda tag: F.nullif(F.regexp_replace(pick(tag), "[^0-9]", ""), F.lit("")).cast("long")
    typed = rows.select(filing, F.upper(pick("cusip")).alias("security_id"), pick("nameOfIssuer").alias("issuer"), digits("value").alias("value"), digits("sshPrnamt").alias("shares")).filter(F.length("security_id") == 9)
    totals = typed.groupBy(filing).agg(F.count("*").alias("positions"), F.sum("value").alias("total"), F.round(F.max("value") / F.nullif(F.sum("value"), F.lit(0)), 6).alias("largest_share"))
    return typed.join(targets, "security_id"), totals


def match_offerings(queries: DataFrame, notices: DataFrame) -> DataFrame:
    """The best notice (notice_id, name, filed) of each query (query_id, name): equal names before names that begin with it, then the newest.

    Names are compared by key. Every beginning of a notice's name is a key of its own with its best notice, so a query
    meets one row whatever the number of notices that share a first word. Blank names match nothing.
    """
    from ..operators.joins import prefix_table

    known = prefix_table(notices.select("notice_id", org_key(F.col("name")).alias("_name"), "filed"), "_name", [F.desc("filed"), F.asc("notice_id")])
    q = queries.select("query_id", org_key(F.col("name")).alias("_q"))
    return q.join(known, F.col("_q") == F.col("prefix")).select("query_id", "notice_id", "exact", "filed")


def build_history(archive: DataFrame, feed: DataFrame, key: str = "entity_id", date: str = "filing_date") -> DataFrame:
    """One row for each (entity, date): of feed snapshots the newest, the feed before the archive."""
    a = archive.withColumns({"_rank": F.lit(0), "_snap": F.lit(-1).cast("long")})
    f = feed.withColumns({"_rank": F.lit(1), "_snap": F.col("snapshot_id").cast("long")}).drop("snapshot_id")
    rows = a.unionByName(f, allowMissingColumns=True).filter(F.col(key).isNotNull() & F.col(date).isNotNull())
    rest = sorted(c for c in rows.columns if c not in (key, date, "_rank", "_snap"))
    return latest_per_key(rows, [key, date], ["_rank", "_snap", *rest]).drop("_rank", "_snap")


def backfill_history(history: DataFrame, extra: DataFrame, key: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """History with measures from ``extra`` where it has them, and whether a row changed."""
    one = extra.groupBy(*(F.col(k).alias(f"_{k}") for k in key)).agg(*(F.max(m).alias(f"_{m}") for m in measures))
    j = history.join(one, [F.col(k) == F.col(f"_{k}") for k in key], "left")
    new = {m: F.coalesce(f"_{m}", m) for m in measures}
    changed = ~F.struct(*(new[m].alias(m) for m in measures)).eqNullSafe(F.struct(*measures))
    return j.select(*(c for c in history.columns if c not in measures), *(new[m].alias(m) for m in measures), changed.alias("changed"))


def register_snapshots(files: DataFrame, registry: DataFrame, source: str) -> DataFrame:
    """New registry rows of files (path, content): what has the same source, name and hash is there already."""
    marked = files.select(F.lit(source).alias("source_key"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("sha256")).distinct()
    return marked.join(registry.select("source_key", "filename", "sha256"), ["source_key", "filename", "sha256"], "left_anti")


def export_csv(df: DataFrame, path: str) -> None:
    """Write a ranked list as CSV with a header."""
    df.write.mode("errorifexists").option("header", True).csv(path)


_POINTER = "version string, number long"


def publish(df: DataFrame, path: str) -> str:
    """Write a new version of a table below ``path`` and then point to it; readers see the old one or the new one, whole.

    Returns the version. The pointer is written last, with the number after the greatest that is there.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/versions/{version}")
    pointer = spark.createDataFrame([(version, _last_number(spark, path) + 1)], _POINTER).coalesce(1)
    pointer.write.mode("append").parquet(f"{path}/pointers")
    return version


def published(spark: SparkSession, path: str) -> DataFrame:
    """The version with the greatest number; of two that were published at once under one number the greater name."""
    version = spark.read.schema(_POINTER).parquet(f"{path}/pointers").orderBy(F.desc("number"), F.desc("version")).first().version
    return spark.read.parquet(f"{path}/versions/{version}")


def _last_number(spark: SparkSession, path: str) -> int:
    """The greatest number of a published version, 0 before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/pointers")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return 0
    return spark.read.schema(_POINTER).parquet(f"{path}/pointers").agg(F.max("number")).first()[0] or 0
